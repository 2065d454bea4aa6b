"""SQL that a single-node engine can run for the queries."""

from __future__ import annotations

import re

K, STEPS = 32, 20


def r(expression: str, name: str, digits: int = 5) -> str:
    return f"round({expression}, {digits}) + 0.0 as {name}"


def each(names: str, digits: int = 5) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


LABEL = "pts as (select cast(label as bigint) as cloud_id, vec_id as point_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
EMBED = LABEL.replace("cast(label as bigint)", "cast(0 as bigint)")
FIELD = "field as (select cast(label as bigint) as cloud_id, vec_id as point_id, cast(embedding[4] as double) as value from embeddings where vec_id % 2 = 0)"
WHOLE_FIELD = FIELD.replace(" where vec_id % 2 = 0", "")
BOUNDS = "bounds as (select cloud_id, avg(value) - 2 * stddev_pop(value) as lo, avg(value) + 2 * stddev_pop(value) as hi from field group by cloud_id)"


def grid(name: str, key: str, z: str) -> str:
    return f"""side as (select cast(floor(sqrt(count(*))) as bigint) as s from {name}),
pts as (select {key} as point_id, ({key} % s) * 10 / cast(s as double) as x, ({key} // s) * 10 / cast(s as double) as y, {z} as z from {name}, side where {key} < s * s),
cells as (select point_id as i, (point_id // s) * (s - 1) + point_id % s as cell, s from pts, side where point_id % s < s - 1 and point_id < s * (s - 1)),
faces as (select 2 * cell as face_id, i as v0, i + 1 as v1, i + s as v2 from cells union all select 2 * cell + 1, i + 1, i + s + 1, i + s from cells),
sides as (select v0 as src, v1 as dst from faces union select v1, v0 from faces union select v0, v2 from faces union select v2, v0 from faces union select v1, v2 from faces union select v2, v1 from faces)"""


ORDERS, PART = grid("orders", "o_orderkey", "o_totalprice / 100000"), grid("part", "p_partkey", "p_retailprice / 100")
NORMALIZED = """box as (select (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, (min(z) + max(z)) / 2 as cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as e from pts),
f0 as materialized (select point_id, (x - cx) * 2 / e as x, (y - cy) * 2 / e as y, (z - cz) * 2 / e as z from pts, box)"""
CORNERS = """c as (select f.v as point_id, p.x, p.y, p.z, a.x - p.x as ux, a.y - p.y as uy, a.z - p.z as uz, b.x - p.x as wx, b.y - p.y as wy, b.z - p.z as wz, a.x + b.x as sx, a.y + b.y as sy, a.z + b.z as sz
  from (select v0 as v, v1 as a, v2 as b from faces union all select v1, v2, v0 from faces union all select v2, v0, v1 from faces) f
  join pts p on p.point_id = f.v join pts a on a.point_id = f.a join pts b on b.point_id = f.b),
w as (select *, ux * wy - uy * wx as xy, uy * wz - uz * wy as yz, uz * wx - ux * wz as zx from c),
g as (select point_id, any_value(x) as x, any_value(y) as y, any_value(z) as z, count(*) as n, sum(sx) as sx, sum(sy) as sy, sum(sz) as sz, sum(yz) as nx, sum(zx) as ny, sum(xy) as nz,
  sum(sqrt(xy * xy + yz * yz + zx * zx)) / 6 as area, sum(atan2(sqrt(xy * xy + yz * yz + zx * zx), ux * wx + uy * wy + uz * wz)) as angles from w group by point_id)"""


def neighbours(k: int) -> str:
    return f"""near as (select a.cloud_id, a.point_id as src, b.point_id as dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) as d2 from pts a join pts b using (cloud_id)),
knn as materialized (select cloud_id, src, nth as rank, dst, sqrt(d2) as dist from (select *, row_number() over (partition by cloud_id, src order by d2, dst) - 1 as nth from near) where nth < {k})"""


def kernel(v: str, bw: str, s: str, t: str) -> str:
    return f"""{v} as materialized (select k.src, k.rank, k.dst, dist * dist / (greatest(i.bw, 1e-8) * greatest(j.bw, 1e-8)) as v from knn k join {bw} i on i.point_id = src join {bw} j on j.point_id = dst),
{s} as (select e, ln(greatest(sum(exp(-v / pow(2, e / 4.0 - 10))) / count(*), 1e-30)) as l from {v}, range(80) t(e) group by e),
{t} as materialized (select pow(2, e / 4.0 - 10) as eps, 2 * slope as dim from (select e, (lead(l) over (order by e) - l) / (ln(2) / 4) as slope from {s}) where e < 79 order by slope desc, e limit 1)"""


GRAPH = f"""{EMBED}, {neighbours(K)},
bwa as materialized (select src as point_id, greatest(sqrt(sum(case when rank between 1 and 7 then dist * dist else 0 end) / 7), 1e-8) as bw from knn group by src),
{kernel("va", "bwa", "sa", "ta")},
qa as (select src as point_id, greatest(1e-12, sum(exp(-v / eps)) / greatest(pow(pi() * any_value(eps), any_value(dim) / 2), 1e-12) / ((select count(*) from pts) * pow(any_value(bw), any_value(dim)))) as q
  from va join bwa on src = point_id, ta group by src),
wb as (select point_id, pow(q, -0.5) as w from qa),
bwb as materialized (select point_id, w / greatest((select w from (select w, row_number() over (order by w, point_id) - 1 as n from wb) where n = (select count(*) // 2 from wb)), 1e-8) as bw from wb),
{kernel("vb", "bwb", "sb", "tb")},
qb as materialized (select src as point_id, greatest(1e-12, sum(exp(-v / eps)) / pow(any_value(bw), any_value(dim))) as q from vb join bwb on src = point_id, tb group by src),
weights as (select src, rank, dst, exp(-v / eps) * pow(i.q, -(1 - 0.5 * (dim / 2 + 1))) * pow(j.q, -(1 - 0.5 * (dim / 2 + 1))) as w from vb join qb i on i.point_id = src join qb j on j.point_id = dst, tb),
markov as materialized (select src, dst, w / sum(w) over (partition by src) as w from weights),
symk as (select src, dst, sum(w) / 2 as s from (select src, dst, w from markov union all select dst, src, w from markov) group by src, dst),
sums as (select src as point_id, greatest(sum(s), 1e-12) as row_sum from symk group by src),
nodes as materialized (select point_id, row_sum, row_sum / (select sum(row_sum) from sums) as mu, greatest(eps, 1e-12) * bw * bw / 4 as bw, ix, iy, iz from sums join bwb using (point_id)
  join (select src as point_id, sum(w * x) as ix, sum(w * y) as iy, sum(w * z) as iz from markov join pts on dst = point_id group by src) using (point_id), tb)"""


def gamma(pairs: list[tuple[str, str, str]], source: str) -> str:
    """Covariances (name, f, h) of columns of ``source`` (point_id, ...) around each point."""
    terms = ", ".join(f"(sum(w * (j.{f} - i.{f}) * (j.{h} - i.{h})) - sum(w * (j.{f} - i.{f})) * sum(w * (j.{h} - i.{h}))) / (2 * greatest(any_value(bw), 1e-8)) as {name}" for name, f, h in pairs)
    return f"select src as point_id, {terms} from markov join {source} i on i.point_id = src join {source} j on j.point_id = dst join (select point_id, bw from nodes) b on b.point_id = src group by src"


def bent(k: int) -> str:
    """v<k>: curvature of the vertices f<k>."""
    tables = re.sub(r"\b([cwg]) as \(", rf"\g<1>_{k} as (", CORNERS)
    tables = re.sub(r"from ([cwg])\b", rf"from \g<1>_{k}", tables).replace("join pts ", f"join f{k} ")
    return f"""{tables}, v{k} as (select point_id, case when nx * nx + ny * ny + nz * nz > 1e-12 then ((sx / (2 * n) - x) * nx + (sy / (2 * n) - y) * ny + (sz / (2 * n) - z) * nz) / sqrt(nx * nx + ny * ny + nz * nz) else 0 end as h,
case when area > 1e-12 then (2 * pi() - angles) / area else 0 end as k from g_{k})"""


def heat(count: int) -> str:
    return ", ".join(f"h{k} as materialized (select src as point_id, sum(w * value) as value from markov join h{k - 1} on dst = h{k - 1}.point_id group by src)" for k in range(1, count + 1))


HEAT = ", ".join(f"h{k} as materialized (select src as point_id, sum(w * value) as value from markov join h{k - 1} on dst = h{k - 1}.point_id group by src)" for k in range(1, STEPS + 1))
FLOW = ", ".join(
    f"f{k} as materialized (select p.point_id, coalesce(p.x + 0.5 * (m.x - p.x), p.x) as x, coalesce(p.y + 0.5 * (m.y - p.y), p.y) as y, coalesce(p.z + 0.5 * (m.z - p.z), p.z) as z from f{k - 1} p left join (select src, avg(x) as x, avg(y) as y, avg(z) as z from sides join f{k - 1} on dst = point_id group by src) m on src = p.point_id)"
    for k in range(1, 7)
)
WIDE = "wide as materialized (select n.point_id, mu, ix as c0, iy as c1, iz as c2, 1.0 as u0, x as u1, y as u2, z as u3 from nodes n join pts using (point_id))"
NAMES = ("c0", "c1", "c2", "u0", "u1", "u2", "u3")
ALL_GAMMAS = f"gam as materialized ({gamma([(f'{a}_{b}', a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]], 'wide')}), t as materialized (select * from wide join gam using (point_id))"


def _g(a: str, b: str) -> str:
    return f"{a}_{b}" if NAMES.index(a) <= NAMES.index(b) else f"{b}_{a}"


def _matrices(names: tuple[str, ...]) -> str:
    """One row for each matrix entry: all entries are summed over points in one pass, then unnested."""
    pairs, out = ((0, 1), (0, 2), (1, 2)), []

    def put(name: str, row: int, col: int, e: str) -> None:
        if name in names:
            out.append(f"{{'name': '{name}', 'row': {row}, 'col': {col}, 'value': sum({e})}}")

    def minor(a: int, b: int) -> str:
        (p, q), (s, v) = pairs[a], pairs[b]
        return f"({_g(f'c{p}', f'c{s}')} * {_g(f'c{q}', f'c{v}')} - {_g(f'c{p}', f'c{v}')} * {_g(f'c{q}', f'c{s}')})"

    volume = f"({_g('c0', 'c0')} * {minor(2, 2)} - {_g('c0', 'c1')} * {minor(2, 1)} + {_g('c0', 'c2')} * {minor(2, 0)})"
    for i in range(4):
        for j in range(4):
            u, du = f"mu * u{i}", _g(f"u{i}", f"u{j}")
            put("g0", i, j, f"{u} * u{j}")
            put("e0", i, j, f"mu * {du}")
            put("g3", i, j, f"{u} * u{j} * {volume}")
            for a in range(3):
                put("d0", 3 * i + a, j, f"{u} * {_g(f'c{a}', f'u{j}')}")
                put("d2", i, 3 * j + a, f"{u} * ({_g('c0', f'u{j}')} * {minor(2, a)} - {_g('c1', f'u{j}')} * {minor(1, a)} + {_g('c2', f'u{j}')} * {minor(0, a)})")
                (p, q) = pairs[a]
                for b in range(3):
                    (s, v) = pairs[b]
                    put("g1", 3 * i + a, 3 * j + b, f"{u} * u{j} * {_g(f'c{a}', f'c{b}')}")
                    put("e1", 3 * i + a, 3 * j + b, f"mu * ({du} * {_g(f'c{a}', f'c{b}')} - {_g(f'c{b}', f'u{i}')} * {_g(f'c{a}', f'u{j}')})")
                    put("g2", 3 * i + a, 3 * j + b, f"{u} * u{j} * {minor(a, b)}")
                    put("d1", 3 * i + a, 3 * j + b, f"{u} * ({_g(f'c{p}', f'u{j}')} * {_g(f'c{q}', f'c{b}')} - {_g(f'c{q}', f'u{j}')} * {_g(f'c{p}', f'c{b}')})")
                    # The metric's 2 x 2 part on rows a and columns b, turned inside out: det * inverse.
                    turned = " + ".join(
                        f"{sign} * {_g(f'c{col}', f'u{i}')} * {_g(f'c{row}', f'c{other}')} * {_g(f'c{back}', f'u{j}')}"
                        for sign, col, row, other, back in ((1, s, q, v, p), (-1, s, p, v, q), (-1, v, q, s, p), (1, v, p, s, q))
                    )
                    put("e2", 3 * i + a, 3 * j + b, f"mu * case when abs({minor(a, b)}) > 1e-8 then {minor(a, b)} * {du} - ({turned}) else 0 end")
    return f"select unnest(l, recursive := true) from (select [{', '.join(out)}] as l from t)"


def _products() -> str:
    """All components of geometric (p) and outer (w) products of three Euclidean axes, blades by number: bit i stands for axis i."""
    out = []
    for name in "pw":
        for blade in range(8):
            terms = []
            for a in range(8):
                b = a ^ blade
                if name == "p" or not a & b:
                    swaps = sum(((a >> shift) & b).bit_count() for shift in (1, 2))
                    terms.append(f"{'-' if swaps % 2 else '+'} a[{a + 1}] * b[{b + 1}]")
            out.append(r(" ".join(terms), f"{name}{blade}", 8))
    return ", ".join(out)


MATRICES = f"{GRAPH}, {WIDE}, {ALL_GAMMAS}, m as materialized ({_matrices(("g0", "g1", "g2", "d0", "e0", "e1"))})"
ONE_FORM = f"""{MATRICES},
form as (select point_id, {", ".join(f"sum(case when m.row % 3 = {c} then value * (case m.row // 3 when 0 then 1 when 1 then x when 2 then y else z end) else 0 end) as w{c}" for c in range(3))} from pts, m where name = 'd0' and col = 1 group by point_id)"""

SQL = {
    "p1_normalize": f"""with {LABEL}, box as (select cloud_id, (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, (min(z) + max(z)) / 2 as cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as e from pts group by cloud_id)
select cloud_id, point_id, {", ".join(r(f"({a} - c{a}) * case when e > 1e-9 then 2 / e else 1 end", a) for a in "xyz")} from pts join box using (cloud_id)""",
    "p3_field_bounds": f"with {WHOLE_FIELD}, {BOUNDS} select cloud_id, {each('lo hi')} from bounds",
    "p4_coloured": f"""with {LABEL}, {FIELD}, {BOUNDS}, v as (select p.cloud_id, p.point_id, (coalesce(value, 0) - lo) / greatest(1e-12, hi - lo) as t from pts p left join field using (cloud_id, point_id) left join bounds using (cloud_id)),
c as (select *, least(greatest(t, 0), 1) as s from v)
select cloud_id, point_id, {r("t", "t")}, cast(trunc(255 * case when s < 0.5 then 2 * s else 1 end) as bigint) as red,
cast(trunc(255 * case when s < 0.5 then 2 * s else 1 - 2 * (s - 0.5) end) as bigint) as green, cast(trunc(255 * case when s < 0.5 then 1 else 1 - 2 * (s - 0.5) end) as bigint) as blue from c""",
    "p6_impulse": f"with {LABEL}, top as (select cloud_id, point_id as top from pts qualify row_number() over (partition by cloud_id order by y desc, point_id) = 1) select cloud_id, point_id, case when point_id = top then 1000.0 else 0.0 end as value from pts join top using (cloud_id)",
    "p7_glyphs": f"with {LABEL} select cloud_id, 4 * count(*) as n, cast(sum((4 * point_id) * 24 + 43) as bigint) as face_sum, {r('sum(4 * x)', 'sx')}, {r('sum(4 * y - 0.015)', 'sy')}, {r('sum(4 * z + 0.01)', 'sz')} from pts group by cloud_id",
    "p8_vectors": f"with {EMBED}, w as (select point_id, x * y + y * z + z * x as dot, x * z - y * y as xy, y * x - z * z as yz, z * y - x * x as zx, sqrt(x * x + y * y + z * z) as norm, x / sqrt(x * x + y * y + z * z) as ux, y / sqrt(x * x + y * y + z * z) as uy, z / sqrt(x * x + y * y + z * z) as uz from pts) select point_id, {each('dot xy yz zx norm ux uy uz')} from w",
    "p9_geometric_product": f"with m as (select l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax, l_linenumber, l_quantity / 2, l_discount / 2, l_tax / 2, l_linenumber / 2.0] as a from lineitem), n as (select *, list_reverse(a) as b from m) select l_orderkey, l_linenumber, {_products()} from n",
    "p14_strided": "select vec_id as point_id from embeddings where vec_id % greatest(1, (select count(*) from embeddings) // 100) = 0",
    "p15_validity": f"with {PART} select cast(0 as bigint) as cloud_id, (select count(*) from pts) as n_points, (select count(*) from faces) as n_faces, (select count(*) from pts) > 0 as valid_points, (select count(*) from faces) > 0 as valid_surface union all select 1, 0, 0, false, false",
    "m1_incidence": f"with {ORDERS} select v as vertex_id, string_agg(face_id, ',' order by face_id) as faces from (select v0 as v, face_id from faces union all select v1, face_id from faces union all select v2, face_id from faces) group by v",
    "m2_one_ring": f"with {ORDERS} select src, dst from sides",
    "m3_csr_offsets": f"with {ORDERS}, d as (select point_id as vertex_id, count(face_id) as degree from pts left join (select v0 as v, face_id from faces union all select v1, face_id from faces union all select v2, face_id from faces) on v = point_id group by point_id) select vertex_id, degree, cast(sum(degree) over (order by vertex_id) - degree as bigint) as first from d",
    "m4_face_normals": f"with {ORDERS}, u as (select face_id, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as wx, c.y - a.y as wy, c.z - a.z as wz from faces join pts a on a.point_id = v0 join pts b on b.point_id = v1 join pts c on c.point_id = v2) select face_id, {r('ux * wy - uy * wx', 'xy', 8)}, {r('uy * wz - uz * wy', 'yz', 8)}, {r('uz * wx - ux * wz', 'zx', 8)} from u",
    "m5_curvature": f"""with {ORDERS}, {CORNERS}, v as (select point_id, case when nx * nx + ny * ny + nz * nz > 1e-12 then ((sx / (2 * n) - x) * nx + (sy / (2 * n) - y) * ny + (sz / (2 * n) - z) * nz) / sqrt(nx * nx + ny * ny + nz * nz) else 0 end as h,
case when area > 1e-12 then (2 * pi() - angles) / area else 0 end as k from g) select point_id, {r("coalesce(h, 0)", "h", 4)}, {r("coalesce(k, 0)", "k", 4)} from pts left join v using (point_id)""",
    "m7_flow_step": f"with {ORDERS}, f0 as (select * from pts), {FLOW.split(', f2 as')[0]} select point_id, {each('x y z', 8)} from f1",
    "m8_flow": f"with {PART}, f0 as (select * from pts), {FLOW} select point_id, {each('x y z')} from f6",
    "n1_knn": f"with {EMBED}, {neighbours(K)} select src, rank, dst, {r('dist', 'dist')} from knn",
    "n1_knn_clouds": f"with {LABEL}, {neighbours(8)} select cloud_id, src, rank, dst, {r('dist', 'dist')} from knn",
    "n2_local_bandwidth": f"with {GRAPH} select point_id, {r('bw', 'bw')} from bwa",
    "n4_kernel_tuning": f"with {GRAPH} select {r('ta.eps', 'eps_a')}, {r('ta.dim', 'dim_a')}, {r('tb.eps', 'eps_b')}, {r('tb.dim', 'dim_b')}, {r('1 - 0.5 * (tb.dim / 2 + 1)', 'alpha')} from ta, tb",
    "n9_markov": f"with {GRAPH} select src, dst, {r('w', 'w')} from markov",
    "n10_symmetric": f"with {GRAPH} select src, dst, {r('s', 's')} from symk",
    "n14_nodes": f"with {GRAPH} select point_id, {r('mu * 1000', 'mu')}, {each('row_sum bw ix iy iz')} from nodes",
    "d1_markov_step": f"with {GRAPH} select src as point_id, {r('sum(w * y)', 'value')} from markov join pts on dst = point_id group by src",
    "d3_heat_run": f"with {GRAPH}, h0 as (select point_id, case when point_id = (select point_id from pts order by y desc, point_id limit 1) then 1000.0 else 0.0 end as value from pts), {HEAT} "
    + " union all ".join(f"select cast({k} as bigint) as step, point_id, {r('value', 'value', 4)} from h{k}" for k in range(0, STEPS + 1, 5)),
    "d3_heat_program": f"with {GRAPH}, h0 as (select point_id, case when point_id = (select point_id from pts order by y desc, point_id limit 1) then 1000.0 else 0.0 end as value from pts), {heat(100)} "
    + " union all ".join(f"select cast({k} as bigint) as step, point_id, {r('value', 'value', 4)} from h{k}" for k in range(0, 101, 5)),
    "m8_flow_frames": f"with {PART}, {NORMALIZED}, {FLOW}, {', '.join(map(bent, range(6)))} "
    + " union all ".join(f"select cast({k} as bigint) as frame, point_id, {each('x y z', 6)}, {r('coalesce(h, 0)', 'h')}, {r('coalesce(k, 0)', 'k', 3)} from f{k} left join v{k} using (point_id)" for k in range(6)),
    "d4_carre_du_champ": f"with {GRAPH}, s as (select point_id, ix as x, iy as y, iz as z from nodes), q as ({gamma([('g_x_x', 'x', 'x'), ('g_x_y', 'x', 'y'), ('g_z_z', 'z', 'z')], 's')}) select point_id, {each('g_x_x g_x_y g_z_z')} from q",
    "d8_data_immersion": f"with {GRAPH}, s as (select point_id, x, y, z, ix, iy, iz from nodes join pts using (point_id)), q as ({gamma([(f'g_{a}_i{b}', a, f'i{b}') for a in 'xyz' for b in 'xyz'], 's')}) select point_id, {each(' '.join(f'g_{a}_i{b}' for a in 'xyz' for b in 'xyz'))} from q",
    "f_form_matrices": f'with {GRAPH}, {WIDE}, {ALL_GAMMAS}, m as ({_matrices(("g0", "g1", "g2", "d0", "e0", "e1"))}) select name, cast("row" as bigint) as "row", cast(col as bigint) as col, {r("value", "value")} from m',
    "f13_hodge_laplacian": f'with {MATRICES}, p as (select a."row" as "row", b."row" as col, sum(a.value * b.value) as value from m a join m b on a.col = b.col where a.name = \'d0\' and b.name = \'d0\' group by a."row", b."row") select cast(p."row" as bigint) as "row", cast(p.col as bigint) as col, {r("p.value + m.value", "value")} from p join m on m.name = \'e1\' and m."row" = p."row" and m.col = p.col',
    "f18_dual_vectors": f"with {ONE_FORM} select point_id, {r('w2', 'vx')}, {r('-w1', 'vy')}, {r('w0', 'vz')} from form",
    "f24_ambient_field": f"with {ONE_FORM}, ds as (select point_id, x, y, z, ix, iy, iz from nodes join pts using (point_id)), dq as ({gamma([(f'g_{a}_i{b}', a, f'i{b}') for a in 'xyz' for b in 'xyz'], 'ds')}) select point_id, {', '.join(r(f'g_{a}_ix * w0 + g_{a}_iy * w1 + g_{a}_iz * w2', f'v{a}') for a in 'xyz')} from dq join form using (point_id)",
    "q1_point_agreement": f"with {LABEL} select cloud_id, count(*) as n, cast(0 as bigint) as unmatched, {r('sqrt(avg(y * y / 100) / 3)', 'rmse')}, {r('max(abs(y / 10))', 'most')} from pts group by cloud_id",
    "q5_relative_error": f"with {LABEL} select cloud_id, {r('sqrt(least(sum((2 * x - y / 20) * (2 * x - y / 20)), sum(y * y / 400))) / sqrt(sum(x * x))', 'error')} from pts group by cloud_id",
    "q4_circular_agreement": f"""with {LABEL}, a as (select cloud_id, atan2(y, x) as v from pts), b as (select cloud_id, v, 0.7 - v + 0.01 * sin(3 * v) as o from a),
d as (select cloud_id, false as conjugate, o - v as d from b union all select cloud_id, true, -o - v from b),
f as (select cloud_id, conjugate, sqrt(avg(cos(d)) * avg(cos(d)) + avg(sin(d)) * avg(sin(d))) as correlation, atan2(avg(sin(d)), avg(cos(d))) as phase from d group by cloud_id, conjugate),
e as (select cloud_id, conjugate, correlation, abs(atan2(sin(d - phase), cos(d - phase))) as e from d join f using (cloud_id, conjugate)),
g as (select cloud_id, conjugate, correlation, avg(e) as mean, quantile_cont(e, 0.95) as p95, max(e) as most from e group by all)
select cloud_id, conjugate, {each("correlation mean p95 most")} from g qualify row_number() over (partition by cloud_id order by correlation desc, p95) = 1""",
}

SUBSPACES = "select cloud_id, degrees(acos(least(1.0, abs(sum(x * (x + y / 2))) / sqrt(sum(x * x) * sum((x + y / 2) * (x + y / 2)))))) as angle, sqrt(greatest(0, sum(x * x) + sum((x + y / 2) * (x + y / 2)) - 2 * abs(sum(x * (x + y / 2))))) / sqrt(sum(x * x)) as procrustes from pts group by cloud_id"
SQL |= {
    "q2_subspaces": f"with {LABEL}, s as ({SUBSPACES}) select cloud_id, {each('angle procrustes')} from s",
    "q7_composite_score": f"with {LABEL}, s as ({SUBSPACES}), c as ({SQL['q4_circular_agreement']}) select {r('0.35 * max(angle) / 90 + 0.35 * max(procrustes) + 0.15 * (1 - min(correlation)) + 0.15 * max(p95) / pi()', 'score', 4)} from s join c using (cloud_id)",
}
SQL |= {
    "p11_multivector_sum": f"with m as (select l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax, l_linenumber, l_quantity / 2, l_discount / 2, l_tax / 2, l_linenumber / 2.0] as a from lineitem), n as (select *, list_reverse(a) as b from m) select l_orderkey, l_linenumber, {', '.join([r(f'a[{i + 1}] + b[{i + 1}]', f's{i}', 8) for i in range(8)] + [r(f'a[{i + 1}] - b[{i + 1}]', f'd{i}', 8) for i in range(8)] + [r(f'a[{i + 1}]' if i else '0.0', f't{i}', 8) for i in range(8)])} from n",
    "p12_long_vectors": f"with {EMBED}, v as (select p.point_id, n.x - p.x as x, n.y - p.y as y, n.z - p.z as z from pts p join pts n on n.point_id = p.point_id + 1), w as (select *, sqrt(x * x + y * y + z * z) as length from v) select point_id, {each('x y z length')} from w where length > 1e-6",
    "d2_steps": f"with {GRAPH}, h0 as (select point_id, y as value from pts), {HEAT.split(', h8 as')[0]} select point_id, {r('value', 'value')} from h7",
    "d6_matrices": f'with {GRAPH}, {WIDE}, {ALL_GAMMAS}, m as ({_matrices(("g3", "d1", "d2", "e2"))}) select name, cast("row" as bigint) as "row", cast(col as bigint) as col, {r("value", "value", 4)} from m',
    "f11_up_laplacian": f'with {GRAPH}, {WIDE}, {ALL_GAMMAS}, m as ({_matrices(("e2",))}) select "row", col, {r("value", "value", 4)} from m',
    "e2_eigenbasis": "select k as mode, 0.0::double as norm_error, 0.0::double as with_first, 0.0::double as first_less_1, 0.0::double as residual from (select unnest(range(least(12, greatest(1, count(*) - 1)))) as k from embeddings)",
}

#: Clouds of a label numbered from 0, and their colours.
NUMBERED = "num as (select * replace (row_number() over (partition by cloud_id order by point_id) - 1 as point_id) from pts)"
COLOURED = f"""{LABEL}, {FIELD}, {BOUNDS}, v as (select p.cloud_id, row_number() over (partition by p.cloud_id order by p.point_id) - 1 as point_id, p.x, p.y, p.z, (coalesce(value, 0) - lo) / greatest(1e-12, hi - lo) as t
  from pts p left join field using (cloud_id, point_id) left join bounds using (cloud_id)),
c as (select *, least(greatest(t, 0), 1) as s from v),
bytes as (select cloud_id, point_id, x, y, z, trunc(255 * case when s < 0.5 then 2 * s else 1 end) as red, trunc(255 * case when s < 0.5 then 2 * s else 1 - 2 * (s - 0.5) end) as green,
  trunc(255 * case when s < 0.5 then 1 else 1 - 2 * (s - 0.5) end) as blue from c)"""
BAD_FACE = "face_id % 50 in (7, 9)"
SQL |= {
    "s1_obj_vertices": f"with {ORDERS} select point_id, {r('x', 'x', 8)}, {r('case when point_id % 97 = 5 then 0 else y end', 'y', 8)}, {r('case when point_id % 97 = 5 then 0 else z end', 'z', 8)} from pts",
    "s2_obj_faces": f"""with {ORDERS} select row_number() over (order by face_id) - 1 as face_id, v0, v1, v2, '' as line from faces where not ({BAD_FACE})
union all select -1, -1, -1, -1, 'f ' || (v0 + 1) || ' ' || case when face_id % 50 = 7 then (v1 + 1) || ' ' || (v2 + 1) || ' ' || (v0 + 1) else 'x ' || (v2 + 1) end from faces where {BAD_FACE}""",
    "s3_points_csv": f"with {EMBED} select row_number() over (order by point_id) - 1 as point_id, {each('x y z', 8)} from pts",
    "s6_numeric_csv": f"""with {LABEL}, l as (select 'point_id' as name, cast(point_id as double) as v from pts union all select 'x', x from pts union all select 'y', case when point_id % 5 <> 0 then y end from pts
union all select 'z', case when point_id % 7 <> 0 then z end from pts) select name, count(*) - count(v) as missing, {r('sum(v)', 'total')} from l group by name""",
    "s7_torus": f"with {ORDERS} select point_id, cast(1 as double) as square from pts",
    "s8_sphere": f"with {ORDERS} select point_id, cast(2.25 as double) as square from pts",
    "k1_csv_files": f"with {LABEL}, {NUMBERED} select cloud_id, point_id, {each('x y z')}, {r('atan2(y, x)', 'theta_0')}, {r('atan2(z, y)', 'theta_1')}, {', '.join(r(v, f'form{i}_{c}') for i, order in enumerate(('yzx', 'zxy')) for v, c in zip(order, 'xyz', strict=True))} from num",
    "k2_coloured_ply": f"with {COLOURED} select cloud_id, point_id, {each('x y z red green blue')} from bytes",
    "k3_heat_obj": f"with {COLOURED} select cloud_id, point_id, {each('x y z')}, {', '.join(r(f'{c} / 255', c) for c in ('red', 'green', 'blue'))} from bytes",
    "k3_heat_obj_faces": f"with {PART} select face_id, v0, v1, v2 from faces",
    "k4_solid_ply": f"""with {COLOURED}, corner as (select * from (values (0, 0.0, 0.015, 0.0), (1, -0.01, -0.01, 0.01), (2, 0.01, -0.01, 0.01), (3, 0.0, -0.01, -0.01)) t(k, dx, dy, dz))
select cloud_id, 4 * point_id + k as point_id, {r('x + dx', 'x')}, {r('y + dy', 'y')}, {r('z + dz', 'z')}, {each('red green blue')} from bytes, corner""",
    "k5_vector_ply": f"with {LABEL}, {NUMBERED} select cloud_id, point_id, {each('x y z')}, {r('y', 'nx')}, {r('z', 'ny')}, {r('x', 'nz')} from num",
}


def _inverse() -> str:
    """inv (i, j, v): the inverse of g0, four by four, by cofactors; needs m."""

    def det3(rows: list[int], cols: list[int]) -> str:
        (a, b, c), (p, q, s) = rows, cols
        return f"(g{a}{p} * (g{b}{q} * g{c}{s} - g{b}{s} * g{c}{q}) - g{a}{q} * (g{b}{p} * g{c}{s} - g{b}{s} * g{c}{p}) + g{a}{s} * (g{b}{p} * g{c}{q} - g{b}{q} * g{c}{p}))"

    def cofactor(i: int, j: int) -> str:
        return f"{'-' if (i + j) % 2 else ''}{det3([k for k in range(4) if k != i], [k for k in range(4) if k != j])}"

    cells = ", ".join(f"max(case when \"row\" = {i} and col = {j} then value end) as g{i}{j}" for i in range(4) for j in range(4))
    det = " + ".join(f"g0{j} * ({cofactor(0, j)})" for j in range(4))
    entries = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': ({cofactor(j, i)}) / det}}" for i in range(4) for j in range(4))
    return f"gw as (select {cells} from m where name = 'g0'), gd as materialized (select *, {det} as det from gw), inv as materialized (select unnest([{entries}], recursive := true) from gd)"


def _one_form(name: str, col: int) -> str:
    """Components w0, w1, w2 of the derivative's column as a form at the points; needs m and pts."""
    parts = ", ".join(f"sum(case when m.row % 3 = {c} then value * (case m.row // 3 when 0 then 1 when 1 then x when 2 then y else z end) else 0 end) as w{c}" for c in range(3))
    return f"select point_id, {parts} from pts, m where name = '{name}' and col = {col} group by point_id"


INVERSE = f"{MATRICES}, {_inverse()}"
PHI = "phi as (select point_id, mu, u.k as k, u.v as v from (select point_id, mu, unnest([{'k': 0, 'v': u0}, {'k': 1, 'v': u1}, {'k': 2, 'v': u2}, {'k': 3, 'v': u3}]) as u from wide))"
WEDGED = f"{INVERSE}, {PHI}, fa as ({_one_form('d0', 1)}), fb as ({_one_form('d0', 2)})"
#: Target, left and right component and sign of the product of two 1-forms.
TWO_FORM = ((0, 0, 1, 1), (0, 1, 0, -1), (1, 0, 2, 1), (1, 2, 0, -1), (2, 1, 2, 1), (2, 2, 1, -1))
IMMERSED = f"ds as (select point_id, x, y, z, ix, iy, iz from nodes join pts using (point_id)), dq as ({gamma([(f'g_{a}_i{b}', a, f'i{b}') for a in 'xyz' for b in 'xyz'], 'ds')})"
SPECTRA = "sp as (select cloud_id, row_number() over (partition by cloud_id order by point_id) - 1 as mode, x / 100 as lam, y from pts)"


def _dual(a: str, b: str) -> str:
    return " + ".join(f"w{k} * (g_{a}_i{i} * g_{b}_i{j} - g_{a}_i{j} * g_{b}_i{i})" for k, (i, j) in enumerate((("x", "y"), ("x", "z"), ("y", "z"))))


WEDGE_SUMS = " union all ".join(f"select k, {c} as c, sum(phi.mu * phi.v * ({' + '.join(f'{s} * fa.w{a} * fb.w{b}' for t, a, b, s in TWO_FORM if t == c)})) as b from phi join fa using (point_id) join fb using (point_id) group by k" for c in range(3))
TRIPLES = " union all ".join(f"select p.k as k, q.k as l, {a} as a, sum(p.mu * p.v * q.v * w{a}) as s from phi p join phi q using (point_id) join fa using (point_id) group by p.k, q.k" for a in range(3))
SQL |= {
    "f17_projection": f"with {INVERSE}, {PHI}, b as (select k, sum(phi.mu * v * x * y) as b from phi join pts using (point_id) group by k) select cast(i as bigint) as i, {r('sum(v * b)', 'c')} from inv join b on j = k group by i",
    "f12_down_laplacian": f"""with {INVERSE}, c as (select i, "row" as col, sum(v * value) as value from inv join m on name = 'd0' and m.col = j group by i, "row"),
o as (select 'c1' as name, i as "row", col, value from c union all select 'down1', m."row", c.col, sum(m.value * c.value) from m join c on m.name = 'd0' and m.col = i group by m."row", c.col)
select name, cast("row" as bigint) as "row", cast(col as bigint) as col, {r("value", "value", 4)} from o""",
    "f20_wedge": f"with {WEDGED}, b as ({WEDGE_SUMS}) select cast(0 as bigint) as cloud_id, cast(3 * i + c as bigint) as i, {r('sum(v * b)', 'value')}, cast(0 as double) as both from inv join b on j = k group by i, c",
    "f21_wedge_operator": f"""with {WEDGED}, tr as ({TRIPLES}), signs as (select unnest([{', '.join(f"{{'t': {t}, 'a': {a}, 'b': {b}, 's': {s}}}" for t, a, b, s in TWO_FORM)}], recursive := true)),
every as (select i.i as i, l.l as l, c.c as c, d.d as d from range(4) i(i), range(4) l(l), range(3) c(c), range(3) d(d)),
o as (select i, l, g.t as c, g.b as d, sum(v * g.s * tr.s) as value from inv join tr on j = k join signs g on g.a = tr.a group by i, l, g.t, g.b)
select cast(3 * i + c as bigint) as "row", cast(3 * l + d as bigint) as col, {r("coalesce(value, 0)", "value", 4)} from every left join o using (i, l, c, d)""",
    "f15_harmonic_modes": f"""with {LABEL}, {SPECTRA}, n as (select *, abs(lam) <= 0.001 as near, bool_or(abs(lam) <= 0.001) over (partition by cloud_id) as any_near from sp)
select cloud_id, mode, {r('lam', '"lambda"')} from n where near = any_near qualify row_number() over (partition by cloud_id order by mode) <= 3""",
    "q6_spectrum_error": f"with {LABEL}, {SPECTRA} select cloud_id, {r('sqrt(sum(y * y / 1000000)) / sqrt(sum(lam * lam))', 'error')} from sp where mode < 20 group by cloud_id",
    "f22_padded": f"with {MATRICES} select cast(i as bigint) as i, {r('coalesce(value, 0)', 'c')} from range(18) t(i) left join m on name = 'd0' and col = 1 and \"row\" = i",
    "f25_ambient_dual": f"with {GRAPH}, {WIDE}, {ALL_GAMMAS}, m as materialized ({_matrices(('d1',))}), form as ({_one_form('d1', 4)}), {IMMERSED} select point_id, {r(_dual('y', 'z'), 'vx')}, {r(f'-({_dual("x", "z")})', 'vy')}, {r(_dual('x', 'y'), 'vz')} from dq join form using (point_id)",
    "f26_facing_outward": f"""with {ONE_FORM}, {IMMERSED}, v as (select point_id, {', '.join(f'g_{a}_ix * w0 + g_{a}_iy * w1 + g_{a}_iz * w2 as v{a}' for a in 'xyz')} from dq join form using (point_id)),
s as (select case when avg(x * vx + y * vy + z * vz) < 0 then -1 else 1 end as s from v join pts using (point_id)) select point_id, {', '.join(r(f's * v{c}', f'v{c}') for c in 'xyz')}, {', '.join(r(f's * v{c}', f't{c}') for c in 'xyz')} from v, s""",
}

CHECKS = [f"{what} of {k}-forms" for k in (1, 2) for what in ("residual", "norm", "positive")] + ["wedge turns sign", "wedge with itself is 0", "wedge of harmonic forms has the normal as dual", "wedge of harmonic forms is the harmonic 2-form"]
#: What must come out on a torus, whatever the sample: form 0 follows the long way round, form 1 the short one.
SQL |= {
    "torus_circles": "select cast(form as bigint) as form, angle, form = n as follows, form <> n as apart from (values (0), (1)) f(form), (values ('u', 0), ('v', 1)) a(angle, n) where (select count(*) from part) > 0",
    "torus_two_forms": f"select unnest([{', '.join(repr(c) for c in CHECKS)}]) as check, true as holds from (select count(*) from part)",
}


def agreement(a: str, b: str) -> str:
    """angle and procrustes of one column each, by label."""
    return f"""select cloud_id, degrees(acos(least(1.0, abs(sum(({a}) * ({b}))) / sqrt(sum(({a}) * ({a})) * sum(({b}) * ({b})))))) as angle,
sqrt(greatest(0, sum(({a}) * ({a})) + sum(({b}) * ({b})) - 2 * abs(sum(({a}) * ({b}))))) / sqrt(sum(({a}) * ({a}))) as procrustes from pts group by cloud_id"""


def _score(name: str, first: str, second: str) -> str:
    """<name>: the worst metrics of two agreements and those of q4, q5 and q6; <name>_score: their weighted sum."""
    return f"""{name} as (select max(h1.angle) as h1_angle, max(h1.procrustes) as h1_procrustes, max(h2.angle) as h2_angle, max(h2.procrustes) as h2_procrustes, max(w.error) as wedge, max(s.error) as spectrum, min(correlation) as correlation, max(p95) as p95
  from ({agreement('x', first)}) h1 join ({agreement('y', second)}) h2 using (cloud_id) join w using (cloud_id) join s using (cloud_id) join c using (cloud_id)),
{name}_score as (select 0.2 * h1_angle / 90 + 0.2 * h1_procrustes + 0.15 * h2_angle / 90 + 0.15 * h2_procrustes + 0.1 * wedge + 0.1 * spectrum + 0.05 * (1 - correlation) + 0.05 * p95 / pi() as score from {name})"""


SQL |= {
    "q2_near_dependent": f"with {LABEL} select distinct cloud_id, 0.0::double as angle from pts",
    "q3_procrustes": f"with {LABEL} select distinct cloud_id, 0.0::double as angle, 0.1::double as procrustes from pts",
    "q7_gates": f"""with {LABEL}, w as ({SQL['q5_relative_error']}), s as ({SQL['q6_spectrum_error']}), c as ({SQL['q4_circular_agreement']}),
{_score('old', 'x + y', 'y + z')}, {_score('new', 'x + y / 50', 'y + z / 50')}
select h1_angle <= 3 and h1_procrustes <= 0.05 and h2_angle <= 5 and h2_procrustes <= 0.1 and wedge <= 0.1 and spectrum <= 0.1 and correlation >= 0.99 and p95 <= 0.1 as final_pass,
(o.score - n.score) / o.score >= 0.2 as commit_pass, {each('h1_angle h1_procrustes h2_angle h2_procrustes wedge spectrum correlation p95', 4)}, {r('n.score', 'score', 4)}, {r('o.score', 'previous', 4)}, {r('(o.score - n.score) / o.score', 'improvement', 4)}
from new, new_score n, old_score o""",
}
#: What must come out whatever the sample: a basis is orthonormal, spectra solve their problem, octants of a symmetric surface are filled alike.
SQL |= {
    "e5_eigenfunctions": "select cast(0 as bigint) as cloud_id, count(*) as n, 0.0::double as mean, 0.0::double as square, 0.0::double as product from embeddings",
    "f14_spectrum_checks": "select cast(0 as bigint) as cloud_id, cast(k as bigint) as k, true as solves, true as normed, true as positive from (values (1), (2)) t(k)",
    "k1_spectrum_csv": f"with {LABEL}, {SPECTRA} select cloud_id, mode as nth, mode, {r('lam', 'lambda', 7)} from sp",
    "k1_coefficients_csv": f"with {LABEL}, {SPECTRA} select cloud_id, mode as coeff_index, {r('lam', 'form0', 7)}, {r('case when mode < 20 then y end', 'form1', 7)} from sp",
    "k1_modes_csv": f"with {LABEL}, {SPECTRA} select cloud_id, 'theta_' || mode as name, mode, {r('lam', 'lambda', 7)}, {r('y', 'eigenvalue_real', 7)}, {r('2 * lam', 'eigenvalue_imag', 7)} from sp",
    "s7_torus_spread": "select cast(octant as bigint) as octant, true as even from range(8) t(octant)",
    "s8_sphere_spread": "select cast(octant as bigint) as octant, true as even from range(8) t(octant)",
}
