"""Queries over the given tables, one for each operator or group of operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.tables import drop_stored, pin, scratch, shared_folder, short_methods, table
from ..operators import compare, diffusion, fields, forms, hodge, knn, markov, mesh, products, spectral
from ..sources.samples import torus_at
from . import files, views
from .sql import SQL

K, STEPS, BASIS = 32, 20, 12


def shown(df: DataFrame, *keys: str, digits: int = 5, **columns) -> DataFrame:
    """Keys as they are, other columns rounded."""
    named = {c: F.col(c) for c in df.columns if c not in keys} if not columns else columns
    return df.select(*keys, *[(F.round(v, digits) + 0.0).alias(k) for k, v in named.items()])


def graph(spark: SparkSession, sf_dir: str) -> markov.Graph:
    return graph_of(views.pts_embed(spark, sf_dir), K)


def graph_of(points: DataFrame, k: int) -> markov.Graph:
    """The graph of some points; what finding the neighbours left is removed."""
    with scratch(points.sparkSession) as kept:
        g = markov.build(points, knn.knn(points, k))
        kept += [g.knn, g.markov, g.params, g.times]
    return g


def p1_normalize(spark, sf_dir):
    return shown(fields.normalize(views.pts_label(spark, sf_dir)), "cloud_id", "point_id")


def p3_field_bounds(spark, sf_dir):
    return shown(fields.field_bounds(views.field_embed(spark, sf_dir)), "cloud_id")


def p4_coloured(spark, sf_dir):
    rows = fields.coloured(views.pts_label(spark, sf_dir), views.field_sparse(spark, sf_dir))
    return rows.select("cloud_id", "point_id", (F.round("t", 5) + 0.0).alias("t"), *[F.col(c).cast("long").alias(c) for c in ("red", "green", "blue")])


def p6_impulse(spark, sf_dir):
    return fields.impulse(views.pts_label(spark, sf_dir))


def p7_glyphs(spark, sf_dir):
    points = views.pts_label(spark, sf_dir)
    faces = fields.glyph_faces(points).groupBy("mesh_id").agg(F.sum(F.col("v0") + 2 * F.col("v1") + 3 * F.col("v2")).alias("face_sum"))
    corners = fields.glyph_vertices(points).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])
    return shown(corners.join(faces, F.col("mesh_id") == F.col("cloud_id")).drop("mesh_id"), "cloud_id", "n", "face_sum")


def p8_vectors(spark, sf_dir):
    points = views.pts_embed(spark, sf_dir)
    a, b = vec.vec(), (F.col("y"), F.col("z"), F.col("x"))
    w, u = vec.wedge(a, b), vec.unit(a)
    return shown(points, "point_id", dot=vec.dot(a, b), xy=w[0], yz=w[1], zx=w[2], norm=vec.norm(a), ux=u[0], uy=u[1], uz=u[2])


def p9_geometric_product(spark, sf_dir):
    short_methods(spark)
    rows = views.multivectors(spark, sf_dir)
    p, w = vec.geometric_product(F.col("a"), F.col("b"), (3, 0, 0)), vec.geometric_product(F.col("a"), F.col("b"), (3, 0, 0), outer=True)
    rows = rows.select("l_orderkey", "l_linenumber", p.alias("p"), w.alias("w"))
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(F.get(c, F.lit(i)), 8) + 0.0).alias(f"{c}{i}") for c in ("p", "w") for i in range(8)])


def p11_multivector_sum(spark, sf_dir):
    """a + b, a - b and a less its scalar part."""
    rows, a, b = views.multivectors(spark, sf_dir), F.col("a"), F.col("b")
    made = {"s": vec.multivector_sum(a, b), "d": vec.multivector_sum(a, b, -1.0), "t": vec.multivector_sum(a, vec.from_blade(0, F.get(a, F.lit(0))), -1.0)}
    rows = rows.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in made.items()])
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(F.get(c, F.lit(i)), 8) + 0.0).alias(f"{c}{i}") for c in made for i in range(8)])


def p12_long_vectors(spark, sf_dir):
    """Vectors from each point to the one of the next id, without those of equal places."""
    points = views.pts_embed(spark, sf_dir)
    ahead = points.select((F.col("point_id") - 1).alias("point_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    rows = points.join(ahead, "point_id").select("point_id", *[(F.col(f"n{c}") - F.col(c)).alias(c) for c in "xyz"])
    return shown(rows.filter(vec.longer_than(vec.vec())), "point_id", x=F.col("x"), y=F.col("y"), z=F.col("z"), length=vec.norm(vec.vec()))


def p14_strided(spark, sf_dir):
    return fields.strided(views.pts_embed(spark, sf_dir), 100).select("point_id")


def p15_validity(spark, sf_dir):
    points, faces = views.mesh_part(spark, sf_dir)
    clouds = points.select("cloud_id").distinct().union(spark.range(1, 2).toDF("cloud_id"))
    return fields.validity(clouds, points, faces)


def faces_of_vertices(points: DataFrame, faces: DataFrame) -> DataFrame:
    rows = mesh.incidence(points, faces)
    return rows.groupBy("vertex_id").agg(F.array_join(F.sort_array(F.collect_list("face_id")), ",").alias("faces"))


def m1_incidence(spark, sf_dir):
    return faces_of_vertices(*views.mesh_orders(spark, sf_dir))


def m2_one_ring(spark, sf_dir):
    return mesh.one_ring(*views.mesh_orders(spark, sf_dir)).select("src", "dst")


def m3_csr_offsets(spark, sf_dir):
    points, faces = views.mesh_orders(spark, sf_dir)
    return mesh.csr_offsets(mesh.corners(faces), points, "vertex_id").select("vertex_id", "degree", "first")


def m4_face_normals(spark, sf_dir):
    return shown(mesh.face_normals(*views.mesh_orders(spark, sf_dir)).drop("mesh_id"), "face_id", digits=8)


def m5_curvature(spark, sf_dir):
    return shown(mesh.curvature(*views.mesh_orders(spark, sf_dir)).drop("mesh_id"), "point_id", digits=4)


def m7_flow_step(spark, sf_dir):
    points, faces = views.mesh_orders(spark, sf_dir)
    return shown(mesh.flow_step(points, mesh.one_ring(points, faces)).drop("cloud_id"), "point_id", digits=8)


def m8_flow(spark, sf_dir):
    return shown(mesh.flow(*views.mesh_part(spark, sf_dir), frames=6).drop("cloud_id"), "point_id")


def n1_knn(spark, sf_dir):
    return shown(knn.knn(views.pts_embed(spark, sf_dir), K).select("src", F.col("rank").cast("long").alias("rank"), "dst", "dist"), "src", "rank", "dst")


def n1_knn_clouds(spark, sf_dir):
    return shown(knn.knn(views.pts_label(spark, sf_dir), 8).select("cloud_id", "src", F.col("rank").cast("long").alias("rank"), "dst", "dist"), "cloud_id", "src", "rank", "dst")


def n2_local_bandwidth(spark, sf_dir):
    return shown(markov.local_bandwidth(knn.knn(views.pts_embed(spark, sf_dir), K)).drop("cloud_id"), "point_id")


def n4_kernel_tuning(spark, sf_dir):
    return shown(graph(spark, sf_dir).params.drop("cloud_id"))


def n9_markov(spark, sf_dir):
    return shown(graph(spark, sf_dir).markov.select("src", "dst", "w"), "src", "dst")


def n10_symmetric(spark, sf_dir):
    return shown(graph(spark, sf_dir).symk.select("src", "dst", "s"), "src", "dst")


def n14_nodes(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    return shown(nodes, "point_id", mu=F.col("mu") * 1000, row_sum=F.col("row_sum"), bw=F.col("bw"), ix=F.col("ix"), iy=F.col("iy"), iz=F.col("iz"))


def d1_markov_step(spark, sf_dir):
    points = views.pts_embed(spark, sf_dir)
    return shown(diffusion.step(graph(spark, sf_dir).markov, fields.height(points)).drop("cloud_id"), "point_id")


def d3_heat_run(spark, sf_dir):
    points = views.pts_embed(spark, sf_dir)
    rows = diffusion.run(graph(spark, sf_dir).markov, fields.impulse(points), STEPS, places=points)
    return shown(rows.select(F.col("step").cast("long").alias("step"), "point_id", "value"), "step", "point_id", digits=4)


def d2_steps(spark, sf_dir):
    """Seven steps of the heights: no multiple of the steps between snapshots."""
    points = views.pts_embed(spark, sf_dir)
    return shown(diffusion.steps(graph(spark, sf_dir).markov, fields.height(points), 7, points).drop("cloud_id"), "point_id")


def run_folder(spark: SparkSession) -> str:
    """A new folder for the snapshots of a run."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def d3_heat_program(spark, sf_dir):
    """100 steps from the impulse; every fifth is written as a partition and the run broken off once and resumed."""
    points, folder = views.pts_embed(spark, sf_dir), run_folder(spark)
    markov, begin = graph(spark, sf_dir).markov, pin(fields.impulse(points))
    diffusion.run_to(folder, markov, begin, 100, places=points, stop_after=40)
    rows = diffusion.run_to(folder, markov, begin, 100, places=points)
    return shown(rows.select(F.col("step").cast("long").alias("step"), "point_id", "value"), "step", "point_id", digits=4)


def m8_flow_frames(spark, sf_dir):
    """Curvature, export and flow of six frames of the normalised surface, broken off once and resumed."""
    points, faces = views.mesh_part(spark, sf_dir)
    points, folder = pin(fields.normalize(points)), run_folder(spark)
    mesh.flow_to(folder, points, faces, 6, stop_after=2)
    rows = mesh.flow_to(folder, points, faces, 6)
    return rows.select(F.col("step").cast("long").alias("frame"), "point_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("x", 6), ("y", 6), ("z", 6), ("h", 5), ("k", 3))])


def d4_carre_du_champ(spark, sf_dir):
    g = graph(spark, sf_dir)
    coords = g.nodes.select("cloud_id", "point_id", F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("iz").alias("z"))
    return shown(diffusion.carre_du_champ(g.markov, g.nodes, coords, [("x", "x"), ("x", "y"), ("z", "z")]).drop("cloud_id"), "point_id")


def data_immersion(spark, sf_dir, g):
    both = views.pts_embed(spark, sf_dir).join(g.nodes.select("cloud_id", "point_id", "ix", "iy", "iz"), ["cloud_id", "point_id"])
    return diffusion.carre_du_champ(g.markov, g.nodes, both, [(a, f"i{b}") for a in "xyz" for b in "xyz"])


def d8_data_immersion(spark, sf_dir):
    return shown(data_immersion(spark, sf_dir, graph(spark, sf_dir)).drop("cloud_id"), "point_id")


def monomials(spark, sf_dir):
    return views.pts_embed(spark, sf_dir).select("cloud_id", "point_id", F.array(F.lit(1.0), "x", "y", "z").alias("phi"))


def matrices(spark, sf_dir, g):
    return forms.form_matrices(forms.gamma_rows(g.markov, g.nodes, monomials(spark, sf_dir)), 4)


def f_form_matrices(spark, sf_dir):
    rows = matrices(spark, sf_dir, graph(spark, sf_dir))
    rows = rows.filter(F.col("name").isin("g0", "g1", "g2", "d0", "e0", "e1")).select("name", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    return shown(rows, "name", "row", "col")


def d6_matrices(spark, sf_dir):
    """The other Gram, derivative and energy matrices: volume forms, 2-forms and the derivatives into them."""
    rows = matrices(spark, sf_dir, graph(spark, sf_dir)).filter(F.col("name").isin("g3", "d1", "d2", "e2"))
    return shown(rows.select("name", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), "name", "row", "col", digits=4)


def eigenbasis(spark, sf_dir, g):
    return spectral.eigenbasis(g.symk, g.nodes, BASIS)


def e2_eigenbasis(spark, sf_dir):
    """For each basis function: how far its mean square is from 1, its product with the first from 0, and it from an eigenvector."""
    g = graph(spark, sf_dir)
    basis, values = eigenbasis(spark, sf_dir, g)
    long = pin(basis.select("cloud_id", "point_id", F.posexplode("phi").alias("mode", "u"), F.get("phi", F.lit(0)).alias("u0")))
    ends = long.select("cloud_id", F.col("point_id").alias("dst"), "mode", "u")
    moved = g.symk.join(ends, ["cloud_id", "dst"]).groupBy("cloud_id", F.col("src").alias("point_id"), "mode").agg(F.sum(F.col("s") * F.col("u")).alias("su"))
    rows = long.join(moved, ["cloud_id", "point_id", "mode"]).join(g.nodes.select("cloud_id", "point_id", "mu", "row_sum"), ["cloud_id", "point_id"]).join(values, ["cloud_id", "mode"])
    away = F.col("su") / F.col("row_sum") - F.col("lambda") * F.col("u")
    rows = rows.groupBy(F.col("mode").cast("long").alias("mode")).agg(
        F.abs(F.sum(F.col("mu") * F.col("u") ** 2) - 1).alias("norm_error"), F.abs(F.sum(F.when(F.col("mode") > 0, F.col("mu") * F.col("u") * F.col("u0")).otherwise(0.0))).alias("with_first"),
        F.max(F.when(F.col("mode") == 0, F.abs(F.col("u") - 1)).otherwise(0.0)).alias("first_less_1"), F.sqrt(F.sum(F.col("mu") * away**2)).alias("residual"),
    )
    return shown(rows, "mode", digits=4)


def e3_eigenvalues(spark, sf_dir):
    values = eigenbasis(spark, sf_dir, graph(spark, sf_dir))[1]
    return shown(values.select(F.col("mode").cast("long").alias("mode"), "lambda"), "mode")


def e5_eigenfunctions(spark, sf_dir):
    """Two eigenfunctions as fields: their number of points, and how far mean, mean square and product are from those in the measure mu."""
    g = graph(spark, sf_dir)
    basis = pin(eigenbasis(spark, sf_dir, g)[0])
    one, two = (spectral.eigenfunction(basis, i).withColumnRenamed("value", f"f{i}") for i in (1, 2))
    rows = one.join(two, ["cloud_id", "point_id"]).join(g.nodes.select("cloud_id", "point_id", "mu"), ["cloud_id", "point_id"])
    off = {"mean": F.sum(F.col("mu") * F.col("f1")), "square": F.sum(F.col("mu") * F.col("f2") ** 2) - 1, "product": F.sum(F.col("mu") * F.col("f1") * F.col("f2"))}
    return shown(rows.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), *[F.abs(v).alias(k) for k, v in off.items()]), "cloud_id", "n", digits=4)


def f14_spectrum_checks(spark, sf_dir):
    """For the 1-forms and 2-forms of the plain basis: pairs solve their problem, have norm 1 and are not negative."""
    found, out = pin(matrices(spark, sf_dir, graph(spark, sf_dir))), None
    for k in (1, 2):
        laplacian, mass = laplacian_of(found, k), found.filter(F.col("name") == f"g{k}")
        rows = hodge.residuals(laplacian, mass, hodge.spectrum(laplacian, mass))
        one = rows.groupBy("cloud_id").agg((F.max("residual") < 1e-6).alias("solves"), (F.max("norm_error") < 1e-8).alias("normed"), (F.min("lambda") > -1e-6).alias("positive"))
        one = one.select("cloud_id", F.lit(k).cast("long").alias("k"), "solves", "normed", "positive")
        out = one if out is None else out.union(one)
    return out


def harmonic_coordinates(spark, sf_dir):
    """From points to angles: eigenbasis, forms, spectrum, harmonic 1-form, its field in space and circular coordinate."""
    g = graph(spark, sf_dir)
    basis = pin(eigenbasis(spark, sf_dir, g)[0])
    gammas = pin(forms.gamma_rows(g.markov, g.nodes, basis))
    found = pin(forms.form_matrices(gammas, BASIS))
    laplacian = hodge.added(hodge.down_laplacian(found, 1), found.filter("name = 'e1'"), "hodge1")
    modes = hodge.harmonic_modes(hodge.spectrum(laplacian, found.filter("name = 'g1'")))
    first = pin(modes.groupBy("cloud_id").agg(F.min_by("coefficients", "mode").alias("coefficients")))
    angles = products.circular_coordinates(basis, products.circular_mode(gammas, products.padded(first, BASIS), 1.0))
    field = hodge.facing_outward(hodge.ambient_vectors(hodge.pointwise(basis, first, 3), data_immersion(spark, sf_dir, g)), views.pts_embed(spark, sf_dir))
    return field.join(angles, ["cloud_id", "point_id"]).select("point_id", "vx", "vy", "vz", F.col("value").alias("angle"))


def f13_hodge_laplacian(spark, sf_dir):
    rows = hodge.hodge_laplacian(pin(matrices(spark, sf_dir, graph(spark, sf_dir))))
    return shown(rows.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), "row", "col")


def f14_hodge_spectrum(spark, sf_dir):
    found = pin(matrices(spark, sf_dir, graph(spark, sf_dir)))
    laplacian = hodge.added(hodge.down_laplacian(found, 1), found.filter("name = 'e1'"), "hodge1")
    return shown(hodge.spectrum(laplacian, found.filter("name = 'g1'")).select("cloud_id", "mode", "lambda"), "cloud_id", "mode")


def one_form(spark, sf_dir, g):
    """The column of the weak derivative that belongs to the second basis function, as a 1-form."""
    return hodge.pointwise(monomials(spark, sf_dir), hodge.coefficients_of(matrices(spark, sf_dir, g), "d0", 1), 3)


def f18_dual_vectors(spark, sf_dir):
    return shown(hodge.dual_vectors(one_form(spark, sf_dir, graph(spark, sf_dir))).drop("cloud_id"), "point_id")


def f24_ambient_field(spark, sf_dir):
    g = graph(spark, sf_dir)
    return shown(hodge.ambient_vectors(one_form(spark, sf_dir, g), data_immersion(spark, sf_dir, g)).drop("cloud_id"), "point_id")


def sheared_agreement(points: DataFrame, other: DataFrame) -> DataFrame:
    return shown(compare.point_agreement(points, other.withColumn("x", F.col("x") + F.col("y") / 10)), "cloud_id", "n", "unmatched")


def q1_point_agreement(spark, sf_dir):
    points = views.pts_label(spark, sf_dir)
    return sheared_agreement(points, points)


def q4_circular_agreement(spark, sf_dir):
    angle = views.pts_label(spark, sf_dir).select("cloud_id", "point_id", F.atan2("y", "x").alias("value"))
    turned = angle.withColumn("value", 0.7 - F.col("value") + 0.01 * F.sin(3 * F.col("value")))
    return compare.circular_agreement(angle, turned).select("cloud_id", "conjugate", *[(F.round(c, 5) + 0.0).alias(c) for c in ("correlation", "mean", "p95", "most")])


def q5_relative_error(spark, sf_dir):
    points = views.pts_label(spark, sf_dir)
    a, b = (points.select("cloud_id", "point_id", v.alias("value")) for v in (F.col("x"), -F.col("x") + F.col("y") / 20))
    return shown(compare.relative_error(a, b), "cloud_id")


def e4_condition(spark, sf_dir):
    return shown(spectral.condition(matrices(spark, sf_dir, graph(spark, sf_dir))), "cloud_id", digits=2)


def f11_up_laplacian(spark, sf_dir):
    return shown(matrices(spark, sf_dir, graph(spark, sf_dir)).filter("name = 'e2'").select("row", "col", "value"), "row", "col", digits=4)


def f17_projection(spark, sf_dir):
    """Coefficients of the product of the points' first two coordinates, which no combination of the basis equals."""
    form = views.pts_embed(spark, sf_dir).select("cloud_id", "point_id", F.array(F.col("x") * F.col("y")).alias("form"))
    found = products.project(form, monomials(spark, sf_dir), graph(spark, sf_dir).nodes)
    return shown(found.select(F.posexplode("coefficients").alias("i", "c")).select(F.col("i").cast("long").alias("i"), "c"), "i")


def f12_down_laplacian(spark, sf_dir):
    """The codifferential of 1-forms and their down-Laplacian on a basis that is not orthonormal."""
    found = pin(matrices(spark, sf_dir, graph(spark, sf_dir)))
    rows = hodge.codifferential(found, 1).union(hodge.down_laplacian(found, 1))
    return shown(rows.select("name", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), "name", "row", "col", digits=4)


def synthetic_spectra(spark, sf_dir):
    """A spectrum for each label: points in order of their ids as modes, and a second one near it."""
    rows = files.spectra(spark, sf_dir)
    return rows.drop("y"), rows.select("cloud_id", "mode", (F.col("lambda") + F.col("y") / 1000).alias("lambda"))


def f15_harmonic_modes(spark, sf_dir):
    rows = hodge.harmonic_modes(synthetic_spectra(spark, sf_dir)[0])
    return shown(rows.select("cloud_id", F.col("mode").cast("long").alias("mode"), "lambda"), "cloud_id", "mode")


def q6_spectrum_error(spark, sf_dir):
    return shown(compare.spectrum_error(*synthetic_spectra(spark, sf_dir)), "cloud_id")


def f22_padded(spark, sf_dir):
    """The coefficients of one derivative, as those of six modes."""
    found = products.padded(hodge.coefficients_of(matrices(spark, sf_dir, graph(spark, sf_dir)), "d0", 1), 6)
    return shown(found.select(F.posexplode("coefficients").alias("i", "c")).select(F.col("i").cast("long").alias("i"), "c"), "i")


def f25_ambient_dual(spark, sf_dir):
    g = graph(spark, sf_dir)
    form = hodge.pointwise(monomials(spark, sf_dir), hodge.coefficients_of(matrices(spark, sf_dir, g), "d1", 4), 3)
    return shown(hodge.ambient_duals(form, data_immersion(spark, sf_dir, g)).drop("cloud_id"), "point_id")


def f26_facing_outward(spark, sf_dir):
    """The field of the form whose coefficients are those of f24 with the other sign, turned to face outward."""
    g, points = graph(spark, sf_dir), views.pts_embed(spark, sf_dir)
    one = hodge.ambient_vectors(one_form(spark, sf_dir, g), data_immersion(spark, sf_dir, g))
    turned = one.select("cloud_id", "point_id", *[(-F.col(f"v{c}")).alias(f"v{c}") for c in "xyz"])
    out = hodge.facing_outward(one, points).join(hodge.facing_outward(turned, points).toDF("cloud_id", "point_id", "tx", "ty", "tz"), ["cloud_id", "point_id"])
    return shown(out.drop("cloud_id"), "point_id")


def f20_wedge(spark, sf_dir):
    """Two derivatives' wedge product and the sum of it and the turned one, which is 0."""
    g, basis = graph(spark, sf_dir), monomials(spark, sf_dir)
    found = pin(matrices(spark, sf_dir, g))
    a, b = (hodge.coefficients_of(found, "d0", i) for i in (1, 2))
    one, two = (products.wedge(x, 1, y, 1, basis, g.nodes).select("cloud_id", F.posexplode("coefficients").alias("i", c)) for x, y, c in ((a, b, "value"), (b, a, "turned")))
    rows = one.join(two, ["cloud_id", "i"]).withColumn("both", F.col("value") + F.col("turned")).drop("turned")
    return shown(rows.withColumn("i", F.col("i").cast("long")), "cloud_id", "i")


def f21_wedge_operator(spark, sf_dir):
    g = graph(spark, sf_dir)
    alpha = hodge.coefficients_of(matrices(spark, sf_dir, g), "d0", 1)
    rows = products.wedge_operator(alpha, 1, 1, monomials(spark, sf_dir), g.nodes)
    return shown(rows.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), "row", "col", digits=4)


def f23_circular_coordinates(spark, sf_dir):
    g = graph(spark, sf_dir)
    gammas = pin(forms.gamma_rows(g.markov, g.nodes, monomials(spark, sf_dir)))
    turning = g.nodes.select("cloud_id").distinct().select("cloud_id", F.array(*[F.lit(v) for v in (0.0,) * 4 + (4.0, 0.0, -4.0) + (0.0,) * 5]).alias("coefficients"))
    modes = products.circular_mode(gammas, turning, 0.1)
    return shown(products.circular_coordinates(gammas.select("cloud_id", "point_id", "phi"), modes), "cloud_id", "point_id")


def subspaces(spark, sf_dir):
    points = views.pts_label(spark, sf_dir)
    return compare.subspace_agreement(*[points.select("cloud_id", "point_id", F.array(v).alias("form")) for v in (F.col("x"), F.col("x") + F.col("y") / 2)])


def q2_subspaces(spark, sf_dir):
    return shown(subspaces(spark, sf_dir), "cloud_id")


def q7_composite_score(spark, sf_dir):
    return shown(compare.composite_score(subspaces(spark, sf_dir).join(q4_circular_agreement(spark, sf_dir), "cloud_id"), compare.ONE_FORM_SHARES), digits=4)


def q2_near_dependent(spark, sf_dir):
    """Three columns of which the last is the first but for a 10**-8 part, against three plain ones: the same space."""
    points = views.pts_label(spark, sf_dir)
    sets = [points.select("cloud_id", "point_id", F.array(*c).alias("form")) for c in (("x", "y", "z"), (F.col("x"), F.col("y"), F.col("x") + F.lit(1e-8) * F.col("z")))]
    return compare.subspace_agreement(*sets).select("cloud_id", (F.round("angle", 3) + 0.0).alias("angle"))


def q3_procrustes(spark, sf_dir):
    """Three columns turned round and stretched by a tenth: no angle, and a tenth is left after the best rotation."""
    points = views.pts_label(spark, sf_dir)
    sets = [points.select("cloud_id", "point_id", F.array(*c).alias("form")) for c in (("x", "y", "z"), (1.1 * F.col("y"), -1.1 * F.col("x"), 1.1 * F.col("z")))]
    return shown(compare.subspace_agreement(*sets), "cloud_id")


def q7_gates(spark, sf_dir):
    """Full score, worst metrics, final and commit gate of one set of results against another, with a row for each label."""
    points = views.pts_label(spark, sf_dir)
    x, y, z = (F.col(c) for c in "xyz")

    def metrics(first, second) -> DataFrame:
        out = None
        for name, (a, b) in (("h1", (x, first)), ("h2", (y, second))):
            one = compare.subspace_agreement(*[points.select("cloud_id", "point_id", F.array(c).alias("form")) for c in (a, b)])
            one = one.toDF("cloud_id", f"{name}_angle", f"{name}_procrustes")
            out = one if out is None else out.join(one, "cloud_id")
        errors = q5_relative_error(spark, sf_dir).withColumnRenamed("error", "wedge").join(q6_spectrum_error(spark, sf_dir).withColumnRenamed("error", "spectrum"), "cloud_id")
        return pin(out.join(errors, "cloud_id").join(q4_circular_agreement(spark, sf_dir).select("cloud_id", "correlation", "p95"), "cloud_id"))

    found = compare.gates(metrics(x + y, y + z), metrics(x + y / 50, y + z / 50))
    return shown(found, "final_pass", "commit_pass", digits=4)


TORUS_BASIS, TORUS_K, TORUS_RADIUS = 50, 24, 0.8


def torus_program(spark, sf_dir):
    """A torus with a point for each part, its graph, eigenbasis, form matrices and laid out covariances."""
    ids = table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("cloud_id"), F.col("p_partkey").alias("point_id"))
    points = pin(torus_at(ids, small=TORUS_RADIUS))
    g = graph_of(points, TORUS_K)
    drop_stored(g.knn)  # neither this nor symk is read any more once the basis is there
    g.nodes  # noqa: B018
    with scratch(spark):
        basis = pin(spectral.eigenbasis(g.symk, g.nodes, TORUS_BASIS, rounds=4)[0])  # residuals below 1e-4 will do here
    drop_stored(g.symk)
    made = forms.assembly(g.markov, g.nodes, basis)
    return points, g, basis, made, pin(made.matrices(TORUS_BASIS))


def laplacian_of(found: DataFrame, k: int) -> DataFrame:
    return hodge.added(hodge.down_laplacian(found, k), found.filter(F.col("name") == f"e{k}"), f"hodge{k}")


def torus_circles(spark, sf_dir):
    """Circular coordinates of the two harmonic 1-forms of a torus against its known angles: which form follows which angle, and whether well."""
    points, g, basis, made, found = torus_program(spark, sf_dir)
    modes = pin(hodge.spectrum(laplacian_of(found, 1), found.filter("name = 'g1'")))
    cycles = pin(products.cycles_of(made, modes.filter("mode < 2").select("cloud_id", "mode", "coefficients")))
    angles = None
    for form in (0, 1):
        one = products.circular_coordinates(basis, cycles.filter(F.col("form") == form)).withColumn("form", F.lit(form))
        angles = one if angles is None else angles.union(one)
    angles = pin(angles)
    known = {"u": F.atan2("y", "x"), "v": F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 2.0)}
    out = None
    for form in (0, 1):
        for name, angle in known.items():
            reference = points.select("cloud_id", "point_id", angle.alias("value"))
            one = compare.circular_agreement(reference, angles.filter(F.col("form") == form).select("cloud_id", "point_id", "value"))
            one = one.select(F.lit(form).cast("long").alias("form"), F.lit(name).alias("angle"), (F.col("correlation") >= 0.95).alias("follows"), (F.col("correlation") <= 0.2).alias("apart"))
            out = one if out is None else out.union(one)
    return out


def torus_two_forms(spark, sf_dir):
    """The 2-form chain on a torus: spectrum, harmonic 2-form, wedge of the two harmonic 1-forms, dual field.

    Each row is a check: how far a value is from what it must be, and whether within the bound.
    """
    points, g, basis, made, found = torus_program(spark, sf_dir)
    checks = None
    one_forms = two_forms = None
    for k in (1, 2):
        laplacian, mass = laplacian_of(found, k), found.filter(F.col("name") == f"g{k}")
        modes = pin(hodge.spectrum(laplacian, mass))
        one_forms, two_forms = (modes, two_forms) if k == 1 else (one_forms, modes)
        rows = hodge.residuals(laplacian, mass, modes).agg(F.max("residual").alias("residual"), F.max("norm_error").alias("norm_error"), F.min("lambda").alias("lambda"))
        for what, holds in (("residual", F.col("residual") < 1e-6), ("norm", F.col("norm_error") < 1e-8), ("positive", F.col("lambda") > -1e-8)):
            row = rows.select(F.lit(f"{what} of {k}-forms").alias("check"), holds.alias("holds"))
            checks = row if checks is None else checks.union(row)
    first, second = (pin(one_forms.filter(F.col("mode") == i).select("cloud_id", "coefficients")) for i in (0, 1))
    ab, ba = (pin(products.wedge(x, 1, y, 1, basis, g.nodes)) for x, y in ((first, second), (second, first)))
    pairs = ab.join(ba.withColumnRenamed("coefficients", "turned"), "cloud_id")
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    sums = pairs.select(size(F.zip_with("coefficients", "turned", lambda a, b: a + b)).alias("sum"), size(F.col("coefficients")).alias("own"))
    own = products.wedge(first, 1, first, 1, basis, g.nodes).select(size(F.col("coefficients")).alias("own"))
    harmonic = two_forms.filter("mode = 0").select("cloud_id", "coefficients")
    mass = found.filter("name = 'g2'")
    products_ = [hodge.inner(mass, p, q).withColumnRenamed("value", n) for p, q, n in ((ab, harmonic, "both"), (ab, ab, "aa"), (harmonic, harmonic, "hh"))]
    alike = products_[0].join(products_[1], "cloud_id").join(products_[2], "cloud_id").select((F.abs("both") / F.sqrt(F.col("aa") * F.col("hh"))).alias("alike"))
    # Out of the surface: away from the circle in the middle of the tube.
    ring = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    normal = [F.col("x") * (1 - 2 / ring), F.col("y") * (1 - 2 / ring), F.col("z")]
    immersed = g.nodes.select("cloud_id", "point_id", "mu", *[F.col(f"i{a}").alias(a) for a in "xyz"])
    field = hodge.dual_vectors(hodge.pointwise(basis, ab, 3)).join(immersed, ["cloud_id", "point_id"])
    dot = lambda p, q: F.sum(F.col("mu") * sum((a * b for a, b in zip(p, q, strict=True)), F.lit(0.0)))
    v = [F.col(f"v{c}") for c in "xyz"]
    outward = field.agg((F.abs(dot(v, normal)) / F.sqrt(dot(v, v) * dot(normal, normal))).alias("outward"))
    return (
        checks.union(sums.select(F.lit("wedge turns sign"), (F.col("sum") < 1e-9 * F.col("own")) & (F.col("own") > 1e-3)))
        .union(own.select(F.lit("wedge with itself is 0"), F.col("own") < 1e-9))
        .union(outward.select(F.lit("wedge of harmonic forms has the normal as dual"), F.col("outward") > 0.85))
        .union(alike.select(F.lit("wedge of harmonic forms is the harmonic 2-form"), F.col("alike") > 0.7))
    )


QUERIES = (
    p1_normalize, p3_field_bounds, p4_coloured, p6_impulse, p7_glyphs, p8_vectors, p9_geometric_product, p14_strided, p15_validity,
    m1_incidence, m2_one_ring, m3_csr_offsets, m4_face_normals, m5_curvature, m7_flow_step, m8_flow, n1_knn, n1_knn_clouds, n2_local_bandwidth,
    n4_kernel_tuning, n9_markov, n10_symmetric, n14_nodes, d1_markov_step, d3_heat_run, d4_carre_du_champ, d8_data_immersion, f_form_matrices,
    f13_hodge_laplacian, f14_hodge_spectrum, f18_dual_vectors, f24_ambient_field,
    e4_condition, f11_up_laplacian, f17_projection, f20_wedge, f21_wedge_operator, f23_circular_coordinates, q2_subspaces, q7_composite_score,
    q1_point_agreement, q4_circular_agreement, q5_relative_error,
    p11_multivector_sum, p12_long_vectors, d2_steps, d6_matrices, e2_eigenbasis, e3_eigenvalues, harmonic_coordinates,
    f12_down_laplacian, f15_harmonic_modes, q6_spectrum_error, f22_padded, f25_ambient_dual, f26_facing_outward,
    d3_heat_program, m8_flow_frames, torus_circles, torus_two_forms, q2_near_dependent, q3_procrustes, q7_gates, e5_eigenfunctions, f14_spectrum_checks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *files.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
