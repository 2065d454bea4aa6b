import glob

from geoflow.sources import sinks, text


def lines(path: str) -> list[str]:
    return [line.rstrip("\n") for f in sorted(glob.glob(f"{path}/cloud_id=0/part-*")) for line in open(f)]


def test_spectrum_coefficients_and_modes(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    sinks.write_spectrum_csv(spark.createDataFrame([(0, 1, 0.5), (0, 0, 0.25)], "cloud_id long, mode int, lambda double"), a)
    assert lines(a) == ["mode,lambda", "0,0.25", "1,0.5"]
    forms = [spark.createDataFrame([(0, v)], "cloud_id long, coefficients array<double>") for v in ([1.0, 2.0], [3.0])]
    sinks.write_coefficients_csv(forms, b)
    assert lines(b) == ["coeff_index,form0,form1", "0,1.0,3.0", "1,2.0,nan"]
    sinks.write_modes_csv(spark.createDataFrame([(0, "theta_0", 0, 1.5, 0.5, 2.0)], "cloud_id long, name string, mode int, lambda double, re double, im double"), c)
    assert lines(c) == ["name,mode,lambda,eigenvalue_real,eigenvalue_imag", "theta_0,0,1.5,0.5,2.0"]


def test_lines_of_many_splits_are_numbered_without_shuffling_them(spark, tmp_path):
    kinds = ["v {0} 1 2", "vn 0 0 1", " v\t{0} none 2 ", "v", "", "f 1/7 2//3 3 ", "f 1 2 3\t", "f 0 1 2", "f 1 2 3 4", "fx 1 2 3", "f", "f 3 2 1"]
    want = {"a": ([], [], []), "b": ([], [], [])}
    for n in range(3000):
        line, (points, faces, bad) = kinds[n % 12].format(n), want["ab"[n // 1000 == 1]]
        (tmp_path / "ab"[n // 1000 == 1]).mkdir(exist_ok=True)
        with open(tmp_path / "ab"[n // 1000 == 1] / f"part-{n // 500:05}", "a") as f:
            f.write(line + "\n")
        if n % 12 in (0, 2, 3):
            points.append((0.0 if n % 12 == 3 else float(n), float(n % 12 == 0), 2.0 * (n % 12 == 0)))
        elif n % 12 in (5, 11):
            faces.append((0, 1, 2) if n % 12 == 5 else (2, 1, 0))
        elif n % 12 in (6, 7, 8, 10):
            bad.append(line)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        points, faces, bad = text.read_obj(spark, f"{tmp_path}/*", parts=True)
        assert "SortMergeJoin" not in str(points._jdf.queryExecution().executedPlan()) and "__part" not in str(faces._jdf.queryExecution().executedPlan())
        found = {k: ([], [], []) for k in want}
        for i, (rows, names) in enumerate(((points.orderBy("point_id"), "xyz"), (faces.orderBy("face_id"), ("v0", "v1", "v2")))):
            for r in rows.collect():
                found[r.file[-1]][i].append((r[1], *[r[c] for c in names]))
        for r in bad.collect():
            found[r.file[-1]][2].append(r.line)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, (p, f, b) in want.items():
        assert found[name][:2] == ([(i, *x) for i, x in enumerate(p)], [(i, *x) for i, x in enumerate(f)]) and sorted(found[name][2]) == sorted(b)
