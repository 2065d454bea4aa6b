"""Steps written one by one, which leave nothing behind, against steps of one plan."""

import os

import numpy as np
from pyspark.sql import functions as F

from geoflow.functions import tables
from geoflow.operators import knn, markov, spectral
from geoflow.sources.samples import torus


def test_rounds_in_place_equal_rounds_of_one_plan_and_leave_little(spark, monkeypatch):
    points = torus(spark, 300, small=0.8, seed=3)
    g = markov.build(points, knn.knn(points, 16))
    plan = spectral.packed.layout(spectral.normalized(g.symk, g.nodes), spectral.packed.along_curve(g.nodes, ("ix", "iy", "iz")), 64)
    state = spectral.packed.start(plan, spectral.begun(g.nodes, 6))
    folder = tables.shared_folder(spark)
    one, found = spectral.krylov_round(plan, state, 6, 4, 5)
    monkeypatch.setattr(spectral, "AT_ONCE", 0)
    before = set(os.listdir(folder.removeprefix("file:")))
    with tables.scratch(spark) as kept:
        two, again = spectral.krylov_round(plan, state, 6, 4, 5)
        kept += [two, again]
    assert len(set(os.listdir(folder.removeprefix("file:"))) - before) == 2  # the state and the values
    assert np.isclose(found.first().residual, again.first().residual, rtol=1e-6)
    a, b = (np.array([r.v for r in spectral.packed.unpacked(plan, s).orderBy("point_id").collect()]) for s in (one, two))
    assert np.allclose(np.abs(a[:, :4]), np.abs(b[:, :4]), atol=1e-8)


def test_scratch_keeps_what_is_asked_for_alone(spark):
    with tables.scratch(spark) as kept:
        a, b = (tables.stored(spark.range(5).select((F.col("id") + k).alias("id"))) for k in (0, 1))
        c = tables.stored(a.join(b, "id"))
        kept.append(c.filter("id > 2"))
    exists = [os.path.exists(x.inputFiles()[0].removeprefix("file://")) for x in (a, b, c)]
    assert exists == [False, False, True] and c.count() == 4
    tables.drop_stored(c)
    assert not os.path.exists(c.inputFiles()[0].removeprefix("file://"))
