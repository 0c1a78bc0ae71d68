"""Panels in blocks: the same results as over whole panels, and no block that grows with its panel."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.operators import blocks, cross


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    seqs = rng.permutation(5000)[:900]
    rows = [(int(s), "hot" if k < 700 else ["b", None, "c"][k % 3], int(rng.integers(0, 3)), rng.normal(size=6).tolist()) for k, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "seq long, panel string, key int, data array<double>").repartition(6).cache()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 25)


def collected(df, *columns):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in columns)) for r in df.collect()), key=lambda r: r[0])


def test_blocks_are_bounded_runs(hot, small):
    cut = blocks.in_blocks(hot, ["panel"])
    sizes = cut.groupBy("panel", "block_").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("a").collect()
    own = [r for r in sizes if r.panel == "hot"]
    assert sum(r.n for r in own) == 700 and len(own) > 12 and max(r.n for r in own) < 700 / 3
    assert [r.block_ for r in own] == sorted(r.block_ for r in own) and all(x.b < y.a for x, y in zip(own, own[1:]))
    few = blocks.in_blocks(hot, ["panel"], rows=1000)
    assert few.where("block_ <> 0 or least_ is not null").count() == 0


@pytest.mark.parametrize("before, after", [(1, 0), (0, 1), (2, 2), (3, 1)])
def test_margins_hold_the_neighbours(hot, small, before, after):
    near = blocks.with_margins(hot, ["panel"], before=before, after=after)
    w, whole = blocks.window(["panel"]), Window.partitionBy("panel").orderBy("seq")
    beside = lambda w: F.concat_ws(",", *[F.lag("seq", k).over(w) for k in range(1, before + 1)], F.lit("|"), *[F.lead("seq", k).over(w) for k in range(1, after + 1)])
    got = blocks.without_margins(near.withColumn("beside", beside(w)))
    assert got.columns == [*hot.columns, "beside"]
    assert collected(got, "seq", "beside") == collected(hot.withColumn("beside", beside(whole)), "seq", "beside")
    assert near.where("margin_").count() < 900


def test_operators_in_blocks(hot, monkeypatch):
    def results():
        return [
            collected(cross.mix(hot, ["panel"]), "seq", "data"),
            collected(cross.median(hot, ["panel"], 3), "seq", "data"),
            collected(cross.adjacent_coherence(hot, ["panel"]), "seq", "coherence"),
            collected(cross.filter_phase_coherence(hot, ["panel"]), "seq", "data"),
            collected(cross.runs(hot, ["panel"], "seq", "key"), "seq", "run"),
            collected(cross.segments_at_gaps(hot, ["panel"], "seq", 12), "seq", "segment"),
        ]

    whole = results()
    monkeypatch.setattr(blocks, "ROWS", 25)
    for a, b in zip(whole, results()):
        assert a == b
    plan = cross.mix(hot, ["panel"])._jdf.queryExecution().executedPlan().toString()
    assert all("block_" in line for line in plan.splitlines() if "Window" in line and "data" in line)


def test_running_totals(hot, small):
    got = blocks.totals_before(hot, ["panel"], "key", "total")
    whole = hot.withColumn("total", F.sum("key").over(Window.partitionBy("panel").orderBy("seq")))
    assert collected(got, "seq", "total") == collected(whole, "seq", "total") and got.columns == whole.columns


def test_empty_table(hot):
    none = hot.where("false")
    assert blocks.without_margins(blocks.with_margins(none, ["panel"])).count() == 0 and cross.runs(none, ["panel"], "seq", "key").count() == 0
