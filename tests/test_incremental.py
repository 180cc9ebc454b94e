"""Random changes through every plan node: the maintained state equals the batch definition, as a multiset, after each epoch."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaweave import zset
from deltaweave.operators import batch
from deltaweave.plans import engine as engines
from deltaweave.plans import nodes as N
from deltaweave.plans.engine import CycleError, Engine, delete, update

A, B = N.Source("a"), N.Source("b")
SCHEMA = {"a": "k long, v long", "b": "k2 long, w long"}
NODES = {
    "filter": lambda: N.filter_(A, F.col("v") > 4),
    "union": lambda: N.Union([A, N.project(B, F.col("k2").alias("k"), F.col("w").alias("v"))]),
    "inner": lambda: N.InnerJoin(A, B, [("k", "k2")]),
    "residual": lambda: N.InnerJoin(A, B, [("k", "k2")], F.col("v") < F.col("w")),
    "left": lambda: N.Matching(A, B, [("k", "k2")], "left"),
    "right": lambda: N.Matching(A, B, [("k", "k2")], "right"),
    "full": lambda: N.Matching(A, B, [("k", "k2")], "full"),
    "semi": lambda: N.Matching(A, B, [("k", "k2")], "left_semi"),
    "anti": lambda: N.Matching(A, B, [("k", "k2")], "left_anti"),
    "not_in": lambda: N.NullAwareAnti(A, B, "k", "k2"),
    "sum_count": lambda: N.SumCount(A, ["k"], "v"),
    "minmax": lambda: N.aggregate(A, ["k"], F.min("v").alias("lo"), F.max("v").alias("hi"), F.median("v").alias("m")),
    "global": lambda: N.aggregate(A, [], F.count("*").alias("n")),
    "distinct": lambda: N.SetOp([A], "distinct"),
    "intersect_all": lambda: N.SetOp([A, N.project(B, F.col("k2").alias("k"), F.col("w").alias("v"))], "intersect", all=True),
    "except": lambda: N.SetOp([A, N.project(B, F.col("k2").alias("k"), F.col("w").alias("v"))], "except"),
    "window": lambda: N.window(A, ["k"], rn=F.row_number().over(Window.partitionBy("k").orderBy("v"))),
    "top_k": lambda: N.top_k(A, 2, [F.col("v").desc()], ["k"]),
}


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def changes(rng, rows):
    """A few retractions of present rows and a few insertions, with nulls and repeats."""
    gone = rng.sample(rows, min(len(rows), rng.randrange(4)))
    new = [(rng.choice([1, 2, 3, None]), rng.randrange(8)) for _ in range(rng.randrange(1, 6))]
    for r in gone:
        rows.remove(r)
    rows += new
    return [(*r, -1) for r in gone] + [(*r, 1) for r in new]


@pytest.mark.parametrize("name", NODES)
def test_maintained_equals_batch(spark, tmp_path, name):
    rng = random.Random(sum(map(ord, name)))
    e = Engine(spark, str(tmp_path))
    for t, s in SCHEMA.items():
        e.create_table(t, s)
    node = NODES[name]()
    e.create_materialized_view("v", node)
    rows = {"a": [], "b": []}
    for epoch in range(3):
        e.commit(epoch, {t: spark.createDataFrame(changes(rng, rows[t]), f"{SCHEMA[t]}, _weight long") for t in rows})
        sources = {t: zset.lift(spark.createDataFrame(rows[t], SCHEMA[t])) for t in rows}
        assert bag(e.read("v")) == bag(zset.expand(node.state(sources))), epoch


def test_epochs_are_idempotent_and_logged(spark, tmp_path):
    e = Engine(spark, str(tmp_path), retention=2)
    e.create_table("a", SCHEMA["a"])
    e.create_materialized_view("v", N.SumCount(A, ["k"], "v"))
    for epoch in range(3):
        change = zset.lift(spark.createDataFrame([(1, epoch)], SCHEMA["a"]))
        assert e.commit(epoch, {"a": change})
        assert not e.commit(epoch, {"a": change})
    assert bag(e.subscribe("v", from_epoch=1).drop("epoch")) == Counter({(1, 1, 2, -1): 1, (1, 3, 3, 1): 1})
    assert bag(e.subscribe("v").drop("epoch")) == Counter({(1, 3, 3, 1): 1})
    with pytest.raises(ValueError):
        e.subscribe("v", from_epoch=-1)
    assert "SumCount" in e.explain_incremental("v")


def test_dml_and_overdraft(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.commit(0, {"a": zset.lift(spark.createDataFrame([(1, 1), (1, 1), (2, 5)], SCHEMA["a"]))})
    e.commit(1, {"a": update(e.weighted("a"), F.col("k") == 1, v=F.col("v") + 1)})
    e.commit(2, {"a": delete(e.weighted("a"), F.col("k") == 2)})
    assert bag(e.read("a")) == Counter({(1, 2): 2})
    with pytest.raises(Exception, match="invalid multiplicity"):
        e.commit(3, {"a": zset.lift(spark.createDataFrame([(9, 9)], SCHEMA["a"]), -1)})


def test_cycles_are_refused(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_materialized_view("x", A)
    e.create_materialized_view("y", N.Source("x"))
    with pytest.raises(CycleError):
        e.create_materialized_view("x", N.Source("y"), replace=True)
    assert e.order() == ["x", "y"]


def test_a_failed_commit_leaves_nothing_and_can_be_tried_again(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_table("b", SCHEMA["b"])
    e.create_materialized_view("v", N.SumCount(A, ["k"], "v"))
    e.commit(0, {"a": zset.lift(spark.createDataFrame([(1, 1)], SCHEMA["a"]))})
    good = zset.lift(spark.createDataFrame([(1, 2)], SCHEMA["a"]))
    with pytest.raises(ValueError, match="invalid multiplicity"):
        e.commit(1, {"a": good, "b": zset.lift(spark.createDataFrame([(9, 9)], SCHEMA["b"]), -1)})
    assert e.epoch == 0 and bag(e.read("a")) == Counter({(1, 1): 1})
    assert e.commit(1, {"a": good})
    assert bag(e.read("a")) == Counter({(1, 1): 1, (1, 2): 1}) and bag(e.read("v")) == Counter({(1, 3, 2): 1})


def test_an_engine_opened_again_goes_on(spark, tmp_path):
    def opened():
        e = Engine(spark, str(tmp_path))
        e.create_table("a", SCHEMA["a"])
        e.create_materialized_view("v", N.SumCount(A, ["k"], "v"))
        return e

    change = zset.lift(spark.createDataFrame([(1, 5), (2, None)], SCHEMA["a"]))
    for epoch in range(12):
        e = opened() if epoch % 5 == 0 else e
        assert e.epoch == epoch - 1 and e.commit(epoch, {"a": change}) and not opened().commit(epoch, {"a": change})
    assert e.base["a"][0] > 0  # logs were folded on the way
    assert bag(opened().read("v")) == Counter({(1, 60, 12): 1, (2, None, 12): 1})
    assert opened().subscribe("v", from_epoch=9).select("epoch").distinct().count() == 2


def test_a_commit_writes_no_more_than_its_change(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.commit(0, {"a": zset.lift(spark.range(50_000).selectExpr("id AS k", "id AS v"))})
    e.commit(1, {"a": zset.lift(spark.createDataFrame([(1, 1)], SCHEMA["a"]))})
    sizes = [sum(f.stat().st_size for f in (tmp_path / "a").rglob(f"epoch={k}/*/*.parquet")) for k in (0, 1)]
    assert 0 < sizes[1] < 3000 < sizes[0]


def test_retention_removes_files(spark, tmp_path):
    e = Engine(spark, str(tmp_path), retention=1)
    e.create_table("a", SCHEMA["a"])
    for epoch in range(5):
        e.commit(epoch, {"a": zset.lift(spark.createDataFrame([(1, epoch)], SCHEMA["a"]))})
    assert len(list((tmp_path / "a" / "log").rglob("_SUCCESS"))) <= 2 and len(list((tmp_path / "a" / "state").rglob("_SUCCESS"))) == 1
    assert e.read("a").count() == 5 and Engine(spark, str(tmp_path)).epoch == 4


def test_inline_views_and_diamonds(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_view("big", N.filter_(A, F.col("v") > 2))
    e.create_materialized_view("sums", N.SumCount(N.Source("big"), ["k"], "v"))
    e.create_materialized_view("counts", N.aggregate(A, ["k"], F.count("*").alias("c")))
    both = N.InnerJoin(N.project(N.Source("sums"), "k", "total"), N.project(N.Source("counts"), F.col("k").alias("k2"), "c"), [("k", "k2")])
    e.create_materialized_view("both", both)
    assert e.levels() == [["counts", "sums"], ["both"]]
    e.commit(0, {"a": zset.lift(spark.createDataFrame([(1, 1), (1, 5), (2, 3)], SCHEMA["a"]))})
    e.commit(1, {"a": spark.createDataFrame([(1, 5, -1), (1, 9, 1), (2, 4, 1)], f"{SCHEMA['a']}, _weight long")})
    assert bag(e.read("both")) == Counter({(1, 9, 1, 2): 1, (2, 7, 2, 2): 1})
    assert bag(e.read("big")) == Counter({(1, 9): 1, (2, 3): 1, (2, 4): 1})


def test_refresh_tells_the_views_behind_it(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_materialized_view("x", N.filter_(A, F.col("v") > 2))
    e.create_materialized_view("y", N.SumCount(N.Source("x"), ["k"], "v"))
    e.commit(0, {"a": zset.lift(spark.createDataFrame([(1, 1), (1, 5)], SCHEMA["a"]))})
    e.views["x"] = N.filter_(A, F.col("v") > 0)
    e.refresh("x")
    assert bag(e.read("y")) == Counter({(1, 6, 2): 1})


def test_a_stream_commits_its_batches(spark, tmp_path):
    source = tmp_path / "in"
    e = Engine(spark, str(tmp_path / "state"))
    e.create_table("events", "id long, ts timestamp_ntz")
    e.create_materialized_view("v", N.aggregate(N.Linear(N.Source("events"), lambda z: batch.tumble(z, "ts", "1 day")), ["window_start"], F.count("*").alias("n")))
    days = [["2024-01-05 10:00:00", "2024-01-05 11:00:00"], ["2024-01-05 12:00:00", "2024-01-01 00:00:00"]]  # the last is four days late
    for k, times in enumerate(days):
        spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, ts string").write.mode("append").json(str(source))
        stream = spark.readStream.schema("id long, ts timestamp").json(str(source))
        e.stream("events", stream, str(tmp_path / "progress"), ts="ts", delay="1 day").awaitTermination()
    assert [r["n"] for r in e.read("v").collect()] == [3] and e.epoch == 1


def test_a_view_takes_its_old_rows_from_itself(spark, tmp_path):
    made = []
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_materialized_view("v", N.Keyed(A, ["k"], lambda rows: made.append(1) or rows.groupBy("k").agg(F.max("v").alias("hi"))))
    made.clear()
    e.commit(0, {"a": zset.lift(spark.createDataFrame([(1, 1), (1, 5), (None, 3)], SCHEMA["a"]))})
    e.commit(1, {"a": spark.createDataFrame([(1, 5, -1), (None, 4, 1)], f"{SCHEMA['a']}, _weight long")})
    assert len(made) == 2 and bag(e.read("v")) == Counter({(1, 1): 1, (None, 4): 1})


@pytest.mark.parametrize("name", ["inner", "full", "semi", "sum_count", "minmax", "except", "top_k"])
def test_large_changes_look_for_no_keys(spark, tmp_path, monkeypatch, name):
    """Where most of a table changes, and every change counts as large here, views equal their definition without a search for touched keys."""
    looked, real = [], zset.rows_with_keys
    monkeypatch.setattr(engines, "LEAST", 0, raising=False)
    monkeypatch.setattr(zset, "rows_with_keys", lambda *x: looked.append(1) or real(*x))
    rng = random.Random(name)
    e = Engine(spark, str(tmp_path))
    for t, s in SCHEMA.items():
        e.create_table(t, s)
    node = NODES[name]()
    e.create_materialized_view("v", node)
    rows = {"a": [], "b": []}
    for epoch in range(2):
        e.commit(epoch, {t: spark.createDataFrame(changes(rng, rows[t]), f"{SCHEMA[t]}, _weight long") for t in rows})
    assert bag(e.read("v")) == bag(zset.expand(node.state({t: zset.lift(spark.createDataFrame(rows[t], SCHEMA[t])) for t in rows})))
    assert not looked


def test_small_changes_look_for_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engines, "LEAST", 0)
    e = Engine(spark, str(tmp_path))
    e.create_table("a", SCHEMA["a"])
    e.create_materialized_view("v", N.aggregate(A, ["k"], F.count("*").alias("n")))
    e.commit(0, {"a": zset.lift(spark.range(50_000).selectExpr("id % 9 AS k", "id AS v"))})
    looked, real = [], zset.rows_with_keys
    monkeypatch.setattr(zset, "rows_with_keys", lambda *x: looked.append(1) or real(*x))
    e.commit(1, {"a": zset.lift(spark.createDataFrame([(4, 1)], SCHEMA["a"]), 2)})
    assert looked and Counter(r["n"] for r in e.read("v").collect()) == Counter([5556] * 4 + [5558] + [5555] * 4)
