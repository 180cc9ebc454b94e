import pytest
from pyspark.sql import functions as F

from deltaweave.functions import scalar as S
from deltaweave.operators import batch
from deltaweave.plans.catalog import QUERIES
from deltaweave.sources.tables import cdc_changes, checkpointed, generate_rows, json_rows
from deltaweave.streaming.late import late_windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "expr, wanted",
    [
        (lambda: S.substring(F.lit("hello"), 0, 2), "h"),
        (lambda: S.substring(F.lit("hello"), -2, 3), ""),
        (lambda: S.substring(F.lit("hello"), 2), "ello"),
        (lambda: S.concat(F.lit("a"), F.lit(None), F.lit(3)), "a3"),
        (lambda: S.regexp_replace_first(F.lit("abab"), "b", "X"), "aXab"),
        (lambda: S.regexp_replace_first(F.lit("zzz"), "b", "X"), "zzz"),
        (lambda: S.split_part(F.lit("a/b"), "/", 0), ""),
        (lambda: S.split_part(F.lit("a/b"), "/", -1), ""),
        (lambda: S.split_part(F.lit("a/b"), "/", 2), "b"),
        (lambda: S.trim(F.lit("\t  a ")), "a"),
        (lambda: S.trim(F.lit("xxaxy"), "xy"), "a"),
        (lambda: S.int_div(F.lit(-7), F.lit(2)), -3),
        (lambda: S.int_div(F.lit(7), F.lit(2)), 3),
        (lambda: S.strpos(F.lit("abc"), ""), 1),
        (lambda: S.date_part("dow", F.lit("2024-01-07 00:00:00")), 0.0),
        (lambda: S.date_part("isodow", F.lit("2024-01-07 00:00:00")), 7.0),
        (lambda: S.date_part("epoch", F.lit("1970-01-01 00:00:01.5")), 1.5),
        (lambda: S.age(F.lit("2024-01-03 01:02:03"), F.lit("2024-01-01 00:00:00")), "2 days 01:02:03"),
        (lambda: S.to_char(F.lit("2024-01-03 04:05:06").cast("timestamp"), "YYYY-MM-DD HH24:MI:SS"), "2024-01-03 04:05:06"),
        (lambda: S.is_distinct_from(F.lit(None), F.lit(1)), True),
    ],
)
def test_scalars(spark, expr, wanted):
    assert one(spark, expr()) == wanted


def test_series_and_json(spark):
    df = spark.createDataFrame([(1, 3, '[1,"a",{"b":2}]'), (3, 1, "[]"), (2, 2, None)], "a long, b long, j string")
    assert sorted(r["g"] for r in batch.generate_series(df, F.col("a"), F.col("b"), 1, "g").collect()) == [1, 2, 2, 3]
    assert sorted(r["g"] for r in batch.generate_series(df, F.col("a"), F.col("b"), -2, "g").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        batch.generate_series(df, F.col("a"), F.col("b"), 0, "g")
    assert sorted(r["i"] for r in batch.json_array(df, "j", "i").collect()) == ['"a"', "1", '{"b":2}']


def test_null_aware_anti(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    for right, wanted in (([], {1, 2, None}), ([(1,)], {2}), ([(1,), (None,)], set())):
        got = batch.null_aware_anti(left, spark.createDataFrame(right, "r long"), "k", "r")
        assert {r[0] for r in got.collect()} == wanted


def test_top_k_ties_and_sessions(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "c"), (2, 1, "d")], "g long, v long, t string")
    assert sorted(r["t"] for r in batch.top_k(rows, 1, [F.col("v").desc()], ["g"]).collect()) == ["a", "d"]
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:01")], "u string, s string").select("u", F.col("s").cast("timestamp_ntz").alias("ts"))
    got = sorted((str(r["session_start"])[11:16], str(r["session_end"])[11:16], r["n"]) for r in batch.sessions(events, ["u"], "ts", "10 minutes").collect())
    assert got == [("00:00", "00:10", 2), ("00:20", "00:20", 1)]


def test_fixed_point_ends_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    hop = edges.select(F.col("a").alias("m"), F.col("b").alias("z"))
    step = lambda new: new.join(hop, F.col("b") == F.col("m")).select("a", F.col("z").alias("b"))
    from deltaweave.sources.tables import checkpointed

    assert batch.fixed_point(edges, step, checkpointed).count() == 9
    with pytest.raises(RuntimeError):
        batch.fixed_point(edges, step, checkpointed, max_iterations=1)


def test_bloom_has_no_false_negative(spark):
    df = spark.range(20)
    bits = batch.bloom(df, "id")
    assert df.crossJoin(bits).filter(~batch.might_contain(F.col("bits"), F.col("id"))).count() == 0


def test_sources(spark):
    assert generate_rows(spark, 10).count() == 10
    lines = spark.createDataFrame([('[1,"x"]',), ('{"a":2,"b":"y"}',), ("broken",)], "j string")
    good, dead = json_rows(lines, "j", "a long, b string", strict=False)
    assert sorted(map(tuple, good.collect())) == [(1, "x"), (2, "y")]
    assert [r[0] for r in dead.collect()] == ["broken"]
    records = spark.sql("SELECT struct(1 AS k) AS before, struct(2 AS k) AS after UNION ALL SELECT NULL, struct(3)")
    assert sorted(map(tuple, cdc_changes(records).collect())) == [(1, -1), (2, 1), (3, 1)]


def test_late_policies(spark):
    def rows(*stamps):
        return spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))

    epochs = [rows("2024-01-01 01:00:00", "2024-01-05 01:00:00"), rows("2024-01-01 02:00:00", "2024-01-05 02:00:00")]
    assert sorted(r["n"] for r in late_windows(epochs, "ts", "1 day", "drop")[0].collect()) == [1, 2]
    assert sorted(r["n"] for r in late_windows(epochs, "ts", "1 day", "update")[0].collect()) == [2, 2]
    assert late_windows(epochs, "ts", "1 day", "route")[1].count() == 1


def test_windows_do_not_depend_on_the_session_zone(spark):
    """Days with a clock change in New York among them."""
    times = ["2024-07-01 00:30:00", "2024-03-10 02:30:00", "2024-03-10 03:10:00", "2024-11-03 01:30:00", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").selectExpr("i", "cast(t as timestamp_ntz) as t")
    got = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = [batch.tumble(rows, "t", "1 day"), batch.hop(rows, "t", "1 day", "6 hours"), batch.sessions(rows, ["i"], "t", "1 hour")]
            found.append(rows.select("i", S.date_bin("t", 900), S.date_part("epoch", "t"), S.date_part("dow", "t"), S.age("t", F.lit("2024-01-01"))))
            got.append([sorted(map(str, (tuple(r.asDict().values()) for r in x.selectExpr(*[f"cast(`{c}` as string) as `{c}`" for c in x.columns]).collect()))) for x in found])
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[0] == got[1] and "2024-07-01 00:00:00" in str(got[0][0])


def test_snapshots_hold_every_row(spark):
    rows = spark.createDataFrame([(None if i % 10 == 0 else f"k{i % 7}", i) for i in range(100)], "k string, v int")
    parts = [(i, c.collect()) for i, c in batch.snapshot_chunks(rows, "k", 30, checkpointed)]
    assert [(i, len(c)) for i, c in parts] == [(0, 30), (1, 30), (2, 30), (3, 10)] and {r["v"] for _, c in parts for r in c} == set(range(100))
    again = [(i, c.collect()) for i, c in batch.snapshot_chunks(rows.repartition(5), "k", 30, checkpointed, resume_from=2)]
    assert [(i, sorted(map(tuple, c), key=str)) for i, c in again] == [(i, sorted(map(tuple, c), key=str)) for i, c in parts[2:]]
    assert list(batch.snapshot_chunks(rows.limit(0), "k", 30, checkpointed)) == []


def test_chunks_are_read_one_by_one(spark):
    rows = spark.range(100).selectExpr("cast(null as string) AS k", "id AS v")
    files = [c.inputFiles() for _, c in batch.snapshot_chunks(rows, "k", 30, checkpointed, then=["v"])]
    assert len(files) == 4 and all(files) and len(set(sum(files, []))) == sum(map(len, files))


@pytest.mark.parametrize("copies", [0, 7])
def test_the_snapshot_query_takes_one_plan_for_all_chunks(spark, tmp_path, copies):
    """Also where names are repeated, in which case the second column says which row comes first, and over no rows at all."""
    names = spark.range(50 * copies).selectExpr("format_string('Supplier#%09d', id % 50) AS s_name", "id AS s_suppkey")
    names.write.parquet(str(tmp_path / "supplier.parquet"))
    found = QUERIES["snapshot_chunks"](spark, str(tmp_path))
    ordered = sorted(names.collect(), key=lambda r: ("" if r["s_name"] == "Supplier#000000003" else r["s_name"], r["s_suppkey"]))
    assert {r["n"]: r["chunk"] for r in found.collect()} == {r["s_suppkey"]: i // 40 for i, r in enumerate(ordered)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
