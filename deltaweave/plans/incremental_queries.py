"""Registered queries of the incremental layer: views kept over epochs of changes must equal their batch definition.

Each history loads a part of a table, then inserts the rest while it retracts and replaces rows. The SQL is over the rows that are left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaweave import zset
from deltaweave.operators import batch
from deltaweave.plans import nodes as N
from deltaweave.plans.engine import Engine, update
from deltaweave.plans.registry import Tables, query
from deltaweave.sources.tables import cdc_changes, checkpointed, shared_folder
from deltaweave.streaming.late import late_windows, split_late_sessions

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_price decimal(18,2)"
CUSTOMERS = "c_custkey long, c_nationkey int, c_mktsegment string"
#: What the history of orders leaves: keys with remainder 3 are deleted, those with remainder 5 doubled in price.
LEFT = "(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 8 = 5 THEN 2 ELSE 1 END AS o_price FROM orders WHERE o_orderkey % 8 <> 3) o"


def engine(t: Tables) -> Engine:
    return Engine(t.spark, f"{shared_folder(t.spark)}/views-{uuid.uuid4().hex}")


def orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_price"))


def customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")


def history(e: Engine, t: Tables) -> None:
    """Epoch 0: customers and half of the orders; 1: the other half, and the deletions; 2: the updates; 2 again, which must change nothing."""
    rows = orders(t)
    e.commit(0, {"orders": zset.lift(rows.filter("o_orderkey % 2 = 1")), "customer": zset.lift(customers(t))})
    gone = e.weighted("orders").filter("o_orderkey % 8 = 3")
    e.commit(1, {"orders": zset.merge(zset.lift(rows.filter("o_orderkey % 2 = 0")), zset.negate(gone))})
    change = update(e.weighted("orders"), F.col("o_orderkey") % 8 == 5, o_price=(F.col("o_price") * 2).cast("decimal(18,2)"))
    e.commit(2, {"orders": change})
    e.commit(2, {"orders": change})


def kept(t: Tables, *views: tuple[str, N.Node]) -> Engine:
    e = engine(t)
    e.create_table("orders", ORDERS)
    e.create_table("customer", CUSTOMERS)
    for name, node in views:
        e.create_materialized_view(name, node)
    history(e, t)
    return e


O, C = N.Source("orders"), N.Source("customer")


@query("ivm_filter_project_epochs", f"SELECT o_orderkey, CAST(o_price AS DOUBLE) AS p FROM {LEFT} WHERE o_orderstatus = 'F'")
def _(t):
    node = N.project(N.filter_(O, F.col("o_orderstatus") == "F"), "o_orderkey", F.col("o_price").cast("double").alias("p"))
    return kept(t, ("v", node)).read("v")


@query("ivm_agg_epochs", f"SELECT o_orderstatus, CAST(SUM(o_price) AS DOUBLE) AS total, COUNT(*) AS n FROM {LEFT} GROUP BY o_orderstatus")
def _(t):
    return kept(t, ("v", N.SumCount(O, ["o_orderstatus"], "o_price"))).read("v").select("o_orderstatus", F.col("total").cast("double").alias("total"), "n")


@query("ivm_minmax_epochs", f"SELECT o_custkey, CAST(MIN(o_price) AS DOUBLE) AS lo, CAST(MAX(o_price) AS DOUBLE) AS hi, COUNT(DISTINCT o_orderstatus) AS kinds FROM {LEFT} GROUP BY o_custkey")
def _(t):
    node = N.aggregate(O, ["o_custkey"], F.min("o_price").cast("double").alias("lo"), F.max("o_price").cast("double").alias("hi"), F.count_distinct("o_orderstatus").alias("kinds"))
    return kept(t, ("v", node)).read("v")


@query("ivm_join_epochs", f"SELECT o_orderkey, c_mktsegment, CAST(o_price AS DOUBLE) AS p FROM {LEFT} JOIN customer ON o_custkey = c_custkey")
def _(t):
    node = N.project(N.InnerJoin(O, C, [("o_custkey", "c_custkey")]), "o_orderkey", "c_mktsegment", F.col("o_price").cast("double").alias("p"))
    return kept(t, ("v", node)).read("v")


@query("ivm_outer_join_epochs", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM {LEFT} WHERE o_price > 300000) b ON c_custkey = o_custkey")
def _(t):
    node = N.project(N.Matching(C, N.filter_(O, F.col("o_price") > 300000), [("c_custkey", "o_custkey")], "left"), "c_custkey", "o_orderkey")
    return kept(t, ("v", node)).read("v")


@query("ivm_anti_join_epochs", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {LEFT} WHERE o_custkey = c_custkey AND o_price > 300000)")
def _(t):
    node = N.project(N.Matching(C, N.filter_(O, F.col("o_price") > 300000), [("c_custkey", "o_custkey")], "left_anti"), "c_custkey")
    return kept(t, ("v", node)).read("v")


@query("ivm_window_epochs", f"SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_price, o_orderkey) AS rn FROM {LEFT}")
def _(t):
    node = N.window(O, ["o_custkey"], rn=F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_price", "o_orderkey")))
    return kept(t, ("v", N.project(node, "o_orderkey", "o_custkey", "rn"))).read("v")


@query("ivm_topk_epochs", f"SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_price DESC, o_orderkey) AS rn FROM {LEFT}) x WHERE rn <= 2")
def _(t):
    node = N.top_k(O, 2, [F.col("o_price").desc(), F.col("o_orderkey")], ["o_custkey"])
    return kept(t, ("v", N.project(node, "o_custkey", "o_orderkey"))).read("v")


@query("ivm_distinct_epochs", f"SELECT DISTINCT o_custkey, o_orderstatus FROM {LEFT}")
def _(t):
    return kept(t, ("v", N.SetOp([N.project(O, "o_custkey", "o_orderstatus")], "distinct"))).read("v")


@query("ivm_setops_epochs", f"SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey AS k FROM {LEFT} WHERE o_price > 200000")
def _(t):
    left, right = N.project(C, F.col("c_custkey").alias("k")), N.project(N.filter_(O, F.col("o_price") > 200000), F.col("o_custkey").alias("k"))
    return kept(t, ("v", N.SetOp([left, right], "except", all=True))).read("v")


@query("view_on_view", f"SELECT c_mktsegment, CAST(SUM(o_price) AS DOUBLE) AS total, COUNT(*) AS n FROM {LEFT} JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(t):
    joined = N.project(N.InnerJoin(O, C, [("o_custkey", "c_custkey")]), "c_mktsegment", "o_price")
    e = kept(t, ("joined", joined), ("v", N.SumCount(N.Source("joined"), ["c_mktsegment"], "o_price")))
    return e.read("v").select("c_mktsegment", F.col("total").cast("double").alias("total"), "n")


@query("view_attach", f"SELECT o_orderstatus, COUNT(*) AS n FROM {LEFT} GROUP BY o_orderstatus")
def _(t):
    """A view made between two epochs starts from the state of then."""
    e = engine(t)
    e.create_table("orders", ORDERS)
    rows = orders(t)
    e.commit(0, {"orders": zset.lift(rows)})
    e.create_materialized_view("v", N.aggregate(O, ["o_orderstatus"], F.count("*").alias("n")))
    e.commit(1, {"orders": zset.negate(e.weighted("orders").filter("o_orderkey % 8 = 3"))})
    return e.read("v")


@query("changelog_subscribe", f"SELECT o_orderstatus, COUNT(*) AS n FROM {LEFT} GROUP BY o_orderstatus")
def _(t):
    """The snapshot and changes of a view, added up."""
    e = kept(t, ("v", N.aggregate(O, ["o_orderstatus"], F.count("*").alias("n"))))
    return zset.expand(zset.consolidate(e.subscribe("v", from_epoch=-1).drop("epoch")))


@query("dml_update_delete", f"SELECT o_orderkey, CAST(o_price AS DOUBLE) AS p FROM {LEFT}")
def _(t):
    return kept(t).read("orders").select("o_orderkey", F.col("o_price").cast("double").alias("p"))


@query("ivm_session_epochs", """SELECT user_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS n FROM (SELECT user_id, ts, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '8 hours' THEN 0 ELSE 1 END AS f FROM events WHERE event_id % 5 <> 2) a) b GROUP BY user_id, s""")
def _(t):
    e = engine(t)
    e.create_table("events", "event_id long, user_id long, ts timestamp_ntz")
    e.create_materialized_view("v", N.session(N.Source("events"), ["user_id"], "ts", "8 hours"))
    rows = t.events.select("event_id", "user_id", "ts")
    e.commit(0, {"events": zset.lift(rows.filter("event_id % 5 < 3"))})
    e.commit(1, {"events": zset.merge(zset.lift(rows.filter("event_id % 5 >= 3")), zset.lift(rows.filter("event_id % 5 = 2"), -1))})
    return e.read("v")


@query("ivm_recursion_epochs", "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, c_nationkey + LENGTH(o_orderpriority) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def _(t):
    e = engine(t)
    e.create_table("edges", "a long, b long")

    def step(new: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        return new.join(tables["edges"].select(F.col("a").alias("m"), F.col("b").alias("z")), F.col("b") == F.col("m")).select("a", F.col("z").alias("b"))

    e.create_materialized_view("v", N.Recursion(N.Source("edges"), step, ["edges"], checkpointed))
    edges = t.sql("SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(c_nationkey + LENGTH(o_orderpriority) AS BIGINT) AS b, o_orderstatus AS k FROM orders JOIN customer ON o_custkey = c_custkey")
    e.commit(0, {"edges": zset.lift(edges.filter("k <> 'F'").select("a", "b"))})
    e.commit(1, {"edges": zset.merge(zset.lift(edges.filter("k = 'F'").select("a", "b")), zset.lift(edges.filter("k = 'P'").select("a", "b"), -1))})
    return e.read("v")


@query("cdc_changes", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 5 <> 0")
def _(t):
    """Insert, update and delete records of a change stream."""
    row, changed = F.struct("s_suppkey", "s_nationkey"), F.struct("s_suppkey", F.lit(-1).alias("s_nationkey"))
    none = F.lit(None).cast("struct<s_suppkey:bigint,s_nationkey:int>")
    s = t.supplier
    made = [s.select(none.alias("before"), row.alias("after")), s.filter("s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0").select(row.alias("before"), changed.alias("after")), s.filter("s_suppkey % 5 = 0").select(row.alias("before"), none.alias("after"))]
    return zset.expand(zset.consolidate(cdc_changes(made[0].union(made[1]).union(made[2]))))


#: Two epochs of events: the watermark of the second is the latest time of the first, which is before the last six days.
EARLY = "event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-24 00:00:00'"
_MARK = f"(SELECT MAX(ts) FROM events WHERE {EARLY})"
_DAY = "DATE_TRUNC('day', ts)"
_LATE = f"(NOT ({EARLY}) AND {_MARK} > {_DAY} + INTERVAL '1 day')"


def _late(t: Tables, policy: str):
    rows = t.events.select("event_id", "ts")
    early = "event_id % 2 = 0 AND ts < TIMESTAMP_NTZ '2024-01-24 00:00:00'"
    return late_windows([rows.filter(early), rows.filter(f"NOT ({early})")], "ts", "1 day", policy)


@query("late_drop", f"SELECT {_DAY} AS window_start, COUNT(*) AS n FROM events WHERE NOT {_LATE} GROUP BY 1")
def _(t):
    return _late(t, "drop")[0]


@query("late_update", f"SELECT {_DAY} AS window_start, COUNT(*) AS n FROM events GROUP BY 1")
def _(t):
    return _late(t, "update")[0]


@query("late_route", f"SELECT event_id, ts FROM events WHERE {_LATE}")
def _(t):
    return _late(t, "route")[1]


# -- further nodes over the same history
_DEAR = f"(SELECT * FROM {LEFT} WHERE o_price > 300000) b"


def dear() -> N.Node:
    return N.filter_(O, F.col("o_price") > 300000)


def keys() -> tuple[N.Node, N.Node]:
    return N.project(O, F.col("o_custkey").alias("k")), N.project(C, F.col("c_custkey").alias("k"))


for _how, _sql in (("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    @query(f"ivm_{_how}_join_epochs", f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c {_sql} {_DEAR} ON c_custkey = o_custkey")
    def _(t, how=_how):
        node = N.Matching(N.filter_(C, F.col("c_mktsegment") == "BUILDING"), dear(), [("c_custkey", "o_custkey")], how)
        return kept(t, ("v", N.project(node, "c_custkey", "o_orderkey"))).read("v")


@query("ivm_semi_join_epochs", f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {LEFT} WHERE o_custkey = c_custkey AND o_price > 300000)")
def _(t):
    return kept(t, ("v", N.project(N.Matching(C, dear(), [("c_custkey", "o_custkey")], "left_semi"), "c_custkey"))).read("v")


@query("ivm_not_in_epochs", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {LEFT} WHERE o_price > 300000)")
def _(t):
    return kept(t, ("v", N.project(N.NullAwareAnti(C, dear(), "c_custkey", "o_custkey"), "c_custkey"))).read("v")


@query("ivm_union_epochs", f"SELECT o_custkey AS k FROM {LEFT} UNION ALL SELECT c_custkey AS k FROM customer")
def _(t):
    return kept(t, ("v", N.Union(keys()))).read("v")


@query("ivm_intersect_epochs", f"SELECT o_custkey AS k FROM {LEFT} INTERSECT ALL SELECT c_custkey AS k FROM customer")
def _(t):
    return kept(t, ("v", N.SetOp(keys(), "intersect", all=True))).read("v")


@query("ivm_median_epochs", f"SELECT o_orderstatus, CAST(MEDIAN(o_custkey) AS DOUBLE) AS m, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s FROM {LEFT} GROUP BY o_orderstatus")
def _(t):
    return kept(t, ("v", N.aggregate(O, ["o_orderstatus"], F.median("o_custkey").alias("m"), F.sum_distinct("o_custkey").alias("s")))).read("v")


def _event_views(t: Tables, node: N.Node) -> DataFrame:
    """Three fifths of the events, then the others, while one fifth is taken back."""
    e = engine(t)
    e.create_table("events", "event_id long, user_id long, ts timestamp_ntz")
    e.create_materialized_view("v", node)
    rows = t.events.select("event_id", "user_id", "ts")
    e.commit(0, {"events": zset.lift(rows.filter("event_id % 5 < 3"))})
    e.commit(1, {"events": zset.merge(zset.lift(rows.filter("event_id % 5 >= 3")), zset.lift(rows.filter("event_id % 5 = 2"), -1))})
    return e.read("v")


@query("ivm_tumble_epochs", "SELECT TIME_BUCKET(INTERVAL '1 day', ts) AS window_start, COUNT(*) AS n FROM events WHERE event_id % 5 <> 2 GROUP BY 1")
def _(t):
    return _event_views(t, N.aggregate(N.Linear(N.Source("events"), lambda z: batch.tumble(z, "ts", "1 day")), ["window_start"], F.count("*").alias("n")))


@query("ivm_hop_epochs", "SELECT w AS window_start, COUNT(*) AS n FROM (SELECT TIME_BUCKET(INTERVAL '6 hours', ts) - i * INTERVAL '6 hours' AS w FROM events, RANGE(4) r(i) WHERE event_id % 5 <> 2) x GROUP BY w")
def _(t):
    return _event_views(t, N.aggregate(N.Linear(N.Source("events"), lambda z: batch.hop(z, "ts", "1 day", "6 hours")), ["window_start"], F.count("*").alias("n")))


@query("commit_retry", "SELECT s_suppkey FROM supplier")
def _(t):
    """A commit that fails leaves nothing, and its retry counts once."""
    e = engine(t)
    e.create_table("s", "s_suppkey long")
    e.create_table("other", "x long")
    rows = zset.lift(t.supplier.select("s_suppkey"))
    overdraft = zset.lift(t.spark.createDataFrame([(1,)], "x long"), -1)
    try:
        e.commit(0, {"s": rows, "other": overdraft})
    except ValueError:
        e.commit(0, {"s": rows})
    return e.read("s")


@query("engine_restart", "SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY s_nationkey")
def _(t):
    """A second engine on the same path goes on where the first stopped."""
    first = engine(t)

    def declared(e: Engine) -> Engine:
        e.create_table("s", "s_suppkey long, s_nationkey int")
        e.create_materialized_view("v", N.aggregate(N.Source("s"), ["s_nationkey"], F.count("*").alias("n")))
        return e

    rows = t.supplier.select("s_suppkey", "s_nationkey")
    declared(first).commit(0, {"s": zset.lift(rows.filter("s_suppkey % 2 = 0"))})
    second = declared(Engine(t.spark, first.path))
    second.commit(0, {"s": zset.lift(rows)})  # committed before
    second.commit(1, {"s": zset.lift(rows.filter("s_suppkey % 2 = 1"))})
    return second.read("v")


@query("view_on_inline_view", f"SELECT o_custkey, CAST(SUM(o_price) AS DOUBLE) AS total, COUNT(*) AS n FROM {LEFT} WHERE o_price > 300000 GROUP BY o_custkey")
def _(t):
    e = engine(t)
    e.create_table("orders", ORDERS)
    e.create_table("customer", CUSTOMERS)
    e.create_view("dear", dear())
    e.create_materialized_view("v", N.SumCount(N.Source("dear"), ["o_custkey"], "o_price"))
    history(e, t)
    return e.read("v").select("o_custkey", F.col("total").cast("double").alias("total"), "n")


@query("diamond_views", f"SELECT o_custkey, COUNT(*) AS n, CAST(MAX(o_price) AS DOUBLE) AS hi FROM {LEFT} GROUP BY o_custkey")
def _(t):
    counts = N.aggregate(O, ["o_custkey"], F.count("*").alias("n"))
    highs = N.aggregate(O, ["o_custkey"], F.max("o_price").alias("hi"))
    both = N.InnerJoin(N.Source("counts"), N.project(N.Source("highs"), F.col("o_custkey").alias("k2"), "hi"), [("o_custkey", "k2")])
    e = kept(t, ("counts", counts), ("highs", highs), ("both", both))
    return e.read("both").select("o_custkey", "n", F.col("hi").cast("double").alias("hi"))


@query("stream_tumble_epochs", "SELECT TIME_BUCKET(INTERVAL '1 day', ts) AS window_start, COUNT(*) AS n FROM events GROUP BY 1")
def _(t):
    """A file stream whose micro-batches are commits."""
    e = engine(t)
    e.create_table("events", "event_id long, ts timestamp_ntz")
    e.create_materialized_view("v", N.aggregate(N.Linear(N.Source("events"), lambda z: batch.tumble(z, "ts", "1 day")), ["window_start"], F.count("*").alias("n")))
    t.events.select("event_id", "ts").repartition(3).write.parquet(f"{e.path}/_in")
    stream = t.spark.readStream.schema("event_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{e.path}/_in")
    e.stream("events", stream, f"{e.path}/_progress").awaitTermination()
    return e.read("v")


@query("late_retraction", f"SELECT {_DAY} AS window_start, CAST(SUM(CASE WHEN {EARLY} THEN 1 WHEN event_id % 3 = 0 THEN -1 WHEN {_LATE} THEN 0 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1 HAVING SUM(CASE WHEN {EARLY} THEN 1 WHEN event_id % 3 = 0 THEN -1 WHEN {_LATE} THEN 0 ELSE 1 END) <> 0")
def _(t):
    """Late insertions are dropped, late retractions never."""
    rows = t.events.select("event_id", "ts")
    early = "event_id % 2 = 0 AND ts < TIMESTAMP_NTZ '2024-01-24 00:00:00'"
    second = rows.filter(f"NOT ({early})").withColumn("w", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return late_windows([rows.filter(early).withColumn("w", F.lit(1)), second], "ts", "1 day", "drop", weight="w")[0]


@query("late_session", f"SELECT event_id FROM events WHERE NOT ({EARLY}) AND {_MARK} > ts + INTERVAL '8 hours'")
def _(t):
    """Rows that come after the session they would make has ended."""
    rows = t.events.select("event_id", "ts")
    early = "event_id % 2 = 0 AND ts < TIMESTAMP_NTZ '2024-01-24 00:00:00'"
    mark = rows.filter(early).agg(F.max("ts")).first()[0]
    return split_late_sessions(rows.filter(f"NOT ({early})"), "ts", "8 hours", mark)[1].select("event_id")
