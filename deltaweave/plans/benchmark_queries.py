"""TPC-H- and Nexmark-shaped queries over the given tables, as SQL that both sides run.

Where the given tables lack a column, a near one stands in: lineitem for the bridge between parts and suppliers, the order's
priority for its ship priority. For Nexmark, customers are persons, parts are auctions and line items are bids.
"""

from __future__ import annotations

from deltaweave.functions import scalar as S
from deltaweave.operators import batch
from deltaweave.plans.registry import Tables, query, sql_query

PRICE = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
REVENUE = "CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"
TPCH = {
    1: f"SELECT l_returnflag, {PRICE} AS s FROM lineitem GROUP BY l_returnflag",
    2: "SELECT DISTINCT p_partkey, s_suppkey, s_acctbal FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 15",
    3: f"SELECT l_orderkey, {PRICE} AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < DATE '1996-01-01' GROUP BY l_orderkey",
    4: "SELECT o_orderpriority, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    5: f"SELECT n_name, {REVENUE} AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name",
    6: "SELECT CAST(SUM(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS s FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05",
    7: f"SELECT n_nationkey, {PRICE} AS s FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey < 12 GROUP BY n_nationkey",
    8: f"SELECT o_orderdate, {PRICE} AS s FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY o_orderdate",
    9: f"SELECT n_nationkey, {PRICE} AS s FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 25 GROUP BY n_nationkey",
    10: f"SELECT c_custkey, {PRICE} AS s FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey",
    11: "SELECT l_partkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 10 GROUP BY l_partkey",
    12: "SELECT l_linestatus, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY l_linestatus",
    13: "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey GROUP BY c_custkey",
    14: f"SELECT p_partkey, {PRICE} AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-01-01' GROUP BY p_partkey",
    15: f"WITH revenue AS (SELECT l_suppkey, {REVENUE} AS total FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT MAX(total) FROM revenue)",
    16: "SELECT p_brand, COUNT(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 30 GROUP BY p_brand",
    17: f"SELECT p_partkey, {PRICE} AS s FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' GROUP BY p_partkey",
    18: "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 180) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice",
    19: f"SELECT {REVENUE} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 40) OR (p_brand = 'Brand#5' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 50)",
    20: "SELECT s_suppkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size = 12 GROUP BY s_suppkey",
    21: "SELECT s_suppkey, COUNT(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_linestatus = 'F' GROUP BY s_suppkey",
    22: "SELECT c_nationkey, COUNT(*) AS customers, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer WHERE c_acctbal > (SELECT AVG(CAST(c_acctbal AS DECIMAL(18,2))) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
}
for _n, _text in TPCH.items():
    sql_query(f"tpch_q{_n}", _text)

PERSON = "person AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, c_nationkey AS state FROM customer)"
AUCTION = "auction AS (SELECT p_partkey AS id, p_name AS item_name, p_partkey % 50 AS seller, p_size % 10 AS category, CAST(p_retailprice * 100 AS BIGINT) AS reserve FROM part)"
BID = "bid AS (SELECT l_partkey AS auction, l_suppkey AS bidder, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS price, l_linestatus AS channel, l_shipdate AS date_time, l_orderkey AS k, l_linenumber AS j FROM lineitem)"
NEXMARK = {
    0: "SELECT auction, bidder, price, date_time FROM bid",
    1: "SELECT auction, bidder, price * 90 / 100 AS price FROM bid",
    2: "SELECT auction, price FROM bid WHERE auction % 123 = 0",
    3: "SELECT name, city, state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE category = 5 AND (state = 3 OR state = 7 OR city = 'BUILDING')",
    4: "SELECT category, CAST(AVG(CAST(final AS DOUBLE)) AS DOUBLE) AS a FROM (SELECT a.id, category, MAX(price) AS final FROM auction a JOIN bid b ON a.id = b.auction AND b.price >= a.reserve GROUP BY a.id, category) x GROUP BY category",
    6: "SELECT seller, k, j, AVG(CAST(price AS DOUBLE)) OVER (PARTITION BY seller ORDER BY date_time, k, j, bidder, price ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM auction JOIN bid ON auction.id = bid.auction",
    8: "SELECT p.id, name, a.id AS auction_id FROM person p JOIN auction a ON p.id = a.seller AND a.reserve >= p.state * 1000",
    9: "SELECT auction, bidder, price FROM (SELECT bid.*, ROW_NUMBER() OVER (PARTITION BY auction ORDER BY price DESC, date_time, k, j, bidder) AS rn FROM bid) x WHERE rn <= 1",
    13: "SELECT auction, price, channel, r_name AS value FROM bid JOIN region ON bid.auction % 5 = r_regionkey",
    14: "SELECT auction, CASE WHEN price > 5000000 THEN 'day' WHEN price > 1000000 THEN 'night' ELSE 'other' END AS t, LENGTH(REPLACE(channel, 'F', '')) AS c FROM bid WHERE price > 900000",
    16: "SELECT channel, CAST(date_time AS DATE) AS d, COUNT(DISTINCT bidder) AS bidders, COUNT(DISTINCT auction) AS auctions FROM bid GROUP BY channel, CAST(date_time AS DATE)",
    17: "SELECT auction, CAST(date_time AS DATE) AS d, COUNT(*) AS n, MAX(price) AS hi, AVG(CAST(price AS DOUBLE)) AS a FROM bid GROUP BY auction, CAST(date_time AS DATE)",
    18: "SELECT auction, bidder, price FROM (SELECT bid.*, ROW_NUMBER() OVER (PARTITION BY bidder ORDER BY date_time DESC, k, j, auction, price) AS rn FROM bid) x WHERE rn <= 1",
    19: "SELECT auction, price, k, j FROM (SELECT bid.*, ROW_NUMBER() OVER (PARTITION BY auction ORDER BY price DESC, k, j, bidder) AS rn FROM bid) x WHERE rn <= 10",
    20: "SELECT auction, bidder, price, item_name FROM bid JOIN auction a ON bid.auction = a.id WHERE category = 3",
}


def _with(text: str) -> str:
    used = [c for n, c in (("person", PERSON), ("auction", AUCTION), ("bid", BID)) if n in text]
    return f"WITH {', '.join(used)} {text}"


for _n, _text in NEXMARK.items():
    _spark = _text.replace("price * 90 / 100", "price * 90 DIV 100")
    sql_query(f"nexmark_q{_n}", _with(_spark), _with(_text.replace("price * 90 / 100", "price * 90 // 100")))


def _bids(t: Tables):
    return t.sql(_with("SELECT * FROM bid"))


@query("nexmark_q5", _with("SELECT w, auction, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY w ORDER BY n DESC, auction) AS rn FROM (SELECT DATE_TRUNC('month', date_time) AS w, auction, COUNT(*) AS n FROM bid GROUP BY ALL) x) y WHERE rn <= 5"))
def _(t):
    from pyspark.sql import functions as F

    counts = _bids(t).groupBy(F.date_trunc("month", "date_time").cast("timestamp_ntz").alias("w"), "auction").agg(F.count("*").alias("n"))
    return batch.top_k(counts, 5, [F.col("n").desc(), F.col("auction")], ["w"])


@query("nexmark_q7", _with("SELECT TIME_BUCKET(INTERVAL '1 day', date_time) AS w, MAX(price) AS hi FROM bid GROUP BY w"))
def _(t):
    from pyspark.sql import functions as F

    return _bids(t).groupBy(S.date_bin("date_time", 86400).alias("w")).agg(F.max("price").alias("hi"))


@query("nexmark_q11", """SELECT user_id, COUNT(*) AS n, MIN(ts) AS start_, MAX(ts) AS end_ FROM (SELECT user_id, ts, SUM(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '10 hours' THEN 0 ELSE 1 END AS f FROM events) a) b GROUP BY user_id, s""")
def _(t):
    return batch.sessions(t.events, ["user_id"], "ts", "10 hours").selectExpr("user_id", "n", "session_start AS start_", "session_end AS end_")


sql_query("nexmark_q12", "SELECT user_id, TIME_BUCKET(INTERVAL '1 day', ts) AS w, COUNT(*) AS n FROM events GROUP BY ALL".replace("TIME_BUCKET(INTERVAL '1 day', ts)", "DATE_TRUNC('day', CAST(ts AS TIMESTAMP_NTZ))").replace("GROUP BY ALL", "GROUP BY user_id, DATE_TRUNC('day', CAST(ts AS TIMESTAMP_NTZ))"), "SELECT user_id, DATE_TRUNC('day', ts) AS w, COUNT(*) AS n FROM events GROUP BY ALL")
sql_query("nexmark_q15", _with("SELECT CAST(date_time AS DATE) AS d, COUNT(*) AS total, COUNT(CASE WHEN price < 1000000 THEN 1 END) AS low_n, COUNT(DISTINCT bidder) AS bidders, COUNT(DISTINCT CASE WHEN price < 1000000 THEN bidder END) AS low_bidders FROM bid GROUP BY CAST(date_time AS DATE)"))


@query("nexmark_q21", "SELECT page_id, REGEXP_REPLACE(url, '[0-9]+', 'N') AS u FROM pages")
def _(t):
    return t.pages.select("page_id", S.regexp_replace_first("url", "[0-9]+", "N").alias("u"))


@query("nexmark_q22", "SELECT page_id, SPLIT_PART(url, '/', 3) AS a, SPLIT_PART(url, '/', 4) AS b, SPLIT_PART(url, '/', 5) AS c FROM pages")
def _(t):
    return t.pages.select("page_id", *[S.split_part("url", "/", n).alias(x) for n, x in ((3, "a"), (4, "b"), (5, "c"))])
