"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document's terms are its lower-cased words between blanks, told apart by 64-bit hashes; a term's weight is its number of
occurrences. For sample k, term f has r and c drawn from a gamma(2, 1) and b drawn uniformly, all from hashes of (f, k). A
weight w gives t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1), and the sample is the (f, t) of the least a, kept as
24 bits. Two documents share a sample with a chance equal to their generalised Jaccard similarity, the sum of the lesser
weights over the sum of the greater ones.

A gamma(2, 1) is the sum of two exponentials, and also the product of a gamma(3, 1) and the root of a uniform, so that its
logarithm is a sum, too. So r and ln c of a term are sums of the draws of two halves of its hash, b is that of the first half, and
2 ^ 26 combinations come from two tables of HALF rows, whatever the input, which may be broadcast. At weight 1, t is 0 and
ln a = (c0 - r0 * d) + c1 - r1 * d with d = 1 - b, of which the first part is in the table; at others, r * t goes off. All rows of a document are made, counted and reduced in the partition that
holds its text: words are never shuffled.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint

_HALF_BITS = 13
HALF = 1 << _HALF_BITS
SAMPLES = 64
BLANKS = " \t\n\x0b\f\r"
NULL_ID = -(1 << 63)
PART_CHARS = 3_000_000  # characters of text in one partition
_ID_BITS = 24  # of a sample, and how many hex digits it has is in fingerprint()
SCALE, OFFSET = 1 << 30, 192  # of the order of ln a in whole numbers
_SPREAD = 0x9E3779  # odd, so that a term's t give different samples


def draws(spark: SparkSession, side: int, samples: int = SAMPLES) -> DataFrame:
    """For each half of a hash, arrays over the samples: half0, r0, d0 (one less b), p0 (ln c less r * d), or half1, r1, c1. All but d0 are in units of 1 / SCALE, and p0 is moved by OFFSET."""

    def log_uniform(k: Column, salt: int) -> Column:
        return F.coalesce(F.ln(uniform(k, salt)), F.lit(0.0))  # never null, and declared so

    def uniform(k: Column, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("id", k, F.lit(2 * salt + side)), 11) + F.lit(0.5)) * F.lit(2.0**-53)  # not a quotient, which is declared as one that may be null

    def log_gamma(k: Column) -> Column:
        if side:
            return log_uniform(k, 1) * 0.5
        return F.coalesce(F.ln(-(log_uniform(k, 1) + log_uniform(k, 4) + log_uniform(k, 5))), F.lit(0.0))

    def over(make) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(samples)), make)

    def gap(k: Column) -> Column:
        return 1 - uniform(k, 3)

    half, unit = F.col("id").alias(f"half{side}"), F.lit(float(SCALE))
    r = over(lambda k: -log_uniform(k, 2) * unit).alias(f"r{side}")
    if side:
        return spark.range(HALF).select(half, r, over(lambda k: log_gamma(k) * unit).alias("c1"))
    return spark.range(HALF).select(half, r, over(gap).alias("d0"), over(lambda k: (log_gamma(k) + log_uniform(k, 2) * gap(k) + OFFSET) * unit).alias("p0"))


def sketch(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, sketch): the samples of each text as integers. `keys` are unique for each row, and rows with equal keys[0] are in one partition.

    A text without words has one term of its own, the empty word, so such texts have equal sketches.
    """
    low = F.lit((1 << _ID_BITS) - 1)
    words = texts.select(*keys, F.explode(F.split(F.btrim(F.lower(text), F.lit(BLANKS)), r"\s+")).alias("word"))
    counted = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("w"))
    halves = [F.shiftrightunsigned("term", side * _HALF_BITS).bitwiseAND(F.lit(HALF - 1)).alias(f"half{side}") for side in (0, 1)]
    drawn = counted.select(*keys, *halves, F.shiftrightunsigned("term", 2 * _HALF_BITS).bitwiseAND(low).alias("own"), F.coalesce(F.ln(F.col("w").cast("double")), F.lit(0.0)).alias("lw"))
    for side in (0, 1):
        drawn = drawn.join(F.broadcast(draws(texts.sparkSession, side, samples)), f"half{side}")

    def sample(k: int) -> Column:
        r0, d, p, r1, c = (F.col(x)[k] for x in ("r0", "d0", "p0", "r1", "c1"))
        value = p + c - r1 * d
        r = r0 + r1
        t = F.coalesce(F.floor(F.col("lw") * float(SCALE) / r + 1 - d), F.lit(0).cast("long"))
        # the order of the values in the upper bits, which sample it is in the lower ones; most terms have weight 1
        one = F.shiftleft(F.floor(value), _ID_BITS).bitwiseOR(F.col("own"))
        more = F.shiftleft(F.floor(value - r * t), _ID_BITS).bitwiseOR((F.col("own") + t * F.lit(_SPREAD)).bitwiseAND(low))
        return F.min(F.when(F.col("lw") == 0, one).otherwise(more)).alias(f"s{k}")

    least = drawn.groupBy(*keys).agg(*[sample(k) for k in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"s{k}").bitwiseAND(low).cast("int") for k in range(samples)]).alias("sketch"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def fingerprint(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def _following(docs: DataFrame) -> DataFrame:
    """(kid, next, next_hash, half, chars) for each id: the id that follows in descending order, after the last the first.

    Rows with one id have one follower, and what follows is the row of that id whose text has the least hash. Ids are sorted
    by range; only one row for each range is looked at together.
    """
    light = docs.select("kid", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n"))
    light = light.groupBy("kid").agg(F.min("h").alias("h"), F.max(F.floor(F.col("n") / 2)).cast("int").alias("half"), F.sum("n").alias("chars"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(light.repartitionByRange(parts, "kid").withColumn("p", F.spark_partition_id()))
    me = F.struct("kid", "h")
    edges = ranged.groupBy("p").agg(F.max(me).alias("hi"), F.min("kid").alias("lo"))
    whole = Window.orderBy(F.col("lo").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("p", F.coalesce(F.lead("hi").over(Window.orderBy(F.col("lo").desc())), F.first("hi").over(whole)).alias("below"))
    within = ranged.withColumn("then", F.lead(me).over(Window.partitionBy("p").orderBy(F.col("kid").desc())))
    then = F.coalesce("then", "below")
    chained = within.join(F.broadcast(edges), "p")  # a row for each range
    return checkpoint(chained.select("kid", then["kid"].alias("next"), then["h"].alias("next_hash"), "half", "chars"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) first ones of the following
    document, in descending order of doc_id and round again. A null text counts as empty; texts without words are alike. A
    null id counts as the least one. Rows with one id keep their own row and share a follower; see `_following`.
    """
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("kid"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    chain = _following(base)
    chars = chain.agg(F.sum("chars")).first()[0] or 0
    dealt = base.repartition(max(1, ceil(chars / PART_CHARS)), "kid")
    giving = chain.select(F.col("next").alias("kid"), "next_hash", F.col("kid").alias("to"), "half")
    # whether it is that row is asked after the join: as a join key, the hash would have every text shuffled again
    prefix = F.when(F.xxhash64("text") == F.col("next_hash"), F.substring("text", F.lit(1), F.col("half")))
    given = dealt.join(giving, "kid").select("to", prefix.alias("prefix"))
    given = given.groupBy("to").agg(F.max("prefix").alias("prefix")).withColumnRenamed("to", "kid")  # one, even of repeated rows
    half = F.floor(F.col("n_chars") / 2).cast("int")
    own = dealt.join(chain.select("kid", "next"), "kid").join(given, "kid").withColumn("n_chars", F.char_length("text").cast("long"))
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("prefix", F.lit(1), half)))
    sides = F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))
    # the number tells repeated rows apart; it comes before the explode, which would count its own rows
    numbered = own.select("kid", F.monotonically_increasing_id().alias("uid"), "next", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), F.xxhash64("text").alias("h"), sides.alias("sides"))
    both = numbered.select("kid", "uid", "next", "n_chars", "sha", "h", F.explode("sides").alias("x"))
    keys = ["kid", "uid", "next", "n_chars", "sha", "h"]
    sketched = sketch(both.select(*keys, "x.side", "x.text"), [*keys, "side"], "text", samples)
    sides = checkpoint(sketched.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == k, F.col("sketch"))).alias(name) for k, name in enumerate(("mine", "edit"))]))
    first = sides.groupBy("kid").agg(F.min(F.struct("h", "mine")).alias("x")).select(F.col("kid").alias("next"), F.col("x.mine").alias("theirs"))
    joined = sides.join(first, "next")
    return joined.select(
        F.when(F.col("kid") != NULL_ID, F.col("kid")).alias("doc_id"),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        fingerprint(F.col("mine")).alias("fingerprint"),
        fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("edit"), samples).alias("near_edited"),
        likeness(F.col("mine"), F.col("theirs"), samples).alias("near_next"),
    )
