"""Secret scans in DataFrame functions alone.

Three kinds have fixed forms (assign, access, hex). The fourth, entropy, slides a window over candidate strings of a
character class and keeps the incremental counts of its characters: with S the sum of c*log2(c) over the counts c, a
window of W characters has Shannon entropy log2(W) - S/W, and one step changes two counts and so two terms of S. Spans are
in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The forms of the three base kinds and the least length of what must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 20
HEX, HEX_LEAST = r"[0-9a-f]{24,}", 24  # the runs of [0-9a-f]+ that are long enough
VALUE_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Character classes of candidate strings: alphabet, the form of a candidate, window, least entropy in bits, and the form of
#: candidates that are left to another class.
CLASSES = {
    "base16": ("0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}+(?![0-9A-Za-z])", 20, 2.8, None),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", 20, 3.75, "^[0-9a-fA-F]*$"),
}
#: Candidates that are no secrets: placeholders, runs of one character, counting sequences, words without any digit.
ALLOWED = r"(?i)example|placeholder|changeme|dummy|(.)\1{7}|0123456789|1234567890|abcdefgh|^[^0-9]*$"
LONG_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"  # in every text with an access, hex or entropy span
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each item, `step` folded over all items up to it, block by block rather than all anew for each item."""

    def fold(items: Column, start: Column) -> Column:
        return F.aggregate(items, start, step)

    def within(v: Column, blocks: Column) -> Column:
        def one(b: Column) -> Column:
            base = fold(F.slice(blocks, F.lit(1), b), first)
            own = F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
            return let(base, lambda s: let(own, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: fold(F.slice(x, F.lit(1), i), s))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), one))

    def parted(v: Column) -> Column:
        count = F.ceil(F.size(v) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), first))
        return F.when(F.size(v) > 0, let(blocks, lambda bs: within(v, bs))).otherwise(F.slice(v, 1, 0))

    return let(values, parted)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches of `pattern`, leftmost first and without overlap; value: the group's text."""

    def placed(hits: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        ends = running(steps, F.lit(0), lambda a, x: a + x)
        values = hits if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.zip_with(ends, F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("n"), v.alias("v"))), lambda e, x: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["v"].alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans_of(found: Column, kind: str, keep: Callable[[Column], Column]) -> Column:
    rank = KINDS.index(kind)
    return F.transform(F.filter(found, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def entropy_hull(candidate: Column, alphabet: str, window: int, least: float) -> Column:
    """(from, to): the hull, within the candidate, of all windows of at least `least` bits; null if there is none."""
    size = len(alphabet)

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def scan(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > window, F.element_at(codes, i - window)).otherwise(F.lit(0))

            def moved(x: Column) -> Column:
                """x: the codes that enter and leave; a character that does both changes nothing."""
                came, went = F.element_at(acc["counts"], x["new"]), F.element_at(acc["counts"], F.greatest(x["old"], F.lit(1)))
                gain = weight(came + 1) - weight(came)
                loss = F.when(x["old"] > 0, weight(went) - weight(went - 1)).otherwise(F.lit(0.0))
                s = F.when(x["new"] == x["old"], acc["s"]).otherwise(acc["s"] + gain - loss)
                counts = F.transform(acc["counts"], lambda c, k: c + (k + 1 == x["new"]).cast("int") - (k + 1 == x["old"]).cast("int"))
                full = (i >= window) & (F.lit(log2(window)) - s / window >= least)
                return F.struct(
                    counts.alias("counts"),
                    s.alias("s"),
                    F.when(full & (acc["first"] < 0), i - window).otherwise(acc["first"]).alias("first"),
                    F.when(full, i).otherwise(acc["last"]).alias("last"),
                )

            return let(F.struct(new.alias("new"), old.alias("old")), moved)

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        done = F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step)
        return let(done, lambda d: F.when(d["first"] >= 0, F.struct(d["first"].alias("from"), d["last"].alias("to"))))

    letters = F.filter(F.split(candidate, ""), lambda c: c != "")
    return let(F.transform(letters, lambda c: F.call_function("instr", F.lit(alphabet), c)), scan)


def entropy_spans(text: Column) -> Column:
    """Spans of all classes; candidates on the allow list give none, and equal spans of two classes count once."""
    kind = KINDS.index("entropy")

    def of(alphabet: str, form: str, window: int, least: float, other: str | None) -> Column:
        allowed = ALLOWED if other is None else f"{ALLOWED}|{other}"
        open_ = F.filter(matches(text, form), lambda x: ~F.rlike(x["value"], F.lit(allowed)))
        hulls = F.transform(open_, lambda x: F.struct(x["start"].alias("start"), entropy_hull(x["value"], alphabet, window, least).alias("hull")))
        return F.transform(
            F.filter(hulls, lambda x: x["hull"].isNotNull()),
            lambda x: F.struct((x["start"] + x["hull"]["from"]).alias("start"), F.lit(kind).alias("rank"), (x["start"] + x["hull"]["to"]).alias("end"), F.lit("entropy").alias("kind")),
        )

    return F.array_distinct(F.concat(*[of(*c) for c in CLASSES.values()]))


def secret_spans(text: Column) -> Column:
    """All spans of a text in order of start, then kind. Texts that cannot have a kind skip its pattern."""
    none = F.lit(None).cast(SPANS)
    lower = F.lower(text)
    named = lower.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lower.contains(word)
    assign = spans_of(matches(text, ASSIGN, 2), "assign", lambda x: F.length(x["value"]) >= VALUE_LEAST)
    access = spans_of(matches(text, ACCESS), "access", lambda x: x["end"] - x["start"] >= ACCESS_LEAST)
    hexes = spans_of(matches(text, HEX), "hex", lambda x: x["end"] - x["start"] >= HEX_LEAST)
    empty = F.array().cast(SPANS)
    by_name = F.coalesce(F.when(named, assign).otherwise(none), empty).cast(SPANS)
    by_run = F.coalesce(F.when(text.rlike(LONG_RUN), F.concat(F.when(text.contains("AKIA"), access.cast(SPANS)).otherwise(empty), hexes.cast(SPANS), entropy_spans(text).cast(SPANS))).otherwise(none), empty)
    return F.array_sort(F.concat(by_name, by_run))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (start, rank, end, kind), in order.

    A null text counts as empty and has no spans. Repeated rows and repeated or null ids each keep their own row; other
    columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # a one-row explode keeps the optimiser from computing the spans once for each column made of them
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.explode(F.array(secret_spans(text))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans together by one); a null text stays null."""
    names = docs.columns
    text = F.col(text_col)
    own = free_name(docs, "_spans")
    found = docs.select("*", F.explode(F.array(secret_spans(F.coalesce(text, F.lit(""))))).alias(own))

    def cut(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        kept = F.zip_with(spans, before, lambda x, p: F.when(x["start"] >= p, F.concat(F.substring(text, p + 1, x["start"] - p), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    clean = F.when(F.size(own) > 0, let(F.col(own), cut)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in names])


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of `find_secrets`."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda x: x["kind"] != "entropy"))
    return find_secrets(docs).select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
