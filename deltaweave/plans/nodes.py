"""Plan nodes: each has one definition over plain rows and one rule that turns changes of its inputs into changes of its output.

A context holds the named sources before the change (`old`), the change (`delta`) and after it (`new`), all weighted.
They need not be added up: a row may be there several times, with weights of either sign.
Rules by class: linear nodes apply to the change itself; the inner join is bilinear; every other node computes the touched
keys before and after, and emits the difference.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave import zset
from deltaweave.operators import batch
from deltaweave.zset import WEIGHT


class States(dict):
    """Weighted states by name; an inline view's is made from its definition when asked for."""

    def __init__(self, states: dict[str, DataFrame], inline: dict[str, Node] | None = None):
        super().__init__(states)
        self.inline = inline or {}

    def __missing__(self, name: str) -> DataFrame:
        return self.inline[name].state(self)


@dataclass
class Context:
    old: dict[str, DataFrame]
    delta: dict[str, DataFrame]
    new: dict[str, DataFrame]
    inline: dict[str, Node] = field(default_factory=dict)
    large: frozenset[str] = frozenset()  # sources whose change is a large part of them
    own: tuple[Node, DataFrame] | None = None  # the view's node and the weighted rows that the view has

    def known(self, node: Node) -> DataFrame | None:
        """The node's output before the change, if it is kept."""
        return self.own[1] if self.own is not None and self.own[0] is node else None

    def with_keys(self, node: Node, state: DataFrame, keys: Sequence[str], touched: DataFrame) -> DataFrame:
        """Rows of the touched keys; all rows where so much of the node's sources changed that to look for these costs more than it spares."""
        names, seen = list(node.sources()), set()
        while names:
            name = names.pop()
            seen.add(name)
            names += self.inline[name].sources() if name in self.inline else ()
        return state if not keys or seen & self.large else zset.rows_with_keys(state, list(keys), touched)


class Node:
    inputs: tuple[Node, ...] = ()

    def batch(self, *rows: DataFrame) -> DataFrame:
        """The output for plain input rows."""
        raise NotImplementedError

    def delta(self, cx: Context) -> DataFrame:
        raise NotImplementedError

    def state(self, sources: dict[str, DataFrame]) -> DataFrame:
        """The output for weighted sources, weighted."""
        return zset.lift(self.batch(*[zset.expand(i.state(sources)) for i in self.inputs]))

    def sources(self) -> set[str]:
        return set().union(*[i.sources() for i in self.inputs])

    def explain(self, depth: int = 0) -> str:
        return "\n".join([f"{'  ' * depth}{type(self).__name__} [{self.rule}]", *[i.explain(depth + 1) for i in self.inputs]])

    rule = "recompute touched keys"


@dataclass
class Source(Node):
    name: str
    rule = "change of the table"

    def delta(self, cx):
        if self.name in cx.inline:
            return cx.inline[self.name].delta(cx)
        return cx.delta[self.name] if self.name in cx.delta else cx.old[self.name].limit(0)

    def state(self, sources):
        return sources[self.name]

    def sources(self):
        return {self.name}


@dataclass
class Linear(Node):
    """Filter, projection, computed column, unnesting, tumbling or hopping assignment: anything that works row by row and keeps `_weight`."""

    child: Node
    apply: Callable[[DataFrame], DataFrame]
    rule = "linear"

    def __post_init__(self):
        self.inputs = (self.child,)

    def delta(self, cx):
        return self.apply(self.child.delta(cx))

    def state(self, sources):
        return self.apply(self.child.state(sources))


def filter_(child: Node, condition: Column) -> Linear:
    return Linear(child, lambda z: z.filter(condition))


def project(child: Node, *exprs: Column | str) -> Linear:
    return Linear(child, lambda z: z.select(*exprs, WEIGHT))


@dataclass
class Union(Node):
    parts: Sequence[Node]
    rule = "linear"

    def __post_init__(self):
        self.inputs = tuple(self.parts)

    def delta(self, cx):
        return zset.merge(*[p.delta(cx) for p in self.parts])

    def state(self, sources):
        return zset.merge(*[p.state(sources) for p in self.parts])


def _renamed(z: DataFrame, prefix: str) -> DataFrame:
    return z.withColumnRenamed(WEIGHT, f"{prefix}{WEIGHT}")


@dataclass
class InnerJoin(Node):
    """Column names of both sides must differ; `on`: pairs of names; `residual`: a further condition over both."""

    left: Node
    right: Node
    on: Sequence[tuple[str, str]]
    residual: Column | None = None
    rule = "bilinear"

    def __post_init__(self):
        self.inputs = (self.left, self.right)

    def _join(self, a: DataFrame, b: DataFrame) -> DataFrame:
        condition = reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in self.on])
        if self.residual is not None:
            condition = condition & self.residual
        out = _renamed(a, "_l").join(_renamed(b, "_r"), condition)
        return out.withColumn(WEIGHT, F.col(f"_l{WEIGHT}") * F.col(f"_r{WEIGHT}")).drop(f"_l{WEIGHT}", f"_r{WEIGHT}")

    def delta(self, cx):
        dl, dr = self.left.delta(cx), self.right.delta(cx)
        return zset.merge(self._join(dl, self.right.state(cx.new)), self._join(self.left.state(cx.old), dr))

    def state(self, sources):
        return self._join(self.left.state(sources), self.right.state(sources))


@dataclass
class Keyed(Node):
    """A node whose output for a key depends only on the input rows with that key. Without keys, all rows are one group."""

    child: Node
    keys: Sequence[str]
    of_rows: Callable[[DataFrame], DataFrame]

    def __post_init__(self):
        self.inputs = (self.child,)

    def batch(self, rows):
        return self.of_rows(rows)

    def delta(self, cx):
        change, known = self.child.delta(cx), cx.known(self)

        def rows(sources: dict[str, DataFrame]) -> DataFrame:
            return zset.lift(self.of_rows(zset.expand(cx.with_keys(self, self.child.state(sources), self.keys, change))))

        if known is None or not set(self.keys) <= set(known.columns):
            return zset.diff(rows(cx.old), rows(cx.new))
        return zset.diff(cx.with_keys(self, known, self.keys, change), rows(cx.new))


def aggregate(child: Node, keys: Sequence[str], *aggs: Column) -> Keyed:
    return Keyed(child, keys, lambda rows: rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs))


def window(child: Node, partition_by: Sequence[str], **columns: Column) -> Keyed:
    return Keyed(child, partition_by, lambda rows: rows.select("*", *[c.alias(n) for n, c in columns.items()]))


def top_k(child: Node, k: int, order: Sequence[Column], partition_by: Sequence[str]) -> Keyed:
    return Keyed(child, partition_by, lambda rows: batch.top_k(rows, k, order, partition_by))


def session(child: Node, keys: Sequence[str], ts: str, gap: str) -> Keyed:
    return Keyed(child, keys, lambda rows: batch.sessions(rows, keys, ts, gap))


@dataclass
class SumCount(Node):
    """SUM and COUNT by key with invertible partials: the change of a group's sums is the weighted sum of its change.

    Emits the old row of a touched group and the new one; the old sums come from the group's rows only.
    """

    child: Node
    keys: Sequence[str]
    value: str
    rule = "invertible group"

    def __post_init__(self):
        self.inputs = (self.child,)

    def _sums(self, z: DataFrame) -> DataFrame:
        known = F.when(F.col(self.value).isNotNull(), F.col(WEIGHT)).otherwise(0)
        return z.groupBy(*self.keys).agg(F.sum(F.coalesce(F.col(self.value) * F.col(WEIGHT), F.lit(0))).alias("_s"), F.sum(known).alias("_c"), F.sum(WEIGHT).alias("_n"))

    def _rows(self, sums: DataFrame) -> DataFrame:
        return zset.lift(sums.filter(F.col("_n") != 0).select(*self.keys, F.when(F.col("_c") != 0, F.col("_s")).alias("total"), F.col("_n").alias("n")))

    def state(self, sources):
        return self._rows(self._sums(self.child.state(sources)))

    def delta(self, cx):
        change = self._sums(self.child.delta(cx))
        before = self._sums(cx.with_keys(self, self.child.state(cx.old), self.keys, change))
        after = before.unionByName(change).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("_s", "_c", "_n")])
        return zset.diff(self._rows(before), self._rows(after))


@dataclass
class Matching(Node):
    """Outer, semi and anti joins: rows of the touched join keys before and after."""

    left: Node
    right: Node
    on: Sequence[tuple[str, str]]
    how: str  # left, right, full, left_semi, left_anti

    def __post_init__(self):
        self.inputs = (self.left, self.right)

    def batch(self, a, b):
        return a.join(b, reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in self.on]), self.how)

    def delta(self, cx):
        lk, rk = [x for x, _ in self.on], [y for _, y in self.on]
        touched = self.left.delta(cx).select(*lk).union(self.right.delta(cx).select(*[F.col(y) for y in rk])).distinct()
        theirs = touched.select(*[F.col(x).alias(y) for x, y in self.on])
        sides = []
        for sources in (cx.old, cx.new):
            a, b = cx.with_keys(self, self.left.state(sources), lk, touched), cx.with_keys(self, self.right.state(sources), rk, theirs)
            sides.append(zset.lift(self.batch(zset.expand(a), zset.expand(b))))
        return zset.diff(*sides)


@dataclass
class NullAwareAnti(Node):
    """NOT IN. A change of the right side may touch every left row, so both states are compared whole then."""

    left: Node
    right: Node
    left_key: str
    right_key: str

    def __post_init__(self):
        self.inputs = (self.left, self.right)

    def batch(self, a, b):
        return batch.null_aware_anti(a, b, self.left_key, self.right_key)

    def delta(self, cx):
        known = cx.known(self)
        return zset.diff(self.state(cx.old) if known is None else known, self.state(cx.new))


@dataclass
class SetOp(Node):
    """distinct, intersect, except: by the net weights of whole rows."""

    parts: Sequence[Node]
    kind: str
    all: bool = False

    def __post_init__(self):
        self.inputs = tuple(self.parts)

    def batch(self, *rows):
        a = rows[0]
        if self.kind == "distinct":
            return a.distinct()
        b = rows[1]
        if self.kind == "intersect":
            return a.intersectAll(b) if self.all else a.intersect(b)
        return a.exceptAll(b) if self.all else a.subtract(b)

    def delta(self, cx):
        keys = zset.columns(self.inputs[0].state(cx.old))
        touched = reduce(lambda x, y: x.union(y), [i.delta(cx).select(*keys) for i in self.inputs]).distinct()
        known = cx.known(self)

        def rows(sources: dict[str, DataFrame]) -> DataFrame:
            return zset.lift(self.batch(*[zset.expand(cx.with_keys(self, i.state(sources), keys, touched)) for i in self.inputs]))

        return zset.diff(rows(cx.old) if known is None else cx.with_keys(self, known, keys, touched), rows(cx.new))


@dataclass
class Recursion(Node):
    """base, then `step` of what is new until nothing is, as sets. Compared whole, as one retraction can undo any row."""

    base: Node
    step: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    reads: Sequence[str]
    checkpoint: Callable[[DataFrame], DataFrame]
    max_iterations: int = 100
    rule: str = field(default="recompute", repr=False)

    def __post_init__(self):
        self.inputs = (self.base, *[Source(n) for n in self.reads])

    def batch(self, base, *tables):
        named = dict(zip(self.reads, tables, strict=True))
        return batch.fixed_point(base, lambda new: self.step(new, named), self.checkpoint, self.max_iterations)

    def delta(self, cx):
        known = cx.known(self)
        return zset.diff(self.state(cx.old) if known is None else known, self.state(cx.new))
