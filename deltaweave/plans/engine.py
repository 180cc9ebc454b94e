"""Tables, views, epochs and their change logs.

A table's or view's state is a weighted Parquet table, its base, and the logs of the epochs since. A commit writes logs alone, so its
cost follows the change; when a state has gathered enough logs, they are folded into a new base. A commit names its epoch: the
change goes through the view graph level by level, every log is written to a folder of this attempt, and one append to `_meta`
publishes them all. Until then nothing is visible, here or to an engine that opens the same path later; a commit that breaks off
leaves only folders that nobody reads. A commit of an epoch that is already there does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaweave import zset
from deltaweave.plans.nodes import Context, Node, States
from deltaweave.zset import WEIGHT

PART, LEAST = 8, 1 << 20  # a change is large if its files have LEAST bytes and a PART-th of those of the state with it
FOLD = 8  # logs that a state gathers before they become part of its base
META = "seq long, epoch long, name string, kind string, path string"


class CycleError(ValueError):
    pass


class Engine:
    """What was committed under `path` is there again when an engine is opened on it and the same tables and views are declared."""

    def __init__(self, spark: SparkSession, path: str, retention: int | None = None):
        self.spark, self.path, self.retention = spark, path.rstrip("/"), retention
        self.schemas: dict[str, T.StructType] = {}
        self.views: dict[str, Node] = {}
        self.inline: dict[str, Node] = {}
        self.base: dict[str, tuple[int, str]] = {}  # the epoch up to which a base goes, and its folder
        self.logs: dict[str, list[tuple[int, str]]] = {}  # epochs and folders, those in the base too while they are kept
        self.folded: dict[str, int] = {}  # how many of these are in the base
        self.watermarks: dict[str, object] = {}
        self.epoch, self._seq = -1, 0
        self._recover()

    # -- files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _recover(self) -> None:
        at, fs = self._fs(f"{self.path}/_meta")
        if not fs.exists(at):
            return
        rows = self.spark.read.schema(META).parquet(f"{self.path}/_meta").orderBy("seq").collect()  # a few for each commit
        for r in rows:
            self._note(r["epoch"], r["name"], r["kind"], r["path"])
            self._seq = max(self._seq, r["seq"] + 1)

    def _note(self, epoch: int, name: str, kind: str, path: str) -> None:
        if kind == "log":
            self.logs.setdefault(name, []).append((epoch, path))
        elif kind == "base":
            self.base[name], self.folded[name] = (epoch, path), len(self.logs.setdefault(name, []))
        elif kind == "new":
            self.base[name], self.folded[name], self.logs[name] = (epoch, path), 0, []
        elif kind == "dropped":
            self.logs[name] = [x for x in self.logs[name] if x[1] != path]
            self.folded[name] -= 1
        elif kind == "epoch":
            self.epoch = epoch

    def _publish(self, entries: Sequence[tuple[int, str, str, str]]) -> None:
        """(epoch, name, kind, path) for all at once: one file appears, or none."""
        rows = [(self._seq + i, *e) for i, e in enumerate(entries)]
        self.spark.createDataFrame(rows, META).coalesce(1).write.mode("append").parquet(f"{self.path}/_meta")
        self._seq += len(rows)
        for e in entries:
            self._note(*e)

    def _write(self, df: DataFrame, name: str, kind: str, epoch: int) -> str:
        path = f"{self.path}/{name}/{kind}/epoch={epoch}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _stored(self, name: str, path: str) -> DataFrame:
        return self.spark.read.schema(self._weighted_schema(name)).parquet(path)

    def _large(self, name: str, path: str) -> bool:
        """Whether the change at `path` is a large part of a state."""

        def size(path: str) -> int:
            at, fs = self._fs(path)
            return fs.getContentSummary(at).getLength()

        change = size(path)
        return change >= LEAST and change * (PART - 1) >= sum(map(size, self._paths(name)))

    def _weighted_schema(self, name: str) -> T.StructType:
        return T.StructType([*self.schemas[name].fields, T.StructField(WEIGHT, T.LongType())])

    # -- definitions

    def create_table(self, name: str, schema: T.StructType | str) -> None:
        self.schemas[name] = self.spark.createDataFrame([], schema).schema
        self.logs.setdefault(name, [])

    def create_view(self, name: str, node: Node) -> None:
        """An inline view: read by expanding its definition, in other views as well."""
        self.inline[name] = node

    def create_materialized_view(self, name: str, node: Node, replace: bool = False) -> None:
        """A maintained view, filled from the present states; from the next epoch on it follows the changes. One that was published under this path before goes on from there."""
        if name in self.schemas and not (replace and name in self.views):
            raise ValueError(f"{name} exists")
        before = self.views.get(name)
        self.views[name] = node
        try:
            self.order()
        except CycleError:
            self.views.pop(name)
            if before is not None:
                self.views[name] = before
            raise
        state = node.state(self._states())
        self.schemas[name] = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema if f.name != WEIGHT])
        if name in self.base and not replace:
            return
        # a global aggregate has a row even before the first epoch
        path = self._write(zset.consolidate(state), name, "state", self.epoch)
        self._publish([(self.epoch, name, "new", path)])

    def refresh(self, name: str) -> None:
        """Compute a maintained view anew. Where that differs from what is kept, the difference is logged and goes on to the views that read it."""
        change = zset.diff(self._present(name), self.views[name].state(self._states()))
        path = self._write(change, name, "log", self.epoch)
        if not self._stored(name, path).isEmpty():
            self._run(self.epoch, {name: path})

    def _reads(self, node: Node) -> set[str]:
        """The tables and maintained views that a node reads, through inline views as well."""
        found, open_ = set(), list(node.sources())
        while open_:
            name = open_.pop()
            if name in self.inline:
                open_ += self.inline[name].sources()
            else:
                found.add(name)
        return found

    def levels(self) -> list[list[str]]:
        """Views in levels: each comes after those it reads, and those of one level don't read each other."""
        left = {n: self._reads(v) & self.views.keys() for n, v in self.views.items()}
        out: list[list[str]] = []
        while left:
            ready = sorted(n for n, needs in left.items() if not needs & left.keys())
            if not ready:
                raise CycleError(f"views read each other: {sorted(left)}")
            out.append(ready)
            for n in ready:
                del left[n]
        return out

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    # -- states

    def _paths(self, name: str) -> list[str]:
        return [*([self.base[name][1]] if name in self.base else []), *[p for _, p in self.logs[name][self.folded.get(name, 0) :]]]

    def _present(self, name: str, more: Sequence[str] = ()) -> DataFrame:
        """The state as base and logs, not yet added up."""
        paths = [*self._paths(name), *more]
        if not paths:
            return self.spark.createDataFrame([], self._weighted_schema(name))
        return reduce(lambda a, b: a.unionByName(b), [self._stored(name, p) for p in paths])

    def _states(self, more: Mapping[str, str] | None = None) -> States:
        more = more or {}
        return States({n: self._present(n, [more[n]] if n in more else []) for n in self.schemas}, self.inline)

    def weighted(self, name: str) -> DataFrame:
        return zset.consolidate(self._present(name))

    def read(self, name: str) -> DataFrame:
        """A table's or view's rows as of the last epoch."""
        return zset.expand(self.inline[name].state(self._states()) if name in self.inline else self._present(name))

    # -- commits

    def commit(self, epoch: int, changes: Mapping[str, DataFrame]) -> bool:
        """Apply weighted changes of tables and bring all views to `epoch`. False if the epoch was committed before."""
        if epoch <= self.epoch:
            return False
        given = {}
        for name, change in changes.items():
            given[name] = self._write(zset.consolidate(change.select(*self.schemas[name].names, WEIGHT)), name, "log", epoch)
            self._check(name, self._stored(name, given[name]), self._large(name, given[name]))
        self._run(epoch, given)
        return True

    def _check(self, name: str, change: DataFrame, large: bool) -> None:
        """An error if the change retracts more of a row than there is."""
        gone = change.filter(F.col(WEIGHT) < 0)
        if gone.isEmpty():
            return
        met = self._present(name) if large else zset.rows_with_keys(self._present(name), self.schemas[name].names, gone)
        if not zset.consolidate(met.unionByName(gone)).filter(F.col(WEIGHT) < 0).isEmpty():
            raise ValueError(f"invalid multiplicity in {name}: more rows were retracted than exist")

    def _run(self, epoch: int, given: Mapping[str, str]) -> None:
        written = dict(given)
        old = self._states()
        for level in self.levels():
            large = frozenset(n for n, p in written.items() if self._large(n, p))
            cx = Context(old, {n: self._stored(n, p) for n, p in written.items()}, self._states(written), self.inline, large)
            due = [n for n in level if n not in given and self._reads(self.views[n]) & written.keys()]

            def advance(name: str, cx: Context = cx) -> str:
                node = self.views[name]
                return self._write(zset.consolidate(node.delta(replace(cx, own=(node, old[name])))), name, "log", epoch)

            with ThreadPoolExecutor(max(1, min(8, len(due)))) as pool:
                written |= dict(zip(due, pool.map(advance, due), strict=True))
        self._publish([*[(epoch, n, "log", p) for n, p in written.items()], (epoch, "", "epoch", "")])
        self._fold(written)

    def _fold(self, names) -> None:
        """Fold logs into new bases where there are enough, and drop what is no longer kept."""
        limit = min(FOLD, self.retention or FOLD)
        entries, gone = [], []
        for name in names:
            if len(self.logs[name]) - self.folded.get(name, 0) > limit:
                if name in self.base:
                    gone.append(self.base[name][1])
                entries.append((self.epoch, name, "base", self._write(zset.consolidate(self._present(name)), name, "state", self.epoch)))
        if entries:
            self._publish(entries)
        if self.retention:
            old = [(e, n, p) for n in names for e, p in self.logs[n][: self.folded.get(n, 0)] if len(self.logs[n]) > self.retention and (e, p) in self.logs[n][: -self.retention]]
            if old:
                self._publish([(e, n, "dropped", p) for e, n, p in old])
                gone += [p for _, _, p in old]
        for path in gone:
            at, fs = self._fs(path)
            fs.delete(at, True)

    def subscribe(self, name: str, from_epoch: int | None = None, where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """(epoch, columns, _weight): the changes after `from_epoch`; without one, the present state as a snapshot of this epoch."""
        if from_epoch is None:
            out = self.weighted(name).withColumn("epoch", F.lit(self.epoch).cast("long"))
        else:
            logs = self.logs[name]
            if self.retention and len(logs) >= self.retention and from_epoch < logs[-self.retention :][0][0] - 1:
                raise ValueError(f"changes of {name} since epoch {from_epoch} are no longer kept")
            parts = [self._stored(name, p).withColumn("epoch", F.lit(e).cast("long")) for e, p in logs if e > from_epoch]
            out = zset.merge(*parts) if parts else self.spark.createDataFrame([], self._weighted_schema(name)).withColumn("epoch", F.lit(0).cast("long"))
        if where is not None:
            out = out.filter(where)
        return out.select("epoch", *(columns or self.schemas[name].names), WEIGHT)

    def stream(self, table: str, rows: DataFrame, folder: str, ts: str | None = None, delay: str | None = None, **options: str):
        """Start a streaming query whose micro-batches are commits that insert into `table`. Its id of a batch is the epoch, so a batch that is run again changes nothing.

        With `ts`, rows later than `delay` behind the latest time of earlier batches are left out, and the mark stays as it was when the batch began.
        """
        if ts is not None:
            rows = rows.withWatermark(ts, delay or "0 seconds")

        def put(batch: DataFrame, epoch: int) -> None:
            kept = batch
            if ts is not None:
                mark = self.watermarks.get(table)
                if mark is not None:
                    kept = batch.filter(F.col(ts) >= F.lit(mark) - F.expr(f"INTERVAL {delay or '0 seconds'}"))
                latest = batch.agg(F.max(ts)).first()[0]
                if latest is not None and (mark is None or latest > mark):
                    self.watermarks[table] = latest
            self.commit(epoch, {table: zset.lift(kept.select(*self.schemas[table].names))})

        return rows.writeStream.foreachBatch(put).option("checkpointLocation", folder).options(**options).trigger(availableNow=True).start()

    def explain_incremental(self, name: str) -> str:
        return self.views[name].explain()


def delete(state: DataFrame, where: Column) -> DataFrame:
    """The change that deletes the rows of a weighted state for which the condition is true."""
    return zset.negate(state.filter(where))


def update(state: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Old rows out, new rows in."""
    hit = state.filter(where)
    return zset.merge(zset.negate(hit), hit.withColumns(values))
