"""The latest state of rows by key, kept as a bucketed base table and the changes since: updating it does not read the whole log.

A folder holds tables and manifests. A manifest names the base, the changes that are not merged into it yet, and the last batch
that is. Changes are written first and count from the moment in which the next manifest, a file of its own, is renamed into place;
so a reader sees whole batches, and a batch that is replayed changes nothing. Each column keeps the order of the update that set
it, so updates may come in any order, and an update that leaves a column null leaves it as it is.

The base is bucketed and sorted by key. Changes are joined to it bucket by bucket: the base is not shuffled, neither by a read nor
by a merge, and files of small changes vanish with every merge.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


@dataclass
class Snapshot:
    """The state of rows with `keys` in a folder. The fields `order` of a row say which of two updates is the later one; none of keys and order may be null."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict]:
        """The number and content of the newest manifest; 0 and an empty state where there is none."""
        fs, at = self._files(), self._path("manifest")
        numbers = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")] if fs.exists(at) else []
        if not numbers:
            return 0, {"base": None, "buckets": self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "through": -1, "changes": {}}
        row = self.spark.read.text(f"{self.folder}/manifest/{max(numbers):010d}.json", wholetext=True).first()
        return max(numbers), json.loads(row["value"])

    def _commit(self, edit: Callable[[dict], dict | None]) -> None:
        """Put edit(state) in place as the next manifest; where another writer was first, edit what it has written."""
        while True:
            number, state = self.manifest()
            state = edit(state)
            if state is None:
                return
            fs, aside, to = self._files(), self._path(f"aside-{uuid.uuid4().hex}"), self._path(f"manifest/{number + 1:010d}.json")
            fs.mkdirs(to.getParent())
            out = fs.create(aside, False)
            out.write(json.dumps(state).encode())
            out.close()
            jvm = self.spark._jvm
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
            try:  # fails if the file is there
                files.rename(aside, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
                return
            except Exception as e:
                fs.delete(aside, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    def _folded(self, rows: DataFrame) -> DataFrame:
        """For each key and column the last value that is not null, with its order: combined before the shuffle."""
        at = F.struct(*self.order)
        values = [c for c in rows.columns if c not in (*self.keys, *self.order)]
        return rows.groupBy(*self.keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(c) for c in values])

    def _base(self, path: str, buckets: int, like: DataFrame | None = None) -> DataFrame:
        """The bucketed table at a path; with `like`, its rows are written there first."""
        name = "snapshot_" + hashlib.md5(path.encode()).hexdigest()
        if like is not None:
            like.write.format("parquet").bucketBy(buckets, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(name)
        elif not self.spark.catalog.tableExists(name):  # a session that has not written it
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _state(self, state: dict) -> DataFrame | None:
        """Base and changes as one row for each key."""
        paths = list(state["changes"].values())
        new = None
        if paths:
            # dealt into the buckets of the base, so that neither the join nor a first base needs another shuffle
            rows = self.spark.read.option("mergeSchema", "true").parquet(*paths).repartition(state["buckets"], *self.keys)
            new = rows.groupBy(*self.keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in self.keys])
        if not state["base"]:
            return new
        base = self._base(state["base"], state["buckets"])
        if new is None:
            return base
        old, new = base.alias("old"), new.alias("new")
        both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in self.keys], "full_outer")

        def merged(c: str):
            have = [F.col(f"{side}.{c}") for side, rows in (("old", old), ("new", new)) if c in rows.columns]
            return (F.greatest(*have) if len(have) > 1 else have[0]).alias(c)

        columns = list(dict.fromkeys([*old.columns, *new.columns]))
        return both.select(*[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in self.keys], *[merged(c) for c in columns if c not in self.keys])

    def update(self, rows: DataFrame, batch: int) -> None:
        """Add a batch of updates (keys, order and any of the columns). Batches come with rising numbers; one that was added before is left out."""
        known = lambda s: batch <= s["through"] or str(batch) in s["changes"]
        if known(self.manifest()[1]):
            return
        path = f"{self.folder}/change-{batch}-{uuid.uuid4().hex}"
        self._folded(rows).write.parquet(path)
        self._commit(lambda s: None if known(s) else s | {"changes": s["changes"] | {str(batch): path}})

    def compact(self) -> None:
        """Merge the changes into a new base, bucket by bucket. What was replaced stays for its readers until vacuum()."""
        _, state = self.manifest()
        if not state["changes"]:
            return
        path = f"{self.folder}/base-{uuid.uuid4().hex}"
        self._base(path, state["buckets"], self._state(state))

        def edit(now: dict) -> dict:
            if now["base"] != state["base"]:
                raise RuntimeError("another writer has merged the changes")
            left = {b: p for b, p in now["changes"].items() if b not in state["changes"]}
            return now | {"base": path, "through": max(now["through"], *map(int, state["changes"])), "changes": left}

        self._commit(edit)

    def read(self) -> DataFrame:
        """The latest state, one row for each key; an error where nothing was ever added."""
        rows = self._state(self.manifest()[1])
        if rows is None:
            raise ValueError(f"no state in {self.folder}")
        return rows.select(*self.keys, *[F.col(f"{c}.v").alias(c) for c in rows.columns if c not in self.keys])

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name. Only while nobody else reads or writes."""
        number, state = self.manifest()
        live = {p.rsplit("/", 1)[-1] for p in (state["base"], *state["changes"].values()) if p}
        fs = self._files()
        for f in fs.listStatus(self._path("")):
            name = f.getPath().getName()
            if name.startswith(("base-", "change-", "aside-")) and name not in live:
                shared.remove(self.spark, f"{self.folder}/{name}")
        for f in fs.listStatus(self._path("manifest")):
            if f.getPath().getName() != f"{number:010d}.json":
                fs.delete(f.getPath(), False)


def keep(messages: DataFrame, rows: Callable[[DataFrame], DataFrame], state: Snapshot, checkpoint: str, every: int = 20, once: bool = True):
    """Start a stream that keeps a snapshot of rows(messages): each micro-batch is one update, every so many are merged into the base."""

    def write(batch: DataFrame, number: int) -> None:
        state.update(rows(batch), number)
        if number % every == every - 1:
            state.compact()

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
