"""One commit for everything that a micro-batch writes.

A job owns a folder with several tables. A micro-batch writes its rows of each
table into fresh folders (segments), which nobody reads yet, and then creates one
small file, the manifest, by renaming it into place: it names all segments of all
tables and the job's own state. So the rows of a batch appear in all tables at
once or in none, a batch that runs again after its commit does nothing, and what a
killed attempt left behind is deleted by the next one.

Segments are merged by levels: `FAN_IN` segments of a level become one of the next.
So a table of any age has few segments, a manifest stays small, and a row is
rewritten a logarithmic number of times. A table may be indexed by a column of
whole numbers: the manifest then keeps that column's range for each file, and
readers open the files of a range only, without listing folders. Merged folders are
deleted one commit later, for readers of the manifest before.

One job writes to a folder at a time (Spark allows one run per checkpoint). The
folder must be on a file system with atomic renames, shared by all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN_IN = 8
LOG = "_commits"
KEPT_MANIFESTS = 3


@dataclass(frozen=True)
class Layout:
    """How a table's segments are written."""

    by: tuple[str, ...] = ()  # partition folders
    order: tuple[str, ...] = ()  # sort order inside files
    index: str | None = None  # column whose range is kept per file
    options: dict[str, str] = field(default_factory=dict)


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files, where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(where))


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


class Commits:
    """Tables of one job below `path`."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Layout] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.layouts = tables or {}
        self.manifest = self._last()

    # --- manifests ---------------------------------------------------------------

    def _last(self) -> dict:
        names = [n for n in _names(self.spark, f"{self.path}/{LOG}") if n.endswith(".json")]
        if not names:
            return {"batch": -1, "state": {}, "tables": {}, "schemas": {}}
        files, where = _folder(self.spark, f"{self.path}/{LOG}/{names[-1]}")
        stream = files.open(where)
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
        finally:
            stream.close()
        return json.loads(bytes(raw).decode())

    def _publish(self, manifest: dict) -> None:
        """The commit: after the rename the batch is there, before it is not."""
        name = f"{self.path}/{LOG}/{manifest['batch']:012d}.json"
        files, draft = _folder(self.spark, f"{self.path}/{LOG}/.{uuid.uuid4().hex}")
        stream = files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if not files.rename(draft, _folder(self.spark, name)[1]):
            raise RuntimeError(f"{name} is there already: two jobs write to {self.path}")

    @property
    def state(self) -> dict:
        return self.manifest["state"]

    def segments(self, table: str) -> list[dict]:
        return self.manifest["tables"].get(table, [])

    # --- reading -----------------------------------------------------------------

    def read(
        self,
        table: str,
        schema: StructType | None = None,
        above: int | None = None,
        upto: int | None = None,
        segments: list[dict] | None = None,
        points: list[int] | None = None,
    ) -> DataFrame:
        """Committed rows. With an index, `above` < index <= `upto` and `points` (single
        values) prune by file; other rows may still be among them.

        The schema is the stored one, so an empty table has its columns; `schema`
        serves a table that no batch has written to.
        """
        known = self.manifest["schemas"].get(table)
        if segments is None and known:
            schema = StructType.fromJson(known)
        schema = schema or StructType()
        paths = []
        for segment in self.segments(table) if segments is None else segments:
            if segment["files"] is None:
                paths.append(f"{self.path}/{segment['path']}")
                continue
            paths += [
                f"{self.path}/{segment['path']}/{name}"
                for name, low, high in segment["files"]
                if (above is None or high > above) and (upto is None or low <= upto)
                and (points is None or any(low <= p <= high for p in points))
            ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # below the base path, segments are partitions like the table's own
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*paths).select(*schema.names)

    # --- writing -----------------------------------------------------------------

    def batch(self, batch_id: int) -> Batch | None:
        """The writer of a micro-batch; nothing if it is committed already."""
        if batch_id <= self.manifest["batch"]:
            return None
        return Batch(self, batch_id)


class Batch:
    """What one micro-batch adds; visible after `commit`."""

    def __init__(self, commits: Commits, batch_id: int):
        self.commits, self.id = commits, batch_id
        last = commits.manifest
        self.state = dict(last["state"])
        self.schemas = dict(last["schemas"])
        self.tables = {name: list(segments) for name, segments in last["tables"].items()}
        self._clean_up()

    def _clean_up(self) -> None:
        """Delete what the last commit replaced and what dead attempts left behind."""
        spark, path = self.commits.spark, self.commits.path
        alive = {s["path"] for segments in self.tables.values() for s in segments}
        for table in {*self.commits.layouts, *self.tables}:
            for name in _names(spark, f"{path}/{table}"):
                if f"{table}/{name}" not in alive:
                    _delete(spark, f"{path}/{table}/{name}")
        for name in _names(spark, f"{path}/{LOG}")[:-KEPT_MANIFESTS]:
            _delete(spark, f"{path}/{LOG}/{name}")

    def append(self, table: str, rows: DataFrame, level: int = 0) -> dict | None:
        """Write rows of a table; returns their segment. No rows leave no folder."""
        layout = self.commits.layouts[table]
        spark, path = self.commits.spark, f"{table}/segment={self.id:012d}-{uuid.uuid4().hex[:12]}"
        whole = f"{self.commits.path}/{path}"
        if layout.index:
            # ranges of the index, so that a file covers little of it; the order
            # splits a value that many rows share
            ranges = (layout.index, *layout.order)
            laid_out = rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
        else:
            laid_out = rows.hint("rebalance", *layout.by)
            if layout.order:
                laid_out = laid_out.sortWithinPartitions(*layout.by, *layout.order)
        writer = laid_out.write.options(**layout.options)
        (writer.partitionBy(*layout.by) if layout.by else writer).parquet(whole)
        # partition columns come last when the segments are read
        fields = {f.name: f for f in rows.schema.fields}
        names = [n for n in fields if n not in layout.by] + list(layout.by)
        schema = StructType([fields[n] for n in names])
        self.schemas[table] = schema.jsonValue()
        # from the files' footers and one column
        stored = spark.read.schema(schema).parquet(whole)
        files, n = None, 0
        if layout.index:
            name = F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name")
            range_of = [f(layout.index) for f in (F.min, F.max)]
            found = stored.groupBy(name).agg(*range_of, F.count("*")).collect()
            files, n = [tuple(r)[:3] for r in found], sum(r[3] for r in found)
        else:
            n = stored.count()
        if not n:
            _delete(spark, whole)
            return None
        segment = {"path": path, "level": level, "rows": n, "files": files}
        self.tables.setdefault(table, []).append(segment)
        return segment

    def replace(self, table: str, rows: DataFrame) -> None:
        """Make these the table's only rows; they may be computed from the old ones."""
        segment = self.append(table, rows)
        self.tables[table] = [segment] if segment else []

    def written(self, table: str, segment: dict | None) -> DataFrame:
        """Rows that this batch has just appended."""
        schema = StructType.fromJson(self.schemas[table])
        return self.commits.read(table, schema, segments=[segment] if segment else [])

    def drop(self, table: str, upto: int) -> None:
        """Forget files of an indexed table that hold nothing above `upto`."""
        kept = []
        for segment in self.tables.get(table, []):
            files = [f for f in segment["files"] if f[2] > upto]
            if files:
                kept.append({**segment, "files": files})
        self.tables[table] = kept

    def merge(self, table: str, keep: Column | None = None) -> None:
        """Merge levels that have `FAN_IN` segments; rows without `keep` are left out."""
        while True:
            levels: dict[int, list[dict]] = {}
            for segment in self.tables.get(table, []):
                levels.setdefault(segment["level"], []).append(segment)
            full = [k for k, segments in levels.items() if len(segments) >= FAN_IN]
            if not full:
                return
            level = min(full)
            merged = [s["path"] for s in levels[level]]
            own = StructType.fromJson(self.schemas[table])
            rows = self.commits.read(table, own, segments=levels[level])
            self.tables[table] = [s for s in self.tables[table] if s["path"] not in merged]
            self.append(table, rows.where(keep) if keep is not None else rows, level + 1)

    def commit(self) -> None:
        manifest = {
            "batch": self.id,
            "state": self.state,
            "schemas": self.schemas,
            "tables": self.tables,
        }
        self.commits._publish(manifest)
        self.commits.manifest = manifest


def in_one_commit(
    path: str, tables: dict[str, Layout], step: Callable[[DataFrame, Batch], None]
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: `step` writes through the batch, then all is committed."""

    def run(rows: DataFrame, batch_id: int) -> None:
        batch = Commits(rows.sparkSession, path, tables).batch(batch_id)
        if batch is None:
            return
        step(rows, batch)
        for name, layout in tables.items():
            if not layout.index:
                batch.merge(name)
        batch.commit()

    return run


def stored(
    spark: SparkSession, path: str, table: str, schema: StructType | None = None
) -> DataFrame:
    """Committed rows of a job's table, merged or not."""
    return Commits(spark, path).read(table, schema)
