"""A table of unique ids that many small batches add to, in the shared folder.

Rows lie in segments, which never change. A commit is a numbered marker file that
lists the segments that count; it appears by one rename, so a reader sees the table
before or after a commit and never half of it. What a crash leaves behind is listed
in no marker.

A batch adds one segment of level 0. When FAN segments of a level are there,
they are merged into one of the next level, so a row is written again only about
log(batches) / log(FAN) times and there are never many segments. Segments from level 1 on are
partitioned by buckets of the id's hash, more of them the higher the level: a
batch looks its ids up in the buckets they fall into.

Markers also hold the last batch of each stream, so that a batch that comes again
changes nothing, and running sums over all rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 8
MOST_BUCKETS = 4096
#: Markers that stay; readers of an older one may lose their files.
KEPT = 4
STREAM, BATCH, BUCKET = "stream", "batch_id", "_bucket"


class Segment(NamedTuple):
    path: str
    level: int
    buckets: int
    rows: int


class Snapshot(NamedTuple):
    """What a marker says; version -1 is an empty table without a marker."""

    version: int
    segments: tuple[Segment, ...]
    streams: Mapping[str, int]
    totals: Mapping[str, float]


EMPTY = Snapshot(-1, (), {}, {})


class Folder:
    """The few file operations that a commit needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        folder = self.path(name)
        if not self.files.exists(folder):
            return []
        return [status.getPath().getName() for status in self.files.listStatus(folder)]

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a new file that is there whole or not at all; False if the name is taken."""
        hidden = self.path(f".{uuid.uuid4().hex}.tmp")
        stream = self.files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.path(name)
        self.files.mkdirs(target.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            qualified = [self.files.makeQualified(p) for p in (hidden, target)]
            context.rename(*qualified, options)
        except Py4JJavaError as error:
            self.files.delete(hidden, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def _marker(version: int) -> str:
    return f"_commits/{version:020d}.json"


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n[:-5]) for n in folder.names("_commits") if n.endswith(".json") and not n.startswith("."))


def _load(folder: Folder, version: int) -> Snapshot:
    found = json.loads(folder.read(_marker(version)))
    return Snapshot(version, tuple(Segment(*s) for s in found["segments"]), found["streams"], found["totals"])


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    folder = Folder(spark, root)
    versions = _versions(folder)
    return _load(folder, versions[-1]) if versions else EMPTY


def _commit(folder: Folder, now: Snapshot) -> bool:
    text = json.dumps({"segments": now.segments, "streams": dict(now.streams), "totals": dict(now.totals)})
    return folder.publish(_marker(now.version), text)


def _full(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType())])


def _rows(spark: SparkSession, root: str, segment: Segment, schema: T.StructType) -> DataFrame:
    full = _full(schema)
    if segment.buckets:
        full = full.add(BUCKET, T.IntegerType())
    return spark.read.schema(full).parquet(f"{root}/{segment.path}")


def read(spark: SparkSession, root: str, schema: T.StructType, seen: Snapshot | None = None) -> DataFrame:
    """All rows with the stream and batch that brought them."""
    seen = snapshot(spark, root) if seen is None else seen
    names = _full(schema).fieldNames()
    parts = [_rows(spark, root, s, schema).select(*names) for s in seen.segments]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], _full(schema))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def known_ids(ids: DataFrame, root: str, schema: T.StructType, key: str, seen: Snapshot) -> DataFrame | None:
    """Ids of the table that may be among `ids`: of large segments only the buckets that `ids` fall into."""
    spark = ids.sparkSession
    parts = []
    touched: dict[int, list[int]] = {}
    for segment in seen.segments:
        rows = _rows(spark, root, segment, schema)
        if segment.buckets:
            if segment.buckets not in touched:
                # At most MOST_BUCKETS numbers.
                found = ids.select(_bucket(key, segment.buckets).alias("b")).distinct().collect()
                touched[segment.buckets] = sorted(r["b"] for r in found)
            rows = rows.where(F.col(BUCKET).isin(touched[segment.buckets]))
        parts.append(rows.select(key))
    return reduce(DataFrame.unionAll, parts) if parts else None


def _store(folder: Folder, rows: DataFrame, level: int) -> Segment:
    path = f"data/{level}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.root}/{path}")
    return Segment(path, level, 0, rows.sparkSession.read.parquet(f"{folder.root}/{path}").count())


def add(
    rows: DataFrame,
    root: str,
    schema: T.StructType,
    key: str,
    stream: str,
    batch_id: int,
    sums: Mapping[str, Column] | None = None,
) -> bool:
    """Add the rows whose ids are new (`rows` has one per id); False if the batch is in already.

    `sums` names running sums over the added rows. If another stream commits at the
    same time, the ids are looked up again.
    """
    spark = rows.sparkSession
    folder = Folder(spark, root)
    while True:
        seen = snapshot(spark, root)
        if seen.streams.get(stream, -1) >= batch_id:
            return False
        known = known_ids(rows, root, schema, key, seen)
        fresh = rows if known is None else rows.join(known, key, "left_anti")
        named = fresh.select(*schema.fieldNames(), F.lit(stream).alias(STREAM), F.lit(batch_id).cast("long").alias(BATCH))
        segment = _store(folder, named, 0)
        measures = {**(sums or {}), "rows": F.lit(1)}
        added = (
            _rows(spark, root, segment, schema)
            .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in measures.items()])
            .first()
            .asDict()
        )
        totals = {n: seen.totals.get(n, 0) + added[n] for n in measures}
        segments = (*seen.segments, segment) if segment.rows else seen.segments
        later = Snapshot(seen.version + 1, segments, {**seen.streams, stream: batch_id}, totals)
        if _commit(folder, later):
            if not segment.rows:
                folder.remove(segment.path)
            break
        folder.remove(segment.path)
    while compact(spark, root, schema, key):
        pass
    tidy(spark, root)
    return True


def compact(spark: SparkSession, root: str, schema: T.StructType, key: str) -> bool:
    """Merge FAN segments of a level into one of the next; False if no level has as many."""
    folder = Folder(spark, root)
    seen = snapshot(spark, root)
    for level in sorted({s.level for s in seen.segments}):
        old = [s for s in seen.segments if s.level == level][:FAN]
        if len(old) < FAN:
            continue
        buckets = min(FAN ** (level + 1), MOST_BUCKETS)
        rows = read(spark, root, schema, seen._replace(segments=tuple(old))).withColumn(BUCKET, _bucket(key, buckets))
        path = f"data/{level + 1}-{uuid.uuid4().hex}"
        # One file per bucket, except where AQE parts a large one.
        rows.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{root}/{path}")
        merged = Segment(path, level + 1, buckets, sum(s.rows for s in old))
        while True:
            now = snapshot(spark, root)
            if not set(old) <= set(now.segments):
                folder.remove(path)
                return True
            kept = tuple(s for s in now.segments if s not in old)
            if _commit(folder, now._replace(version=now.version + 1, segments=(merged, *kept))):
                return True
    return False


def tidy(spark: SparkSession, root: str) -> None:
    """Remove markers but the last KEPT ones, and the segments that only the removed ones list."""
    folder = Folder(spark, root)
    versions = _versions(folder)
    if len(versions) <= KEPT:
        return
    live = {s.path for v in versions[-KEPT:] for s in _load(folder, v).segments}
    for version in versions[:-KEPT]:
        for segment in _load(folder, version).segments:
            if segment.path not in live:
                folder.remove(segment.path)
        folder.remove(_marker(version))
