"""Stored tables: keyed ones with commits, and ones by day with pruned scans and retention.

A keyed table is Parquet folders, each with a folder for every hash bucket of the key, and manifests that say which folder's
buckets are the table. A commit writes a folder and then the next manifest, which appears at once or, if another writer was
faster, not at all; then the commit is tried on top of that one. Files are never changed, so a reader keeps the state it began
with, and reads only the buckets it needs. Compaction replaces a bucket's folders by one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sentrylake.operators.tables import last_of

ATTEMPTS = 20


class Conflict(RuntimeError):
    """What a commit wanted to replace has been replaced by another one."""


class Files:
    """The file system that a path is on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none where it isn't there."""
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Puts a whole file at p, unless there is one: then False."""
        part = f"{p}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self.conf)
        rename = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.getClass(), 1)
        options[0] = rename
        try:
            context.rename(context.makeQualified(self.path(part)), context.makeQualified(self.path(p)), options)
        except Py4JJavaError as e:
            self.fs.delete(self.path(part), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


@dataclass
class Folder:
    name: str
    seq: int
    buckets: list[int]
    batch: int | None = None


@dataclass
class Manifest:
    version: int
    folders: list[Folder] = field(default_factory=list)


@dataclass
class KeyedTable:
    """Rows by key; of equal keys the last committed counts, within a commit the last by ``order``.

    ``merge`` puts the rows of a key together in another way: it gets a DataFrame with the column _seq (the commit) and gives one
    row for each key. It must give the same whether rows are merged at once or bit by bit.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    schema: StructType | str
    buckets: int = 64
    order: tuple[str, ...] = ()
    merge: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        given = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in given])

    def _files(self) -> Files:
        return Files(self.spark, self.path)

    def manifest(self) -> Manifest:
        """The newest one; an empty one where nothing was committed."""
        files = self._files()
        found = [n for n in files.names(f"{self.path}/manifests") if n.endswith(".json")]
        if not found:
            return Manifest(0)
        read = json.loads(files.read(f"{self.path}/manifests/{found[-1]}"))
        return Manifest(read["version"], [Folder(**f) for f in read["folders"]])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> Folder | None:
        """Writes a folder of rows with _seq; None where there are none. A bucket's rows lie sorted by key, with Bloom filters."""
        name = uuid.uuid4().hex
        out = rows.withColumn("_bucket", self.bucket()).repartition("_bucket").sortWithinPartitions("_bucket", *self.keys).write
        for k in self.keys:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        held = [int(n.removeprefix("_bucket=")) for n in self._files().names(f"{self.path}/data/{name}") if n.startswith("_bucket=")]
        return Folder(name, 0, sorted(held)) if held else None

    def _commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        for _ in range(ATTEMPTS):
            new = change(self.manifest())
            if self._files().create(f"{self.path}/manifests/{new.version:012}.json", json.dumps(asdict(new))):
                return new
        raise Conflict(f"{ATTEMPTS} commits to {self.path} were overtaken")

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Commits rows and returns the version. A batch that was committed before is replaced, so it can be tried again."""
        folder = self._write(rows.select(*self.schema.names))

        def change(m: Manifest) -> Manifest:
            old = [f for f in m.folders if batch is not None and f.batch == batch]
            kept = [f for f in m.folders if f not in old]
            added = [] if folder is None else [Folder(folder.name, min([m.version + 1, *(f.seq for f in old)]), folder.buckets, batch)]
            return Manifest(m.version + 1, [*kept, *added])

        return self._commit(change).version

    def _rows(self, m: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of those buckets, with _seq, not merged yet."""
        wanted = None if buckets is None else set(buckets)
        paths = [(f, b) for f in m.folders for b in f.buckets if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0).cast("long"))
        seq = F.create_map(*[F.lit(x) for f in {f.name: f for f, _ in paths}.values() for x in (f.name, f.seq)])
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f.name}/_bucket={b}" for f, b in paths])
        return rows.withColumn("_seq", seq[F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)].cast("long"))

    def _merged(self, rows: DataFrame) -> DataFrame:
        out = self.merge(rows) if self.merge else last_of(rows, self.keys, ["_seq", *self.order])
        return out.select(*self.schema.names)

    def read(self, buckets: Iterable[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The table, or some buckets of it, as of the newest or another manifest."""
        return self._merged(self._rows(manifest or self.manifest(), buckets))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())  # as many as there are buckets at most

    def lookup(self, values: list) -> DataFrame:
        """The rows of some keys (values, or tuples where the key has several columns); other buckets aren't read."""
        m = self.manifest()
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        asked = self.spark.createDataFrame(rows, StructType([self.schema[k] for k in self.keys]))
        found = self._rows(m, self.buckets_of(asked))
        for i, k in enumerate(self.keys):
            found = found.where(F.col(k).isin([r[i] for r in rows]))
        return self._merged(found).join(F.broadcast(asked.distinct()), self.keys, "left_semi")

    def compact(self, most: int = 1) -> int:
        """Puts the buckets that lie in more than ``most`` folders together; returns how many these are."""
        m = self.manifest()
        held: dict[int, int] = {}
        for f in m.folders:
            for b in f.buckets:
                held[b] = held.get(b, 0) + 1
        full = sorted(b for b, n in held.items() if n > most)
        if not full:
            return 0
        folder = self._write(self.read(full, m))
        taken = {(f.name, b) for f in m.folders for b in f.buckets if b in full}
        newest = max(f.seq for f in m.folders if set(f.buckets) & set(full))

        def change(now: Manifest) -> Manifest:
            if not taken <= {(f.name, b) for f in now.folders for b in f.buckets}:
                raise Conflict("buckets that were to be put together have been replaced")
            rest = [Folder(f.name, f.seq, [b for b in f.buckets if (f.name, b) not in taken], f.batch) for f in now.folders]
            return Manifest(now.version + 1, [*[f for f in rest if f.buckets], *([Folder(folder.name, newest, folder.buckets)] if folder else [])])

        self._commit(change)
        return len(full)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Deletes manifests but the last ``keep``, and folders that none of these names; no write may be under way. Returns the folders."""
        files = self._files()
        found = [n for n in files.names(f"{self.path}/manifests") if n.endswith(".json")]
        kept = found[-keep:]
        named = {f["name"] for n in kept for f in json.loads(files.read(f"{self.path}/manifests/{n}"))["folders"]}
        gone = [n for n in files.names(f"{self.path}/data") if n not in named]
        for n in gone:
            files.delete(f"{self.path}/data/{n}")
        for n in found[:-keep]:
            files.delete(f"{self.path}/manifests/{n}")
        return gone


# --- tables by day


def store_days(rows: DataFrame, path: str, ts_us: str = "ts_us", key: str = "event_id", column: str = "day") -> None:
    """Stores rows by day. The days that rows have replace what was stored of them; other days stay."""
    out = rows.withColumn(column, F.coalesce(F.to_date(F.timestamp_micros(ts_us)).cast("string"), F.lit("none")))
    writer = out.repartition(column, F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions(column, key).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(column).parquet(path)


def scan_days(spark: SparkSession, path: str, first: str, last: str, column: str = "day") -> DataFrame:
    """Rows of the days first to last (yyyy-mm-dd); other days' folders aren't read."""
    return spark.read.option("basePath", path).parquet(path).withColumn(column, F.col(column).cast("string")).where(F.col(column).between(first, last))


def drop_days(spark: SparkSession, path: str, days: int, today: str, column: str = "day") -> list[str]:
    """Retention: deletes the folders of days that are more than so many days before today, and returns these days."""
    files = Files(spark, path)
    limit = spark.range(1).select(F.date_sub(F.lit(today).cast("date"), days).cast("string").alias("d")).first()["d"]
    found = [m[1] for n in files.names(path) if (m := re.fullmatch(rf"{re.escape(column)}=(\d{{4}}-\d\d-\d\d)", n))]
    gone = [d for d in found if d < limit]
    for d in gone:
        files.delete(f"{path}/{column}={d}")
    return gone
