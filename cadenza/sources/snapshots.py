"""Tables in versions: a manifest names the folders that make up a table, and a commit is one create of the next manifest.

``root/data/<id>`` folders are written once, partitioned by hash buckets of the keys, and never changed. ``root/versions/<n>``
lists which buckets of which folders are the table. A version is the create of a file that doesn't exist, which one
of several writers can do; nothing is renamed or overwritten. A writer that is lost leaves a folder that no manifest
names, or a manifest without its end, which readers pass over: the table is the last whole version. Two writers don't mix: the
one that comes second finds its number taken, and makes its change again on what the first has left.

The store must have create-if-absent, as HDFS and local file systems do."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.sets import upsert_by_key

#: Seconds for which a manifest without its end counts as one that is being written.
GRACE = 30.0
BUCKET = "_bucket"
_END = "\nend\n"


@dataclass(frozen=True)
class Snapshot:
    """``parts``: folder and the buckets of it that belong to the table."""

    version: int
    schema: str
    buckets: int
    parts: dict[str, list[int]] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has put the version."""


class Store:
    """A table's files, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since 1970 of its last change) of what lies in a folder."""
        where = self._path(f"{self.root}/{folder}")
        if not self.files.exists(where):
            return []
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self.files.listStatus(where)]

    def read(self, name: str) -> str:
        at = self._path(f"{self.root}/{name}")
        stream = self.files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Fails with Conflict if there is such a file."""
        try:
            stream = self.files.create(self._path(f"{self.root}/{name}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(name) from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.files.delete(self._path(f"{self.root}/{name}"), True)


def _manifest(store: Store, name: str) -> Snapshot | None:
    text = store.read(f"versions/{name}")
    if not text.endswith(_END):
        return None
    made = json.loads(text.removesuffix(_END))
    return Snapshot(int(name), made["schema"], made["buckets"], made["parts"])


def current(spark: SparkSession, root: str) -> tuple[Snapshot | None, int]:
    """The last whole version, and the number that the next one takes: after any manifest that its writer didn't end."""
    store, after = Store(spark, root), 0
    for name, changed in sorted(store.names("versions"), reverse=True):
        if not name.isdigit():
            continue
        while (found := _manifest(store, name)) is None and time.time() - changed < GRACE:
            time.sleep(0.2)
        after = max(after, int(name))
        if found:
            return found, after + 1
    return None, after + 1


def commit(spark: SparkSession, root: str, number: int, snapshot: Snapshot) -> None:
    text = json.dumps({"schema": snapshot.schema, "buckets": snapshot.buckets, "parts": snapshot.parts})
    Store(spark, root).create(f"versions/{number:020d}", text + _END)


def _rows(spark: SparkSession, root: str, found: Snapshot, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, of some buckets only, with their bucket."""
    out = spark.createDataFrame([], f"{found.schema}, {BUCKET} int")
    for folder, own in sorted(found.parts.items()):
        some = own if buckets is None else sorted(set(own) & set(buckets))
        if some:
            out = out.unionByName(spark.read.schema(out.schema).parquet(f"{root}/data/{folder}").where(F.col(BUCKET).isin(some)))
    return out


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as it is, or as it was in a version."""
    found = current(spark, root)[0] if version is None else _manifest(Store(spark, root), f"{version:020d}")
    if found is None:
        raise FileNotFoundError(f"{root} has no such version")
    return _rows(spark, root, found).drop(BUCKET)


def _written(rows: DataFrame, root: str) -> tuple[str, list[int]]:
    """A new folder with the rows, partitioned by bucket; its name, and the buckets that have rows."""
    folder = uuid.uuid4().hex
    path = f"{root}/data/{folder}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
    return folder, sorted(int(n.partition("=")[2]) for n, _ in Store(rows.sparkSession, root).names(f"data/{folder}") if n.startswith(f"{BUCKET}="))


def upsert_snapshot(new: DataFrame, root: str, keys: list[str], buckets: int = 64, tries: int = 20) -> int:
    """Replaces the rows of the keys of ``new``; gives the version that has them. Only buckets that they fall into are read and
    written. Columns that the table lacks are added, those that ``new`` lacks are null."""
    spark = new.sparkSession
    for _ in range(tries):
        base, number = current(spark, root)
        count = base.buckets if base else buckets
        tagged = new.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int"))
        touched = sorted(r[0] for r in tagged.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        merged = upsert_by_key(_rows(spark, root, base, touched), tagged, keys) if base else tagged
        schema = ", ".join(f"`{c}` {t}" for c, t in merged.dtypes if c != BUCKET)
        folder, full = _written(merged, root)
        parts = {f: left for f, own in (base.parts if base else {}).items() if (left := [b for b in own if b not in touched])}
        try:
            commit(spark, root, number, Snapshot(number, schema, count, parts | {folder: full}))
            return number
        except Conflict:
            Store(spark, root).delete(f"data/{folder}")
    raise Conflict(f"{root}: {tries} other writers came first")


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than: float = 7 * 86_400.0) -> int:
    """Deletes the folders that none of the last ``keep`` whole versions names and that are older than the age in seconds, which must
    exceed the longest job: younger ones may belong to a writer that hasn't committed. Gives their number."""
    store, whole = Store(spark, root), []
    for name, _ in sorted(store.names("versions"), reverse=True):
        if len(whole) < keep and name.isdigit() and (found := _manifest(store, name)):
            whole.append(found)
    named = {f for s in whole for f in s.parts}
    gone = [n for n, changed in store.names("data") if n not in named and time.time() - changed > older_than]
    for n in gone:
        store.delete(f"data/{n}")
    return len(gone)
