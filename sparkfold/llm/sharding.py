"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations only.

``append`` writes an arrival as Parquet files, one per task: small immutable shards.  ``compact`` puts the
shards that are smaller than half the target in tiers by size (powers of ``fan_in``) and merges each tier
that has ``fan_in`` shards at least into files of about the target size.  A merge reads its shards and
writes fewer partitions; rows are neither shuffled nor sorted, so no key can be hot.  Each byte is
rewritten once per tier at most: log(target / smallest shard) to the base ``fan_in`` times.

The state is a versioned manifest of shards.  A version is a folder that holds what it adds and what it
takes away; each CHECKPOINT-th one holds the whole list instead, so an append writes a few rows however
many shards there are.  A version is written beside the others and appears by a rename to the next version
number, which fails if that number is taken; then an append tries again on top of the newer version, and a
merge is given up, and its files deleted, if another one took its shards.  Readers see a whole version or
none.  Shards of older versions stay until ``vacuum``, which also deletes what died writers have left.

Never data, but names come to the driver: the paths of the shards of one merge (MERGE_SHARDS at most), those of
a version that is read, as for every scan, and in ``vacuum`` one folder name for each write.

Defined results: an arrival without rows adds no shard; a store without shards reads as an empty table of
its schema; rows that repeat stay repeated; nulls and extra columns are stored as they are; all arrivals of a
store have its schema.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .session import discard, fresh_name, stored

#: Target size of a file, and shards of similar size that make a merge worth while.
TARGET_BYTES, FAN_IN = 128 << 20, 4
#: Shards below this size are all in the lowest tier.
FLOOR_BYTES = 1 << 20
#: Shards that one merge takes at most; what is left is taken by the next.
MERGE_SHARDS = 10_000
#: Versions from one whole manifest to the next.
CHECKPOINT = 16
_MANIFEST = "path string, bytes long, rows long, added long"
_CHANGE = f"{_MANIFEST}, gone boolean"


class Conflict(RuntimeError):
    """Another writer took the next version number first."""


class ShardStore:
    """Shards below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fan_in = target_bytes, fan_in

    # versions ------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with their times (seconds)."""
        fs, path = self._fs(), self._path(folder)
        return [(x.getPath().getName(), x.getModificationTime() // 1000) for x in fs.listStatus(path)] if fs.exists(path) else []

    def _known(self) -> tuple[list[int], int]:
        """Numbers of all versions, in order, and the first one that may still be read."""
        names = [n for n, _ in self._names("_manifest")]
        horizon = max([0, *(int(n.removeprefix("horizon-")) for n in names if n.startswith("horizon-"))])
        return sorted(int(n[1:]) for n in names if n.startswith("v")), horizon

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, in order."""
        known, horizon = self._known()
        return [v for v in known if v >= horizon]

    def _folder(self, version: int) -> str:
        return f"_manifest/v{version:010d}"

    def _base(self, version: int) -> int:
        """The whole manifest that a version builds on (1 if there is none yet)."""
        fs = self._fs()
        while version > 1 and not fs.exists(self._path(f"{self._folder(version)}/_whole")):
            version -= 1
        return version

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version (the latest one if none is given): path, bytes, rows, added (version)."""
        known = self.versions()
        if version is None and not known:
            return self.spark.createDataFrame([], _MANIFEST)
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"there is no version {version}")
        changes = self.spark.read.schema(_CHANGE).parquet(*[f"{self.root}/{self._folder(v)}" for v in range(self._base(version), version + 1)])
        rows = changes.groupBy("path").agg(F.max("bytes").alias("bytes"), F.max("rows").alias("rows"), F.max("added").alias("added"), F.bool_or("gone").alias("gone"))
        return rows.where(~F.col("gone")).drop("gone")

    def _commit(self, change: DataFrame, base: int) -> int:
        """Makes ``change`` (rows of _CHANGE) version base + 1, or raises Conflict."""
        waiting, version = f"_manifest/.{uuid.uuid4().hex}", base + 1
        whole = version % CHECKPOINT == 0
        if whole:
            gone = change.where("gone").select("path")
            change = self.manifest(base).join(gone, "path", "left_anti").withColumn("gone", F.lit(False)).unionByName(change.where(~F.col("gone")))
        (change if whole else change.coalesce(1)).write.parquet(f"{self.root}/{waiting}")
        if whole:
            self._fs().create(self._path(f"{waiting}/_whole")).close()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_manifest").toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(waiting), self._path(self._folder(version)), options)
        except Exception as fault:
            context.delete(self._path(waiting), True)
            if version in self._known()[0]:
                raise Conflict(f"version {version} exists") from fault
            raise
        return version

    def _update(self, change: Callable[[DataFrame, int], DataFrame | None]) -> int | None:
        """Commits what ``change`` makes of the latest version; starts over if another writer was faster."""
        while True:
            known = self.versions()
            base = known[-1] if known else 0
            rows = change(self.manifest(), base + 1)
            if rows is None:
                return None
            try:
                return self._commit(rows, base)
            except Conflict:
                continue

    # data ----------------------------------------------------------------

    def _own(self, rows: DataFrame) -> list[Column]:
        return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]

    def _shards(self, folder: str, *keys: str) -> DataFrame:
        """Manifest rows of the files below a data folder, without ``added``."""
        schema = StructType([*self.schema.fields, *(StructField(k, IntegerType()) for k in keys)])
        written = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        return written.groupBy(*keys, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))

    @staticmethod
    def _added(shards: DataFrame, version: int) -> DataFrame:
        return shards.select("path", "bytes", "rows", F.lit(version).cast("long").alias("added"), F.lit(False).alias("gone"))

    def append(self, arrival: DataFrame) -> int:
        """Adds the rows of an arrival as new shards; returns the version that has them."""
        folder = f"data/{uuid.uuid4().hex}"
        arrival.select(*self._own(arrival)).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._update(lambda _, version: self._added(self._shards(folder), version))

    def append_each(self, rows: DataFrame, arrival: Column) -> list[int]:
        """Adds rows as one arrival for each value of ``arrival`` (an integer): one pass writes them all, then each becomes a version of its own, in order."""
        folder, key = f"data/{uuid.uuid4().hex}", fresh_name("arrival", self.schema.names)
        rows.select(*self._own(rows), arrival.cast("int").alias(key)).write.option("compression", "zstd").partitionBy(key).parquet(f"{self.root}/{folder}")
        shards = stored(self._shards(folder, key))
        out = []
        for r in shards.select(key).distinct().orderBy(key).toLocalIterator():
            mine = shards.where(F.col(key).eqNullSafe(F.lit(r[0])))
            out.append(self._update(lambda _, version, mine=mine: self._added(mine, version)))
        discard(shards)
        return out

    def _tiers(self) -> DataFrame:
        """Small shards with their tier."""
        size = F.greatest(F.col("bytes"), F.lit(FLOOR_BYTES)) / F.lit(float(FLOOR_BYTES))
        return self.manifest().where(F.col("bytes") < self.target_bytes // 2).withColumn("tier", F.floor(F.log(size) / F.log(F.lit(float(self.fan_in)))).cast("int"))

    def compact(self) -> int:
        """Merges tiers until none has ``fan_in`` shards; returns the number of merges."""
        merges = 0
        while True:
            small = self._tiers()
            full = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan_in).orderBy("tier").first()
            if full is None:
                return merges
            taken = small.where(F.col("tier") == full.tier).orderBy("bytes", "path").limit(MERGE_SHARDS).select("path", "bytes").collect()
            self._merge([r.path for r in taken], sum(r.bytes for r in taken))
            merges += 1

    def _merge(self, paths: list[str], size: int) -> int | None:
        """Puts the rows of some shards into files of the target size; None if another merge took one of them."""
        parts, folder = max(1, -(-size // self.target_bytes)), f"data/{uuid.uuid4().hex}"
        self.spark.read.schema(self.schema).parquet(*paths).coalesce(parts).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        old = self.spark.createDataFrame([(p,) for p in paths], "path string")

        def change(shards: DataFrame, version: int) -> DataFrame | None:
            if shards.join(old, "path", "left_semi").count() < len(paths):
                return None  # another merge was faster; its result stands
            taken = old.selectExpr("path", "CAST(NULL AS long) AS bytes", "CAST(NULL AS long) AS rows", "CAST(NULL AS long) AS added", "true AS gone")
            return self._added(self._shards(folder), version).unionByName(taken)

        version = self._update(change)
        if version is None:
            self._fs().delete(self._path(folder), True)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def vacuum(self, keep: int = 1, grace_seconds: int = 86_400) -> int:
        """Forgets all but the last ``keep`` versions; deletes the shards that only they held, and the folders of data
        or of manifests that no version holds and that are older than ``grace_seconds`` (a writer may still be at
        work on younger ones).  Returns the number of shards that were forgotten."""
        known = self.versions()
        gone, kept = known[:-keep], known[-keep:]
        if not kept:
            return 0
        fs = self._fs()
        live = self.manifest(kept[0]).select("path")
        for v in kept[1:]:
            live = live.unionByName(self.manifest(v).select("path"))
        live = live.distinct()
        dead = []
        if gone:
            base = self._base(gone[0])
            held = self.spark.read.schema(_CHANGE).parquet(*[f"{self.root}/{self._folder(v)}" for v in range(base, kept[-1] + 1)]).select("path").distinct()
            dead = [r.path for r in held.join(live, "path", "left_anti").toLocalIterator()]
            # from now on no reader starts on a version that loses its shards
            fs.create(self._path(f"_manifest/horizon-{kept[0]:010d}")).close()
            for v in range(1, self._base(kept[0])):
                fs.delete(self._path(self._folder(v)), True)
            for p in dead:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(p)), False)
        used = {r[0] for r in live.select(F.regexp_extract("path", "/data/([0-9a-f]{32})/", 1)).distinct().toLocalIterator()}
        before = int(time.time()) - grace_seconds
        for folder, names in (("data", [x for x in self._names("data") if x[0] not in used]), ("_manifest", [x for x in self._names("_manifest") if x[0].startswith(".")])):
            for name, at in names:
                if at <= before:
                    fs.delete(self._path(f"{folder}/{name}"), True)
        return len(dead)


def op2_sharding(docs: DataFrame, root: str, arrivals: int = 5) -> DataFrame:
    """Every document, read back from the compacted store: its columns, n_bytes and the MD5 of its text.

    The table comes in ``arrivals`` parts, each a version of the store.
    """
    store = ShardStore(docs.sparkSession, root, docs.schema)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals)))
    store.compact()
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return store.read().select(*rest, F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"
