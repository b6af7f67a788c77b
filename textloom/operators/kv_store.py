"""Key-value rows stored in key order: a lookup opens the files of one chunk, and a batch rewrites only the chunks that it hits.

Keys are unique, so a chunk, a range of `width` keys, has at most that many rows. Rows stand in folders of chunks, sorted by key. A table, the map, says in which
folder each chunk stands now; an index of hashed payloads says in which chunks a payload may be, for lookups by value. What a batch writes is new folders; a small
manifest (see sources/segments.py) names the map, the folders and the indexes, so readers see all of a batch or nothing, and of two writers one looks again. Folders and indexes
are merged, the smaller half into one, when there are more than FOLDERS.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered
from textloom.shared import forget, small_side, staged
from textloom.sources import segments

#: Rows of a chunk on average, and folders of a store before the smaller half becomes one.
CHUNK_ROWS, FOLDERS = 1_000_000, 8
ROWS, MAP, BY_PAYLOAD = "key long, payload string, chunk long", "chunk long, folder string, n long", "h long, chunk long, folder string"


def _new(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


@dataclass
class Store:
    """One state of a store at path; open() gives the newest. Its rows stay as they are while it is used."""

    spark: SparkSession
    path: str
    version: int
    manifest: dict

    # ---- making
    @classmethod
    def create(cls, rows: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS) -> Store:
        """rows: key, payload. Of rows of one key that with the greatest payload stays; rows without a key get the next ones, in order of payload."""
        spark = rows.sparkSession
        span = rows.agg(F.min("key"), F.max("key"), F.count("key")).first()
        base = span[0] or 0
        width = max(1, -(-(span[1] - base + 1) * chunk_rows // span[2])) if span[2] else chunk_rows
        empty = cls(spark, path, segments.state(spark, path)[0], {"base": base, "width": width, "last": -1, "map": None, "folders": [], "indexes": []})
        return empty.insert(rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        version, manifest = segments.state(spark, path)
        if not version:
            raise ValueError(f"there is no store at {path}")
        return cls(spark, path, version, manifest)

    def _chunk(self, key="key"):
        return F.floor((F.col(key) - self.manifest["base"]) / F.lit(self.manifest["width"]).cast("decimal(20,0)")).cast("long")

    def _map(self) -> DataFrame:
        name = self.manifest["map"]
        return self.spark.read.schema(MAP).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], MAP)

    def _read(self, where: DataFrame | None) -> DataFrame:
        """key, payload, chunk of the chunks of where (chunk, folder), which name the only folders that are opened; None: all."""
        if where is None:
            where = self._map()
        by_folder: dict[str, list[int]] = {}
        for r in where.select("chunk", "folder").distinct().collect():  # at most a row for each CHUNK_ROWS rows
            by_folder.setdefault(r.folder, []).append(r.chunk)
        parts = [self.spark.read.schema(ROWS).parquet(f"{self.path}/{f}").where(F.col("chunk").isin(sorted(chunks))) for f, chunks in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ROWS)

    def _of(self, chunks: DataFrame) -> DataFrame:
        return self._map().join(small_side(chunks.select("chunk").distinct()), "chunk", "left_semi")

    # ---- reading
    def rows(self) -> DataFrame:
        return self._read(None).select("key", "payload")

    def ordered(self) -> DataFrame:
        return self.rows().orderBy("key")

    def search(self, key: int) -> DataFrame:
        """The row of key: one chunk is read, and of it the row groups that may hold the key."""
        chunk = (key - self.manifest["base"]) // self.manifest["width"]
        return self._read(self._map().where(F.col("chunk") == chunk)).where(F.col("key") == key).select("key", "payload")

    def search_keys(self, keys: DataFrame) -> DataFrame:
        """key, payload of all keys (key) that are there."""
        keys = keys.select(F.col("key").cast("long").alias("key")).where("key is not null").distinct()
        rows = self._read(self._of(keys.select(self._chunk().alias("chunk"))))
        return rows.join(small_side(staged(keys, "keys")), "key", "left_semi").select("key", "payload")

    def search_values(self, values: DataFrame) -> DataFrame:
        """key, payload of all rows whose payload is one of values (payload): chunks by the index, then rows by the payload itself."""
        values = staged(values.select("payload").where("payload is not null").distinct(), "values")
        parts = [self.spark.read.schema(BY_PAYLOAD).parquet(f"{self.path}/{name}") for name in self.manifest["indexes"]]
        if not parts:
            return self.spark.createDataFrame([], "key long, payload string")
        entries = reduce(DataFrame.unionByName, parts)
        few = [r[0] for r in values.select(F.xxhash64("payload")).limit(101).collect()]
        if len(few) <= 100:  # the hashes reach the scan
            entries = entries.where(F.col("h").isin(few))
        may = entries.join(small_side(values.select(F.xxhash64("payload").alias("h"))), "h", "left_semi").select("chunk", "folder").distinct()
        live = self._map().join(small_side(staged(may, "chunks")), ["chunk", "folder"], "left_semi")  # entries of folders that a chunk has left are stale
        return self._read(live).join(small_side(values), "payload", "left_semi").select("key", "payload")

    # ---- writing
    def _put(self, rows: DataFrame, hit: DataFrame, last: int, folders: list[str], indexes: list[str]) -> Store:
        """The store after this one, in which the chunks of hit have these rows. folders, indexes: those kept besides."""
        folder, index, table = _new("rows"), _new("payloads"), _new("map")
        rows.repartitionByRange("chunk", "key").sortWithinPartitions("chunk", "key").write.partitionBy("chunk").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(ROWS).parquet(f"{self.path}/{folder}")
        entries = written.select(F.xxhash64("payload").alias("h"), "chunk", F.lit(folder).alias("folder")).distinct()
        entries.repartitionByRange("h", "chunk").sortWithinPartitions("h").write.parquet(f"{self.path}/{index}")
        counts = written.groupBy("chunk").agg(F.lit(folder).alias("folder"), F.count("*").alias("n"))
        kept = self._map().join(small_side(hit.select("chunk").distinct()), "chunk", "left_anti")
        kept.unionByName(counts).orderBy("chunk").write.parquet(f"{self.path}/{table}")
        new = self.manifest | {"map": table, "last": last, "folders": [*folders, folder], "indexes": [*indexes, index]}
        new["segments"] = [{"name": name} for name in (table, *new["folders"], *new["indexes"])]
        segments.publish(self.spark, self.path, self.version, new)
        segments.clean(self.spark, self.path)
        return Store(self.spark, self.path, self.version + 1, new)

    def _merge(self, changes: DataFrame, add: bool, last: int) -> Store:
        """changes: key, payload, one row for each key. add: keys that are new come in, else they are left."""
        changes = staged(changes.withColumn("chunk", self._chunk()), "changes")
        hit = staged(changes.select("chunk").distinct() if add else self._of(changes).select("chunk"), "hit")
        old = self._read(self._of(hit)).withColumnRenamed("payload", "_old").withColumn("_there", F.lit(True))
        both = old.join(changes.withColumn("_new", F.lit(True)), ["key", "chunk"], "full" if add else "left")
        rows = both.select("key", F.when(F.col("_new"), F.col("payload")).otherwise(F.col("_old")).alias("payload"), "chunk")
        done = self._put(rows, hit, last, self.manifest["folders"], self.manifest["indexes"])
        forget(changes, hit)
        return done.compact()

    def insert(self, values: DataFrame) -> Store:
        """Add rows (payload, perhaps key). A key that is there gets the new payload; rows without a key get the next ones after the largest that ever was, in order of payload."""
        if "key" not in values.columns:
            values = values.withColumn("key", F.lit(None).cast("long"))
        given = values.where("key is not null").groupBy(F.col("key").cast("long").alias("key")).agg(F.max("payload").alias("payload"))
        free = values.where("key is null").select("payload")
        last = max(self.manifest["last"], given.agg(F.coalesce(F.max("key"), F.lit(-1))).first()[0])
        new = numbered(free, "payload").select((F.col("number") + last + 1).cast("long").alias("key"), "payload")
        rows = staged(given.unionByName(new), "inserted")
        last = max(last, rows.agg(F.coalesce(F.max("key"), F.lit(-1))).first()[0])
        return self._merge(rows, True, last)

    def update(self, changes: DataFrame) -> Store:
        """New payloads (key, payload) for keys that are there; others are left. Of several for one key the greatest payload counts."""
        rows = changes.where("key is not null").groupBy(F.col("key").cast("long").alias("key")).agg(F.max("payload").alias("payload"))
        return self._merge(rows, False, self.manifest["last"])

    def compact(self, limit: int = FOLDERS) -> Store:
        """One folder and one index for the smaller half of the folders, if there are more than limit."""
        folders = self.manifest["folders"]
        if len(folders) <= limit:
            return self
        held = {r.folder: r.n for r in self._map().groupBy("folder").agg(F.sum("n").alias("n")).collect()}
        small = sorted(folders, key=lambda f: held.get(f, 0))[: (len(folders) + 1) // 2]
        hit = self._map().where(F.col("folder").isin(small))
        kept = [f for f in folders if f not in small]
        indexes = self.manifest["indexes"]
        return self._put(self._read(hit), hit, self.manifest["last"], kept, [i for f, i in zip(folders, indexes, strict=True) if f in kept])
