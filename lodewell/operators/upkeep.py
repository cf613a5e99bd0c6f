"""Incremental maintenance of derived tables: diffs, upserts, cascades, snapshots and leases."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.operators.changes import latest_by
from lodewell.session import publish_once


def diff(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): new, deleted, unchanged (same time and size), touched (same content) or changed.

    Both frames have key, content_hash, size_bytes and mtime_ms, one row per key. A null hash differs from all.
    """
    a = stored.select(F.col(key).alias("k"), F.struct("content_hash", "size_bytes", "mtime_ms").alias("old"))
    b = scanned.select(F.col(key).alias("k"), F.struct("content_hash", "size_bytes", "mtime_ms").alias("now"))
    same_stat = (F.col("old.size_bytes") == F.col("now.size_bytes")) & (F.col("old.mtime_ms") == F.col("now.mtime_ms"))
    same_hash = F.lower("old.content_hash") == F.lower("now.content_hash")
    c = F.when(F.col("now").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.coalesce(same_stat, F.lit(False)), "unchanged").when(F.coalesce(same_hash, F.lit(False)), "touched").otherwise("changed")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), c.alias("change"))


def to_read(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """Scanned files whose time or size differ from what is stored; asked before any content is read."""
    s = stored.select(key, F.col("size_bytes").alias("__s"), F.col("mtime_ms").alias("__m"))
    same = (F.col("__s") == F.col("size_bytes")) & (F.col("__m") == F.col("mtime_ms"))
    return scanned.join(s, key, "left").filter(~F.coalesce(same, F.lit(False))).drop("__s", "__m")


def replace_rows(stored: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """stored without the rows of changed keys, and new: artifacts of changed documents are replaced whole."""
    return stored.join(changed.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_columns(stored: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """stored with the non-null columns of patch put over its own by key."""
    names = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    j = stored.join(p, key, "left")
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in stored.columns])


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by (type, label), symbols by (type, label, ref_id): metadata of the new, ref_id of the new unless null, the stored id kept."""
    s, n = (d.withColumn("__ref", F.when(F.col("type") == "symbol", F.coalesce("ref_id", F.lit("")))) for d in (stored, new))
    a, b = s.alias("a"), n.alias("b")
    on = (F.col("a.type") == F.col("b.type")) & (F.col("a.label") == F.col("b.label")) & F.col("a.__ref").eqNullSafe(F.col("b.__ref"))
    pick = lambda first, second, c: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    return a.join(b, on, "full_outer").select(pick("a", "b", "node_id"), pick("a", "b", "type"), pick("a", "b", "label"), pick("b", "a", "ref_id"), pick("b", "a", "metadata"))


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """stored and the rows of new whose keys it lacks; of repeated new keys the first by order."""
    fresh = latest_by(new, keys, order).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh)


def delete_cascade(gone: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Tables without the rows that hang on gone keys.

    gone has one column of keys; each table is (frame, column that points up, own key), and its own deleted keys go on to the next.
    """
    out = []
    dead = gone.toDF("__dead").distinct()
    for frame, up, own in tables:
        out.append(frame.join(dead, frame[up] == dead["__dead"], "left_anti"))
        dead = frame.join(dead, frame[up] == dead["__dead"], "left_semi").select(F.col(own).alias("__dead"))
    return out


def settings_fingerprint(settings: dict) -> str:
    """A hash of chunk settings: another one than the stored means that all is chunked again."""
    import hashlib

    return hashlib.sha256(json.dumps(settings, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


@dataclass
class Settings:
    """Defaults of chunking and retrieval; from_json replaces a block wholly where it is given."""

    chunking: dict = field(default_factory=lambda: {"targetTokens": 1024, "overlapTokens": 128})
    retrieval: dict = field(default_factory=lambda: {"vectorLimit": 20, "textLimit": 20, "graphHops": 1, "maxGraphNeighbors": 15, "finalLimit": 10, "maxContextTokens": 4000})
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str | None) -> Settings:
        got = json.loads(text) if text else {}
        return cls(**{k: v for k, v in got.items() if k in cls.__dataclass_fields__})

    def to_json(self) -> str:
        return json.dumps(asdict(self))


class Snapshots:
    """Tables by epoch behind numbered pointers; a pointer names the folder of each table and is never overwritten.

    Every attempt writes to a folder of its own, so readers of the published epoch are not disturbed and a crash leaves it as it
    was. An epoch that is not newer than the published is refused, also when two attempts race (see publish_once).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def epoch(self) -> int:
        """The published epoch, -1 if none."""
        f = self._path(f"{self.root}/published")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(f)), default=-1) if self._fs.exists(f) else -1

    def tables(self) -> dict[str, str]:
        """Folders below root of the published tables by name."""
        if (e := self.epoch()) < 0:
            return {}
        s = self._fs.open(self._path(f"{self.root}/published/{e}"))
        try:
            return json.loads(s.readUTF())
        finally:
            s.close()

    def begin(self, epoch: int | None = None) -> Draft:
        """A draft of an epoch, the next one if none is given."""
        epoch = self.epoch() + 1 if epoch is None else epoch
        if not isinstance(epoch, int) or isinstance(epoch, bool):
            raise ValueError("epoch is not a whole number")
        if self.epoch() >= epoch:
            raise RuntimeError(f"epoch {epoch} is not newer than {self.epoch()}")
        return Draft(self, epoch)

    def publish(self, tables: dict[str, DataFrame], epoch: int) -> None:
        """Writes all tables and makes them current together."""
        draft = self.begin(epoch)
        for name, df in tables.items():
            draft.write(name, df)
        draft.commit()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.tables()[name]}")


class Draft:
    """Tables of an epoch that is not published yet; what is written can be read at once, so it is made only once."""

    def __init__(self, snapshots: Snapshots, epoch: int):
        self.of, self.epoch, self.folder, self.tables = snapshots, epoch, f"epoch-{epoch}-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.of.root}/{self.folder}/{name}")
        return self.add(name, f"{self.folder}/{name}")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes what the tables are made from; it is not published."""
        df.write.parquet(f"{self.of.root}/{self.folder}/staged/{name}")
        return self.of.spark.read.parquet(f"{self.of.root}/{self.folder}/staged/{name}")

    def add(self, name: str, folder: str) -> DataFrame:
        """Takes a table as it lies in folder, below root; one of an older epoch is carried on so."""
        self.tables[name] = folder
        return self.of.spark.read.parquet(f"{self.of.root}/{folder}")

    def commit(self) -> None:
        draft = f"{self.of.root}/drafts/{self.folder}"
        out = self.of._fs.create(self.of._path(draft), True)
        out.writeUTF(json.dumps(self.tables))
        out.close()
        if not publish_once(self.of.spark, draft, f"{self.of.root}/published/{self.epoch}"):
            raise RuntimeError(f"epoch {self.epoch} was published by another run")


def claim(leases: DataFrame, claims: DataFrame) -> DataFrame:
    """leases after claims (workspace_id, owner, at, until): a lease that is free, expired at `at`, or the owner's own is taken.

    Of several claims on one workspace the earliest, then the smallest owner, is tried.
    """
    c = latest_by(claims, ["workspace_id"], [F.asc("at"), F.asc("owner")]).select("workspace_id", F.col("owner").alias("__o"), F.col("at").alias("__a"), F.col("until").alias("__u"))
    j = leases.join(c, "workspace_id", "full_outer")
    free = F.col("owner").isNull() | (F.col("expires_at") <= F.col("__a")) | (F.col("owner") == F.col("__o"))
    take = F.col("__o").isNotNull() & F.coalesce(free, F.lit(True))
    return j.select("workspace_id", F.when(take, F.col("__o")).otherwise(F.col("owner")).alias("owner"), F.when(take, F.col("__u")).otherwise(F.col("expires_at")).alias("expires_at"))


def release(leases: DataFrame, workspace: str, owner: str) -> DataFrame:
    """leases with one given up, if owner still holds it."""
    mine = (F.col("workspace_id") == workspace) & (F.col("owner") == owner)
    return leases.withColumn("expires_at", F.when(mine, None).otherwise(F.col("expires_at"))).withColumn("owner", F.when(mine, None).otherwise(F.col("owner")))


SENSITIVE = ["api_key", "secret", "password", "token"]


def seal_settings(settings: DataFrame, key: str) -> DataFrame:
    """settings (key, value) with sensitive values encrypted: 'enc:' and hex of nonce, text and tag."""
    bad = F.lit(False)
    for s in SENSITIVE:
        bad = bad | F.lower("key").contains(s)
    sealed = F.concat(F.lit("enc:"), F.lower(F.hex(F.aes_encrypt(F.encode("value", "UTF-8"), F.unhex(F.lit(key)), F.lit("GCM")))))
    return settings.withColumn("value", F.when(bad & ~F.col("value").startswith("enc:"), sealed).otherwise(F.col("value")))


def open_settings(settings: DataFrame, key: str) -> DataFrame:
    """settings with sealed values in clear; those that cannot be opened are left out."""
    plain = F.decode(F.try_aes_decrypt(F.unhex(F.expr("substring(value, 5)")), F.unhex(F.lit(key)), F.lit("GCM")), "UTF-8")
    sealed = F.col("value").startswith("enc:")
    return settings.withColumn("value", F.when(sealed, plain).otherwise(F.col("value"))).filter("value is not null")
