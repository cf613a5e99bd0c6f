"""Only new or changed records.

`latest_by` keeps the newest row of a key, `changed_records` compares current hashes with a state,
and `StateStore` holds that state in numbered versions behind one pointer that is swapped atomically,
so a failed run leaves the last completed version in force: nothing is skipped and nothing repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.session import publish_once


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first by `order`.

    The limit is applied on the map side before the shuffle (a row_number filter of 1), so a key that
    holds a third of all rows costs one row per input partition. Null keys are a key of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def same_hash(a: Column, b: Column) -> Column:
    """Whether two hex digests agree without regard to letter case; null agrees with nothing."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def changed_records(
    current: DataFrame,
    state: DataFrame,
    key: str,
    hash_col: str,
    state_key: str,
    state_hash: str,
    accept: Column | None = None,
) -> DataFrame:
    """Rows of `current` that `state` does not cover, with `change` = 'new' or 'changed'.

    state has one row per state_key (see latest_by). accept is a condition on state columns under which
    a covered row counts (null counts as false). Current rows with a null hash are left out: there is no
    content to process. Repeated current keys come out once per distinct hash; an empty state makes every
    row new; an empty current gives no rows. Columns of state never clash: only the three used are taken.
    """
    ok = F.lit(True) if accept is None else F.coalesce(accept, F.lit(False))
    s = state.select(
        F.col(state_key).alias("__key"), F.lower(state_hash).alias("__hash"), ok.alias("__ok"), F.lit(True).alias("__seen")
    )
    joined = current.filter(F.col(hash_col).isNotNull()).join(s, F.col(key) == F.col("__key"), "left")
    covered = F.coalesce((F.lower(hash_col) == F.col("__hash")) & F.col("__ok"), F.lit(False))
    return (
        joined.filter(~covered)
        .withColumn("change", F.when(F.col("__seen").isNull(), F.lit("new")).otherwise(F.lit("changed")))
        .drop("__key", "__hash", "__ok", "__seen")
        .dropDuplicates([key, hash_col])
    )


class StateStore:
    """Versions of (record_key, content_hash) under `root`, the current one named by a pointer file.

    A version is a list of folders: a base and the deltas of later runs, so a commit writes only what its run processed; every
    COMPACT-th commit writes the whole anew. commit() writes its folder completely, then publishes a numbered pointer that names
    the folders; a run that dies before leaves the last version current and its leftovers unread. Pointers are never
    overwritten (see publish_once for the file systems on which that holds): of two runs that start from the same version
    the second finds its number taken and raises, and starts again from what the first committed.
    """

    #: Folders of a version at most.
    COMPACT = 8
    SCHEMA = "record_key string, content_hash string, seq int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last committed version; 0 before the first."""
        folder = self._path(f"{self.root}/pointers")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def folders(self, version: int) -> list[str]:
        """The folders of a version, oldest first."""
        if not version:
            return []
        s = self._fs.open(self._path(f"{self.root}/pointers/{version:012d}"))
        try:
            return s.readUTF().split()
        finally:
            s.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The committed state: of each key the hashes of the last run that processed it; an empty frame before the first commit."""
        names = self.folders(self.version() if version is None else version)
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/{n}" for n in names])
        if len(names) == 1:
            return rows
        last = Window.partitionBy("record_key").orderBy(F.desc("seq"))
        return rows.withColumn("__r", F.rank().over(last)).filter("__r = 1").drop("__r")

    def select(self, current: DataFrame, key: str, hash_col: str) -> DataFrame:
        """Rows of current that the committed state does not cover, with `change` = 'new' or 'changed'.

        A key that comes with several hashes is covered by each that was committed with it. Rows with a null hash are left out;
        repeated rows come out once per key and hash.
        """
        state = self.read().groupBy(F.col("record_key").alias("__key")).agg(F.collect_set("content_hash").alias("__hashes"))
        j = current.filter(F.col(hash_col).isNotNull()).join(state, F.col(key).cast("string") == F.col("__key"), "left")
        covered = F.coalesce(F.array_contains("__hashes", F.lower(hash_col)), F.lit(False))
        change = F.when(F.col("__key").isNull(), "new").otherwise("changed")
        return j.filter(~covered).withColumn("change", change).drop("__key", "__hashes").dropDuplicates([key, hash_col])

    def commit(self, done: DataFrame, key: str, hash_col: str, base: int | None = None) -> int:
        """Adds the processed rows to the state and makes the result current; returns its version.

        base is the version the run started from (the current one if None). Rows with a null key or hash are not remembered.
        """
        base = self.version() if base is None else base
        new = done.select(F.col(key).cast("string").alias("record_key"), F.lower(hash_col).alias("content_hash"), F.lit(base + 1).alias("seq")).dropna().distinct()
        names = self.folders(base)
        name = f"state-{base + 1:012d}-{uuid.uuid4().hex}"
        if len(names) + 1 > self.COMPACT:
            new = self.read(base).join(new.select("record_key").distinct(), "record_key", "left_anti").unionByName(new)
            names = []
        new.write.parquet(f"{self.root}/{name}")
        draft = f"{self.root}/drafts/{name}"
        out = self._fs.create(self._path(draft), True)
        out.writeUTF(" ".join([*names, name]))
        out.close()
        if not publish_once(self.spark, draft, f"{self.root}/pointers/{base + 1:012d}"):
            raise RuntimeError(f"version {base + 1} was committed by another run")
        return base + 1

    def vacuum(self) -> list[str]:
        """Removes folders that the current version does not need; call it while no run reads or commits."""
        kept = set(self.folders(self.version()))
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        gone = [n for n in names if n.startswith("state-") and n not in kept]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return gone
