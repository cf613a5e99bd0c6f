"""Session factory and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def make_session(cpus: int | str = "*", memory: str = "8g", app: str = "lodewell") -> SparkSession:
    """A local session with the settings the tests and the bench use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that all executors share.

    Only where the session names none and runs on one machine (tests) a local folder is set; on a cluster that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lodewell-checkpoints"))
    return named or jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that a lost executor loses nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stamps(*frames: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of the files that frames read: another value means other data."""
    out = []
    for df in frames:
        spark = df.sparkSession
        conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for name in sorted(df.inputFiles()):
            s = (p := path(name)).getFileSystem(conf).getFileStatus(p)
            out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


def publish_once(spark: SparkSession, draft: str, final: str) -> bool:
    """Gives the finished file draft the name final, once: False if another run has taken that name.

    On a local disk a hard link does it, elsewhere a rename that refuses an existing target. Both are one atomic step on local
    disks and on HDFS. Object stores on which a rename is a copy give no such promise: keep pointers on one of the former.
    """
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    a, b = path(draft), path(final)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            os.link(a.toUri().getPath(), b.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(a, False)
        return True
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    none[0] = kind.getEnumConstants()[0]
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(a, b, none)
    except Exception:
        if not fs.exists(b):
            raise
        return False
    return True


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a few small files would keep Python work on fewer.

    Only files that together are smaller than one scan partition per core are dealt out anew, so what is shuffled is bounded
    by cores times the partition size; larger inputs, and frames that do not read files, are left as they are.
    """
    spark = df.sparkSession
    cores, names = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not names or len(names) >= cores:
        return df
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum((p := path(n)).getFileSystem(conf).getFileStatus(p).getLen() for n in names)
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")))
    return df.repartition(cores) if size < cores * most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodewell-"), "lodewell.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("lodewell", os.path.relpath(p, here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
