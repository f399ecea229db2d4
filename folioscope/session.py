"""Session helpers shared by every operator: session set-up, table access, shared work folders and sizing."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

PARTITION_BYTES = 128 << 20
#: Rows go to Python workers in batches of about so many bytes, unless the session says otherwise: long texts would
#: else fill batches of many hundred megabytes, once in the JVM and once in the worker.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
UNKNOWN_BYTES = 1 << 52
_OWN: dict[str, str] = {}


def get_session(app: str = "folioscope", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they start (once a session), and batches of a bounded size."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    key = f"ship-{spark.sparkContext.applicationId}"
    if key not in _OWN:
        root = Path(__file__).resolve().parent
        _OWN[key] = path = f"{tempfile.mkdtemp(prefix='folioscope-')}/folioscope.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, dealt out where its files give fewer tasks than there are cores (one small file can't be
    split further). Larger tables are read as they lie; columns and filters still reach the scan."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.xxhash64(*df.columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset and all tasks run on this machine
    (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioscope/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing will read again."""
    path = getattr(df, "_folioscope_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fanout(df: DataFrame, target: int = PARTITION_BYTES) -> int:
    """Partitions for an explicit repartition of `df`: the session's count, or more where its bytes ask for it.

    Plans of unknown size (in-memory rows) are estimated beyond any table; they keep the session's count."""
    n, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return n if size > UNKNOWN_BYTES else max(n, math.ceil(size / target))
