"""Tables read from a data folder, and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quern-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: the lineage is cut and the work is not repeated.

    Columnar, so that later readers take only the columns they need. Removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Keys up to this number (some 50 bytes each) are sent to all tasks; more are joined by shuffle.
BROADCAST_KEYS = 500_000


def once(rows: DataFrame, key: str, best: Callable[[list[str]], Column]) -> DataFrame:
    """rows, each key once: of several rows of a key the one that best(other columns) picks, an aggregate. Rows without a key are left out.

    The keys that come more than once are found from the key alone, and only their rows are shuffled; all others stay where they lie.
    """
    rows = rows.where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c != key]
    many = staged(rows.select(key).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if not (n := many.count()):
        return rows
    if n <= BROADCAST_KEYS:
        many = F.broadcast(many)
    picked = rows.join(many, key, "left_semi").groupBy(key).agg(best(rest).alias("_r")).select(key, "_r.*")
    return rows.join(many, key, "left_anti").select(key, *rest).unionByName(picked)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
