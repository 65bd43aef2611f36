"""Session, intermediate tables in the shared folder, and size-checked broadcasting."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def session(app: str = "lumenmatch", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew joins, Arrow."""
    b = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-lumen-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the application's folder that nothing uses yet."""
    return f"{shared_folder(spark)}/lumen-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The files of one application lie in one folder, which ``clear`` removes.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple[weakref.ref, str]] = {}


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized DataFrame that nothing reads any more."""
    known, path = _written.pop(id(df), (lambda: None, ""))
    if known() is df:
        delete_path(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which Spark deletes the shuffle files of plans that nothing holds any more."""
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete all intermediate files of this application; results not yet read are lost."""
    _written.clear()
    delete_path(spark, f"{shared_folder(spark)}/lumen-{spark.sparkContext.applicationId}")


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, written once; with a broadcast hint only if its counted rows are at most max_rows."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def merged(df: DataFrame) -> DataFrame:
    """df, to be joined by sort and merge, never broadcast.

    For sides that grow with the input: Spark reckons their size from compressed files and shuffles,
    of which rows in the driver's memory can take some hundred times as much.
    """
    return df.hint("merge")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df dealt by the columns to all shuffle partitions, however few rows it has: what follows makes many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """df, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
