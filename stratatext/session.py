"""Session set-up, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import IllegalArgumentException, UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes above which a side is never broadcast.  Every broadcast hint in
#: this package sits behind :func:`is_small`, which reads at most one row more.
BROADCAST_ROW_LIMIT = 20_000
BROADCAST_BYTE_LIMIT = 64 << 20


def build_session(app: str = "stratatext", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew handling and a UTC clock."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Text work is heavy per byte: keep small shuffles spread over the cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-master session without that setting gets a private folder; a
    cluster session without it is an error, because executors could not share it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


_local_folder: str | None = None


#: Makes Spark delete a query's shuffle files when the query ends, not at some later garbage collection.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files: a written table needs none of them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage at a table written to the shared folder and read back.

    Used where one result feeds several branches of a plan: it is computed once
    and survives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """True when ``df`` has at most ``limit`` rows and about ``max_bytes`` of content.

    Reads no more than ``limit + 1`` rows; content is measured as JSON text.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    row = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"] <= limit and row["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint behind a size check; a larger side is left to shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that has fewer input splits than the cluster has cores.

    A table stored as a few large row groups would otherwise be worked on by a
    few tasks.  Scans with enough splits are returned as they are: no shuffle.
    The keys together must be (nearly) unique, so that no task gets a hot one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        splits = df._jdf.queryExecution().sparkPlan().execute().getNumPartitions()
    except (IllegalArgumentException, UnsupportedOperationException):  # no mere scan: a join that is not planned yet
        return df.repartition(*keys)
    return df.repartition(*keys) if splits < cores else df
