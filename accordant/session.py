"""Session defaults and reliable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "accordant", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is planned for; ``conf`` adds or overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here are built from thousands of small expressions; recording the Python call
        # site of each one would cost more than running a small query.
        "spark.sql.dataFrameQueryContext.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own_folder: tempfile.TemporaryDirectory | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local, one folder of this process is used
    instead; it goes when the process ends.
    """
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="accordant-")
    return _own_folder.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_root`, which is deleted when the session's JVM ends."""
    path = f"{scratch_root(spark)}/accordant/{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return a scan of it.

    Use it where several consumers read one result: the scan is columnar, so each consumer
    reads only its columns, and a lost executor costs a re-read and not a recompute.  Rows of one
    directory are brought together first, so tasks do not write a file into every directory; a
    large directory is split again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, name: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a bucketed table in the shared folder and return a scan of it.

    Rows are dealt by ``by`` once; aggregations and windows whose keys include these columns, and
    joins of such tables on them, then need no exchange.  The number of buckets is that of the session's
    shuffle partitions unless given.  The table is known to this session's catalog by a name of its own.
    """
    n = buckets or bucket_count(df.sparkSession)
    return in_buckets(df.repartition(n, *by), name, by, n)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, paths: list[str], megabytes: int) -> int:
    """Number of parts to deal rows to that are made from the files below ``paths``: one per so many megabytes of them.

    At least that of the session's shuffle partitions.  Adaptive execution leaves such parts as they are; it would
    merge them by their shuffled size, which says little where few bytes become many rows.
    """
    size = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(bucket_count(spark), -(-size // (megabytes << 20)))


def in_buckets(df: DataFrame, name: str, by: list[str], buckets: int) -> DataFrame:
    """Write ``df``, whose rows are dealt by ``by`` to so many partitions already, as a bucketed table; a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "accordant_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
