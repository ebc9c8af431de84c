"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# whether a join asks for rows dealt by all its keys, not only by some of them
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

# Settings a job should run with; all are runtime SQL settings.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text stages cost far more per byte than usual: keep small shuffles spread over all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    ALL_JOIN_KEYS: "true",
}

# whether Spark deletes the shuffle files of a query when it ends
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# how many partitions a shuffle has before adaptive execution merges small ones
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# up to which size it merges them
MERGED_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# rows of a shuffle that one task should take
TASK_ROWS = 1 << 18


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within the block shuffles into a partition per ``TASK_ROWS`` of ``rows``, if that is more than is set.

    A task's memory then does not grow with the table. Adaptive execution merges partitions that are small.
    """
    names = (FIRST_PARTITIONS, MERGED_SIZE)
    before = {name: spark.conf.get(name, None) for name in names}
    least = int(before[FIRST_PARTITIONS] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(FIRST_PARTITIONS, str(max(least, -(-rows // TASK_ROWS))))
    # rows that a join multiplies: merged to a quarter of the usual size
    spark.conf.set(MERGED_SIZE, "16m")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and later scans
    read only the columns they need. Nothing reads the shuffle files of the
    write once the table is there, so Spark deletes them then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def cut_by_user(df: DataFrame, parts: int, key: str = "user_id") -> DataFrame:
    """``cut_lineage`` into ``parts`` files, a key's rows in one of them.

    Spark knows how the rows lie: grouping, windows and joins whose keys hold
    ``key`` need no shuffle of such tables, if all have the same ``parts``
    (joins on more keys only while ``ALL_JOIN_KEYS`` is off). ``df`` is dealt
    so itself, or each of its tasks writes up to ``parts`` files. Only the DataFrame knows the table: its name is dropped at once, its files stay.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, "cut"), f"tessera_{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.table(name)
    table.scratch = path
    spark.sql(f"DROP TABLE {name}")
    return table


def is_small(df: DataFrame) -> bool:
    """Whether the planner sends ``df`` to every task of a join, as far as it knows the size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` has written.

    Only for tables whose readers have all been written themselves: a lost
    executor's work on a reader that has not would need them again.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
