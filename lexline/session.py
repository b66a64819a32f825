"""Session helpers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What Spark allows if spark.sql.sources.bucketing.maxBuckets is left as it is.
_MOST_BUCKETS = 100_000


#: Rows after which Spark's Parquet writer first asks how much it holds.
_FIRST_ASKED = ("parquet.page.size.row.check.min", "parquet.block.size.row.check.min")


def long_rows(spark: SparkSession) -> None:
    """Let Parquet writers of this session ask after each row how much they hold, not after a hundred.

    They hold a hundred rows whatever their length otherwise, and the page of them compressed beside it.
    Short rows are asked about as seldom as before, since the next time follows from their length.
    """
    for key in _FIRST_ASKED:
        spark.conf.set(key, "1")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for kept results: the one the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a new temporary folder; on a cluster that would
    be lost with its machine, so there the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="lexline-checkpoints-")
        context.setCheckpointDir(named)
    return named


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def durable(df: DataFrame, below: str | None = None) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder, or ``below``, and read on from there.

    Results that feed several branches are computed once, each branch reads only the columns it
    needs, and a lost executor costs a read. Nothing reads the write's shuffle files again, so
    they go when it ends and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{below or checkpoint_dir(spark).rstrip('/')}/lexline-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, below: str | None = None) -> DataFrame:
    """``durable``, dealt by a hash of ``key``: joins on it move the other side alone, however often.

    There are as many buckets as shuffle partitions, as a join would deal both sides anew if there were
    fewer. Rows of one key are one task's, so ``key`` must not be shared by many rows. The table's name
    goes at once; the files stay.
    """
    spark = df.sparkSession
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _MOST_BUCKETS)
    name = f"lexline_{uuid.uuid4().hex}"
    path = f"{below or checkpoint_dir(spark).rstrip('/')}/{name}"
    with _shuffles_freed(spark):
        dealt = df.repartition(buckets, key).write.bucketBy(buckets, key)
        dealt.option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


class Scratch:
    """Kept tables that only steps on the way to a result read, in one folder.

    ``remove`` deletes them all. Call it when what is still to be read of them is in a ``durable`` table.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/lexline-scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        return durable(df, self.folder)

    def remove(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give row-local work at least one partition per core.

    Only a source with few splits, such as one small file, is repartitioned; a large one has more
    splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows_per_task: int) -> DataFrame:
    """Give row-local work that takes far longer than reading a task for each ``rows_per_task`` rows.

    Splits and row groups of a file go by bytes, and ``spread`` by cores, so a task's rows would grow with
    the input. The rows are counted first, which of a table reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(df.count() / rows_per_task)))
