"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "corpus", "citations", "tag_log", "source_policy", "authority", "review_labels", "mix_targets",
)


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the given session is used as it is."""
    b = (
        SparkSession.builder.master(master)
        .appName("stemma")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STEMMA_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session has it.

    Where it is unset, a master on this machine gets a folder under the warehouse; a
    cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stemma-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it again.

    Cuts lineage without local copies: a lost executor loses nothing, since every
    later stage reads files all executors share.  Compressed columns make it
    smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemma-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stemma_path = path
    if _open:
        _open[-1].append(path)
    return out


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes every table that :func:`materialize` wrote inside, but those given to ``keep``.

    ``keep(df, name)`` writes what is to outlive the block.
    """
    mine: list[str] = []
    _open.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        mine.remove(out._stemma_path)
        if len(_open) > 1:
            _open[-2].append(out._stemma_path)  # the block around it decides
        return out

    try:
        yield keep
    finally:
        _open.pop()
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Asks the driver to collect what finished steps left, so that their shuffle files are deleted on the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once all that was made of it is written itself."""
    path = getattr(df, "_stemma_path", None)
    if path:
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
