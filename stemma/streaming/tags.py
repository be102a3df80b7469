"""The append-only classification log as a stream: dead letters apart, last write wins.

State is a table, not an operator: every micro-batch is reduced to its latest row
per notice and merged into the table by one aggregation on the key, so a notice
tagged ever so often costs one row a batch.  Applying a batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.tags import RELEVANCE, latest

SCHEMA = (
    "tag_row_id bigint, notice_id string, relevance string, relevance_none_reason string, works array<string>, themes array<string>, approaches array<string>, confidence double, justification string, "
    "needs_review boolean, wave string, run_id string, source_model string, auto_generated boolean, vocabulary_version string, prompt_version string, input_digest string, tagged_at string"
)


def read_log(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, dead letters): no id, an unknown relevance, or no time."""
    ok = F.col("notice_id").isNotNull() & F.col("relevance").isin(*RELEVANCE) & F.col("tagged_at").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)


class LatestTable:
    """A table of the latest row per notice, one generation per micro-batch, in a shared folder.

    The current generation is the last one that was written whole; a batch starts
    from the last generation before it, so applying it again gives the same table.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _generations(self, spark: SparkSession) -> list[str]:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if n.startswith("gen-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        done = [g for g in self._generations(spark) if before is None or g < f"gen-{before:08d}"]
        return spark.read.schema(SCHEMA).parquet(f"{self.folder}/{done[-1]}") if done else spark.createDataFrame([], SCHEMA)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        good, bad = split(batch)
        spark = batch.sparkSession
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        merged = latest(self.read(spark, batch_id).unionByName(latest(good.select(columns))))
        merged.write.mode("overwrite").parquet(f"{self.folder}/gen-{batch_id:08d}")
        bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/rejects/gen-{batch_id:08d}")
        self._forget(spark)

    def _forget(self, spark: SparkSession) -> None:
        """Deletes generations that no batch starts from any more: the last batch may be applied again, so two before it stay."""
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for g in self._generations(spark)[:-3]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{g}"), True)


def run_available(spark: SparkSession, log_folder: str, table: LatestTable, checkpoint: str) -> None:
    """Apply everything that has arrived, in micro-batches, and stop."""
    q = read_log(spark, log_folder).writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, late: str = "21 days", width: str = "7 days") -> DataFrame:
    """Rows per week and relevance by event time; rows later than the watermark are left out."""
    t = stream.withColumn("at", F.to_timestamp("tagged_at"))
    return t.withWatermark("at", late).groupBy(F.window("at", width), "relevance").agg(F.count("*").alias("n"))
