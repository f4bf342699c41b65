"""Predictions as a stream: rows are read as files arrive, each is predicted on its own, and a row that can't be
predicted carries its error instead of failing the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import vectors as vec
from codonlake.operators import scoring


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_a_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream. The schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", pattern).parquet(folder)


def predicted(df: DataFrame, logits: str = "logits", classes: int = 2, threshold: float = 0.5) -> DataFrame:
    """Add ``prob``, ``pred`` and ``error``; works on a stream and on a table alike."""
    ok = vec.is_scored(F.col(logits), classes)
    p = F.when(ok, scoring.binary_prediction(F.col(logits), threshold))
    why = F.when(F.col(logits).isNull(), "no scores").when(F.size(logits) != classes, "wrong number of scores").when(~ok, "scores are not numbers")
    return df.withColumn("__p", p).withColumn("prob", F.col("__p.prob")).withColumn("pred", F.col("__p.pred")).withColumn("error", why).drop("__p")


def for_models(df: DataFrame, models: DataFrame) -> DataFrame:
    """Each row of a stream for each model of a registry (a static table)."""
    return df.crossJoin(F.broadcast(models))


def outcome_counts(df: DataFrame, by: str) -> DataFrame:
    """(by, total, succeeded, failed) as running counts."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def windowed_counts(df: DataFrame, time: str, by: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, by, n): rows by event-time window, with rows later than ``late`` dropped. An extension."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived, into parquet files (``append``) or, with the last state kept, a table
    (``complete``), and return it. A run that is repeated goes on where the last ended."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
