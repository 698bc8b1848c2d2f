"""Windows over an event stream: tumbling counts and gap sessions, with a watermark for late events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: the table may be one file


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running(events: DataFrame) -> DataFrame:
    """user_id, n and total so far, for each user that a batch brings events of: state kept from batch to batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame([(key[0], n, total)], columns=["user_id", "n", "total"])

    rows = events.where("user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there, each batch written to a part of a table in the shared folder, and give that table.

    A batch that runs again after a failure overwrites its own part, so no row comes twice. complete: the last batch
    holds everything. append, update: all batches, with their number as `batch`.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/table/batch={0 if mode == 'complete' else batch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("batch", "long")
    try:
        return stream.sparkSession.read.schema(schema).parquet(f"{folder}/table")
    except AnalysisException:  # no batch came
        return stream.sparkSession.createDataFrame([], schema)
