"""What streams write: refined rows, the audit trail, and rows that came too late; each batch once, also after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.clustering import audit
from ..sources.logs import LOG, LogSchema, valid, write_csv


def _each(stream: DataFrame, save, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def save_refined(refined: DataFrame, rows_path: str, audit_path: str, checkpoint: str, s: LogSchema = LOG) -> StreamingQuery:
    """Writes a stream of refined rows as CSV, and their audit trail as JSON: a folder for each batch, which a repeated batch overwrites."""

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        write_csv(batch, f"{rows_path}/batch={number}", s=s)
        audit(batch, s.activity, s.event).write.mode("overwrite").json(f"{audit_path}/batch={number}")
        batch.unpersist()

    return _each(refined, save, checkpoint)


def save_late(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", s: LogSchema = LOG) -> StreamingQuery:
    """Writes the rows of a stream that arrivals(), with the same delay, lets go: those at or behind the latest time of the batches before, less the delay.

    The marks of the batches lie beside the checkpoint, so that a restart goes on from them.
    """
    marks = f"{checkpoint}-marks"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = valid(batch, s).persist()
        before = spark.read.schema("latest timestamp, batch long").parquet(marks).where(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        late = batch.where(F.col(s.time) <= F.lit(before) - F.expr(f"interval {delay}")) if before is not None else batch.where("false")
        late.withColumn("reason", F.lit("late")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.agg(F.max(s.time).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        batch.unpersist()

    return _each(stream, save, checkpoint)
