"""Late rows kept as data instead of vanishing behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from sessionloom.session import work_folder


def split_late(stream: DataFrame, time: str, delay_ms: int, purpose: str = "late", behind: int = 2) -> tuple[DataFrame, DataFrame]:
    """Drains ``stream`` into two tables, rows on time and late rows, and reads them back.

    Both get the number of their micro-batch (``batch``), late rows also how far behind the watermark they came (``late_us``, microseconds).
    The watermark of a batch is the newest time of the batches up to ``behind`` before it, in whole milliseconds, less the delay; 2 is what the
    engine's stateful operators use for dropping rows, so the late table holds the rows that they would drop. A row without time is on time. Every
    batch writes its newest time and its rows to folders of its own number: a batch that is repeated after a failure
    replaces its rows and finds the same watermark.
    """
    spark = stream.sparkSession
    target = work_folder(spark, purpose)

    def handle(df: DataFrame, batch: int) -> None:
        here = df.sparkSession
        us = F.unix_micros(F.col(time).cast("timestamp"))
        df.agg(F.max(us).alias("top")).write.mode("overwrite").parquet(f"{target}/marks/batch={batch}")
        tops = here.read.schema("top long, batch long").parquet(f"{target}/marks")
        top = tops.where(F.col("batch") <= batch - behind).agg(F.max("top")).first()[0]
        mark = None if top is None else (top // 1000 - delay_ms) * 1000
        late = F.lit(False) if mark is None else F.coalesce(us <= mark, F.lit(False))
        df.where(~late).write.mode("overwrite").parquet(f"{target}/on_time/batch={batch}")
        by = F.lit(mark).cast("long") - us
        df.where(late).withColumn("late_us", by).write.mode("overwrite").parquet(f"{target}/late/batch={batch}")

    query = stream.writeStream.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()
    plain = StructType(list(stream.schema)).add("batch", IntegerType())
    more = StructType(list(stream.schema)).add("late_us", LongType()).add("batch", IntegerType())
    return _read(spark, f"{target}/on_time", plain), _read(spark, f"{target}/late", more)


def _read(spark, path: str, schema: StructType) -> DataFrame:
    from sessionloom.sources.readers import read_or_empty

    return read_or_empty(spark, path, schema, "parquet")
