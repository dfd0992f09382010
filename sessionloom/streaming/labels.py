"""Labels of closed sessions in a stream, by thresholds from a sketch that grows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from sessionloom.session import work_folder
from sessionloom.sources.readers import read_or_empty

#: Values a sketch keeps about; fewer values than that are held exactly, beyond it the rank error is about 2.3 / SIZE ** 0.9.
SIZE = 8192


def label_closed_sessions(stream: DataFrame, share: float = 0.99, strict: bool = False, size: int = SIZE, purpose: str = "labelled") -> tuple[DataFrame, DataFrame]:
    """Drains a stream of closed sessions into a table with ``label`` and ``bot_type``, and returns it with the thresholds of all batches.

    The batch rule for fast sessions, carried along: without an install, and a request rate at least (``strict``: above) the ``share`` quantile
    of all sessions closed so far, those of the running batch included. What is kept of the past is one mergeable quantile sketch; the sketch of a batch
    is aggregated with map-side combine and merged with the one before. State and rows lie in folders of the batch's number, so a repeated
    batch starts from the same sketch and replaces its rows. Earlier labels stay as they were.
    """
    spark = stream.sparkSession
    target = work_folder(spark, purpose)
    state = "sketch binary, threshold double, batch long"

    def handle(df: DataFrame, batch: int) -> None:
        here = df.sparkSession
        held = read_or_empty(here, f"{target}/state", _schema(state), "parquet").where(F.col("batch") < batch)
        last = held.agg(F.max_by("sketch", "batch").alias("sketch")).where("sketch IS NOT NULL")
        rate = F.when(~F.isnan("requests_per_minute"), F.col("requests_per_minute").cast("double"))
        new = df.where(rate.isNotNull()).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(rate, size).alias("sketch")).where("n > 0").select("sketch")
        merged = last.select("sketch").unionByName(new).agg(F.count("*").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch")).where("n > 0")
        merged = merged.select("sketch", F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("threshold"))
        merged.write.mode("overwrite").parquet(f"{target}/state/batch={batch}")
        found = here.read.schema("sketch binary, threshold double").parquet(f"{target}/state/batch={batch}").select("threshold").first()
        top = F.lit(found["threshold"] if found else None).cast("double")
        fast = F.coalesce((rate > top) if strict else (rate >= top), F.lit(False))
        bot = fast & ~(F.coalesce(F.col("install_count"), F.lit(0)) > 0)
        out = df.withColumns({"label": bot.cast("int"), "bot_type": F.when(bot, "talkingdata_possible_bot").otherwise("talkingdata_human")})
        out.write.mode("overwrite").parquet(f"{target}/rows/batch={batch}")

    query = stream.writeStream.option("checkpointLocation", f"{target}/log").outputMode("append").trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()
    schema = StructType(list(stream.schema)).add("label", IntegerType()).add("bot_type", StringType()).add("batch", IntegerType())
    thresholds = read_or_empty(spark, f"{target}/state", _schema(state), "parquet").select("batch", "threshold", F.kll_sketch_get_n_double("sketch").alias("seen"))
    return read_or_empty(spark, f"{target}/rows", schema, "parquet"), thresholds


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)
