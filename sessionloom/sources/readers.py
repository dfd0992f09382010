"""Typed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sessionloom.functions.columns import calendar_parts
from sessionloom.schema import CLICK_COLUMNS, CLICK_SCHEMA


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Explicitly typed CSV/Parquet/ORC/JSON scan; no inference pass over the files."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_clicks(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, CLICK_SCHEMA, fmt)


def read_clicks_projected(
    spark: SparkSession, folder: str, fmt: str = "csv", names: tuple[str, ...] = ("train", "train_sample")
) -> DataFrame:
    """The seven click columns of the first existing file name in a folder."""
    for name in names:
        try:
            return read_clicks(spark, f"{folder.rstrip('/')}/{name}.{fmt}", fmt).select(*CLICK_COLUMNS)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"none of {names} under {folder}")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A missing input is an empty frame of the same schema, so later unions still work."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_head(df: DataFrame, n: int = 5, order: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows, in the given order if there is one."""
    return (df.orderBy(*order) if order else df).limit(n)


def normalise_clicks(df: DataFrame, calendar: bool = True) -> DataFrame:
    """Coerce click_time, drop unreadable rows, default is_attributed to 0, add calendar parts."""
    if "click_time" not in df.columns:
        raise ValueError("click input must contain click_time")
    kind = df.schema["click_time"].dataType
    time = F.try_to_timestamp("click_time") if isinstance(kind, T.StringType) else F.col("click_time").cast("timestamp")
    flag = F.coalesce(F.col("is_attributed").cast("int"), F.lit(0)) if "is_attributed" in df.columns else F.lit(0)
    out = df.withColumns({"click_time": time, "is_attributed": flag}).dropna(subset=["click_time"])
    return out.withColumns(calendar_parts(F.col("click_time"))) if calendar else out


def read_numbered(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """A file scan with each row's file (``file_path``) and place in it from 0 (``file_row``)."""
    df = spark.read.format(fmt).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row"))


def capped_class_scan(
    df: DataFrame, negative_cap: int = 120_000, positive_minimum: int = 5_000, chunk_rows: int = 750_000, label: str = "is_attributed"
) -> DataFrame:
    """What a reader in file order keeps: every positive, and the first ``negative_cap`` negatives, of the chunks it reads.

    A chunk is ``chunk_rows`` rows of a file (``read_numbered``), files follow each other by name. Reading stops behind the first
    chunk at which both the cap and the positive minimum are met, so positives behind it are left out; if that never happens, all is read. A null
    label is negative. Classes are counted per chunk in one narrow scan, the counts are added up in file order, and only the one chunk
    that the cap cuts through is ranked. What stays is a filter by file, place and label: no row is shuffled.
    """
    positive = F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1
    part = F.floor(F.col("file_row") / chunk_rows)
    counts = df.groupBy("file_path", part.alias("part")).agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))
    order = Window.orderBy("file_path", "part")
    upto = counts.select("file_path", "part", F.sum("positives").over(order).alias("positives"), F.sum("negatives").over(order).alias("negatives"))
    upto = upto.withColumn("before", F.coalesce(F.lag("negatives").over(order), F.lit(0)))
    place = F.struct("file_path", "part")
    last, cut = upto.agg(
        F.min(F.when((F.col("positives") >= positive_minimum) & (F.col("negatives") >= negative_cap), place)),
        F.min(F.when(F.col("negatives") >= negative_cap, F.struct("file_path", "part", (negative_cap - F.col("before")).alias("room")))),
    ).first()
    kept = df
    if last:
        file, at = F.col("file_path"), F.col("file_row")
        kept = kept.where((file < last["file_path"]) | ((file == last["file_path"]) & (at < (last["part"] + 1) * chunk_rows)))
    if cut:
        edge = df.where((F.col("file_path") == cut["file_path"]) & (part == cut["part"]) & ~positive)
        end = edge.select("file_row").orderBy("file_row").limit(int(cut["room"])).agg(F.max("file_row")).first()[0]
        until = -1 if end is None else end
        first = (F.col("file_path") < cut["file_path"]) | ((F.col("file_path") == cut["file_path"]) & (F.col("file_row") <= until))
        # with no room in the chunk itself, the negatives before it are still in
        before = (F.col("file_path") < cut["file_path"]) | ((F.col("file_path") == cut["file_path"]) & (F.col("file_row") < cut["part"] * chunk_rows))
        kept = kept.where(positive | first | before)
    return kept


def read_csv_inferred(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a heading whose column types are read from the data (one more pass over the files)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
