"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding. Each stage reads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm import contamination, mixing, ngram_join, quality, sharding
from sessionloom.llm.common import documents, with_columns
from sessionloom.session import materialise


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold stay; the machine is trained on the labelled ones among them.

    A null or empty text is scored as an empty one. Repeated rows get equal scores and share their fate, rows without an id are scored like others. Texts
    are read whole. Without labels all stay. A column named ``__score`` is dropped, all others stay; an empty table stays empty.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_rows(docs, machine, "__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays, the one with the smallest id.

    Texts without words are in no group and all stay. Of rows equal in id and text one stays, of equal texts under several ids
    the smallest id; a null id is never the smallest. Columns stay as they are, but those named ``__key``, ``__one`` or ``__turn`` clash and are replaced
    inside; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item stay.

    A null or empty text holds no copy and stays; repeated rows share their fate. Test items that are null or empty match nothing; one of one to three
    words matches every document that holds these words in a row. A column named ``__matches`` is dropped; an empty table stays empty.
    """
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them (0 to 2 times). Targets weigh the sources 5, 2, 1, repeating, over 150% of all words.

    A null source is a source of its own, the last. Texts without words have size 0. Draws are keyed by id, source and text, so reruns agree; rows
    equal in all three share their copies. Columns that start with two underscores and clash are replaced inside; an empty table stays empty.
    """
    sized = with_columns(docs, __words=mixing.word_count(F.col("text")), __key=F.xxhash64("doc_id", "source", "text"))
    mixed = mixing.mix(sized.select("source", "__key", "__words"), size="__words", key=["__key"])
    taken = mixed.groupBy("__key").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    met = sized.join(materialise(taken, "mix-taken"), "__key")
    # rows that are equal in id, source and text share their copies
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__words")) - 1
    own = F.floor((F.col("__copies") + F.col("__rows") - 1 - turn) / F.col("__rows")).cast("long")
    each = met.withColumn("__own", own).where("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own"))))
    return each.select(*[F.col(f"`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its global row number, its shard (0 to 7) and its slot in the shard.

    Rows follow id and source, nulls first; rows equal in both get neighbouring numbers in the order they are read. Columns named ``row_number``, ``shard``
    or ``slot`` are replaced; an empty table stays empty.
    """
    return sharding.shard_rows(docs, ["doc_id", "source"])


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
#: A trained model and similarity components are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name)
    return docs
