"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is set so that its source's words reach the target. Its whole part is taken for
certain; the fraction is an inclusion probability p. Documents are then ordered by u/(1-u) over p/(1-p), with u drawn from
the document's key, and the first ones are taken until the source's remaining words are reached (Rosén's order sampling,
with the sample's fixed size counted in words).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import WORD, documents, numbered, unit_draw, with_columns
from sessionloom.session import materialise

#: Rows of a source that one cell of the rank histogram holds on average; only the cell a target cuts through is sorted.
CELL_ROWS = 4000


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source (columns ``source``, ``words``): its ``target``.

    Sources rank by code point, null last, and take ``weights`` in turn. Each round shares what capped sources leave
    by weight among the rest, until no target is above ``most`` times its source; only three sums leave a round.
    """
    ranked, _ = numbered(
        sizes, [F.col("source").isNull(), F.col("source")], "rank", "mix-sources"
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialise(
        with_columns(ranked, weight=F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")), cap=F.col("words") * float(most)),
        "mix-weights",
    )
    total = ranked.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0] * float(share)
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap") if full >= 0 else F.lit(False)
        row = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.coalesce(F.sum(above.cast("long")), F.lit(0)),
        ).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], max(level, (total - row[0]) / row[1])
    return ranked.select("source", "words", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def mix(
    df: DataFrame,
    source: str = "source",
    size: str = "size",
    key: list[str] = ("doc_id",),
    weights: list[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    damping: float = 0.25,
    seed: str = "mix",
) -> DataFrame:
    """Rows with ``source_size``, ``target`` and ``copies`` (0..most, whole numbers), other columns as they are.

    Expected copies fall with the logarithmic size class of a document as size**-damping, so long documents are repeated less;
    ``damping`` 0 treats all alike. A source's taken words miss its target by half of one document's words at most. A null
    source is a source of its own; sizes that are null count 0, and a document of size 0 is never taken. Repeated rows draw
    one number each and tie, then rank by the order of the written table. An empty table stays empty.
    """
    measured = materialise(
        with_columns(
            df,
            __source=F.col(f"`{source}`"),
            __size=F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long")),
            __u=unit_draw(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-")) for k in key], salt=seed),
        ).withColumn("__class", F.floor(F.log2(F.col("__size") + 1)).cast("int")),
        "mix-measured",
    )
    classes = materialise(
        measured.groupBy("__source", "__class").agg(F.sum("__size").alias("s"), F.count("*").alias("rows")), "mix-classes"
    )
    wanted = targets(classes.groupBy(F.col("__source").alias("source")).agg(F.sum("s").alias("words")), list(weights), share, most)
    # Expected copies min(most, c * w) per class, w falling with the class: the classes reach the cap one after another.
    w = F.pow(F.lit(2.0), -float(damping) * F.col("__class"))
    per = Window.partitionBy("__source").orderBy("__class")
    steps = (
        classes.join(wanted, classes["__source"].eqNullSafe(wanted["source"]))
        .select("__source", "__class", "s", "rows", "words", "target", w.alias("w"))
        .withColumn("ahead", F.coalesce(F.sum("s").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum(F.col("w") * F.col("s")).over(per.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("c", F.try_divide(F.col("target") - float(most) * F.col("ahead"), F.col("left")))
        .withColumn("c", F.first(F.when(F.col("c") * F.col("w") <= float(most), F.col("c")), True).over(
            per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("e", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(F.col("c"), F.lit(float(most))) * F.col("w"))))
        .withColumn("sure", F.floor(F.col("e") + 1e-12).cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("e") - F.col("sure")))
    )
    whole = Window.partitionBy("__source")
    rates = materialise(
        steps.withColumn("rest", F.col("target") - F.sum(F.col("sure") * F.col("s")).over(whole))
        .withColumn("cells", F.greatest(F.lit(1), F.ceil(F.sum("rows").over(whole) / CELL_ROWS)).cast("long"))
        .select(F.col("__source").alias("r_source"), F.col("__class").alias("r_class"), "words", "target", "sure", "p", "rest", "cells"),
        "mix-rates",
    )
    # rank = odds(u) / odds(p), squeezed into (0, 1) so that a cell is a range of ranks
    odds = F.try_divide(F.col("__u") / (1 - F.col("__u")) * (1 - F.col("p")), F.col("p"))
    open_ = (F.col("p") > 1e-12) & (F.col("__size") > 0)
    ordered = (
        measured.join(rates, measured["__source"].eqNullSafe(rates["r_source"]) & (measured["__class"] == rates["r_class"]))
        .withColumn("__rank", F.when(open_, odds))
        .withColumn("__cell", F.when(open_, F.floor((1 - 1 / (1 + F.col("__rank"))) * F.col("cells")).cast("long")))
        .drop("r_source", "r_class", "p", "cells")
    )
    ordered = materialise(ordered, "mix-ordered")
    cells = ordered.where("__cell IS NOT NULL").groupBy("__source", "__cell").agg(F.sum("__size").alias("s"), F.max("rest").alias("rest"))
    run = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        cells.withColumn("upto", F.sum("s").over(run))
        .where(F.col("upto") >= F.col("rest"))
        .groupBy(F.col("__source").alias("c_source"))
        .agg(F.min(F.struct("__cell", F.col("upto"), F.col("s"))).alias("m"))
        .select("c_source", F.col("m.__cell").alias("cut"), (F.col("m.upto") - F.col("m.s")).alias("below"))
    )
    cuts = materialise(cuts, "mix-cuts")
    joined = ordered.join(cuts, ordered["__source"].eqNullSafe(cuts["c_source"]), "left").drop("c_source")
    cut, cell = F.col("cut"), F.col("__cell")
    inside = joined.where(cell.isNotNull() & cut.isNotNull() & (cell == cut))
    line = Window.partitionBy("__source").orderBy("__rank", *[F.col(f"`{k}`") for k in key])
    upto = F.col("below") + F.sum("__size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = inside.withColumn("__extra", (upto - F.col("__size") / 2 <= F.col("rest")).cast("long"))
    outside = joined.where(~(cell.isNotNull() & cut.isNotNull() & (cell == cut))).withColumn(
        "__extra", F.when(cell.isNotNull() & (cut.isNull() | (cell < cut)), 1).otherwise(0).cast("long")
    )
    done = outside.unionByName(picked)
    return with_columns(
        done,
        source_size=F.col("words").cast("long"),
        target=F.col("target"),
        copies=F.when(F.col("__size") > 0, F.col("sure") + F.col("__extra")).otherwise(0).cast("long"),
    ).drop("__source", "__size", "__u", "__class", "words", "sure", "rest", "__rank", "__cell", "cut", "below", "__extra")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op10_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their source's target and the words the mix takes of each."""
    rows = documents(spark, folder).select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("mark")
    )
    return mix(rows, key=["doc_id", "mark"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
