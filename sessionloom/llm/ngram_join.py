"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

Equal sets are one class; classes are joined. A class's n-grams are ordered rare first and only the first
n - ceil(t n) + 1 of them are joined: two sets with similarity t share one of those. Within the classes that share a prefix
n-gram, one after another serves as the star that all others are compared with, so a group of near copies costs one pair
per member and not one per pair of members: classes that are already connected need no comparison. What stays
unconnected after ``STARS`` stars is joined pair by pair, so no link between different texts is lost.

The suffix filter bounds a pair's Hamming distance from below: a set's parity sketch flips one of ``SKETCH`` bits for each n-gram, so two
sketches differ in at most as many bits as the sets differ in n-grams. A short sketch of ``SKETCH`` bits is full for a long text, so what it lets
through is bounded again by sketches with a bit or two for every n-gram; the longer of two is folded to the other's length. Only pairs within all bounds fetch their sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm import tokens
from sessionloom.llm.common import arrow_batches, documents, with_columns
from sessionloom.llm.graph import components
from sessionloom.session import materialise, ship_by_value

ship_by_value(__name__)
ship_by_value(tokens.__name__)

#: Counters of the n-gram frequency table (a power of 2) and counters in one of its rows. Fixed size at any scale.
COUNTERS, ROW = 1 << 20, 1 << 14
#: Bits of the filter that tells which classes have a candidate.
FILTER_BITS = 1 << 22
STARS = 2
#: An n-gram whose counter exceeds this and ``OFTEN`` times the mean may be hot: its rows are dealt into ``SALTS`` groups first.
HOT, OFTEN, SALTS = 1000, 20, 1024
SKETCH = 512
_PARTS = [f"s{i}" for i in range(SKETCH // 64)]

_SETS = f"doc_id long, mark long, class long, n long, {', '.join(f'{c} long' for c in _PARTS)}, wide binary, part int, counts binary"


def wide_sketch(own: np.ndarray) -> bytes:
    """Parities of a set's n-grams in as many bits as it has n-grams, rounded up to a power of 2."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    return np.packbits((np.bincount((own >> 20) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sets(batches, n, counters):
    """Rows (doc_id, mark, class, n, sketch) and, at a partition's end, its n-gram counts in compressed rows."""
    counts = np.zeros(counters, dtype=np.int64)
    names = ["doc_id", "mark", "class", "n", *_PARTS, "wide", "part", "counts"]
    for batch in batches:
        classes, sizes, wides, flips = [], [], [], np.zeros((batch.num_rows, SKETCH), dtype=np.uint8)
        for i, own in tokens.shingle_sets(batch.column("text"), n):
            classes.append(tokens.set_mark(own) if len(own) else None)
            sizes.append(len(own))
            wides.append(wide_sketch(own) if len(own) else None)
            np.add.at(counts, own & (counters - 1), 1)
            flips[i] = np.bincount((own >> 40) & (SKETCH - 1), minlength=SKETCH) & 1
        sketch = np.packbits(flips, axis=1).view(np.int64)
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64())]
            + [pa.array(np.ascontiguousarray(c)) for c in sketch.T] + [pa.array(wides, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
            names,
        )
    if counts.any():
        blobs = [zlib.compress(counts[i : i + ROW].tobytes(), 1) for i in range(0, counters, ROW)]
        none = pa.nulls(len(blobs)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none] * (len(names) - 3) + [pa.nulls(len(blobs), pa.binary()), pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names)


def _summed(batches):
    total = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            row = np.frombuffer(zlib.decompress(blob), np.int64)
            total[part] = total[part] + row if part in total else row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])


def _prefixes(batches, n, percent, shared):
    """The rare-first prefix of every class once per partition: gram, class, size, position, salt of frequent grams (or -1)."""
    counts, seen = shared.value, set()
    often = max(HOT, OFTEN * counts.sum() // len(counts))
    for batch in batches:
        grams, classes, sizes, places, salts = [], [], [], [], []
        for _, own in tokens.shingle_sets(batch.column("text"), n):
            k = len(own)
            if not k or (mark := tokens.set_mark(own)) in seen:
                continue
            seen.add(mark)
            length = k - -(-percent * k // 100) + 1
            weight = counts[own & (len(counts) - 1)]
            if length < k // 2:
                limit = np.partition(weight, length - 1)[length - 1]
                pool = weight <= limit
                own, weight = own[pool], weight[pool]
            order = np.lexsort((own, weight))[:length]
            own, weight = own[order], weight[order]
            salts.append(np.where(weight > often, mark & (SALTS - 1), -1).astype(np.int32))
            grams.append(own)
            classes.append(np.full(len(own), mark, dtype=np.int64))
            sizes.append(np.full(len(own), k, dtype=np.int32))
            places.append(np.arange(len(own), dtype=np.int32))
        if grams:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (grams, classes, sizes, places, salts)], ["gram", "class", "n", "place", "salt"]
            )


def _wanted_sets(batches, n, shared):
    """Sets of the rows that the filter names."""
    bits = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        bit = np.asarray(batch.column("key")) & (FILTER_BITS - 1)
        batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
        sets = [own for _, own in tokens.shingle_sets(batch.column("text"), n) if len(own)]
        if sets:
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokens.set_mark(own) for own in sets], pa.int64()), pa.array([own.tobytes() for own in sets], pa.binary())], ["class", "grams"]
            )


def _within(batches, percent):
    """Pairs whose wide sketches differ in no more bits than similar sets of these sizes may."""
    for batch in batches:
        keep, most = [], (np.asarray(batch.column("an")) + np.asarray(batch.column("bn"))) * (100 - percent)
        for x, y, allowed in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most.tolist()):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            least = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
            keep.append(int(np.unpackbits(x ^ y).sum()) * (100 + percent) <= allowed)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches, percent):
    """Pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bits(df: DataFrame, column: str) -> bytes:
    """Bit filter over a 64-bit column; 64 bits a row, so its size is fixed."""
    bit = F.col(column).bitwiseAND(FILTER_BITS - 1)
    rows = df.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(({column} & 63) AS INT))")).alias("v")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in rows:
        out[row[0]] = row[1]
    return out.tobytes()


def join_classes(df: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``doc_id``, ``mark``, ``class``, ``n``; links ``a``, ``b`` between classes that span their components)."""
    spark = df.sparkSession
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    both = materialise(texts.mapInArrow(lambda b: _sets(b, n, COUNTERS), _SETS), "join-sets")
    rows = both.where("part IS NULL").select("doc_id", "mark", "class", "n", *_PARTS, "wide")
    summed = both.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary")
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for part, blob in summed.collect():  # COUNTERS numbers, whatever the corpus
        counts[part * ROW : (part + 1) * ROW] = np.frombuffer(blob, np.int64)
    shared = spark.sparkContext.broadcast(counts)
    prefixes = texts.select("text").mapInArrow(lambda b: _prefixes(b, n, percent, shared), "gram long, class long, n int, place int, salt int")
    # of near copies, the one with the fewest n-grams of its own before the common one lies in their middle: it is the first star
    near, member = Window.partitionBy("gram", "salt"), F.struct("place", "class", "n")
    dealt = materialise(
        prefixes.withColumn("before", F.lag("class").over(near.orderBy("class")))
        .withColumns({"low": F.min("class").over(near), "high": F.max("class").over(near), "size": F.count("*").over(near), "star": F.min(member).over(near)})
        .where("(salt >= 0 OR low < high) AND (before IS NULL OR before <> class)")
        .select("gram", "class", "n", "place", "salt", "size", "low", "high", "star"),
        "join-postings",
    )
    postings = dealt.where("salt < 0").select("gram", "class", "n", "place", "size", "star")
    salted = dealt.where("salt >= 0")
    if salted.limit(1).count():
        whole = salted.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("size"), F.min("star").alias("star"))
        whole = materialise(whole.where("low < high").select("gram", "size", "star"), "join-hot")
        postings = postings.unionByName(salted.select("gram", "class", "n", "place").join(whole, "gram"))
    # one row speaks for a class: its key finds the text, its sketch stands for the set
    speaker = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "mark", *_PARTS, "wide")).alias("m"))
    speaker = materialise(speaker.select("class", F.xxhash64("m.doc_id", "m.mark").alias("key"), *[F.col("m." + c).alias(c) for c in (*_PARTS, "wide")]), "join-speakers")
    keyed = texts.select("text", F.xxhash64("doc_id", "mark").alias("key"))

    def sketches(side: str) -> DataFrame:
        return speaker.select(F.col("class").alias(side), *[F.col(c).alias(side + c) for c in _PARTS])

    def bounded(an, bn):
        """Hamming distance bound of two sketches against the most that the sizes allow."""
        apart = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in _PARTS[1:]), F.bit_count(F.col("a" + _PARTS[0]).bitwiseXOR(F.col("b" + _PARTS[0]))))
        return apart * (100 + percent) <= (an + bn) * (100 - percent)

    def fits(an, bn, ap, bp):
        """Length and position bounds at a common n-gram: what may be common before it and after it."""
        room = F.least(ap, bp) + F.least(an - ap, bn - bp)
        return (100 * F.least(an, bn) >= percent * F.greatest(an, bn)) & ((100 + percent) * room >= percent * (an + bn))

    def links(pairs: DataFrame) -> DataFrame:
        """Pairs (``a`` < ``b``, sizes) once each, bounded by their sketches, then verified on the whole sets.

        Merge joins throughout: pairs and sets both grow with the corpus, and so the plan is the same at every size.
        """
        once = pairs.distinct().join(sketches("a").hint("merge"), "a").join(sketches("b").hint("merge"), "b").where(bounded(F.col("an"), F.col("bn"))).select("a", "b", "an", "bn")
        once = materialise(once, "join-pairs")

        def ends_of(some: DataFrame) -> DataFrame:
            return some.select(F.col("a").alias("class")).unionByName(some.select(F.col("b").alias("class"))).distinct()

        wide = materialise(speaker.select("class", "wide").join(ends_of(once).hint("merge"), "class"), "join-wide")
        x, y = (wide.select(F.col("class").alias(side), F.col("wide").alias(name)).hint("merge") for side, name in ("ax", "by"))
        once = materialise(once.join(x, "a").join(y, "b").mapInArrow(lambda b: _within(b, percent), "a long, b long"), "join-near")
        ends = ends_of(once)
        bits = spark.sparkContext.broadcast(_bits(ends.join(speaker.select("class", "key"), "class"), "key"))
        sets = materialise(keyed.mapInArrow(lambda b: _wanted_sets(b, n, bits), "class long, grams binary"), "join-grams")
        x = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
        y = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
        return materialise(once.join(x.hint("merge"), "a").join(y.hint("merge"), "b").mapInArrow(lambda b: _verified(b, percent), "a long, b long"), "join-links")

    def ordered(a, b, an, bn):
        first = F.col(a) < F.col(b)
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(first, F.col(an)).otherwise(F.col(bn)).alias("an"), F.when(first, F.col(bn)).otherwise(F.col(an)).alias("bn")]

    active, found = postings, None
    for turn in range(STARS + 1):
        if turn == 0:
            pairs = active.where("class <> star.class").where(fits(F.col("star.n"), F.col("n"), F.col("star.place"), F.col("place")))
            pairs = pairs.select("class", "n", F.col("star.class").alias("s_class"), F.col("star.n").alias("s_n")).select(*ordered("class", "s_class", "n", "s_n"))
        elif turn < STARS:
            stars = active.groupBy("gram").agg(F.min(F.struct("place", "class", "n", "label")).alias("s"))
            stars = materialise(stars.select("gram", *[F.col(f"s.{c}").alias("s_" + c) for c in ("class", "n", "place", "label")]), "join-stars")
            met = active.join(stars, "gram").where(F.col("label") != F.col("s_label"))
            pairs = met.where(fits(F.col("s_n"), F.col("n"), F.col("s_place"), F.col("place"))).select(*ordered("class", "s_class", "n", "s_n"))
        else:
            sketched = materialise(active.join(speaker.drop("key", "wide"), "class"), "join-sketched")
            names = {"class": "", "n": "n", "place": "p", "label": "l"} | {c: c for c in _PARTS}
            left, right = (sketched.select("gram", *[F.col(c).alias(side + short) for c, short in names.items()]) for side in "ab")
            sized = fits(F.col("an"), F.col("bn"), F.col("ap"), F.col("bp")) & bounded(F.col("an"), F.col("bn"))
            pairs = left.join(right, "gram").where((F.col("a") < F.col("b")) & (F.col("al") != F.col("bl")) & sized).select("a", "b", "an", "bn")
        new = links(pairs)
        found = new if found is None else found.unionByName(new)
        if turn == STARS:
            break
        labels = components(found).select(F.col("node").alias("class"), F.col("label").alias("new"))
        # the star is settled in its gram; a gram with one class left is done
        rest = active.where(F.col("size") > turn + 2)
        if turn == 0:
            rest = rest.where("class <> star.class")
        else:
            rest = rest.join(stars.select("gram", F.col("s_class").alias("class")), ["gram", "class"], "left_anti")
        rest = rest.join(labels, "class", "left").select("gram", "class", "n", "place", "size", F.coalesce("new", "class").alias("label"))
        rest = materialise(rest, "join-rest")
        open_ = rest.groupBy("gram").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("gram")
        active = materialise(rest.join(open_, "gram"), "join-active")
        if not active.limit(1).count():
            break
    return rows, found


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``mark`` (hash of its text), ``n_shingles``, ``component_id``, ``component_mark``.

    ``df`` has ``doc_id`` and ``text``; other columns are ignored. Documents link when 100 * |A and B| >= percent * |A or B|.
    A null, empty or blank text has no shingles, links with nothing and is its own component. A null doc_id
    takes part but is never the smallest; a component of only such rows has a null id. Repeated rows are rows of
    one class. ``component_mark`` tells components apart even where ids are null or repeated. An empty table gives no rows.
    """
    with arrow_batches(df.sparkSession):
        rows, found = join_classes(df, n, percent)
    labels = components(found).select(F.col("node").alias("class"), "label")
    classes = materialise(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first")), "join-classes")
    named = materialise(classes.join(labels, "class", "left").select("class", "first", F.coalesce("label", "class").alias("label")), "join-named")
    least = materialise(named.groupBy("label").agg(F.min("first").alias("component_id")), "join-components")
    of = materialise(named.join(least, "label").select("class", "component_id", "label"), "join-of")
    own = rows.where("class IS NULL").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_mark"))
    linked = rows.where("class IS NOT NULL").join(of, "class").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("component_mark"))
    return linked.unionByName(own)


def keep_one(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``df`` that stay when each component keeps its row with the smallest doc_id (one row of equal
    ones); documents without words all stay. Columns are those of ``df``."""
    marks = near_duplicates(df, n, percent).where("component_mark IS NULL OR doc_id <=> component_id")
    marks = materialise(marks.select(F.xxhash64("doc_id", "mark").alias("__key"), "doc_id", "mark", "component_mark").distinct(), "join-kept")
    first = marks.where("component_mark IS NOT NULL").groupBy("component_mark").agg(F.min(F.struct("doc_id", "mark", "__key")).alias("m"))
    stay = first.select("m.__key", F.lit(True).alias("__one")).unionByName(marks.where("component_mark IS NULL").select("__key", F.lit(False).alias("__one")))
    met = with_columns(df, __key=F.xxhash64("doc_id", F.xxhash64("text"))).join(materialise(stay, "join-stay"), "__key")
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__one"))
    return met.withColumn("__turn", turn).where("NOT __one OR __turn = 1").select(*[F.col(f"`{c}`") for c in df.columns])


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets reach a Jaccard similarity of 0.85."""
    return near_duplicates(documents(spark, folder), n=4, percent=85).select("doc_id", "n_shingles", "component_id")
