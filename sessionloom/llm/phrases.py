"""Phrase collocations by best-first growth of prefixes, one frontier per language.

The count of a prefix bounds every phrase that grows from it: cut after its first word w, a phrase with a occurrences scores at most
1000 * a * n / (f(w) * a) = 1000 * n / f(w), so rare first words can score highest and are grown first. A round grows the rarest first
words still to grow (``SHARE`` of their occurrences): pairs, then windows of up to five words
behind frequent pairs, then exact counts of all their prefixes. A language is settled when its 2000th surviving score is above the bound of
every word not yet grown (strictly, so ties are inside), or when nothing is left to grow. Until then, ends of phrases that start with a word not
grown stand with the least and the most that they can count; those that still matter at the end are counted in one more pass.

Tasks find the words of whole texts with numpy and count within slices first. Pairs are counted by a 64-bit number, which only selects
where windows start and end; phrases and their counts are text and exact. Bit filters (16 bits an entry, 16 MiB at
most) only spare rows: what numbers and filters let through by mistake is dropped by its count or by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm import tokens
from sessionloom.llm.common import arrow_batches, documents
from sessionloom.llm.tokens import _VALUE, bytes_of, mixed, powers
from sessionloom.session import materialise, ship_by_value

ship_by_value(__name__)
ship_by_value(tokens.__name__)

LEAST = 100
LONGEST = 5
TOP = 2000
#: A round grows the rarest words that hold this share of the occurrences still to grow.
SHARE = 0.5
#: Largest bit filter: 2**27 bits.
MOST_BITS = 27
#: Bytes of text that are counted together.
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _split(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of a stretch of bytes, where each starts, and how many separators stand before it."""
    n, kind = len(data), _KIND[data]
    inside = kind == 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    return words, start, np.cumsum(kind == 2, dtype=np.int64)[start]


class Slice:
    """Words of some rows: ``word`` numbers the distinct (language, word) pairs; ``same`` tells whether the next word continues the piece."""

    def __init__(self, words: pa.ChunkedArray, row: np.ndarray, separators: np.ndarray, codes: np.ndarray, names: pa.Array):
        coded = words.combine_chunks().dictionary_encode()
        self.names, k = names, max(1, len(names))
        self.word, self.key = pd.factorize(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * k + codes[row])
        self.text = coded.dictionary.take(pa.array(self.key // k))
        self.lang = self.key % k
        self.same = np.append((row[1:] == row[:-1]) & (separators[1:] == separators[:-1]), False)

    def langs(self, of: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.lang[of]))

    def hashes(self) -> np.ndarray:
        return hashed(self.text, self.names.take(pa.array(self.lang)))


def _numbers(texts: pa.Array) -> np.ndarray:
    """A 64-bit number per text."""
    data, starts = bytes_of(texts)
    lo, hi = int(starts[0]), int(starts[-1])
    up, down = powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=total[1:])
    at = starts - lo
    return mixed((total[at[1:]] - total[at[:-1]]) * down[at[:-1]])


def hashed(words: pa.Array, langs: pa.Array) -> np.ndarray:
    """A 64-bit number per (language, word), for filters only: a clash costs rows, never results."""
    return mixed(_numbers(words) + mixed(_numbers(langs) + np.uint64(1)))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first + mixed(second + np.uint64(1)))


def slices(batches) -> Iterator[Slice]:
    """All words of all rows, about ``SLICE`` bytes of text at a time; a longer text is split in stretches and held as one slice."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes, names = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.dictionary
        data, starts = bytes_of(batch.column("text"))
        row, rows = 0, len(starts) - 1
        while row < rows:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + SLICE, "right")) - 1)
            at, hi, words, owner, separators, before = int(starts[row]), int(starts[end]), [], [], [], 0
            while at < hi:
                cut = min(hi, at + SLICE)
                while cut < hi and not _KIND[data[cut]]:
                    free = np.flatnonzero(_KIND[data[cut : min(hi, cut + SLICE)]])
                    cut = cut + int(free[0]) if len(free) else min(hi, cut + SLICE)
                bounds = starts[row:end] - at
                found, start, seps = _split(data[at:cut], bounds[(bounds >= 0) & (bounds <= cut - at)])
                words.append(found)
                # an empty row and its successor start at the same byte: the word belongs to the last row that starts there
                owner.append(row + np.searchsorted(starts[row : end + 1], start + at, "right") - 1)
                separators.append(seps + before)
                before += int(np.count_nonzero(_KIND[data[at:cut]] == 2))
                at = cut
            if words and sum(map(len, words)):
                yield Slice(pa.chunked_array(words), np.concatenate(owner), np.concatenate(separators), codes, names)
            row = end


def _out(**columns) -> pa.RecordBatch:
    made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_large_string(c.type) else c for c in made], list(columns))


#: Rows that a task gathers before it adds up equal ones.
GATHERED = 1 << 17
#: Least size of the filter of phrase ends, as a power of 2 (1 MiB).
END_BITS = 23


def _gathered(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with equal ones added up (``n``) across the slices of a task, as far as ``GATHERED`` rows go."""
    held: list[pa.RecordBatch] = []
    for batch in made:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            held = _added(held)
            if sum(map(len, held)) >= GATHERED // 2:
                yield from held
                held = []
    yield from _added(held)


def _added(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    if not batches:
        return []
    table = pa.Table.from_batches(batches)
    names = table.column_names
    return table.group_by(names[:-1]).aggregate([("n", "sum")]).rename_columns(names).combine_chunks().to_batches()


def _words(batches):
    """Occurrences of every word, and of all words together (a null word)."""
    for s in slices(batches):
        n = np.bincount(s.word, minlength=len(s.key))
        yield _out(lang=s.langs(np.arange(len(s.key))), word=s.text, n=n)
        total = np.bincount(s.lang, weights=n, minlength=len(s.names)).astype(np.int64)
        used = np.flatnonzero(total)
        yield _out(lang=s.names.take(pa.array(used)), word=pa.nulls(len(used), pa.string()), n=total[used])


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each number."""
    place = h >> np.uint64(64 - int(math.log2(len(bits) * 8)))
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pairs(batches, grown, frequent):
    """Numbers of the pairs of a word to grow and a frequent word, with their occurrences."""
    for s in slices(batches):
        h = s.hashes()
        may, starts = marked(frequent.value, h), marked(grown.value, h)
        at = np.flatnonzero(s.same[:-1] & starts[s.word[:-1]] & may[s.word[1:]])
        code, pairs = pd.factorize(paired(h[s.word[at]], h[s.word[at + 1]]))
        yield _out(pair=pairs.astype(np.uint64).view(np.int64), n=np.bincount(code, minlength=len(pairs)))


def _windows(batches, starts, links, waiting, frequent):
    """Two to five frequent words behind every marked pair, with the word before them.

    A window ends, and the word before is left out (null), where the two words in a row are known to be rare: no frequent phrase
    goes on there. Pairs that begin with a word still waiting to be grown are not known.
    """
    for s in slices(batches):
        h, n = s.hashes(), len(s.word)
        ok = marked(frequent.value, h)[s.word]
        pair = paired(h[s.word[:-1]], h[s.word[1:]])
        both = s.same[:-1] & ok[:-1] & ok[1:]
        linked = np.append(both & (marked(links.value, pair) | marked(waiting.value, h)[s.word[:-1]]), False)
        at = np.flatnonzero(both & marked(starts.value, pair))
        if not len(at):
            continue
        columns = [np.where((at > 0) & linked[at - 1], s.word[at - 1], -1), s.word[at], s.word[at + 1]]
        goes = np.ones(len(at), dtype=bool)
        for j in range(2, LONGEST):
            to = np.minimum(at + j, n - 1)
            goes = goes & (at + j < n) & linked[to - 1]
            columns.append(np.where(goes, s.word[to], -1))
        names = [f"c{j}" for j in range(len(columns))]
        met = pa.table([pa.array(c) for c in columns], names).group_by(names).aggregate([([], "count_all")]).combine_chunks()
        ids = [np.asarray(met[c].combine_chunks()) for c in names]
        texts = [s.text.take(pa.array(i, mask=i < 0)) for i in ids]
        phrase = pc.binary_join_element_wise(*texts[1:], pa.scalar(" ", pa.large_string()), null_handling="skip")
        length = sum((i >= 0).astype(np.int32) for i in ids[1:])
        yield _out(lang=s.langs(ids[1]), prev=texts[0], phrase=phrase, size=length, n=np.asarray(met["count_all"].combine_chunks()))


WINDOW = "lang string, prev string, phrase string, size int, n long"


def _ends(batches, wanted, frequent):
    """Occurrences of wanted phrases of two to four words."""
    for s in slices(batches):
        h, n = s.hashes(), len(s.word)
        ok = marked(frequent.value, h)[s.word]
        linked = np.append(s.same[:-1] & ok[:-1] & ok[1:], False)
        at, number, size = np.flatnonzero(ok), h[s.word[ok]], 1
        while size < LONGEST - 1:
            goes = linked[at + size - 1]
            at = at[goes]
            number, size = paired(number[goes], h[s.word[at + size]]), size + 1
            hit = at[marked(wanted.value, number)]
            if len(hit):
                names = [f"c{j}" for j in range(size)]
                met = pa.table([pa.array(s.word[hit + j]) for j in range(size)], names).group_by(names).aggregate([([], "count_all")]).combine_chunks()
                ids = [np.asarray(met[c].combine_chunks()) for c in names]
                phrase = pc.binary_join_element_wise(*[s.text.take(pa.array(i)) for i in ids], pa.scalar(" ", pa.large_string()))
                yield _out(lang=s.langs(ids[0]), phrase=phrase, n=np.asarray(met["count_all"].combine_chunks()))


def _numbered(batches):
    """Numbers of words and of phrases; a phrase's is its first pair's, carried on word by word."""
    for batch in batches:
        cut = pc.split_pattern(batch.column("phrase"), " ")
        size = np.asarray(pc.list_value_length(cut))
        each = hashed(cut.flatten(), batch.column("lang").take(pa.array(np.repeat(np.arange(len(size)), size))))
        first = np.cumsum(size) - size
        number = each[first]
        for j in range(1, int(size.max(initial=1))):
            more = size > j
            number[more] = paired(number[more], each[first[more] + j])
        yield _out(number=number.view(np.int64))


def numbers_of(entries: DataFrame) -> DataFrame:
    return entries.select("lang", "phrase").mapInArrow(_numbered, "number long")


def bit_filter(numbers: DataFrame, least_bits: int = 15):
    """Broadcast bits of a column of numbers: 16 bits an entry, at least 4 KiB (or what ``least_bits`` says), at most 16 MiB."""
    spark = numbers.sparkSession
    bits = min(MOST_BITS, max(least_bits, math.ceil(math.log2(16 * max(1, numbers.count())))))
    place = F.shiftrightunsigned("number", 64 - bits) + 1
    parts = numbers.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for part, held in parts.toLocalIterator():
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(held, np.uint8)
    return spark.sparkContext.broadcast(out)


def _head(phrase: str, words: Column | str) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.col(words) if isinstance(words, str) else words)


def _prefixes(windows: DataFrame) -> DataFrame:
    """Every window as its prefixes of two and more words."""
    each = windows.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size"))))
    return each.select("lang", "prev", "n", "m", _head("phrase", "m").alias("phrase"))


class _Round:
    """What the tasks of one round look up, and the numbers of all pairs found frequent so far."""

    def __init__(self, docs: DataFrame, ready: DataFrame, waiting: DataFrame, pairs: list[DataFrame], frequent, least: int):
        self.docs, self.ready, self.least, self.frequent = docs, ready, least, frequent
        grown = bit_filter(numbers_of(ready))
        self.waiting = bit_filter(numbers_of(waiting))
        counts = docs.mapInArrow(lambda b: _gathered(_pairs(b, grown, frequent)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("f"))
        pairs.append(materialise(counts.where(F.col("f") >= least).select(F.col("pair").alias("number")), "phrase-pairs"))
        self.starts, self.links = bit_filter(pairs[-1]), bit_filter(reduce(DataFrame.unionByName, pairs))
        grown.unpersist()

    def windows(self) -> DataFrame:
        starts, links, waiting, frequent = self.starts, self.links, self.waiting, self.frequent
        return self.docs.mapInArrow(lambda b: _gathered(_windows(b, starts, links, waiting, frequent)), WINDOW)

    def grams(self) -> DataFrame:
        """All frequent phrases that start with a grown word: ``lang``, ``phrase``, ``m`` (words), ``f``, ``left`` (largest count with a word before it)."""
        by_prev = _prefixes(self.windows()).groupBy("lang", "phrase", "m", "prev").agg(F.sum("n").alias("n"))
        grams = by_prev.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("f"), F.max(F.when(F.col("prev").isNotNull(), F.col("n"))).alias("left"))
        # a pair that a filter let through by mistake is rare itself or starts with a word of another class
        first = self.ready.select("lang", F.col("phrase").alias("first"))
        grams = grams.where(F.col("f") >= self.least).withColumn("first", _head("phrase", F.lit(1)))
        return materialise(grams.join(first, ["lang", "first"]).drop("first"), "phrase-grams")


def _cuts(grams: DataFrame) -> DataFrame:
    """All cuts (``k``, ``head``, ``rest``) of the phrases of ``grams`` that no longer phrase takes the place of."""
    longer = grams.where("m > 2").select("lang", _head("phrase", F.col("m") - 1).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("right"))
    inside = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))) >= F.col("f")
    alive = grams.join(longer, ["lang", "phrase"], "left").where((F.col("m") == LONGEST) | ~inside).select("lang", "phrase", "m", F.col("f").alias("a"))
    cuts = alive.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("head", _head("phrase", "k"))
    return materialise(cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)")), "phrase-cuts")


def _score(r: str) -> Column:
    return F.expr(f"(1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST({r} AS DECIMAL(18, 0)))")


def _scored(cuts: DataFrame, known: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Every cut with ``l``, ``r`` and the range [``low``, ``high``] of its score.

    The rest of a phrase may start with a word that is not grown yet, and its count is then not known: it lies between the phrase's own
    count and that of its first word.
    """
    out = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    out = out.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "left")
    first = words.select("lang", F.col("phrase").alias("next"), F.col("f").alias("most"))
    out = out.withColumn("next", _head("rest", F.lit(1))).join(first, ["lang", "next"]).join(totals, "lang")
    out = out.withColumns({"r_high": F.coalesce("r", "most"), "r_low": F.coalesce("r", "a")})
    return materialise(out.select("lang", "phrase", "m", "a", "k", "rest", "l", "r", "n", _score("r_high").alias("low"), _score("r_low").alias("high")), "phrase-scores")


def _frontier(words: DataFrame, state: DataFrame, share: float) -> DataFrame:
    """The next frequency class [low, high) of each language in ``state`` (``all``: whatever is left)."""
    left = words.join(state, "lang").where("f >= low").groupBy("lang", "n", "most", "low", "all", F.floor(F.log2("f")).alias("class")).agg(F.sum("f").alias("f"))
    upto = F.sum("f").over(Window.partitionBy("lang").orderBy("class"))
    cut = left.withColumns({"upto": upto, "whole": F.sum("f").over(Window.partitionBy("lang"))}).where(F.col("upto") >= share * F.col("whole"))
    high = F.when(F.col("all"), F.col("most") + 1).otherwise(F.least(F.pow(F.lit(2.0), F.min("class") + 1).cast("long"), F.col("most") + 1))
    return materialise(cut.groupBy("lang", "n", "most", "low", "all").agg(high.alias("high")), "phrase-state")


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP, share: float = SHARE) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's best phrases (columns ``text`` and ``lang`` of ``df``).

    A null language is ``und``, a null or empty text has no words, repeated rows count repeatedly, other columns are ignored and an empty
    table gives no rows. Texts of any length are read whole. Phrases with equal scores follow their count, then their bytes;
    none is lost to a tie except behind the last rank. Counts up to 10**17 are exact.
    """
    docs = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with arrow_batches(df.sparkSession):
        return _collocations(docs, least, top, share)


def _collocations(docs: DataFrame, least: int, top: int, share: float) -> DataFrame:
    counts = docs.mapInArrow(lambda b: _gathered(_words(b)), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = materialise(counts.where((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counts.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "f")
    frequent = bit_filter(numbers_of(words))
    most = words.groupBy("lang").agg(F.max("f").alias("most"))
    start = totals.join(most, "lang").select("lang", "n", "most", F.lit(0).cast("long").alias("low"), F.lit(False).alias("all"))
    state = _frontier(words, start, share)
    pairs: list[DataFrame] = []
    grams: list[DataFrame] = []
    cuts: list[DataFrame] = []
    scored = None
    while state.limit(1).count():
        ready = materialise(words.join(state.select("lang", "low", "high"), "lang").where("f >= low AND f < high").select("lang", "phrase", "f"), "phrase-ready")
        waiting = words.join(state.select("lang", "high"), "lang").where("f >= high")
        turn = _Round(docs.join(state.select("lang"), "lang", "left_semi"), ready, waiting, pairs, frequent, least)
        grams.append(turn.grams())
        cuts.append(_cuts(grams[-1]))
        known = reduce(DataFrame.unionByName, [words, *[g.select("lang", "phrase", "f") for g in grams]])
        scored = _scored(reduce(DataFrame.unionByName, cuts), known, words, totals)
        # settled: enough phrases that score above the bound of all words still to grow, whatever is not known, or no such word
        bound = state.select("lang", F.expr("(1000 * CAST(n AS DECIMAL(30, 0))) div CAST(high AS DECIMAL(20, 0))").alias("bound"))
        held = scored.groupBy("lang", "phrase").agg(F.min("low").alias("low")).join(bound, "lang")
        held = held.groupBy("lang").agg(F.count_if(F.col("low") > F.col("bound")).alias("above"), F.count("*").alias("have"))
        open_ = state.join(held, "lang", "left").where((F.col("high") <= F.col("most")) & (F.coalesce("above", F.lit(0)) < top))
        # while the wanted number is not even there, no bound can settle anything: all that is left is grown next
        rest = open_.select("lang", "n", "most", F.col("high").alias("low"), (F.coalesce("have", F.lit(0)) < top).alias("all"))
        state = _frontier(words, materialise(rest, "phrase-open"), share)
    if scored is None:
        return totals.where("false").selectExpr("lang", "1 AS rank", "lang AS phrase", "n AS a", "n AS l", "n AS r", "n", "n AS score")
    # only what may reach the last rank needs exact counts of the ends not grown
    ranges = scored.groupBy("lang", "phrase").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    nth = ranges.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low")))).where(F.col("place") == top)
    hopeful = ranges.join(nth.select("lang", F.col("low").alias("least")), "lang", "left").where("least IS NULL OR high >= least")
    best = materialise(scored.join(hopeful.select("lang", "phrase"), ["lang", "phrase"]), "phrase-hopeful")
    ends = materialise(best.where("r IS NULL").select("lang", F.col("rest").alias("phrase")).distinct(), "phrase-ends")
    if ends.limit(1).count():
        # every phrase of the corpus is looked up: what a crowded filter lets through by mistake would outnumber the ends
        marks = bit_filter(numbers_of(ends), END_BITS)
        counts = docs.mapInArrow(lambda b: _gathered(_ends(b, marks, frequent)), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("end"))
        counts = materialise(counts.join(ends, ["lang", "phrase"]), "phrase-end-counts")
        best = best.join(counts.withColumnRenamed("phrase", "rest"), ["lang", "rest"], "left").withColumn("r", F.coalesce("r", "end"))
        marks.unpersist()
    frequent.unpersist()
    found = best.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(_score("r").alias("score"), "k", "l", "r")).alias("cut"))
    found = materialise(found.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "phrase-found")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_best_first_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations(documents(spark, folder))
