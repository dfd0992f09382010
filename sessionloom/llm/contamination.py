"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages they point to.

The test items are taken in blocks of bounded size; each block is sent to the tasks and all documents pass it whole, so no
document's text is shuffled. A first pass counts in how many documents each n-gram of the items occurs; an item's seeds
are its n-grams rare first, as many as it takes that a copy which keeps ``KEPT`` of them meets one. An item too short for an n-gram
is found where all its words stand in a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import tokens
from sessionloom.llm.common import documents, with_columns
from sessionloom.session import ship_by_value

ship_by_value(__name__)
ship_by_value(tokens.__name__)

GRAM = 4
#: Share of an item's n-grams that an edited copy must keep to be sure to meet a seed.
KEPT = 0.1
#: Alignment: a matching word scores 1, a replaced, missing or added one costs this much.
COST = 0.5
#: A copy scores at least this share of the item's words.
THRESHOLD = 0.5
#: Words of test items held by a task at a time; a larger benchmark takes more passes.
BLOCK_WORDS = 500_000
_FILTER = 1 << 20
#: Characters that are words by themselves, and the bytes that their codes start with.
IDEOGRAPH = r"([\p{Han}\p{Hiragana}\p{Katakana}])"
_LEADS = np.isin(np.arange(256), [*range(0xE3, 0xEA), 0xEF, 0xF0])

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()),
    T.StructField("end_word", T.LongType()), T.StructField("seeds", T.LongType()),
]))


def _align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the word after its end."""
    slope = COST * np.arange(1, len(words) + 1)
    above, best, end = np.zeros(len(words) + 1), 0.0, 0
    for word in item:
        here = np.maximum(above[:-1] + np.where(words == word, 1.0, -COST), above[1:] - COST)
        here = np.maximum(np.maximum.accumulate(np.maximum(here, 0.0) + slope) - slope, 0.0)
        above[1:] = here
        if (top := here.max()) > best:
            best, end = float(top), int(here.argmax()) + 1
    return best, end


def _folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, with blanks around every ideograph."""
    try:
        column = pc.utf8_lower(column)
    except pa.ArrowInvalid:  # broken bytes
        column = pa.array([None if b is None else b.decode("utf-8", "replace").lower() for b in column.cast(pa.binary()).to_pylist()], pa.string())
    data, starts = tokens.bytes_of(column)
    if _LEADS[data[starts[0] : starts[-1]]].any():
        column = pc.replace_substring_regex(column, IDEOGRAPH, r" \1 ")
    return column


def _whole(words, block):
    """Short test items whose words a document holds in a row."""
    found = []
    for n, (keys, owners) in block["short"].items():
        runs = tokens.joined(words, n)
        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        places = np.flatnonzero(keys[at] == runs)
        for k, first, times in zip(*(x.tolist() for x in np.unique(at[places], return_index=True, return_counts=True))):
            start = int(places[first])
            found += [{"item_id": int(block["ids"][i]), "score": 1.0, "start_word": start, "end_word": start + n, "seeds": times} for i in owners[k]]
    return found


def _matches(words, grams, block):
    """Test items that a document's words hold a copy of."""
    return _aligned(words, grams, block) + (_whole(words, block) if block["short"] else [])


def _aligned(words, grams, block):
    keys, owners, offsets = block["seed"], block["seed_item"], block["seed_at"]
    near = np.flatnonzero(block["bits"][grams & np.uint64(_FILTER - 1)]) if len(grams) else []
    if not len(near):
        return []
    lo, hi = np.searchsorted(keys, grams[near], "left"), np.searchsorted(keys, grams[near], "right")
    hits = [(owners[k], p - offsets[k], p) for p, a, b in zip(near.tolist(), lo.tolist(), hi.tolist()) for k in range(a, b)]
    hits.sort()
    found, at = [], 0
    while at < len(hits):
        item = hits[at][0]
        own = block["items"][item]
        upto, spans, slack = at, [], len(own) // 2 + 1
        while upto < len(hits) and hits[upto][0] == item:
            lo_, hi_ = max(0, hits[upto][1] - slack), min(len(words), hits[upto][1] + len(own) + slack)
            if spans and lo_ <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi_)
            else:
                spans.append([lo_, hi_])
            upto += 1
        best = max(((*_align(own, words[a:b]), a) for a, b in spans), key=lambda x: (x[0], -x[2]))
        if best[0] >= THRESHOLD * len(own):
            end = best[2] + best[1]
            _, back = _align(own[::-1], words[max(0, end - 2 * len(own)) : end][::-1])
            found.append({"item_id": int(block["ids"][item]), "score": round(best[0] / len(own), 6), "start_word": end - back, "end_word": end, "seeds": upto - at})
        at = upto
    return found


def _per_row(column):
    """Words and n-grams of each row."""
    for row, end, words, counts in tokens.word_hashes(_folded(column), tokens.PUNCTUATION):
        grams, at = tokens.joined(words, GRAM), 0
        for k in counts.tolist():
            yield words[at : at + k], grams[at : at + max(0, k - GRAM + 1)]
            at += k


def _counted(batches, keys, bits):
    total = np.zeros(len(keys), dtype=np.int64)
    for batch in batches:
        for _, grams in _per_row(batch.column("text")):
            near = grams[bits[grams & np.uint64(_FILTER - 1)]]
            if len(near):
                at = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
                total[np.unique(at[keys[at] == near])] += 1
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(total[full])], ["gram", "docs"])


def _bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(_FILTER, dtype=bool)
    bits[keys & np.uint64(_FILTER - 1)] = True
    return bits


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS):
    """Test items with words in id order, as lists of (item_id, word hashes) of at most ``limit`` words."""
    rows, size = [], 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        words = next(iter(tokens.word_hashes(_folded(pa.array([row[1]], pa.string())), tokens.PUNCTUATION)))[2]
        if not len(words):
            continue
        if rows and size + len(words) > limit:
            yield rows
            rows, size = [], 0
        rows.append((row[0], words))
        size += len(words)
    if rows:
        yield rows


def prepared(docs: DataFrame, rows) -> dict:
    """A block's seeds, chosen by how many documents hold each n-gram, and its items under ``GRAM`` words by their length."""
    grams = [tokens.joined(words, GRAM) for _, words in rows]
    short: dict[int, dict] = {}
    for i, (_, words) in enumerate(rows):
        if len(words) < GRAM:
            short.setdefault(len(words), {}).setdefault(tokens.joined(words, len(words))[0], []).append(i)
    short = {n: (np.array(sorted(d), dtype=np.uint64), [d[k] for k in sorted(d)]) for n, d in short.items()}
    keys = np.unique(np.concatenate(grams))
    shared = docs.sparkSession.sparkContext.broadcast((keys, _bits(keys)))
    counts = np.zeros(len(keys), dtype=np.int64)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for at, n in texts.mapInArrow(lambda b: _counted(b, *shared.value), "gram long, docs long").groupBy("gram").agg(F.sum("docs")).collect():
        counts[at] = n  # at most one row for each n-gram of the block
    seeds, owners, offsets = [], [], []
    for i, own in enumerate(grams):
        at = np.searchsorted(keys, own)
        keep = len(own) - int(np.ceil(KEPT * len(own))) + 1
        order = np.lexsort((own, counts[at]))[:keep]
        seeds.append(own[order])
        owners.append(np.full(len(order), i))
        offsets.append(order)
    seeds, owners, offsets = (np.concatenate(x) for x in (seeds, owners, offsets))
    order = np.argsort(seeds, kind="stable")
    return {"seed": seeds[order], "seed_item": owners[order], "seed_at": offsets[order], "bits": _bits(seeds), "items": [w for _, w in rows], "ids": [i for i, _ in rows], "short": short}


def find_copies(df: DataFrame, benchmark: DataFrame, column: str = "matches", limit: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with an array of matches (item_id, score, start_word, end_word, seeds), empty for clean documents.

    Words are lower-cased runs of letters, digits and characters beyond ASCII; an ideograph or kana is a word. The score is the best
    local alignment's as a share of the item's words. An item under ``GRAM`` words matches where all of them stand in a row (seeds: how
    often). Items with a null id or text, or without words, match nothing; a repeated item matches once for each of its rows. A null or empty text has no match; repeated documents are matched each. A column
    named as the new one is replaced. Empty tables are fine on either side.
    """
    plain = [c for c in df.columns if c.lower() != column.lower()]
    out = with_columns(df.select([F.col(f"`{c}`") for c in plain]), **{column: F.array().cast(MATCH)})
    fields = out.schema
    for rows in blocks(benchmark, limit):
        shared = df.sparkSession.sparkContext.broadcast(prepared(df, rows))

        def run(batches, shared=shared):
            for batch in batches:
                block = shared.value
                new = [_matches(words, grams, block) for words, grams in _per_row(batch.column("text"))]
                old = batch.column(column)
                if any(new):
                    old = pa.array([a + b for a, b in zip(old.to_pylist(), new)], old.type)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [old], plain + [column])

        out = out.mapInArrow(run, fields)
    return out


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, columns as they are."""
    return find_copies(df, benchmark, "__matches").where(F.size("__matches") == 0).drop("__matches")


def op9_seeded_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and test item it holds a copy of; clean documents have none."""
    texts = documents(spark, folder).select("doc_id", "text")
    found = find_copies(texts, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
