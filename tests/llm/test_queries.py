"""Registered queries whose rows SQL cannot give, against plain versions."""

import math
import zlib

import pyarrow.parquet as pq
import xxhash

from sessionloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


def documents():
    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def drawn(*values):
    """The engine's 64-bit hash of long values."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return signed(h)


def place(number, n, seed=17):
    """A row number's place under the permutation, by walking cycles one step at a time."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    while True:
        halves = [number % a, number // a]
        for i in range(6):
            size = (a, b)[i % 2]
            halves[i % 2] = (halves[i % 2] + drawn(seed, i, halves[1 - i % 2]) % size) % size
        number = halves[0] + halves[1] * a
        if number < n:
            return number


def test_op6_against_a_plain_permutation(spark):
    rows = [(d["doc_id"], zlib.crc32((d["text"] or "").encode()), len((d["text"] or "").encode()) + 1) for d in documents()]
    want = []
    for number, (doc, crc, size) in enumerate(sorted(rows)):
        y = place(number, len(rows))
        want.append((doc, size, crc, "rows", y % 8, y // 8, None))
    got = queries.QUERIES["op6_feistel_shards"](spark, FOLDER).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for shard in range(8):
        slots = sorted(w[5] for w in want if w[4] == shard)
        assert slots == list(range(len(slots)))


def test_op4_folds_and_predictions(spark):
    rows = queries.QUERIES["op4_factorisation_machine"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in documents())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_wide_sketches_tell_long_texts_apart():
    """Sets of thousands of n-grams that share a part only are not fetched; similar ones always are, whatever their sizes."""
    import numpy as np
    import pyarrow as pa

    from sessionloom.llm import ngram_join

    draw = np.random.RandomState(3)
    long_ = [np.unique(draw.randint(0, 1 << 62, 4000)) for _ in range(4)]
    pairs = [(a, np.unique(np.concatenate([a[:1500], b[:2500]]))) for a, b in zip(long_, long_[1:])]
    similar = []
    for n in (1, 5, 60, 66, 1000, 1025, 4097):
        own = np.unique(draw.randint(0, 1 << 62, n))
        similar.append((own, own[: len(own) - len(own) // 7]))
    each = pairs + [(a, b) for a, b in similar if 100 * len(b) >= 85 * len(a)]
    columns = [[i for i in range(len(each))], [100 + i for i in range(len(each))], [len(a) for a, _ in each], [len(b) for _, b in each]]
    sketches = [[ngram_join.wide_sketch(side) for side in sides] for sides in zip(*each)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns + sketches], ["a", "b", "an", "bn", "x", "y"])
    (kept,) = ngram_join._within([batch], 85)
    assert kept.column("a").to_pylist() == list(range(len(pairs), len(each)))


def test_few_phrase_ends_let_few_others_through(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from sessionloom.llm import phrases

    ends = spark.range(367).select(F.xxhash64("id").alias("number"))
    bits = phrases.bit_filter(ends, phrases.END_BITS).value
    assert phrases.marked(bits, np.array([r[0] for r in ends.collect()], dtype=np.int64).view(np.uint64)).all()
    others = np.random.RandomState(5).randint(0, 1 << 63, 1_000_000).astype(np.uint64) * np.uint64(2)
    assert phrases.marked(bits, others).sum() < 500  # 11,000 in the smallest filter
