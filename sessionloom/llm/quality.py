"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is half of |sum v_i x_i|**2 - sum |v_i x_i|**2, so
a document costs one pass over its words. Every word occurrence is a feature of value 1 / (number of words).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import tokens
from sessionloom.llm.common import documents, with_columns
from sessionloom.session import ship_by_value

ship_by_value(__name__)
ship_by_value(tokens.__name__)

#: Labelled rows a fit uses at most: those with the smallest hashed ids.
FIT_ROWS = 12_000
BUCKETS = 1 << 14
RANK = 8
#: Passes over the learning rows: ``EPOCHS``, or as many as make ``STEPS`` steps of 256 rows where the rows are few.
EPOCHS, STEPS = 12, 300
THRESHOLD = 0.7
STATISTICS = (
    "log characters, log words, bytes per word, upper case, digits, symbols, exclamation marks, line ends, beyond ASCII, "
    "distinct words, distinct four-word runs, share of the commonest word, log of the n_chars column"
).split(", ")


@dataclass
class Machine:
    bias: float
    words: np.ndarray
    word_factors: np.ndarray
    stats: np.ndarray
    stat_factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _byte_classes() -> np.ndarray:
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    rows = [
        (code & 0xC0) != 0x80,  # one for each character
        (code >= 65) & (code <= 90),
        (code >= 48) & (code <= 57),
        (code > 32) & (code < 127) & ~letter & ~((code >= 48) & (code <= 57)) & ~np.isin(code, [44, 46]),
        code == 33,
        code == 10,
        code >= 128,
    ]
    return np.array(rows, dtype=np.int64)


def features(text: pa.Array, n_chars: pa.Array):
    """Slices: first row, row after the last, word buckets, words per row, statistics per row."""
    data, starts = tokens.bytes_of(text)
    given = np.nan_to_num(np.asarray(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64), nan=-1.0, posinf=-1.0)
    classes = _byte_classes()
    for row, end, words, counts in tokens.word_hashes(text):
        stats = np.zeros((end - row, len(STATISTICS)))
        runs, at = tokens.joined(words, 4), 0
        for i in range(end - row):
            own = data[starts[row + i] : starts[row + i + 1]]
            seen = classes @ np.bincount(own, minlength=256)
            k, size = int(counts[i]), max(1, len(own))
            kinds, times = np.unique(words[at : at + k], return_counts=True)
            spans = runs[at : at + max(0, k - 3)]
            stats[i] = (
                np.log1p(seen[0]), np.log1p(k), size / max(1, k), *(seen[1:] / size),
                len(kinds) / max(1, k), len(np.unique(spans)) / max(1, len(spans)), times.max() / k if k else 0.0,
                np.log1p(given[row + i] if given[row + i] >= 0 else seen[0]),
            )
            at += k
        yield row, end, (words & np.uint64(BUCKETS - 1)).astype(np.int64), counts, stats


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, counts[i] of them for i (0 where there are none)."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def scores(m: Machine, buckets: np.ndarray, counts: np.ndarray, stats: np.ndarray):
    """Probabilities, and the parts a gradient needs."""
    x = np.clip((stats - m.mean) / m.scale, -5, 5)
    each = 1.0 / np.maximum(counts, 1)
    v = m.word_factors[buckets]
    total = _sums(v, counts) * each[:, None] + x @ m.stat_factors
    squares = _sums((v * v).sum(1), counts) * each**2 + (x * x) @ (m.stat_factors**2).sum(1)
    line = _sums(m.words[buckets], counts) * each + x @ m.stats + m.bias
    z = line + 0.5 * ((total * total).sum(1) - squares)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), x, each, total


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Machine | None:
    """Machine from (buckets, statistics, label) rows by Adam on the logistic loss; none without rows."""
    if not rows:
        return None
    stats = np.array([r[1] for r in rows])
    labels = np.array([r[2] for r in rows], dtype=np.float64)
    draw = np.random.RandomState(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(
        float(np.log(prior / (1 - prior))), np.zeros(BUCKETS), draw.normal(0, 0.05, (BUCKETS, RANK)), np.zeros(stats.shape[1]),
        draw.normal(0, 0.05, (stats.shape[1], RANK)), stats.mean(0), np.maximum(stats.std(0), 1e-6),
    )
    names = ("words", "word_factors", "stats", "stat_factors")
    rates = {"words": 0.05, "word_factors": 0.02, "stats": 0.03, "stat_factors": 0.02}
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    step, batches = 0, -(-len(rows) // 256)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        order = draw.permutation(len(rows))
        for begin in range(0, len(order), 256):
            part = order[begin : begin + 256]
            buckets = np.concatenate([rows[i][0] for i in part])
            counts = np.array([len(rows[i][0]) for i in part])
            p, x, each, total = scores(m, buckets, counts, stats[part])
            g = (p - labels[part]) / len(part)
            owner = np.repeat(np.arange(len(part)), counts)
            ge = (g * each)[owner]
            push = {
                "words": np.bincount(buckets, ge, BUCKETS) + 1e-5 * m.words,
                "stats": x.T @ g + 1e-4 * m.stats,
                "stat_factors": x.T @ (g[:, None] * total) - ((x * x).T @ g)[:, None] * m.stat_factors + 1e-4 * m.stat_factors,
            }
            vg = ge[:, None] * (total[owner] - m.word_factors[buckets] * each[owner][:, None])
            push["word_factors"] = np.stack([np.bincount(buckets, vg[:, f], BUCKETS) for f in range(RANK)], 1)
            step += 1
            m.bias -= 0.05 * g.sum()
            for k in names:
                first[k] += 0.1 * (push[k] - first[k])
                second[k] += 0.001 * (push[k] ** 2 - second[k])
                setattr(m, k, getattr(m, k) - rates[k] * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return m


def _featured(batches):
    for batch in batches:
        ids, blobs, stats = [], [], []
        label = batch.column("quality")
        for row, end, buckets, counts, values in features(batch.column("text"), batch.column("n_chars")):
            at = np.concatenate(([0], np.cumsum(counts)))
            for i in range(end - row):
                blobs.append(buckets[at[i] : at[i + 1]].astype(np.uint16).tobytes())
                stats.append(values[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(stats, pa.binary()), label], ["buckets", "stats", "quality"])


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Machine from at most ``FIT_ROWS`` labelled documents of the learning folds (CRC-32 of the id, modulo 4, not 2).

    A label that is null is no label; of contradicting labels of one document the lower one counts.
    """
    learn = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    )
    texts = _inputs(docs).join(F.broadcast(learn), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    found = texts.select("text", "n_chars", "quality").mapInArrow(_featured, "buckets binary, stats binary, quality int").collect()
    found.sort(key=lambda r: (bytes(r[1]), bytes(r[0])))
    return fit([(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(s, np.float64), q) for b, s, q in found])


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def score_rows(df: DataFrame, machine: Machine | None, column: str = "score") -> DataFrame:
    """All columns of ``df`` and its score from ``text`` (null counts as empty) and ``n_chars`` (null or absent: the text's length).

    Scores lie in 0..1; without a machine (no labels) all are 1.0. A column of that name is replaced.
    """
    df = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() != column.lower()])
    if machine is None:
        return df.withColumn(column, F.lit(1.0))
    shared = df.sparkSession.sparkContext.broadcast(machine)
    inner = with_columns(df, __text=F.col("text").cast("string"), __n=F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double"))
    plain = [c for c in df.columns]

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, end, buckets, counts, stats in features(batch.column("__text"), batch.column("__n")):
                out[row:end] = scores(shared.value, buckets, counts, stats)[0]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + [pa.array(out)], plain + [column])

    return inner.mapInArrow(run, T.StructType(df.schema.fields + [T.StructField(column, T.DoubleType())]))


def op4_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score; trained on the learning folds of ``labels``."""
    docs = documents(spark, folder)
    machine = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_rows(docs.select("doc_id", "text", "n_chars"), machine).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
