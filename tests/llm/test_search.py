"""Graph search, shared-list negatives and phrase growth against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import connect, differences
from pyspark.sql import Row

from sessionloom.llm import negatives, neighbours, oracles, phrases

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string, extra int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def odd_vectors(seed=3, n=420, dim=6):
    """Ties, repeats, equal vectors under many ids, and rows that take no part."""
    draw = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        x = np.round(draw.normal(size=dim), 1) if i % 3 else np.array([0.5, -0.25, 1, 0, 0, 0.125])
        rows.append((i, [float(v) for v in x], int(draw.randint(0, 3))))
    rows += [(100, [0.5] * dim, 1), (100, [0.5] * dim, 1), (7, rows[7][1], 2)]
    rows += [(200_000, None, 1), (200_100, [0.0] * dim, 1), (200_200, [float("nan")] * dim, 0), (200_300, [float("inf")] * dim, 0), (200_400, [None] * dim, 0), (None, [0.1] * dim, 1)]
    rows += [(200_500, [0.5] * dim, None), (200_600, [], 1), (200_700, [1.0, 2.0], 1)]
    return rows


# --- op11 --------------------------------------------------------------------------------


def true_nearest(rows, every=20, k=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and np.abs(v).max() > 0]
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            found = sorted((-float(w @ v), j) for b, (j, w) in enumerate(good) if b != at and len(w) == len(v))
            out.append((i, [(j, -s) for s, j in found[:k]]))
    return out


def test_search_small_and_odd(spark):
    rows = odd_vectors()
    got = defaultdict(list)
    for r in neighbours.nearest(table(spark, rows)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = true_nearest(rows)
    assert set(got) == {i for i, found in want if found}
    held = total = 0
    for i, found in want:
        if [j for j, _ in want].count(i) > 1:
            continue
        mine = sorted(got.get(i, []))
        assert [r for r, *_ in mine] == list(range(1, len(found) + 1))
        assert all(a >= b - 1e-12 for (_, _, a), (_, _, b) in zip(mine, mine[1:]))
        assert i not in [j for _, j, _ in mine] or i in (100, 7)
        held += len({j for _, j, _ in mine} & {j for j, _ in found})
        total += len(found)
    assert held / total > 0.97


def test_search_few_candidates_returns_all(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(12)]
    got = neighbours.nearest(table(spark, rows)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(11, 0, -1)) and {r.query_id for r in got} == {0}
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(0, [0.0], 1), (20, None, 1)])).count() == 0


def test_search_recall_on_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in neighbours.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    held = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = sorted(got[ids[i]])
        assert len(mine) == 20
        assert all(abs(s - float(x[i] @ x[np.flatnonzero(ids == j)[0]])) < 1e-12 for _, j, s in mine)
        held += len(best & {j for _, j, _ in mine})
    assert held / (20 * len(got)) > 0.95


def test_pruned_edges_are_diverse():
    draw = np.random.RandomState(1)
    points = draw.normal(size=(300, 8)).astype(np.float32)
    graph, start = neighbours.build_graph(points, degree=8, beam=20)
    assert ((graph >= 0).sum(1) > 0).all()
    edges = neighbours.robust_prune(points, np.arange(300), np.tile(np.arange(300), (300, 1)), 8, 1.2)
    for i in range(300):
        kept = edges[i][edges[i] >= 0]
        d = ((points[kept] - points[i]) ** 2).sum(1)
        assert (np.diff(d) >= 0).all() and i not in kept
        for a in range(len(kept)):
            for b in range(a):
                assert 1.44 * ((points[kept[a]] - points[kept[b]]) ** 2).sum() > d[a] - 1e-5
    seen, todo = {start}, [start]
    while todo:
        for j in graph[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) == 300


# --- op12 --------------------------------------------------------------------------------


def true_negatives(rows, every=100):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v:
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if np.isfinite(x).all():
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(q) for q in np.floor(256 * x)]))
    out = []
    for at, (i, label, q) in enumerate(good):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, w)), j, other == label, b) for b, (j, other, w) in enumerate(good) if b != at and len(w) == len(q)]
        scored.sort()
        for p, j, alike, _ in [s for s in scored if s[2]][:5]:
            inside = [(-s, n) for s, n, same, _ in scored if not same and -80 * p <= -100 * s <= -100 * p]
            out += [(i, j, rank, n, -p, s) for rank, (s, n) in enumerate(inside[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 8])
def test_negatives_odd(spark, monkeypatch, seed):
    rows = odd_vectors(seed)
    got = sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows)).collect())
    assert got == true_negatives(rows)


def test_negatives_blocks_chunks_and_large_numbers(spark):
    """Lists of several blocks, several anchors a chunk, and products beyond 53 bits."""
    draw = np.random.RandomState(2)
    rows = [(i, [float(v) for v in draw.normal(size=4) * (40_000 if i % 2 else 1)], int(draw.randint(0, 2))) for i in range(1500)]
    df = table(spark, rows)
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, every=50).collect()) == true_negatives(rows, 50)


def test_negatives_empty(spark):
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    assert negatives.hard_negatives(table(spark, [(100, [1.0], 1)])).count() == 0


def test_one_direction_for_a_third_of_all(spark):
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [float(i % 11), 1.0, -1.0], i % 4) for i in range(3000)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(table(spark, rows)).collect())
    assert got == true_negatives(rows)


# --- op13 --------------------------------------------------------------------------------


def true_phrases(docs, least, top):
    words, counts = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        longer = {m: [g for g, c in f.items() if len(g) == m and c >= least] for m in range(3, 6)}
        dropped = {s for m in longer for g in longer[m] for n in range(2, m) for i in range(m - n + 1) if f[s := g[i : i + n]] <= f[g]}
        for g, a in f.items():
            if len(g) > 1 and a >= least and g not in dropped:
                score, k = min((1000 * a * words[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, words[lang], -s))
    return sorted(out)


def made_up(seed, n=250):
    draw = random.Random(seed)
    common = [f"w{i}" for i in range(30)] + ["É", "日本", "Don't"]
    fixed = ["New York City Hall opens", "a\tb  c", "x x x x x x", "to be or not to be", "日本 の 東京"]
    docs = [(None, None), ("en", ""), ("fr", None), ("en", "..,,\n\n"), ("de", "one"), (None, "x x x x, x x.x x\x0bx x")]
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(1, 12)):
            parts.append(draw.choice(fixed) if draw.random() < 0.3 else draw.choice(common))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n", "!"]))
        docs.append((draw.choice(["en", "en", "fr", None]), "".join(parts)))
    return docs + docs[:40]


@pytest.mark.parametrize("seed, least, top, share", [(1, 5, 40, 0.5), (2, 2, 15, 0.1), (3, 8, 1000, 0.5), (4, 3, 5, 0.05)])
def test_phrases(spark, seed, least, top, share):
    docs = made_up(seed)
    df = spark.createDataFrame([Row(text=t, lang=lang, n="c", m=1, f=2, phrase="p", low=3) for lang, t in docs], "text string, lang string, n string, m int, f int, phrase string, low int")
    got = sorted(tuple(r) for r in phrases.collocations(df.repartition(3), least, top, share).collect())
    assert got == true_phrases(docs, least, top)


def test_phrases_long_text(spark, monkeypatch):
    """A text longer than a slice is cut between words only, and a word may be longer than a slice."""
    text = ("alpha beta gamma, " * 300 + "y" * 5000 + " delta epsilon " * 200) * 2
    docs = [("en", text), ("en", "alpha beta"), ("en", "z" * 3000)]
    parts = [p for p in phrases.slices(_batches(docs))]
    monkeypatch.setattr(phrases, "SLICE", 256)
    small = [p for p in phrases.slices(_batches(docs))]
    assert len(small) > len(parts) or len(docs) == len(small)

    def counts(slices_):
        c = Counter()
        for s in slices_:
            words = s.text.to_pylist()
            for i, w in enumerate(s.word):
                c[words[w], words[s.word[i + 1]] if s.same[i] else None] += 1
        return c

    assert counts(parts) == counts(small)
    df = spark.createDataFrame([Row(lang=lang, text=t) for lang, t in docs])
    assert sorted(tuple(r) for r in phrases.collocations(df, 50, 100).collect()) == true_phrases(docs, 50, 100)


def test_phrases_hold_little_text_at_once(spark, monkeypatch):
    docs = [("en", f"alpha beta gamma{i % 7} " * 200) for i in range(2000)]
    assert max(sum(len(s.text[int(w)].as_py()) + 1 for w in s.word) for s in phrases.slices(_batches(docs))) <= 1 << 20
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], phrases.materialise
    before = spark.conf.get(name)
    monkeypatch.setattr(phrases, "materialise", lambda *a: (seen.append(int(spark.conf.get(name))), write(*a))[1])
    df = spark.createDataFrame([Row(lang=lang, text=t) for lang, t in docs[:20]])
    assert phrases.collocations(df, 50, 100).count() > 0
    assert set(seen) == {1000} and spark.conf.get(name) == before


def _batches(docs):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], ["lang", "text"])]


def test_phrases_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(df).count() == 0


@pytest.mark.parametrize("name", ["op12_shared_list_negatives", "op13_best_first_phrases"])
def test_query_against_sql(spark, name):
    from sessionloom.llm import queries

    folder = "/root/testdata/sf0.01"
    assert differences(queries.QUERIES[name](spark, folder), connect(folder), oracles.NEGATIVES if "12" in name else oracles.PHRASES) is None
