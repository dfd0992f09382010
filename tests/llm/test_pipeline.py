"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from test_corpus import DOCS, joined_components, plain_targets, shingles

import corpus_pipeline
import __spark_entry__ as driver


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose and junk, copies, leaks, nulls and repeated rows."""
    draw = random.Random(21)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(900)]

    def prose(k):
        return " ".join(draw.choice(vocabulary) for _ in range(k)).capitalize() + "."

    items = [(i, prose(30)) for i in range(6)]
    rows, labels, junk, leaks = [], [], set(), set()
    for i in range(400):
        body = prose(draw.randint(30, 150))
        if i % 4 == 3:
            body = " ".join(w.upper() + "!!" for w in prose(12).split()) * 6
            junk.add(i)
        elif i % 20 == 0:
            body = f"{body} {items[i // 20 % 6][1]} {prose(20)}"
            leaks.add(i)
        rows.append((i, body, "en", f"s{i % 5}", len(body)))
        labels.append((i, int(i not in junk), 0))
    for i in range(400, 440):
        near = rows[(i - 400) * 4][1].split()
        near[3] = "changed" if i % 2 else near[3]
        rows.append((i, " ".join(near), "en", f"s{i % 5}", len(" ".join(near))))
        if (i - 400) * 4 in leaks:
            leaks.add(i)
    rows += [rows[1], (None, prose(60), None, None, None), (900, None, "en", "s0", 0), (901, "", "en", "s1", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, junk, leaks


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """What every stage returned, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus[0]).write.parquet(str(folder / name))
        before, docs = docs, spark.read.parquet(str(folder / name))
        out[name] = before, docs
    return out


def test_stages_keep_the_columns_of_documents(tables):
    for name, (_, after) in list(tables.items())[:-1]:
        assert sorted(after.columns) == ["doc_id", "lang", "n_chars", "source", "text"], name


def test_quality_drops_junk_only(corpus, tables):
    _, rows, junk, _ = corpus
    kept = {r.doc_id for r in tables["quality_filter"][1].collect()}
    prose = {r[0] for r in rows if r[1] and r[0] not in junk}
    assert len(prose - kept) <= 0.02 * len(prose) and len(kept & junk) <= 0.02 * len(junk)


def test_one_of_each_group_stays(tables):
    before, after = tables["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect() if r.doc_id is not None}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = sorted(i for i, c in joined_components(sets, pairs).items() if i == c)
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == want and len(want) < len(sets)


def test_documents_with_test_items_go(corpus, tables):
    before, after = tables["decontaminate"]
    before, after = ([r.doc_id for r in t.collect()] for t in (before, after))
    assert Counter(after) == Counter(i for i in before if i not in corpus[3])


def test_sources_come_near_their_targets(tables):
    before, after = tables["mix"]
    size, taken, largest = defaultdict(int), defaultdict(int), 0
    for r in before.collect():
        size[r.source] += len((r.text or "").split())
        largest = max(largest, len((r.text or "").split()))
    times = Counter()
    for r in after.collect():
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    for source, target in plain_targets(size).items():
        assert abs(taken[source] - target) <= largest / 2 + 1e-6


def test_shards_are_even_and_slots_gapless(tables):
    before, after = tables["shard"]
    out = after.toPandas()
    assert Counter(before.toPandas().doc_id.fillna(-1)) == Counter(out.doc_id.fillna(-1))
    sizes = out.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_run_gives_what_the_stages_give(spark, corpus, tables):
    got = corpus_pipeline.run(spark, corpus[0])
    want = tables["shard"][1]
    key = ["row_number", "shard", "slot", "doc_id", "source"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, want.select(key).collect()))


def test_pipeline_is_registered():
    assert driver.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "decontaminate", "mix", "shard"]


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0, name
