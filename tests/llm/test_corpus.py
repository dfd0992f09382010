"""Corpus operators against plain versions of themselves, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import contamination, html, mixing, ngram_join, pii, quality, queries, secrets, sharding, substrings, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def joined_components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def awkward(spark):
    """Near copies, copies, nulls, blanks, a long text, repeated rows, names that clash with results."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(60):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(20, 120))]
        rows.append((i * 3, " ".join(body)))
        for k in range(draw.randint(0, 4)):
            near = list(body)
            for _ in range(draw.randint(0, 4)):
                near[draw.randrange(len(near))] = draw.choice(vocabulary)
            rows.append((1000 + len(rows), "\t".join(near).upper() if k % 2 else " ".join(near)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE\vtwo"), (905, "x" * 70000 + " y " * 3000), (906, None)]
    rows += [rows[0], (None, rows[3][1]), (None, "lonely text of six words here")]
    table = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if i != 903 else None, len(t or "")) for i, t in rows], DOCS)
    return rows, table.withColumn("shard", F.lit("mine")).withColumn("score", F.lit("x")).repartition(5)


def test_near_duplicates_match_all_pairs(awkward):
    rows, table = awkward
    for n, percent in ((4, 85), (5, 80)):
        got = {(r.doc_id, r.mark): r for r in ngram_join.near_duplicates(table, n, percent).collect() if r.doc_id is not None}
        sets = {i: shingles(t, n) for i, t in rows if i is not None}
        pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = joined_components(sets, pairs)
        assert {i: r.component_id for (i, _), r in got.items()} == want
        assert {i: r.n_shingles for (i, _), r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert len(pairs) > 20


def test_one_document_of_a_group_stays(spark, awkward):
    rows, table = awkward
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    got = [r.doc_id for r in kept.collect()]
    sets = {i: shingles(t, 5) for i, t in rows if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = sorted(i for i, c in joined_components(sets, pairs).items() if i == c)
    assert sorted(i for i in got if i is not None) == want
    assert got.count(None) == 1  # the lonely one; the other is a copy
    assert ngram_join.keep_one(table.limit(0)).count() == 0


def test_stars_leave_no_pair_behind(spark):
    """A chain of copies, each near only to its neighbours, is one component."""
    body = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(body), "en", "s", 0))
        body[(i * 7) % 60] = f"new{i}"
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), 1, 90).collect()
    sets = {r[0]: shingles(r[1], 1) for r in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in got} == joined_components(sets, pairs)


def plain_pii(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    text = text or ""
    out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{m.start()}:{m.end()}" for k, m in out)


PIECES = ["a", "@", ".", "1", "2", "+", " ", "-", "(", "é", "_", "25", "@b.c", "1.2.3.4", "4785380592391139", "😀"]
ODD = [
    "a@b.c_d@e.f x", "a@b@c.d.e", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "300.1.1.1 0001.2.3.4 1.2.3.0255", "4785 3805 9239 1139", "++1 2345678", "", None,
    "x@" + "a." * 3000 + "b", "9" * 5000, "a" * 3000 + "@",
]


def test_base_personal_data_matches_plain_patterns(spark):
    draw = random.Random(1)
    cases = ODD + ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, 25))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(4)
    got = table.select("doc_id", pii.listed(F.concat(*pii.base_spans(F.coalesce("text", F.lit("")))), pii.KINDS).alias("spans")).collect()
    assert {r.doc_id: r.spans for r in got} == {i: plain_pii(t) for i, t in enumerate(cases)}


def test_personal_data_learnt_from_the_base(spark):
    draw = random.Random(2)
    texts = []
    for i in range(160):
        number = f"({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        texts.append((i, f"call {'+1 ' if i % 8 else ''}{number} or id {draw.getrandbits(60):015x} now", "clash"))
    texts += [(500, None, "clash"), (501, "", "clash"), (501, "", "clash")]
    found = pii.scan(spark.createDataFrame(texts, "doc_id long, text string, pii string"), ["doc_id"])
    rows = found.collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    more = [i for i in range(160) if by[i].more_pii]
    assert set(more) <= {i for i in range(160) if i % 8 == 0}
    assert not by[500].pii and not by[501].pii
    text = spark.createDataFrame(texts[1:2], "doc_id long, text string, x string").join(found.drop("x"), "doc_id")
    assert "<phone>" in text.select(pii.redact(F.col("text"), F.col("pii")).alias("t")).first().t
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_personal_data_that_the_patterns_miss_is_found(spark):
    """Plus-less numbers outnumber the base ones, and still all are found; codes, dates and failed checks are not."""
    draw = random.Random(12)
    number = lambda: f"({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
    texts = [(i, f"call {'+1 ' if i % 3 == 0 else ''}{number()} now" if i % 2 else f"call {'+1 ' if i % 3 == 0 else ''}{draw.randint(200, 999)}-555-{draw.randint(1000, 9999)}, or so") for i in range(300)]
    texts += [(300 + i, f"mail me{i}@site{i % 7}.com or id {draw.getrandbits(60):015x} of 2021-0{1 + i % 9}-1{i % 9} and 4785380592391138") for i in range(60)]
    texts += [(400 + i, f"mail you{i} (at) place{i % 5}.org today") for i in range(10)]
    rows = pii.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), ["doc_id"]).collect()
    more = {r.doc_id: [s.value for s in r.more_pii] for r in rows if r.more_pii}
    texts = dict(texts)
    assert set(more) == {i for i in range(300) if i % 3} | set(range(400, 410))
    assert all(re.fullmatch(r"\(?\d{3}\)?[ -]555-\d{4}|you\d+ \(at\) place\d\.org", v) and v in texts[i] for i, vs in more.items() for v in vs)


def test_personal_data_without_counter_examples(spark):
    texts = [(i, f"call {'+1 ' if i % 2 else ''}(743) 555-38{i}") for i in range(10, 40)]
    rows = pii.scan(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id for r in rows if r.more_pii} == {i for i in range(10, 40) if i % 2 == 0}


def test_secrets_match_plain_patterns_and_tests(spark):
    draw = random.Random(4)
    parts = ["token", "=", '"', " ", ":", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "pass", "word", "API_KEY", "é", "x", "."]
    cases = [None, "", "token=abc token = 'abcdef'"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 18))) for _ in range(300)]
    got = secrets.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(cases)], "doc_id long, text string, secrets int").repartition(4))
    got = {r[0]: r[1] for r in got.select("doc_id", secrets.listed(F.col("secrets"), secrets.KINDS)).collect()}

    def plain(text):
        text, out = text or "", []
        for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            out += [(m.start(), 0, m.end())] * (len(m.group(2)) >= 6)
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

    assert got == {i: plain(t) for i, t in enumerate(cases)}
    randoms = [base64.b64encode(draw.randbytes(30)).decode() for _ in range(100)]
    plains = [("andthereishornononwith" * 3)[: 24 + i] for i in range(40)] + ["a" * 30, "thisIsAVeryLongCamelCaseIdentifierName", "-" * 40]
    table = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(randoms + plains)], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.scan(table).where(F.size("random_tokens") > 0).collect()}
    assert len([i for i in hit if i < 100]) >= 95 and not [i for i in hit if i >= 100]


def test_short_random_keys_are_tested(spark):
    draw = random.Random(13)
    keys = []
    while len(keys) < 100:
        key = base64.b64encode(draw.randbytes(18)).decode()[: 16 + len(keys) % 8]
        if re.search("[A-Za-z]", key) and re.search("[0-9]", key):
            keys.append(key)
    plains = ["onlyLettersInThis", "1234567890123456", "aaaaaaaaaaaaaaa1", "a1" * 9, "word-word-word"]
    table = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + plains)], "doc_id long, text string")
    hit = {r.doc_id: r.random_tokens[0].value for r in secrets.scan(table).where(F.size("random_tokens") > 0).collect()}
    assert sum(hit.get(i) == k for i, k in enumerate(keys)) >= 95 and not [i for i in hit if i >= 100]


def test_quality_scores_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = quality.train(docs, labels)
    scored = quality.score_rows(docs.withColumn("score", F.lit("clash")), machine).select("doc_id", "score").join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]]
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.85
    assert (good >= quality.THRESHOLD).mean() > 0.95
    again = quality.train(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(again.words, machine.words)


def test_pair_sum_by_squares_is_the_sum_over_pairs():
    draw = np.random.RandomState(1)
    m = quality.fit([(draw.randint(0, quality.BUCKETS, 9), draw.normal(size=len(quality.STATISTICS)), int(i % 2)) for i in range(8)])
    buckets, stats = draw.randint(0, quality.BUCKETS, 7), draw.normal(size=(1, len(quality.STATISTICS)))
    got = quality.scores(m, buckets, np.array([7]), stats)[0][0]
    x = np.concatenate([np.full(7, 1 / 7), np.clip((stats[0] - m.mean) / m.scale, -5, 5)])
    v = np.concatenate([m.word_factors[buckets], m.stat_factors])
    z = m.bias + x @ np.concatenate([m.words[buckets], m.stats]) + sum(x[i] * x[j] * v[i] @ v[j] for i in range(len(x)) for j in range(i))
    assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_quality_without_labels_or_text(spark, awkward):
    _, table = awkward
    none = spark.createDataFrame([(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(table, none) is None
    assert {r.score for r in quality.score_rows(table, None).collect()} == {1.0}
    machine = quality.train(table, spark.createDataFrame([(3 * i, i % 2, 0) for i in range(20)] + [(0, 1, 0)], "doc_id long, quality int, toxic int"))
    scores = [r.score for r in quality.score_rows(table, machine).collect()]
    assert len(scores) == table.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score_rows(table.limit(0), machine).count() == 0


def test_pages_give_their_article(spark):
    long = "Some longer sentence with words, commas and more. Another follows here, with detail."
    page = f"""<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>
      <div id="cookie-notice"><p>We use cookies, accept them, please.</p></div><div class="content"><h2>Head &amp; line</h2><p>{long}<p>{long}<br>
      <blockquote>Short.</blockquote></div><div class="sidebar"><p>{long}</p></div><form><p>Mail</p></form><div class="comments"><p>{long}</p></div><footer>x</footer>"""
    want = "\n".join(["Head & line", long, long, "Short."])
    rows = [(1, page, 0), (2, None, 0), (3, "", 0), (4, "<p>open <b>end", 0), (5, "<", 0), (1, page, 0), (6, page.replace('"content"', '"post"'), 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, text int")).select("page_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted([(1, want), (1, want), (2, ""), (3, ""), (4, "open end"), (5, "<"), (6, want)])


def test_short_blocks_of_the_article_stay():
    long = "<p>" + "Some longer sentence with words, commas and more. Another follows here, with detail. " * 4 + "</p>"
    body = " ".join(long[3:-4].split())
    inner = f"<h1>Title</h1><p class=lead>Short.</p><div class=entry>{long}{long}</div><section id=s3><h2>Note</h2><p>Two words.</p></section>"
    want = "\n".join(["Title", "Short.", body, body, "Note", "Two words."])
    for name in ("article", "main"):
        assert html.main_text(f"<body><div class=nav>Home</div><{name}>{inner}<aside>{long}</aside></{name}><p>Outside.</p>{long}</body>") == want
    # no stated content: sections of one kind are one path, and everything in the container of the strong ones stays
    parts = f"<section id=s1>{long}</section><section id=s2><h2>B</h2><p>Two words.</p></section><section id=s3>{long}</section>"
    page = f"<body><div id=top><p>Hi</p></div><h1>Title</h1><div class=post><p class=lead>Short.</p>{parts}</div><div><p>Bye</p></div><footer>{long}</footer></body>"
    assert html.main_text(page) == "\n".join(["Title", "Short.", body, "B", "Two words.", body])


def test_links_of_the_article_stay():
    refs = "<p>Text of it.</p><h2>References</h2><ul><li><a href=x>A paper on things</a></li><li><a href=y>Another</a>.</li></ul>"
    assert html.main_text(f"<body><article>{refs}</article></body>") == "Text of it.\nReferences\nA paper on things\nAnother."
    assert html.main_text(f"<body>{refs}</body>") == "Text of it.\nReferences"  # elsewhere a block of links is a menu


def test_suffix_ranks_on_demand():
    """Only asked-for suffixes are ranked; equal strings have equal ranks, and a stretch of one suffix has that suffix's rank."""
    text = bytes(random.Random(4).choices(b"abcd ", k=400))
    data = np.frombuffer(text + text[100:300], np.uint8)
    _, first, last, _, rank, n, rank_at = substrings.stretches(np.array([0, len(data)]), data)
    assert n == len(data) - substrings.LENGTH + 1
    assert (rank_at(np.arange(100, 251)) == rank_at(np.arange(400, 551))).all() and len(set(rank_at(np.arange(351)).tolist())) == 351
    lone = first == last
    assert (rank_at(first[lone]) == rank[lone]).all()


def test_ratios_judge_stated_content():
    """A stated teaser without a strong path does not hide the story; deep nesting costs no more than length."""
    story = [f"Sentence {i} of the story, with words, commas and more. " * 8 for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in story)
    page = f"<body><article><p>Read this too.</p></article><div class=zeta><h1>Head</h1>{body}</div></body>"
    assert html.main_text(page) == "\n".join(["Head", *map(str.strip, story)])
    both = f"<body><article><p>Read this too.</p></article><div class=zeta><article class=story><h1>Head</h1>{body}<p class=end>Fin</p></article></div></body>"
    assert html.main_text(both) == "\n".join(["Head", *map(str.strip, story), "Fin"])
    started = time.process_time()
    html.main_text("<div>x" * 20_000 + "</b></td>" * 20_000)
    assert time.process_time() - started < 5


def test_pages_of_the_given_table(spark):
    import html as entities

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in html.extract(pages).select("html", "text").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1).replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_one(spark, n):
    got = sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 17)).collect())
    assert got == list(range(n))


def test_shards(spark, awkward):
    rows, table = awkward
    out = sharding.shard_rows(table, ["doc_id", "text"], 8).toPandas()
    assert len(out) == len(rows) and sorted(out.row_number) == list(range(len(rows)))
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = sharding.shard_rows(table.repartition(3), ["doc_id", "text"], 8).toPandas()
    key = ["row_number", "shard", "slot"]
    assert out.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()
    assert sharding.shard_rows(table.limit(0), ["doc_id"], 8).count() == 0


def plain_removal(docs):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_opened_suffixes_come_slice_by_slice():
    import pyarrow as pa

    class Full:
        value = np.full(1 << 10, 255, dtype=np.uint8)

    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(800)] + ["", None, "x" * 200]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    made = list(substrings._opened([batch], Full))
    assert max(map(len, made)) <= substrings.PIECE < sum(map(len, made))
    got = [row for b in made for row in zip(b.column("doc").to_pylist(), b.column("rank").to_pylist())]
    assert len(got) == len(set(got)) == 800 * (3000 - substrings.LENGTH + 1) + 1


def test_removed_substrings(spark, tmp_path):
    draw = random.Random(3)
    parts = ["ab", "a", "ha ha ", "xyz ", "é", "the quick brown fox jumps over it ", "0123456789" * 6, "!!"]
    docs = [(draw.randint(0, 90), "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for _ in range(120)]
    docs += [(500, None), (501, ""), (502, "a" * 5000), (503, "a" * 60), (1, "a" * 49), (2, "a" * 50), docs[0]]
    spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = substrings.op7_cover_sample_suffixes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == plain_removal(docs)


def test_near_vectors_match_all_pairs(spark):
    draw = np.random.RandomState(5)
    base = draw.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + draw.normal(0, 0.05, (20, 16)), np.repeat(base[:1], 30, 0) + draw.normal(0, 0.02, (30, 16))])
    rows = [(int(i), [float(v) for v in r], 9) for i, r in enumerate(x)]
    odd = [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] + [1.0] * 15), (205, [1e300] * 16), (206, [1e-300] * 16), (207, [1.0] * 8)]
    table = spark.createDataFrame(rows + [(i, v, 9) for i, v in odd], "vec_id long, embedding array<double>, unit int")
    got = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    units = {i: np.array(v) / np.linalg.norm(np.array(v)) for i, v, _ in rows} | {205: np.ones(16) / 4, 206: np.ones(16) / 4}
    pairs = [(a, b) for a in units for b in units if a < b and units[a] @ units[b] >= 0.95]
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    ids = [r[0] for r in rows] + [i for i, _ in odd]
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.97 * 2 * len(pairs) and all(got[i].n_links <= links[i] for i in ids)
    assert {i: got[i].component_id for i in ids} == joined_components(ids, pairs)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_recall_of_the_tables():
    for n in (10, 10**5, 10**9):
        k, tables = vectors.plan(n, 0.95)
        assert 1 - (1 - vectors.meeting((2 - 1.9) ** 0.5) ** k) ** tables >= vectors.RECALL


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    draw = np.random.RandomState(6)
    centre = draw.normal(size=12)
    rows = [(i, [float(v) for v in centre + draw.normal(0, 0.05, 12)]) for i in range(70)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {69} and {r.component_id for r in got} == {0}


def test_copies_of_test_items(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(3000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(20)] + [(50, None), (None, "a b c d e f"), (51, "too short"), (0, None)]

    def text(k):
        return " ".join(draw.choice(vocabulary) for _ in range(k))

    docs, leaks = [(i, text(200)) for i in range(60)], set()
    for i in range(40):
        item = i % 20
        w = items[item][1].split()
        for _ in range(i // 8):  # replaced, dropped, added words
            at = draw.randrange(len(w))
            w[at : at + draw.randint(0, 1)] = [draw.choice(vocabulary)] * draw.randint(0, 2)
        docs.append((100 + i, f"{text(90)} {', '.join(w).upper()} {text(50)}"))
        leaks.add((100 + i, item))
    docs += [(900, None), (901, ""), docs[60]]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).withColumn("matches", F.lit(1)).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (contamination.BLOCK_WORDS, 100):  # one block of items, many blocks
        found = contamination.find_copies(table, bench, limit=limit).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id").collect()
        assert {tuple(r) for r in found} == leaks and len(found) == len(leaks) + 1
    left = contamination.clean(table, bench)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == set(range(60)) | {900, 901}
    assert contamination.clean(table, bench.limit(0)).count() == table.count()
    assert contamination.clean(table.limit(0), bench).count() == 0


def test_copies_of_short_ideographic_and_accented_items(spark):
    spanish = "ÁRBOL ESTÁ AÚN CANCIÓN NIÑO MÁS ALLÁ RÁPIDO ÓRGANO ÚLTIMO"
    chinese = "今天天气很好我们一起去公园散步然后回家吃饭"
    items = [(1, spanish.lower()), (2, chinese), (3, "Olvido Raro"), (4, "solo"), (5, "ひみつの鍵"), (6, "Été là-bas"), (4, "solo"), (7, "!?")]
    docs = [
        (1, f"texto {spanish} fin"), (2, f"他说：{chinese}。再见"), (3, "un olvido, raro; olvido raro"), (4, "olvido muy raro"), (5, "SOLO"), (6, "soloist"),
        (7, "これはひみつの鍵です"), (8, "un ÉTÉ LÀ BAS"), (9, ""), (10, None), (11, "今天很好"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for limit in (contamination.BLOCK_WORDS, 5):
        rows = contamination.find_copies(table, bench, limit=limit).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (2, 2), (3, 3), (5, 4), (5, 4), (7, 5), (8, 6)]
    three = next(r for r in rows if r.doc_id == 3)
    assert (three.score, three.start_word, three.end_word, three.seeds) == (1.0, 1, 3, 2)
    broken = table.limit(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.unhex(F.lit("FF20")), F.encode(F.lit("Olvido RARO"), "UTF-8")).cast("string").alias("text"))
    assert contamination.clean(broken, bench).count() == 0


def test_alignment_is_smith_waterman():
    draw = np.random.RandomState(9)
    for _ in range(30):
        a, b = draw.randint(0, 4, draw.randint(1, 9)), draw.randint(0, 4, draw.randint(1, 14))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -contamination.COST), h[i, j + 1] - contamination.COST, h[i + 1, j] - contamination.COST)
        assert abs(contamination._align(a, b)[0] - h.max()) < 1e-9


def plain_targets(words):
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(words.values()), set()
    while True:
        rest = total - sum(2 * words[s] for s in full)
        free = sum(weight[s] for s in words if s not in full)
        target = {s: 2.0 * words[s] if s in full else rest * weight[s] / free for s in words}
        over = {s for s in words if s not in full and target[s] > 2 * words[s]}
        if not over:
            return target
        full |= over


def test_mix_reaches_its_targets(spark):
    draw = random.Random(10)
    rows = [(i, " ".join(["w"] * draw.choice([1, 5, 20, 80, 300])), "en", draw.choice(["a", "b", "c", "d", "é", None]), 0) for i in range(3000)]
    rows += [(5000, None, None, "z", 0), (5001, "", None, "a", 0), rows[0], rows[0]]
    table = spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1).alias("copies"))
    out = mixing.mix(table).toPandas()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = plain_targets(sizes)
    out["source"] = [s if isinstance(s, str) else None for s in out.source]
    assert len(out) == len(rows) and out.copies.between(0, 2).all()
    for s in sizes:
        own = out[[x == s for x in out.source]]
        assert np.allclose(own.target, want[s]) and (own.source_size == sizes[s]).all()
        assert abs((own["size"] * own.copies).sum() - want[s]) <= 150 + 1e-6
    again = mixing.mix(table.repartition(7)).toPandas()
    assert sorted(zip(out.doc_id, out.copies)) == sorted(zip(again.doc_id, again.copies))
    assert mixing.mix(table.limit(0)).count() == 0


def test_every_contracted_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
