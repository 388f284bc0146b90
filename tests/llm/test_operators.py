"""The corpus operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbena.llm import flac, hamming_search, langid, line_dedup, ngram_join, packing, quality, queries, sentencepiece_codec, toxicity, warc_index

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, x string, part int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    """Ties, repeats, nulls, empties, a very long text and columns whose names clash with internal ones."""
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood tonight"
    near = base.replace("lazy", "sleepy")
    long = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
    rows = [(1, base), (2, base), (3, near), (4, "completely different words stand in this other text for once"), (5, ""), (6, None), (None, base), (7, "   \n  "), (8, "one two"), (9, "one two"), (10, long), (4, "completely different words stand in this other text for once"), (11, "line a of text here\nline b of text here\nline a of text here")]
    return spark.createDataFrame([(i, t, "en" if i != 4 else None, "s", len(t or ""), "i", "x", 1, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words(text):
    return [w for w in re.split(r"[ \t\n\v\f\r]+", (text or "").lower()) if w]


def test_ngram_join_edges(docs, none):
    got = {(tuple(r.docs_a), tuple(r.docs_b)): r.jaccard for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got[(1, 2), (1, 2)] == 1.0 and got[(8, 9), (8, 9)] == 1.0
    assert ((1, 2), (3,)) in got and len(got) == 3
    assert ngram_join.ngram_jaccard_join(none).count() == 0
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 4, 4, 5, 6, 7, 8, 10, 11]


def test_ngram_join_brute(corpus):
    texts = {r.doc_id: words(r.text) for r in corpus.select("doc_id", "text").collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in texts.items()}
    ids = sorted(sets)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = set()
    for r in ngram_join.ngram_jaccard_join(corpus).collect():
        got |= {(min(a, b), max(a, b)) for a in r.docs_a for b in r.docs_b if a != b}
    assert got == want


def test_ngram_classes(spark, docs, none, corpus):
    """One row a document: its group and the number of its near copies, equal texts among them."""
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.classes(docs).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 8: (8, 1), 9: (8, 1)} | {i: (i, 0) for i in (4, 5, 6, 7, 10, 11)}
    assert ngram_join.classes(none).count() == 0
    rng = np.random.RandomState(5)
    # short and long variants around the threshold, chains and false candidates
    rows = [(i, " ".join(rng.choice([f"a{i % 9}b{k}" for k in range(3 + 4 * (i % 9))], 1 + rng.randint(3 + 5 * (i % 9))))) for i in range(150)]
    rows += [(200 + i, " ".join(f"c{k if rng.rand() > 0.1 else rng.randint(900)}" for k in range(10 + 2 * (i // 20)))) for i in range(100)]
    for df in (corpus, spark.createDataFrame(rows, "doc_id bigint, text string")):
        texts = {r.doc_id: words(r.text) for r in df.select("doc_id", "text").collect()}
        sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in texts.items()}
        near = {a: {b for b in sets if b != a and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])} for a in sets}
        root = {i: i for i in sets}
        while True:
            after = {i: min([root[i], *(root[j] for j in near[i])]) for i in sets}
            if after == root:
                break
            root = after
        rows = ngram_join.classes(df).collect()
        assert len(rows) == len(sets) and {r.doc_id: (r.class_id, r.links) for r in rows} == {i: (root[i], len(near[i])) for i in sets}


def test_line_dedup_edges(docs, none):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns and line_dedup.dedup_lines(none).count() == 0
    rows = {(r.doc_id, r.text) for r in got.collect()}
    assert (11, "line a of text here\nline b of text here") in rows or (11, "line a of text here") in rows
    ids = [i for i, _ in rows]
    assert 2 not in ids and 9 not in ids and {1, 4, 5, 6, 7, 8, 10, None} <= set(ids)


def test_line_dedup_brute(corpus):
    lines = sorted({x.strip(" \t\n\r\v\f") for r in corpus.collect() for x in r.text.lower().split("\n")} - {""})
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    count = collections.Counter((a, b) for members in index.values() for k, a in enumerate(members) for b in members[k + 1 :])
    want = {p for p, o in count.items() if o >= 0.75 * (len(sets[p[0]]) + len(sets[p[1]]) - o)}
    points, offsets = line_dedup.code_points(pa.array(lines))
    ids = line_dedup.line_ids(points, offsets[:-1], offsets[1:]).tolist()
    root = {r.id: r.root for r in line_dedup.similar_lines(corpus).collect()}
    found = [p for p in want if root.get(ids[p[0]], ids[p[0]]) == root.get(ids[p[1]], ids[p[1]])]
    assert len(found) >= 0.9 * len(want)
    # nothing is joined that brute force doesn't join
    up = list(range(len(lines)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in want:
        up[find(a)] = find(b)
    own = {x: find(i) for i, x in enumerate(ids)}
    for a, r in root.items():
        assert own[a] == own[r]


def test_language(docs, none, corpus):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[5].lang_id == got[6].lang_id == "und" and got[1].lang_id == "en"
    assert langid.identify(none).count() == 0 and langid.keep_identified(docs).columns == docs.columns
    known = corpus.where(F.pmod("doc_id", F.lit(2)) == 0)
    model = langid.train(known)
    held = langid.identify(corpus.where(F.pmod("doc_id", F.lit(2)) == 1), model).collect()
    assert np.mean([r.lang == r.lang_id for r in held]) > 0.95


def test_language_brute(corpus):
    """Scores by plain dictionaries."""
    rows = [(r.lang, r.text) for r in corpus.limit(60).collect()]
    model = langid.fit(pa.array([t for _, t in rows]), [x for x, _ in rows])
    scores, scored, total = model.score(pa.array(["the qxzv and", "", "zz"]))
    assert total.tolist() == [3, 0, 1] and scores.shape == (3, len(model.languages)) and scored[1] == 0
    the = langid.span_hashes(np.frombuffer(b"the", np.uint8), np.array([0]), np.array([3]))
    alone = model.score(pa.array(["the"]))[0][0]
    assert np.allclose(alone, model.words.logs[model.words.find(the)[0]])


def test_language_sample(spark, corpus):
    """400 documents of a language train, with the same model as on the driver alone."""
    spell = lambda i: "".join("abcdefghij"[int(x)] for x in str(i))
    d = spark.createDataFrame([(i, f"{spell(i)}q {spell(i)}q", "xx") for i in range(1000, 1400)], "doc_id bigint, text string, lang string")
    assert len(langid.train(d).words.keys) == 400
    rows = corpus.where("trim(lang) <> '' AND text IS NOT NULL").select("lang", "text").collect()
    alone, spread = langid.fit(pa.array([r.text for r in rows]), [r.lang for r in rows]), langid.train(corpus, per_language=len(rows))
    assert alone.languages == spread.languages
    for a, b in [(alone.words, spread.words), *((alone.grams[k], spread.grams[k]) for k in alone.grams)]:
        assert np.array_equal(a.keys, b.keys) and np.allclose(a.logs, b.logs)


def test_quality(spark, docs, none, corpus, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert quality.score(none, labels).count() == 0
    assert quality.score(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns
    got = quality.score(corpus, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.9


def test_trees_brute():
    rng = np.random.RandomState(1)
    x = rng.randn(600, 4)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality.fit(x[:400], y[:400], trees=30)
    assert ((forest.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.9

    def walk(row):
        total = forest.base
        for n in forest.roots:
            while forest.left[n] != n:
                n = forest.left[n] if row[forest.feature[n]] <= forest.threshold[n] else forest.right[n]
            total += forest.value[n]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])


def test_statistics_brute():
    text = "Hello WORLD 12!\nHello there.\nHello there."
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array([text, None]))[0]))
    assert round(math.expm1(s["words"])) == 7 and round(math.expm1(s["lines"])) == 3 and s["unique_lines"] == pytest.approx(2 / 3) and s["top_word"] == pytest.approx(3 / 7)


def test_toxicity(spark, docs, none):
    rng = np.random.RandomState(0)
    plain = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    bad = ["grumblezak", "vorpikhund", "snarkwexel"]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(plain, 60).tolist()
        if i % 4 == 0:
            for k in range(4):
                w[k * 9] = bad[rng.randint(3)]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    known = y.where("doc_id < 300")
    got = {r.doc_id: r.toxic for r in toxicity.detect(d, known).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert toxicity.detect(docs, known.limit(0)).where("toxic").count() == 0 and toxicity.detect(docs, known).count() == docs.count()
    assert toxicity.detect(none, known).count() == 0
    low = {r.doc_id: r.toxic for r in toxicity.detect(d, known, max_grams=3000).collect()}  # a lower order
    assert len(low) == 400


def test_toxicity_beyond_the_broadcast_bound(spark, corpus, data):
    """The partitioned table scores as the broadcast one does; the order stays."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    d = corpus.union(spark.createDataFrame([(None, "nobody knows it", "en", "s", 1), (-1, None, None, "s", 0), (-2, "", "xx", "s", 0)], corpus.schema))
    small, large = (sorted(toxicity.detect(d, labels, max_grams=n).collect(), key=key) for n in (4_000_000, 100))
    assert [(r.doc_id, r.lang, r.toxic) for r in small] == [(r.doc_id, r.lang, r.toxic) for r in large]
    assert np.allclose([r.score for r in small], [r.score for r in large], atol=1e-5)


def test_every_toxic_label_counts(spark):
    d = spark.createDataFrame([(i, "abcde", "en") for i in range(80)], "doc_id bigint, text string, lang string")
    y = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id bigint, toxic int")
    got = toxicity.counted(d, y).agg(F.max("toxic"), F.max("ordinary")).first()
    assert got[0] == 40 and 0 < got[1] < 40


def test_the_toxicity_query_returns_every_document(spark, corpus, data):
    got = queries.op2_toxicity(spark, data)
    assert got.columns == ["doc_id", "lang", "score", "toxic"] and got.count() == corpus.count()


def test_grams_brute():
    table = toxicity._alphabet()
    texts = ["Ab c", "", None, "é--dog", "x"]
    grams, row = toxicity.grams_of(pa.array(texts), table, 3)
    want = []
    for i, t in enumerate(texts):
        for w in [x for x in re.split(r"[^a-zé]+", (t or "").lower()) if x]:
            s = [1, *(int(table[ord(ch)]) for ch in w)]
            last = (t.lower().rstrip().endswith(w) and t.lower()[-1] == w[-1]) and w == [x for x in re.split(r"[^a-zé]+", t.lower()) if x][-1]
            if not last:
                s.append(1)
            for k in range(1, len(s)):
                v = 0
                for ch in s[max(0, k - 2) : k + 1]:
                    v = (v << 10) | ch
                want.append((i, v))
    assert sorted(zip(row.tolist(), grams.tolist())) == sorted(want)


def brute_packs(rows, shards, window=2048):
    units = [(s, d, a, w[a : a + window]) for s, d, w in rows for a in range(0, len(w), window)]
    n, mean = len(units), sum(len(u[3]) for u in units) / len(units)
    df = collections.Counter(x for u in units for x in set(u[3]))
    out = {}
    for shard in range(shards):
        own = sorted((u for u in units if u[0] == shard), key=lambda u: (u[1], u[2]))
        tf, used, number = [collections.Counter(u[3]) for u in own], set(), 0
        for i, u in enumerate(own):
            if i in used:
                continue
            used.add(i)
            members, room, scores = [(u[1], u[2], len(u[3]))], window - len(u[3]), []
            for j, o in enumerate(own):
                if room and j not in used and len(o[3]) <= room:
                    x = sum(math.log(1 + (n - df[q] + 0.5) / (df[q] + 0.5)) * tf[j][q] * 2.2 / (tf[j][q] + 1.2 * (0.25 + 0.75 * len(o[3]) / mean)) for q in tf[i] if q in tf[j])
                    if round(x, 6) > 0:
                        scores.append((-round(x, 6), j))
            for _, j in sorted(scores):
                if len(own[j][3]) <= room:
                    members.append((own[j][1], own[j][2], len(own[j][3])))
                    used.add(j)
                    room -= len(own[j][3])
            out[shard, number] = members
            number += 1
    return out


def test_packing(docs, none, corpus):
    assert packing.pack(none).count() == 0
    got = packing.pack(docs).collect()
    placed = collections.Counter(d for r in got for d in r.doc_ids)
    assert placed[4] == 2 and placed[10] == 30 and not {5, 6, 7} & set(placed)
    shards = -(-corpus.count() // 80)
    rows = [(r.s, r.doc_id, words(r.text)) for r in corpus.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("s")).collect()]
    got = {(r.shard, r.pack): list(zip(r.doc_ids, r.starts, r.lengths)) for r in packing.pack(corpus, shard_docs=80).collect()}
    assert got == brute_packs(rows, shards)


def test_packing_over_shards(spark, corpus):
    """A seed finds its neighbours in all shards, whatever their number and however short the lists are."""
    rows = [(0, r.doc_id, words(r.text)) for r in corpus.select("doc_id", "text").collect()]
    want = brute_packs(rows, 1)
    whole = {(r.shard, r.pack): list(zip(r.doc_ids, r.starts, r.lengths)) for r in packing.pack(corpus, answers=1000).collect()}
    assert whole == want
    pairs = lambda packs: {(m[0], x) for m in packs.values() for x in m[1:]}
    packs = packing.pack(corpus, index_units=30, answers=64).collect()
    got = {(r.shard, r.pack): list(zip(r.doc_ids, r.starts, r.lengths)) for r in packs}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want))
    assert sorted(x for m in got.values() for x in m) == sorted(x for m in want.values() for x in m)


def brute_searched(rows, every, answers=64, window=2048):
    """Windows of (shard, seed): neighbours in the whole corpus for seeds divisible by every, then in the shard."""
    units = sorted(((d, a, s, w[a : a + window]) for s, d, w in rows for a in range(0, len(w), window)), key=lambda u: u[:2])
    n, mean = len(units), sum(len(u[3]) for u in units) / len(units)
    tf = [collections.Counter(u[3]) for u in units]
    df = collections.Counter(x for t in tf for x in t)
    idf = {q: math.log(1 + (n - m + 0.5) / (m + 0.5)) for q, m in df.items() if m > 1}
    score = lambda i, j: round(sum(idf[q] * tf[j][q] * 2.2 / (tf[j][q] + 1.2 * (0.25 + 0.75 * len(units[j][3]) / mean)) for q in tf[i] if q in tf[j] and q in idf), 3)
    used, out = set(), {}

    def take(i, near, room):
        for _, j in near:
            if j not in used and len(units[j][3]) <= room:
                out[i].append(j)
                used.add(j)
                room -= len(units[j][3])
        return room

    def near(i, others, room):
        return sorted((-x, j) for j in others if j != i and len(units[j][3]) <= room for x in [score(i, j)] if x > 0)

    left = {}
    for i, u in enumerate(units):
        if u[0] % every == 0 and i not in used:
            used.add(i)
            out[i] = [i]
            room = window - len(u[3])
            left[i] = take(i, near(i, range(n), room)[:answers], room) if room else 0
    for i, u in enumerate(units):
        if left.get(i):
            take(i, near(i, [j for j in range(n) if units[j][2] == u[2]], left[i]), left[i])
    for i, u in enumerate(units):
        if i not in used:
            used.add(i)
            out[i] = [i]
            room = window - len(u[3])
            if room:
                take(i, near(i, [j for j in range(n) if units[j][2] == u[2]], room), room)
    return {units[i][:2]: [units[j][:2] for j in own] for i, own in out.items()}


def test_packing_searched(docs, none, corpus):
    """Seeds divisible by every search all shards; every unit is in a pack, also those that no seed takes."""
    assert packing.pack(none, every=50).count() == 0
    placed = collections.Counter(d for r in packing.pack(docs, every=3).collect() for d in r.doc_ids)
    assert placed[4] == 2 and placed[10] == 30 and not {5, 6, 7} & set(placed)
    units = sum(-(-len(words(r.text)) // 2048) for r in corpus.collect())
    for index_units, answers in ((2048, 64), (30, 64), (30, 3)):
        shards = -(-units // index_units)
        rows = [(r.s, r.doc_id, words(r.text)) for r in corpus.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("s")).collect()]
        want = brute_searched(rows, 10, answers)
        got = {(r.doc_ids[0], r.starts[0]): list(zip(r.doc_ids, r.starts)) for r in packing.pack(corpus, every=10, index_units=index_units, answers=answers).collect()}
        assert sorted(x for m in got.values() for x in m) == sorted(x for m in want.values() for x in m)
        pairs = lambda packs: {(s, x) for s, m in packs.items() for x in m}
        assert len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want)), (index_units, answers)


def test_packing_searched_sends_little(spark, corpus, monkeypatch):
    """What reaches the driver from the search are the seeds' lists, whatever the number of shards."""
    sent = []
    keep = packing.by_part
    monkeypatch.setattr(packing, "by_part", lambda *a: sent.append(packing.cut(keep(*a))) or sent[-1])
    packing.pack(corpus, every=10, index_units=10, answers=4)
    lists = sent[1].collect()  # the first is the corpus's frequencies
    seeds = corpus.where("doc_id % 10 = 0").count()
    assert 0 < sum(len(r.ask) // 8 for r in lists) <= 5 * 2 * seeds


def test_packing_searched_ties(spark, monkeypatch):
    """Lists that end among equal scores are whole after one search: a shard's ties come in the order of doc_id too."""
    docs = spark.createDataFrame([(i, f"same words here and own{i % 2}") for i in range(400)], "doc_id bigint, text string")
    tops, keep = [], packing._hits
    monkeypatch.setattr(packing, "_hits", lambda sent, top, *a: tops.append(top) or keep(sent, top, *a))
    got = {(r.doc_ids[0], r.starts[0]): list(zip(r.doc_ids, r.starts)) for r in packing.pack(docs, window=20, every=50, index_units=20, answers=30).collect()}
    rows = [(r.s, r.doc_id, words(r.text)) for r in docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(20)).alias("s")).collect()]
    want = brute_searched(rows, 50, 30, 20)
    seeds = [(i, 0) for i in range(0, 400, 50)]
    assert [got[i] for i in seeds] == [want[i] for i in seeds] and len(tops) == 1 and tops[0] < 31


def test_packing_scores_of_like_asks():
    """Each block of asks has a matrix of its own; the scores are those of the postings, whichever terms it holds."""
    rng = np.random.default_rng(3)
    held = rng.random((60, 90)) < np.linspace(0.02, 0.9, 60)[:, None]
    term, unit = np.nonzero(held)
    weight = rng.random(len(term)).astype(np.float32)
    index = packing.Postings(held.sum(axis=1), unit.astype(np.int32), weight, np.ones(90, dtype=np.int64), np.arange(90))
    whole = np.zeros((60, 90))
    whole[term, unit] = weight
    for asks in (1, 16, 37):
        query = rng.random((asks, 60)) < 0.4
        assert np.allclose(index.scores(*np.nonzero(query), asks), query @ whole, atol=1e-4)
    # two languages: the asks of each stand together, in their former order
    ask, code = np.array([0, 1, 2, 3, 0, 1, 2, 3]), np.array([0, 1, 0, 1, 2, 3, 4, 5])
    assert packing.by_common_words(ask, code, 4, 2).tolist() == [0, 2, 1, 3]


def test_hamming(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.randn(24).tolist()) for i in range(120)] + [(200, None), (None, [1.0] * 24), (201, []), (202, [1.0, -1.0]), (203, [float("nan")] * 24), (5, [9.0] * 24)]
    v = spark.createDataFrame([(a, b, 1, "d") for a, b in rows], "vec_id bigint, embedding array<double>, rank int, dims string")
    got = collections.defaultdict(list)
    for r in hamming_search.top_k(v, k=5, shard_codes=50).collect():
        got[r.vec_id].append((r.distance, r.neighbour_id))
    codes = {}
    for i, e in rows:
        if i is not None and e is not None and len(e) == 24:
            code = tuple(x > 0 for x in e)
            codes[i] = min(codes.get(i, code), code)
    for i, a in codes.items():
        assert sorted(got[i]) == sorted((sum(x != y for x, y in zip(a, b)), j) for j, b in codes.items() if j != i)[:5]
    assert hamming_search.top_k(v.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "https://www.B.example.com:80/x?q=1#f", "<p>é</p>"), (2, "http://b.example.com/x?q=1", "two"), (3, "http://a.org", ""), (4, None, "x"), (5, "http://c.org/\t tab", "t\n"), (6, "http://d.org", None), (None, "/path", "n"), (2, "http://b.example.com/x?q=1", "two")]
    pages = spark.createDataFrame([(a, b, h, 3, "f") for a, b, h in rows], "page_id bigint, url string, html string, block int, file string")
    directory, folder = warc_index.build(pages, block_lines=2)
    keys = pages.select(warc_index.url_key(F.col("url")).alias("url_key"))
    got = sorted((r.url_key, r.page_id or 0, r.html) for r in warc_index.lookup(directory, folder, keys).collect())
    want = sorted([("com,example,b)/x?q=1", 1, "<p>é</p>"), ("com,example,b)/x?q=1", 2, "two"), ("com,example,b)/x?q=1", 2, "two"), ("org,a)/", 3, ""), ("org,c)/\t tab", 5, "t\n"), (")/path", 0, "n")])
    assert got == want
    assert warc_index.lookup(directory, folder, spark.createDataFrame([("zz",), (None,)], "url_key string")).count() == 0
    assert warc_index.captures(pages.limit(0)).count() == 0


def test_flac(spark):
    tables, rng = (flac._CRC8, flac._CRC16), np.random.RandomState(0)
    clips = {1: rng.randint(-32768, 32767, (700, 2)), 2: np.full((300, 1), -7), 3: np.cumsum(rng.randint(-3, 4, (1000, 1)), axis=0), 4: np.array([[5, 6]]), 5: np.zeros((0, 1), int), 6: flac.signal(rng.randn(64) * 0.1)}
    streams = {k: flac.encode(x.astype(np.int64), tables) for k, x in clips.items()}
    broken = bytearray(streams[6])
    broken[120] ^= 4
    rows = [*streams.items(), (7, None), (8, b"no"), (9, bytes(broken)), (10, streams[1][:-5]), (1, streams[1])]
    media = spark.createDataFrame([(k, bytearray(b) if b is not None else None, 1) for k, b in rows], "id bigint, flac binary, block int")
    blocks = flac.decode_column(media)
    got = collections.defaultdict(list)
    for r in blocks.where("error IS NULL").collect():
        got[r.id].append((r.first_sample, np.frombuffer(bytes(r.pcm), dtype="<i2").reshape(-1, r.channels)))
    for k in (2, 3, 4, 6):
        assert np.array_equal(np.concatenate([p for _, p in sorted(got[k], key=lambda x: x[0])]), clips[k])
    assert len(got[1]) == 2 * 6 and {r.id for r in blocks.where("error IS NOT NULL").collect()} == {8, 9, 10}
    at = {r.id: r for r in flac.seek(blocks.where("error IS NULL AND id = 3"), 301).collect()}
    assert np.frombuffer(bytes(at[3].pcm), dtype="<i2")[at[3].place] == clips[3][301, 0]
    assert flac.decode_column(media.limit(0)).count() == 0
    assert flac.decode_column(flac.media_of(spark.createDataFrame([(1, [0.1] * 64), (2, None)], "vec_id bigint, embedding array<double>"))).where("error IS NULL").count() == 2


def test_flac_by_hand():
    """Sides, wasted bits, escaped partitions and 5-bit Rice parameters, written bit by bit."""
    tables = (flac._CRC8, flac._CRC16)

    def frame(mode, parts):
        w = flac._Writer()
        for value, count in ((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (mode, 4), (4, 3), (0, 1), (0, 8), (3, 8)):
            w.put(value, count)
        w.put(flac.crc8(w.bytes(), tables[0]), 8)
        for value, count in parts:
            w.put(value, count)
        return w.bytes() + flac.crc16(w.bytes(), tables[1]).to_bytes(2, "big")

    head = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes([0, 16, 0, 16]) + bytes(6) + ((8000 << 44) | (1 << 41) | (15 << 36) | 4).to_bytes(8, "big") + bytes(16)
    verbatim = [(0, 1), (1, 6), (0, 1), *[(x, 16) for x in (10, 20, 30, 40)]]
    wasted = [(0, 1), (1, 6), (1, 1), (1, 2), *[(x & 0x7FFF, 15) for x in (1, -2, 3, -4)]]  # side: 17 bits, 2 wasted
    out, error = flac.decode(head + frame(8, verbatim + wasted), tables)
    assert error is None and out[0][1].tolist() == [[10, 6], [20, 28], [30, 18], [40, 56]]
    escape = [(0, 1), (8, 6), (0, 1), (0, 2), (1, 4), (15, 4), (5, 5), (3, 5), (-3 & 31, 5), (0, 4), (0b1, 1), (0b001, 3)]
    rice2 = [(0, 1), (9, 6), (0, 1), (7, 16), (1, 2), (0, 4), (1, 5), (0b10, 2), (0b11, 2), (0b010, 3)]
    out, error = flac.decode(head + frame(1, escape + rice2), tables)
    assert error is None and out[0][1].tolist() == [[3, 7], [-3, 7], [0, 6], [1, 7]]


def test_sentencepiece(docs, none):
    sp = sentencepiece_codec.processor(open(queries.PIECES, "rb").read())
    encoder, decoder = sentencepiece_codec.Encoder(sp, max_chunks=3), sentencepiece_codec.Decoder(sp)
    assert encoder.by_chunk
    texts = ["a  b", "  lead", " x", "trail ", "trail   ", "", None, " ", "tab\tx\n\n y", "é日本 ▁z 😀", "a\n  b", "plain words here", "plain words here"]
    for _ in range(2):
        ids = encoder.encode(pa.array(texts))
        assert ids.to_pylist() == [None if t is None else sp.encode(t) for t in texts]
    assert decoder.decode(ids).to_pylist() == [None if t is None else sp.decode(sp.encode(t)) for t in texts]
    got = sentencepiece_codec.encode_decode(docs, queries.PIECES).collect()
    assert len(got) == docs.count() and all(r.decoded is None or r.ids is not None for r in got) and sentencepiece_codec.encode_decode(none, queries.PIECES).count() == 0
    assert [r.decoded for r in got] == [r.text for r in docs.collect()]


def test_sentencepiece_distinct(spark, corpus, docs):
    """Each distinct marked word of the corpus is segmented once, whatever batch it stands in; ids equal the library's."""
    model = open(queries.PIECES, "rb").read()
    sp = sentencepiece_codec.processor(model)
    spread = corpus.repartition(3)
    made = sentencepiece_codec.chunk_answers(spread, sentencepiece_codec.send(spark, model)).agg(F.sum("made")).first()[0]
    texts = {r.doc_id: r.text for r in corpus.collect()}
    chunks = set()
    for t in texts.values():
        chunks |= {x[1:] for x in re.findall(" +[^ ]*", " " + t.replace("\u2581", " "))} if "  " not in t and t.strip(" ") == t and t else {x[1:] for x in re.findall(" +[^ ]+| +$", " " + t)} if t else set()
    assert made == len(chunks)
    for r in sentencepiece_codec.encode_decode(spread, queries.PIECES).collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) and r.decoded == texts[r.doc_id]


def test_sentencepiece_decode(spark):
    sp = sentencepiece_codec.processor(open(queries.PIECES, "rb").read())
    long = "word " * 50_000
    rows = [(1, sp.encode("plain  text é日😀"), 5), (2, None, 6), (3, [], 7), (4, [None, *sp.encode("x y")], 8), (5, [10**6], 9), (6, [3 + 0xFF], 1), (1, sp.encode("plain  text é日😀"), 5), (7, sp.encode(long), 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, part int")
    got = [(r.doc_id, r.decoded) for r in sentencepiece_codec.decode(df, queries.PIECES).collect()]
    assert got == [(1, "plain  text é日😀"), (2, None), (3, ""), (4, "x y"), (5, "⁇ "), (6, "\ufffd"), (1, "plain  text é日😀"), (7, long)]
    assert sentencepiece_codec.decode(df.limit(0), queries.PIECES).count() == 0


def test_flac_long_and_seek(spark, tmp_path):
    """A stream is decoded through a small window, blocks come as they are decoded, and a seek reads by pushed bounds."""
    import tracemalloc

    tables, rng = (flac._CRC8, flac._CRC16), np.random.default_rng(1)
    x = rng.integers(-30000, 30000, (80_000, 2))
    stream = flac.encode(x, tables, block=4096, linear=0)
    tracemalloc.start()
    done = 0
    for first, pcm, _, _, error in flac.frames(stream, tables):
        assert error is None and first == done and np.array_equal(pcm, x[first : first + len(pcm)])
        done += len(pcm)
    assert done == len(x) and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    for window in (32, 1000):
        assert flac.decode(flac.encode(x[:3000], tables, block=1024), tables, window)[1] is None
    media = spark.createDataFrame([(1, bytearray(stream)), (2, bytearray(stream))], "id bigint, flac binary")
    flac.write_blocks(flac.decode_column(media), str(tmp_path / "blocks"))
    found = flac.seek_file(spark, str(tmp_path / "blocks"), 2, 61_234)
    r = found.first()
    assert found.count() == 1 and np.frombuffer(bytes(r.pcm), dtype="<i2").reshape(-1, 2)[r.place].tolist() == x[61_234].tolist()
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = flac.seek_file(spark, str(tmp_path / "blocks"), 2, 61_234)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(first_sample,61234)" in plan and "GreaterThan(end_sample,61234)" in plan


def test_flac_linear_by_hand():
    """A linear predictor of order 2 written bit by bit: the samples follow from the coefficients by hand."""
    tables = (flac._CRC8, flac._CRC16)
    w = flac._Writer()
    for value, count in ((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (0, 4), (4, 3), (0, 1), (0, 8), (5, 8)):
        w.put(value, count)
    w.put(flac.crc8(w.bytes(), tables[0]), 8)
    # order 2, warm 100 and 110; coefficients 3 and -1 of 4 bits, shift 1: (3 x[-1] - x[-2]) >> 1
    residual = [1, -2, 0, 3]
    for value, count in ((0, 1), (33, 6), (0, 1), (100, 16), (110, 16), (3, 4), (1, 5), (3, 4), (-1 & 15, 4), (0, 2), (0, 4), (1, 4)):
        w.put(value, count)
    for v in residual:  # Rice parameter 1
        u = 2 * v if v >= 0 else -2 * v - 1
        w.put(1, (u >> 1) + 1)
        w.put(u & 1, 1)
    body = w.bytes()
    stream = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes([0, 16, 0, 16]) + bytes(6) + ((8000 << 44) | (15 << 36) | 6).to_bytes(8, "big") + bytes(16) + body + flac.crc16(body, tables[1]).to_bytes(2, "big")
    want = [100, 110]
    for v in residual:
        want.append(v + ((3 * want[-1] - want[-2]) >> 1))
    out, error = flac.decode(stream, tables)
    assert error is None and out[0][1][:, 0].tolist() == want


def test_warc_odd_urls(spark):
    """Line breaks, tabs, NULs and backslashes in URLs neither break records nor lose keys."""
    urls = ["http://a.com/x\r\nFake: y", "http://a.com/t\tb", "http://a.com/n\0l", "http://a.com/b\\n", "http://a.com/plain", "http://b.com/" + "z" * 50_000]
    pages = spark.createDataFrame([(i, u, f"<p>{i}", 1, 2) for i, u in enumerate(urls)], "page_id bigint, url string, html string, block int, file int")
    directory, folder = warc_index.build(pages, block_lines=2)
    keys = pages.select(warc_index.url_key(F.col("url")).alias("url_key"))
    found = warc_index.lookup(directory, folder, keys)
    assert {r.page_id: (r.url, r.html) for r in found.collect()} == {i: (u, f"<p>{i}") for i, u in enumerate(urls)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_line_dedup_names_and_many_drops(spark):
    """Columns with names like internal ones stay, and a document of very many dropped lines is filtered in linear time."""
    many = "\n".join(f"this very line is repeated again and again {i % 3}" for i in range(30_000))
    rows = [(1, "first line of some length here\nsecond line that is other", "n", "d", "t", "i"), (2, many, "n", "d", "t", "i")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __numbers string, __doc string, __text string, number string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[1]["__numbers"] == "n" and got[2].text.count("\n") <= 2


def test_components(spark):
    """Chains, stars and cycles against plain union-find."""
    from verbena.llm.pairs import components

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [tuple(map(int, e)) for e in rng.integers(2000, 2400, (250, 2))] + [(5, 5)]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for n in root if find(n) != n}
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "x bigint, y bigint").repartition(4)).collect()}
    assert got == want


def test_large_cluster_makes_each_pair_about_once():
    """Lists of a large cluster are multiplied, not paired gram by gram: no true pair is lost, and few are made again."""
    from verbena.llm import ngram_join as N

    rng = np.random.default_rng(3)
    base = rng.permutation(400).astype(np.uint64)
    sets = []
    for k in range(300):
        own = base.copy()
        own[rng.integers(0, 400, 25)] = 1000 + rng.integers(0, 60, 25).astype(np.uint64) if k < 200 else 5000 + np.arange(25, dtype=np.uint64) + np.uint64(25 * k)
        sets.append(np.unique(own) if k < 280 else np.unique(own)[:250])
    # the global order, rare first; all grams but the lone ones are listed
    count = dict(zip(*np.unique(np.concatenate(sets), return_counts=True)))
    sets = [np.array(sorted(s, key=lambda g: (count[g], g)), dtype=np.uint64) for s in sets]
    size = [len(s) for s in sets]
    lone = [sum(count[g] == 1 for g in s) for s in sets]
    first = [min(n, int(N.prefix_length(np.array([n]), 0.5)[0]) + N.MEET - 1) for n in size]
    batch = pa.RecordBatch.from_pydict({"group": list(range(300)), "size": size, "lone": lone, "prefix": [N.pack_keys(s[a:f], 5) for s, a, f in zip(sets, lone, first)]})
    parts, blobs = 3, list(N._prefix_lists(4, 5)([batch]))
    pairs = [x for k in range(4) for x in N._group_pairs(parts, 0.5, 5)(iter([b.filter(pa.compute.equal(b["part"], k)) for b in blobs]))]
    table = pa.Table.from_batches(pairs)
    long = table.filter(pa.compute.is_valid(table["places"]))
    assert long.num_rows and all(len(c.as_py()) > 8 * N.LONG for c in long["a"])
    made = table.filter(pa.compute.is_null(table["places"])).to_batches()
    for k in range(parts):
        made += N._cluster_pairs(parts, 0.5)(iter(long.filter(pa.compute.equal(long["part"], k)).to_batches()))
    made = pa.Table.from_batches(made)
    found = [(x, y) for k in range(parts) for b in N._meeting(iter(made.filter(pa.compute.equal(made["part"], k)).to_batches())) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())]
    assert len(found) == len(set(found))
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if 3 * len(np.intersect1d(sets[i], sets[j])) >= size[i] + size[j]}
    assert len(near) > 30_000 and near <= set(found)
    assert sum(len(c.as_py()) for c in made["count"]) < 6 * len(found)
