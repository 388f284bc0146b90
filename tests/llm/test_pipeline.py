"""The pipeline's stages, each written and read again, against what they call."""

import math
import re
import weakref
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from verbena.llm import blobs, line_dedup, ngram_join, packing, pairs, quality
from verbena.llm.blobs import cut


def told(rows):
    """Documents whose language can be told, by plain dictionaries (all rows train: fewer than 400 a language)."""
    runs = lambda text: re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())
    grams = lambda w, k: [w[i : i + k] for i in range(len(w) - k + 1)]
    counts = {lang: Counter() for lang in sorted({r.lang for r in rows if r.lang and r.lang.strip()})}
    for r in rows:
        if r.lang in counts:
            counts[r.lang].update(runs(r.text))
    total = sum(counts.values(), Counter())

    def table(keys, smooth):
        by = {lang: Counter() for lang in counts}
        for lang, c in counts.items():
            for w, n in c.items():
                for g in keys(w):
                    by[lang][g] += n
        names = set().union(*by.values())
        return {g: [math.log((c[g] + smooth) / (sum(c.values()) + smooth * (len(names) + 1))) for c in by.values()] for g in names} if names else {}

    known = [table(lambda w: [w] if total[w] >= 2 else [], 0.1), *[table(lambda w, k=k: grams(w, k), 0.5) for k in range(5, 0, -1)]]
    out = set()
    for r in rows:
        scores = []
        for w in runs(r.text):
            for k, own in zip((None, 5, 4, 3, 2, 1), known):
                hits = [own[g] for g in ([w] if k is None else grams(w, k)) if g in own]
                if hits:
                    scores.append([sum(x) / len(hits) for x in zip(*hits)])
                    break
        if scores:
            top = sorted(sum(x) / len(scores) for x in zip(*scores))
            if top[-1] - top[-2] >= 0.05:
                out.add((r.doc_id, r.text))
    return out


def good(rows, forest):
    out = set()
    for r, x in zip(rows, quality.statistics(pa.array([r.text for r in rows], pa.string()))):
        margin = forest.base
        for n in forest.roots:
            while forest.left[n] != n:
                n = forest.left[n] if x[forest.feature[n]] <= forest.threshold[n] else forest.right[n]
            margin += forest.value[n]
        if 1 / (1 + math.exp(-margin)) >= 0.5:
            out.add((r.doc_id, r.text))
    return out


def groups(sets, threshold):
    """The smallest member of each item's component of items at least threshold alike."""
    index, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    overlap = Counter((a, b) for own in index.values() for k, a in enumerate(own) for b in own[k + 1 :])

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for (a, b), o in overlap.items():
        if o >= threshold * (len(sets[a]) + len(sets[b]) - o):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def without_similar_lines(rows):
    plain = lambda line: line.lower().strip(" \t\n\r\v\f")
    of = groups({x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in {plain(x) for r in rows for x in r.text.split("\n")} - {""}}, 0.75)
    seen, out = set(), set()
    for r in sorted(rows, key=lambda r: r.doc_id):
        kept = []
        for line in r.text.split("\n"):
            own = of.get(plain(line))
            if own not in seen:
                kept.append(line)
            seen |= {own} - {None}
        text = "\n".join(kept)
        if text == r.text or text.strip():
            out.add((r.doc_id, text))
    return out


def without_copies(rows):
    sets = {}
    for r in rows:
        w = r.text.lower().split()
        if w:
            sets[r.doc_id] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    of = groups(sets, 0.5)
    return {(r.doc_id, r.text) for r in rows if of.get(r.doc_id, r.doc_id) == r.doc_id}


def test_stages_brute(spark, data):
    """The documents and texts that each stage keeps, by plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    plain = {"language": told, "quality": lambda rows: good(rows, quality.train(docs, labels)), "line_dedup": without_similar_lines, "ngram_join": without_copies}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        after = cut(stage(spark, docs, data))
        got = [(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()]
        want = plain[name](rows)
        assert len(got) == len(set(got)) and set(got) == want, (name, len(set(got) - want), len(want - set(got)))
        docs = after
    lengths = {r.doc_id: len(r.text.lower().split()) for r in docs.collect()}
    placed = sorted((d, s, n) for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect() for d, s, n in zip(r.doc_ids, r.starts, r.lengths))
    assert placed == sorted((d, s, min(2048, n - s)) for d, n in lengths.items() for s in range(0, n, 2048))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, data))
        assert docs.columns == names, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    placed = [d for r in packs for d, s in zip(r.doc_ids, r.starts) if s == 0]
    assert len(placed) == len(set(placed)) == docs.where("trim(text) <> ''").count()
    assert all(r.words <= 2048 for r in packs)


def test_run_on_an_empty_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def python_in_one_task(plan):
    """Pairs of Python nodes of a plan without an exchange between them: each needs a worker of its own in the same task."""
    out, above = [], []
    for line in plan.splitlines():
        m = re.match(r"((?:   |:  )*(?:\+- |:- )?)(?:\*\(\d+\) )?(\w+)", line)
        if not m:
            continue
        above = above[: len(m[1]) // 3] + [m[2]]
        if re.search("InArrow|InPandas|EvalPython", m[2]):
            for name in reversed(above[:-1]):
                if "Exchange" in name:
                    break
                if re.search("InArrow|InPandas|EvalPython", name):
                    out.append((name, m[2]))
    return out


def test_one_python_worker_a_task(spark, data, monkeypatch):
    """An executor keeps each worker it ever needed at once, with its memory, so a task of any stage needs one."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for m in (line_dedup, ngram_join, packing, pairs):
        monkeypatch.setattr(m, "cut", seen)
    for _, stage in corpus_pipeline.STAGES:
        plans.append(stage(spark, docs, data)._jdf.queryExecution().executedPlan().toString())
    assert sum("InArrow" in p for p in plans) >= 8
    assert not [x for p in plans for x in python_in_one_task(p)]


def test_memory_goes_back_when_a_map_ends(monkeypatch):
    held, gone = [], []

    def run(batches):
        for _ in batches:
            a = np.ones(1000)
            held.append(weakref.ref(a))
            yield len(a)

    monkeypatch.setattr(blobs, "trim", lambda: gone.append(held[-1]() is None))
    assert list(blobs.trimmed(run)(iter([1, 2]))) == [1000, 1000] and gone == [True]


def test_small_clusters_share_blocks(spark, monkeypatch):
    """A block of verify costs about a millisecond by itself; few pairs take few, and the components stay."""
    text = lambda i, k: f"{i * i + 7:06d} line of cluster {i * 7919} about subject {i * 104729}, copy {k}"
    docs = spark.createDataFrame([(3 * i + k, text(i, k)) for i in range(200) for k in range(3)], "doc_id bigint, text string")
    placed = []

    def seen(df):
        out = cut(df)
        if "block" in df.columns and "x" in df.columns:
            placed.append(out)
        return out

    monkeypatch.setattr(pairs, "cut", seen)
    assert line_dedup.similar_lines(docs).select("root").distinct().count() == 200
    assert [r.doc_id % 3 for r in line_dedup.dedup_lines(docs).collect()] == [0] * 200
    assert 1 <= placed[0].select("block").distinct().count() <= 4
    monkeypatch.setattr(pairs, "SHARED", 16)
    assert line_dedup.dedup_lines(docs).count() == 200
    assert placed[-1].select("block").distinct().count() > 20


def test_units_of_a_shard_travel_together():
    """A shard's units of several sub-batches are one blob, and the same units as in many."""
    texts = [" ".join(f"word{i * k % 97}" for k in range(1, 2000)) for i in range(1, 301)]
    table = pa.table({"doc_id": range(300), "shard": pa.array([i % 3 for i in range(300)], pa.int64()), "text": texts})
    assert sum(map(len, texts)) > 3 * blobs.SUB_BATCH_BYTES
    few, many = (pa.Table.from_batches(packing._units(2048, *flush)(iter(table.to_batches()))) for flush in ((), (1,)))
    assert few.num_rows == 3 < many.num_rows
    for k in range(3):
        a, b = (packing.Shard(t.filter(pa.compute.equal(t["shard"], k))) for t in (few, many))
        assert all(np.array_equal(getattr(a, name), getattr(b, name)) for name in ("doc", "start", "length", "mark", "unit", "term", "tf"))
        terms, df = np.unique(a.term, return_counts=True)
        told = packing._local_frequencies(1)(few.filter(pa.compute.equal(few["shard"], k))).to_pylist()[0]
        assert np.array_equal(blobs.unpack_ids(told["terms"]), terms.astype(np.int64)) and np.array_equal(np.frombuffer(told["df"], dtype=np.uint32), df)
