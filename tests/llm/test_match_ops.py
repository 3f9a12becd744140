"""Toxicity, search, line and document dedup, decontamination: against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from epiframe.llm import decontaminate, graph, licenses, line_dedup, near_dup, search, toxicity
from epiframe.llm.common import stored, table
from tests.conftest import SF001
from tests.llm.conftest import ODD

LOW = str.maketrans(licenses.UPPER, licenses.LOWER)


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF001, "documents").orderBy("doc_id").collect()]


def _union(n):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return parent, top


def brute_components(rows, size, share=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent, top = _union(len(rows))
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for o, n in Counter(o for x in s for o in having[x]).items():
            if 100 * n >= share * (len(s) + len(sets[o]) - n):
                parent[top(k)] = top(o)
        for x in s:
            having[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def near_copies(base, n, edits):
    rng = np.random.default_rng(5)
    words = base.split()
    out = []
    for k in range(n):
        w = list(words)
        for p in rng.choice(len(w), edits[k % len(edits)], replace=False):
            w[p] = f"edit{k}x{p}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, size):
    base = " ".join(f"base{i}" for i in range(120))
    rows = corpus + ODD + [(10_000 + k, t) for k, t in enumerate(near_copies(base, 60, (0, 1, 2, 5, 9, 12)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dup.near_components(df, size, small_bucket=4, block=16).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(odd, empty):
    assert near_dup.near_components(empty).count() == 0
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 6}


def test_odd_sketches_estimate(spark):
    rng = np.random.default_rng(1)
    for similarity in (0.95, 0.85, 0.7):
        shared = int(2 * 1000 * similarity / (1 + similarity))
        pool = rng.integers(1, 1 << 52, 4000).astype(np.uint64)
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000:2000 - shared]])
        values, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        s = near_dup.odd_sketches(near_dup.min_hashes(values, bounds))
        bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        n = 64 * near_dup.SKETCH
        estimate = 1 + n / (4 * near_dup.SAMPLES) * np.log(1 - 2 * bits / n)
        assert abs(estimate - similarity) < 0.13


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(300, 301), (302, 301), (302, 303)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 5 for k in range(5, 40)) and found[303] == 300
    tree = {r.node: r.root for r in graph.forest(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")).collect()}
    assert set(tree.values()) == {0} and len(tree) == 31


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance():
    rng = np.random.default_rng(2)
    for _ in range(4000):
        a, b = ("".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(2))
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def brute_lines(rows, edits=2, least=10, least_near=40):
    lines = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x) >= least]
    first = {}
    for i, n, x in lines:
        first[x] = min(first.get(x, (i, n)), (i, n))
    unique = sorted(first, key=len)
    parent, top = _union(len(unique))
    for a, x in enumerate(unique):
        for b in range(a + 1, len(unique)):
            y = unique[b]
            if len(y) - len(x) > edits:
                break
            if len(x) >= least_near and sum((Counter(x) - Counter(y)).values()) <= edits and distance(x, y) <= edits:
                parent[top(a)] = top(b)
    keep = {}
    for a, x in enumerate(unique):
        keep[top(a)] = min(keep.get(top(a), first[x]), first[x])
    where = {x: keep[top(a)] for a, x in enumerate(unique)}
    return sorted((i, n, where[x][0]) for i, n, x in lines if where[x] != (i, n))


def test_repeated_lines_equal_brute_force(spark, corpus):
    line = "the quick brown fox jumps over the lazy dog and runs away from it"
    planted = [(20_000 + k, f"own {k}\n" + line[:k] + "#" + line[k + (k % 3 > 0):] + "\nend of it") for k in range(40)]
    planted += [(30_000, line + "!!"), (30_001, line[:-2]), (30_002, "short one"), (30_003, "ten chars!\nten chars!\nTen chars!")]
    rows = corpus[:60] + planted + [(40_000, None), (40_001, ""), (40_002, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.line, r.class_id) for r in line_dedup.repeated_lines(df, small_bucket=4, block=8).collect())
    want = brute_lines(rows)
    assert got == want and len(want) > 40
    gone = {(i, n) for i, n, _ in want}
    for r in line_dedup.dedup_lines(df).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r.doc_id, n) not in gone))


def brute_short_lines(rows):
    lines = [(i, n, x) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    unique = sorted({x for _, _, x in lines}, key=len)
    parent, top = _union(len(unique))
    for a, x in enumerate(unique):
        for b in range(a + 1, len(unique)):
            y = unique[b]
            if distance(x, y) <= min(2, len(x) // 10):
                parent[top(a)] = top(b)
    keep = {}
    for a, x in enumerate(unique):
        first = min((i, n) for i, n, y in lines if y == x)
        keep[top(a)] = min(keep.get(top(a), first), first)
    where = {x: keep[top(a)] for a, x in enumerate(unique)}
    return sorted((i, n, where[x][0]) for i, n, x in lines if where[x] != (i, n))


def test_lines_of_every_length(spark):
    rng = np.random.default_rng(12)
    rows = [(k, f"Copyright {2000 + k} Example Ltd.\nHome\n \n\nMenu {k}\npage {k} of 90\n" + "own words " * (k + 9)) for k in range(12)]
    for k in range(60):  # lengths around the steps: 9 to 11 and 19 to 22
        base = ("abcdefghijk", "the quick brown fox ju")[k % 2][:(9 + k // 2 % 3 if k % 2 == 0 else 19 + k // 2 % 4)]
        w = list(base)
        for p in rng.choice(len(w), k % 3, replace=False):
            w[p] = "#" if p % 2 else ""
        rows.append((100 + k, f"{''.join(w)}\nt"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.line, r.class_id) for r in line_dedup.repeated_lines(df, small_bucket=4, block=8, **line_dedup.EVERY_LINE).collect())
    assert got == brute_short_lines(rows)
    gone = {(i, n) for i, n, _ in got}
    assert all((k, 0) in gone and (k, 1) in gone and (k, 2) not in gone and (k, 3) not in gone and (k, 4) not in gone for k in range(1, 12))


def test_line_dedup_of_odd_tables(odd, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ODD) and out.columns[:len(odd.columns)] == odd.columns
    by = {(r.doc_id, r.text) for r in out.collect()}
    assert (None, "alpha beta gamma delta epsilon") in by and (1, "") in by  # a null id comes first


def test_every_probe_finds_its_segment():
    """Any two lines within the edits share a key, one of them as its own segment."""
    rng = np.random.default_rng(4)
    for edits in (1, 2, 3):
        for _ in range(200):
            x = "".join(rng.choice(list("abcd"), rng.integers(20, 40)))
            y = list(x)
            for _ in range(rng.integers(0, edits + 1)):
                p = rng.integers(0, len(y))
                kind = rng.integers(0, 3)
                y[p:p + (kind < 2)] = [] if kind == 0 else [str(rng.integers(0, 9))]
            keys = []
            for t in (x, "".join(y)):
                own = line_dedup._Lines([t], 1)
                keys.append(line_dedup.segment_keys(own.span_hash, own.start, own.length, edits)[0].tolist())
            (a, b) = keys
            assert set(a[:edits + 1]) & set(b) or set(b[:edits + 1]) & set(a)


def test_leaks_exact_edited_and_none(spark, corpus):
    items = [(r.item_id, r.text) for r in table(spark, SF001, "benchmark").collect()]
    rng = np.random.default_rng(8)
    planted = []
    for n, (k, text) in enumerate(items[:20]):
        w = text.split()
        for p in rng.choice(len(w), max(1, len(w) // 10), replace=False):
            w[p] = f"other{p}"
        planted.append((50_000 + n, f"some words before {' '.join(w)} and some behind", k))
    df = spark.createDataFrame([(i, t) for i, t, _ in planted] + corpus, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(None, None), (-1, ""), (-2, "two words")], "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    exact = {(i, k) for i, t in corpus for k, q in items if q in (t or "")}
    assert exact <= pairs and {(i, k) for i, _, k in planted} <= pairs
    assert {i for i, _ in pairs} == {i for i, _ in exact} | {i for i, _, _ in planted}
    for r in got:
        assert 0.4 <= r.score <= 1 and r.passage in dict([(i, t) for i, t, _ in planted] + corpus)[r.doc_id]
    blocks = decontaminate.find_leaks(df, bench, words_per_block=300).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == pairs
    clean = decontaminate.drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in corpus} - {i for i, _ in exact}


@pytest.mark.parametrize("exact", [False, True])
def test_leaks_of_heavily_edited_copies(spark, exact):
    """Every copy of score 0.4 is found, whatever other documents hold."""
    rng = np.random.default_rng(11)
    item = [f"item{i}" for i in range(39)]
    rows, want = [], set()
    for k in range(160):
        w = list(item)
        spots = rng.choice(39, round(39 * (0.2, 0.25, 0.3, 0.35, 0.4)[k % 5]), replace=False)
        if k % 8 == 0:
            spots = range(k // 8 % 3, 39, 3)  # every third word: no 3-gram is left
        for p in spots:
            w[p] = f"other{k}x{p}"
        rows.append((k, f"before {' '.join(w)} behind"))
        number = {x: n for n, x in enumerate(sorted(set(item + w)))}
        best, _ = decontaminate.align(*(np.array([number[x] for x in y], np.uint64) for y in (item, w)))
        if best >= 0.4 * 2 * 39:
            want.add(k)
    assert len(want) > 120 and all(k in want for k in range(0, 160, 8))
    df = spark.createDataFrame(rows + [(1000, " ".join(item))] * exact, "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} - {1000} == want and exact == any(r.score == 1 for r in got)


def test_leaks_of_copies_with_words_put_in_and_left_out(spark):
    item = [f"item{i}" for i in range(40)]
    put_in = [x for i, w in enumerate(item) for x in ([w, f"new{i}"] if i % 3 == 2 else [w])]
    left_out = [w for i, w in enumerate(item) if i % 4 != 3]
    both = [x for i, w in enumerate(item) if i % 6 != 5 for x in ([w, f"new{i}"] if i % 6 == 2 else [w])]
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate((put_in, left_out, both, item[:9]))], "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]


def test_several_passages_of_one_item(spark):
    item = [f"item{i}" for i in range(20)]
    edited = ["x"] + item[1:12] + ["y"] + item[13:]
    text = " ".join(item + item + ["z"] * 5 + item[4:9] + ["z"] * 5 + edited)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontaminate.find_leaks(df, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.start_word, r.end_word) for r in got) == [(0, 20), (20, 40), (56, 75)]


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_leaks_of_odd_tables(spark, odd, empty):
    bench = table(spark, SF001, "benchmark")
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench).count() == len(ODD)


def brute_bm25(rows, queries, k):
    texts = [re.findall(licenses.WORD, (t or "").translate(LOW)) for _, t in rows]
    n, mean = len(rows), sum(map(len, texts)) / len(rows)
    df = Counter(w for t in texts for w in set(t))
    counts = [Counter(t) for t in texts]
    out = set()
    for q in queries:
        own = counts[q]
        scores = []
        for d in range(n):
            s = sum(own[w] * np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
                    for w, c in counts[d].items() if w in own)
            if s > 0:
                scores.append((-round(s, 3), rows[d][0]))
        out |= {(rows[q][0], d, -s) for s, d in sorted(scores)[:k]}
    return out


def test_search_equals_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = search.search(df.filter("doc_id % 20 = 0"), df, 7, bytes_per_shard=40_000, queries_per_block=4).collect()
    want = brute_bm25(corpus, [k for k, (i, _) in enumerate(corpus) if i % 20 == 0], 7)
    assert {(r.query_id, r.doc_id) for r in got} == {(q, d) for q, d, _ in want}
    score = {(q, d): s for q, d, s in want}
    assert all(abs(r.score - score[r.query_id, r.doc_id]) < 2e-3 for r in got)


def test_search_tasks_pass_on_their_best_alone(spark, corpus, monkeypatch):
    """However many shards a task takes, k answers a query leave it."""
    rows, real = {}, search.stored

    def counted(df, label, *more):
        out = real(df, label, *more)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(search, "stored", counted)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(40)
    got = search.search(df.filter("doc_id % 20 = 0"), df, 2).collect()
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert rows["index"][0] > 2 * tasks and sum(rows["answers"]) <= tasks * 2 * rows["queries"][0]
    want = brute_bm25(corpus, [k for k, (i, _) in enumerate(corpus) if i % 20 == 0], 2)
    assert {(r.query_id, r.doc_id) for r in got} == {(q, d) for q, d, _ in want}


@pytest.mark.parametrize("common,k", [(400, 5), (1, 5), (10 ** 9, 5), (400, 12)])
def test_search_parts_give_the_exact_best(monkeypatch, common, k):
    """Parts, blocks and floors leave out nothing: matrix for some terms, none, all; fewer blocks than k."""
    for name, value in (("PART", 64), ("BLOCK", 8), ("SCORES", 1000), ("COMMON", common)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    count = np.zeros((300, 200), dtype=np.int64)
    for d in range(300):  # two kinds of documents, some of them twice
        at = rng.zipf(1.3, 60)
        np.add.at(count[d], at[at < 100] + 100 * (d % 3 == 0), 1)
    count[20:30] = count[0]
    ids, length = rng.permutation(300), count.sum(axis=1)
    row, term = np.nonzero(count)
    r = {c: v[0] for c, v in search._shard_row([(pa.array(ids), length, row, term.astype(np.uint64), count[row, term])]).to_pydict().items()}
    idf = np.log(1 + (300 - (count > 0).sum(axis=0) + 0.5) / ((count > 0).sum(axis=0) + 0.5))
    impact = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * length / length.mean())[:, None])
    asked = rng.choice(300, 40, replace=False)
    q, t = np.nonzero(count[asked])
    weights, floor, found = count[asked][q, t] * idf[t], np.zeros(40), []
    for part, at in search.parts(r, length.mean(), np.arange(200, dtype=np.uint64), (count[asked] > 0).mean(axis=0)):
        for lo in range(0, 40, step := part.at_once()):
            own = (q >= lo) & (q < lo + step)
            w, docs, scores = part.best_of(q[own] - lo, at[t[own]], weights[own], floor[lo:lo + step], k)
            found.append((w + lo, part.ids[docs], part.nulls[docs], scores))
    got = list(zip(*(x.tolist() for x in search._best_found(found, k))))
    want = []
    for n, a in enumerate(asked):
        scores = np.round(impact @ (count[a] * idf), 6)
        order = [d for d in np.lexsort((ids, -scores)) if scores[d] > 0][:k]
        want += [(n, int(ids[d]), False, scores[d]) for d in order]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1.1e-6)


def test_search_of_odd_tables(odd, empty):
    assert search.search(empty, empty).count() == 0
    got = search.search(odd.filter("doc_id = 1"), odd).collect()
    assert sorted((r.rank, str(r.doc_id)) for r in got) == [(1, "None"), (2, "1"), (3, "1"), (4, "8")]


def test_nearest_equals_all_cosines():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(vectors, rng.integers(0, 2, 300).astype(float), list(range(300)), 60, block=16)
    dense = np.zeros((300, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:80]:
        near, cosine = index.nearest(t, w, 9)
        q = np.zeros(60)
        q[t] = w
        want = np.sort(dense @ q)[::-1][:9]
        assert np.allclose(np.sort(cosine)[::-1], want[want > 0][:len(cosine)]) and len(cosine) == min(9, int((dense @ q > 0).sum()))


def test_toxicity_learns_and_keeps_to_the_folds(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(600):
        words = rng.choice([f"word{j}" for j in range(300)], 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            words.insert(5, f"nasty{rng.integers(0, 5000)}")  # never the same word twice: the stem tells
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows + [(None, "x"), (10_000, None), (10_001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lab).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # labels of held-out rows are not read
    flipped = spark.createDataFrame([(i, 1 - t if got[i].held_out else t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(df, flipped).collect()}
    assert all(again[i] == got[i].score for i in again)


def test_toxicity_equals_brute_force(spark):
    """Neighbours, cosines and votes against plain dictionaries; every term of the examples counts."""
    import zlib

    rng = np.random.default_rng(17)
    rows = []
    for i in range(240):
        words = rng.choice([f"w{j}" for j in range(90)], rng.integers(1, 25)).tolist()
        rows.append((i, " ".join(words + ["vile"] * (i % 5 == 0) + ["rot"] * (i % 7 == 0))))
    labels = [(i, int(i % 5 == 0)) for i in range(0, 200)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"),
                                                        spark.createDataFrame(labels, "doc_id long, toxic int"), k=6).collect()}
    texts = {i: Counter(t.split()) for i, t in rows}  # no word is longer than five bytes
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    terms = {t for i in learned for t in texts[i]}
    df = Counter(t for c in texts.values() for t in c)

    def ratio(t):
        n, out = len(learned), 0.0
        for y in (0, 1):
            for has in (False, True):
                cell = sum((t in texts[i]) == has and learned[i] == y for i in learned)
                of = sum((t in texts[i]) == has for i in learned) * sum(learned[i] == y for i in learned) / n
                out += cell * np.log(cell / of) if cell else 0.0
        return 1 + np.sqrt(max(0, 2 * out - 2 * np.log(len(terms))))

    weight = {t: (np.log((len(rows) + 1) / (df[t] + 1)) + 1) * ratio(t) for t in terms}
    assert weight["vile"] > 5 * max(w for t, w in weight.items() if t != "vile")

    def vector(i):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in texts[i].items() if t in terms}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {i: vector(i) for i in learned}
    scores = []
    for i, _ in rows:
        v = vector(i)
        cosine = {e: min(1.0, sum(x * u.get(t, 0) for t, x in v.items())) for e, u in examples.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:6]
        assert np.allclose(got[i].cosines, best) and len(got[i].neighbours) == len(best)
        assert all(abs(cosine[e] - c) < 1e-9 for e, c in zip(got[i].neighbours, got[i].cosines))
        w = 1 / (1.05 - np.array(got[i].cosines))
        prior = (sum(learned.values()) + 0.5) / (len(learned) + 2)
        scores.append(((w @ [learned[e] for e in got[i].neighbours] + prior) / (w.sum() + 1), got[i].score))
    raw, out = np.array(sorted(scores)).T
    assert np.all(np.diff(out) >= -1e-9)  # the calibration keeps the votes' order
    assert all(got[i].predicted == (i % 5 == 0) for i, _ in rows)


def test_toxicity_of_few_rows_and_labels(spark):
    """Two words mark ten of thirty texts: few examples are enough. No labels reject nothing."""
    rng = np.random.default_rng(18)
    rows = [(i, " ".join(rng.choice([f"plain{j}" for j in range(60)], 12).tolist() + ["vile", "scum"] * (i % 3 == 0))) for i in range(30)]
    df = spark.createDataFrame(rows + [(3, "plain1 plain2")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, lab).collect()
    assert len(got) == 31 and all(len(r.neighbours) > 0 for r in got)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got) >= 28
    assert toxicity.reject_toxic(df, lab.limit(0)).count() == 31


def test_toxicity_of_odd_tables(spark, odd, empty):
    lab = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(empty, lab).count() == 0
    assert toxicity.score_toxicity(odd, lab.limit(0)).count() == len(ODD)
    assert toxicity.reject_toxic(odd, lab).columns == odd.columns


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SF001, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF001), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        ids = left
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(c == i for i, _, c in brute_components(texts, 5))  # no near duplicates are left
    items = [r.text for r in table(spark, SF001, "benchmark").collect()]
    assert not any(q in (t or "") for _, t in texts for q in items)
    lines = Counter(x for _, t in texts for x in (t or "").split("\n") if len(x) >= 10)
    assert max(lines.values(), default=0) <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
