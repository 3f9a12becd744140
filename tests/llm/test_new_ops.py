"""Token counts, ranked search, spelling forms: against the library, SQL-like sums and plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epiframe.llm import ranked_search, spelling, token_counts, tokens
from epiframe.llm.common import table
from tests.conftest import SF001
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
LOW = {c: c + 32 for c in range(65, 91)}
PIECES = ["a", "Word", "étude", " ", "   ", "\n", "\n\n", ".", "'", "'re", "r", "e", "1", "234", "　", "日本", "<|endoftext|>", "<|end", "oftext|>", "!?", "’"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


# ---------------------------------------------------------------- op11
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=30, max_size=120).map("".join), st.integers(1, 60), st.integers(20, 80))
def test_a_splice_is_the_difference_of_two_encodings(text, cut, width):
    c = token_counts.counter(tokens.default_vocabulary())
    cut = min(cut, len(text) - 1)
    window = text[:cut + width]
    got = c.splice(window, cut, len(window) == len(text))
    if got is not None:
        assert got == c.count([text])[0] - c.count([text[cut:]])[0]
    else:
        assert len(window) < len(text)


def _long_texts():
    rng = random.Random(3)
    words = ["a", "Mot", "étude", "日本", "<|endoftext|>", "'re", "1234567", "\n\n ", "x" * 40, "  "]
    return {
        1: " ".join(rng.choice(words) for _ in range(900)), 2: "".join(rng.choice(words) for _ in range(900)),
        3: "a" * 5000, 4: "ab" * 300 + " " * 700 + "日" * 900 + ". " + "b" * 700 + "'re", 5: "<|endoftext|>" * 200, 6: " " * 3000, 7: "short one", 8: None, 9: ""}


def test_spliced_counts_are_the_librarys(spark, library):
    texts = _long_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in token_counts.count_tokens(df, chunk_chars=100, overlap=20).collect()}
    for i, t in texts.items():
        assert out[i]["n_tokens"] == library(t), i
        assert out[i]["n_bytes"] == len((t or "").encode())
        assert out[i]["over_limit"] == (library(t) > 1024)
    assert out[7]["n_chunks"] == 1 and out[1]["n_chunks"] > 20
    assert out[3]["n_chunks"] < 50  # one long word: its chunks became one


def test_counts_of_the_whole_table(spark, library):
    docs = table(spark, SF001, "documents")
    want = {r["doc_id"]: library(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, chunk_chars=2000, overlap=64).collect()} == want


def test_counts_of_odd_rows(odd, empty, library):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(odd, chunk_chars=3000).collect())
    assert got == sorted((str(i), library(t)) for i, t in ODD)
    assert token_counts.count_tokens(empty).count() == 0


def test_other_vocabularies_count_whole_texts(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "Some words, étude. " * 40), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, vocabulary=path, chunk_chars=50).collect()}
    assert got == {1: len(SentencePieceProcessor(model_file=path).encode("Some words, étude. " * 40)), 2: 0}
    words = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(words)
    t.no_truncation()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, vocabulary=words, chunk_chars=50).collect()}
    assert got[1] == len(t.encode("Some words, étude. " * 40, add_special_tokens=False).ids)


# ---------------------------------------------------------------- op12
def _terms(text):
    return [w.translate(LOW) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _ranked(items, docs, k):
    docs = [(i, Counter(_terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_equal_plain_sums(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, range(40, 0, -1), k=rng.randint(1, 60)))) for i in range(300)]
    docs += docs[:5] + [(None, docs[7][1]), (400, None), (401, " - ")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 30)))) for i in range(25)] + [(1, "w1 w2"), (1, "w1 w2"), (90, None), (91, "unknown")]
    items += [(92, " ".join(words) + " " + " ".join(f"u{i}" for i in range(200)))]
    got = ranked_search.rank(spark.createDataFrame(items, "item_id long, text string"),
                             spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 10, block_bytes=900)
    assert _rows(got) == _ranked(items, docs, 10)


def test_masks_are_left_out_and_results_stay():
    rng = np.random.default_rng(1)
    parts = (500_000 + rng.random((70, 2000)) * 400_000).astype(np.int32) * (rng.random((70, 2000)) < np.linspace(0.02, 0.6, 70)[::-1, None])
    weights, ids = rng.integers(1, 9000, 70), rng.permutation(2000)
    best = ranked_search.Best(10)
    scored = ranked_search.best_of_run(parts, weights, ids, best, parts.max(axis=1).astype(np.int64))
    whole = weights @ parts.astype(np.int64)
    order = np.lexsort((ids, -whole))[:10]
    assert best.id.tolist() == ids[order].tolist() and best.score.tolist() == whole[order].tolist()
    assert scored < 1000


def test_ranks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha word"), (2, "日本 x"), (None, "é")], "item_id long, text string")
    assert _rows(ranked_search.rank(items, odd)) == _ranked([(1, "alpha word"), (2, "日本 x"), (None, "é")], ODD, 10)
    assert ranked_search.rank(items, empty).count() == 0
    assert ranked_search.rank(empty, odd, item_id="doc_id").count() == 0


# ---------------------------------------------------------------- op13
def _vocabulary(docs):
    found = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = spelling.shared(a, b)
    return a[p:] == b[p + 1:] if len(a) < len(b) else a[p + 1:] == b[p + 1:]


def _forms(docs):
    n = _vocabulary(docs)
    deleted = {}
    for w in n:  # words of one edit share a word less a letter, or one is the other's
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            deleted.setdefault(v, set()).add(w)
    near = {w: set() for w in n}
    for group in deleted.values():
        for a in group:
            near[a] |= {b for b in group if _one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_forms_of_the_whole_table(spark):
    docs = table(spark, SF001, "documents")
    want = _forms([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 500 and any(r[1] for r in want)
    assert _found(spelling.spelling_forms(docs, rows_per_range=150)) == want


def test_forms_with_chains_and_many_like_words(spark):
    rng = random.Random(4)
    words = ["prefixed" + "".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(300)]  # one hot first half
    words += ["".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(60)]
    docs += [(1000, "Chained " * 2500), (1001, "chainedx " * 240), (1002, "chainedxy " * 22), (1003, "chainedxyz " * 2), (None, "nullword nullword"), (5, None)]
    docs += [(2000, ("z" * 3000 + " ") * 2 + ("z" * 2999 + " ") * 25)]
    got = _found(spelling.spelling_forms(spark.createDataFrame(docs, "doc_id long, text string"), rows_per_range=40))
    assert got == _forms(docs)
    assert {r[2] for r in got if r[0].startswith("chained")} == {"chained"}


def test_forms_of_odd_rows(spark, odd, empty):
    assert _found(spelling.spelling_forms(odd)) == _forms(ODD)
    assert spelling.spelling_forms(empty).count() == 0


def test_routing_reaches_every_near_word():
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(7, 10))) for _ in range(3000)})
    ranges = spelling.Ranges([(i, part[0], part[-1]) for i in range(0, len(words), 50) if (part := words[i:i + 50])])
    where = {w: 50 * (i // 50) for i, w in enumerate(words)}
    for w in words[::7]:
        to = set(ranges.of(w))
        assert all(where[o] in to for o in words if _one_edit(w, o) and spelling._front_half(w, o))


# ---------------------------------------------------------------- stages on repeated ids, null ids, clashing names
def test_near_copies_go_by_id_and_text(spark):
    from epiframe.llm import near_dup

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, c), (9, c), (None, c + " end"), (None, "only null " * 9), (None, "only null " * 9), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _gone int, _id int, _digest int")
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, a), (5, b), (9, c), (None, "only null " * 9), (7, ""), (7, "")], key=str)


def test_stages_bear_any_names(spark):
    from epiframe.llm import decontaminate, line_dedup, toxicity

    line = "a line that stands in every document"
    rows = [(i, f"{line}\nown line of document number {i}, of its own") for i in range(6)]
    names = ["_lines", "_id", "_digest", "_bad", "lines_in", "lines_out", "first_docs", "_new"]
    df = spark.createDataFrame([(i, t, *range(8)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    cut = line_dedup.dedup_lines(df, **line_dedup.EVERY_LINE)
    assert sorted(cut.columns) == sorted(df.columns) and {r["lines_in"] for r in cut.collect()} == {2}
    own = line_dedup.without_repeated_lines(df, **line_dedup.EVERY_LINE)
    assert own.columns == df.columns and {r["lines_in"] for r in own.collect()} == {4}
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    assert toxicity.reject_toxic(df, labels).columns == df.columns
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    assert decontaminate.drop_contaminated(df, items).columns == df.columns


def test_stages_leave_only_their_result(spark):
    import os

    from epiframe.llm import near_dup
    from epiframe.session import checkpoint_dir

    def tables():
        folder = os.path.dirname(checkpoint_dir(spark).removeprefix("file:"))
        return {os.path.join(at, n) for at, names, _ in os.walk(folder) for n in names if n.startswith("llm-")}

    docs = table(spark, SF001, "documents")
    before = tables()
    kept = near_dup.drop_near_duplicates(docs)
    left = {"-".join(os.path.basename(n).split("-")[1:3]) for n in tables() - before}
    assert left == {"near-gone", "near-repeated"}
    assert kept.count() < docs.count()


def test_a_thousand_token_files(spark, library, tmp_path):
    from epiframe.llm import token_files

    df = spark.createDataFrame([(i if i % 50 else None, f"text <|endoftext|> number {i}") for i in range(1000)], "doc_id long, text string")
    path = f"{tmp_path}/tokens"
    got = token_files.token_digest(df, path, docs_per_file=1).collect()
    import os

    assert len([n for n in os.listdir(f"{path}/blocks") if n.startswith("file=")]) > 900
    assert sorted(r["n_tokens"] for r in got) == sorted(library(f"text <|endoftext|> number {i}") + 1 for i in range(1000))
    files = {}
    for r in spark.read.parquet(f"{path}/blocks").select("file", "doc_id").collect():
        files.setdefault(r["file"], []).append(-1 if r["doc_id"] is None else r["doc_id"])
    ordered = [files[f] for f in sorted(files)]
    assert all(max(x) <= min(y) for x, y in zip(ordered, ordered[1:]))
