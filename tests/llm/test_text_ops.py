"""Formatting, token files, packing, licences, sharding: contracts against plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epiframe.llm import chat_format, licenses, packing, sharding, token_files, tokens
from epiframe.llm.common import ALNUM, SPACED, Words, number_rows, running_total, shingles, stored
from tests.conftest import SF001
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "Word", "étude", " ", "  ", "\n", "\n\n", ".", ",", "'s", "don't", "1", "\t", "　", "\x85", "日本", "<|endoftext|>", "-", "!?", "\x1c", "’"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own_encoder():
    return tokens.Encoder(tokens.default_vocabulary(), bits=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9).map("".join), min_size=1, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    enc = tokens.encoder(tokens.default_vocabulary())
    t = enc.tokenizer
    ids, bounds = enc.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_with_a_full_cache(own_encoder, reference):
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(20)]  # more pieces than the cache holds
    for t in texts:
        assert own_encoder.encode(pa.array([t, None], pa.string()))[0].tolist() == reference(t)


def test_words_match_the_patterns():
    texts = ["Ab c\n　D", None, "", "  x\ty ", "é1-b", "tail", "next"]
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts, pa.string()), table)
        low = [(t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)) for t in texts]
        want = [re.findall(pattern, t) for t in low]
        got = [[w.data[a:b].tobytes().decode().translate(str.maketrans(licenses.UPPER, licenses.LOWER))
                for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.first, w.first[1:])]
        assert got == want
        flat = [x for t in want for x in t]
        assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_shingle_counts():
    texts = ["a b a b a", "one", "", None, "A b", "a b c"]
    values, bounds = shingles(Words(pa.array(texts, pa.string()), SPACED), 2)
    assert np.diff(bounds).tolist() == [2, 1, 0, 0, 1, 2]
    assert values[bounds[4]] in values[bounds[0]:bounds[1]]


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(0)
    counts = (2.0 ** np.arange(30)).astype(np.int64)
    lengths = token_files.code_lengths(counts, 9)
    assert lengths.max() <= 9 and abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-12
    for ids in (rng.integers(0, 30, 5000), np.zeros(7, np.int64), np.array([3])):
        lengths = token_files.code_lengths(np.bincount(ids, minlength=30), 9)
        codes = token_files.canonical_codes(lengths)
        bounds = np.array([0, len(ids) // 3, len(ids) // 3, len(ids)])
        payload, marks = token_files.encode_blocks(ids, bounds, codes, lengths, 16)
        table, width = token_files.decode_table(lengths)
        assert (token_files.decode_blocks(payload, marks, np.diff(bounds), table, width, 16) == ids).all()
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(10, np.int64), 3)


def test_limited_lengths_are_optimal():
    import itertools

    counts = np.array([1, 1, 2, 3, 7])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, 4), repeat=5) if sum(2.0 ** -x for x in ls) <= 1)
    assert (counts * token_files.code_lengths(counts, 3)).sum() == best


@given(st.binary(max_size=50), st.binary(max_size=300))
def test_crc_of_joined_parts(a, b):
    assert token_files.crc_shift(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_token_files_round_trip(spark, odd, reference, tmp_path):
    got = token_files.token_digest(odd, str(tmp_path / "t"), block_ids=1000, checkpoint_ids=64, docs_per_file=3).collect()
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted((len(reference(t)) + 1, zlib.crc32(np.array([*reference(t), 0], "<u4").tobytes())) for _, t in ODD)
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == want
    ids = {(r.doc, r.block): np.frombuffer(r.ids, "<u4") for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert sum(map(len, ids.values())) == at


def test_token_files_of_an_empty_table(empty, tmp_path):
    assert token_files.token_digest(empty, str(tmp_path / "t")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=17, max_size=17))
def test_plan_uses_up_the_histogram(counts):
    hist = np.array([0, *counts[1:]], dtype=np.int64)
    made = packing.plan(hist, 16)
    used = np.zeros(17, dtype=np.int64)
    for lengths, n in made:
        assert n > 0 and sum(lengths) <= 16
        for v in lengths:
            used[v] += n
    assert (used == hist).all()
    assert sum(n for _, n in made) <= 1.25 * max(1, sum(n for _, n in packing.best_fit(hist, 16))) + 1


def test_packing_contract(spark, odd, reference):
    rows = packing.pack_documents(odd, 64, 2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 64
    want = []
    for i, t in ODD:
        ids = np.array([*reference(t), 2], "<u4")
        cut = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want += [(str(i), n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len(by) <= -(-sum(w[3] for w in want) // 64) + 2


def test_packing_an_empty_table(empty):
    assert packing.pack_documents(empty).count() == 0


def test_number_rows_and_running_total(spark):
    df = stored(spark.range(500).selectExpr("id", "case when id % 3 = 0 then null else id % 2 end as k", "id % 7 as v"), "test")
    got = number_rows(df, ["k"], ["id"], "nth", rows_per_block=20).collect()
    for k in {r.k for r in got}:
        assert sorted(r.nth for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))
    total = running_total(df, ["id"], "v", "before", rows_per_range=50).collect()
    assert all(r.before == sum(i % 7 for i in range(r.id)) for r in total)


def test_sharding_is_minimax(spark, odd):
    rows = sharding.shard_documents(odd, 3, groups_per_bin=2).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    texts = {}
    for r in rows:
        texts.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    size = {}
    for r in rows:
        size[r.group_key] = size.get(r.group_key, 0) + r.size
    order = [size[k] for k in sorted(size)]
    best = min(max(sum(order[:a]), sum(order[a:b]), sum(order[b:])) for a in range(len(order) + 1) for b in range(a, len(order) + 1))
    shards = [sum(r.size for r in rows if r.shard == s) for s in range(3)]
    assert max(shards) == best == rows[0].capacity
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.text_crc32 == 0 and r.size == 1 for r in rows if r.doc_id in (2, 3))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 4))
def test_cuts_against_every_partition(sizes, shards, per_bin):
    class Groups(sharding._Ladder):
        def __init__(self):
            self.bins = list(range(0, len(sizes), per_bin))
            self.ends = np.cumsum([sum(sizes[b:b + per_bin]) for b in self.bins])
            self.starts = np.concatenate([[0], self.ends[:-1]])
            self.total, self.largest = sum(sizes), max(sizes)

        def inside(self, b):
            own = sizes[self.bins[b]:self.bins[b] + per_bin]
            return self.starts[b] + np.concatenate([[0], np.cumsum(own)]), [str(i) for i in range(len(own))]

    capacity, cuts = sharding.minimax_cuts(Groups(), shards)

    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    assert fits(capacity) and (capacity == 1 or not fits(capacity - 1))
    edges = set(np.cumsum([0, *sizes]).tolist())
    places = [0, *cuts, sum(sizes)]
    assert all(p in edges for p in places) and all(0 <= b - a <= capacity for a, b in zip(places, places[1:]))


def test_written_shards_hold_every_row_once(spark, odd, empty, tmp_path):
    from collections import Counter

    names = odd.columns
    sharding.write_shards(odd, str(tmp_path / "odd"), 3, rows_per_file=2)
    got = spark.read.parquet(str(tmp_path / "odd"))
    assert set(got.columns) == {*names, "shard_", "slot"}  # odd has a column shard
    rows = got.collect()
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r) for r in odd.collect())
    for n in range(3):
        assert sorted(r.slot for r in rows if r.shard_ == n) == list(range(sum(r.shard_ == n for r in rows)))
    want = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_documents(odd, 3).collect()}
    assert all(r.shard_ == want[r.doc_id, zlib.crc32((r.text or "").encode())] for r in rows)
    sharding.write_shards(empty, str(tmp_path / "empty"), 3)


def test_sharding_an_empty_table(empty):
    assert sharding.shard_documents(empty).count() == 0


def _scan_by_hand(text):
    words = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_scan(spark, odd):
    texts = [t for _, t in ODD] + [
        "Released under the MIT License. and Mit\n license! mit license", "smit license MIT licenseé mit-license", "mit license " * 500,
        "Licensed under the Apache License, Version 2.0.", "GNU GENERAL PUBLIC LICENSE, version 3; all rights reserved",
        "Licensed under CC BY-NC 4.0.", "İ mit license K", "SPDX-License-Identifier: GPL-2.0-only"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _scan_by_hand(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id - len(ODD): r.labels for r in rows}
    assert labels[3] == "apache,apache-2.0" and labels[4] == "gpl,gpl-3.0,proprietary" and labels[5] == "cc-by-nc-4.0" and labels[7] == "gpl-2.0"
    assert licenses.scan(odd).count() == len(ODD)
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_suppression_by_containment_and_priority(spark):
    rules = [licenses.Rule("short", ("b", "b"), "b c", 10, 0.5), licenses.Rule("long", ("b", "b"), "a b c", 5, 0.5),
             licenses.Rule("same", ("b", "b"), "a b c", 9, 0.5), licenses.Rule("late", ("c", "c"), "c d", 1, 0.5)]
    df = spark.createDataFrame([(1, "a b c d")], "doc_id int, text string")
    r = licenses.scan(df, rules, gate="b").collect()[0]
    assert r.labels == "same" and r.n_kept == 1  # inside, same span with less priority, overlapping with less priority


def spelled(parsed):
    """Every word sequence of a parsed pattern; the shortest of a repeated class."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            ways = [chr(arg)]
        elif name == "IN":
            ways = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
            ways = ways if all(str(k) == "LITERAL" for k, _ in arg) else ways[:1]
        elif name == "BRANCH":
            ways = [x for branch in arg[1] for x in spelled(branch)]
        elif name == "SUBPATTERN":
            ways = spelled(arg[3])
        else:
            assert name == "MAX_REPEAT" and arg[0] in (0, 1)
            ways = spelled(arg[2]) + [""] * (arg[0] == 0)
        out = [a + b for a in out for b in ways]
    return out


def test_gate_and_keywords_pass_every_spelling():
    from re import _parser

    seen = 0
    for rule in licenses.default_rules():
        for text in set(spelled(_parser.parse(rule.pattern))):
            assert re.fullmatch(rule.pattern, text)
            words = f" {text} "
            assert f" {rule.keywords[0]}" in words and (not rule.keywords[1] or f" {rule.keywords[1]}" in words), (rule, text)
            for gap in ("\n", " \t\r\n" + "* " * 30, " - "):
                assert re.search(licenses.GATE, text.upper().replace(" ", gap)), (rule, text)
            seen += 1
    assert seen > 2000


def test_licences_across_line_feeds(spark):
    texts = ["All rights\nreserved", "into the public\ndomain", "cc" + " " * 40 + "by 4.0", "licensed under 0BSD", "under a FreeBSD variant",
             "FreeBSD license", "(CC)\nBY-SA", "MIT No\nAttribution", "accby nothing", "creative commons" + "\n" * 30 + "by nc"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)] == [
        "proprietary", "public-domain", "cc-by-4.0", "bsd-0-clause", "bsd-2-clause", "bsd-2-clause", "cc-by-sa-4.0", "mit-0", "", "cc-by-nc-4.0"]
    assert all((r.score > 0) == (r.labels != "") for r in rows)


def test_rules_are_hundreds():
    assert len(licenses.default_rules()) > 250


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hey <|im_end|>"), (1, 2, "ann", "yes"), (1, 3, "cat b", None),
             (None, 0, None, "lost"), (2, 0, "system", "alone"), (1, None, "ann", "first")]
    rows = chat_format.rotate(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), turns_per_part=4).collect()
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "cat b"), (None, "unknown")}
    for (conv, who), parts in by.items():
        parts.sort(key=lambda r: r.part)
        assert [p.start_char for p in parts] == [sum(len(q.text) for q in parts[:i]) for i in range(len(parts))]
        own = [p.text[m.start:m.end] for p in parts for m in p.masks]
        if (conv, who) == (1, "ann"):
            assert own == ["first<|im_end|>\n", "hi<|im_end|>\n", "yes<|im_end|>\n"]
            whole = "".join(p.text for p in parts)
            assert whole == ("<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                             "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user name=bob\nhey <|im_end |><|im_end|>\n"
                             "<|im_start|>user name=cat_b\n<|im_end|>\n")
    assert sum(r.n_own for r in rows) == 6  # every turn of a participant once


def test_rotation_of_an_empty_table(spark):
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_registered_names():
    from __spark_entry__ import queries

    names = queries()
    assert "pipeline" in names and sorted({int(m[1]) for m in map(re.compile(r"op(\d+)_").match, names) if m}) == list(range(1, 14))


def test_query_columns(spark):
    from epiframe.llm.queries import QUERIES

    got = QUERIES["op8_sharding"](spark, SF001)
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(got.columns)
