"""Operator 13: spelling variants by a scan of the sorted vocabulary with banded edit matrices."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, row_runs, stored, whole_text

# Fixed values of the words: shortest word, least occurrences, one occurrence in so many loses a letter.
SHORTEST, LEAST, LOSES = 7, 2, 31
#: How much commoner a word's form is.
COMMONER = 10
_FAR = 9


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # U+00C0 to U+00FF: 0xC3, then 0x80 to 0xBF


def _letters(data: np.ndarray) -> np.ndarray:
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return inside


def _crc32(start: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes, continued from ``start``."""
    order = np.argsort(-sizes, kind="stable")
    state, begin, size = ~start[order], begins[order], sizes[order]
    short = int(np.searchsorted(-size, -64))  # longer words one by one
    for i in range(short):
        state[i] = ~np.uint32(zlib.crc32(data[begin[i]:begin[i] + size[i]].tobytes(), int(~state[i])))
    for j in range(int(size[short]) if short < len(size) else 0):
        end = int(np.searchsorted(-size, -j))
        some = state[short:end]
        state[short:end] = _CRC[(some ^ data[begin[short:end] + j]) & np.uint32(255)] ^ (some >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): all words of the texts, after the loss of letters; see ``spelling_forms``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), whole_text(F.col(f"`{text_col}`")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for lo, hi in row_runs(b.column("text"), 2_000_000):
                words = Words(b.column("text").slice(lo, hi - lo), _letters)
                low = words.data.copy()
                upper = (low >= 65) & (low <= 90)
                low[upper] += 32
                tail = np.concatenate([[0], np.cumsum((low & 0xC0) == 0x80)])
                length = words.ends - words.starts - (tail[words.ends] - tail[words.starts])
                at = np.flatnonzero(length >= SHORTEST)
                begin, size, length = words.starts[at], (words.ends - words.starts)[at], length[at]
                first = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in b.column("id").slice(lo, hi - lo).to_pylist()], dtype=np.uint32)
                crc = _crc32(first[words.docs[at]], low, begin, size)
                raw, lost = low.tobytes(), crc % LOSES == 0
                whole = at[~lost]
                _, one, n = np.unique(words.hashes[whole], return_index=True, return_counts=True)
                where = whole[one]
                for a, z, c in zip(words.starts[where].tolist(), words.ends[where].tolist(), n.tolist()):
                    counts[raw[a:z]] = counts.get(raw[a:z], 0) + c
                shorter = lost & (length > SHORTEST)
                for a, s, n, h in zip(*(x[shorter].tolist() for x in (begin, size, length, crc))):
                    word, cut = raw[a:a + s].decode(), h % n
                    word = (word[:cut] + word[cut + 1:]).encode()
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > 300_000:
                    yield _counted(counts)
                    counts = {}
        yield _counted(counts)

    def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()).cast(pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the scan of a sorted list
class SortedList:
    """Distinct sorted words as one run of code points, with the prefix each shares with the word before."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.lcp = np.zeros(n + 1, dtype=np.int64)
        for i in range(1, n):
            self.lcp[i] = shared(words[i - 1], words[i])
        #: The next place whose shared prefix is shorter: what skips a range.
        self.after = np.full(n + 1, n, dtype=np.int64)
        stack: list[int] = []
        for i, p in enumerate(self.lcp.tolist()):
            while stack and self.lcp[stack[-1]] > p:
                self.after[stack.pop()] = i
            stack.append(i)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs of exactly one edit that share the query's first half (``half``).

        All queries scan together, a matrix row each at a time. A row holds the three cells
        about the diagonal. Rows of the prefix that the next word shares stay; once all
        three cells exceed one, every word that shares this prefix is skipped.
        """
        found_q, found_w = [], []
        order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
        at = 0
        while at < len(order):  # queries of like length, so that the padded rows stay small
            to = at + 1
            while to < len(order) and (to - at) * len(queries[order[to]]) < 400_000:
                to += 1
            some = order[at:to]
            q, w = self._scan([queries[i] for i in some])
            found_q.append(np.array(some, dtype=np.int64)[q])
            found_w.append(w)
            at = to
        return (np.concatenate(found_q), np.concatenate(found_w)) if found_q else (np.zeros(0, np.int64),) * 2

    def _scan(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(q) for q in queries], dtype=np.int64)
        longest = int(size.max())
        letters = np.zeros((len(queries), longest + 4), dtype=np.uint32)  # one in front, 0 behind: no letter
        flat = np.frombuffer("".join(queries).encode("utf-32-le"), dtype=np.uint32)
        letters[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = flat
        depth = (size - 1) // 2
        word = np.array([bisect_left(self.words, q[:h]) for q, h in zip(queries, depth.tolist())], dtype=np.int64)
        stop = np.array([bisect_right(self.words, q[:h] + "\U0010ffff") for q, h in zip(queries, depth.tolist())], dtype=np.int64)
        rows = np.full((len(queries), longest + 4, 3), _FAR, dtype=np.uint8)
        every = np.arange(len(queries))
        rows[every, depth] = np.stack([np.where(depth > 0, 1, _FAR), np.zeros_like(depth), np.ones_like(depth)], axis=1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        act = every[word < stop]
        word, stop, depth = word[act], stop[act], depth[act]
        while len(act):
            row, over = rows[act, depth].T, self.size[word] <= depth
            a, b, c = row
            letter = self.codes[np.minimum(self.first[word] + depth, len(self.codes) - 1)]
            x = np.minimum(a + (letter != letters[act, depth]), b + 1)
            y = np.minimum(np.minimum(b + (letter != letters[act, depth + 1]), c + 1), x + 1)
            z = np.minimum(c + (letter != letters[act, depth + 2]), y + 1)
            new = np.minimum(np.stack([x, y, z], axis=1), _FAR)
            depth = depth + 1
            rows[act, depth] = new
            dead = over | (new.min(axis=1) > 1)
            end = ~dead & (depth == self.size[word])
            hit = np.flatnonzero(end)
            cell = size[act[hit]] - self.size[word[hit]] + 1
            hit, cell = hit[(cell >= 0) & (cell <= 2)], cell[(cell >= 0) & (cell <= 2)]
            hit = hit[new[hit, cell] == 1]
            found.append((act[hit], word[hit]))
            moved = np.flatnonzero(dead | end)
            to, reach = word[moved] + 1, depth[moved]
            skip = np.flatnonzero(dead[moved] & ~over[moved])
            skip = skip[(to[skip] < stop[moved[skip]])]
            while len(skip):  # ranges that share the dead prefix
                skip = skip[self.lcp[to[skip]] >= reach[skip]]
                to[skip] = self.after[to[skip]]
                skip = skip[to[skip] < stop[moved[skip]]]
            word[moved] = to
            depth[moved] = np.minimum(reach, self.lcp[np.minimum(to, len(self.words))])
            open_ = word < stop
            if not open_.all():
                act, word, stop, depth = act[open_], word[open_], stop[open_], depth[open_]
        return np.concatenate([f[0] for f in found] or [every[:0]]), np.concatenate([f[1] for f in found] or [every[:0]])


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 16:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    while a[lo] == b[lo]:
        lo += 1
    return lo


def _front_half(a: str, b: str) -> bool:
    """Is the first half of the shorter word common? If not, the one edit is in it, and the last half is."""
    half = min(len(a), len(b)) // 2
    return a[:half] == b[:half]


def best_near(words: list[str], counts: list[int], queries: list[str], backward: bool) -> tuple[list, list, list, list]:
    """(query, near words in the list, largest count, its word): of the pairs this direction is for."""
    listed = SortedList(words)
    q, w = listed.near(queries)
    keep = np.fromiter((_front_half(queries[i][::-1], words[j][::-1]) != backward if backward else _front_half(queries[i], words[j])
                        for i, j in zip(q.tolist(), w.tolist())), dtype=bool, count=len(q))
    q, w = q[keep], w[keep]
    place = np.arange(len(words))
    if backward:
        by = sorted(range(len(words)), key=lambda i: words[i][::-1])
        place[by] = np.arange(len(words))
    n = np.array(counts, dtype=np.int64)
    order = np.lexsort((place[w], -n[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    return ([queries[i] for i in q[first].tolist()], np.diff(np.append(first, len(q))).tolist(), n[w[first]].tolist(),
            [words[j] for j in w[first].tolist()])


# ---------------------------------------------------------------- ranges of the sorted vocabulary
_HEAD = 64


class Ranges:
    """First and last words (64 code points of them) of the sorted vocabulary's ranges."""

    def __init__(self, bounds: list[tuple[int, str, str]]):
        bounds = sorted(bounds, key=lambda b: b[1])
        self.ids = [b[0] for b in bounds]
        self.low, self.high = [b[1][:_HEAD] for b in bounds], [b[2][:_HEAD] for b in bounds]
        self.common = [a[:shared(a, b)] for a, b in zip(self.low, self.high)]

    def of(self, word: str) -> list[int]:
        """Ranges that may hold words of one edit that share the word's first half."""
        head = word[:min((len(word) - 1) // 2, _HEAD)]
        lo, hi = bisect_left(self.high, head), bisect_right(self.low, head + "\U0010ffff")
        return [self.ids[i] for i in range(lo, hi) if hi - lo < 3 or _prefix_within_one(self.common[i], word)]


def _prefix_within_one(prefix: str, word: str) -> bool:
    """Is some prefix of the word at most one edit from ``prefix``?"""
    p = shared(prefix, word)
    if p == len(prefix) or p == len(word):
        return len(prefix) - p <= 1
    rest = prefix[p + 1:]
    return word.startswith(rest, p + 1) or word.startswith(rest, p) or word.startswith(prefix[p:], p + 1)


def _near(vocabulary: DataFrame, backward: bool, rows_per_range: int) -> DataFrame:
    """(word, n_near, n, form) of the pairs whose edit is in the last half (backward: in the first)."""
    turn = F.reverse if backward else (lambda c: c)
    total = vocabulary.count()
    ranges = min(1 << 16, max(1, math.ceil(total / rows_per_range)))
    listed = stored(vocabulary.select(turn(F.col("word")).alias("word"), "n").repartitionByRange(ranges, "word")
                    .withColumn("range", F.spark_partition_id()), "sorted")
    bounds = Ranges([tuple(r) for r in listed.groupBy("range").agg(F.min("word"), F.max("word")).collect()])  # a row a range

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("word").to_pylist()
            to = [bounds.of(w) for w in words]
            yield pa.RecordBatch.from_pydict({"range": pa.array([r for x in to for r in x], pa.int32()),
                                              "word": pa.array([w for w, x in zip(words, to) for _ in x], pa.string())})

    routed = stored(listed.select("word").mapInArrow(route, "range int, word string"), "routed")
    slices = (routed.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * rows_per_range)).cast("int").alias("slices")))
    parts = 2 * ranges
    asked = (routed.join(F.broadcast(slices), "range")  # a row a range
             .withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).select("range", "slice", "word").repartition(parts, "range", "slice"))
    held = (listed.join(F.broadcast(slices), "range")
            .select("range", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "word", "n").repartition(parts, "range", "slice"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("word")
        names = ["word", "n_near", "n", "form"]
        return pa.table(dict(zip(names, best_near(right.column("word").to_pylist(), right.column("n").to_pylist(),
                                                  left.column("word").to_pylist(), backward) if left.num_rows and right.num_rows else ([],) * 4)),
                        schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n", pa.int64()), ("form", pa.string())]))

    near = asked.groupBy("range", "slice").cogroup(held.groupBy("range", "slice")).applyInArrow(scan, "word string, n_near long, n long, form string")
    return near.select(turn(F.col("word")).alias("word"), "n_near", "n", turn(F.col("form")).alias("form"))


def near_words(vocabulary: DataFrame, rows_per_range: int = 10_000) -> DataFrame:
    """For every word of ``vocabulary`` (word, n; distinct, stored) that has near words: word, n_near, form, form_n.

    Near: exactly one inserted, deleted or replaced code point. ``form`` is the near word
    of largest n, the smallest of equal ones. The sorted vocabulary is cut into ranges of
    about ``rows_per_range`` words; a word goes to the ranges that hold its first half
    (and, on reversed words, its last half), for one edit leaves one half as it is. A range asked
    by very many words is dealt to several tasks.
    """
    both = stored(_near(vocabulary, False, rows_per_range).unionByName(_near(vocabulary, True, rows_per_range)), "near")
    best = F.min(F.struct((-F.col("n")).alias("n"), "form"))
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 10_000) -> DataFrame:
    """Every word of the texts with the commoner word it is a variant of.

    Runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the whole texts, A-Z lower-cased, are occurrences.
    With h = crc32 of ``<doc_id>:<run>``, an occurrence loses its code point h % length
    where 31 divides h. Words are what remains, of 7 code points and 2 occurrences or more.

    Returns word; form: its near word (``near_words``) of largest n, if that n is 10 times
    its own or more; root: the last of the chain of forms, the word itself if it has none;
    n: occurrences; n_near: near words; form_n: the form's n.

    Null texts hold no words; a null id counts as an empty string; repeated rows count as
    often as they stand. An empty table gives an empty one. Other columns of ``docs`` are
    not read, whatever their names.
    """
    counted = word_counts(docs, id_col, text_col).filter((F.col("n") >= LEAST) & (F.char_length("word") >= SHORTEST))
    vocabulary = stored(counted, "vocabulary")
    near = near_words(vocabulary, rows_per_range)
    joined = vocabulary.join(near, "word", "left")
    commoner = F.col("form_n") >= COMMONER * F.col("n")
    forms = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(commoner, F.col("form")).alias("form"), F.when(commoner, F.col("form_n")).alias("form_n")), "forms")
    # every step multiplies n by 10: chains are short, and each round halves what is left of them
    roots = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return (forms.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
