"""Operator 3: benchmark decontamination by n-gram seeds and local alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, fresh_names, keep, mix64, row_runs, stored, temporary_tables, whole_text, Words

_U = np.uint64
MATCH, MISMATCH, GAP = 2, -1, -1
_ROWS = ("doc_id long, item_id long, score double, matched int, item_words int, start_word long, end_word long, passage string")


def patterns(size: int) -> list[tuple[int, ...]]:
    """Places of the words of a seed: ``size`` in a row, or of one more with an inner one left out."""
    row = tuple(range(size + 1))
    return [row[:size]] + [row[:j] + row[j + 1:] for j in range(1, size)]


def gram_hashes(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``places`` after every start; the same words hash alike, whatever their places."""
    n = max(0, len(words) - places[-1])
    acc = np.zeros(n, dtype=np.uint64)
    for j, p in enumerate(places):
        acc = mix64(acc + words[p:n + p] * _U(0x9E3779B97F4A7C15) + _U(j))
    return acc


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of first word, hash) of every seed that lies in one row."""
    place, acc = [], []
    for places in patterns(size):
        own = gram_hashes(words.hashes, places)
        inside = np.flatnonzero(words.docs[:len(own)] == words.docs[places[-1]:places[-1] + len(own)])
        place.append(inside)
        acc.append(own[inside])
    return np.concatenate(place), np.concatenate(acc)


class _Lookup:
    """Finds hashes in a sorted table; a bitmap turns most others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mark = np.zeros(1 << 22, dtype=bool)
        self.mark[(keys & _U((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, index into keys) of those that are present."""
        at = np.flatnonzero(self.mark[(hashes & _U((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        sure = self.keys[where] == hashes[at]
        return at[sure], where[sure]


def align(item: np.ndarray, text: np.ndarray, middle: bool = False) -> tuple[int, int]:
    """Smith-Waterman over word hashes: best local score and the end (past the last word) in text.

    Of several ends in one row of the table the first counts, or the middle one.
    """
    at = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for w in item:
        step = np.where(text == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + step, out=new[1:])
        row = np.maximum.accumulate(new + at) - at  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            ties = np.flatnonzero(row == row[top]) if middle else [top]
            best, end = int(row[top]), int(ties[len(ties) // 2])
    return best, end


class Seeds:
    """The seeds of one block of items: gram -> (item, place in item), and the items' words."""

    def __init__(self, item_ids: list, items: list[np.ndarray], size: int):
        self.ids, self.items = item_ids, items
        key, item, place = [], [], []
        self.needed = np.zeros(len(items), dtype=np.int64)
        for n, words in enumerate(items):
            own = [gram_hashes(words, places) for places in patterns(size)]
            if not len(own[0]):
                continue
            key += own
            item.append(np.full(sum(map(len, own)), n))
            place += [np.arange(len(o)) for o in own]
            self.needed[n] = min(2, len(np.unique(np.concatenate(own))))
        empty = np.zeros(0, dtype=np.int64)
        key = np.concatenate(key) if key else empty.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        self.item = np.concatenate(item)[order] if item else empty
        self.place = np.concatenate(place)[order] if place else empty
        keys, first = np.unique(key[order], return_index=True)
        self.lookup, self.first = _Lookup(keys), np.append(first, len(key))


def leaks(words: Words, seeds: Seeds, size: int, least_score: float) -> list[tuple]:
    """(row, item, score, matched, start, end) of aligned passages; words counted in the row."""
    place, hashes = grams(words, size)
    at, key = seeds.lookup.find(hashes)
    if not len(at):
        return []
    number = seeds.first[key + 1] - seeds.first[key]
    seed = np.repeat(seeds.first[key] - (np.cumsum(number) - number), number) + np.arange(number.sum())
    where, gram = np.repeat(place[at], number), np.repeat(key, number)
    item, row = seeds.item[seed], words.docs[where]
    order = np.lexsort((where, item, row))
    where, gram, item, row = where[order], gram[order], item[order], row[order]
    offset = seeds.place[seed][order]
    length = np.array([len(w) for w in seeds.items])
    new = np.ones(len(where), dtype=bool)  # a run of hits: one row, one item, no gap longer than the item
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (where[1:] - where[:-1] > length[item[1:]])
    edges = np.append(np.flatnonzero(new), len(where)).tolist()
    run = np.unique((np.cumsum(new) - 1) * len(seeds.first) + gram) // len(seeds.first)  # once per seed
    enough = np.bincount(run, minlength=len(edges) - 1) >= seeds.needed[item[edges[:-1]]]
    out = []
    for k in np.flatnonzero(enough).tolist():
        a, b = edges[k], edges[k + 1]
        n, r = int(item[a]), int(row[a])
        own, at, from_row = seeds.items[n], where[a:b], int(words.first[r])
        slack = len(own) // 2 + 2
        todo = [(max(from_row, int((at - offset[a:b]).min()) - slack),
                 min(int(words.first[r + 1]), int((at - offset[a:b]).max()) + len(own) + slack))]
        while todo:  # what stands before and behind a passage may hold another
            lo, hi = todo.pop()
            if len(np.unique(gram[a:b][(at >= lo) & (at <= hi - size)])) < seeds.needed[n]:
                continue
            text = words.hashes[lo:hi]
            best, end = align(own, text, middle=True)
            if best < least_score * MATCH * len(own):
                continue
            longest = (MATCH + 1) * len(own) - best  # every word more costs a gap
            back, length_back = align(own[::-1], text[max(0, end - longest):end][::-1])
            start = end - length_back
            matched = int(np.isin(own, text[start:end]).sum())
            out.append((r, n, best / (MATCH * len(own)), matched, lo + start - from_row, lo + end - from_row))
            todo += [(lo, lo + start), (lo + end, hi)]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 3,
               least_score: float = 0.4, words_per_block: int = 700_000, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Passages of documents that copy a benchmark item, also edited or paraphrased.

    Words are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased. Every
    ``size``-gram of an item is a seed, also one with a word left out inside, in the item or
    in the text; an edit leaves none that could be told by its frequency. Where two
    different seeds of an item stand close together in a document, the item is aligned with the words around (match +2, mismatch -1, gap -1); passages of
    at least ``least_score`` of an unchanged copy's score are returned: doc_id, item_id,
    score, matched, item_words, start_word, end_word (words from 0), passage (the text).
    With the defaults, no copy of an item of over 25 different words that has words replaced
    and reaches that score is missed: at least 60 % of the words stand, so that about one in
    five stretches of four words or more holds three, a seed. Among inserted and dropped words, two
    seeds need three words of four in place twice.

    Items are taken in blocks of about ``words_per_block`` words, the bound on what is
    sent to the tasks; each block is one pass over the documents, in which no text is
    moved. Null and empty texts and items, and items of fewer than ``size`` words, match
    nothing. Repeated rows give repeated results; null ids are kept.
    """
    items = stored(benchmark.select(F.col(item_col).cast("long").alias("item_id"), whole_text(item_text_col).alias("text")), "items")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / 5 / words_per_block))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    found = [_leaks_of_block(rows, items.filter(F.col("block") == n), size, least_score) for n in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _leaks_of_block(rows: DataFrame, block: DataFrame, size: int, least_score: float) -> DataFrame:
    own = sorted(((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in block.select("item_id", "text").collect()))
    words = Words(pa.array([t for _, _, t in own], pa.string()), ALNUM)
    items = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    ids = [None if empty else i for empty, i, _ in own]
    seeds = Seeds(ids, items, size)

    def search(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            for lo, hi in row_runs(b.column("text")):
                texts = b.column("text").slice(lo, hi - lo)
                text = Words(texts, ALNUM)
                out = leaks(text, seeds, size, least_score)
                if not out:
                    continue
                row, item, score, matched, start, end = (list(c) for c in zip(*out))
                passage = []
                for r, s, e in zip(row, start, end):
                    a, z = text.starts[text.first[r] + s], text.ends[text.first[r] + e - 1]
                    passage.append(text.data[a:z].tobytes().decode())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)),
                    "item_id": pa.array([seeds.ids[i] for i in item], pa.int64()), "score": pa.array(score, pa.float64()),
                    "matched": pa.array(matched, pa.int32()), "item_words": pa.array([len(seeds.items[i]) for i in item], pa.int32()),
                    "start_word": pa.array(start, pa.int64()), "end_word": pa.array(end, pa.int64()), "passage": pa.array(passage, pa.string())})

    return rows.mapInArrow(search, _ROWS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any leaked passage, with all their columns. An id has one fate:
    it goes if any of its rows has a leak; rows without id are never matched and stay.
    Names of columns never clash."""
    id_col = options.get("id_col", "doc_id")
    bad_id = fresh_names(docs, "_bad")[0]
    with temporary_tables(docs.sparkSession):
        bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias(bad_id)).filter(F.col(bad_id).isNotNull()).distinct()
        bad = keep(stored(bad, "leaked"))
    return docs.join(bad, F.col(f"`{id_col}`") == F.col(bad_id), "left_anti")
