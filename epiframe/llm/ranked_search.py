"""Operator 12: best documents of every item, over groups of documents with the same matched terms."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, row_runs, stored, whole_text

# Fixed values of the score: scale of a term's part, weight of the length norm, share of it that grows with the length (in percent).
PART, NORM, GROWING = 1_000_000_000, 8, 90
#: Cells of one matrix of terms by documents.
CELLS = 8_000_000
_NULL_ID = np.iinfo(np.int64).max


class Items:
    """Distinct terms of a block of items: one vocabulary, and each item's places in it."""

    def __init__(self, texts: list[str]):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        self.vocabulary = np.unique(words.hashes)
        at = np.searchsorted(self.vocabulary, words.hashes)
        self.terms = [np.unique(at[lo:hi]) for lo, hi in zip(words.first, words.first[1:])]

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the vocabulary's terms in a batch."""
        size = max(1, len(self.vocabulary))
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), size - 1)
        known = self.vocabulary[at] == words.hashes if len(self.vocabulary) else np.zeros(len(at), bool)
        key, n = np.unique(words.docs[known] * size + at[known], return_counts=True)
        return key // size, key % size, n


def statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents of every term of the items."""
    terms = len(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, df = 0, 0, np.zeros(terms, dtype=np.int64)
        for b in batches:
            for lo, hi in row_runs(b.column("text")):
                words = Words(b.column("text").slice(lo, hi - lo), ALNUM)
                held += int((np.diff(words.first) > 0).sum())
                total += len(words.hashes)
                df += np.bincount(items.counts(words)[1], minlength=terms)[:terms]
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([[-2, -1], there])), "n": pa.array(np.concatenate([[held, total], df[there]]))})

    out = np.zeros(terms + 2, dtype=np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"] + 2] = r["n"]
    return int(out[0]), int(out[1]), out[2:]


class Best:
    """The k best documents of one item so far, by score, then id (null last)."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score[score > 0]]), np.concatenate([self.id, ids[score > 0]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def best_of_run(parts: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best, tops: np.ndarray) -> int:
    """Add a run's documents to an item's best; returns the number of documents scored.

    ``parts`` (terms by documents) holds each term's part of the score. The rows' bitmaps,
    read across, are the documents' masks of matched terms. A mask's maximum is the sum of
    its terms' weighted highest parts. Documents are grouped by mask, masks evaluated from
    the highest maximum on until it falls below the k-th best score (equal scores still
    count: a smaller id may win).
    """
    masks = np.packbits(parts > 0, axis=0)  # eight terms a row, a document a column
    high = np.zeros(8 * len(masks), dtype=np.int64)
    high[: len(weights)] = weights * tops
    most = np.zeros(masks.shape[1], dtype=np.int64)
    for row, of_byte in zip(masks, high.reshape(-1, 8) @ _BITS.T):
        most += of_byte[row]
    open_docs = np.flatnonzero(most >= best.least())
    if not len(open_docs):
        return 0
    wide = np.zeros((len(open_docs), -(-len(masks) // 8) * 8), dtype=np.uint8)
    wide[:, : len(masks)] = masks[:, open_docs].T
    wide = wide.view(np.uint64)
    order = np.lexsort((*wide.T, -most[open_docs]))
    docs, wide = open_docs[order], wide[order]
    first = np.flatnonzero(np.concatenate([[True], (wide[1:] != wide[:-1]).any(axis=1)]))  # one mask from each on
    edge, upper, scored, at = np.append(first, len(docs)), most[docs[first]], 0, 0
    while at < len(first) and upper[at] >= best.least():
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + 4 * best.k, "right")) - 1)  # whole masks, some documents
        to = min(to, int(np.searchsorted(-upper, -best.least(), "right")))
        group = docs[edge[at]:edge[to]]
        best.add(weights @ parts[:, group].astype(np.int64), ids[group])
        scored, at = scored + len(group), to
    return scored


def rank(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
         id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """The k best documents of every item: item_id, rank (from 1), doc_id, score (whole numbers).

    Terms are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased. N documents
    hold a term, L terms in all; a term of df documents weighs w = floor(1000 ln((2N + 2) /
    (2 df + 1))); a document of n terms has m = 10 + 90 n N div L and scores the sum of
    w (10^9 tf div (1000 tf + 8 m)) over the item's terms, once each. Documents without a
    common term or with score 0 are not returned; equal scores rank by ascending id, null last.

    N, L and df are counted over all documents first. Then each task reads its documents
    in runs and keeps k documents an item; the tasks' answers, k rows an item each, are
    merged. Items are sent to the tasks in blocks of about ``block_bytes`` of text.

    Null texts have no term: as items no answer, as documents never returned. Repeated
    rows of ``docs`` are documents of their own; equal (id, text) items are one, other
    items of one id are ranked on their own under that id. Empty tables give no rows.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(F.col(f"`{text_col}`")).alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), whole_text(F.col(f"`{item_text}`")).alias("text")).distinct()
    asked = stored(asked.withColumn("item", F.concat_ws(":", F.lit(uuid.uuid4().hex), F.xxhash64("item_id", "text"), F.sha2("text", 256))), "items")
    blocks = math.ceil((asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 1) / block_bytes)
    answers = None
    for n in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).select("item", "text").toArrow()
        if some.num_rows:
            part = stored(_answers(some.column("item").to_pylist(), Items(some.column("text").to_pylist()), rows, k), "ranked")
            answers = part if answers is None else answers.unionByName(part)
    if answers is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _answers(names: list[str], items: Items, docs: DataFrame, k: int) -> DataFrame:
    held, total, df = statistics(docs, items)
    weight = np.array([math.floor(1000 * math.log((2 * held + 2) / (2 * int(f) + 1))) for f in df], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((names, items, weight))
    run_rows = max(64, min(4096, CELLS // max(1, len(items.vocabulary))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, weight = sent.value
        best = [Best(k) for _ in names]
        for b in batches:
            ids = b.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for lo, hi in row_runs(b.column("text"), 4_000_000):
                words = Words(b.column("text").slice(lo, hi - lo), ALNUM)
                m = 100 - GROWING + GROWING * np.diff(words.first) * held // max(1, total)
                row, term, n = items.counts(words)
                part = PART * n // (1000 * n + NORM * m[row])
                for at in range(0, hi - lo, run_rows):
                    to = min(at + run_rows, hi - lo)
                    a, z = np.searchsorted(row, [at, to])
                    dense = np.zeros((len(items.vocabulary), to - at), dtype=np.int32)
                    dense[term[a:z], row[a:z] - at] = part[a:z]
                    tops = dense.max(axis=1, initial=0).astype(np.int64)
                    for item, own in zip(best, items.terms):
                        own = own[tops[own] > 0]
                        for c in range(0, to - at, width := max(1, CELLS // max(1, len(own)))):
                            if len(own):
                                best_of_run(dense[own, c:c + width], weight[own], ids[lo + at + c:lo + to], item, tops[own])
        size = [len(x.score) for x in best]
        doc = np.concatenate([x.id for x in best])
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(np.repeat(np.array(names, dtype=object), size), pa.string()), "doc_id": pa.array(doc, mask=doc == _NULL_ID),
            "score": pa.array(np.concatenate([x.score for x in best]))})

    return docs.mapInArrow(answer, "item string, doc_id long, score long")
