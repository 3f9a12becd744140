"""Operator 5: toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, fresh_names, keep, mix64, row_runs, stored, temporary_tables, whole_text, Words


def text_terms(texts: pa.Array, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word occurrence: the word, and its first bytes where it is longer."""
    words = Words(texts, ALNUM)
    rows, terms = [words.docs], [words.hashes]
    for size in stems:
        longer = words.ends - words.starts > size
        rows.append(words.docs[longer])
        starts = words.starts[longer]
        terms.append(mix64(words.span_hash(starts, starts + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(terms)


def held_out(id_col: str):
    """The rows no label may be learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Index:
    """Block-max inverted index over example vectors; exact nearest examples by cosine.

    Examples are sorted by their heaviest term and cut into blocks; per term the index
    holds its postings and, for every block it occurs in, its largest weight there. A
    query adds up its terms' block maxima and scores blocks from the highest bound on,
    until no other block can reach the k-th best. Terms of one example in 16 or
    more, whose block maxima would tell little, are added up first, for many queries at
    once: their sums' largest value in a block is their part of its bound.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_terms: int, block: int = 64):
        heaviest = np.array([t[np.argmax(w)] for t, w in vectors], dtype=np.int64)
        order = np.lexsort((np.arange(len(vectors)), heaviest))
        self.labels, self.ids, self.block = labels[order], [ids[i] for i in order], block
        self.n, self.blocks = len(order), -(-len(order) // block)
        sizes = np.array([len(vectors[i][0]) for i in order], dtype=np.int64)
        term = np.concatenate([vectors[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if len(order) else np.zeros(0)
        example = np.repeat(np.arange(self.n), sizes)
        by_term = np.lexsort((example, term))
        self.example, self.weight, term = example[by_term], weight[by_term], term[by_term]
        key = term * max(1, self.blocks) + self.example // block
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        self.run = np.append(edge, len(key))  # postings of one term in one block
        self.run_block = self.example[edge] // block
        self.run_max = np.maximum.reduceat(self.weight, edge) if len(edge) else self.weight
        self.runs_of = np.searchsorted(term[edge], np.arange(n_terms + 1))
        # the terms of one example in 16 or more also stand as whole rows
        number = np.bincount(term, minlength=n_terms)
        common = np.flatnonzero(number * 16 > self.n)
        self.row_of = np.full(n_terms, -1)
        self.row_of[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        mine = self.row_of[term] >= 0
        self.rows[self.row_of[term[mine]], self.example[mine]] = self.weight[mine]

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms with whole rows add to every example's cosine, one row per query."""
        weight = np.zeros((len(queries), len(self.rows)))
        for own, (terms, weights) in zip(weight, queries):
            row = self.row_of[terms]
            own[row[row >= 0]] = weights[row >= 0]
        return weight @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 (ties: first in the index) and their cosines;
        ``base``: the query's row of ``common``, where it is known."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        base = self.common([(terms, weights)])[0] if base is None else base
        listed = self.row_of[terms] < 0
        terms, weights = terms[listed], weights[listed]
        number = self.runs_of[terms + 1] - self.runs_of[terms]
        upto = np.cumsum(number)
        runs = np.repeat(self.runs_of[terms] - (upto - number), number) + np.arange(upto[-1] if len(upto) else 0)
        own = np.repeat(weights, number)
        bound = np.maximum.reduceat(base, np.arange(0, self.n, self.block))
        bound = bound + np.bincount(self.run_block[runs], weights=own * self.run_max[runs], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, score = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, max(1, 16 * k // self.block)
        while at < len(order) and bound[order[at]] > 0 and (len(best) < k or bound[order[at]] >= score[-1] - 1e-12):
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[order[at:at + step]] = True
            at, step = at + step, 8 * step
            mine = np.flatnonzero(chosen[self.run_block[runs]])
            first = self.run[runs[mine]]
            size = self.run[runs[mine] + 1] - first
            ends = np.cumsum(size)
            post = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            found = np.bincount(self.example[post], weights=np.repeat(own[mine], size) * self.weight[post], minlength=self.n).astype(float)
            found += np.where(np.repeat(chosen, self.block)[:self.n], base, 0.0)
            if without >= 0:
                found[without] = 0
            new = np.flatnonzero(found)
            best, score = np.concatenate([best, new]), np.concatenate([score, found[new]])
            if len(best) > 4 * k:  # all that may be among the k best
                near = np.flatnonzero(score >= np.partition(score, -k)[-k] - 1e-9)
                best, score = best[near], score[near]
            keep = np.lexsort((best, -np.round(score, 12)))[:k]
            best, score = best[keep], score[keep]
        return best, np.minimum(score, 1.0)


class Model:
    """Terms with their weights, the examples' index, the vote's calibration."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, shared: np.ndarray, examples: list, k: int):
        self.terms, self.weight, self.k = terms, weight, k
        full = [(i, *self.vector(t, c), t, c, y) for i, t, c, y in examples if len(t)]
        labels = np.array([e[-1] for e in full], dtype=float)
        every = np.array([e[-1] for e in examples], dtype=float)
        self.prior = (every.sum() + 0.5) / (len(every) + 2)
        self.without = (every.sum() - labels.sum() + self.prior) / (len(every) - len(labels) + 1)  # of texts without terms
        self.index = Index([(e[1], e[2]) for e in full], labels, [e[0] for e in full], len(terms))
        # calibration: each example is scored by the others, then a logistic curve is fitted;
        # terms that only it has would be unknown in a text asked, so they are left out here
        place = {id_: n for n, id_ in enumerate(self.index.ids)}
        known = [self.vector(e[3][shared[e[3]]], e[4][shared[e[3]]]) for e in full]
        raw = [v for v, _, _ in self.votes(known, [place[e[0]] for e in full])]
        self.slope, self.shift = fit_logistic(np.array(raw), labels, self.without)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.weight[terms]
        return terms, weight / np.sqrt((weight * weight).sum()) if len(weight) else weight

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None, batch: int = 64) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic among the nearest, each weighted by 1 / (distance + 0.05), with these and their cosines."""
        for at in range(0, len(queries), batch):
            part = queries[at:at + batch]
            for n, ((terms, weights), base) in enumerate(zip(part, self.index.common(part))):
                near, cosine = self.index.nearest(terms, weights, self.k, without[at + n] if without else -1, base)
                w = 1 / (1.05 - cosine)
                yield float((w @ self.index.labels[near] + self.prior) / (w.sum() + 1)), near, cosine

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list, list]]:
        """Score, neighbours and cosines of texts given as (terms, counts)."""
        votes = self.votes([self.vector(t, c) for t, c in texts])
        for (t, _), (raw, near, cosine) in zip(texts, votes):
            if len(t):
                yield float(1 / (1 + np.exp(-(self.slope * raw + self.shift)))), [self.index.ids[i] for i in near], cosine.tolist()
            else:
                yield float(self.without), [], []


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float, steps: int = 50) -> tuple[float, float]:
    """Logistic curve of y over x by Newton steps, lightly held near slope 6; without data, ``rate``."""
    if not len(x):
        return 0.0, float(np.log(rate / (1 - rate))) if 0 < rate < 1 else 0.0
    a, b = 6.0, -3.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * x + b)))
        s = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.05 * (a - 6), (p - y).sum() + 0.05 * (b + 3)])
        h = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 0.05]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def count_terms(sample: DataFrame, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every term of the examples in order, the examples that hold it, the toxic ones of these."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) == 1
            for lo, hi in row_runs(b.column("text")):
                row, term = text_terms(b.column("text").slice(lo, hi - lo), stems)
                order = np.lexsort((row, term))
                row, term = row[order], term[order]
                new = np.ones(len(row), dtype=bool)  # once per document
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                row, term = row[new], term[new]
                unique, where = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array(unique.view(np.int64)), "pos": pa.array(np.bincount(where, weights=toxic[lo + row], minlength=len(unique)).astype(np.int64)),
                    "n": pa.array(np.bincount(where, minlength=len(unique)).astype(np.int64))})

    found = (sample.select("text", "toxic").mapInArrow(count, "term long, pos long, n long")
             .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow())
    term, pos, n = (found.column(c).to_numpy() for c in ("term", "pos", "n"))
    order = np.argsort(term.view(np.uint64))
    return term.view(np.uint64)[order], n[order], pos[order]


def label_weight(n: np.ndarray, pos: np.ndarray, examples: int, toxic: int) -> np.ndarray:
    """1 + the root of a term's log-likelihood ratio to the label, as far as that is above
    what the luckiest of so many terms reaches by chance; no term weighs less than 1."""
    if not 0 < toxic < examples or not len(n):
        return np.ones(len(n))

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / expected), 0.0)

    rate, out, others = toxic / examples, np.zeros(len(n)), examples - n
    for k, of, r in ((pos, n, rate), (n - pos, n, 1 - rate), (toxic - pos, others, rate), (others - toxic + pos, others, 1 - rate)):
        out += part(k, np.maximum(of * r, 1e-9))
    return 1 + np.sqrt(np.maximum(0, 2 * out - 2 * np.log(len(n))))


def run_vectors(texts: pa.Array, terms: np.ndarray, mark: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``terms`` and counts of whole texts, and the edges of each text's part."""
    row, term = text_terms(texts, stems)
    maybe = mark[(term & np.uint64(len(mark) - 1)).astype(np.int64)]
    row, term = row[maybe], term[maybe]
    place = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    sure = terms[place] == term if len(terms) else np.zeros(0, bool)
    key, counts = np.unique(row[sure] * (len(terms) + 1) + place[sure], return_counts=True)
    return key % (len(terms) + 1), counts, np.searchsorted(key // (len(terms) + 1), np.arange(len(texts) + 1))


def term_marks(terms: np.ndarray, bits: int = 22) -> np.ndarray:
    mark = np.zeros(1 << bits, dtype=bool)
    mark[(terms & np.uint64(len(mark) - 1)).astype(np.int64)] = True
    return mark


def document_frequencies(texts: DataFrame, terms: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """In how many rows each term occurs, and the number of rows; a task returns each term once."""

    def places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(len(terms) + 1, dtype=np.int64), term_marks(terms)
        for b in rows:
            total[-1] += b.num_rows
            for lo, hi in row_runs(b.column("text")):
                place, _, _ = run_vectors(b.column("text").slice(lo, hi - lo), terms, mark, stems)
                total[:-1] += np.bincount(place, minlength=len(terms))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used), "n": pa.array(total[used])})

    got = texts.select("text").mapInArrow(places, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, dtype=np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = 2000, stems: tuple[int, ...] = (5,), k: int = 15,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted, neighbours, cosines.

    Learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0; of these at
    most ``max_examples`` ids (those with the lowest hash), the bound on all that is held
    in memory. Every term (word, or first bytes of a longer one) of the examples is in the
    index and weighs idf, counted over all documents, times its link to the label (at
    least 1). A text's score is the calibrated vote of its k nearest examples by exact
    cosine in the space of these terms; terms that no example has are not in it. All
    voting neighbours are returned, nearest first. A text that has no term of any example,
    so also a null or empty one, gets the toxic share of such examples. Labels that are
    null count as no label, several of one id as their largest; of an example id that
    repeats the smallest text counts. Without any labels every score is 0.25. Other
    columns of the tables are not read, whatever their names.
    """
    usable = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic")))
    chosen = stored(usable.orderBy(F.xxhash64("_id"), "_id").limit(max_examples), "examples")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    # at most max_examples ids are sent to the tasks
    sample = stored(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
                    .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "sample")
    terms, n, pos = count_terms(sample, stems)
    examples, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    df, rows = document_frequencies(texts, terms, stems)
    weight = (np.log((rows + 1) / (df + 1)) + 1) * label_weight(n, pos, examples, toxic)

    def vectors(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = term_marks(terms)
        for b in batch_iter:
            for lo, hi in row_runs(b.column("text")):
                place, counts, edges = run_vectors(b.column("text").slice(lo, hi - lo), terms, mark, stems)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(lo, hi - lo), b.column("toxic").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(counts, pa.int32()))], ["doc_id", "toxic", "terms", "counts"])

    own = sample.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    model = Model(terms, weight, n > 1, [
        (i, t.values.to_numpy().astype(np.int64), c.values.to_numpy(), y)
        for i, t, c, y in zip(own.column("doc_id").to_pylist(), own.column("terms"), own.column("counts"), own.column("toxic").to_pylist())], k)

    def vote(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = term_marks(terms)
        for b in batch_iter:
            for lo, hi in row_runs(b.column("text")):
                place, counts, edges = run_vectors(b.column("text").slice(lo, hi - lo), terms, mark, stems)
                out = list(model.scores([(place[x:y], counts[x:y]) for x, y in zip(edges[:-1], edges[1:])]))
                score = np.array([o[0] for o in out], dtype=float)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo), "held_out": b.column("held_out").slice(lo, hi - lo), "score": pa.array(score),
                    "predicted": pa.array((score >= 0.5).astype(np.int32)),
                    "neighbours": pa.array([o[1] for o in out], pa.list_(pa.int64())), "cosines": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    return texts.mapInArrow(vote, "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>")


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Documents whose predicted label is 0, with all their columns. An id has one fate:
    it goes if any of its rows is predicted toxic; rows without id are never matched and stay.
    Names of columns never clash."""
    id_col = options.get("id_col", "doc_id")
    bad_id = fresh_names(docs, "_bad")[0]
    with temporary_tables(docs.sparkSession):
        bad = score_toxicity(docs, labels, **options).filter("predicted = 1").select(F.col("doc_id").alias(bad_id)).distinct()
        bad = keep(stored(bad, "rejected"))
    return docs.join(bad, F.col(f"`{id_col}`") == F.col(bad_id), "left_anti")
