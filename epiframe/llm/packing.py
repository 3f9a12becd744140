"""Operator 2: best-fit packing by non-negative least squares over length patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_rows, row_runs, stored, whole_text
from .tokens import append_id, default_vocabulary, encoder


def exact_patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of two or three present lengths that fill a sequence exactly.

    One row per pattern, lengths ascending; 0 stands for "no third document".
    """
    present = np.flatnonzero(hist)
    present = present[(present > 0) & (present < capacity)]
    a, b = np.meshgrid(np.concatenate([[0], present]), present, indexing="ij")
    c = capacity - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = (hist[c] > 0) & (c < capacity)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_counts(patterns: np.ndarray, hist: np.ndarray, capacity: int, rounds: int = 60, add: int = 96) -> np.ndarray:
    """Non-negative least squares: repeat counts x with (uses of each length) ~ hist.

    Active-set method: the columns with the steepest descent join the passive set,
    the normal equations are solved on it, and columns that turn negative leave.
    """
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    h = hist.astype(float).copy()
    h[0] = 0
    passive = np.zeros(len(patterns), dtype=bool)

    def uses(counts: np.ndarray) -> np.ndarray:
        out = np.zeros(capacity + 1)
        rows = np.flatnonzero(counts)
        for j in range(3):
            np.add.at(out, patterns[rows, j], counts[rows])
        out[0] = 0
        return out

    def solve(cols: np.ndarray) -> np.ndarray:
        m = np.zeros((capacity + 1, len(cols)))
        for j in range(3):
            np.add.at(m, (patterns[cols, j], np.arange(len(cols))), 1.0)
        m[0] = 0
        m = m[hist > 0]
        return np.linalg.solve(m.T @ m + 1e-6 * np.eye(len(cols)), m.T @ h[hist > 0])

    tolerance = 1e-3 * max(1.0, h.max())
    for _ in range(rounds):
        left = h - uses(x)
        left[0] = 0
        gain = left[patterns].sum(axis=1)
        gain[passive] = -np.inf
        best = np.argsort(-gain, kind="stable")[:add * 8]
        taken: set[int] = set()
        added = 0
        for j in best:  # lengths not met twice in a round keep the equations well posed
            own = {int(v) for v in patterns[j] if v}
            if gain[j] <= tolerance or added == add:
                break
            if not own & taken:
                taken |= own
                passive[j] = True
                added += 1
        if not added or passive.sum() > 2 * capacity:
            break
        while True:
            cols = np.flatnonzero(passive)
            z = solve(cols)
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            old, low = x[cols], z <= 0
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-12))
            moved = old + step * (z - old)
            x[:] = 0
            x[cols] = np.maximum(moved, 0)
            passive[cols[low & (moved <= 1e-9)]] = False
            if not (low & (moved <= 1e-9)).any():
                passive[cols[low]] = False
            if not passive.any():
                break
    return x


def best_fit(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: longest first, each into the fullest place it fits."""
    spaces: dict[int, dict[tuple[int, ...], int]] = {}

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            group = spaces.setdefault(space, {})
            group[pattern] = group.get(pattern, 0) + count

    for length in np.flatnonzero(hist)[::-1]:
        length, left = int(length), int(hist[length])
        if length == 0:
            continue
        while left:
            space = min((s for s in spaces if s >= length), default=None)
            if space is None:
                pattern, count, space = (), left, capacity
            else:
                pattern, count = spaces[space].popitem()
                if not spaces[space]:
                    del spaces[space]
            each = space // length
            full = min(count, left // each)
            put(space - each * length, pattern + (length,) * each, full)
            left -= full * each
            count -= full
            if count and left:
                put(space - left * length, pattern + (length,) * left, 1)
                left, count = 0, count - 1
            if pattern:
                put(space, pattern, count)
    return [(p, c) for group in spaces.values() for p, c in group.items()]


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with repeat counts that use up ``hist`` exactly."""
    left = hist.astype(np.int64).copy()
    out = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = exact_patterns(left, capacity)
    counts = np.rint(fit_counts(patterns, left, capacity)).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] < 1:
            break
        lengths = [int(v) for v in patterns[j][::-1] if v]
        need = {v: lengths.count(v) for v in lengths}
        repeat = min(int(counts[j]), *(int(left[v]) // k for v, k in need.items()))
        if repeat > 0:
            for v, k in need.items():
                left[v] -= repeat * k
            out.append((tuple(lengths), repeat))
    return out + best_fit(left, capacity)


class _Slots:
    """Every place of the plan: the n-th piece of a length finds its sequence and offset."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], capacity: int):
        length, sequence, offset, count, base = [], [], [], [], 0
        for lengths, repeat in made:
            at = 0
            for v in lengths:
                length.append(v)
                sequence.append(base)
                offset.append(at)
                count.append(repeat)
                at += v
            base += repeat
        self.sequences = base
        order = np.argsort(np.array(length, dtype=np.int64), kind="stable")
        self.sequence = np.array(sequence, dtype=np.int64)[order]
        self.offset = np.array(offset, dtype=np.int64)[order]
        count = np.array(count, dtype=np.int64)[order]
        self.start = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
        per_length = np.bincount(np.array(length, dtype=np.int64)[order], weights=count, minlength=capacity + 1)
        self.first = np.concatenate([[0], np.cumsum(per_length.astype(np.int64))])

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + rank
        slot = np.searchsorted(self.start, at, "right") - 1
        return self.sequence[slot] + at - self.start[slot], self.offset[slot]


def pack(pieces: DataFrame, capacity: int, order: list[str], length_col: str = "length") -> DataFrame:
    """Place pieces of 1 to ``capacity`` tokens into sequences: adds sequence_id, offset.

    ``pieces`` is a stored table; ``order`` names columns that tell its rows apart.
    The length histogram (capacity + 1 counts) gives the plan on the driver: exact
    patterns fitted by non-negative least squares, counts rounded, the rest packed
    best-fit. The plan's size depends on ``capacity`` alone. Rows are numbered within
    their length, a hot length over many tasks, and read their place off the plan.
    An empty table gives no rows.
    """
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect():
        hist[r[length_col]] = r["n"]
    slots = _Slots(plan(hist, capacity), capacity)
    ranked = number_rows(pieces, [length_col], order, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                sequence, offset = slots.place(t[length_col].to_numpy().astype(np.int64), t["_rank"].to_numpy())
                t = t.drop_columns(["_rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
                yield from t.to_batches()

    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pieces_of(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None,
              id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents: doc_id, doc (row), piece, start, length, ids_crc32.

    A document is its text's ids and ``end_id``; longer ones than ``capacity`` are cut
    into full pieces behind a shorter first one. Null text is empty (one piece: the end
    id); null ids stay null; repeated rows are documents of their own (``doc`` differs).
    ``with_ids`` adds the ids (binary, little-endian unsigned 32-bit).
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc"),
                       whole_text(text_col).alias("text"))

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batch_iter:
            texts = b.column("text")
            for lo, hi in row_runs(texts):
                ids, bounds = append_id(*own.encode(texts.slice(lo, hi - lo)), end_id)
                sizes = np.diff(bounds)
                first = (sizes - 1) % capacity + 1
                number = (sizes - first) // capacity + 1
                row = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                begin = bounds[row] + start
                raw = ids.astype("<u4").tobytes()
                parts = [memoryview(raw)[4 * s:4 * (s + k)] for s, k in zip(begin.tolist(), length.tolist())]
                out = {"doc_id": b.column("doc_id").slice(lo, hi - lo).take(pa.array(row)),
                       "doc": b.column("doc").slice(lo, hi - lo).take(pa.array(row)),
                       "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                       "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, doc long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; see
    ``pieces_of`` for what becomes of nulls and repeated rows.
    """
    pieces = stored(pieces_of(docs, capacity, end_id, vocabulary, id_col, text_col), "pieces")
    return pack(pieces, capacity, ["doc", "piece"]).drop("doc")
