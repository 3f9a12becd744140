"""Operator 7: line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, discard, fresh_names, keep, mix64, row_runs, sieve, sift, stored, temporary_tables, whole_text
from .graph import bucket_pairs, closure

_U = np.uint64
#: Hash values of the code points below U+4000; others are computed.
_POINTS = mix64(np.arange(1, (1 << 14) + 1, dtype=np.uint64))
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
#: Options of the queries: equal lines of every length; an edit for every ten characters, two at most.
EVERY_LINE = {"least": 1, "steps": ((20, 2), (10, 1))}


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes (edits + 1 columns) of the even partition; longer segments stand last."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    size = base[:, None] + (np.arange(parts)[None, :] >= parts - longer[:, None])
    return np.cumsum(size, axis=1) - size, size


def segment_keys(span_hash, start: np.ndarray, length: np.ndarray, edits: int) -> np.ndarray:
    """Join keys of lines: the own segments first, then the substrings to probe with.

    If two lines differ by at most ``edits`` edits, the longer one (or either, at equal
    length) has a substring that is one of the other's segments, shifted no more than
    the edits to its left and right allow (with d = difference of lengths, segment i
    from 0: by -i..i and by d - (edits - i)..d + (edits - i)). A key tells the
    segment's text, its number and the length of the line it belongs to.
    """
    own, probes = [], []
    for d in range(edits + 1):
        other = length - d
        at, size = segments(other, edits)
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                begin = start + at[:, i] + shift
                tag = mix64(other.astype(np.uint64) * _U(64) + _U(i + 1))
                key = mix64(span_hash(begin, begin + size[:, i]) ^ tag)
                (own if d == 0 and shift == 0 else probes).append(key)
    return np.stack(own + probes, axis=1)


def allowed(length: int, steps: tuple) -> int:
    """Edits between a line of ``length`` and one as long or longer."""
    return next((edits for least, edits in steps if length >= least), 0)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``; bit-parallel inside the diagonal band.

    Register j holds, for the places of ``a`` at most ``edits`` off the diagonal, whether
    the text read so far matches up to there with at most j edits; a step of ``b``
    moves the band by one.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # longest common prefix by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid:] == b[len(b) - mid:] else (low, mid - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    band = (1 << (2 * edits + 1)) - 1
    rows = [sum(1 << (edits + i) for i in range(j + 1)) for j in range(edits + 1)]
    for t, c in enumerate(b, 1):
        mask, shift = masks.get(c, 0), t - edits - 1
        match = (mask >> shift if shift >= 0 else mask << -shift) & band
        old, new = rows[0], rows[0] & match
        rows[0] = new
        for j in range(1, edits + 1):
            own = rows[j]
            new = ((own & match) | old | (old >> 1) | (new << 1)) & band
            rows[j], old = new, own
        if not new:
            return False
    return bool(rows[edits] >> (len(a) - len(b) + edits) & 1)


class _Lines:
    """Lines of a run of texts in code points: place, length and number, with span hashes."""

    def __init__(self, texts: list[str], least: int):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(points)
        powers, self._inverses = _powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        values = _POINTS[np.minimum(points, len(_POINTS) - 1)]
        high = np.flatnonzero(points >= len(_POINTS) - 1)
        values[high] = mix64(points[high].astype(np.uint64) + _U(1))
        np.cumsum(values * powers[:n], out=self._sums[1:])
        breaks = np.flatnonzero(points == 10)
        start = np.concatenate([bounds[:-1], breaks + 1])
        row = np.concatenate([np.arange(len(texts)), np.searchsorted(bounds, breaks, "right") - 1])
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        last = np.append(row[1:] != row[:-1], True)
        end = np.where(last, bounds[row + 1], np.append(start[1:], 0) - 1)
        number = np.arange(len(row)) - np.searchsorted(row, row)
        inked = np.concatenate([[0], np.cumsum(~np.isin(points, _SPACES))])
        keep = (end - start >= least) & (inked[end] > inked[start])
        self.start, self.length, self.row, self.number = start[keep], (end - start)[keep], row[keep], number[keep]

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._inverses[start] + (end - start).astype(np.uint64))


def lines_of(docs: DataFrame, steps: tuple, least: int, id_col: str, text_col: str) -> DataFrame:
    """Lines of at least ``least`` characters, none blank: doc_id, digest, line, h1, h2, keys0, keys1, ...

    There are keys for each of the ``steps``: of the lines it holds for, and of those longer
    by no more than its edits. They are null for other lines, and for repeats within a batch.
    """
    tops = [None] + [longer + edits for (longer, _), (_, edits) in zip(steps, steps[1:])]  # lengths below these
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), "text")

    def lists(own: _Lines, near: np.ndarray, n: int, edits: int) -> pa.Array:
        if not near.any():
            return pa.nulls(len(near), pa.list_(pa.int64()))
        keys = segment_keys(own.span_hash, own.start[near], own.length[near], edits)
        keys = mix64(keys + _U(n)) if n else keys
        found = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int64)))
        return found.take(pa.array(np.where(near, np.cumsum(near) - 1, 0), mask=~near))

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            texts = b.column("text")
            for lo, hi in row_runs(texts, 600_000):
                own = _Lines(texts.slice(lo, hi - lo).to_pylist(), least)
                if not len(own.start):
                    continue
                h1 = own.span_hash(own.start, own.start + own.length)
                h2 = mix64(own.span_hash(own.start, own.start + own.length // 2) + h1 * _U(3))
                first = np.zeros(len(h1), dtype=bool)
                first[np.unique(h1, return_index=True)[1]] = True
                near = [first & (own.length >= shortest) & (own.length < (top or own.length + 1)) for (shortest, _), top in zip(steps, tops)]
                where = pa.array(own.row + lo)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").take(where), "digest": b.column("digest").take(where),
                    "line": pa.array(own.number.astype(np.int32)), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)),
                    **{f"keys{n}": lists(own, near[n], n, edits) for n, (_, edits) in enumerate(steps)}})

    return rows.mapInArrow(cut, "doc_id long, digest long, line int, h1 long, h2 long" + "".join(f", keys{n} array<long>" for n in range(len(steps))))


def _may_hold(bits: np.ndarray):
    """Column function: whether a 64-bit digest may be in the sieve."""
    @F.pandas_udf("boolean")
    def test(digest):
        return pd.Series(sift(bits, digest.to_numpy()))

    return test


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Line texts: node, text. ``wanted`` has node, doc_id, digest, line; only texts that may hold one move."""
    per_doc = stored(wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("line", "node")).alias("places")), "line-places")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text")).withColumn("_digest", F.xxhash64("_text"))
    rows = rows.filter(_may_hold(sieve(per_doc, "digest"))("_digest"))
    found = per_doc.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    found = found.select(F.split("_text", "\n").alias("lines"), F.explode("places").alias("p"))
    return (found.select(F.col("p.node").alias("node"), F.get("lines", F.col("p.line")).alias("text"))
            .groupBy("node").agg(F.first("text").alias("text")))  # a row that repeats gives its lines twice


def confirm(pairs: DataFrame, texts: DataFrame, steps: tuple) -> DataFrame:
    """Those of the pairs (a, b) whose texts are within the edits of the shorter one."""
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def check(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            keep = [within(p, q, allowed(min(len(p), len(q)), steps)) for p, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _compare_lines(steps: tuple):
    """Test of two rows of a block: lengths and letter counts first, then the distance."""
    edits = max(e for _, e in steps)

    def prepare(batch):
        texts = batch["text"].tolist()
        length = np.array([len(t) for t in texts])
        bags = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) & 31, minlength=32) for t in texts]).astype(np.int32)

        def likely(i):  # an edit changes the counts of two letters at most
            near = np.flatnonzero(np.abs(length - length[i]) <= edits)
            return near[np.abs(bags[near] - bags[i]).sum(axis=1) <= 2 * edits]

        return likely, lambda i, j: within(texts[i], texts[j], allowed(min(length[i], length[j]), steps))

    return prepare


def repeated_lines(docs: DataFrame, edits: int = 2, least: int = 10, least_near: int = 40, id_col: str = "doc_id",
                   text_col: str = "text", small_bucket: int = 12, block: int = 512, steps: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """Lines that go: doc_id, digest (xxhash64 of the text), line (from 0), class_id.

    Lines of ``least`` characters or more that are equal, and those of ``least_near`` or
    more that at most ``edits`` edits link (also over others), are one class; its first
    line in order of (doc_id, digest, line) stays. class_id is the doc_id of that line.
    ``steps``, (least length, edits) from the longest on, go instead of the one step
    (``least_near``, ``edits``); of two lines the shorter one's step holds.
    """
    steps = steps or ((least_near, edits),)
    lines = stored(lines_of(docs, steps, least, id_col, text_col), "lines")
    classes = stored(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "digest", "line")).alias("first"),
                                                   F.count(F.lit(1)).alias("copies")), "line-classes")
    keyed = [(lines.filter(f"keys{n} is not null").select(F.col("h1").alias("node"), F.col(f"keys{n}").alias("keys")), e) for n, (_, e) in enumerate(steps)]
    rows = [k.select("node", F.posexplode("keys").alias("i", "band")).select("node", "band", (F.col("i") > e).alias("probe")) for k, e in keyed]
    bands = (reduce(DataFrame.unionByName, rows).groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("probe").alias("probe"))
             .filter((F.col("lo") != F.col("hi")) & ~F.col("probe")).select(F.col("band").alias("_band")))
    bands = stored(bands, "line-bands")
    bits = sieve(bands, "_band")  # most keys are met once: these need not move again

    def met(edits: int):
        def sifted(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batch_iter:
                keys = b.column("keys").flatten().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(sift(bits, keys))
                number = max(1, len(keys) // max(1, b.num_rows))  # as many for every line
                yield pa.RecordBatch.from_pydict({"band": pa.array(keys[keep]), "node": b.column("node").take(pa.array(keep // number)),
                                                  "probe": pa.array(keep % number > edits)})

        return sifted

    members = reduce(DataFrame.unionByName, [k.mapInArrow(met(e), "band long, node long, probe boolean") for k, e in keyed])
    members = members.groupBy("band", "node").agg(F.min("probe").alias("probe"))
    members = stored(members.join(bands, F.col("band") == F.col("_band"), "left_semi"), "line-members")
    slim = stored(lines.select("doc_id", "digest", "line", "h1", "h2"), "line-places-of")  # the keys are no longer needed
    discard(lines, bands)
    lines = slim
    centre = F.min(F.struct("probe", F.xxhash64("band", "node").alias("h"), F.col("node").alias("c"))).alias("centre")
    buckets = (members.groupBy("band").agg(F.count(F.lit(1)).alias("m"), centre).filter("m > 1")
               .select(F.col("band").alias("_band"), "m", F.col("centre.c").alias("c")))
    shared = stored(members.join(buckets, F.col("band") == F.col("_band")).select("band", "node", "m", "c"), "line-shared")
    discard(members)
    pairs = stored(bucket_pairs(shared, small_bucket), "line-pairs")
    large = shared.filter(F.col("m") > small_bucket).select("band", "node")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    places = classes.select(F.col("h1").alias("node"), "first").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("first").alias("first"))
    texts = stored(texts_of(docs, places.select("node", "first.*"), id_col, text_col), "line-texts")
    best = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = closure(pairs, best, large, texts, lambda p: confirm(p, texts, steps), _compare_lines(steps), block)
    # a line without links is told by both its hashes
    whole = classes.join(found, F.col("h1") == F.col("node"), "left").withColumn("other", F.when(F.col("root").isNull(), F.col("h2")).otherwise(F.lit(0)))
    whole = whole.withColumn("root", F.coalesce("root", "h1")).select("h1", "h2", "root", "other", "first", "copies")
    stays = whole.groupBy("root", "other").agg(F.min("first").alias("stays"), F.sum("copies").alias("n")).filter("n > 1")
    whole = whole.join(stays, ["root", "other"]).select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "stays")
    return (lines.select("doc_id", "digest", "line", "h1", "h2").join(whole, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
            .filter(~F.struct("doc_id", "digest", "line").eqNullSafe(F.col("stays")))
            .select("doc_id", "digest", "line", F.col("stays.doc_id").alias("class_id")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with their columns, repeated lines cut out of the text.

    Adds lines_in, lines_out and first_docs (ids of the documents that keep the lines);
    columns of ``docs`` with these names are replaced. Other names never clash. Lines are
    what stands between line feeds; blank lines, and those under ``least``, stay. Null text
    stays null. Rows of the same id and text are treated alike: all keep the same
    lines. A null id comes before all others.
    """
    lines_col, first_col, id_, digest, new = fresh_names(docs, "_lines", "_first", "_id", "_digest", "_new")
    with temporary_tables(docs.sparkSession):
        gone = (repeated_lines(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id", "digest")
                .agg(F.collect_set("line").alias(lines_col), F.sort_array(F.collect_set("class_id")).alias(first_col)))
        gone = keep(stored(gone.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), lines_col, first_col), "line-gone"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text(F.col(f"`{text_col}`"))) == F.col(digest))
    rows = docs.join(gone, same, "left")
    text, cut = F.col(f"`{text_col}`"), F.col(lines_col)

    def left(d):  # each text is split once; the lines that stay are looked up by their numbers
        numbers = F.array_except(F.sequence(F.lit(0), F.size(d["parts"]) - 1), d["gone"])
        return F.transform(numbers, lambda i: F.get(d["parts"], i))

    parts = F.split(text, "\n")
    stays = F.get(F.transform(F.array(F.struct(parts.alias("parts"), cut.alias("gone"))), left), 0)
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts))
    n_gone = F.when(cut.isNull(), F.lit(0)).otherwise(F.size(cut))
    rows = rows.withColumn(new, F.when(cut.isNull(), text).otherwise(F.array_join(stays, "\n")))
    own = [c for c in docs.columns if c not in ADDED]
    return rows.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in own],
                       n_lines.alias(ADDED[0]), (n_lines - n_gone).alias(ADDED[1]),
                       F.coalesce(F.col(first_col), F.array().cast("array<bigint>")).alias(ADDED[2]))


#: Columns that ``dedup_lines`` adds.
ADDED = ("lines_in", "lines_out", "first_docs")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents with repeated lines cut and their own columns only; those left without any line go.

    A column of ``docs`` named like one that ``dedup_lines`` adds keeps its values.
    """
    names = dict(zip(ADDED, fresh_names(docs, *[f"_own_{c}" for c in ADDED])))
    hidden = docs.withColumnsRenamed({c: names[c] for c in ADDED if c in docs.columns})
    out = dedup_lines(hidden, id_col, text_col, **options).filter((F.col("lines_out") > 0) | (F.col("lines_in") == 0)).drop(*ADDED)
    return out.withColumnsRenamed({n: c for c, n in names.items() if n in out.columns}).select(*[F.col(f"`{c}`") for c in docs.columns])
