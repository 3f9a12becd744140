"""Operator 10: near duplicates by banded MinHash, odd sketches, and full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, keep, mix64, row_runs, shingles, SPACED, stored, temporary_tables, whole_text, Words
from .graph import bucket_pairs, closure

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Words of 64 bits in an odd sketch.
SKETCH = 8
#: Similarity below the wanted one at which candidates still pass their sketches: at 0.8 and
#: 128 samples the estimate's deviation is 0.035, so a true link passes by more than 5 of these.
MARGIN = 0.2
_FACTORS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples (SAMPLES x rows) of non-empty sets given one after another."""
    mixed, own = mix64(values + np.uint64(1)), np.empty(len(values), dtype=np.uint64)
    out = np.empty((SAMPLES, len(bounds) - 1), dtype=np.uint64)
    for i in range(SAMPLES):
        np.multiply(mixed, _FACTORS[i], out=own)
        np.minimum.reduceat(own, bounds[:-1], out=out[i])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Fold the samples of each row into a parity bitmap (rows x SKETCH words).

    Every (number, value) of a sample toggles one bit, so the XOR of two sketches is
    the sketch of the samples in which they differ.
    """
    bits = 64 * SKETCH
    place = mix64(samples + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(bits)
    rows = samples.shape[1]
    flat = (np.arange(rows, dtype=np.int64)[None, :] * bits + place.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(rows, SKETCH)


def most_bits(similarity: float) -> int:
    """Expected XOR population count of two sketches of this similarity.

    2 * SAMPLES * (1 - s) members differ; n bits toggled so often hold
    n / 2 * (1 - exp(-2 * differing / n)) ones.
    """
    bits = 64 * SKETCH
    return int(bits / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / bits)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band (rows x BANDS)."""
    out = np.empty((samples.shape[1], BANDS), dtype=np.uint64)
    for band in range(BANDS):
        acc = np.full(samples.shape[1], band + 1, dtype=np.uint64)
        for row in samples[band * ROWS:(band + 1) * ROWS]:
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + row)
        out[:, band] = acc
    return out


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each non-empty set: two sums over differently mixed members."""
    return (np.add.reduceat(mix64(values + np.uint64(11)), bounds[:-1]),
            np.add.reduceat(mix64(values * np.uint64(0xD1342543DE82EF95) + np.uint64(13)), bounds[:-1]))


_SIGNED = ", ".join(f"s{i} long" for i in range(SKETCH))


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, row, digest (xxhash64 of the text), n (set size), k1, k2 (digest), sketch s0.., bands (null for empty sets)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       whole_text(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))

    def sign(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            texts = b.column("text")
            for lo, hi in row_runs(texts):
                values, bounds = shingles(Words(texts.slice(lo, hi - lo), SPACED), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                place = np.cumsum(n > 0) - 1
                take = pa.array(np.where(n > 0, place, 0), mask=n == 0)
                columns = {"doc_id": b.column("doc_id").slice(lo, hi - lo), "row": b.column("row").slice(lo, hi - lo),
                           "digest": b.column("digest").slice(lo, hi - lo), "n": pa.array(n)}
                if len(full):
                    edges = np.append(bounds[full], len(values))
                    samples = min_hashes(values, edges)
                    k1, k2 = set_keys(values, edges)
                    sketch, keys = odd_sketches(samples), band_keys(samples)
                else:
                    k1 = k2 = np.zeros(1, np.uint64)
                    sketch, keys = np.zeros((1, SKETCH), np.uint64), np.zeros((1, BANDS), np.uint64)
                columns |= {"k1": pa.array(k1.view(np.int64)).take(take), "k2": pa.array(k2.view(np.int64)).take(take)}
                columns |= {f"s{i}": pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)).take(take) for i in range(SKETCH)}
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_pydict(columns | {"bands": lists.take(take)})

    return rows.mapInArrow(sign, f"doc_id long, row long, digest long, n long, k1 long, k2 long, {_SIGNED}, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Full sets (binary, sorted 64-bit hashes) of the classes in ``wanted``: node, n, members.

    ``wanted`` has node, doc_id and digest (of one document of the class), k1, k2.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("text")).withColumn("_digest", F.xxhash64("text"))
    rows = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("node", "k1", "k2", "text")

    def collect(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            texts = b.column("text")
            for lo, hi in row_runs(texts):
                values, bounds = shingles(Words(texts.slice(lo, hi - lo), SPACED), size)
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                k1, k2 = set_keys(values, np.append(bounds[full], len(values)))
                # repeated ids: only the row with the class's own set
                own = (b.column("k1").slice(lo, hi - lo).to_numpy()[full] == k1.view(np.int64)) & (b.column("k2").slice(lo, hi - lo).to_numpy()[full] == k2.view(np.int64))
                full = full[own]
                raw = values.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "node": b.column("node").slice(lo, hi - lo).take(pa.array(full)),
                    "members": pa.array([raw[8 * a:8 * e] for a, e in zip(bounds[full].tolist(), bounds[full + 1].tolist())], pa.binary())})

    return rows.mapInArrow(collect, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


def alike(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """Exact test on two sorted sets: intersection / union >= share."""
    if share[1] * min(len(x), len(y)) < share[0] * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return share[1] * common >= share[0] * (len(both) - common)


def confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a")

    def check(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_iter:
            keep = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share)
                    for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def common_counts(left: list[np.ndarray], every: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections (left x every), exact: products of 0/1 matrices over shared members."""
    flat = np.concatenate(every)
    value, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(m) for m in every])
    shared = np.flatnonzero(count > 1)  # left rows are among every: what occurs once meets nothing else
    column = np.full(len(value), -1)
    column[shared] = np.arange(len(shared))
    place = column[place]
    row, place = row[place >= 0], place[place >= 0]
    own = np.concatenate(left) if left else flat[:0]
    own_row = np.repeat(np.arange(len(left)), [len(m) for m in left])
    where = np.minimum(np.searchsorted(value, own), len(value) - 1)
    own_place = np.where(value[where] == own, column[where], -1)
    own_row, own_place = own_row[own_place >= 0], own_place[own_place >= 0]
    out = np.zeros((len(left), len(every)), dtype=np.int64)
    order, own_order = np.argsort(place, kind="stable"), np.argsort(own_place, kind="stable")
    place, row, own_place, own_row = place[order], row[order], own_place[own_order], own_row[own_order]
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        c, d = np.searchsorted(own_place, [lo, lo + width])
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(every), width), np.float32)
        x[own_row[c:d], own_place[c:d] - lo] = 1
        y[row[a:b], place[a:b] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _compare_sets(share: tuple[int, int]):
    """Exact test of the left rows of a block with all its rows, on their full sets."""
    def prepare(batch):
        members = [np.frombuffer(m, np.uint64) for m in batch["members"]]
        size = np.array([len(m) for m in members])
        left = np.flatnonzero(batch["left"].to_numpy())
        nth = {int(i): n for n, i in enumerate(left)}
        common = common_counts([members[i] for i in left], members)
        alike = share[1] * common >= share[0] * (size[left][:, None] + size[None, :] - common)
        return (lambda i: np.flatnonzero(alike[nth[i]])), (lambda i, j: True)

    return prepare


def near_components(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id",
                    text_col: str = "text", small_bucket: int = 12, block: int = 256) -> DataFrame:
    """Components of documents linked by Jaccard similarity of word shingles >= share.

    Words are runs of non-blank characters, A-Z lower-cased; a set holds the distinct
    ``size``-word shingles, the whole sequence if there are fewer words. Documents of
    equal sets are one class from the start. Classes that share a band of MinHash
    samples are candidates: in a bucket every class with the bucket's centre, in small
    ones every two. Odd sketches drop the unlike ones; links are confirmed on full sets,
    the best candidate of each class first, then all that lie across components. Last,
    large buckets that still hold several components are compared block by block.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the component, null if
    it has none), kept (doc_id equals component_id). Empty texts have no set and are
    components of their own; null ids are rows like others; rows that repeat an id are
    judged one by one.
    """
    out = _judged(docs, size, share, id_col, text_col, small_bucket, block)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _judged(docs: DataFrame, size: int, share: tuple[int, int], id_col: str, text_col: str, small_bucket: int, block: int) -> DataFrame:
    """Per row: doc_id, digest, n_shingles, component_id and root (one number a component; null for empty sets)."""
    signed = stored(signatures(docs, size, id_col, text_col), "signed")
    first = [F.first(c).alias(c) for c in [*(f"s{i}" for i in range(SKETCH)), "bands"]]
    one = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))), F.min(F.struct("doc_id", "digest"))).alias("one")
    classes = signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("node"), one, *first)
    classes = stored(classes.select("k1", "k2", "n", "node", "one.doc_id", "one.digest", *(f"s{i}" for i in range(SKETCH)), "bands"), "classes")
    rows = classes.select(F.explode("bands").alias("band"), "node")
    centre = F.min(F.struct(F.xxhash64("band", "node").alias("h"), F.col("node").alias("c"))).alias("centre")
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m"), centre).filter("m > 1").select(F.col("band").alias("_band"), "m", F.col("centre.c").alias("c"))
    shared = stored(rows.join(buckets, F.col("band") == F.col("_band")).select("band", "node", "m", "c"), "buckets")
    pairs = bucket_pairs(shared, small_bucket)
    sketches = classes.select("node", *[f"s{i}" for i in range(SKETCH)])
    most = most_bits(share[0] / share[1] - MARGIN)
    x = sketches.select(F.col("node").alias("a"), *[F.col(f"s{i}").alias(f"x{i}") for i in range(SKETCH)])
    y = sketches.select(F.col("node").alias("b"), *[F.col(f"s{i}").alias(f"y{i}") for i in range(SKETCH)])
    bits = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(SKETCH)), F.lit(0))
    near = stored(pairs.join(x, "a").join(y, "b").select("a", "b", bits.alias("bits")).filter(F.col("bits") <= most), "candidates")

    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
    large = shared.filter(F.col("m") > small_bucket)
    wanted = nodes.unionByName(large.select("node")).distinct()
    sets = stored(sets_of(docs, classes.select("node", "doc_id", "digest", "k1", "k2").join(wanted, "node", "left_semi"), size, id_col, text_col), "sets")

    best = near.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    found = closure(near.select("a", "b"), best, large, sets, lambda p: confirm(p, sets, share),
                    _compare_sets(share), block)

    roots = classes.select("node", "doc_id", "k1", "k2").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = roots.join(least, "root").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "component_id", "root")
    out = signed.select("doc_id", "digest", F.col("n").alias("n_shingles"), "k1", "k2")
    return out.join(of_class, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left").drop("_1", "_2", "k1", "k2")


def drop_near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id",
                         text_col: str = "text", small_bucket: int = 12, block: int = 256) -> DataFrame:
    """Documents with all their columns, one row of each component.

    Rows are told by (id, text): of a component the one of the smallest id stays (null
    after all others; of one id the smallest hash of the text), so that an id that
    repeats with another text loses only the text that is a copy. Of rows repeated with
    id and text one stays. Rows without words are no copies of each other: all stay.
    Names of columns never clash.
    """
    id_, digest, row = fresh_names(docs, "_id", "_digest", "_row")
    with temporary_tables(docs.sparkSession):
        judged = stored(_judged(docs, size, share, id_col, text_col, small_bucket, block).filter("n_shingles > 0"), "judged")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
        first = judged.groupBy("root").agg(F.min(order).alias("f")).select(F.col("root").alias("_root"), "f")
        rows = judged.join(first, F.col("root") == F.col("_root")).groupBy("doc_id", "digest").agg(
            F.first(order.eqNullSafe(F.col("f"))).alias("stays"), F.count(F.lit(1)).alias("n"))
        gone = keep(stored(rows.filter("not stays").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)), "near-gone"))
        many = keep(stored(rows.filter("stays and n > 1").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)), "near-repeated"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text(F.col(f"`{text_col}`"))) == F.col(digest))
    kept = docs.join(gone, same, "left_anti")
    if many.isEmpty():
        return kept
    repeated = kept.join(many, same).groupBy(id_, digest).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return kept.join(many, same, "left_anti").unionByName(repeated.select(f"{row}.*"))
