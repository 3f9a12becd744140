"""Operator 4: token ids in files of canonical length-limited Huffman codes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import row_runs, running_total, stored, whole_text
from .tokens import append_id, default_vocabulary, encoder

_CRC_POLY = 0xEDB88320
_BLOCKS = "doc_id long, doc long, block int, n_ids long, ids_after long, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Huffman code lengths of at most ``max_bits`` bits (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids need codes of more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, row = [], leaves
    leaf = np.ones(len(leaves), dtype=bool)
    for _ in range(max_bits):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        row = np.concatenate([leaves, pairs])
        order = np.argsort(row, kind="stable")
        row, leaf = row[order], order < len(leaves)
    take = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[used[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id); a code is the previous one plus 1, shifted to its length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        width = int(lengths.max())
        steps = np.uint64(1) << (width - lengths[used].astype(np.uint64))
        starts = np.cumsum(steps, dtype=np.uint64) - steps
        codes[used] = starts >> (width - lengths[used].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For every window of the longest code's bits: id << 5 | length of the code it starts with."""
    width = int(lengths.max(initial=1))
    out = np.zeros(1 << width, dtype=np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        filled = np.repeat((used.astype(np.uint32) << 5) | lengths[used], 1 << (width - lengths[used].astype(np.int64)))
        out[: len(filled)] = filled
    return out, width


def encode_blocks(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray,
                  every: int) -> tuple[list[bytes], list[bytes]]:
    """Each block's bits (starting on a byte) and its checkpoints: bit offsets of every ``every``-th id."""
    bits = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(bits)])
    size = (total[bounds[1:]] - total[bounds[:-1]] + 7) // 8
    place = np.concatenate([[0], np.cumsum(size)])
    block = np.repeat(np.arange(len(size)), np.diff(bounds))
    at = total[:-1] - total[bounds[:-1]][block] + 8 * place[:-1][block]
    words = np.zeros(int(place[-1]) // 8 + 2, dtype=np.uint64)
    if len(ids):
        word, shift = at >> 6, 64 - (at & 63) - bits
        code = codes[ids]
        part = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[edge]] = np.bitwise_or.reduceat(part, edge)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    raw = words.astype(">u8").tobytes()
    payload = [raw[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
    marks = [(at[a:b:every] - 8 * p).astype("<u4").tobytes() for a, b, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), place[:-1].tolist())]
    return payload, marks


def decode_blocks(payloads: list[bytes], marks: list[bytes], counts: np.ndarray, table: np.ndarray, width: int,
                  every: int) -> np.ndarray:
    """Ids of all blocks: one lane per checkpoint, all lanes step through the table together."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    place = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(payloads) + bytes(8), dtype=np.uint8).astype(np.uint64)
    lanes = [np.frombuffer(m, dtype="<u4").astype(np.int64) for m in marks]
    per = np.array([len(x) for x in lanes], dtype=np.int64)
    at = np.concatenate(lanes) + np.repeat(8 * place, per) if lanes else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
    left = np.minimum(np.repeat(counts, per) - nth * every, every)
    begin = np.repeat(np.cumsum(counts) - counts, per) + nth * every
    out = np.zeros(int(counts.sum()), dtype=np.uint32)
    order = np.argsort(-left, kind="stable")
    at, left, begin = at[order], left[order], begin[order]
    window = (data[:-7] << np.uint64(32)) | (data[1:-6] << np.uint64(24)) | (data[2:-5] << np.uint64(16)) | (data[3:-4] << np.uint64(8)) | data[4:-3]
    active = len(at)
    for step in range(every):
        active = int(np.searchsorted(-left, -step, "left"))
        if not active:
            break
        pos = at[:active]
        peek = (window[pos >> 3] >> (np.uint64(40 - width) - (pos & 7).astype(np.uint64))) & np.uint64((1 << width) - 1)
        found = table[peek.astype(np.int64)]
        out[begin[:active] + step] = found >> 5
        pos += (found & 31).astype(np.int64)
    return out


def crc_shift(crc: int, n_bytes: int) -> int:
    """The CRC's share in that of a longer string: as if ``n_bytes`` zero bytes came after.

    crc(A + B) = crc_shift(crc(A), len(B)) ^ crc(B).
    """
    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = (b >> 1) ^ (_CRC_POLY if b & 1 else 0)
        return out

    power, factor, n = 0x80000000, 0x00800000, n_bytes  # 1 and x^8, highest power in the lowest bit
    while n:
        if n & 1:
            power = times(power, factor)
        factor = times(factor, factor)
        n >>= 1
    return times(power, crc)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, max_bits: int = 18,
                 block_ids: int = 65_536, checkpoint_ids: int = 128, docs_per_file: int = 32_000,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of whole texts, each with ``end_id`` behind it, below ``path``.

    ``path/blocks`` holds files in ascending doc_id order (nulls first); a row is an
    independent block of one document: doc_id, doc, block, n_ids, ids_after, payload,
    checkpoints. ``path/code`` holds one row: the code lengths of all ids, from the
    global counts. Null text is empty; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    source = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc"),
                       whole_text(text_col).alias("text"))

    def encode(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source)
        kind = np.uint16 if own.vocabulary <= 1 << 16 else np.uint32
        counts = np.zeros(max(own.vocabulary, end_id + 1), dtype=np.int64)
        for b in batch_iter:
            texts = b.column("text")
            for lo, hi in row_runs(texts):
                ids, bounds = append_id(*own.encode(texts.slice(lo, hi - lo)), end_id)
                counts += np.bincount(ids, minlength=len(counts))
                raw = ids.astype(kind).tobytes()
                edges = (bounds * np.dtype(kind).itemsize).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo), "doc": b.column("doc").slice(lo, hi - lo),
                    "wide": pa.array([kind is np.uint32] * (hi - lo)),
                    "ids": pa.array([raw[s:e] for s, e in zip(edges, edges[1:])], pa.binary()),
                    "counts": pa.nulls(hi - lo, pa.binary())})
        yield pa.RecordBatch.from_pydict({  # this task's counts, in a row of its own
            "doc_id": pa.nulls(1, pa.int64()), "doc": pa.nulls(1, pa.int64()), "wide": pa.nulls(1, pa.bool_()),
            "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    encoded = stored(rows.mapInArrow(encode, "doc_id long, doc long, wide boolean, ids binary, counts binary"), "ids")

    def add_up(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batch_iter:
            for x in b.column("counts").to_pylist():
                total = total + np.frombuffer(x, dtype=np.int64)
        if not isinstance(total, int):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used])})

    counted = (encoded.filter("counts is not null").select("counts").mapInArrow(add_up, "id long, n long")
               .groupBy("id").agg(F.sum("n").alias("n")).collect())  # a row per id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(lengths.tobytes(), checkpoint_ids)], "lengths binary, checkpoint_ids int").coalesce(1).write.parquet(f"{path}/code")

    documents = encoded.filter("ids is not null")
    files = max(1, -(-documents.count() // docs_per_file))

    def to_blocks(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for b in batch_iter:
            for i in _by_bytes(b.column("ids")):
                part = b.slice(i.start, i.stop - i.start)
                raw = part.column("ids").to_pylist()
                kinds = part.column("wide").to_pylist()
                own = [np.frombuffer(x, dtype="<u4" if w else "<u2") for x, w in zip(raw, kinds)]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                number = -(-sizes // block_ids)
                row = np.repeat(np.arange(len(own)), number)
                block = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                size = np.minimum(sizes[row] - block * block_ids, block_ids)
                ids = np.concatenate(own).astype(np.int64)
                payload, marks = encode_blocks(ids, np.concatenate([[0], np.cumsum(size)]), codes, lengths, checkpoint_ids)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(row)), "doc": part.column("doc").take(pa.array(row)),
                    "block": pa.array(block.astype(np.int32)), "n_ids": pa.array(size),
                    "ids_after": pa.array(sizes[row] - block * block_ids - size),
                    "payload": pa.array(payload, pa.binary()), "checkpoints": pa.array(marks, pa.binary())})

    # a file is a range of (doc_id, doc) and one task's
    order = [F.col("doc_id").asc_nulls_first(), F.col("doc")]
    dealt = documents.select("doc_id", "doc", "wide", "ids").repartitionByRange(files, *order)
    blocks = dealt.mapInArrow(to_blocks, _BLOCKS).withColumn("file", F.spark_partition_id())
    blocks.sortWithinPartitions("file", *order, "block").write.partitionBy("file").parquet(f"{path}/blocks")


def _by_bytes(column: pa.Array, limit: int = 4_000_000) -> Iterator[slice]:
    """Runs of rows of about ``limit`` bytes."""
    sizes = np.array([len(x) for x in column.to_pylist()], dtype=np.int64)
    total = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(total, prepend=-1, append=total[-1] + 1 if len(total) else 0))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield slice(a, b)


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """Decode the blocks below ``path``: doc_id, doc, block, n_ids, ids_after and the ids.

    ids: little-endian unsigned 32-bit, binary. With ``digest``, instead of the ids
    the block's share of the CRC-32 of its document's ids; the shares' XOR is the CRC.
    """
    code = spark.read.parquet(f"{path}/code").first()
    lengths, every = np.frombuffer(code["lengths"], dtype=np.uint8), code["checkpoint_ids"]

    def decode(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = decode_table(lengths)
        for b in batch_iter:
            for i in _by_bytes(b.column("payload")):
                part = b.slice(i.start, i.stop - i.start)
                counts = part.column("n_ids").to_numpy()
                ids = decode_blocks(part.column("payload").to_pylist(), part.column("checkpoints").to_pylist(), counts, table, width, every)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = (4 * np.cumsum(counts)).tolist()
                pieces = [raw[s:e] for s, e in zip([0, *ends], ends)]
                after = part.column("ids_after").to_pylist()
                last = pa.array([crc_shift(zlib.crc32(p), 4 * a) if a else zlib.crc32(p) for p, a in zip(pieces, after)], pa.int64()) if digest else pa.array([bytes(p) for p in pieces], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "doc", "block", "n_ids", "ids_after")), last],
                                                 ["doc_id", "doc", "block", "n_ids", "ids_after", "crc_share" if digest else "ids"])

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")  # of an empty table there are no files to infer it from
    return blocks.mapInArrow(decode, "doc_id long, doc long, block int, n_ids long, ids_after long, " + ("crc_share long" if digest else "ids binary"))


def token_digest(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the token files of ``docs``, read them back: doc_id, start, n_tokens, ids_crc32.

    ``start``: ids of all documents before it in ascending doc_id order (nulls first).
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    found = (read_tokens(spark, path, digest=True).groupBy("doc_id", "doc")
             .agg(F.sum("n_ids").alias("n_tokens"), F.bit_xor("crc_share").alias("ids_crc32")))
    found = stored(found, "token-digest")
    return running_total(found, ["doc_id", "doc"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
