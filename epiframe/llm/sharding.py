"""Operator 8: minimax contiguous partition of atomic groups into shards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, number_rows, stored, whole_text


class _Ladder:
    """Prefix sums over the ordered groups, kept coarse on the driver.

    Groups are ordered by key and cut into bins by the key's leading hex digits; the
    driver holds the bins' totals and fetches a bin's groups only where a cut falls.
    """

    def __init__(self, groups: DataFrame, digits: int):
        self.groups = groups
        rows = groups.groupBy("bin").agg(F.sum("size").alias("s"), F.max("size").alias("m")).orderBy("bin").collect()
        self.bins = [r["bin"] for r in rows]
        self.ends = np.cumsum(np.array([r["s"] for r in rows], dtype=np.int64))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if rows else self.ends
        self.total = int(self.ends[-1]) if rows else 0
        self.largest = max((r["m"] for r in rows), default=0)
        self._inside: dict[int, tuple[np.ndarray, list[str]]] = {}

    def inside(self, b: int) -> tuple[np.ndarray, list[str]]:
        """Start of each group of bin b, and the groups' keys."""
        if b not in self._inside:
            rows = self.groups.filter(F.col("bin") == self.bins[b]).select("key", "size").orderBy("key").collect()
            ends = self.starts[b] + np.cumsum(np.array([r["size"] for r in rows], dtype=np.int64))
            self._inside[b] = np.concatenate([[self.starts[b]], ends]), [r["key"] for r in rows]
        return self._inside[b]

    def floor(self, x: int) -> int:
        """Largest group boundary at or before x."""
        if x >= self.total:
            return self.total
        edges = self.inside(int(np.searchsorted(self.ends, x, "right")))[0]
        return int(edges[np.searchsorted(edges, x, "right") - 1])

    def ceil(self, x: int) -> int:
        """Smallest group boundary at or after x."""
        if x <= 0:
            return 0
        edges = self.inside(int(np.searchsorted(self.ends, x, "left")))[0]
        return int(edges[np.searchsorted(edges, x, "left")])

    def coarse(self, x: int) -> int:
        return self.total if x >= self.total else int(self.starts[np.searchsorted(self.ends, x, "right")])

    def key_at(self, edge: int) -> str:
        """Key of the group that starts at this boundary."""
        edges, keys = self.inside(int(np.searchsorted(self.ends, edge, "right")))
        return keys[int(np.searchsorted(edges, edge, "left"))]

    def fits(self, capacity: int, shards: int, step) -> bool:
        """Greedy check: fill each shard as far as ``step`` allows."""
        at = 0
        for _ in range(shards):
            if at + capacity >= self.total:
                return True
            at = step(at + capacity)
        return False


def minimax_cuts(ladder: _Ladder, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and ``shards - 1`` cut places that keep to it.

    A capacity that fits when cuts fall on whole bins fits for sure, and one that
    does not even fit when groups may be cut anywhere fails for sure; only between
    the two the groups of the bins concerned are looked at.
    """
    low, high = max(-(-ladder.total // shards), ladder.largest), ladder.total
    while low < high:
        mid = (low + high) // 2
        if ladder.fits(mid, shards, ladder.coarse):
            ok = True
        elif not ladder.fits(mid, shards, lambda x: x):
            ok = False
        else:
            ok = ladder.fits(mid, shards, ladder.floor)
        low, high = (low, mid) if ok else (mid + 1, high)
    latest = [ladder.total]  # from the end: the first place from which the rest still fits
    for _ in range(shards - 1):
        latest.append(ladder.ceil(latest[-1] - low))
    cuts, at = [], 0
    for s in range(shards - 1):
        first, last = latest[shards - 1 - s], ladder.floor(at + low)
        aim = at + round((ladder.total - at) / (shards - s))
        below, above = ladder.floor(aim), ladder.ceil(aim)
        near = below if aim - below <= above - aim else above
        at = min(max(near, first, at), last)
        cuts.append(at)
    return low, cuts


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    groups_per_bin: int = 65_536, carry: bool = False) -> DataFrame:
    """Put documents into ``shards`` of near equal bytes; equal texts stay together.

    Size is the text's UTF-8 bytes plus 1. Equal texts (null as empty) are one atomic
    group; groups stand in the order of their MD5 and each shard is a contiguous run
    of groups. The largest shard is as small as any such cut allows.

    Returns doc_id, size, text_crc32, group_key, shard, slot (0.. in its shard, no
    gaps) and capacity; with ``carry`` also the row itself, as the struct ``document``.
    Null ids and repeated rows are rows like others; an empty table gives no rows; a
    group above the mean size has a shard as large as itself. Other columns of
    ``docs`` are not read without ``carry``, and never clash.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group_key"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if carry else []))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("size"))
    n = rows.count()
    digits = max(2, math.ceil(math.log(max(1, n / groups_per_bin), 16)))
    groups = stored(groups.withColumn("bin", F.substring("key", 1, digits)), "shard-groups")
    ladder = _Ladder(groups, digits)
    capacity, cuts = minimax_cuts(ladder, shards) if n else (0, [])
    shard = F.lit(0)
    for c in cuts:
        if c < ladder.total:
            shard = shard + (F.col("group_key") >= F.lit(ladder.key_at(c))).cast("int")
    placed = stored(rows.withColumn("shard", shard), "shard-placed")
    return number_rows(placed, ["shard"], ["doc_id", "group_key"], "slot").withColumn("capacity", F.lit(capacity))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                 rows_per_file: int = 100_000) -> None:
    """Shard documents and write them whole below ``path/shard=<n>``, ordered by slot within each file.

    A row travels with its place and is never looked up by its id, so repeated rows and
    ids and null ids are written as often as ``docs`` has them. Files hold the columns of
    ``docs`` and slot; where ``docs`` has a column shard or slot itself, the new ones'
    names end in an underscore. An empty table writes a folder without rows.
    """
    shard, slot, part = fresh_names(docs, "shard", "slot", "_part")
    placed = shard_documents(docs, shards, id_col, text_col, carry=True)
    rows = placed.select("document.*", F.col("shard").alias(shard), F.col("slot").alias(slot),
                         F.floor(F.col("slot") / rows_per_file).alias(part))
    (rows.repartition(shard, part).sortWithinPartitions(shard, slot).drop(part)
     .write.partitionBy(shard).parquet(path))
