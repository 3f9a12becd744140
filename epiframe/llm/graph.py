"""Connected components of links by alternating star steps on tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, number_rows, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link: root is the component's smallest node.

    ``links`` has columns a and b (not null). Each round hangs larger neighbours, then
    smaller ones, onto the smallest (two grouped minima, no list of neighbours), until
    every node hangs on its root; the number of rounds grows with the logarithm of the
    longest path. Rounds are stored tables.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (both.filter("v > u").join(least, F.col("u") == F.col("x"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:  # a round that changes nothing: only stars are left
            break
        mark = now
    else:
        raise RuntimeError(f"components not closed after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def forest(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for links in which every b has one a, smaller than b: pointer jumping."""
    tree = stored(links.select(F.col("b").alias("node"), F.col("a").alias("root")), "forest")
    for _ in range(max_rounds):
        up = tree.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = tree.join(up, F.col("root") == F.col("_n"), "left")
        before, tree = tree, stored(step.select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "forest")
        discard(before)
        if tree.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"forest not closed after {max_rounds} rounds")
    roots = tree.select(F.col("root").alias("node"), "root").distinct()
    return tree.select("node", "root").unionByName(roots)


def bucket_pairs(shared: DataFrame, small: int) -> DataFrame:
    """Candidate pairs (a < b) of bucket members: all with the centre, in small buckets every two.

    ``shared`` has band, node, m (members of the bucket) and c (its centre).
    """
    star = shared.filter("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b"))
    few = (shared.filter(F.col("m").between(3, small)).groupBy("band").agg(F.sort_array(F.collect_set("node")).alias("all"))
           .select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b")))
    return star.unionByName(few).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    a = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rows = pairs.join(a, "a", "left").join(b, "b", "left")
    return rows.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def several_roots(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, node, root, left) of the buckets whose members lie in more than one component.

    ``left`` marks members outside the bucket's largest component.
    """
    wide = members.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    sizes = wide.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = (sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
            .filter("roots > 1").select(F.col("band").alias("_band"), F.col("main.root").alias("_main")))
    return wide.join(main, F.col("band") == F.col("_band")).select("band", "node", "root", (F.col("root") != F.col("_main")).alias("left"))


def link_across(buckets: DataFrame, payload: DataFrame, prepare: Callable, block: int) -> DataFrame:
    """Links between different components inside large buckets, compared block by block.

    ``buckets``: band, node, root, left; ``payload``: node and what the test needs. The
    members outside a bucket's largest component are compared with all its members:
    both are dealt into blocks of about ``block``, a task compares one block with another
    and returns at most the links that join components it still sees apart, so what
    comes out is no more than what went in. ``prepare(batch)`` gives two functions:
    likely(i), an array of the rows worth a test with row i, and same(i, j), the test.
    """
    def dealt(rows: DataFrame, name: str) -> DataFrame:
        rows = number_rows(rows, ["band"], ["node"], "_nth").withColumn(name, (F.col("_nth") / block).cast("int"))
        return stored(rows.select("band", "node", "root", name), "dealt")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("band").agg(F.sequence(F.lit(0), F.max(name)).alias("_blocks"))

    every, left = dealt(buckets, "j"), dealt(stored(buckets.filter("left"), "left"), "i")
    a = every.join(blocks(left, "i"), "band").select("band", F.explode("_blocks").alias("i"), "j", "node", "root", F.lit(False).alias("left"))
    b = left.join(blocks(every, "j"), "band").select("band", "i", F.explode("_blocks").alias("j"), "node", "root", F.lit(True).alias("left"))
    # a number of partitions of its own: small groups cost time, not bytes, and are not to be merged
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = a.unionByName(b).join(payload, "node").repartition(parts, "band", "i", "j")

    def compare(batch):
        likely, same = prepare(batch)
        nodes, links = batch["node"].to_numpy(), []
        root = np.unique(batch["root"].to_numpy(), return_inverse=True)[1]
        for i in np.flatnonzero(batch["left"].to_numpy()).tolist():
            other = likely(i)
            for j in other[root[other] != root[i]].tolist():
                if root[j] != root[i] and same(i, j):
                    links.append((nodes[i], nodes[j]))
                    root[root == root[j]] = root[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return full.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def closure(near: DataFrame, best: DataFrame, large: DataFrame, payload: DataFrame, confirm: Callable,
            prepare: Callable, block: int) -> DataFrame:
    """Components (node, root) of all links among candidates, confirming as few as needed.

    ``near`` has candidate pairs a < b, ``best`` one of them for every b. The best pairs
    are confirmed first and make a forest; then the other pairs that lie across its
    trees, and the members of the ``large`` buckets (band, node) that hold several trees,
    block by block. ``confirm(pairs)`` keeps the true links.
    """
    found = stored(forest(confirm(best)), "trees")
    more = confirm(apart(near.join(best, ["a", "b"], "left_anti").select("a", "b"), found))
    open_buckets = stored(several_roots(large, found), "open")
    if not open_buckets.isEmpty():
        more = more.unionByName(link_across(open_buckets, payload, prepare, block))
    more = stored(more, "links")
    if more.isEmpty():
        return found
    a = found.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = stored(components(between), "merged")
    top = merged.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = found.join(top, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return stored(moved.unionByName(merged.join(found, "node", "left_anti")), "components")
