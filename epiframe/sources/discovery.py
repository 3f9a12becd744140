"""Episode discovery over an object listing ``(bucket, key)``.

The listing is an ordinary table (from a manifest, an inventory export or
``binaryFile`` paths); everything here is a projection + aggregation over
it, so a billion-object listing is just a large scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.plans.ordered import index_within
from epiframe.session import join_small

# Camera names of a complete multi-view episode, in order; default task text.
CAMERA_VIEWS = ("cam_high", "cam_left_wrist", "cam_right_wrist")
DEFAULT_TASK = "Do something"


def uri_split(uri) -> tuple:
    """S6 ``scheme://bucket/key`` → (bucket, key)."""
    u = F.col(uri) if isinstance(uri, str) else uri
    return (F.regexp_extract(u, r"^[^:]+://([^/]*)/?(.*)$", 1),
            F.regexp_extract(u, r"^[^:]+://([^/]*)/?(.*)$", 2))


def camera_files(listing: DataFrame, cameras: Sequence[str] = CAMERA_VIEWS) -> DataFrame:
    """``(bucket, prefix, cam)`` for every key ending ``raw_video/<cam>.mp4`` (prefix keeps its '/')."""
    alt = "|".join(cameras)
    pat = rf"^(.*)raw_video/({alt})\.mp4$"
    return listing.filter(F.col("key").rlike(pat)).select(
        "bucket", F.regexp_extract("key", pat, 1).alias("prefix"), F.regexp_extract("key", pat, 2).alias("cam"))


def view_sets(listing: DataFrame, cameras: Sequence[str] = CAMERA_VIEWS) -> DataFrame:
    """``(bucket, prefix, views)`` distinct camera set per prefix."""
    return camera_files(listing, cameras).groupBy("bucket", "prefix").agg(F.array_sort(F.collect_set("cam")).alias("views"))


def _required(cameras: Sequence[str]):
    return F.array(*[F.lit(c) for c in sorted(cameras)])


def discover_multiview(listing: DataFrame, cameras: Sequence[str] = CAMERA_VIEWS,
                       max_episodes: int | None = None) -> DataFrame:
    """S3: prefixes whose camera set equals the required set (U4), sorted; first ``max_episodes``."""
    req = _required(cameras)
    vs = view_sets(listing, cameras)
    out = vs.filter((F.size(F.array_except(req, "views")) == 0) & (F.size(F.array_except("views", req)) == 0))
    out = out.select("bucket", "prefix")
    if max_episodes is not None:
        return out.orderBy("bucket", "prefix").limit(max_episodes)
    return out


def missing_views(listing: DataFrame, cameras: Sequence[str] = CAMERA_VIEWS) -> DataFrame:
    """S3 report / U3: ``(bucket, prefix, missing)`` for incomplete prefixes, names sorted."""
    req = _required(cameras)
    vs = view_sets(listing, cameras)
    return vs.select("bucket", "prefix", F.array_sort(F.array_except(req, "views")).alias("missing")).filter(
        F.size("missing") > 0)


def discover_single(listing: DataFrame) -> DataFrame:
    """Distinct prefix (with trailing '/') of every key ending ``/video.mp4``."""
    k = F.col("key")
    return listing.filter(k.endswith("/video.mp4")).select(
        "bucket", F.expr("substring(key, 1, length(key) - length('video.mp4'))").alias("prefix")).distinct()


def discover_companions(listing: DataFrame, root: str = "", files: Sequence[str] = ("video.mp4", "eef_torso.pt"),
                        ) -> DataFrame:
    """Directories holding every file in ``files`` (intersection of per-file semi-joins).

    Only direct children of ``root`` are candidates; when ``root`` itself
    qualifies it replaces the list; with no candidate at all, every depth is
    searched (recursive fallback).
    """
    pat = r"^(.*/)?([^/]+)$"
    d = listing.select("bucket", F.regexp_extract("key", pat, 1).alias("dir"),
                       F.regexp_extract("key", pat, 2).alias("file"))
    d = d.filter(F.col("dir").startswith(root))
    have = None
    for f in files:
        one = d.filter(F.col("file") == f).select("bucket", "dir").distinct()
        have = one if have is None else have.join(one, ["bucket", "dir"], "left_semi")
    rel = F.expr(f"substring(dir, {len(root) + 1})")
    kind = F.when(rel == "", 0).when(rel.rlike("^[^/]+/$"), 1).otherwise(2)
    have = have.withColumn("_kind", kind)
    # two scalar subqueries: does the root qualify, is there any direct child
    root_ok = have.select(F.max((F.col("_kind") == 0).cast("int"))).scalar()
    child_ok = have.select(F.max((F.col("_kind") == 1).cast("int"))).scalar()
    keep = F.when(root_ok == 1, F.col("_kind") == 0).when(child_ok == 1, F.col("_kind") == 1).otherwise(F.lit(True))
    return have.filter(keep).select("bucket", "dir")


def union_distinct_prefixes(*listings: DataFrame) -> DataFrame:
    """Union of discovered episodes over several prefixes, de-duplicated."""
    out = listings[0]
    for other in listings[1:]:
        out = out.unionByName(other)
    return out.distinct()


def instruction_from_json(js, default: str = DEFAULT_TASK):
    """``sub_instructions[0].instruction``, else the default task (also on bad JSON)."""
    c = F.col(js) if isinstance(js, str) else js
    return F.coalesce(F.get_json_object(c, "$.sub_instructions[0].instruction"), F.lit(default))


def id_from_name(name):
    """S12 ``metadata_*_<id>.json`` → text before the first '.', after the last '_'."""
    c = F.col(name) if isinstance(name, str) else name
    return F.element_at(F.split(F.split_part(c, F.lit("."), F.lit(1)), "_"), -1)


def episode_subset(listing: DataFrame, path: str, wanted: DataFrame | None, idx_col: str = "idx") -> DataFrame:
    """Number the listing by sorted path (0-based), keep rows whose number is wanted."""
    numbered = index_within(listing, [], [path], out=idx_col)
    if wanted is None:
        return numbered
    return join_small(numbered, wanted.select(idx_col).distinct(), [idx_col], "left_semi")
