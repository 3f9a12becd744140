"""Episode-shaped views over the driver tables (no new data is made).

``frames_ev``  events as episodes: episode = user, time order (ts, event_id).
``frames_li``  lineitem as episodes: episode = order, order over every column.
``vectors``    embeddings as 64-dim frames with a label as task index.
``views``      conversations as (episode, camera) = (conv_id, role).
``object_keys`` pages' URLs as an object-store listing.
``log_lines``  orders as training-log lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.plans.ordered import index_within

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, t, ts, event_id, task, state[2], actions[2])."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"), "event_id", "ts", F.col("event_type").alias("task"),
        F.col("value").cast("double").alias("s0"),
        F.get_json_object("props", "$.k").cast("double").alias("s1"),
    )
    ev = index_within(ev, ["episode_id"], ["ts", "event_id"], out="t")
    vec = F.array("s0", "s1")
    return ev.select("episode_id", "t", "ts", "event_id", "task",
                     vec.alias("state"), vec.alias("actions"))


LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def frames_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, t, task, state[4], actions[4]); duplicates ordered by every column."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), *LI_ORDER)
    li = index_within(li, ["episode_id"], LI_ORDER, out="t")
    vec = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return li.select("episode_id", "t", F.col("l_returnflag").alias("task"),
                     vec.alias("state"), vec.alias("actions"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, task_index, state[64] as double)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("task_index"),
        F.col("embedding").cast("array<double>").alias("state"))


def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing: (uri, bucket, key) from page URLs, plus camera files per episode.

    Every page gives an episode prefix ``<lang>/<n>`` on bucket = host; camera
    files are ``<prefix>/raw_video/<cam>.mp4`` for a page-dependent subset of
    cameras, and companion files ``video.mp4`` / ``eef_torso.pt``.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    prefix = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", "")
    cams = F.array(F.lit("cam_high"), F.lit("cam_left_wrist"), F.lit("cam_right_wrist"), F.lit("cam_low"))
    base = pages.select("page_id", host.alias("bucket"), prefix.alias("prefix"))
    files = base.select(
        "page_id", "bucket", "prefix",
        F.posexplode(F.array(
            *[F.concat(F.lit("raw_video/"), F.element_at(cams, i + 1), F.lit(".mp4")) for i in range(4)],
            F.lit("video.mp4"), F.lit("eef_torso.pt"))).alias("pos", "file"))
    # drop some files per page (never the first camera) so some prefixes are incomplete
    keep = ((F.col("page_id") * 7 + F.col("pos") * 3) % 5) != 0
    files = files.filter(keep | (F.col("pos") == 0))
    return files.select(
        "bucket", F.concat_ws("/", "prefix", "file").alias("key"),
        F.concat(F.lit("s3://"), "bucket", F.lit("/"), F.concat_ws("/", "prefix", "file")).alias("uri"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, text) training-log lines from orders: step = o_orderkey, loss from price."""
    return log_lines_of(table(spark, sf_dir, "orders"))


def log_lines_of(o: DataFrame) -> DataFrame:
    """``log_lines`` of any orders rows (batch or stream)."""
    whole = F.floor(F.col("o_totalprice")).cast("bigint")
    loss = F.concat((whole / F.lit(100000)).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((whole % F.lit(100000)).cast("string"), 5, "0"))
    text = F.concat(F.lit("["), F.col("o_orderstatus"), F.lit("] step="), F.col("o_orderkey").cast("string"),
                    F.lit(" loss="), loss, F.lit(" lr=0.0001 grad_norm=1.5 data_time=0.01s"))
    return o.select(F.col("o_orderkey").alias("line_id"), text.alias("text"))


def frames_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames_ev`` plus ``vel`` = [floor(value / 60)]: a coarse signal with idle runs."""
    f = frames_ev(spark, sf_dir)
    return f.withColumn("vel", F.array(F.floor(F.col("state")[0] / F.lit(60.0)).cast("double")))


def arm_frames(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """``frames_ev`` as a robot's frames: (episode_id, t, prompt, state[dims], actions[dims], views).

    Even dims are value / 1000 + 0.01 j, odd ones k / 1000 - 0.01 j; an action is 2 state
    - 0.1. Views are three small integers a frame; the left wrist view lacks on every
    third event; there is no right wrist view.
    """
    f = frames_ev(spark, sf_dir)
    s = F.col("state")
    state = F.array(*[(s[0] / F.lit(1000.0) + F.lit(0.01 * j)) if j % 2 == 0 else (s[1] / F.lit(1000.0) - F.lit(0.01 * j))
                      for j in range(dims)])
    view = F.array(F.pmod(F.floor(s[0]), F.lit(256)), F.pmod(F.floor(s[1]), F.lit(256)), F.pmod("t", F.lit(256))).cast("array<int>")
    return f.select("episode_id", "t", F.col("task").alias("prompt"), state.alias("state"),
                    view.alias("cam_high"), F.when(F.col("event_id") % 3 != 0, view).alias("cam_left_wrist")).withColumn(
        "actions", F.transform("state", lambda x: x * F.lit(2.0) - F.lit(0.1)))


def modalities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Five per-modality tables ``(episode_id, t, v)`` from ``frames_li``.

    eef_torso[9] = s0 + i, head[2] = (s2, s3), eef_left[9] = s1/1000 + i,
    gripper_cmd[2] = (10*s2, 10*s3), eef_right[9] = s0 - i. The head table
    lacks the last frame of episodes whose last line has return flag 'R',
    so lengths differ there.
    """
    li = frames_li(spark, sf_dir).select("episode_id", "t", "task", "state")
    s = F.col("state")
    seq9 = F.sequence(F.lit(0), F.lit(8))
    torso = li.select("episode_id", "t", F.transform(seq9, lambda i: s[0] + i).alias("v"))
    left = li.select("episode_id", "t", F.transform(seq9, lambda i: s[1] / F.lit(1000.0) + i).alias("v"))
    right = li.select("episode_id", "t", F.transform(seq9, lambda i: s[0] - i).alias("v"))
    grip = li.select("episode_id", "t", F.array(s[2] * F.lit(10.0), s[3] * F.lit(10.0)).alias("v"))
    last = li.groupBy("episode_id").agg(F.max("t").alias("_last"))
    head = (li.join(last, "episode_id")
            .filter(~((F.col("t") == F.col("_last")) & (F.col("task") == "R")))
            .select("episode_id", "t", F.array(s[2], s[3]).alias("v")))
    return {"eef_torso": torso, "head": head, "eef_left": left, "gripper_cmd": grip, "eef_right": right}


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-conversation instruction JSON ``{"sub_instructions":[{"instruction": …}, …]}``.

    Instructions are the user turns in order (quotes, backslashes and line
    breaks removed); conversations with a system turn get a truncated,
    unparsable document.
    """
    c = table(spark, sf_dir, "conversations")
    clean = F.regexp_replace(F.col("text"), r'["\\\r\n\t]', " ")
    item = F.concat(F.lit('{"instruction":"'), clean, F.lit('"}'))
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", item.alias("s"))))).alias("_u"),
        F.max((F.col("role") == "system").cast("int")).alias("_sys"))
    g = g.withColumn("_doc", F.concat(F.lit('{"sub_instructions":['),
                                      F.array_join(F.transform("_u", lambda x: x["s"]), ","), F.lit("]}")))
    doc = F.when(F.col("_sys") == 1, F.expr("substring(_doc, 1, length(_doc) - 2)")).otherwise(F.col("_doc"))
    return g.select(F.col("conv_id").alias("episode_id"), doc.alias("json"))
