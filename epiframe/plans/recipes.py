"""Dataset recipes that run (F7, F8, P23): one invertible composition per robot and model family.

A recipe is folded into two pipelines:

* the **data side**: chunk the source's action column, repack, robot mapping over the
  rows of chunks, delta actions. The norm stats are computed on what it returns
  (``recipe_stats``), so they always fit the recipe;
* the **model side**: normalise with those stats (quantiles for every family but
  ``flow``), default prompt, text features, padding or action tokens.

Every step names its inverse, so ``Pipeline.inverse`` turns model output back into the
robot's actions in the reverse order. Nothing here reads data; all steps are column
expressions.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiframe.functions import robots as RB
from epiframe.functions import text as TX
from epiframe.functions import vectors as V
from epiframe.operators import schema as SC
from epiframe.operators import stats as S
from epiframe.operators import windows as W
from epiframe.plans.pipeline import Pipeline, Step

Tokenize = Callable[[Column], Column]


@dataclasses.dataclass(frozen=True)
class Recipe:
    """What a dataset needs.

    ``fields`` maps the names the robot mapping reads to paths of the source (P1);
    ``keys`` pass through. ``delta`` are signed run lengths (M11), or None. ``width`` is
    the model's action dimension, ``dims`` the robot's. ``prompt`` is used where the
    source has none. ``tokenize`` turns a text column into ids.
    """

    name: str
    robot: str
    family: str
    horizon: int
    dims: int
    width: int
    fields: Mapping[str, str]
    delta: tuple[int, ...] | None = None
    prompt: str | None = None
    keys: tuple[str, ...] = ("episode_id", "t")
    actions: str = "actions"
    token_len: int = 48
    vocabulary: int = 257_152
    tokenize: Tokenize = TX.code_points

    @property
    def quantiles(self) -> bool:
        return self.family != "flow"


# ---------------------------------------------------------------- robot mappings: inputs, outputs
def _dual_arm(r: Recipe) -> tuple[Step, Step]:
    return RB.map_dual_arm_in, RB.map_dual_arm_out


def _dual_arm_native(r: Recipe) -> tuple[Step, Step]:
    """Dual arm that already speaks the model's joint space."""
    return (lambda df: RB.map_dual_arm_in(df, adapt=False)), (lambda df: RB.map_dual_arm_out(df, adapt=False))


def _first_dims(r: Recipe) -> Step:
    return lambda df: RB.outputs_first_k(df, r.dims)


ROBOTS: dict[str, Callable[[Recipe], tuple[Step, Step]]] = {
    "dual_arm": _dual_arm,
    "dual_arm_native": _dual_arm_native,
    "arm8": lambda r: ((lambda df: RB.map_arm8_in(df, r.family)), _first_dims(r)),
    "arm7": lambda r: ((lambda df: RB.map_arm7_in(df, r.family)), _first_dims(r)),
    "arm31": lambda r: (RB.map_arm31_in, _first_dims(r)),
    "ur5": lambda r: (RB.map_ur5_in, _first_dims(r)),
    "plain": lambda r: ((lambda df: df), _first_dims(r)),
}


def _has_actions(step: Step) -> Step:
    """Inference rows have no actions; steps on actions leave them alone."""
    return lambda df: step(df) if "actions" in df.columns else df


def data_side(r: Recipe) -> Pipeline:
    """Chunk, repack, robot mapping, delta; the inverses are absolute actions, robot outputs."""
    p = Pipeline().push(inputs=[
        lambda df: W.action_chunk(df, r.horizon, [r.actions], keys=r.keys[:-1], t=r.keys[-1]) if r.actions in df.columns else df])
    fields = {k: k for k in r.keys} | dict(r.fields)

    def repack(df: DataFrame) -> DataFrame:
        there = {p for p, _ in SC.leaf_paths(df.schema)}
        optional = {r.actions, r.fields.get("prompt")}  # absent at inference, or filled by the default
        return SC.repack(df, {k: v for k, v in fields.items() if v in there or v not in optional})

    inputs, outputs = ROBOTS[r.robot](r)
    p = p.push(inputs=[repack]).push(inputs=[inputs], outputs=[_has_actions(outputs)])
    if r.delta is None:
        return p
    mask = V.make_bool_mask(*r.delta)
    return p.push(inputs=[_has_actions(lambda df: df.withColumn("actions", V.delta_actions("actions", "state", mask)))],
                  outputs=[_has_actions(lambda df: df.withColumn("actions", V.absolute_actions("actions", "state", mask)))])


def recipe_stats(r: Recipe, frames: DataFrame) -> DataFrame:
    """A4 for a recipe: norm stats of what its data side makes of ``frames``."""
    made = SC.drop_strings(data_side(r).forward(frames).select(*r.keys, "state", "actions"))
    return S.norm_stats(S.long_values(made, ["state"], ["actions"]))


# ---------------------------------------------------------------- model families
def _pad(width: int) -> Step:
    def run(df: DataFrame) -> DataFrame:
        df = df.withColumn("state", V.pad_to_dim("state", width))
        if "actions" in df.columns:
            df = df.withColumn("actions", V.on_rows("actions", lambda row: V.pad_to_dim(row, width)))
        return df

    return run


def _prompt_tokens(r: Recipe, with_state: bool) -> Step:
    """Prompt ids padded to ``token_len`` and their mask; the prompt itself is used up."""

    def run(df: DataFrame) -> DataFrame:
        if "prompt" not in df.columns:
            raise ValueError("a prompt is required")
        text = TX.prompt_with_state("prompt", "state") if with_state else F.concat(TX.clean_prompt_a("prompt"), F.lit("\n"))
        tokens, mask, _ = TX.pad_tokens(r.tokenize(text), r.token_len)
        return df.withColumns({"tokens": tokens, "token_mask": mask}).drop("prompt")

    return run


def _action_tokens(r: Recipe) -> Step:
    """Prompt and state as prefix; the chunk as binned, reversed ids between ``Action: `` and ``|`` (training only)."""

    def run(df: DataFrame) -> DataFrame:
        if "prompt" not in df.columns:
            raise ValueError("a prompt is required")
        prefix = r.tokenize(TX.prompt_with_state("prompt", "state", with_action_marker=False))
        postfix = F.array().cast("array<int>")
        if "actions" in df.columns:
            bins = V.token_remap(V.discretize(F.flatten("actions")), r.vocabulary)
            postfix = F.concat(r.tokenize(F.lit("Action: ")), bins, r.tokenize(F.lit("|")))
        df = df.withColumns({"_prefix": prefix, "_postfix": postfix})
        tokens, _, _ = TX.pad_tokens(F.concat("_prefix", "_postfix"), r.token_len)
        mask, ar, loss = TX.prefix_masks(F.size("_prefix"), F.size("_postfix"), r.token_len)
        return df.withColumns({"tokens": tokens, "token_mask": mask, "ar_mask": ar, "loss_mask": loss}).drop("_prefix", "_postfix", "prompt")

    return run


def _id_text(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit(","))


def _token_actions(r: Recipe) -> Step:
    """Predicted ids (from the first ``Action: `` to ``|``) back to a chunk; without a marker, or too few ids: zeros.

    Ids are searched as text: every step reads the one before it once, so that nothing
    is computed once per element.
    """
    need = r.horizon * r.dims

    def rows(ids: Column) -> Column:
        values = F.transform(V.token_remap(F.slice(ids, 1, need), r.vocabulary),
                             lambda t: t.cast("double") / F.lit(256.0) * F.lit(2.0) - F.lit(1.0))
        cut = V.once(lambda v: F.array(*[F.slice(v, i * r.dims + 1, r.dims) for i in range(r.horizon)]), values)
        zeros = F.array_repeat(F.array_repeat(F.lit(0.0), r.dims), r.horizon)
        return F.when(F.size(ids) >= need, cut).otherwise(zeros)

    def run(df: DataFrame) -> DataFrame:
        mark, end = _id_text(r.tokenize(F.lit("Action: "))), _id_text(r.tokenize(F.lit("|")))
        after = F.split_part(_id_text(F.col("tokens")), mark, F.lit(2))
        body = F.split_part(F.concat(F.lit(","), after), end, F.lit(1))
        ids = F.filter(F.split(body, ","), lambda x: x != "").cast("array<int>")
        return df.withColumn("actions", V.once(rows, ids))

    return run


FAMILIES: dict[str, Callable[[Recipe], Pipeline]] = {
    "flow": lambda r: Pipeline().push(inputs=[_prompt_tokens(r, with_state=False), _pad(r.width)]),
    "flow_q": lambda r: Pipeline().push(inputs=[_prompt_tokens(r, with_state=True), _pad(r.width)]),
    "tokens": lambda r: Pipeline().push(inputs=[_action_tokens(r)], outputs=[_token_actions(r)]),
}


def model_side(r: Recipe, stats: DataFrame | None) -> Pipeline:
    """Normalise, default prompt, the family's features; the inverse un-normalises."""
    if r.family not in FAMILIES:
        raise ValueError(f"unknown model family {r.family!r}")
    p = Pipeline()
    if stats is not None:
        mode = "quantile" if r.quantiles else "z"

        def normalise(df: DataFrame) -> DataFrame:
            return S.apply_stats(df, stats, {c: c for c in ("state", "actions") if c in df.columns}, mode)

        def restore(df: DataFrame) -> DataFrame:
            return S.apply_stats(df, stats, {c: c for c in ("state", "actions") if c in df.columns}, mode, inverse=True)

        p = p.push(inputs=[normalise], outputs=[restore])
    return p.push(inputs=[lambda df: SC.inject_default(df, "prompt", r.prompt)]).then(FAMILIES[r.family](r))


def build_recipe(r: Recipe, stats: DataFrame | None) -> Pipeline:
    """The whole recipe: data side, then model side; ``inverse`` runs from model output to robot actions."""
    return data_side(r).then(model_side(r, stats))


# The recipes' delta masks and dimensions, as each robot lays out its vectors.
RECIPES: dict[str, Recipe] = {r.name: r for r in (
    Recipe("dual_arm", "dual_arm", "flow", horizon=50, dims=14, width=32, delta=(6, -1, 6, -1),
           fields={"cam_high": "observation/images/top", "state": "observation/state", "actions": "action"}, actions="action"),
    Recipe("arm8", "arm8", "flow_q", horizon=10, dims=8, width=32, token_len=200,
           fields={"image": "exterior_image", "wrist_image": "wrist_image", "joint_position": "joint_position",
                   "gripper_position": "gripper_position", "actions": "actions", "prompt": "prompt"}),
    Recipe("arm8_positions", "arm8", "flow_q", horizon=10, dims=8, width=32, token_len=200, delta=(7, -1),
           fields={"image": "exterior_image", "wrist_image": "wrist_image", "joint_position": "joint_position",
                   "gripper_position": "gripper_position", "actions": "actions", "prompt": "prompt"}),
    Recipe("arm7", "arm7", "tokens", horizon=10, dims=7, width=7, token_len=180,
           fields={"image": "image", "wrist_image": "wrist_image", "state": "state", "actions": "actions", "prompt": "prompt"}),
    Recipe("arm7_delta", "arm7", "flow", horizon=50, dims=7, width=32, delta=(6, -1),
           fields={"image": "image", "wrist_image": "wrist_image", "state": "state", "actions": "actions", "prompt": "prompt"}),
    Recipe("arm31", "arm31", "flow_q", horizon=50, dims=31, width=32, delta=(9, -2, 9, -1, 9, -1), prompt="fold clothes", token_len=250,
           fields={"cam_high": "cam_high", "cam_left_wrist": "cam_left_wrist", "state": "state", "actions": "actions", "prompt": "prompt"}),
    Recipe("ur5", "ur5", "flow", horizon=50, dims=7, width=32, delta=(6, -1),
           fields={"joints": "joints", "gripper": "gripper", "image": "image", "wrist_image": "wrist_image", "actions": "actions",
                   "prompt": "prompt"}),
)}


def recipe(name: str, **changes) -> Recipe:
    """A preset with some values changed (another horizon, source paths, tokenizer, ...)."""
    return dataclasses.replace(RECIPES[name], **changes)


__all__: Sequence[str] = ("Recipe", "RECIPES", "recipe", "build_recipe", "data_side", "model_side", "recipe_stats")
