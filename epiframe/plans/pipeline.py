"""Composable pipelines (F1–F4); the recipes built on them are in ``plans.recipes``.

A step is any ``DataFrame -> DataFrame`` callable. A ``Pipeline`` holds a
forward list and an inverse list; pushing a group appends its inputs and
*prepends* its outputs, so the inverse runs in reverse order of the
forward steps.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


Step = Callable[[DataFrame], DataFrame]


def compose(steps: Sequence[Step]) -> Step:
    """run steps left to right (``reduce`` over ``DataFrame.transform``)."""
    steps = list(steps)

    def run(df: DataFrame) -> DataFrame:
        return reduce(lambda acc, f: acc.transform(f), steps, df)

    return run


@dataclasses.dataclass(frozen=True)
class Pipeline:
    """forward steps (inputs) and inverse steps (outputs)."""

    inputs: tuple[Step, ...] = ()
    outputs: tuple[Step, ...] = ()

    def push(self, inputs: Sequence[Step] = (), outputs: Sequence[Step] = ()) -> "Pipeline":
        """Inputs are appended; outputs are prepended."""
        return Pipeline(self.inputs + tuple(inputs), tuple(outputs) + self.outputs)

    def forward(self, df: DataFrame) -> DataFrame:
        return compose(self.inputs)(df)

    def then(self, other: "Pipeline") -> "Pipeline":
        """This pipeline's inputs first; its outputs last."""
        return self.push(other.inputs, other.outputs)

    def inverse(self, df: DataFrame) -> DataFrame:
        return compose(self.outputs)(df)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """apply a per-batch pandas function (Arrow batches, one pass per partition).

    For steps a column expression cannot state; everything else stays in
    the JVM.
    """

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
