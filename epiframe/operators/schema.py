"""Schema-level operators.

Paths are '/'-joined struct field names. Renames and repacks are decided on
the driver from the schema only (no data is read) and become one ``select``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "/"


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(path, type) of every non-struct field, depth first, in schema order."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        p = f"{prefix}{SEP}{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out.extend(leaf_paths(f.dataType, p))
        else:
            out.append((p, f.dataType))
    return out


def path_col(path: str) -> Column:
    c = None
    for part in path.split(SEP):
        c = F.col(f"`{part}`") if c is None else c.getField(part)
    return c


def _nest(flat: Mapping[str, Column]) -> list[Column]:
    """Unflatten ``{path: column}`` into top-level columns with nested structs."""
    tree: dict = {}
    for path, col in flat.items():
        node = tree
        parts = path.split(SEP)
        for p in parts[:-1]:
            node = node.setdefault(p, {})
            if not isinstance(node, dict):
                raise ValueError(f"both leaf and struct on the way to {path}")
        if parts[-1] in node:
            raise ValueError(f"{path} is given twice")
        node[parts[-1]] = col

    def build(name: str, node) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(k, v) for k, v in node.items()]).alias(name)
        return node.alias(name)

    return [build(k, v) for k, v in tree.items()]


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """Output tree whose leaves name input paths; a missing path is an error."""
    flat: dict[str, Column] = {}
    present = {p for p, _ in leaf_paths(df.schema)}

    def walk(node, prefix):
        for k, v in node.items():
            p = f"{prefix}{SEP}{k}" if prefix else k
            if isinstance(v, Mapping):
                walk(v, p)
            else:
                if v not in present:
                    raise KeyError(f"repack: no input path {v!r}")
                flat[p] = path_col(v)

    walk(structure, "")
    return df.select(*_nest(flat))


def inject_default(df: DataFrame, col: str, value) -> DataFrame:
    """Add ``col`` with ``value`` only if it is absent (schema-level)."""
    if value is None or col in df.columns:
        return df
    return df.withColumn(col, F.lit(value))


def _new_name(path: str, rules: Mapping[str, str | None]) -> str | None:
    """Name given by the first rule whose pattern covers the whole path; None drops the leaf."""
    for pattern, name in rules.items():
        found = re.fullmatch(pattern, path)
        if found:
            return None if name is None else found.expand(name)
    return path


def regex_rename(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Full-match regex rename of leaf paths; first pattern wins, ``None`` drops.

    Back-references use Python ``re`` syntax (``\\1``). Two leaves of one name, or
    a name that is a leaf and a struct at once, raise before any job runs.
    """
    moves = [(path, _new_name(path, patterns)) for path, _ in leaf_paths(df.schema)]
    moves = [(path, name) for path, name in moves if name is not None]
    uses = Counter(name for _, name in moves)
    repeated = sorted(name for name, n in uses.items() if n > 1)
    if repeated:
        raise ValueError(f"leaf name already exists: {', '.join(repeated)}")
    leaves = {tuple(name.split(SEP)) for name in uses}
    structs = {leaf[:depth] for leaf in leaves for depth in range(1, len(leaf))}
    if leaves & structs:
        raise ValueError(f"both leaf and struct: {', '.join(sorted(SEP.join(x) for x in leaves & structs))}")
    return df.select(*_nest({name: path_col(path) for path, name in moves}))


def apply_selector(df: DataFrame, selector: Mapping[str, object], fn: Callable[[Column, object], Column],
                   strict: bool = False) -> DataFrame:
    """Apply ``fn(col, selector[path])`` to leaves named in ``selector``."""
    columns = {path: path_col(path) for path, _ in leaf_paths(df.schema)}
    unknown = selector.keys() - columns.keys()
    if strict and unknown:
        raise ValueError(f"no leaf of the table: {', '.join(sorted(unknown))}")
    columns.update({path: fn(columns[path], arg) for path, arg in selector.items() if path in columns})
    return df.select(*_nest(columns))


def flatten_struct(df: DataFrame) -> DataFrame:
    """P5: nested structs → flat columns named ``a/b/c``."""
    return df.select(*[path_col(p).alias(p) for p, _ in leaf_paths(df.schema)])


def unflatten_struct(df: DataFrame) -> DataFrame:
    """P5 inverse: ``a/b/c`` columns → nested structs."""
    return df.select(*_nest({c: F.col(f"`{c}`") for c in df.columns}))


def drop_strings(df: DataFrame) -> DataFrame:
    """Drop every string leaf (top-level and nested)."""
    keep = {p: path_col(p) for p, t in leaf_paths(df.schema) if not isinstance(t, T.StringType)}
    return df.select(*_nest(keep))


def contract_check(df: DataFrame, required: list[str], paired: Mapping[str, str] | None = None,
                   masks: Mapping[str, str] | None = None) -> DataFrame:
    """Required columns present; paired columns come together; absent masks default to true."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    for a, b in (paired or {}).items():
        if (a in df.columns) != (b in df.columns):
            raise ValueError(f"'{a}' and '{b}' must be provided together")
    out = df
    for m, src in (masks or {}).items():
        out = out.withColumn(m, F.coalesce(F.col(m), F.lit(True)) if m in df.columns else F.lit(True))
    return out


def unique_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def schema_table(spark, df: DataFrame) -> DataFrame:
    """(path, dtype) of every leaf as a small DataFrame."""
    rows = [(p, t.simpleString()) for p, t in leaf_paths(df.schema)]
    return spark.createDataFrame(rows, "path string, dtype string")


def schema_diff(spark, a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two ``(path, dtype)`` tables; rows where they differ."""
    ta = schema_table(spark, a).withColumnRenamed("dtype", "left_dtype")
    tb = schema_table(spark, b).withColumnRenamed("dtype", "right_dtype")
    j = ta.join(tb, "path", "full_outer")
    return j.filter(~F.col("left_dtype").eqNullSafe(F.col("right_dtype")))


def record_summary(df: DataFrame) -> DataFrame:
    """One row per leaf: path, dtype, min/max array size (one aggregation pass)."""
    leaves = leaf_paths(df.schema)
    aggs = []
    for i, (p, t) in enumerate(leaves):
        if isinstance(t, T.ArrayType):
            aggs += [F.min(F.size(path_col(p))).alias(f"_mn{i}"), F.max(F.size(path_col(p))).alias(f"_mx{i}")]
        else:
            aggs += [F.lit(None).cast("int").alias(f"_mn{i}"), F.lit(None).cast("int").alias(f"_mx{i}")]
    one = df.agg(*aggs) if aggs else df.limit(0)
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t.simpleString()).alias("dtype"),
                              F.col(f"_mn{i}").alias("min_size"), F.col(f"_mx{i}").alias("max_size"))
                     for i, (p, t) in enumerate(leaves)])
    return one.select(F.inline(rows))
