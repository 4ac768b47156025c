"""Tagged union: frames stacked by column name, each with its parameters as constant columns.

Tags are literals, so a filter on one prunes whole branches from the plan. Missing columns become null. Row order has
no meaning.
"""

from __future__ import annotations

import datetime
import enum
import warnings
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.sources.targets import as_frame


def literal(value: Any) -> Column:
    """A constant of a parameter's value: lists become arrays, dicts maps, enums their name."""
    if isinstance(value, enum.Enum):
        return F.lit(value.name)
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.create_map(*[x for k, v in value.items() for x in (literal(k), literal(v))])
    if value is None or isinstance(value, (bool, int, float, str, bytes, datetime.date, datetime.datetime)):
        return F.lit(value)
    return F.lit(str(value))


#: A union expected to be smaller than this is one partition.
SMALL_BYTES = 1 << 20


def changed_by(clashes: list[tuple[DataFrame, str, Any]]) -> list[str]:
    """Of the tags that replace columns (frame, name, value), the names for which any row has another value; what can't be
    compared counts as other. One query for all, which reads these columns alone and skips what statistics show equal."""
    try:
        others = [df.where(~F.col(name).eqNullSafe(literal(value))).select(F.lit(name).alias("name")) for df, name, value in clashes]
        found = {r["name"] for r in reduce(DataFrame.union, others).distinct().collect()}
    except Exception:
        found = {name for _, name, _ in clashes}
    return [n for n in dict.fromkeys(name for _, name, _ in clashes) if n in found]


def tagged(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    """df with a column for each parameter. A column that is there is replaced."""
    return df.withColumns({k: literal(v) for k, v in params.items()}) if params else df


def _stack(frames: list[DataFrame]) -> DataFrame:
    """A balanced tree of unions: the plan of n branches is log n deep before Spark flattens it."""
    while len(frames) > 1:
        frames = [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames[k : k + 2]) for k in range(0, len(frames), 2)]
    return frames[0]


def _gathered(df: DataFrame) -> DataFrame:
    """A union of very small frames in one partition, so that stacking again and again doesn't multiply tiny files. By the
    size that Spark expects, which for stored frames is that of their files."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.coalesce(1) if int(str(size)) < SMALL_BYTES else df


def concat_iter(items: Iterable[tuple], concat_fn: Callable | None = None, keys: list[str] | None = None) -> Any:
    """Stack (id, params, data) triples. Where a tag replaces a column and so changes data, that is said once a column;
    tagging again with equal values is silent. data: a frame, or a list or dict of frames, which are stacked part by part.
    keys: the parameters that become columns (None: all, []: none). concat_fn(id, params, frame) replaces tagging."""
    clashes: list[tuple[DataFrame, str, Any]] = []

    def one(identifier: Any, params: dict, data: Any) -> DataFrame:
        df = as_frame(data)
        if concat_fn is not None:
            return concat_fn(identifier, params, df)
        tags = {k: v for k, v in params.items() if keys is None or k in keys}
        clashes.extend((df, k, v) for k, v in tags.items() if k in df.columns)
        return tagged(df, tags)

    parts: list[Any] = []
    for identifier, params, data in items:
        if isinstance(data, dict):
            parts.append({k: one(identifier, params, v) for k, v in data.items()})
        elif isinstance(data, list):
            parts.append([one(identifier, params, v) for v in data])
        else:
            parts.append(one(identifier, params, data))
    for name in changed_by(clashes) if clashes else ():
        warnings.warn(f"the tag {name!r} replaces a column of the data", stacklevel=2)
    if not parts:
        from stepwell.sources.files import active

        return active().createDataFrame([], "struct<>")
    if isinstance(parts[0], dict):
        return {k: _gathered(_stack([p[k] for p in parts])) for k in parts[0]}
    if isinstance(parts[0], list):
        return [_gathered(_stack([p[k] for p in parts])) for k in range(len(parts[0]))]
    return _gathered(_stack(parts))
