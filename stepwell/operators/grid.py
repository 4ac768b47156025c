"""Parameter sets: as dicts for flows, and the same grids as frames."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def params_generator_single(values: dict[str, list], base: dict | None = None) -> dict[int, dict]:
    """One parameter's values, numbered from 0, each with the base parameters."""
    (name, choices), *_ = values.items()
    return {k: {**(base or {}), name: v} for k, v in enumerate(choices)}


def params_generator_multiple(grid: dict[str, list]) -> dict[str, dict]:
    """All combinations: names sorted, the last varying fastest; keys like a_1_b_x."""
    names = sorted(grid)
    out = {}
    for combination in itertools.product(*[grid[n] for n in names]):
        out["_".join(f"{n}_{v}" for n, v in zip(names, combination, strict=True))] = dict(zip(names, combination, strict=True))
    return out


generate_exps_for_multi_param = params_generator_multiple


def params_generator_dictlist(grid: dict[str, list], base: dict | None = None) -> dict[int, dict]:
    """All combinations, the first name varying fastest, numbered from 0; a combination overrides the base."""
    names = list(grid)
    out = {}
    for k, combination in enumerate(itertools.product(*[grid[n] for n in reversed(names)])):
        out[k] = {**(base or {}), **dict(zip(names, reversed(combination), strict=True))}
    return out


def params_generator_df(df: Any, base: dict | None = None, most: int = 100_000) -> dict[int, dict]:
    """A parameter set for each row without nulls. Rows become steps of a plan on the driver, so their number is bounded."""
    if not isinstance(df, DataFrame):
        return {k: {**(base or {}), **r} for k, r in df.dropna().to_dict("index").items()}
    rows = df.na.drop("any").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} parameter sets")
    return {k: {**(base or {}), **r.asDict()} for k, r in enumerate(rows)}


def grid_frame(spark: Any, grid: dict[str, list]) -> DataFrame:
    """params_generator_multiple as a frame: a key and a column for each parameter. Only literals are combined."""
    names = sorted(grid)
    df = spark.range(1).drop("id")
    for n in names:
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in grid[n]])).alias(n))
    return df.select(F.concat_ws("_", *[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]).alias("key"), *names)


def grid_index_frame(spark: Any, grid: dict[str, list]) -> DataFrame:
    """params_generator_dictlist as a frame: a number and a column for each parameter, the first varying fastest."""
    df, number, step = spark.range(1).drop("id"), F.lit(0), 1
    for n, values in grid.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_at_{n}", n))
        number = number + F.col(f"_at_{n}") * step
        step *= len(values)
    return df.select(number.cast("int").alias("key"), *grid)
