"""Pipelines of DataFrame steps: sequences with conditions, switches, ensembles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register an operator of (df, **options) by name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in OPERATORS:
            raise ValueError(f"operator {name} exists")
        OPERATORS[name] = f
        return f

    return register


def unregister(name: str) -> None:
    OPERATORS.pop(name)


def json_condition(column: str, path: str, value: str | None = None) -> Column:
    """A member exists, or equals ``value`` as a string."""
    found = F.get_json_object(column, path)
    return F.coalesce(found == value, F.lit(False)) if value is not None else found.isNotNull()


def sequence(df: DataFrame, steps: list[tuple[Step, Column | None]]) -> DataFrame:
    """Steps in turn; rows for which a step's condition fails stop there and come out as they are."""
    done: list[DataFrame] = []
    for step, condition in steps:
        if condition is not None:
            holds = F.coalesce(condition, F.lit(False))
            done.append(df.filter(~holds))
            df = df.filter(holds)
        df = step(df)
    for part in done:
        df = df.unionByName(part, allowMissingColumns=True)
    return df


def switch(df: DataFrame, branches: list[tuple[Column, Step]]) -> DataFrame:
    """Each row through the last branch whose condition holds; rows without one stay as they are."""
    chosen = F.lit(-1)
    for i, (condition, _) in enumerate(branches):
        chosen = F.when(F.coalesce(condition, F.lit(False)), F.lit(i)).otherwise(chosen)
    marked = df.withColumn("__branch", chosen)
    out = marked.filter("__branch = -1").drop("__branch")
    for i, (_, step) in enumerate(branches):
        out = out.unionByName(step(marked.filter(F.col("__branch") == i).drop("__branch")), allowMissingColumns=True)
    return out


def ensemble(df: DataFrame, branches: dict[str, Step], keys: list[str]) -> DataFrame:
    """Every branch over all rows; each one's other columns become a struct under its name."""
    out = df.select(*keys).distinct()
    for name, step in branches.items():
        found = step(df)
        rest = [c for c in found.columns if c not in keys]
        out = out.join(found.select(*keys, F.struct(*rest).alias(name)), keys, "left")
    return out
