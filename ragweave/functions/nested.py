"""Columns of nested types: all their text, members dropped at any depth, maps merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_text(x: Column, kind: T.DataType) -> Column:
    """All values inside, in order of fields and elements, joined by spaces; nulls and empty values are left out."""

    def parts(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            inner = [parts(c[f.name], f.dataType) for f in t]
            found = F.concat(*inner) if inner else F.array().cast("array<string>")
        elif isinstance(t, T.ArrayType):
            found = F.flatten(F.transform(c, lambda e: parts(e, t.elementType)))
        elif isinstance(t, T.MapType):
            found = F.flatten(F.transform(F.map_values(c), lambda e: parts(e, t.valueType)))
        else:
            found = F.array(c.cast("string"))
        return F.coalesce(found, F.array().cast("array<string>"))

    return F.array_join(F.filter(parts(x, kind), lambda v: v.isNotNull() & (v != "")), " ")


def without_key(x: Column, kind: T.DataType, name: str) -> Column:
    """``x`` without the fields and map keys of that name, at any depth."""
    if isinstance(kind, T.StructType):
        kept = [without_key(x[f.name], f.dataType, name).alias(f.name) for f in kind if f.name != name]
        return F.when(x.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: without_key(e, kind.elementType, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(x, lambda k, _: k.cast("string") != name), lambda _, v: without_key(v, kind.valueType, name))
    return x


def drop_key(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(column, without_key(F.col(column), df.schema[column].dataType, name))


def merge_maps(low: Column, high: Column) -> Column:
    """Both maps' entries; where both have a key, that of ``high``. A null map is empty."""
    return F.when(low.isNull(), high).when(high.isNull(), low).otherwise(F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high))
