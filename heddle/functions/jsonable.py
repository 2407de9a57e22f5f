"""A result's values as JSON can hold them, by the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonable(value: Column, kind: T.DataType) -> Column:
    """Booleans, whole numbers and text as they are; decimals as doubles; fractions as doubles, or text where they aren't finite; binary as hexadecimal digits;
    arrays, structs and maps of such; anything else, times among them, as its text."""
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.NullType)):
        return value.cast("string") if isinstance(kind, T.NullType) else value
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[jsonable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        keyed = F.transform(
            F.map_entries(value),
            lambda e: F.struct(e["key"].cast("string").alias("key"), jsonable(e["value"], kind.valueType).alias("value")),
        )
        return F.map_from_entries(keyed)
    return value if isinstance(kind, (T.FloatType, T.DoubleType)) else value.cast("string")


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls kept; numbers that aren't finite are written as text."""
    columns = [jsonable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
