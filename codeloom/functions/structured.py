"""JSON inside columns: lists and objects of metadata, members of objects and arrays as rows, values by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_list(text: Column) -> Column:
    """The strings of a JSON array; of an object, of broken JSON or of null an empty list."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def json_object(text: Column) -> Column:
    """A JSON object as a map of its members, values as JSON or plain text; of anything else an empty map."""
    return F.coalesce(F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>")), F.create_map().cast("map<string,string>"))


def json_lists(text: Column) -> Column:
    """An object of arrays, such as type arguments by callee, as a map of lists."""
    return F.transform_values(json_object(text), lambda _, v: json_list(v))


def json_each(rows: DataFrame, column: str) -> DataFrame:
    """rows with (key, value) for each member of the column's object, or of its array by place from 0; rows of anything else, of empty ones and of null are left out."""
    members = F.map_entries(json_object(F.col(column)))
    elements = F.transform(json_list(F.col(column)), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    each = F.concat(F.transform(members, lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))), elements)
    return rows.withColumn("__e", F.explode(each)).select(*rows.columns, F.col("__e.key").alias("key"), F.col("__e.value").alias("value"))


def json_at(text: Column, path: str) -> Column:
    """The value at a path such as $.a[0].b, null where there is none."""
    return F.get_json_object(text, path)
