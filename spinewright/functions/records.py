"""JSON records, lists and maps: types, fields, record sets, population, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` of a variant; null for a missing one."""
    kind = F.schema_of_variant(value)
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(kind.isNull(), F.lit(None))
    for start, name in named.items():
        out = out.when(kind.startswith(start), name)
    return out.otherwise("number")


def json_type(text: Column) -> Column:
    """:func:`type_of` of JSON text; null for null and for what isn't JSON."""
    return type_of(F.try_parse_json(text))


def each_field(rows: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """``keep``, ``key``, ``value`` (text; strings without quotes, null for a JSON null) and ``type`` of every field of the JSON objects in
    column ``json``. What isn't an object gives no rows."""
    objects = rows.select(*keep, F.try_parse_json(F.col(json)).alias("_v")).where(type_of(F.col("_v")) == "object")
    fields = objects.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).select("key", F.col("value").alias("_f")))
    return fields.select(*keep, "key", F.variant_get("_f", "$", "string").alias("value"), type_of(F.col("_f")).alias("type"))


def record_set(rows: DataFrame, json: str, schema: str, keep: list[str], strict: bool = True) -> DataFrame:
    """``keep`` and the fields of ``schema`` for each record of the JSON arrays in column ``json``; a null array has none. A value that
    doesn't fit its type is an error if ``strict``, else null."""
    records = F.from_json(F.col(json), f"array<struct<{schema}>>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return rows.select(*keep, F.inline(records))


def populated(base: Column, json: Column, fields: list[tuple[str, str]]) -> Column:
    """The struct ``base`` with those of its ``fields`` (name, type) that the JSON object has, JSON nulls included."""
    given, has = F.from_json(json, ", ".join(f"{n} {t}" for n, t in fields)), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.struct(*[F.when(F.array_contains(has, n), given[n]).otherwise(base[n]).alias(n) for n, _ in fields])


def present(texts: Column) -> Column:
    """A list's texts that aren't null or blank; an empty list for a null one."""
    return F.coalesce(F.filter(texts, lambda t: F.coalesce(F.trim(t) != "", F.lit(False))), F.array().cast("array<string>"))


def added(a: Column, b: Column) -> Column:
    """Two maps of numbers added up by key; a null map counts as empty."""
    either = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.coalesce(either, a, b)


def overlaid(a: Column, b: Column) -> Column:
    """The map ``a`` with the entries of ``b`` over it; a null map counts as empty."""
    return F.coalesce(F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x)), a, b)


def only_once(values: Column) -> Column:
    """The list, or an error that names it if it holds a value twice."""
    return F.when(F.size(F.array_distinct(values)) == F.size(values), values).otherwise(F.raise_error(F.concat(F.lit("twice in a list: "), F.to_json(values))).cast("array<string>"))
