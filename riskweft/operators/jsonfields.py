"""What JSON text holds: fields, types and gaps found by counting, and typed columns made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.roles import require_columns
from riskweft.session import checkpointed

DEEPEST = 100  # levels of nesting; JSON readers themselves stop near there
ROOT = ""
_KINDS = ("object", "array", "string", "bigint", "double", "boolean", "null")


def _kind(value: Column) -> Column:
    """The kind of a variant value."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BIGINT", "bigint").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("double")
    )


def _step(path: Column, key: Column) -> Column:
    """A path one field deeper; slashes and tildes in a key are escaped as in JSON pointers."""
    plain = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(path, F.lit("/"), F.when(key == "*", "~2").otherwise(plain))  # a star alone means elements


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """One row per path: how often it occurs, as what, in how many of the objects around it, and its type.

    Paths begin at the root (the empty path); ``/a/b`` is a field, ``/a/*`` the elements of an array.
    ``present`` counts values, ``parents`` the objects (or array elements) that could have held the
    field, ``missing_share`` those without it; ``null_share`` is the part of JSON nulls among present.
    ``kinds`` maps each kind to its count and ``type`` joins them: whole and other numbers to double,
    anything with nulls to itself, everything else that is mixed to string; all nulls are ``null``.
    Texts that are null are not counted; malformed ones have the path null and the type malformed.

    Values are taken apart one level at a time, and only objects and arrays go on to the next; a level
    is summed by path and kind in the map tasks, so the counts move, not the values.  Counts of
    parts of a table add up to those of the whole.
    """
    require_columns(df, [column])
    spark = df.sparkSession
    texts = df.select(F.col(column).cast("string").alias("text")).filter("text IS NOT NULL")
    parsed = texts.select("text", F.try_parse_json("text").alias("value"))
    counts = parsed.filter("value IS NULL").groupBy().agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(None).cast("string").alias("path"), F.lit("malformed").alias("kind"), "n"
    )
    level = parsed.filter("value IS NOT NULL").select(F.lit(ROOT).alias("path"), "value")
    for _ in range(DEEPEST):
        seen = level.withColumn("kind", _kind(F.col("value")))
        counts = counts.unionByName(seen.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n")))
        inner = checkpointed(seen.filter(F.col("kind").isin("object", "array")))
        if inner.isEmpty():
            break
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("key"), F.col("value").alias("part")))
        deeper = F.when(F.col("kind") == "array", F.concat("path", F.lit("/*"))).otherwise(_step(F.col("path"), F.col("key")))
        level = parts.select(deeper.alias("path"), F.col("part").alias("value"))
    else:
        raise ValueError(f"JSON nested deeper than {DEEPEST} levels")
    counts = counts.groupBy("path", "kind").agg(F.sum("n").alias("n"))
    return summarise_fields(counts)


def summarise_fields(counts: DataFrame) -> DataFrame:
    """``json_fields`` from counts (path, kind, n), as of several tables put together."""
    # One row per path and kind from here on.
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in _KINDS]
    paths = counts.groupBy("path").agg(F.sum("n").alias("present"), *by_kind)
    around = paths.select(F.col("path").alias("__around"), F.col("n_object").alias("__objects"))
    parent = F.when(F.col("path") == ROOT, None).otherwise(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1))
    rows = paths.withColumn("__parent", parent).join(around, F.col("__parent") == F.col("__around"), "left")
    inside_array = F.col("path").endswith("/*")
    parents = F.when(F.col("path").isNull() | inside_array | (F.col("path") == ROOT), F.col("present")).otherwise(F.col("__objects"))
    some = lambda *kinds: sum((F.col(f"n_{k}") for k in kinds), F.lit(0)) > 0
    only = lambda *kinds: ~some(*[k for k in _KINDS if k not in (*kinds, "null")])
    kind = (
        F.when(F.col("path").isNull(), "malformed").when(only(), "null").when(only("bigint"), "bigint")
        .when(only("bigint", "double"), "double")
    )
    for k in ("boolean", "string", "object", "array"):
        kind = kind.when(only(k), k)
    kinds = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), F.col(f"n_{k}").alias("n")) for k in _KINDS]), lambda e: e["n"] > 0))
    return rows.select(
        "path", "present", parents.alias("parents"), F.try_divide(parents - F.col("present"), parents).alias("missing_share"),
        F.try_divide(F.col("n_null"), F.col("present")).alias("null_share"), kinds.alias("kinds"), kind.otherwise("string").alias("type"),
    )


def schema_text(fields: DataFrame) -> str:
    """The type of the root as DDL, for ``from_json``; mixed values stay text, nothing but nulls becomes string.

    Collects the paths: as many rows as the JSON has different fields.
    """
    types = {r["path"]: r["type"] for r in fields.filter("path IS NOT NULL").select("path", "type").collect()}
    inner: dict[str, list[str]] = {}
    for path in sorted(types):
        if path:
            inner.setdefault(path.rpartition("/")[0], []).append(path)

    def ddl(path: str) -> str:
        kind = types.get(path, "string")
        if kind == "array":
            return f"array<{ddl(path + '/*') if path + '/*' in types else 'string'}>"
        if kind != "object":
            return {"null": "string"}.get(kind, kind)
        names = [(p.rpartition("/")[2].replace("~2", "*").replace("~1", "/").replace("~0", "~"), p) for p in inner.get(path, []) if p != path + "/*"]
        return "struct<" + ", ".join(f"`{n.replace('`', '``')}`: {ddl(p)}" for n, p in names) + ">"

    return ddl(ROOT)


def typed_json(df: DataFrame, column: str, into: str, schema: str | None = None) -> DataFrame:
    """``df`` with ``into``: the JSON text as a struct, array or value of the found (or given) type.

    Malformed texts give null.
    """
    require_columns(df, [column])
    schema = schema or schema_text(json_fields(df, column))
    return df.withColumn(into, F.from_json(F.col(column).cast("string"), schema))
