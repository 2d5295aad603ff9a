"""JSON columns read through their frequent paths: typed columns for those, and the rest kept, so that nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free

#: Types of columns, and what the schema of their values is called. Numbers with a fraction are decimals of many types: they stay in the rest, digit by digit.
KINDS = {"boolean": ("BOOLEAN",), "bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("STRING",)}


def fields(value: Column) -> Column:
    """An object's fields as an array of (key, value); null for what isn't an object."""
    return F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))


def paths(df: DataFrame, json_col: str, depth: int = 3) -> DataFrame:
    """(path, kind, n): how often each path of keys (an array, up to `depth` long) has a value of each kind, in all rows.

    Kinds are those of the schema of a value: BIGINT, STRING, OBJECT, ARRAY and
    so on. Every row's paths are counted by tasks before the shuffle, and counts
    of parts of the data can be summed. Null texts and texts that aren't JSON
    have no paths.
    """
    rows = df.select(F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(json_col)).alias("value"))
    found = None
    for _ in range(depth):
        spread = rows.select("path", F.explode(fields(F.col("value"))).alias("f"))
        rows = spread.select(F.concat("path", F.array("f.key")).alias("path"), F.col("f.value").alias("value"))
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        here = rows.groupBy("path", kind.alias("kind")).agg(F.count("*").alias("n"))
        found = here if found is None else found.unionByName(here)
    return found


def frequent(df: DataFrame, json_col: str, share: float = 0.5, depth: int = 3, most: int = 100) -> list[tuple[list[str], str]]:
    """The paths that have a scalar of one kind in at least that share of the rows, the commonest `most` of them, with the kind's type."""
    rows = df.count()
    types = {name: kind for kind, names in KINDS.items() for name in names}
    often = paths(df, json_col, depth).filter(F.col("kind").isin(*types) & (F.col("n") >= share * rows))
    return sorted((list(r.path), types[r.kind]) for r in often.orderBy(F.desc("n"), "path", "kind").limit(most).collect())


def reached(value: Column, path: list[str]) -> Column:
    for key in path:
        value = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))
    return value


def without(value: Column, path: list[str]) -> Column:
    """An object without what is at a path; other values as they are."""
    held = F.try_variant_get(value, "$", "map<string,variant>")
    if len(path) == 1:
        kept = F.map_filter(held, lambda k, _: k != path[0])
    else:
        kept = F.transform_values(held, lambda k, v: F.when(k == path[0], without(v, path[1:])).otherwise(v))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.to_variant_object(kept)).otherwise(value)


def shred(df: DataFrame, json_col: str, chosen: list[tuple[list[str], str]], out: list[str], rest: str = "rest") -> DataFrame:
    """df with a typed column for each of the chosen (path, type), and `rest`, a variant of what they don't hold.

    A value is in its typed column only if it is of that very type; others, nulls
    and missing ones leave the column null, and the values stay in `rest`. rest
    is null where the text is null or isn't JSON. The JSON column stays.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in (*out, rest) if c.lower() in taken] or len({c.lower() for c in (*out, rest)}) <= len(chosen):
        raise ValueError(f"names are taken: {clash}")
    (value,) = free(["_value"], df)
    rows = df.withColumn(value, F.try_parse_json(F.col(json_col))).withColumn(rest, F.col(value))
    for (path, kind), name in zip(chosen, out, strict=True):
        at = reached(F.col(value), path)
        mine = F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0).isin(*KINDS[kind])
        rows = rows.withColumn(name, F.when(mine, F.try_variant_get(at, "$", kind)))
        rows = rows.withColumn(rest, F.when(F.col(name).isNotNull(), without(F.col(rest), path)).otherwise(F.col(rest)))
    return rows.drop(value).select(*df.columns, *out, rest)


def assembled(rest: Column, typed: list[tuple[list[str], Column]]) -> Column:
    """Canonical JSON (keys sorted) of `rest` with the typed columns put back at their paths."""

    def put(value: Column, path: list[str], column: Column) -> Column:
        held = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
        one = column.cast("variant") if len(path) == 1 else put(F.try_element_at(held, F.lit(path[0])), path[1:], column)
        others = F.map_filter(held, lambda k, _: k != path[0])
        return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(path[0]), one)))

    for path, column in typed:
        rest = F.when(column.isNotNull(), put(rest, path, column)).otherwise(rest)
    return F.to_json(rest)
