"""Schemaless parameters: JSON documents as columns, and the columns that are found in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(parameters: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path (a.b), null where the document is none or lacks it."""
    return F.get_json_object(parameters, f"$.{path}").try_cast(kind)


def parsed(parameters: Column | str) -> Column:
    """The document as a variant; what can't be read counts as {}."""
    return F.coalesce(F.try_parse_json(F.col(parameters) if isinstance(parameters, str) else parameters), F.parse_json(F.lit("{}")))


def keys(df: DataFrame, parameters: str, skip: Sequence[str] = ()) -> DataFrame:
    """Keys of the documents and how many have each: a row per key."""
    found = df.select(F.explode(F.json_object_keys(parameters)).alias("key"))
    return found.where(~F.col("key").isin(*skip)).groupBy("key").agg(F.count("*").alias("n")) if skip else found.groupBy("key").agg(F.count("*").alias("n"))


def inferred(df: DataFrame, parameters: str, skip: Sequence[str] = ()) -> dict[str, str]:
    """The narrowest type of each key, of bool, bigint, double, array and string: a row per key comes to the driver."""
    each = df.select(F.explode(F.json_object_keys(parameters)).alias("key"), F.col(parameters).alias("p"))
    text = F.expr("variant_get(try_parse_json(p), '$', 'map<string, string>')[key]")
    level = F.when(text.isNull(), 0).when(text.isin("true", "false"), 1).when(text.rlike(r"^-?[0-9]{1,18}$"), 2).when(text.try_cast("double").isNotNull(), 3).when(text.startswith("["), 4).otherwise(5)
    by = each.where(~F.col("key").isin(*skip) if skip else F.lit(True)).groupBy("key").agg(F.max(level).alias("top"), F.min(F.when(level > 0, level)).alias("low")).collect()
    out = {}
    for r in by:
        top, low = r["top"], r["low"] or 0
        mixed = top != low and not {top, low} <= {2, 3}
        out[r["key"]] = "string" if mixed or top in (0, 5) else {1: "boolean", 2: "bigint", 3: "double", 4: "array<double>"}[top]
    return dict(sorted(out.items()))


def flat(df: DataFrame, parameters: str, types: dict[str, str]) -> DataFrame:
    """The documents' keys as columns of these types, beside the others; a clash of names is an error."""
    clash = set(types) & set(df.columns)
    if clash:
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
    schema = ", ".join(f"`{k}` {t}" for k, t in types.items())
    return df.withColumn("_p", F.from_json(parameters, schema)).select(*df.columns, "_p.*")


def document(columns: Sequence[str]) -> Column:
    """Columns as one JSON document; null ones are left out."""
    return F.to_json(F.struct(*columns))
