"""Profiles of JSON lines and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_frequency(lines: DataFrame) -> DataFrame:
    """(key, rows): in how many objects of the lines (row VARIANT) each top-level key stands."""
    return lines.where("row is not null").select(F.explode(F.array_distinct(F.json_object_keys(F.to_json("row")))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


def keys_of_interest(frequency: DataFrame, exact: tuple[str, ...], parts: tuple[str, ...]) -> DataFrame:
    """Keys named in ``exact`` or containing one of ``parts``."""
    low = F.lower("key")
    hit = low.isin(*[e.lower() for e in exact]) if exact else F.lit(False)
    for p in parts:
        hit = hit | low.contains(p.lower())
    return frequency.where(hit)


def line_totals(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(total, blank, valid, bad) of text lines, blank lines included in the total."""
    from palatine.functions.normalize import strip
    from palatine.functions.parse import kind_of, strict_json

    blank = F.coalesce(strip(column) == "", F.lit(True))
    good = F.coalesce(kind_of(strict_json(column)) == "OBJECT", F.lit(False))
    return raw.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & good).alias("valid"),
        F.count_if(~blank & ~good).alias("bad"),
    )


def shapes(lines: DataFrame, n: int = 3, order: str = "ord") -> DataFrame:
    """(ord, shape) of the first n objects."""
    return lines.where("row is not null").orderBy(order).limit(n).select(order, F.schema_of_variant("row").alias("shape"))


def table_profile(tables: dict[str, DataFrame], first_columns: int = 10) -> DataFrame:
    """(table_name, rows, columns): row counts and the first column names; one job over all tables."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(",".join(df.columns[:first_columns])).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
