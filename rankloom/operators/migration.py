"""Nested records of an old form as flat tables of a new one, level by level, with fields changed on the way and counts checked both ways."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


@dataclass(frozen=True)
class Level:
    """How records of a level become rows: new fields from columns of the old record (``r``), the array below, and what identifies a record."""

    name: str
    key: str
    fields: dict[str, str]
    children: str | None = None
    below: Level | None = None


def evolved(record: Column, kind: StructType, fields: dict[str, str]) -> list[Column]:
    """New fields as SQL of the old record ``r``; an old field that the data has not got counts as null, so forms of several ages go together."""
    known = {f.name for f in kind.fields}
    out = []
    for name, sql in fields.items():
        for used in _named(sql) - known:
            sql = sql.replace(f"r.{used}", "null")
        out.append(F.expr(sql.replace("r.", "_r.")).alias(name))
    return out


def _named(sql: str) -> set[str]:
    return set(re.findall(r"\br\.(\w+)", sql))


def migrate(records: DataFrame, top: Level, deepest: int = 8) -> dict[str, DataFrame]:
    """A table for each level: path (the keys from the top), depth, parent path, and the level's new fields.

    ``records`` has one row a top record. An array below is exploded once, from the level above it, so a wide
    record is spread over rows before anything is done with its children. Missing or null arrays have no
    rows; keys that are null become their place in the array.
    """
    out: dict[str, DataFrame] = {}
    level: Level | None = top
    rows = records.select(F.struct(*records.columns).alias("_r"), F.array().cast("array<string>").alias("_up"), F.lit(0).alias("_at"))
    depth = 0
    while level is not None and depth < deepest:
        kind = rows.schema["_r"].dataType
        names = {f.name: f.dataType for f in kind.fields}
        key = F.coalesce(F.col(f"_r.{level.key}").cast("string"), F.concat(F.lit("#"), F.col("_at").cast("string"))) if level.key in names else F.concat(F.lit("#"), F.col("_at").cast("string"))
        placed = rows.withColumn("_path", F.concat("_up", F.array(key)))
        out[level.name] = placed.select(F.array_join("_path", "/").alias("path"), F.lit(depth).alias("depth"), F.nullif(F.array_join("_up", "/"), F.lit("")).alias("parent"), *evolved(F.col("_r"), kind, level.fields))
        if level.children is None or not isinstance(names.get(level.children), ArrayType):
            break
        rows = placed.select(F.col("_path").alias("_up"), F.posexplode(f"_r.{level.children}").alias("_at", "_r")).filter("_r is not null")
        level, depth = level.below, depth + 1
    return out


def _children(name: str, kind: ArrayType) -> Callable[[Column], Column]:
    return lambda record: F.coalesce(record[name], F.array().cast(kind))


def nested_counts(records: DataFrame, top: Level) -> DataFrame:
    """(level, records) counted in the nested form, without taking it apart: sizes of arrays, added up level by level."""
    sums, level, at, kind = [], top, [F.struct(*records.columns)], StructType(records.schema.fields)
    arrays = F.array(at[0])
    while level is not None:
        sums.append((level.name, F.size(arrays)))
        found = {f.name: f.dataType for f in kind.fields}
        if level.children is None or not isinstance(found.get(level.children), ArrayType):
            break
        arrays = F.filter(F.flatten(F.transform(arrays, _children(level.children, found[level.children]))), lambda r: r.isNotNull())
        kind, level = found[level.children].elementType, level.below
    row = records.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(n) for n, s in sums])
    return row.unpivot([], [n for n, _ in sums], "level", "records")


def migration_check(records: DataFrame, tables: dict[str, DataFrame], top: Level) -> DataFrame:
    """(level, records, rows, orphans, missing): both counts, and rows whose parent is not there; missing is the difference."""
    parts, above = [], None
    for name, rows in tables.items():
        orphans = rows.join(above.select(F.col("path").alias("parent")).distinct(), "parent", "left_anti") if above is not None else rows.filter("parent is not null")
        parts.append(rows.agg(F.count("*").alias("rows")).crossJoin(orphans.agg(F.count("*").alias("orphans"))).select(F.lit(name).alias("level"), "rows", "orphans"))
        above = rows
    counted = reduce(DataFrame.union, parts)
    return nested_counts(records, top).join(counted, "level", "left").select("level", "records", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("orphans", F.lit(0)).alias("orphans"), (F.col("records") - F.coalesce("rows", F.lit(0))).alias("missing"))
