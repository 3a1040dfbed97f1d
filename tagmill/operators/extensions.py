"""Beyond the three commands: counts, grouping, several namespaces, set algebra on ids. No syntax of the language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.predicates import Layout, predicate
from tagmill.lang.nodes import Expr
from tagmill.lang.validate import read


def expression(text: str) -> Expr:
    """A where-expression by itself, checked like that of a QUERY."""
    return read(f"QUERY in:x where:({text})").get("where")


def count(events: DataFrame, layout: Layout, where: str) -> DataFrame:
    return events.where(predicate(expression(where), layout)).agg(F.count(F.lit(1)).alias("n"))


def count_by(events: DataFrame, layout: Layout, where: str, by: str | Column, having_least: int = 0) -> DataFrame:
    """Matches by a column; partial counts are made before the shuffle."""
    grouped = events.where(predicate(expression(where), layout)).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") >= having_least) if having_least else grouped


def distinct_entities(events: DataFrame) -> DataFrame:
    return events.select("entity_str", "entity_i64").distinct()


def combine(how: str, left: Column, right: Column) -> Column:
    """Set algebra of two selections as a predicate: and, or, xor, andnot."""
    return {"and": left & right, "or": left | right, "xor": left != right, "andnot": left & ~right}[how]


def across(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Several namespaces as one table with ns; ids stay those of each namespace."""
    return reduce(DataFrame.unionByName, (f.withColumn("ns", F.lit(ns)) for ns, f in frames))


def ids(events: DataFrame) -> DataFrame:
    """Only ids: the scan reads the id and what the predicate needs."""
    return events.select("id")


def bitmap_index(events: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """(key, value, bucket, bits): the ids of each tag value as bitmaps of 32,768 ids; built with partial aggregation."""
    tag = lambda k: F.col(layout.text_tags.get(k) or layout.number_tags[k]).cast("string")
    rows = events.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), tag(k).alias("value")) for k in keys])).alias("t")).where("t.value is not null")
    return rows.groupBy("t.key", "t.value", F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))
