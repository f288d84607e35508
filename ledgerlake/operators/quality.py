"""Structural checks as report rows (check_name, expected, actual, result)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "check_name string, expected string, actual string, result string"


def _rows(df: DataFrame, pairs: list[tuple[str, Column | str, Column | str]]) -> DataFrame:
    """One report row per (name, expected, actual) over a one-row DataFrame."""
    items = [F.struct(F.lit(n).alias("check_name"), (F.lit(e) if isinstance(e, str) else e.cast("string")).alias("expected"), F.col(a).cast("string").alias("actual")) for n, e, a in pairs]
    passed = F.when(F.col("expected").eqNullSafe(F.col("actual")), "PASS").otherwise("FAIL")
    return df.select(F.explode(F.array(*items)).alias("c")).select("c.*").withColumn("result", passed)


class TableChecks:
    """Checks of one table: all row-wise ones in a single aggregation, keys in one each."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggregates: dict[str, Column] = {}
        self.parts: list[DataFrame] = []

    def none(self, name: str, condition: Column) -> TableChecks:
        """No row meets ``condition``."""
        self.aggregates[name] = F.count_if(condition)
        return self

    def not_null(self, name: str, *columns: str) -> TableChecks:
        return self.none(name, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))

    def length(self, name: str, column: str, size: int) -> TableChecks:
        return self.none(name, F.length(column) != size)

    def accepted(self, name: str, column: str, values: list[str]) -> TableChecks:
        return self.none(name, F.col(column).isNotNull() & ~F.col(column).isin(*values))

    def reproducible(self, name: str, column: str, expected: Column) -> TableChecks:
        return self.none(name, ~F.col(column).eqNullSafe(expected))

    def unique(self, name: str, *columns: str) -> TableChecks:
        """Keys that stand more than once (rows with a NULL in the key are not compared)."""
        keyed = self.df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
        self.parts.append(_rows(keyed.agg(F.count(F.lit(1)).alias("a")), [(name, "0", "a")]))
        return self

    def relationship(self, name: str, column: str, parent: DataFrame, parent_column: str) -> TableChecks:
        """Distinct keys without a parent."""
        keys = self.df.where(F.col(column).isNotNull()).select(F.col(column).alias("k_")).distinct()
        lost = keys.join(parent.select(F.col(parent_column).alias("k_")), "k_", "left_anti")
        self.parts.append(_rows(lost.agg(F.count(F.lit(1)).alias("a")), [(name, "0", "a")]))
        return self

    def same_count(self, name: str, expected: DataFrame, actual: DataFrame) -> TableChecks:
        """Two results have the same number of distinct rows."""
        e, a = expected.distinct().agg(F.count(F.lit(1)).alias("e")), actual.distinct().agg(F.count(F.lit(1)).alias("a"))
        self.parts.append(_rows(e.crossJoin(F.broadcast(a)), [(name, F.col("e"), "a")]))  # one row each
        return self

    def counted(self, name: str, stored: str, *by: str) -> TableChecks:
        """Groups in which a row's stored count is not the number of the group's rows."""
        n = self.df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_"), F.count_if(F.col(stored).isNull()).alias("none_"), F.min(stored).alias("low_"), F.max(stored).alias("high_"))
        self.parts.append(_rows(n.where("none_ > 0 OR low_ <> n_ OR high_ <> n_").agg(F.count(F.lit(1)).alias("a")), [(name, "0", "a")]))
        return self

    def report(self) -> DataFrame:
        parts = list(self.parts)
        if self.aggregates:
            one = self.df.agg(*[c.alias(f"c{i}") for i, c in enumerate(self.aggregates.values())])
            parts.insert(0, _rows(one, [(n, "0", f"c{i}") for i, n in enumerate(self.aggregates)]))
        return reduce(DataFrame.unionByName, parts)


def divergence(a: DataFrame, b: DataFrame, keys: list[str], value_a: str, value_b: str, tolerance: float = 1.0) -> DataFrame:
    """Keys whose values differ by more than ``tolerance`` or stand on one side only."""
    both = a.select(*keys, F.col(value_a).alias("a"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col(value_b).alias("b"), F.lit(1).alias("in_b")), keys, "full")
    differs = F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.col("a").isNull() != F.col("b").isNull())
    return both.where(differs).select(*keys, "a", "b")


def drift(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether a figure has one value over all snapshots."""
    n = F.count_distinct(value)
    return df.groupBy(*keys).agg(n.alias("distinct_values")).withColumn("stability", F.when(F.col("distinct_values") <= 1, "STABLE").otherwise("RESTATEMENT_OR_DRIFT"))


def completeness(universe: DataFrame, years: list[int], facts: DataFrame, entity: str, year: str, columns: list[str]) -> DataFrame:
    """Share of the universe with a value, per column and year of the spine."""
    size = universe.agg(F.count(F.lit(1)).alias("size_"))
    held = facts.join(universe, entity, "left_semi").groupBy(year).agg(*[F.count_distinct(F.when(F.col(c).isNotNull(), F.col(entity))).alias(c) for c in columns])
    spine = size.select("size_", F.explode(F.array(*map(F.lit, years))).alias(year))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("n")) for c in columns])).alias("x")
    return spine.join(held, year, "left").select(year, "size_", pairs).select(year, "x.column_name", F.col("x.n").alias("companies"), F.round(F.try_divide(F.col("x.n") * 100.0, F.col("size_")), 1).alias("pct"))
