"""Column-level profile of every load: shares, distincts, quantiles, ranges, patterns and drift.

Method: the profiled columns, of any type, are unpivoted to (column, value, load) cells with
counts, range-partitioned and sorted by (column, value). Counts per partition, column and load are
prefix-summed over the partitions; with these offsets a second pass over the sorted partitions gives
the exact value at any rank, the exact number of distinct values, and, from the merged
cumulative curves of a load and the one before it, the exact Kolmogorov-Smirnov distance.

Numbers, dates (days since 1970), times (microseconds) and booleans are ordered as doubles, where
values that share a double are told apart by their text; all other types are ordered as text.

Scale: equal values collapse to one cell per load before the range shuffle, so a value that
holds a third of all rows is one cell. The sorted cells are written to the shared folder once
and read a few times. The prefix table has at most (partitions + columns) x loads rows, and no more
partitions are made than keep it below ``MOST_PREFIXES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import cut, plan_bytes

#: Bytes of input to a range partition, and rows of the prefix table (32 bytes each in the driver and every worker).
PARTITION_BYTES, MOST_PREFIXES = 16_000_000, 2_000_000
#: Longer texts are ordered by so many first characters and then by their SHA-256.
LONG_TEXT = 256
#: Cells of the table of values by loads that is held at once.
GRID_CELLS = 2_000_000

_NUMERIC = (T.NumericType, T.BooleanType)


def _order_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, _NUMERIC):
        return c.cast("double")
    return F.when(c.isNotNull(), F.lit(0.0))


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def _is_text(kind: T.DataType) -> bool:
    return not isinstance(kind, (*_NUMERIC, T.DateType, T.TimestampType))


def _rest(c: Column, kind: T.DataType) -> Column:
    """Text that tells apart values which share a double, or that is the value; NULL for all others."""
    if isinstance(kind, T.DecimalType):
        back = c.cast("double").cast(f"decimal({kind.precision},{kind.scale})")
        return F.when(back.isNull() | (back != c), c.cast("string"))
    if isinstance(kind, T.LongType):
        return F.when(c.cast("double").cast("decimal(38,0)") != c.cast("decimal(38,0)"), c.cast("string"))
    if isinstance(kind, T.TimestampType):
        us = F.unix_micros(c)
        return F.when(us.cast("double").cast("decimal(38,0)") != us.cast("decimal(38,0)"), us.cast("string"))
    if _is_text(kind):
        t = _text(c, kind)
        return F.when(F.length(t) > LONG_TEXT, F.concat(F.substring(t, 1, LONG_TEXT), F.lit("\u0000"), F.sha2(t, 256))).otherwise(t)
    return F.lit(None).cast("string")


def value_cells(df: DataFrame, load: Column, columns: list[str]) -> DataFrame:
    """(column_name, load_key, state, v, rest, n, size): one cell per column, load and value.

    ``state`` is ``null``, ``nan``, ``inf``, ``finite`` or ``text``; v is NULL for null and NaN, 0 for
    text; size is the length of a text.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in columns:
        x, kind = F.col(f"`{c}`"), kinds[c]
        size = F.length(_text(x, kind)) if _is_text(kind) else F.lit(None).cast("int")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(_is_text(kind)).alias("is_text"), _order_value(x, kind).alias("v"), _rest(x, kind).alias("rest"), size.alias("size")))
    v = F.col("x.v")
    state = F.when(v.isNull(), "null").when(F.col("x.is_text"), "text").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "inf").otherwise("finite")
    return (
        df.select(load.alias("load_key"), F.explode(F.array(*parts)).alias("x"))
        .where(F.col("load_key").isNotNull())
        .select("load_key", "x.column_name", state.alias("state"), F.when(~F.isnan(v), v + F.lit(0.0)).alias("v"), "x.rest", "x.size")
        .groupBy("column_name", "load_key", "state", "v", "rest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    )


def pattern_of(c: Column) -> Column:
    """Class of a text: runs of upper-case letters as A, lower-case as a, digits as 9, blanks as one, codes of letters and digits as X."""
    steps = [(r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Nd}+", "9"), (r"\s+", " "), (r"[Aa9]*(?:[Aa]9|9[Aa])[Aa9]*", "X")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


class _Prefixes:
    """Rows of each (column, load) that lie before a partition, in flat arrays."""

    def __init__(self, counts: pd.DataFrame, loads: list[str]):
        counts = counts.sort_values(["column_name", "load_key", "pid"])
        self.loads = loads
        self.columns = sorted(counts["column_name"].unique())
        of = counts["column_name"].map({c: i for i, c in enumerate(self.columns)}).to_numpy(dtype=np.int64)
        load = counts["load_key"].map({k: i for i, k in enumerate(loads)}).to_numpy(dtype=np.int64)
        self.totals = np.zeros((len(self.columns), len(loads)), dtype=np.int64)
        np.add.at(self.totals, (of, load), counts["n"].to_numpy())
        upto = counts.groupby(["column_name", "load_key"])["n"].cumsum().to_numpy()
        self.key, self.pid, self.upto = of * max(1, len(loads)) + load, counts["pid"].to_numpy(dtype=np.int64), upto
        self.starts = np.searchsorted(self.key, np.arange(len(self.columns) * len(loads) + 1))

    def before(self, column: int, pid: int) -> np.ndarray:
        out = np.zeros(len(self.loads))
        for j in range(len(self.loads)):
            a, b = self.starts[column * len(self.loads) + j], self.starts[column * len(self.loads) + j + 1]
            at = a + np.searchsorted(self.pid[a:b], pid)
            out[j] = self.upto[at - 1] if at > a else 0
        return out


def _curves(shared, shares: tuple[float, ...]):
    """A pass over sorted partitions; yields quantile values and largest curve distances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefixes: _Prefixes = shared.value
        loads = prefixes.loads
        place = {k: i for i, k in enumerate(loads)}
        number = {c: i for i, c in enumerate(prefixes.columns)}
        chunk = max(64, GRID_CELLS // max(1, len(loads)))
        out: list[tuple] = []
        now: str | None = None
        seen = np.zeros(len(loads))
        held: pd.DataFrame | None = None

        def consume(part: pd.DataFrame) -> None:
            nonlocal now, seen
            for column, rows in part.groupby("column_name", sort=False):
                if column != now:
                    now, seen = column, prefixes.before(number[column], int(rows["pid"].iloc[0]))
                total = prefixes.totals[number[column]].astype(np.float64)
                full = np.flatnonzero(total)
                v, rest = rows["v"].to_numpy(), rows["rest"].fillna("").to_numpy()
                new = np.r_[True, (v[1:] != v[:-1]) | (rest[1:] != rest[:-1])]
                at, j, n = np.cumsum(new) - 1, rows["load_key"].map(place).to_numpy(), rows["n"].to_numpy()
                values, texts = v[new], rest[new]
                for first in range(0, values.size, chunk):
                    last = min(values.size, first + chunk)
                    a, b = np.searchsorted(at, (first, last))
                    grid = np.zeros((last - first, len(loads)))
                    np.add.at(grid, (at[a:b] - first, j[a:b]), n[a:b])
                    curve = seen + np.cumsum(grid, axis=0)
                    for i, k in enumerate(full):
                        for q in shares:
                            for side, rank in (("low", np.floor((total[k] - 1) * q)), ("high", np.ceil((total[k] - 1) * q))):
                                if seen[k] <= rank < curve[-1, k]:
                                    hit = first + np.searchsorted(curve[:, k], rank, side="right")
                                    out.append((column, loads[k], "quantile", side, float(q), float(values[hit]), texts[hit]))
                        if i:
                            p = full[i - 1]
                            out.append((column, loads[k], "ks", "", 0.0, float(np.abs(curve[:, k] / total[k] - curve[:, p] / total[p]).max()), None))
                        out.append((column, loads[k], "distinct", "", 0.0, float((grid[:, k] > 0).sum()), None))
                    seen = curve[-1]

        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = part.iloc[-1] if len(part) else None
            if last is None:
                continue
            open_ = (part["column_name"] == last["column_name"]) & (part["v"] == last["v"]) & (part["rest"].fillna("") == (last["rest"] if isinstance(last["rest"], str) else ""))
            held, done = part[open_], part[~open_]
            if len(done):
                consume(done)
            if len(out) > 50_000:
                yield _best(out)
                out.clear()
        if held is not None and len(held):
            consume(held)
        yield _best(out)

    return run


def _best(out: list[tuple]) -> pd.DataFrame:
    """Curve rows of a partition, distances and counts reduced to one per column and load."""
    df = pd.DataFrame(out, columns=["column_name", "load_key", "what", "side", "q", "x", "t"])
    many = df["what"] != "quantile"
    less = df[many].groupby(["column_name", "load_key", "what", "side", "q"], as_index=False, sort=False)["x"].agg(["max", "sum"])
    less["x"] = np.where(less["what"] == "ks", less["max"], less["sum"]) if len(less) else pd.Series(dtype=float)
    return pd.concat([df[~many], less.drop(columns=["max", "sum"]).assign(t=None)], ignore_index=True)[df.columns].astype({"x": float, "q": float})


def column_profile(df: DataFrame, load: Column, columns: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), violations: dict[str, Column] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """One row per column and load with exact statistics and drift against the load before it.

    Result: column_name, load_key, rows, nulls, nans, infinite, distinct_values, top_rows (rows of
    the most frequent value that is neither NULL nor NaN), min_value, max_value (finite, as
    double), violations, one ``q<percent>`` column per quantile (midpoint rule), ks_distance (to the
    last earlier load with values; NULL for the first) and previous_load. Of text columns the values
    are NULL and min_text, max_text, median_text (the lower one), blanks, min_length, max_length,
    patterns (classes that occur, see ``pattern_of``), top_pattern, top_pattern_rows and
    pattern_violations (rows that do not match the regular expression in ``patterns``) are given.

    ``columns`` None takes all columns of the table. Dates count in days since 1970. ``violations`` maps
    a column to a condition over v (double), rest (text) and load_key that marks a value as invalid.
    Rows without a load are left out; a load whose values are all NULL has NULL quantiles; ``-0.0``
    equals ``0.0``; an empty table gives no rows; repeated rows count as delivered. Arrays, maps and
    structs are profiled as their JSON text.
    """
    spark = df.sparkSession
    columns = columns or df.columns
    cells = value_cells(df, load, columns)
    loads_seen = df.select(load.alias("k")).distinct().count()
    wanted = max(spark.sparkContext.defaultParallelism, (plan_bytes(df) or 0) // PARTITION_BYTES)
    partitions = int(max(1, min(wanted, MOST_PREFIXES // max(1, loads_seen))))
    ranged = cut(
        cells.repartitionByRange(partitions, "column_name", "v", "rest")
        .sortWithinPartitions("column_name", "v", "rest")
        .withColumn("pid", F.spark_partition_id())
    )
    bad = F.lit(False)
    for name, condition in (violations or {}).items():
        bad = bad | ((F.col("column_name") == name) & condition)
    odd = F.lit(False)
    for name, expression in (patterns or {}).items():
        odd = odd | ((F.col("column_name") == name) & ~F.col("rest").rlike(expression))
    finite, text = F.col("state") == "finite", F.col("state") == "text"
    n_where = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    base = ranged.groupBy("column_name", "load_key").agg(
        F.sum("n").alias("rows"),
        *[n_where(F.col("state") == s).alias(a) for s, a in (("null", "nulls"), ("nan", "nans"), ("inf", "infinite"))],
        F.max(F.when(F.col("state").isin("finite", "inf", "text"), F.col("n"))).alias("top_rows"),
        F.min(F.when(finite, F.col("v"))).alias("min_value"),
        F.max(F.when(finite, F.col("v"))).alias("max_value"),
        n_where((finite | text) & bad).alias("violations"),
        F.min(F.when(text, F.col("rest"))).alias("min_text"),
        F.max(F.when(text, F.col("rest"))).alias("max_text"),
        n_where(text & (F.trim("rest") == "")).alias("blanks"),
        F.min("size").alias("min_length"),
        F.max("size").alias("max_length"),
        n_where(text & odd).alias("pattern_violations"),
    )
    valued = ranged.where(finite | text)
    counts = valued.groupBy("pid", "column_name", "load_key").agg(F.sum("n").alias("n")).toPandas()  # at most MOST_PREFIXES rows and columns x loads
    prefixes = _Prefixes(counts, sorted(counts["load_key"].unique()))
    ends = valued.select("pid", "column_name", "load_key", "v", "rest", "n").mapInPandas(
        _curves(spark.sparkContext.broadcast(prefixes), tuple({*quantiles, 0.5})), "column_name string, load_key string, what string, side string, q double, x double, t string"
    )
    at = lambda q, side: (F.col("what") == "quantile") & (F.col("side") == side) & (F.col("q") == q)
    wide = ends.groupBy("column_name", "load_key").agg(
        F.sum(F.when(F.col("what") == "distinct", F.col("x"))).cast("long").alias("finite_distinct"),
        F.max(F.when(F.col("what") == "ks", F.col("x"))).alias("ks_distance"),
        F.max(F.when(at(0.5, "low"), F.col("t"))).alias("median_text"),
        *[((F.max(F.when(at(q, "low"), F.col("x"))) + F.max(F.when(at(q, "high"), F.col("x")))) / 2).alias(f"q{round(q * 100)}") for q in quantiles],
    )
    classes = ranged.where(text).groupBy("column_name", "load_key", pattern_of(F.col("rest")).alias("pattern")).agg(F.sum("n").alias("n"))
    shapes = classes.groupBy("column_name", "load_key").agg(F.count(F.lit(1)).alias("patterns"), F.max(F.struct("n", "pattern")).alias("top"))
    infinite_kinds = ranged.where(F.col("state") == "inf").groupBy("column_name", "load_key").agg(F.count(F.lit(1)).alias("inf_distinct"))
    step = Window.partitionBy("column_name").orderBy("load_key")  # one row per load
    texts = F.col("min_text").isNotNull()
    shown = lambda c: F.substring_index(c, "\u0000", 1)
    return (
        base.join(wide, ["column_name", "load_key"], "left")
        .join(infinite_kinds, ["column_name", "load_key"], "left")
        .join(shapes, ["column_name", "load_key"], "left")
        .select(
            "column_name", "load_key", "rows", "nulls", "nans", "infinite",
            (F.coalesce("finite_distinct", F.lit(0)) + F.coalesce("inf_distinct", F.lit(0))).alias("distinct_values"),
            F.coalesce("top_rows", F.lit(0)).alias("top_rows"), "min_value", "max_value", "violations",
            *[F.when(~texts, F.col(f"q{round(q * 100)}")).alias(f"q{round(q * 100)}") for q in quantiles], "ks_distance",
            F.lag("load_key").over(step).alias("previous_load"),
            shown("min_text").alias("min_text"), shown("max_text").alias("max_text"), F.when(texts, shown("median_text")).alias("median_text"), "blanks", "min_length", "max_length",
            F.coalesce("patterns", F.lit(0)).alias("patterns"), F.col("top.pattern").alias("top_pattern"), F.coalesce("top.n", F.lit(0)).alias("top_pattern_rows"), "pattern_violations",
        )
    )


#: The columns of a profile of numbers.
NUMBER_PROFILE = ["column_name", "load_key", "rows", "nulls", "nans", "infinite", "distinct_values", "top_rows", "min_value", "max_value", "violations", "q25", "q50", "q75", "ks_distance", "previous_load"]
