"""What changed between consecutive full snapshots.

Method: every snapshot is unpivoted into cells (key, field, value) plus a presence marker. A cell's
sign in a pair of consecutive snapshots is +1 where only the later one holds it and -1 where only
the earlier one does; the sum over both is what remains. Nonzero sums classify the key (marker +1
added, -1 removed, no marker but cells of both signs changed) and name the changed fields.

Scale: a cell is shuffled once, with the signs of 32 consecutive pairs as the bits of one number, which
are or-ed before and after the shuffle (repeated rows and hot keys collapse before it). A cell that
stays is gone before any other step; later shuffles carry differences only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut

_MARK = "\u0000present"


def snapshot_changes(df: DataFrame, key: Column, date: Column, fields: dict[str, Column], null_transitions: bool = False) -> DataFrame:
    """Added, removed and changed keys of each pair of consecutive snapshot dates.

    ``key``, ``date`` and ``fields`` are expressions already normalised (equal means the same).
    Result: snapshot_key, from_date, to_date, change, changed_fields (sorted array; empty unless
    changed), one row per changed key and pair.

    Rows with a NULL key or date belong to no snapshot and are left out. Repeated rows count
    once. If a key stands several times in a snapshot with different values it is changed when
    a value was lost and another won. With ``null_transitions=False`` NULL is "unknown": a field
    that is NULL on either side is unchanged; with True NULL is a value of its own. Fewer than two
    dates give an empty result.
    """
    names = list(fields)
    rows = df.select(
        key.alias("k"),
        date.alias("d"),
        F.array(
            F.struct(F.lit(_MARK).alias("field"), F.lit("").alias("value")),
            *[F.struct(F.lit(f).alias("field"), (F.concat_ws("", F.when(fields[f].isNull(), F.lit("\u0000null")), fields[f].cast("string")) if null_transitions else fields[f].cast("string")).alias("value")) for f in names],
        ).alias("cells"),
    ).where(F.col("k").isNotNull() & F.col("d").isNotNull())
    order = Window.orderBy("d")  # one row per snapshot date, a few thousand at most
    # A date is the later one of the pair before it and the earlier one of its own: bits below and above 32 of the pair's word.
    at, bit = F.col("at"), lambda n: F.expr(f"shiftleft(1L, {n})")
    word = F.floor(at / 32).cast("int")
    split = F.array(F.struct((word - 1).alias("word"), bit("31").alias("bits")), F.struct(word.alias("word"), bit("32").alias("bits")))
    one = F.array(F.struct(word.alias("word"), F.when(at > 0, bit("at % 32 - 1")).otherwise(F.lit(0).cast("long")).bitwiseOR(bit("32 + at % 32")).alias("bits")))
    numbered = rows.select("d").distinct().select("d", (F.row_number().over(order) - 1).alias("at"), F.lead("d").over(order).alias("after"))
    dates = cut(numbered.withColumn("words", F.when((at > 0) & (at % 32 == 0), split).otherwise(one)))
    cells = (
        rows.join(F.broadcast(dates.select("d", "words")), "d")
        .select("k", "cells", F.explode("words").alias("w"))
        .select("k", "w.word", "w.bits", F.explode("cells").alias("c"))
        .where(F.col("c.value").isNotNull())
        .groupBy("k", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    low = F.lit((1 << 32) - 1)
    later, earlier = F.col("bits").bitwiseAND(low), F.shiftrightunsigned("bits", 32)
    has = lambda c, i: F.getbit(F.col(c), i) == 1
    signs = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: has("differ", i)),
        lambda i: F.struct((F.col("word") * 32 + i).alias("at"), F.when(has("later", i), 1).otherwise(-1).alias("sum")),
    )
    pairs = dates.where("after IS NOT NULL").select("at", F.col("d").alias("from_date"), F.col("after").alias("to_date"))
    nonzero = (
        cells.select("k", "field", "word", later.alias("later"), later.bitwiseXOR(earlier).alias("differ"))
        .where("differ <> 0")
        .select("k", "field", F.explode(signs).alias("x"))
        .select("k", "field", "x.at", "x.sum")
        .join(F.broadcast(pairs), "at")  # the last date has no pair of its own
    )
    per_field = nonzero.groupBy("k", "from_date", "to_date", "field").agg(F.max("sum").alias("won"), F.min("sum").alias("lost"))
    both = (F.col("won") > 0) & (F.col("lost") < 0)
    return (
        per_field.groupBy("k", "from_date", "to_date")
        .agg(
            F.max(F.when(F.col("field") == _MARK, F.when(F.col("won") > 0, "added").otherwise("removed"))).alias("marker"),
            F.sort_array(F.collect_set(F.when((F.col("field") != _MARK) & both, F.col("field")))).alias("fields"),
        )
        .where(F.col("marker").isNotNull() | (F.size("fields") > 0))
        .select(
            F.col("k").alias("snapshot_key"),
            "from_date",
            "to_date",
            F.coalesce("marker", F.lit("changed")).alias("change"),
            F.when(F.col("marker").isNull(), F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )
