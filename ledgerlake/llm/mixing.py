"""Mixing sources to target weights.

Method (hierarchical budgeting): leaves hang below domain and language in a tree; the total is
handed down by weight. A leaf takes at most its tokens times the allowed repeats; what it
cannot take goes to its siblings first and only what they cannot take goes up to the ancestors.
Each leaf then takes whole epochs of its records and, of one more epoch in an order seeded anew,
the prefix that fills its budget. A prefix ends with a whole record; what a leaf leaves or takes too
much is carried to the next leaf of its source, so a source misses its budget by half a record at most.

Scale: tokens are counted once and kept as numbers. The tree has one row per leaf, at most
``LEAF_LIMIT``, broadcast and collected. The prefix is found from token sums over 65,536 ranges of
the order per leaf; only the range in which the budget ends is ordered record by record. Records are
never shuffled but for that range.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE_BITS = 16
LEAF_LIMIT = 100_000


@lru_cache(maxsize=4)
def encoding(vocabulary: bytes):
    """Encoder of a byte-level vocabulary file's contents."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; NULL text has none. The vocabulary is read where the driver runs and handed to the workers."""
    with open(path, "rb") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())  # a file of one or two MB

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(shared.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return count(text)


@dataclass
class Node:
    """A node of the budget tree; a leaf has a capacity, an inner node its children's."""

    name: tuple
    weight: float
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def close(self) -> Node:
        if self.children:
            self.weight = sum(c.close().weight for c in self.children)
            self.capacity = sum(c.capacity for c in self.children)
        return self

    def spend(self, amount: float) -> None:
        """Hand ``amount`` down by weight; what a child cannot take goes to its siblings."""
        self.budget = min(amount, self.capacity)
        if not self.children:
            return
        open_, left = [c for c in self.children if c.capacity > 0 and c.weight > 0], self.budget
        given = {id(c): 0.0 for c in self.children}
        while open_ and left > 1e-9:
            weight = sum(c.weight for c in open_)
            full = {id(c): c.capacity for c in open_ if left * c.weight / weight >= c.capacity}
            if not full:
                given.update((id(c), left * c.weight / weight) for c in open_)
                break
            given.update(full)
            left -= sum(full.values())
            open_ = [c for c in open_ if id(c) not in full]
        for c in self.children:
            c.spend(given[id(c)])


def plan_budgets(leaves: list[tuple[tuple, float, int, int]], total: int | None) -> dict[tuple, int]:
    """Token budget of each leaf: (path, weight, tokens, most repeats) -> budget.

    ``total`` None takes the largest total at which every leaf that has tokens still meets its
    share, so nothing is short but leaves without any tokens.
    """
    root = Node((), 0.0)
    at: dict[tuple, Node] = {(): root}
    for path, weight, tokens, repeats in sorted(leaves, key=lambda x: repr(x[0])):
        for k in range(1, len(path) + 1):
            if path[:k] not in at:
                at[path[:k]] = Node(path[:k], 0.0)
                at[path[: k - 1]].children.append(at[path[:k]])
        at[path].weight, at[path].capacity = weight, float(tokens) * max(0, repeats)
    root.close()
    if total is None:
        # The most that can be spent with no leaf filled before its share is reached.
        low, high = 0.0, root.capacity
        live = [p for p, _, _, _ in leaves if at[p].capacity > 0 and at[p].weight > 0]
        for _ in range(60):
            mid = (low + high) / 2
            root.spend(mid)
            if all(at[p].budget < at[p].capacity * (1 - 1e-12) for p in live):
                low = mid
            else:
                high = mid
        total = int(low)
    root.spend(float(total))
    return {p: int(at[p].budget) for p, _, _, _ in leaves}


def carried(budgets: list[tuple[str, int, int, int]]) -> list[bool]:
    """Whether each leaf takes one more record than fits: (source, rest, taken, next record's tokens) in order of leaves.

    What a leaf leaves open is carried to the source's next leaf; one more record is taken as soon as
    that comes nearer to what is owed.
    """
    owed: dict[str, int] = {}
    out = []
    for source, rest, taken, next_ in budgets:
        owed[source] = owed.get(source, 0) + rest - taken
        more = next_ > 0 and 2 * owed[source] > next_
        owed[source] -= next_ if more else 0
        out.append(more)
    return out


def mix(records: DataFrame, record_id: str, path: list[str], tokens: str, targets: DataFrame, share_of: str, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draw records so that sources meet their target shares of the tokens.

    ``records``: a unique id, the columns of ``path`` (from the root down, ``share_of`` among them)
    and a token count; ``targets``: share_of, target_share, max_repeats. A source's weight is split
    over its leaves by their tokens. Result: the drawn records (id, path, tokens, copies >= 1) and
    one row per target with planned and actual shares.

    ``total`` is the size of the result in tokens: a leaf too small for its share gives what it has,
    max_repeats times, and the rest comes from its siblings, then from its ancestors' other children.
    Without it the largest total is taken at which nothing is short.

    Sources without a target, and records without tokens or source, are never drawn; targets
    without records get nothing and their share goes to siblings, then up the tree. No record is
    taken more than ``max_repeats`` times. Of repeated targets the greatest share counts. Ties in
    the seeded order are settled by id. Empty inputs give empty results.
    """
    spark = records.sparkSession
    rows = cut(
        records.select(F.col(record_id).alias("record_id"), *[F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in path], F.col(tokens).cast("long").alias("n_tokens")).where("n_tokens > 0")
    )
    goals = targets.where(F.col(share_of).isNotNull()).select(share_of, "target_share", "max_repeats").limit(LEAF_LIMIT + 1).collect()
    if len(goals) > LEAF_LIMIT:
        raise ValueError(f"more than {LEAF_LIMIT} targets")
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in sorted(goals, key=lambda r: (r[1] or 0, r[2] or 0))}
    names = spark.createDataFrame([(s,) for s in wanted], f"`{share_of}` string")
    found = rows.groupBy(*path).agg(F.sum("n_tokens").alias("t")).join(F.broadcast(names), share_of, "left_semi")  # LEAF_LIMIT rows at most
    sizes = sorted(found.limit(LEAF_LIMIT + 1).collect(), key=lambda r: tuple(r[p] for p in path))
    if len(sizes) > LEAF_LIMIT:
        raise ValueError(f"more than {LEAF_LIMIT} leaves; use a coarser path")
    of_source: dict[str, int] = {}
    for r in sizes:
        of_source[r[share_of]] = of_source.get(r[share_of], 0) + r.t
    leaves = [(tuple(r[p] for p in path), wanted[r[share_of]][0] * r.t / of_source[r[share_of]], r.t, wanted[r[share_of]][1]) for r in sizes]
    budgets = plan_budgets(leaves, total)
    plan = []
    for no, (p, _, t, most) in enumerate(leaves):
        epochs = min(budgets[p] // t, most)
        plan.append((*p, no, epochs, budgets[p] - epochs * t if epochs < most else 0))
    of_leaf = spark.createDataFrame(plan, ", ".join(f"`{p}` string" for p in path) + ", leaf int, epochs long, rest long")
    h = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("record_id"))
    ranged = rows.join(F.broadcast(of_leaf), path).withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    sums = ranged.where("rest > 0").groupBy("leaf", "range", "rest").agg(F.sum("n_tokens").alias("s"))
    upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows a leaf
    ends = cut(sums.withColumn("before", F.coalesce(F.sum("s").over(upto), F.lit(0))).where("before <= rest AND before + s > rest").select("leaf", F.col("range").alias("end_range"), "before"))
    # The records of the range in which a leaf's budget ends, and the last one that fits and the next.
    inside = ranged.join(F.broadcast(ends), "leaf").where("range = end_range")  # one row a leaf
    run = Window.partitionBy("leaf").orderBy("h", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("h", "record_id")
    fits = F.col("cum") <= F.col("rest")
    edges = inside.withColumn("cum", F.col("before") + F.sum("n_tokens").over(run)).groupBy("leaf").agg(
        F.coalesce(F.max(F.when(fits, F.col("cum"))), F.min("before")).alias("taken"), F.max(F.when(fits, place)).alias("last"), F.min(F.when(~fits, F.struct("h", "record_id", "n_tokens"))).alias("next")
    ).orderBy("leaf").collect()  # one row a leaf
    more = carried([(leaves[e.leaf][0][path.index(share_of)], plan[e.leaf][-1], e.taken, e.next.n_tokens if e.next else 0) for e in edges])
    last = [(e.leaf, (e.next.h, e.next.record_id) if m else e["last"] and tuple(e["last"])) for e, m in zip(edges, more, strict=True)]
    kind = rows.schema["record_id"].dataType.simpleString()
    cuts = ends.join(spark.createDataFrame(last, f"leaf int, last struct<h: bigint, record_id: {kind}>"), "leaf")
    marked = ranged.join(F.broadcast(cuts), "leaf", "left")  # one row a leaf
    within = (F.col("range") < F.col("end_range")) | ((F.col("range") == F.col("end_range")) & F.col("last").isNotNull() & (place <= F.col("last")))
    extra = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("end_range").isNull(), F.lit(1)).otherwise(F.coalesce(within, F.lit(False)).cast("int"))
    drawn = marked.withColumn("copies", F.col("epochs") + extra).where("copies > 0").select(F.col("record_id").alias(record_id), *path, "n_tokens", "copies")
    planned: dict[str, int] = {}
    for p, _, _, _ in leaves:
        s = p[path.index(share_of)]
        planned[s] = planned.get(s, 0) + budgets[p]
    goal = spark.createDataFrame([(s, w, reps, planned.get(s, 0)) for s, (w, reps) in wanted.items()], f"`{share_of}` string, target_share double, max_repeats int, planned_tokens long")
    got = drawn.groupBy(share_of).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").cast("int").alias("most_copies"))
    all_ = Window.partitionBy(F.lit(1))  # one row per target
    report = (
        goal.join(got, share_of, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "records", "most_copies")})
        .withColumn("planned_share", F.try_divide(F.col("planned_tokens"), F.sum("planned_tokens").over(all_)))
        .withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(all_)))
    )
    return drawn, report
