"""Versions of changing attributes with the period each one was valid.

Method (affected-chain rebuild): the store keeps the raw changes and the version chains in hash
buckets of entities. An update, late, corrected or in order, reads the raw changes of the touched
buckets only, rebuilds all intervals of the touched entities, and writes new files for those buckets;
a manifest of the files of every bucket becomes current by one atomic rename.

Corrections: a raw change may carry a delivery number. Of the rows of an entity at one instant
only those of the last delivery count. Rows without one belong to delivery 0, and several different
values of one instant and delivery are all versions (all but the last of no length).

Scale: a bucket holds about ``BUCKET_ROWS`` rows when the store is made, so an update costs what it
touches, however large the store. An entity with more than ``HOT_ROWS`` and a hundred-thousandth
of all rows is range-partitioned by time: its slices are even, and only one row a slice meets
in one task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut, file_system, scratch

#: Rows of a bucket of a new store; more buckets than MOST_BUCKETS are not made.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 200_000
#: Rows of an entity that one task takes at least before it counts as hot.
HOT_ROWS = 200_000
#: Hot entities are fewer than this, whatever the rows: about 5 MB collected and broadcast.
MOST_HOT = 100_000
#: A bucket's raw parts are merged into one when an update finds so many.
MERGE_AT = 16

FROM_TO = ("valid_from_us", "valid_to_us")


def raw_changes(df: DataFrame, key: Column, time_us: Column, value: Column, compared: Column, delivery: Column | None = None) -> DataFrame:
    """Raw rows in the store's form: k, us, value, same, delivery; rows with a NULL in k, us or value are left out."""
    number = F.lit(0) if delivery is None else F.coalesce(delivery, F.lit(0))
    return df.select(key.alias("k"), time_us.alias("us"), value.alias("value"), compared.alias("same"), number.cast("long").alias("delivery")).where("k IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL")


def _few(raw: DataFrame) -> DataFrame:
    """Chains of entities that fit a task each: one exchange by entity serves both windows."""
    now = Window.partitionBy("k").orderBy("us").rangeBetween(0, 0)
    order = Window.partitionBy("k").orderBy("us", "same", "value")
    last = raw.withColumn("last_", F.max("delivery").over(now)).where("delivery = last_")
    starts = last.withColumn("before_", F.lag("same").over(order)).where("before_ IS NULL OR before_ <> same")
    return starts.select("k", "value", "same", F.col("us").alias("valid_from_us"), F.lead("us").over(order).alias("valid_to_us"))


def _hot(raw: DataFrame, rows: int, slice_rows: int) -> DataFrame:
    """Chains of hot entities by even slices of time; one row a slice crosses from slice to slice."""
    once = raw.groupBy("k", "us", "delivery", "same").agg(F.min("value").alias("value"))
    last = once.withColumn("last_", F.max("delivery").over(Window.partitionBy("k", "us"))).where("delivery = last_").select("k", "us", "same", "value")
    n = max(2, -(-rows // slice_rows))
    sliced = cut(last.repartitionByRange(n, "k", "us", "same").withColumn("slice", F.spark_partition_id()))
    inside, slices = Window.partitionBy("k", "slice").orderBy("us", "same"), Window.partitionBy("k").orderBy("slice")
    ends = sliced.groupBy("k", "slice").agg(F.max(F.struct("us", "same")).alias("end_"))
    ahead = ends.select("k", "slice", F.lag("end_.same").over(slices).alias("prior_"))  # one row a slice and entity
    starts = sliced.withColumn("before_", F.lag("same").over(inside)).join(F.broadcast(ahead), ["k", "slice"])
    starts = cut(starts.withColumn("before_", F.coalesce("before_", "prior_")).where("before_ IS NULL OR before_ <> same").drop("before_", "prior_"))
    firsts = starts.groupBy("k", "slice").agg(F.min("us").alias("first_"))
    after = firsts.select("k", "slice", F.min("first_").over(slices.rowsBetween(1, Window.unboundedFollowing)).alias("next_"))  # the same
    upto = F.coalesce(F.lead("us").over(inside), F.col("next_"))
    return starts.join(F.broadcast(after), ["k", "slice"]).select("k", "value", "same", F.col("us").alias("valid_from_us"), upto.alias("valid_to_us"))


def build_history(raw: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Version chains of raw changes: k, value, same, valid_from_us, valid_to_us (NULL: still valid).

    The value of a version is the least of its first instant. Repeated rows change nothing; an empty
    table gives no rows.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    total = raw.count()
    least = max(hot_rows, total // MOST_HOT)
    hot = raw.groupBy("k").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > least).collect() if total > least else []  # fewer than MOST_HOT rows
    if not hot:
        return _few(raw)
    keys = F.broadcast(raw.sparkSession.createDataFrame([(r.k,) for r in hot], raw.select("k").schema))
    return _few(raw.join(keys, "k", "left_anti")).unionByName(_hot(raw.join(keys, "k", "left_semi"), sum(r.n_ for r in hot), hot_rows))


class HistoryStore:
    """Version chains in a shared folder, changed bucket by bucket.

    The manifest ``CURRENT`` names the generation that holds each bucket's chains and the generations
    that hold its raw rows. Readers that opened a state keep it; a writer that dies before the rename
    changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or scratch(spark, "history")

    def manifest(self) -> dict | None:
        fs, path = file_system(self.spark, self.path)
        if not fs.exists(path(f"{self.path}/CURRENT")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def state(self) -> str | None:
        """Name of the current state."""
        m = self.manifest()
        return m and m["state"]

    def _publish(self, manifest: dict) -> None:
        fs, path = file_system(self.spark, self.path)
        draft, final = path(f"{self.path}/_{manifest['state']}.tmp"), path(f"{self.path}/CURRENT")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = getattr(options.Options, "Rename")
        context = options.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        context.rename(draft, final, overwrite)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chains(self) -> DataFrame:
        m = self.manifest()
        return self._read([f"{self.path}/{g}/chains/bucket={b}" for b, g in m["chains"].items()], m["chain_schema"])

    def raw(self) -> DataFrame:
        m = self.manifest()
        return self._read(self._raw_paths(m, m["raw"]), m["raw_schema"])

    def _raw_paths(self, m: dict, buckets) -> list[str]:
        return [f"{self.path}/{g}/raw/bucket={b}" for b in buckets for g in m["raw"].get(b, [])]

    def _write(self, df: DataFrame, to: str, buckets: int) -> list[str]:
        """Write rows by bucket of their entity; the buckets written."""
        bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
        df.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(to)
        fs, path = file_system(self.spark, to)
        return [s.getPath().getName()[7:] for s in fs.listStatus(path(to)) if s.getPath().getName().startswith("bucket=")]

    def apply(self, updates: DataFrame) -> HistoryStore:
        """Merge raw changes (first call: the initial load) and publish the new state."""
        m, new = self.manifest(), uuid.uuid4().hex
        at = f"{self.path}/{new}"
        if m is None:
            size = updates.count()
            kinds = {f.name: f.dataType.simpleString() for f in updates.schema.fields}
            m = {"buckets": int(min(MOST_BUCKETS, max(1, -(-size // self.bucket_rows)))), "raw": {}, "chains": {}, "raw_schema": ", ".join(f"`{c}` {t}" for c, t in kinds.items())}
            m["chain_schema"] = f"k {kinds['k']}, value {kinds['value']}, same {kinds['same']}, valid_from_us long, valid_to_us long"
        touched = self._write(updates, f"{at}/raw", m["buckets"])
        late = self._read([f"{at}/raw/bucket={b}" for b in touched], m["raw_schema"])
        known = [b for b in touched if m["raw"].get(b)]
        if known:
            keys = late.select("k").distinct()
            old = self._read(self._raw_paths(m, known), m["raw_schema"])
            built = build_history(old.join(keys, "k", "left_semi").unionByName(late))
            rest = self._read([f"{self.path}/{m['chains'][b]}/chains/bucket={b}" for b in known if b in m["chains"]], m["chain_schema"])
            built = built.unionByName(rest.join(keys, "k", "left_anti"))
            full = [b for b in known if len(m["raw"][b]) >= MERGE_AT]
        else:
            built, full = build_history(late), []
        written = self._write(built, f"{at}/chains", m["buckets"]) if touched else []
        for b in touched:
            m["raw"].setdefault(b, []).append(new)
        if full:
            merged = uuid.uuid4().hex
            for b in self._write(self._read(self._raw_paths(m, full), m["raw_schema"]), f"{self.path}/{merged}/raw", m["buckets"]):
                m["raw"][b] = [merged]
        m["chains"].update((b, new) for b in written)
        self._publish(m | {"state": new})
        return self

    def vacuum(self) -> int:
        """Remove what no bucket of the current state names; returns how many folders and files. No reader may hold an old state."""
        fs, path = file_system(self.spark, self.path)
        m = self.manifest() or {"raw": {}, "chains": {}}
        kept = {f"{g}/raw/bucket={b}" for b, gs in m["raw"].items() for g in gs} | {f"{g}/chains/bucket={b}" for b, g in m["chains"].items()}
        live = {k.split("/")[0] for k in kept}
        removed = 0
        for top in fs.listStatus(path(self.path)) if fs.exists(path(self.path)) else []:
            name = top.getPath().getName()
            if name in live:
                for kind in ("raw", "chains"):
                    under = path(f"{self.path}/{name}/{kind}")
                    for part in fs.listStatus(under) if fs.exists(under) else []:
                        if f"{name}/{kind}/{part.getPath().getName()}" not in kept:
                            removed += int(part.isDirectory())
                            fs.delete(part.getPath(), True)
            elif name != "CURRENT":
                removed += 1
                fs.delete(top.getPath(), True)
        return removed
