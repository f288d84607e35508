"""Structured Streaming ingest (an extension; the batch semantics are the same functions).

New documents are picked up as files; each micro-batch goes through the same parser and loaders as
a batch run. Appends are source-filtered, so a micro-batch that is replayed after a failure
changes nothing.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions import text as X
from ledgerlake.functions.hashing import key_hash
from ledgerlake.operators.nested import flatten_documents
from ledgerlake.operators.vault import load_hub, load_link, load_satellite

RAW_SCHEMA = "json_text string, extract_date string, cik string"


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def load_batch(batch: DataFrame, target: str, load_ts: datetime) -> None:
    """Append what a batch of raw documents brings to the hub, link and satellite of filings."""
    spark = batch.sparkSession
    entries = flatten_documents(batch, "entries", cik=X.ten_digits("cik")).where("accn IS NOT NULL AND taxonomy = 'us-gaap'")
    rows = entries.select("cik", F.col("accn").alias("accession_number"), F.col("form").alias("form_type"), F.col("filed").try_cast("date").alias("filed_date")).distinct().persist()
    source = "sec_edgar.companyfacts"
    try:
        parts = {
            "hub_filing": lambda old: load_hub(rows, old, "accession_number", "hub_filing_hk", load_ts, source),
            "link_company_filing": lambda old: load_link(rows, old, ["cik", "accession_number"], "link_company_filing_hk", {"hub_company_hk": "cik", "hub_filing_hk": "accession_number"}, load_ts, source),
            "sat_filing_metadata": lambda old: load_satellite(rows.withColumn("hub_filing_hk", key_hash("accession_number")), old, "hub_filing_hk", ["form_type", "filed_date"], "sat_filing_metadata_hk", load_ts, source),
        }
        for name, load in parts.items():
            load(_existing(spark, f"{target}/{name}")).write.mode("append").parquet(f"{target}/{name}")
    finally:
        rows.unpersist()


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, load_ts: datetime | None = None) -> StreamingQuery:
    """Follow a folder of raw-document Parquet files and load every file once."""
    stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 16).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, _: load_batch(df, target, load_ts or datetime.now(UTC)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
