"""Getting raw documents and laying them out as ``extract_date=/cik=`` folders.

The client takes the function that performs a request, so it works with any transport (and in
tests without one).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import file_system
from ledgerlake.sources.tables import file_metadata

RETRIED = frozenset({429, 500, 502, 503, 504})


def pad_cik(cik: int | str) -> str:
    return str(int(cik)).zfill(10)


def fetch_documents(ciks: list[int | str], get: Callable[[str], tuple[int, bytes]], url: str, interval: float = 0.12, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, bytes]]:
    """(padded cik, valid JSON bytes) of each company; waits between requests, retries with
    doubled waits on busy or failing servers, and raises on anything else."""
    for n, cik in enumerate(ciks):
        if n:
            sleep(interval)
        for attempt in range(retries + 1):
            status, body = get(url.format(cik=pad_cik(cik)))
            if status == 200:
                json.loads(body)
                yield pad_cik(cik), body
                break
            if status not in RETRIED or attempt == retries:
                raise OSError(f"status {status} for {pad_cik(cik)}")
            sleep(2.0**attempt)


def write_document(spark: SparkSession, root: str, extract_date: str, cik: int | str, body: bytes, dry_run: bool = False) -> str:
    """Write one document to its folder on any Hadoop file system (a later one of the day replaces it).

    Returns its SHA-256, which is kept beside the document in a file that scans pass over. With
    ``dry_run`` nothing is written.
    """
    digest = hashlib.sha256(body).hexdigest()
    if dry_run:
        return digest
    folder = f"{root}/extract_date={extract_date}/cik={pad_cik(cik)}"
    fs, path = file_system(spark, folder)
    for name, data in (("companyfacts.json", body), ("_companyfacts.sha256", digest.encode())):
        draft, final = path(f"{folder}/_{name}.tmp"), path(f"{folder}/{name}")
        out = fs.create(draft, True)
        out.write(bytearray(data))
        out.close()
        if fs.exists(final):
            fs.delete(final, False)
        fs.rename(draft, final)
    return digest


def write_documents(df: DataFrame, root: str) -> None:
    """Many documents at once: extract_date, cik, json_text, one row a folder."""
    df.select("extract_date", "cik", "json_text").repartition("extract_date", "cik").write.option("lineSep", "\n").partitionBy("extract_date", "cik").text(root)


def write_forecasts(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Forecasts partitioned by concept and date, one file a partition; returns the partitions (with ``dry_run`` only that)."""
    parts = ["canonical_concept", "as_of_date"]
    n = df.select(*parts).distinct().count()
    if not dry_run:
        df.repartition(*parts).write.mode("overwrite").option("compression", "snappy").partitionBy(*parts).parquet(path)
    return n


def bronze_checks(spark, path: str, expected: int) -> DataFrame:
    """Count, companies, dates, empty files, and equal contents under different companies."""
    files = file_metadata(spark, path)
    shared = files.groupBy("content_sha256").agg(F.count_distinct("cik").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("shared"))
    one = files.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cik").alias("ciks"), F.count_if(F.try_to_date("extract_date").isNull()).alias("bad_dates"), F.count_if(F.col("size_bytes") <= 0).alias("empty")
    ).crossJoin(F.broadcast(shared))  # one row each
    checks = [("1_file_count", expected, "n"), ("2_distinct_cik", expected, "ciks"), ("3_dates_valid", 0, "bad_dates"), ("4_size_positive", 0, "empty"), ("5_no_shared_content", 0, "shared")]
    items = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(str(e)).alias("expected"), F.col(c).cast("string").alias("actual")) for n, e, c in checks])
    return one.select(F.explode(items).alias("c")).select("c.*").withColumn("result", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("FAIL"))
