"""Readers of the Parquet tables and of raw documents, seeds and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlake.session import file_system


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table; filters and column choices made later reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents below ``extract_date=/cik=`` folders, one row per file; folder names stay
    text (``0000000001``, not 1) whatever the session infers."""
    fs, make = file_system(spark, path)
    if fs.exists(make(path)) and all(f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(make(path))):  # nothing was written
        return spark.createDataFrame([], "json_text string, extract_date string, cik string")
    return spark.read.schema("value string, extract_date string, cik string").text(path, wholetext=True).withColumnRenamed("value", "json_text")


def read_cover(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed cover fields of the documents, one a file or with ``lines`` one a line; a malformed document is an error."""
    schema = T.StructType([T.StructField("cik", T.StringType()), T.StructField("entityName", T.StringType())])
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not lines).json(path)
    return df.withColumnRenamed("entityName", "entityname")


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with a pinned schema; quoted commas are part of the value."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')


def read_forecasts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Partitioned forecast files; partition columns stay text as declared in ``schema``."""
    return spark.read.schema(schema).parquet(path)


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and content hash of every file, with the partition values in its path."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("content_sha256"),
        F.regexp_extract("path", r"extract_date=([^/]+)", 1).alias("extract_date"),
        F.regexp_extract("path", r"cik=([^/]+)", 1).alias("cik"),
    )
