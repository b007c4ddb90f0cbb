"""Reading headerless 32-bit and 64-bit files, NumPy files, result sheets and metrics in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranged

#: The columns of a result sheet.
SHEET = (
    "input string, error_bound double, mode int, compression_ratio double, preprocessing_GBps double, compression_GBps double, encoding_GBps double, "
    "decompression_GBps double, postprocessing_GBps double, decoding_GBps double, abs_eb double, used_eb double, eb_violations bigint, mass_i double, energy_i double"
)


def find_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of files below a folder whose names match, in order of path. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length").orderBy("path")


def read_raw(spark: SparkSession, path: str, bits: int = 32, pattern: str | None = None) -> DataFrame:
    """Fields (field_id, i, x) from files of little-endian floats, read by ranges of bytes (``ranged``); x has 32 bits. A
    file whose size does not fit raises."""
    return _narrow(ranged.scan(spark, path, "raw", f"<f{bits // 8}", pattern))


def read_npy(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Fields from .npy files of floats, flattened in C order, read by ranges of bytes; x has 32 bits."""
    return _narrow(ranged.scan(spark, path, "npy", pattern=pattern))


def _narrow(field: DataFrame) -> DataFrame:
    return field.withColumn("x", F.col("x").cast("float"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SHEET)


def write_sheet(rows: DataFrame, path: str) -> None:
    """Writes a result table as CSV with a header; result tables are small, so it is one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def metric(text: Column, label: str) -> Column:
    """The number after a label in a line of output; null where there is none. Exponents are read as well."""
    found = F.regexp_extract(text, label + r"\D*?([+-]?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(found != "", found).cast("double")


def scrape(lines: DataFrame, text: str, labels: dict[str, str]) -> DataFrame:
    return lines.withColumns({name: metric(F.col(text), label) for name, label in labels.items()})
