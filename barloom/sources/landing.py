"""Raw vendor files as they land: JSON lines, CSV and Parquet, read with a given schema and in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers' options.
OPTIONS = {"json": {"mode": "FAILFAST"}, "csv": {"mode": "FAILFAST", "header": "true", "enforceSchema": "false"}, "parquet": {}}


def read_landed(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of all files below path, with ingest_seq: a struct that orders rows by when their file was written, its path and their place in it.

    kind: json (an object a line), csv (with a header) or parquet. A row that doesn't fit the schema is an error.
    """
    if kind not in OPTIONS:
        raise ValueError(f"unknown kind of file {kind!r}")
    rows = spark.read.schema(schema).options(**OPTIONS[kind]).format(kind).load(path)
    place = {"written": "file_modification_time", "file": "file_path", "block": "file_block_start"}
    # A task reads a block's rows in order, so the running number follows their places.
    return rows.withColumn("ingest_seq", F.struct(*[F.col(f"_metadata.{c}").alias(n) for n, c in place.items()], F.monotonically_increasing_id().alias("row")))
