"""Sinks: submission CSV, prediction tables, JSON reports, and a content
fingerprint of a table."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import stable_hash


def write_submission(sub: DataFrame, path: str, single_file: bool = False) -> None:
    """A3: ``id,target`` CSV with a header, in files of ascending id ranges.
    ``single_file`` sends all rows through one task, for small submissions only."""
    out = sub.select(S.ID, S.TARGET).orderBy(S.ID)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A4/A5: prediction or out-of-fold tables."""
    df.write.mode("overwrite").format(fmt).save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small JSON report (one row)."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "report string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    """Read back a report written by :func:`write_report`."""
    row = spark.read.text(path).first()
    return json.loads(row[0]) if row is not None else {}


def money_canonical_columns() -> list:
    """Canonical string form of a transaction row: amounts in integer cents."""
    cents = lambda c: F.round(F.col(c) * 100.0).cast("long")
    return [F.col(S.ID), F.col(S.PERIOD), F.col(S.OPERATION), F.col(S.ORIGIN), F.col(S.DEST),
            cents(S.AMOUNT), cents(S.OB_BEFORE), cents(S.OB_AFTER), cents(S.DB_BEFORE), cents(S.DB_AFTER),
            F.col(S.LABEL)]


def table_fingerprint(df: DataFrame, cols: list[Column]) -> DataFrame:
    """Order- and partition-insensitive fingerprint ``(rows, fingerprint)``:
    the sum over rows of a 32-bit md5 prefix of the row's canonical string."""
    row_str = F.concat_ws("|", *[c.cast("string") for c in cols])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(stable_hash(row_str)).cast("long").alias("fingerprint"))
