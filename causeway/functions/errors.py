"""The errors that rows bear, as one table: which part of the library tells of each, and what a row with it is still good for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, what it is found in, whether the row's other fields can be read.
ERRORS = (
    ("MissingHeader", "report", False),
    ("InvalidFingerprint", "report", False),
    ("IncompletePayload", "report", True),
    ("MissingBytes", "snapshot", False),
    ("InvalidProbeId", "id", True),
    ("InvalidEventId", "id", True),
    ("InvalidWallClockTime", "time", True),
    ("InvalidNextEpoch", "restart", True),
)


def table(spark: SparkSession) -> DataFrame:
    """(error, found_in, readable)"""
    return spark.createDataFrame(list(ERRORS), "error string, found_in string, readable boolean")


def readable(error: Column) -> Column:
    """A row with this error, or with none, still has fields to read; an unknown error has not."""
    return error.isNull() | error.isin(*(name for name, _, fine in ERRORS if fine))


def summary(rows: DataFrame) -> DataFrame:
    """(found_in, error, readable, n) of rows with an error; errors that no table knows are of null."""
    counted = rows.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(table(rows.sparkSession)), "error", "left").select("found_in", "error", "readable", "n")
