"""Delimited files into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", null: str = "NULL", times: tuple[str, ...] = ()) -> DataFrame:
    """Columns by position; an empty field, and one that equals the null literal, is null.

    times: columns that hold hours:minutes:seconds, which become seconds of the day.

    A field that its type can't hold is an error when the row is read, not a silent null.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = spark.read.csv(path, schema=text, sep=separator, header=False, nullValue=null, emptyValue="", quote='"', escape='"', mode="FAILFAST")
    typed = []
    for f in schema:
        value = F.when((F.col(f"`{f.name}`") == "") | (F.col(f"`{f.name}`") == null), None).otherwise(F.col(f"`{f.name}`"))
        if f.name in times:
            h, m, sec = (F.split(value, ":")[i].cast("int") for i in range(3))
            value = h * 3600 + m * 60 + sec
        typed.append(value.cast(f.dataType).alias(f.name))
    return df.select(*typed)
