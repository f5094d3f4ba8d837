"""Column types by their DDL names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "numeric": T.DoubleType(),
    "text": T.StringType(),
    "string": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "character": T.StringType(),
    "character varying": T.StringType(),
    "stringcode": T.StringType(),
    "string_code": T.StringType(),
    "date": T.DateType(),
    "time": T.IntegerType(),  # seconds of the day
    "timestamp": T.TimestampType(),
}


class UnknownType(ValueError):
    pass


def parse(name: str) -> T.DataType:
    """The Spark type of a DDL type; a length in brackets is read and ignored."""
    plain = re.sub(r"\s*\([^)]*\)", "", name.strip().lower())
    plain = re.sub(r"\s+", " ", plain)
    if plain not in NAMES:
        raise UnknownType(f"unknown type: {name}")
    return NAMES[plain]
