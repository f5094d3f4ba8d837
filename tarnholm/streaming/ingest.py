"""Continuous loading of delimited files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Database


def ingest(db: Database, name: str, folder: str, separator: str = ",", null: str = "NULL", once: bool = True) -> StreamingQuery:
    """Appends the rows of new files in a folder to a table, each file once.

    Rows are typed as load_csv types them: empty fields and the null literal are null. The
    progress is kept beside the table, so a restarted stream goes on where it stopped; the file
    sink commits whole batches, so a lost executor leaves no rows twice. once: stop when all
    present files are read.
    """
    table = db.table(name)
    text = T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns])
    stream = db.spark.readStream.schema(text).csv(folder, sep=separator, nullValue=null, quote='"', escape='"', mode="FAILFAST")
    typed = stream.select(*(F.when((F.col(f.name) == "") | (F.col(f.name) == null), None).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) for f in table.schema()))
    writer = typed.writeStream.format("parquet").option("path", table.path).option("checkpointLocation", f"{table.path}-progress")
    return (writer.trigger(availableNow=True) if once else writer).start()
