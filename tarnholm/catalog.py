"""A database of typed tables: a manifest beside a folder of Parquet tables."""

from __future__ import annotations

import json
import logging
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types
from .plans.graph import build, from_items
from .plans.learned import JoinStats, learned_sql
from .plans.sizes import measured
from .sources.csv import read_csv
from .sqltext import Select, SQLError, item, order_nulls, order_outer, parse_select, pieces, split, substitute, unique_names

log = logging.getLogger(__name__)
FLAGS = {"primary key": "primary", "unique": "unique", "not null": "not_null", "foreign key": "foreign"}
RESERVED = ("subquery.", "subquerycol.", "filtered.", "joined.", "result.")


class CatalogError(ValueError):
    pass


@dataclass
class Column:
    """A column; the flags describe it and, as for unenforced constraints in general, aren't checked."""

    name: str
    type: str
    primary: bool = False
    unique: bool = False
    not_null: bool = False
    foreign: bool = False

    def field(self) -> T.StructField:
        return T.StructField(self.name, types.parse(self.type), True, {k: getattr(self, k) for k in FLAGS.values()})


@dataclass
class Table:
    name: str
    columns: list[Column]
    path: str
    temporary: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])


def parse_create(sql: str) -> tuple[str, list[Column]]:
    """Name and columns of CREATE TABLE."""
    m = re.fullmatch(r"\s*create\s+table\s+([\w.`]+)\s*\((.*)\)\s*;?\s*", sql, re.S | re.I)
    if not m:
        raise SQLError("not a CREATE TABLE")
    out = []
    for part in split(m[2], ","):
        flags, rest = {}, part.strip()
        for text, name in FLAGS.items():
            pattern = r"\s+" + text.replace(" ", r"\s+") + r"\b"
            flags[name] = bool(re.search(pattern, rest, re.I))
            rest = re.sub(pattern, "", rest, flags=re.I)
        words = rest.split(None, 1)
        if len(words) < 2:
            raise SQLError(f"not a column: {part!r}")
        out.append(Column(words[0].strip("`\"").lower(), words[1].strip(), flags["primary"], flags["unique"], flags["not_null"], flags["foreign"]))
    return m[1].strip("`").lower(), out


@dataclass
class Database:
    """Tables by name (case doesn't matter), kept in ``path``; any file system that Spark can reach."""

    spark: SparkSession
    path: str
    name: str = "db"
    compressed: bool = False
    tables: dict[str, Table] = field(default_factory=dict)
    last: JoinStats | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str = "db") -> Database:
        db = cls(spark, path, name)
        db._store()
        return db

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())
        data = json.loads(text)
        db = cls(spark, path, data["name"], data["compressed"])
        for t in data["tables"]:
            db.tables[t["name"]] = Table(t["name"], [Column(**c) for c in t["columns"]], t["path"])
        return db

    @classmethod
    def over(cls, spark: SparkSession, folder: str, *names: str) -> Database:
        """Existing Parquet files as tables, read when a query names them; nothing is written."""
        db = cls(spark, folder)
        for n in names:
            db.tables[n] = Table(n, [], f"{folder}/{n}.parquet")
        return db

    def _store(self) -> None:
        tables = [{"name": t.name, "path": t.path, "columns": [vars(c) for c in t.columns]} for t in self.tables.values() if not t.temporary]
        text = json.dumps({"name": self.name, "compressed": self.compressed, "tables": tables})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest.json")

    def table(self, name: str) -> Table:
        key = name.strip("`").lower()
        if key not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[key]

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.table(name).path)

    def frames(self, sql: str | None = None) -> dict[str, DataFrame]:
        """The tables, or those whose names occur in a query."""
        words = None if sql is None else {p.strip("`").lower() for p in pieces(sql)}
        return {n: self.df(n) for n in self.tables if words is None or n in words}

    # DDL
    def create_table(self, sql: str) -> Table:
        name, columns = parse_create(sql)
        return self.add_table(name, columns)

    def add_table(self, name: str, columns: list[Column]) -> Table:
        if name in self.tables:
            raise CatalogError(f"table {name} exists")
        if name.startswith(RESERVED):
            raise CatalogError(f"{name} is a reserved name")
        table = Table(name, columns, f"{self.path}/data/{name}/{uuid.uuid4().hex}")
        self.spark.createDataFrame([], table.schema()).write.parquet(table.path)
        self.tables[name] = table
        self._store()
        return table

    def copy_table(self, source: str, target: str) -> Table:
        """The schema alone."""
        return self.add_table(target.lower(), [Column(**vars(c)) for c in self.table(source).columns])

    def drop_table(self, name: str) -> None:
        """Out of the catalog; the data stay."""
        del self.tables[self.table(name).name]
        self._store()

    # data
    def replace(self, name: str, df: DataFrame) -> None:
        """New rows for a table: written beside the old ones, which readers may still hold, then switched."""
        table = self.table(name)
        path = f"{self.path}/data/{table.name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table.path = path
        self._store()

    def load_csv(self, name: str, path: str, separator: str = ",", null: str = "NULL") -> int:
        """Replaces a table's rows by a file's; how many there are."""
        times = tuple(c.name for c in self.table(name).columns if c.type.strip().lower() == "time")
        self.replace(name, read_csv(self.spark, path, self.table(name).schema(), separator, null, times))
        return self.df(name).count()

    def insert_result(self, name: str, df: DataFrame) -> Table:
        """SELECT INTO: the result as a new table."""
        key = name.strip("`").lower()
        if key in self.tables:
            raise CatalogError(f"table {key} exists")
        table = Table(key, [Column(f.name, f.dataType.simpleString()) for f in df.schema], f"{self.path}/data/{key}/{uuid.uuid4().hex}")
        df.write.parquet(table.path)
        self.tables[key] = table
        self._store()
        return table

    def compress(self) -> None:
        """Rewrites all tables with dictionary pages, which is what Parquet does for strings; marks the database."""
        for n in list(self.tables):
            self.replace(n, self.df(n))
        self.compressed = True
        self._store()

    def dictionary(self) -> DataFrame:
        """(code, value): the distinct strings of all tables; a code is the rank of its string."""
        parts = [self.df(t.name).select(F.explode(F.array(*(F.col(f"`{f.name}`") for f in self.df(t.name).schema if isinstance(f.dataType, T.StringType)))).alias("value")) for t in self.tables.values() if any(isinstance(f.dataType, T.StringType) for f in self.df(t.name).schema)]
        if not parts:
            return self.spark.createDataFrame([], "code long, value string")
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        ranked = all_.filter("value IS NOT NULL").distinct().orderBy("value")
        # global ranks without one task that sees all: a count per ordered partition, then its offset
        placed = ranked.select(F.spark_partition_id().alias("part"), "value").checkpoint() if self._can_checkpoint() else ranked.select(F.spark_partition_id().alias("part"), "value").cache()
        counts = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
        offsets, total = {}, 0
        for p in sorted(counts):
            offsets[p], total = total, total + counts[p]
        if not offsets:
            return self.spark.createDataFrame([], "code long, value string")
        base = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("part"))
        local = F.row_number().over(Window.partitionBy("part").orderBy("value"))
        return placed.select((base + local - 1).cast("long").alias("code"), "value")

    def _can_checkpoint(self) -> bool:
        return self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()

    def index(self, keys_only: bool = False) -> dict[str, int]:
        """Statistics for the optimiser in place of hash indexes: the rows of each table."""
        return {n: self.df(n).count() for n, t in self.tables.items() if not keys_only or any(c.primary or c.unique or c.foreign for c in t.columns)}

    def cache(self, *names: str) -> None:
        for n in names or self.tables:
            self.df(n).createOrReplaceTempView(n)
            self.spark.catalog.cacheTable(n)

    def uncache(self, *keep: str) -> None:
        for n in self.tables:
            if n not in keep and self.spark.catalog.tableExists(n) and self.spark.catalog.isCached(n):
                self.spark.catalog.uncacheTable(n)

    def copy_sample(self, target: str, rows: int) -> Database:
        """At most so many rows of every table, in a new database."""
        out = Database.create(self.spark, target, self.name)
        for t in self.tables.values():
            out.tables[t.name] = Table(t.name, t.columns, f"{target}/data/{t.name}/{uuid.uuid4().hex}")
            self.df(t.name).limit(rows).write.parquet(out.tables[t.name].path)
        out._store()
        return out

    # queries
    def views(self, sql: str | None = None) -> dict[str, DataFrame]:
        frames = self.frames(sql)
        for n, df in frames.items():
            df.createOrReplaceTempView(n)
        return frames

    def select(self, sql: str, learned: bool = False, **options) -> DataFrame:
        """The rows of a SELECT; with INTO, they become a table that is then read.

        Aliases of SELECT items may stand in WHERE, where no column has their name. ORDER BY puts
        nulls last, DESC first. learned: take the join order of a comma join by trial (see
        plans.learned); a query of another form is left to Catalyst.
        """
        frames, self.last = self.views(sql), None
        try:
            parts = parse_select(sql)
        except SQLError as e:
            if "isn't taken apart" not in str(e):
                raise
            return self.spark.sql(order_outer(sql))
        prepare_select(parts, {c.lower() for df in frames.values() for c in df.columns})
        df = None
        if not learned:
            parts.from_ = small_steps(self.spark, parts, frames)
        else:
            try:
                df, self.last = learned_sql(self.spark, parts.sql(), frames, **options)
            except SQLError as e:
                log.warning("the join order isn't learned, Catalyst plans the query: %s", e)
        df = self.spark.sql(parts.sql()) if df is None else df
        if parts.into:
            return self.spark.read.parquet(self.insert_result(parts.into, df).path)
        return df


def small_steps(spark: SparkSession, s: Select, tables: dict[str, DataFrame]) -> str:
    """The FROM of a comma join: as written, unless a step of it is estimated to have more rows than all tables together.

    Then it is the order with the smallest steps. A join of another form stays as it is, and so
    does a SELECT of all columns, whose order is that of FROM.
    """
    try:
        items = from_items(s.from_) if s.from_ else []
        if len(items) < 3 or any(e == "*" for e, _ in s.items):
            return s.from_
        _, graph, _ = build(spark, s.sql(), {k.lower(): v for k, v in tables.items()})
    except SQLError:
        return s.from_
    sizes = measured(graph)
    if sizes.widest(tuple(graph.tables)) <= sizes.limit:
        return s.from_
    names = {alias: name for name, alias in items}
    return ", ".join(f"{names[a]} AS `{a}`" for a in sizes.order())


def prepare_select(s: Select, columns: set[str]) -> None:
    """Rewrites what Spark's dialect lacks, in place: names for all columns, aliases in WHERE, null order."""
    named = {a.lower(): e for e, a in s.items if a and a.lower() not in columns}
    if s.where and named:
        s.where = substitute(s.where, named)
    if all(e != "*" and not e.endswith(".*") for e, _ in s.items):
        s.select = ", ".join(f"{e} AS `{n}`" for (e, _), n in zip(s.items, unique_names(s.items)))
        s.items = [item(x) for x in split(s.select, ",")]
    if s.order:
        s.order = order_nulls(s.order)
    if s.limit and not re.fullmatch(r"\d+", s.limit):
        raise SQLError("LIMIT must be a number")
