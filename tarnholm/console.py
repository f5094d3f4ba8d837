"""Commands and statements of the console, one line at a time."""

from __future__ import annotations

import csv
import shlex
import sys
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .catalog import CatalogError, Database
from .plans.explain import episode_lines
from .plans.learned import JoinStats, learned_sql
from .sources.printer import lines
from .sqltext import SQLError, statements

HELP = """\
bench <dir> <out.csv>                      run every .sql file of a folder and write its statistics
compress                                   rewrite all tables with dictionary encoding
exec <file>                                run a file of statements and commands
explain <query>                            run a query with a learned join order and show the search
help                                       this list
index all                                  gather row counts of all tables
list                                       the tables
load <table> <file> <separator> <null>     replace a table's rows by those of a delimited file
quit                                       leave
CREATE TABLE, DROP TABLE, SELECT           as in SQL; SELECT may have INTO"""
COLUMNS = ["Query", "Millis", "PreMillis", "JoinMillis", "PostMillis", "Rows", "Episodes", "Plans", "UctNodes", "JoinCard", "AvgReward", "MaxReward", "BestOrder"]


class Console:
    """run() gives the lines to show; an error is a line, and the console goes on."""

    def __init__(self, db: Database):
        self.db, self.done = db, False

    def run(self, line: str) -> list[str]:
        try:
            return list(self._run(line.strip().rstrip(";")))
        except (CatalogError, SQLError, PySparkException, OSError, ValueError) as e:
            return [f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"]

    def _run(self, line: str) -> Iterator[str]:
        word = line.split(None, 1)[0].lower() if line else ""
        if not word:
            return
        if word in ("quit", "exit"):
            self.done = True
        elif word == "help":
            yield from HELP.splitlines()
        elif word == "list":
            for t in self.db.tables.values():
                yield f"{t.name}({', '.join(f'{c.name} {c.type}' for c in t.columns)})"
        elif word == "compress":
            self.db.compress()
            yield "compressed"
        elif word == "index":
            yield from (f"{n}: {k} rows" for n, k in self.db.index().items())
        elif word == "load":
            parts = shlex.split(line)
            if len(parts) != 5:
                raise SQLError("load <table> <file> <separator> <null>")
            yield f"{self.db.load_csv(parts[1], parts[2], parts[3], parts[4])} rows"
        elif word == "exec":
            for s in statements(Path(line.split(None, 1)[1]).read_text()):
                yield from self.run(s)
        elif word == "bench":
            _, folder, out = shlex.split(line)
            yield from self.bench(folder, out)
        elif word == "explain":
            yield from self.explain(line.split(None, 1)[1])
        elif word == "create":
            yield f"created {self.db.create_table(line).name}"
        elif word == "drop":
            parts = line.split()
            if len(parts) != 3 or parts[1].lower() != "table":
                raise SQLError("DROP TABLE <table>")
            self.db.drop_table(parts[2])
            yield f"dropped {parts[2]}"
        elif word == "select":
            yield from lines(self.db.select(line))
        else:
            raise SQLError(f"not supported: {word}")

    def explain(self, sql: str) -> Iterator[str]:
        df = self.db.select(sql, learned=True)
        yield from episode_lines(self.db.last or JoinStats())
        yield from lines(df)

    def bench(self, folder: str, out: str) -> Iterator[str]:
        """Every query file in order of name, with a learned order where its form allows; statistics as CSV."""
        files = sorted(Path(folder).glob("*.sql"))
        with open(out, "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(COLUMNS)
            for p in files:
                sql, start = p.read_text(), time.perf_counter()
                try:
                    df, stats = learned_sql(self.db.spark, sql.strip().rstrip(";"), self.db.frames(sql))
                except SQLError:
                    df, stats = self.db.select(sql), JoinStats()
                rows = df.count()
                total = 1000 * (time.perf_counter() - start)
                best = " ".join(stats.episodes[-1].order) if stats.episodes else ""
                w.writerow([p.name, round(total), round(stats.pre_millis), round(stats.join_millis), round(total - stats.pre_millis - stats.join_millis), rows, len(stats.episodes), stats.plans, stats.nodes, stats.join_rows, round(stats.average_reward, 4), round(stats.max_reward, 4), best])
                yield f"{p.name}: {rows} rows, {total:.0f} ms"


def main(path: str) -> None:
    from .session import session

    spark: SparkSession = session()
    try:
        db = Database.open(spark, path)
    except PySparkException:
        db = Database.create(spark, path)
    console = Console(db)
    for line in sys.stdin:
        for x in console.run(line):
            print(x)
        if console.done:
            break


if __name__ == "__main__":
    main(sys.argv[1])
