"""python -m tidewater DIR [--read-only] [--sync full|group|off] [--cache MB] [--prelude FILE] [-c SQL]: a console over a database."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidewater.database import Database
from tidewater.plans.parse import Refused

HELP = ".help .quit .tables .schema TABLE .import FILE TABLE .refresh [VIEW] .compact NAME .vacuum NAME .flush .run FILE, or a statement"


def run_file(db: Database, path: str) -> str:
    """A file of Python that defines ``main(db)``, or of statements that end with semicolons."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".py"):
        found: dict = {}
        exec(compile(text, path, "exec"), found)
        out = db.run_script(found["main"])
        return "" if out is None else str(out)
    return "\n".join(run(db, x) for x in text.split(";") if x.strip())


def run(db: Database, line: str) -> str:
    line = line.strip()
    word, *rest = line.split()
    if word == ".help":
        return HELP
    if word == ".tables":
        return "\n".join(db.names())
    if word == ".schema":
        return "\n".join(f"{n} {k.upper()}{'' if null else ' NOT NULL'}" for n, k, null in db.schema(rest[0]))
    if word == ".import":
        return f"{db.import_csv(rest[0], rest[1])} rows"
    if word == ".refresh":
        return str(db.refresh_view(rest[0])) if rest else str(db.refresh() or "")
    if word == ".flush":
        return str(db.flush() or "")
    if word == ".compact":
        return str(db.compact(rest[0]) or "")
    if word == ".vacuum":
        return f"{db.vacuum(rest[0])} folders removed"
    if word == ".run":
        return run_file(db, rest[0])
    if word.startswith("."):
        return f"unknown command {word}; {HELP}"
    out = db.execute(line)
    return render(out) if isinstance(out, DataFrame) else str(out if isinstance(out, int) else "ok")


def render(df: DataFrame, most: int = 1000) -> str:
    rows = [[("NULL" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    wide = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in wide), *map(line, rows)])


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater")
    p.add_argument("dir")
    p.add_argument("--read-only", action="store_true")
    p.add_argument("--sync", choices=("full", "group", "off"), default="full")
    p.add_argument("--cache", type=int, metavar="MB", help="memory of the driver's JVM, in which Spark keeps what it caches")
    p.add_argument("--prelude", metavar="FILE", help="a file that is run first, as by .run")
    p.add_argument("-c", dest="sql")
    a = p.parse_args(args)
    builder = SparkSession.builder.appName("tidewater").config("spark.ui.enabled", "false")
    spark = (builder.config("spark.driver.memory", f"{a.cache}m") if a.cache else builder).getOrCreate()
    with Database(spark, a.dir, a.read_only, a.sync) as db:
        if a.prelude:
            print(run_file(db, a.prelude))
        if a.sql:
            print(run(db, a.sql))
            return 0
        for line in sys.stdin:
            if line.strip() in (".quit", ".exit"):
                break
            if line.strip():
                try:
                    print(run(db, line))
                except (Refused, OSError, IndexError, PySparkException) as e:
                    print(f"error: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
