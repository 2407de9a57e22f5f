"""``python -m heddle``: queries, tables and checks from a shell.

    queries                     the names of all queries
    show NAME FOLDER [ROWS]     a query's first rows over a folder of tables
    ask FOLDER SQL              guarded SQL over the tables of a folder
    describe FOLDER [TABLE...]  the text that describes tables
    look FILE                   what a CSV file looks like
    load FILE TARGET            a CSV file as a Parquet table
    setup FOLDER                what is wrong with this place, if anything
"""

from __future__ import annotations

import sys

from heddle.operators import guard, profile, service
from heddle.plans import registry
from heddle.session import get_session
from heddle.sources import csvload
from heddle.sources.tables import table


def _tables(spark, folder: str, names: list[str] | None = None):
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return {
        n: table(spark, folder, n) for n in sorted(f.removesuffix(".parquet") for f in found if f.endswith(".parquet")) if not names or n in names
    }


def main(arguments: list[str]) -> int:
    command, *rest = arguments or ["help"]
    if command == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    if command not in ("show", "ask", "describe", "look", "load", "setup") or not rest:
        print(__doc__)
        return 2
    spark = get_session(master="local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if command == "show":
            registry.queries()[rest[0]](spark, rest[1]).show(int(rest[2]) if len(rest) > 2 else 20, False)
        elif command == "ask":
            result = guard.run(spark, " ".join(rest[1:]), _tables(spark, rest[0]))
            print("\t".join(result.columns), *("\t".join(map(str, r)) for r in result.rows), sep="\n")
        elif command == "describe":
            print(profile.schema_text(spark, rest[0].rstrip("/").rsplit("/", 1)[-1], _tables(spark, rest[0], rest[1:])))
        elif command == "look":
            shape = csvload.look(spark, rest[0])
            print(f"delimiter {shape.delimiter!r}", *(f"{c.name}\t{c.type}\t{c.header}" for c in shape.columns), sep="\n")
        elif command == "load":
            print(f"{csvload.import_csv(spark, rest[0], rest[1]).rows} rows")
        else:
            service.check_setup({"folder": lambda: service.can_write(spark, rest[0])})
            print("all well")
    except (KeyError, ValueError, TimeoutError, service.ServiceError) as e:
        print(f"{command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
