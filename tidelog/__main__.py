"""Command line: python -m tidelog [--db-path PATH] stat | compact | reindex | dump | load | query | import."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tidelog.sources.store import Store


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidelog", description="An event query engine on PySpark")
    top.add_argument("--db-path", default="./data")
    what = top.add_subparsers(dest="command")
    what.add_parser("stat")
    what.add_parser("compact")
    what.add_parser("reindex").add_argument("--force", action="store_true")
    what.add_parser("dump").add_argument("file")
    what.add_parser("load").add_argument("file")
    what.add_parser("query").add_argument("filters", nargs="?", default="{}")
    what.add_parser("import").add_argument("files", nargs="+")
    given = top.parse_args(args)
    if not given.command:
        top.print_help()
        return 0
    store = Store(SparkSession.builder.appName("tidelog").getOrCreate(), given.db_path)
    if given.command == "stat":
        print("".join(f"{k:>8}  {v:,}\n" for k, v in store.stats().items()), end="")
    elif given.command == "compact":
        print(store.compact())
    elif given.command == "reindex":
        print(store.reindex(given.force, lambda p: print(p, file=sys.stderr)))
    elif given.command == "dump":
        with open(given.file, "wb") as out:
            print(store.dump(out))
    elif given.command == "load":
        print(store.load(given.file))
    elif given.command == "import":
        print(store.import_jsonl(given.files))
    else:
        began = time.perf_counter()
        count = store.stream_query(given.filters, lambda note: print(note))
        print(f"{count} in {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
