"""``python -m findgrain index FOLDER ROOT...``, ``query FOLDER TEXT``, ``stats FOLDER``."""

from __future__ import annotations

import sys

from findgrain.api import SearchIndex
from findgrain.session import build_session
from findgrain.sources.files import Scope

USAGE = __doc__


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "query", "stats"):
        print(USAGE)
        return 2
    spark = build_session("findgrain")
    spark.sparkContext.setLogLevel("ERROR")
    if args[0] == "index":
        index = SearchIndex(spark, args[1], Scope(roots=args[2:]))
        print("generation", index.build(index.scan()))
    elif args[0] == "query":
        for row in SearchIndex(spark, args[1]).search(" ".join(args[2:])).orderBy("rank").collect():
            print(f"{row['score']:10.4f}  {row['path']}")
    else:
        for name, value in SearchIndex(spark, args[1]).stats().first().asDict().items():
            print(f"{name:14} {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
