"""python -m tarnwork QUERY SF_DIR [OUT]: runs a query of the catalog; without OUT it prints the first rows. python -m tarnwork list names them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import catalog


def main(args: list[str]) -> int:
    if args == ["list"]:
        print(*sorted(catalog.QUERIES), sep="\n")
        return 0
    if len(args) not in (2, 3) or args[0] not in catalog.QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    out = catalog.QUERIES[args[0]](SparkSession.builder.getOrCreate(), args[1])
    out.write.parquet(args[2]) if len(args) == 3 else out.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
