"""python -m tidemark QUERY DIR: run one registered query over a directory of tables and show its first rows."""

import argparse

from .queries import QUERIES
from .session import session


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("dir")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    df = QUERIES[args.query](session(), args.dir)
    if args.explain:
        df.explain("formatted")
    df.show(args.rows, truncate=60)


if __name__ == "__main__":
    main()
