"""Command line: python -m ravelin.cli backend | info INDEX | search INDEX QUERY.npy [-k] [--nprobe] [--program FILE]."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from ravelin.index import VectorIndex, backend


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ravelin")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("backend", help="what scores vectors")
    info = sub.add_parser("info", help="an index's manifest")
    info.add_argument("index")
    find = sub.add_parser("search", help="the nearest vectors of a query")
    find.add_argument("index")
    find.add_argument("query", help="a .npy file with one vector")
    find.add_argument("-k", type=int, default=10)
    find.add_argument("--nprobe", type=int, default=2)
    find.add_argument("--backend", default="cpu", choices=("cpu", "gpu"))
    find.add_argument("--device", type=int, default=0, help="which of the session's devices the gpu backend must have")
    find.add_argument("--program", help="a file with a program to run instead of the default one")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "backend":
        out = backend()
    else:
        spark = spark or SparkSession.builder.appName("ravelin").getOrCreate()
        with VectorIndex(spark, args.index, backend=getattr(args, "backend", "cpu"), device=getattr(args, "device", 0)) as index:
            if args.command == "info":
                out = index.info()
            else:
                out = index.search(np.load(args.query, allow_pickle=False), args.k, args.nprobe, Path(args.program).read_text() if args.program else None)
    print(json.dumps(out, indent=2, ensure_ascii=False, default=lambda x: x.tolist()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
