"""Command line: train, score and report on a policy book.

  python -m riskbook book   --tables DIR --out PATH            build the fixture book from driver tables
  python -m riskbook train  --book PATH  --model DIR           fit every model, save the bundle
  python -m riskbook score  --book PATH  --model DIR --out PATH
  python -m riskbook report NAME --tables DIR [--show N]        any registered query (see --list)
  python -m riskbook report --list

Paths are read and written through Spark (local paths or any Hadoop-compatible store).
"""
from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="riskbook")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("book")
    b.add_argument("--tables", required=True)
    b.add_argument("--out", required=True)
    t = sub.add_parser("train")
    t.add_argument("--book", required=True)
    t.add_argument("--model", required=True)
    s = sub.add_parser("score")
    s.add_argument("--book", required=True)
    s.add_argument("--model", required=True)
    s.add_argument("--out", required=True)
    r = sub.add_parser("report")
    r.add_argument("name", nargs="?")
    r.add_argument("--tables")
    r.add_argument("--show", type=int, default=20)
    r.add_argument("--list", action="store_true")
    a = ap.parse_args(argv)

    from riskbook import catalog
    if a.cmd == "report" and a.list:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    from riskbook.session import get_spark
    spark = get_spark()
    from riskbook.sources import io as IO
    if a.cmd == "book":
        from riskbook.sources.book import build_book
        IO.write_policies(build_book(spark, a.tables), a.out)
    elif a.cmd == "train":
        from riskbook.ml.score import evaluate, test_split, train_all
        from riskbook.sources.models import save_model
        book = IO.read_policies(spark, a.book)
        bundle = train_all(book)
        save_model(bundle, spark, a.model)
        for k, v in evaluate(bundle, test_split(book, bundle)):
            print(f"{k:32s} {v}")
    elif a.cmd == "score":
        from riskbook.ml.score import score_book
        from riskbook.sources.models import load_model
        IO.write_policies(score_book(IO.read_policies(spark, a.book), load_model(spark, a.model)), a.out)
    elif a.cmd == "report":
        if not a.name or not a.tables:
            ap.error("report needs NAME and --tables (or --list)")
        catalog.QUERIES[a.name](spark, a.tables).show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
