"""python -m tessera.cli [-db FOLDER] < script.sql: rows as text, '|' between values."""

from __future__ import annotations

import argparse
import sys

from .errors import SQLError, UnsupportedError
from .functions.values import render
from .plans.lexer import split_statements
from .session import local_session
from .sources.store import Store


def run(store: Store, script: str, out) -> None:
    for statement in split_statements(script):
        for row in store.execute(statement).rows:
            print("|".join(map(render, row)), file=out)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("-db", "--db", help="folder of a durable database")
    options = p.parse_args(args)
    spark = local_session()
    try:
        run(Store(spark, options.db), sys.stdin.read(), sys.stdout)
    except (SQLError, UnsupportedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
