"""python -m tessera.slt [--strict] FILES: a line for each file, and the total. Exit 0: all passed; 1: some failed; 2: a file cannot be read."""

from __future__ import annotations

import argparse
import glob
import sys

from ..session import local_session
from .runner import Options, Stats, run_file


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera.slt", description=__doc__)
    p.add_argument("--strict", action="store_true", help="unsupported SQL fails")
    p.add_argument("files", nargs="*", default=["tests/slt/*.test"])
    options = p.parse_args(args)
    spark, total = local_session(), Stats()
    paths = [x for f in options.files for x in (sorted(glob.glob(f)) or [f])]
    for path in paths:
        try:
            s = run_file(spark, path, Options(options.strict))
        except OSError as e:
            print(f"{path}: {e}", file=sys.stderr)
            return 2
        for f in s.failures:
            print(f"{f.file}:{f.line}: {f.message}")
        print(f"{path}: {s.passed} passed, {s.failed} failed, {s.waived} waived of {s.total}")
        for k in ("passed", "failed", "waived"):
            setattr(total, k, getattr(total, k) + getattr(s, k))
    print(f"TOTAL: {total.passed} passed, {total.failed} failed, {total.waived} waived of {total.total}")
    return 1 if total.failed else 0


if __name__ == "__main__":
    sys.exit(main())
