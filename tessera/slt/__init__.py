"""sqllogictest files: parse them, run them."""

from .runner import Failure, Options, Stats, parse_file, run_file

__all__ = ["Failure", "Options", "Stats", "parse_file", "run_file"]
