"""Records of a sqllogictest file, and their verdicts."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import SQLError, UnsupportedError
from ..functions.values import render_slt
from ..sources.store import Store


@dataclass
class Record:
    kind: str  # statement, query
    line: int
    sql: str
    expects_error: bool = False
    types: str = ""
    sort: str = "nosort"
    label: str = ""
    expected: list[str] = field(default_factory=list)
    hash: str | None = None


@dataclass
class Options:
    strict: bool = False  # unsupported SQL fails instead of being waived


@dataclass
class Failure:
    file: str
    line: int
    message: str


@dataclass
class Stats:
    passed: int = 0
    failed: int = 0
    waived: int = 0
    failures: list[Failure] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.passed + self.failed + self.waived


def parse_file(path: str | Path) -> list[Record]:
    return parse_records(Path(path).read_text())


def parse_records(text: str) -> list[Record]:
    """Records in order. A record under skipif or onlyif is left out; ``halt`` ends the file."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out: list[Record] = []
    at, conditional = 0, False

    def block(at: int, *ends: str) -> tuple[list[str], int]:
        got = []
        while at < len(lines) and lines[at].strip() and not any(lines[at].startswith(e) for e in ends):
            got.append(lines[at])
            at += 1
        return got, at

    while at < len(lines):
        words = lines[at].split()
        line = at + 1
        at += 1
        if not words or words[0].startswith("#") or words[0] in ("hash-threshold", "forget"):
            continue
        if words[0] == "halt":
            if not conditional:
                break
            conditional = False
            continue
        if words[0] in ("skipif", "onlyif"):
            conditional = True
            continue
        if words[0] == "statement":
            sql, at = block(at)
            record = Record("statement", line, "\n".join(sql), words[1:2] == ["error"])
        elif words[0] == "query":
            sql, at = block(at, "----")
            record = Record("query", line, "\n".join(sql), words[1:2] == ["error"], words[1] if len(words) > 1 else "", words[2] if len(words) > 2 else "nosort", words[3] if len(words) > 3 else "")
            if at < len(lines) and lines[at].startswith("----"):
                record.expected, at = block(at + 1)
            if len(record.expected) == 1 and (m := re.fullmatch(r"\d+ values hashing to ([0-9a-f]{32})", record.expected[0])):
                record.hash, record.expected = m[1], []
        else:
            continue
        if not conditional:
            out.append(record)
        conditional = False
    return out


def shown(rows: list[tuple], types: str, sort: str) -> list[str]:
    """A result's values as a file lists them."""
    text = [[render_slt(x, types[i] if i < len(types) else "T") for i, x in enumerate(r)] for r in rows]
    if sort == "rowsort":
        text.sort()
    flat = [x for r in text for x in r]
    return sorted(flat) if sort == "valuesort" else flat


def hash_of(values: list[str]) -> str:
    return hashlib.md5("".join(x + "\n" for x in values).encode()).hexdigest()


def verdict(store: Store, r: Record) -> tuple[str, str]:
    """pass, fail or waive, and why."""
    try:
        result = store.execute(r.sql)
        rows = result.rows if r.kind == "query" else []
    except UnsupportedError as e:
        return ("pass", "") if r.kind == "statement" and r.expects_error else ("waive", str(e))
    except SQLError as e:
        return ("pass", "") if r.expects_error else ("fail", f"{r.kind} failed: {e}")
    if r.expects_error:
        return "fail", f"{r.kind} expected to fail, but it did not"
    if r.kind == "statement":
        return "pass", ""
    got = shown(rows, r.types, r.sort)
    if r.hash is not None:
        return ("pass", "") if hash_of(got) == r.hash else ("fail", f"expected hash {r.hash}, got {hash_of(got)}")
    if len(got) != len(r.expected):
        return "fail", f"expected {len(r.expected)} values, got {len(got)}"
    for i, (a, b) in enumerate(zip(got, r.expected)):
        if a != b:
            return "fail", f"value {i}: expected {b!r}, got {a!r}"
    return "pass", ""


def run_file(spark, path: str | Path, options: Options | None = None) -> Stats:
    """A file's records, in order, on a store of its own."""
    options, stats, store = options or Options(), Stats(), Store(spark)
    for r in parse_file(path):
        what, why = verdict(store, r)
        if what == "waive" and options.strict:
            what, why = "fail", f"unsupported: {why}"
        stats.passed += what == "pass"
        stats.waived += what == "waive"
        if what == "fail":
            stats.failed += 1
            stats.failures.append(Failure(str(path), r.line, why))
    return stats
