from pathlib import Path

from tessera.slt import Options, parse_file, run_file
from tessera.slt.__main__ import main
from tessera.slt.runner import hash_of, shown

HERE = Path(__file__).parent / "slt"


def test_records():
    got = parse_file(HERE / "select.test")
    assert [r.kind for r in got].count("statement") == 5
    assert not any(r.sql == "SELECT 1" for r in got)
    assert got[-1].hash and got[-1].types == "I" and got[4].sort == "nosort"


def test_pass_and_waive(spark):
    s = run_file(spark, HERE / "select.test")
    assert (s.passed, s.failed, s.waived) == (11, 0, 1), s.failures
    assert run_file(spark, HERE / "select.test", Options(strict=True)).failed == 1


def test_failures_are_reported(spark):
    s = run_file(spark, HERE / "wrong.test")
    assert (s.passed, s.failed) == (1, 4) and [f.line for f in s.failures] == [4, 7, 10, 15]


def test_sort_and_hash():
    rows = [(2, "b"), (1, "c")]
    assert shown(rows, "IT", "nosort") == ["2", "b", "1", "c"]
    assert shown(rows, "IT", "rowsort") == ["1", "c", "2", "b"]
    assert shown(rows, "IT", "valuesort") == ["1", "2", "b", "c"]
    assert hash_of(["1", "2"]) == "6ddb4095eb719e2a9f0a3f95677d24e0"


def test_command(spark, capsys):
    assert main([str(HERE / "select.test")]) == 0
    assert main([str(HERE / "*.test")]) == 1
    assert "TOTAL: 12 passed, 4 failed, 1 waived of 17" in capsys.readouterr().out
    assert main([str(HERE / "missing.test")]) == 2
