"""Golden files, the prompt and printing."""

from pathlib import Path

import pytest

from millrace import cli, golden
from millrace.printer import box, text_of

FILES = sorted((Path(__file__).parent / "golden").glob("*.sql"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.name)
def test_golden(session, path):
    assert golden.failures(session, path.read_text()) == []


def test_golden_reports_what_differs(session):
    text = "query\nSELECT 1\n----\n2\n\nstatement error\nSELECT 1\n\nstatement ok\nSELECT nope\n"
    found = golden.failures(session, text)
    assert len(found) == 3 and "['1'] instead of ['2']" in found[0]
    with pytest.raises(ValueError):
        golden.cases("nonsense\n")


def test_prompt(session):
    lines, out = iter(["SELECT 1,", "2.5;", "SELECT nope;", "quit;"]), []
    cli.loop(session, lambda prompt: next(lines), out.append)
    text = "\n".join(out)
    assert "Total Rows: 1 Columns: 2" in text and "2.500000" in text and "no column nope" in text and out[-1] == "Bye."


def test_box():
    assert box(["a"], [(1,), (None,)]).split("\n")[1:4] == ["│  a   │", "├──────┤", "│  1   │"]
    assert [text_of(v) for v in (1.0, float("nan"), float("-inf"), None, "x")] == ["1.000000", "nan", "-inf", "Null", "x"]
