"""Runner of golden test files.

A file holds blocks: ``statement ok`` or ``statement error`` and a statement, or
``query``, a statement, ``----`` and the expected rows up to a blank line, values
joined by one space.  Statements may run over lines; lines that start with # are left out.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from millrace.errors import EngineError
from millrace.printer import text_of


@dataclass
class Case:
    kind: str  # ok, error or query
    sql: str
    rows: list[str] = field(default_factory=list)
    line: int = 0


def cases(text: str) -> list[Case]:
    out, lines, k = [], text.split("\n"), 0
    while k < len(lines):
        head = lines[k].strip()
        start, k = k + 1, k + 1
        if not head or head.startswith("#"):
            continue
        kind = {"statement ok": "ok", "statement error": "error", "query": "query"}.get(head)
        if kind is None:
            raise ValueError(f"line {start}: {head!r} opens no block")
        sql = []
        while k < len(lines) and lines[k].strip() and lines[k].strip() != "----":
            sql.append(lines[k].strip())
            k += 1
        case = Case(kind, " ".join(sql), line=start)
        if kind == "query" and k < len(lines) and lines[k].strip() == "----":
            k += 1
            while k < len(lines) and lines[k].strip():
                case.rows.append(lines[k].rstrip())
                k += 1
        out.append(case)
    return out


def failures(session, text: str) -> list[str]:
    """What went otherwise than expected, empty if nothing did."""
    out = []
    for case in cases(text):
        try:
            _, rows = session.run(case.sql)
            got = [" ".join(map(text_of, row)) for row in rows]
            if case.kind == "error":
                out.append(f"line {case.line}: {case.sql}: no error")
            elif case.kind == "query" and got != case.rows:
                out.append(f"line {case.line}: {case.sql}: {got} instead of {case.rows}")
        except EngineError as error:
            if case.kind != "error":
                out.append(f"line {case.line}: {case.sql}: {error.code}: {error.message}")
    return out


def main(paths: list[str]) -> int:
    from pyspark.sql import SparkSession

    from millrace.session import Session
    from millrace.sources.shared import shared_dir

    spark = SparkSession.builder.appName("golden").getOrCreate()
    session = Session(spark, shared_dir(spark))
    wrong = 0
    for path in paths:
        with open(path) as file:
            found = failures(session, file.read())
        wrong += len(found)
        print(f"{path}: {'ok' if not found else 'FAILED'}", *found, sep="\n  ")
    return int(wrong > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
