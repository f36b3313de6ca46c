"""Results as text."""

from __future__ import annotations

import math


def text_of(value) -> str:
    """A value as the golden tests and the prompt show it: doubles with six decimals."""
    if value is None:
        return "Null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def box(names: list[str], rows: list[tuple]) -> str:
    """A table in a box, with its numbers of rows and columns below."""
    cells = [[text_of(v) for v in row] for row in rows]
    widths = [max(len(c) for c in column) + 2 for column in zip(names, *cells, strict=True)]
    line = lambda left, mid, right: left + mid.join("─" * w for w in widths) + right
    show = lambda row: "│" + "│".join(c.center(w) for c, w in zip(row, widths, strict=True)) + "│"
    body = [show(names)]
    for row in cells:
        body += [line("├", "┼", "┤"), show(row)]
    return "\n".join([line("╭", "┬", "╮"), *body, line("╰", "┴", "╯"), f"Total Rows: {len(rows)} Columns: {len(names)}"])
