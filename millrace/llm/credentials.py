"""Secret scan with multipart credential linking [operator 4].

Three base patterns always report: assignments of a secret to a name, access-key
identifiers and long hexadecimal runs.  Beside them the scan looks for weak parts,
which alone mean little: other identifiers, random-looking tokens and endpoints.
A document falls into scopes, its paragraphs.  An interval join over the sorted
parts of a scope, each widened by a reach if one is set, finds which kinds occur
together, and a weak part is reported only where its complement does:

    identifier   with a secret
    token        with an identifier or an endpoint
    endpoint     with a secret (a weak one only together with an identifier)

Base spans of kind assign and hex count as secrets, access as identifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import slices, texts, with_own_names, worker_cache

#: The base patterns, with the letters of the names in either case.
_either = lambda names: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in names)
_NAMES = _either(("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")

#: What a text holds, lower-cased, if ASSIGN can match it.
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

_OWNERS, _LABELS = _either(("client", "account", "tenant", "access[_-]?key", "user")), _either(("id", "name"))
_IDENTIFIER = re.compile(rf"""(?:{_OWNERS})[_-]?(?:{_LABELS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{4,}}|(?:ASIA|AROA|AIDA)[A-Z0-9]{{12,}}""")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
#: Bits a character from which a token looks random.
LEAST_ENTROPY = 3.5

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def _looks_random(token: str) -> bool:
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    counts = Counter(token)
    return -sum(n / len(token) * log2(n / len(token)) for n in counts.values()) >= LEAST_ENTROPY


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[tuple[int, str, int]]:
    found = [(m.start(), "token", m.end()) for m in _TOKEN.finditer(text) if _looks_random(m[0])]
    if "://" in text:
        found += [(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
    if ":" in text or "=" in text or "A" in text:
        names = [(m.start(), "identifier", m.end()) for m in _IDENTIFIER.finditer(text)]
        # the value in NAME=value of an identifier is no token beside it
        values = sorted((s, e) for s, _, e in names)
        own = lambda s: text[s - 1 : s] == "=" and (k := bisect_right(values, (s, 1 << 62))) and s < values[k - 1][1]
        found = [p for p in found if p[1] != "token" or not own(p[0])] + names
    return found


class _Intervals:
    """Intervals sorted by start, with the largest end up to each: a look-up takes two steps whatever their lengths."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def near(self, start: int, end: int, reach: int | None) -> bool:
        """Whether one lies within ``reach`` of [start, end); None: whether there is any."""
        if reach is None:
            return bool(self.starts)
        k = bisect_right(self.starts, end + reach)
        return k > 0 and self.ends[k - 1] + reach >= start


def linked(text: str, base: list[tuple[int, str, int]], reach: int | None) -> list[tuple[int, str, int]]:
    """The weak parts whose complement lies in the same scope and within reach."""
    weak, inside = weak_parts(text), _Intervals([(s, e) for s, _, e in base])
    # a part that overlaps a base span is that span once more
    weak = [w for w in weak if not inside.near(w[0] + 1, w[2] - 1, 0)]
    if not weak:
        return []
    edges = [m.start() for m in _PARAGRAPH.finditer(text)]
    scopes: dict[int, list[tuple[int, str, int]]] = {}
    for part in (*base, *weak):
        scopes.setdefault(bisect_right(edges, part[0]), []).append(part)
    out = []
    roles = {"assign": "secret", "hex": "secret", "access": "identifier"}
    for parts in scopes.values():
        by_role = {role: _Intervals([(s, e) for s, kind, e in parts if roles.get(kind, kind) == role]) for role in ("secret", "identifier", "token", "endpoint")}
        near = lambda role, p: by_role[role].near(p[0], p[2], reach)  # noqa: E731, B023
        for part in parts:
            kind = part[1]
            if kind == "identifier" and (near("secret", part) or near("token", part)):
                out.append(part)
            elif kind == "token" and (near("identifier", part) or near("endpoint", part)):
                out.append(part)
            elif kind == "endpoint" and (near("secret", part) or near("token", part) and near("identifier", part)):
                out.append(part)
    return out


def scan_text(text: str, reach: int | None = None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of all spans, by start, then kind as listed."""
    base = base_spans(text)
    found = [(k, s, e, True) for s, k, e in base] + [(k, s, e, False) for s, k, e in linked(text, base, reach)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, reach: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every row (see SPANS), in code points, ends exclusive.

    reach: characters up to which parts are linked within a paragraph; None: throughout it.

    A null or empty text has no span; repeated rows and null doc_ids are kept; an
    empty table gives an empty one; a text of any length is scanned whole; other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for part in slices(batches):
            found = [scan_text(t or "", reach) for t in part.column("text").to_pylist()]
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, SPANS)


def redact(docs: DataFrame, reach: int | None = None, mark: str = "[secret]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``mark`` in place of every span, overlapping ones counting as one; all rows and columns stay.

    ``length_col``, if there is one, is set to the new length where the text has changed.  Null and
    empty texts stay as they are, and so do clean ones; repeated rows and null ids are kept; an empty
    table gives an empty one; texts of any length are read whole; columns may share names, of which
    the first counts.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("credentials")
        for part in slices(batches, at):
            columns = list(part.columns)
            old = columns[at].to_pylist()
            new = [t and _masked(t, scan_text(t, reach), mark) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                lengths = columns[length].to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for n, a, b in zip(lengths, old, new, strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    apart = with_own_names(docs)
    return apart.mapInArrow(run, apart.schema).toDF(*docs.columns)


def _masked(text: str, spans: list[tuple[str, int, int, bool]], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted((s, e) for _, s, e, _ in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
