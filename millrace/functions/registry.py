"""Name -> signature and Spark columns, for the named functions and the operators.

Types are INT (Spark's integer types, kept at their width), DOUBLE, STRING, NULL and
OTHER (columns that can only be shown).  Truth values are INT; a column that is really
boolean stays so until a number is needed of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import BindError

NUMERIC = ("INT", "DOUBLE")


@dataclass
class Typed:
    """A bound expression.

    width: const (no column), row (a value for each row) or one (an aggregate).
    """

    column: Column
    kind: str
    name: str
    width: str = "const"
    boolean: bool = False
    wide: bool = False  # a 64-bit integer

    @property
    def number(self) -> Column:
        return self.column.cast("int") if self.boolean else self.column

    @property
    def truth(self) -> Column:
        if self.boolean:
            return self.column
        if self.kind not in ("INT", "NULL"):
            raise BindError(f"{self.name} is no truth value; AND, OR and WHERE need INT")
        return self.column != 0


def width_of(args: list[Typed]) -> str:
    widths = {a.width for a in args}
    return "row" if "row" in widths else "one" if "one" in widths else "const"


# --- operators ---

_ARITHMETIC = {"ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b, "MOD": lambda a, b: a % b}
_COMPARE = {
    "LT": lambda a, b: a < b,
    "LE": lambda a, b: a <= b,
    "GT": lambda a, b: a > b,
    "GE": lambda a, b: a >= b,
    "EQ": lambda a, b: a == b,
    "NE": lambda a, b: a != b,
}
OPERATORS = {*_ARITHMETIC, "DIV", *_COMPARE, "AND", "OR"}


def operator(name: str, a: Typed, b: Typed) -> Typed:
    label, width = f"{name}({a.name}, {b.name})", width_of([a, b])
    if name in ("AND", "OR"):
        return Typed(a.truth & b.truth if name == "AND" else a.truth | b.truth, "INT", label, width, boolean=True)
    if name in _COMPARE:
        if not ({a.kind, b.kind} <= {*NUMERIC, "NULL"} or {a.kind, b.kind} <= {"STRING", "NULL"}):
            raise BindError(f"can't compare {a.kind} with {b.kind}")
        return Typed(_COMPARE[name](a.number, b.number), "INT", label, width, boolean=True)
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        raise BindError(f"{name} of {a.kind} and {b.kind}: please CAST other types first")
    if "DOUBLE" in (a.kind, b.kind):
        x, y = a.number.cast("double"), b.number.cast("double")
        return Typed(x / y if name == "DIV" else _ARITHMETIC[name](x, y), "DOUBLE", label, width)
    wide = a.wide or b.wide
    if name == "DIV":  # toward zero
        whole = F.call_function("div", a.number, b.number)
        return Typed(whole if wide else whole.cast("int"), "INT", label, width, wide=wide)
    return Typed(_ARITHMETIC[name](a.number, b.number), "INT", label, width, wide=wide)


# --- casts ---

_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_DOUBLE_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def _prefix(text: Column, pattern: str, to: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    failed = F.raise_error(F.concat(F.lit("no number at the start of "), text))
    return F.when(text.isNull(), F.lit(None)).when(found == "", failed).otherwise(found).cast(to)


def double_text(x: Column) -> Column:
    """Six decimals, as C prints it."""
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return odd.otherwise(F.format_string("%.6f", x))


def cast(args: list[Typed]) -> Typed:
    if len(args) != 2 or args[1].width != "const" or args[1].kind != "STRING":
        raise BindError("CAST takes a value and a type name, as in CAST(x, 'INT')")
    x, to = args[0], args[1].name.upper()
    if to not in ("INT", "DOUBLE", "STRING"):
        raise BindError(f"unknown type {args[1].name}")
    label = f"CAST({x.name}, {args[1].name})"
    spark_type = {"INT": "int", "DOUBLE": "double", "STRING": "string"}[to]
    if x.kind == "STRING" and to != "STRING":
        column = _prefix(x.column, _INT_PREFIX if to == "INT" else _DOUBLE_PREFIX, spark_type)
    elif x.kind == "DOUBLE" and to == "STRING":
        column = double_text(x.column)
    else:
        column = x.number.cast(spark_type)
    return Typed(column, to, label, x.width)


# --- named scalar functions ---

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _guarded(log: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm that is -inf at 0 and NaN below, where Spark's is null."""
    return lambda x: F.when(x > 0, log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x)


_MATH = {
    "SQRT": F.sqrt,
    "SIN": F.sin,
    "COS": F.cos,
    "TAN": F.tan,
    "ASIN": F.asin,
    "ACOS": F.acos,
    "ATAN": F.atan,
    "LOG": _guarded(F.ln),
    "LOG10": _guarded(F.log10),
    "EXP": F.exp,
    "CEIL": lambda x: _whole(F.ceil, x),
    "FLOOR": lambda x: _whole(F.floor, x),
    "ROUND": lambda x: _whole(F.round, x),
}


def _whole(rounded: Callable[[Column], Column], x: Column) -> Column:
    """Rounded as a double; values too large for a fraction, and those that aren't finite, are whole already."""
    return F.when(F.abs(x) < float(1 << 52), rounded(x).cast("double")).otherwise(x)


def scalar(name: str, args: list[Typed]) -> Typed:
    label, width = f"{name}({', '.join(a.name for a in args)})", width_of(args)
    if name == "CAST":
        return cast(args)
    if len(args) != 1 and not (name == "ROUND" and args):
        raise BindError(f"{name} takes one argument")
    x = args[0]
    if name in _MATH:
        if x.kind not in NUMERIC:
            raise BindError(f"{name} only supports INT/DOUBLE")
        return Typed(_MATH[name](x.number.cast("double")), "DOUBLE", label, width)
    if name == "ABS":
        if x.kind not in NUMERIC:
            raise BindError("ABS only supports INT/DOUBLE")
        return Typed(F.abs(x.number), x.kind, label, width, wide=x.wide)
    if x.kind not in ("STRING", "NULL"):
        raise BindError(f"{name} only supports STRING")
    source, target = (_LOWER, _UPPER) if name == "TO_UPPER" else (_UPPER, _LOWER)
    return Typed(F.translate(x.column.cast("string"), source, target), "STRING", label, width)


SCALARS = {*_MATH, "ABS", "CAST", "TO_UPPER", "TO_LOWER"}

# --- aggregates ---

AGGREGATES = {"COUNT", "SUM", "SIMD_SUM"}


def aggregate(name: str, x: Typed) -> Typed:
    """COUNT counts rows, NULLs as well, in 64 bits; SUM is a double and 0 for no rows.  Of a single value, the value itself or 1."""
    label = f"{name}({x.name})"
    if name != "COUNT" and x.kind not in NUMERIC:
        raise BindError(f"{name} only supports INT/DOUBLE")
    if name == "COUNT":
        return Typed(F.lit(1).cast("long") if x.width == "one" else F.count(F.lit(1)), "INT", label, "one", wide=True)
    value = x.number.cast("double")
    return Typed(F.coalesce(value if x.width == "one" else F.sum(value), F.lit(0.0)), "DOUBLE", label, "one")
