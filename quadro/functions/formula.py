"""Formulas over columns: a closed set of numeric functions, compiled to Columns.

A formula is read by Python's own expression parser after its marks are rewritten
(`^` to a power, `=` and `<>` to comparisons, `;` to a comma, [Column name] and C01 to
references). Nothing but numbers, references, arithmetic, comparisons and the registered
functions is accepted.

Every part compiles to a value and an error, both Columns. An error is a text, or null;
IFERROR and ISNUMBER look at it, and at the root it either raises or gives null. Absent
values are errors in pipelines and 0 in result tables (`missing`).
"""

from __future__ import annotations

import ast
import keyword
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.functions.coerce import round_half_away


class FormulaError(ValueError):
    pass


@dataclass
class Part:
    value: Column
    error: Column
    name: str | None = None  # of a bare column


def no_error() -> Column:
    return F.lit(None).cast("string")


def _errors(parts: list[Part]) -> Column:
    return F.coalesce(*[p.error for p in parts], no_error()) if parts else no_error()


def _plain(f: Callable[..., Column]) -> Callable[[list[Part]], Part]:
    return lambda parts: Part(f(*[p.value for p in parts]), _errors(parts))


def _checked(f: Callable[..., Column], bad: Callable[..., Column], why: str) -> Callable[[list[Part]], Part]:
    """A function that fails where `bad` holds of its arguments."""

    def build(parts: list[Part]) -> Part:
        values = [p.value for p in parts]
        wrong = F.coalesce(bad(*values), F.lit(False))
        return Part(F.when(~wrong, f(*values)), F.coalesce(_errors(parts), F.when(wrong, F.lit(why))))

    return build


def _bool(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _true(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(True))


def _median(*v: Column) -> Column:
    a, n = F.array_sort(F.array(*v)), len(v)
    return F.get(a, F.lit(n // 2)) if n % 2 else (F.get(a, F.lit(n // 2 - 1)) + F.get(a, F.lit(n // 2))) / 2


def _scaled(f: Callable[[Column], Column]) -> Callable[..., Column]:
    """Rounds the magnitude at some decimal digits; the sign is kept."""

    def build(v: Column, digits: Column | None = None) -> Column:
        scale = F.pow(F.lit(10.0), F.lit(0.0) if digits is None else digits)
        # Decimal digits as written: 1.005 times 100 is 100.49999999999999 in binary.
        exact = F.round(F.abs(v) * scale, 9)
        return F.signum(v) * f(exact) / scale

    return build


def _if(parts: list[Part]) -> Part:
    test, yes, no = parts
    t = _true(test.value)
    return Part(F.when(t, yes.value).otherwise(no.value), F.coalesce(test.error, F.when(t, yes.error).otherwise(no.error)))


def _ifs(parts: list[Part]) -> Part:
    tests, values = parts[::2], parts[1::2]
    value, error = F.lit(None).cast("double"), F.lit("IFS: no condition holds")
    for t, v in zip(reversed(tests), reversed(values), strict=True):
        value = F.when(_true(t.value), v.value).otherwise(value)
        error = F.coalesce(t.error, F.when(_true(t.value), v.error).otherwise(error))
    return Part(value, error)


def _iferror(parts: list[Part]) -> Part:
    a, b = parts
    good = a.error.isNull() & a.value.isNotNull()
    return Part(F.when(good, a.value).otherwise(b.value), F.when(good, no_error()).otherwise(b.error))


def _isnumber(parts: list[Part]) -> Part:
    return Part(_bool(parts[0].error.isNull() & parts[0].value.isNotNull()), no_error())


_round = _plain(lambda v, d=None: _scaled(lambda x: round_half_away(x))(v, d))
#: name: least and most arguments, and how it compiles.
REGISTRY: dict[str, tuple[int, int, Callable[[list[Part]], Part]]] = {
    "SUM": (1, 99, _plain(lambda *v: reduce(lambda a, b: a + b, v))),
    "AVERAGE": (1, 99, _plain(lambda *v: reduce(lambda a, b: a + b, v) / len(v))),
    "MIN": (1, 99, _plain(lambda *v: F.least(*v) if len(v) > 1 else v[0])),
    "MAX": (1, 99, _plain(lambda *v: F.greatest(*v) if len(v) > 1 else v[0])),
    "MEDIAN": (1, 99, _plain(_median)),
    "COUNT": (1, 99, lambda parts: Part(reduce(lambda a, b: a + b, [_bool(p.error.isNull() & p.value.isNotNull()) for p in parts]), no_error())),
    "ABS": (1, 1, _plain(F.abs)),
    "SQRT": (1, 1, _checked(F.sqrt, lambda v: v < 0, "SQRT of a negative number")),
    "POWER": (2, 2, _plain(F.pow)),
    "EXP": (1, 1, _plain(F.exp)),
    "LN": (1, 1, _checked(F.ln, lambda v: v <= 0, "LN of a number that isn't positive")),
    "LOG": (1, 2, _checked(lambda v, b=None: F.ln(v) / F.ln(F.lit(10.0) if b is None else b), lambda v, b=None: (v <= 0) | (F.lit(False) if b is None else (b <= 0) | (b == 1)), "LOG out of range")),
    "LOG10": (1, 1, _checked(F.log10, lambda v: v <= 0, "LOG10 of a number that isn't positive")),
    "ROUND": (1, 2, _round),
    "ROUNDUP": (1, 2, _plain(_scaled(lambda x: F.ceil(x).cast("double")))),
    "ROUNDDOWN": (1, 2, _plain(_scaled(lambda x: F.floor(x).cast("double")))),
    "TRUNC": (1, 2, _plain(_scaled(lambda x: F.floor(x).cast("double")))),
    "INT": (1, 1, _plain(lambda v: F.floor(v).cast("double"))),
    "IF": (3, 3, _if),
    "IFS": (4, 98, _ifs),
    "AND": (2, 99, _plain(lambda *v: _bool(reduce(lambda a, b: a & b, map(_true, v))))),
    "OR": (2, 99, _plain(lambda *v: _bool(reduce(lambda a, b: a | b, map(_true, v))))),
    "NOT": (1, 1, _plain(lambda v: _bool(~_true(v)))),
    "IFERROR": (2, 2, _iferror),
    "ISNUMBER": (1, 1, _isnumber),
    "CHANGE": (2, 2, _plain(lambda a, b: a - b)),
}
#: Functions that divide their first argument by the second, under the formula's policy:
#: what is divided, and by how much the result is scaled.
DIVIDING: dict[str, tuple[int, int, Callable[[list[Part]], Part], Callable[[list[Part]], Column]]] = {
    "RATE": (2, 3, lambda p: p[0], lambda p: p[2].value if len(p) > 2 else F.lit(100_000.0)),
    "PERCENT": (2, 2, lambda p: p[0], lambda p: F.lit(100.0)),
    "RATIO": (2, 2, lambda p: p[0], lambda p: F.lit(1.0)),
    "PCTCHANGE": (2, 2, lambda p: Part(p[0].value - p[1].value, _errors(p[:2])), lambda p: F.lit(100.0)),
}
#: Functions that look at other rows; they need an order or the whole column.
WINDOWED = {"LAG": (1, 2), "ZSCORE": (1, 1)}
# Other spellings of the functions.
ALIASES = {
    "SOMA": "SUM", "MEDIA": "AVERAGE", "MINIMO": "MIN", "MAXIMO": "MAX", "MEDIANA": "MEDIAN", "CONT": "COUNT", "RAIZ": "SQRT", "POTENCIA": "POWER",
    "ARRED": "ROUND", "TRUNCAR": "TRUNC", "SE": "IF", "E": "AND", "OU": "OR", "NAO": "NOT", "TAXA": "RATE", "PERCENTUAL": "PERCENT", "RAZAO": "RATIO", "VARIACAO": "CHANGE",
}


def _bare(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name.upper()) if not unicodedata.combining(c))


def _rewritten(text: str) -> tuple[str, list[str]]:
    names: list[str] = []

    def refer(m: re.Match) -> str:
        names.append(m[1])
        return f"_ref{len(names) - 1}_"

    text = re.sub(r"\[([^\[\]]+)\]", refer, text.strip().removeprefix("="))
    text = re.sub(rf"(?<![\w.])({'|'.join(keyword.kwlist)})(?![\w.]|\s*\()", refer, text)  # columns named like Python's own words
    text = text.replace(";", ",").replace("<>", "!=").replace("^", "**")
    text = re.sub(r"(?<![\w.])(?:if|and|or|not)(?=\s*\()", lambda m: m[0].upper(), text)  # Python's own words
    return re.sub(r"(?<![<>!=])=(?!=)", "==", text), names


def references(text: str, columns: list[str]) -> list[str]:
    """The columns that a formula reads."""
    source, names = _rewritten(text)
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"can't read {text!r}") from e
    found = [_resolve(n.id, names, columns) for n in ast.walk(tree) if isinstance(n, ast.Name) and _function(n.id) is None]
    return list(dict.fromkeys(found))


def _rows_back(args: list[ast.expr]) -> int:
    step = 1 if len(args) == 1 else args[1].value if isinstance(args[1], ast.Constant) else None
    if not isinstance(step, int) or isinstance(step, bool) or step < 1:
        raise FormulaError("LAG needs a positive whole number of rows")
    return step


def lags(text: str, columns: list[str]) -> list[tuple[str, int]]:
    """The (column, rows before) that a formula's LAGs read."""
    source, names = _rewritten(text)
    found = []
    for n in ast.walk(ast.parse(source, mode="eval")):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and _function(n.func.id) == "LAG" and n.args and isinstance(n.args[0], ast.Name):
            found.append((_resolve(n.args[0].id, names, columns), _rows_back(n.args)))
    return list(dict.fromkeys(found))


def _function(name: str) -> str | None:
    bare = _bare(name)
    bare = ALIASES.get(bare, bare)
    return bare if bare in REGISTRY or bare in DIVIDING or bare in WINDOWED else None


def _resolve(token: str, names: list[str], columns: list[str]) -> str:
    token = names[int(token[4:-1])] if re.fullmatch(r"_ref\d+_", token) else token
    if m := re.fullmatch(r"[cC]0*(\d+)", token):  # a position, even where a column has that name
        if not 1 <= int(m[1]) <= len(columns):
            raise FormulaError(f"no column {token}")
        return columns[int(m[1]) - 1]
    exact = [c for c in columns if c == token] or [c for c in columns if c.lower() == token.lower()]
    if len(exact) != 1:
        raise FormulaError(f"{'no' if not exact else 'more than one'} column {token}")
    return exact[0]


def compile_formula(
        text: str, values: dict[str, Column], missing: str = "zero", division: str = "error", order: Window | dict[tuple[str, int], Column] | None = None, whole: Window | DataFrame | None = None) -> Part:
    """The formula over numeric Columns by name. order: for LAG, a window over a table that is
    small, or what lags() asks for as Columns; whole: for ZSCORE, a window, or the DataFrame of
    the columns, whose mean and spread are then subqueries of their own."""
    source, names = _rewritten(text)
    try:
        tree = ast.parse(source, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"can't read {text!r}") from e
    columns = list(values)

    def column(name: str) -> Part:
        v = values[name].cast("double")
        if missing == "zero":
            return Part(F.coalesce(v, F.lit(0.0)), no_error(), name)
        return Part(v, F.when(v.isNull(), F.lit(f"{name} is missing")), name)

    def divide(a: Part, b: Part) -> Part:
        zero = F.coalesce(b.value == 0, F.lit(False))
        if division == "zero":
            return Part(F.when(zero, F.lit(0.0)).otherwise(F.try_divide(a.value, b.value)), _errors([a, b]))
        return Part(F.try_divide(a.value, b.value), F.coalesce(_errors([a, b]), F.when(zero, F.lit("division by zero"))))

    def windowed(name: str, args: list[ast.expr]) -> Part:
        low, high = WINDOWED[name]
        if not low <= len(args) <= high:
            raise FormulaError(f"{name}: {len(args)} arguments")
        first = build(args[0])
        if first.name is None:
            raise FormulaError(f"{name} needs a column")
        if name == "LAG":
            step = _rows_back(args)
            if order is None:
                raise FormulaError("LAG needs an order")
            before = order[first.name, step] if isinstance(order, dict) else F.lag(first.value, step).over(order)
            return Part(before, F.when(before.isNull(), F.lit("LAG: no such row")))
        if whole is None:
            raise FormulaError("ZSCORE needs a whole column")
        over = (lambda c: whole.agg(c).scalar()) if isinstance(whole, DataFrame) else lambda c: c.over(whole)
        sd = over(F.stddev_samp(first.value))
        return Part(F.try_divide(first.value - over(F.avg(first.value)), sd), F.coalesce(first.error, F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit("ZSCORE: no spread"))))

    def build(n: ast.expr) -> Part:
        match n:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return Part(F.lit(float(v)), no_error())
            case ast.Name(id=name):
                return column(_resolve(name, names, columns))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                p = build(x)
                return Part(-p.value, p.error)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=left, op=op, right=right):
                a, b = build(left), build(right)
                f = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Pow: F.pow}.get(type(op))
                if isinstance(op, ast.Div):
                    return divide(a, b)
                if f is not None:
                    return Part(f(a.value, b.value), _errors([a, b]))
            case ast.Compare(left=left, ops=ops, comparators=rest):
                done = build(left)
                for op, right in zip(ops, rest, strict=True):
                    a, b = done, build(right)
                    f = {ast.Lt: lambda x, y: x < y, ast.Gt: lambda x, y: x > y, ast.LtE: lambda x, y: x <= y, ast.GtE: lambda x, y: x >= y, ast.Eq: lambda x, y: x == y, ast.NotEq: lambda x, y: x != y}.get(type(op))
                    if f is None:
                        break
                    done = Part(_bool(F.coalesce(f(a.value, b.value), F.lit(isinstance(op, ast.NotEq)))), _errors([a, b]))
                else:
                    return done
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                known = _function(name)
                if known in WINDOWED:
                    return windowed(known, args)
                if known is None:
                    raise FormulaError(f"no function {name}")
                if known in DIVIDING:
                    low, high, above, scale = DIVIDING[known]
                    if not low <= len(args) <= high:
                        raise FormulaError(f"{name}: {len(args)} arguments")
                    parts = [build(a) for a in args]
                    ratio = divide(above(parts), parts[1])
                    return Part(ratio.value * scale(parts), F.coalesce(_errors(parts), ratio.error))
                low, high, make = REGISTRY[known]
                if not low <= len(args) <= high or known == "IFS" and len(args) % 2:
                    raise FormulaError(f"{name}: {len(args)} arguments")
                return make([build(a) for a in args])
        raise FormulaError(f"can't read {text!r}")

    return build(tree)


def formula(text: str, values: dict[str, Column], on_error: str = "raise", **options: object) -> Column:
    """The formula as one Column; what fails or isn't finite raises, or is null."""
    p = compile_formula(text, values, **options)
    finite = p.value.isNotNull() & ~F.isnan(p.value) & (F.abs(p.value) < float("inf"))
    if on_error == "null":
        return F.when(p.error.isNull() & finite, p.value)
    why = F.coalesce(p.error, F.when(~F.coalesce(finite, F.lit(False)), F.lit("the result isn't a finite number")))
    return F.when(why.isNotNull(), F.raise_error(F.concat(F.lit(f"{text}: "), why)).cast("double")).otherwise(p.value)
