"""How untyped record values are read: as text keys, numbers, dates and labels.

Blank means absent. Absent numbers are null, never NaN, so that comparisons stay
two-valued after coalesce(..., false). All functions take a Column (or a column's name)
and its Spark type where that decides the reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every script, and the byte-order mark.
WIDE_SPACE = r"[\s ﻿  -     　]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Accented letters and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")


def as_key(c: Column, kind: T.DataType | None = None) -> Column:
    """The text form of a value: whole numbers without a fraction, dates as ISO days.

    Doubles are written out from 1e-6 up to 1e21, as 1e-7 or 1.5e+21 beyond; then there are NaN,
    Infinity and -Infinity."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size, shortest = F.abs(c), c.cast("string")
        whole = F.when((c == F.floor(c)) & (size < 1e15), c.cast("long").cast("string"))
        fraction = F.regexp_replace(shortest.try_cast(T.DecimalType(38, 20)).cast("string"), r"\.?0+$", "")
        power = F.regexp_replace(F.regexp_replace(F.lower(shortest), r"\.0e", "e"), r"e(\d)", "e+$1")
        out = whole.when(F.isnan(c) | (size == float("inf")), shortest).when((size >= 1e-6) & (size < 1e15), fraction)
        return out.when((size >= 1e15) & (size < 1e21), shortest.try_cast(T.DecimalType(38, 0)).cast("string")).otherwise(power)
    if isinstance(kind, T.DecimalType):
        return F.when(c.cast("string").contains("."), F.regexp_replace(c.cast("string"), r"\.?0+$", "")).otherwise(c.cast("string"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def to_number(c: Column, kind: T.DataType | None = None) -> Column:
    """A double, or null where the value is blank or no number; a decimal comma is read."""
    if isinstance(kind, T.NumericType):
        v = c.cast("double")
        return F.when(~F.isnan(v), v)
    text = F.regexp_replace(trim_all(c.cast("string")), "^([^,]*),", "$1.")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def measure_number(c: Column, kind: T.DataType | None = None) -> Column:
    """What a sum adds: 0 for blanks and for what isn't a number."""
    return F.coalesce(to_number(c, kind), F.lit(0.0))


def not_a_number(c: Column, kind: T.DataType | None = None) -> Column:
    """Whether a sum counts a populated value as 0 (reported as a warning)."""
    blank = F.coalesce(trim_all(c.cast("string")), F.lit("")) == ""
    return ~blank & to_number(c, kind).isNull()


def filter_number(c: Column, kind: T.DataType | None = None) -> Column:
    """What a range filter compares: blanks are 0, other texts that are no number null."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(to_number(c, kind), F.lit(0.0))
    return F.when(F.coalesce(trim_all(c.cast("string")), F.lit("")) == "", F.lit(0.0)).otherwise(to_number(c))


def parse_date(c: Column, kind: T.DataType | None = None) -> Column:
    """A date from YYYYMMDD, YYYY-MM-DD or DD/MM/YYYY; impossible days are null."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    text = trim_all(as_key(c, kind))
    day = lambda shape, form: F.when(text.rlike(shape), F.try_to_date(text, form))
    return F.coalesce(day(r"^\d{8}$", "yyyyMMdd"), day(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), day(r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"))


def fold_label(c: Column) -> Column:
    """A label without accents, case and repeated spaces."""
    return F.lower(F.regexp_replace(F.translate(trim_all(c), ACCENTED, PLAIN), f"{WIDE_SPACE}+", " "))


def natural_key(c: Column) -> Column:
    """A text whose plain order puts numbers within labels in numeric order."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.concat_ws("\x01", F.transform(parts, lambda z: F.when(z.rlike(r"^\d+$"), F.lpad(z, 20, "0")).otherwise(F.lower(z))))


def epi_year(d: Column) -> Column:
    """The year of the epidemiological week (Sunday to Saturday, named by its Wednesday)."""
    return F.year(_wednesday(d))


def epi_week(d: Column) -> Column:
    return (F.floor((F.dayofyear(_wednesday(d)) - 1) / 7) + 1).cast("int")


def _wednesday(d: Column) -> Column:
    return F.date_add(d, (4 - F.dayofweek(d)).cast("int"))


def pad_start(c: Column, size: int, fill: str) -> Column:
    """Pads on the left; never shortens."""
    return F.when(F.length(c) < size, F.lpad(c, size, fill)).otherwise(c)


def municipality_code(c: Column) -> Column:
    """The six digits of a municipality code, null where it isn't one."""
    text = trim_all(c)
    return F.when(text.rlike(r"^\d{7}$"), F.substring(text, 1, 6)).when(text.rlike(r"^\d{1,6}$"), F.lpad(text, 6, "0"))


def state_of(code: Column) -> Column:
    """The state of a municipality code of six or seven digits."""
    state = F.substring(trim_all(code), 1, 2)
    return F.when(trim_all(code).rlike(r"^\d{6,7}$") & state.between("11", "53"), state)


def belongs_to_state(code: Column, state: str) -> Column:
    return (code == state) | code.startswith(state)


def local_number(c: Column) -> Column:
    """A number written as 1.234,5."""
    text = F.translate(F.regexp_replace(trim_all(c), r"\.", ""), ",", ".")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def round_half_away(c: Column, digits: int = 0) -> Column:
    return F.round(c, digits)


def normal_cdf(z: Column) -> Column:
    """The normal distribution, by a polynomial for erf with an error under 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    # Coefficients of Abramowitz and Stegun 7.1.26.
    poly = ((((F.lit(1.061405429) * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


# Bytes without a character in Windows-1252, which stand for themselves.
UNUSED_1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def encode_1252(text: str) -> bytes:
    """A text as Windows-1252; what that can't hold is an error that names it, never a ?."""
    parts = []
    for k, c in enumerate(text):
        try:
            parts.append(bytes([ord(c)]) if ord(c) in UNUSED_1252 else c.encode("cp1252"))
        except UnicodeEncodeError:
            raise ValueError(f"{c!r} (U+{ord(c):04X}) at {k} isn't in Windows-1252") from None
    return b"".join(parts)
