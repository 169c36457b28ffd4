"""Key normal forms as built-in column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"(?U)^\s+|\s+$"
_PLAIN = r"^[1-9][0-9]*$"
#: A whole number in any notation without exponent; $1$2 is its plain form.
_WHOLE = r"^(?:\+|(-)(?!0*(?:\.0*)?$))?-?0*([0-9]+)(?:\.0*)?$"
_EXPONENT = r"^[+-]?[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+$"
_NONE = r"(?i)^(nan|none|<na>)?$"


def _integer_text(c: Column) -> Column:
    """Plain digits of a double that holds a whole number, else its text."""
    exact = (c == F.floor(c)) & (F.abs(c) < F.lit(float(2**63)))
    return F.when(exact, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def key_form(c: Column, dtype: T.DataType | None = None) -> Column:
    """The canonical text of a key.

    Text is trimmed; blank, nan, none and <na> in any case become NULL; whatever reads as a
    whole number ("0042", "42.0", "4.2e1") becomes that integer in plain digits; other text
    stays.  `dtype` lets integer, float and text columns take their shortest way.
    """
    if isinstance(dtype, T.IntegralType):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(d.isNull() | F.isnan(d), F.lit(None)).otherwise(_integer_text(d))
    text = c.cast("string")
    t = F.regexp_replace(text, _SPACE, "")
    power = t.try_cast("double")
    return (
        F.when(text.rlike(_PLAIN), text)
        .when(t.rlike(_NONE), F.lit(None))
        .when(t.rlike(_EXPONENT) & (power == F.floor(power)) & (F.abs(power) < 2.0**53), power.cast("decimal(20,0)").cast("string"))
        .otherwise(F.regexp_replace(t, _WHOLE, "$1$2"))
    )


def key_text(c: Column, dtype: T.DataType) -> Column:
    """The plain text of a key column; float columns are refused because 1.0 and 1 would differ."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        raise ValueError("a float column can't be a key: cast it to an integer or a string first")
    return c.cast("string")


def target_key_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a target's key: NULL and NaN stay NULL, 1.0 becomes "1", 1.5 is an error at run time."""
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    d = c.cast("double")
    bad = F.raise_error(F.concat(F.lit("not a whole number in a key column: "), d.cast("string"))).cast("string")
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string")).when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(bad)


def float_id_text(c: Column) -> Column:
    """Benchmark ids stored as floats: 123.0 -> "123", NaN -> NULL, 123.5 -> "123.5"."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string")).otherwise(_integer_text(d))


def fresh(name: str, *frames) -> str:
    """`name`, with underscores added until no frame has such a column (case-insensitively)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
