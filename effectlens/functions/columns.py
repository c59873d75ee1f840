"""Column expressions that cleaning, encoding and resampling are built from.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__NA__"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
CURLY, STRAIGHT = "‘’“”", "''\"\""


def blank_to_null(c: Column) -> Column:
    """Null where a string is empty or white space only, in Unicode's sense."""
    return F.when(~F.coalesce(c.rlike(r"(?U)^\s*$"), F.lit(False)), c)


def to_number(c: Column) -> Column:
    """The double that a string spells, null for all else; also null for NaN."""
    value = F.when(c.cast("string").rlike(NUMBER), F.trim(c.cast("string")).try_cast("double"))
    return F.when(~F.isnan(value), value)


def nominal(c: Column, kind: str = "string") -> Column:
    """The category as a string.  Integral doubles read as integers, so that 1 and 1.0 are one level."""
    if kind in ("double", "float"):
        c = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, CURLY, STRAIGHT)


def ordinal_code(c: Column, levels: list, numeric: bool = False) -> Column:
    """The place of a value in its levels, from 0; null for missing and unknown values."""
    if numeric:
        at = F.array_position(F.array(*[F.lit(float(x)) for x in levels]), c.try_cast("double"))
    else:
        plain = [str(x).translate(str.maketrans(CURLY, STRAIGHT)) for x in levels]
        at = F.array_position(F.array(*[F.lit(x) for x in plain]), straight_quotes(c.cast("string")))
    return F.when(at > 0, (at - 1).cast("int"))


def hashed(*parts) -> Column:
    """md5 of the parts joined by |: an order that doesn't depend on partitioning, seed included."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts]))


def hash_index(n: Column, *parts) -> Column:
    """A number from 0 to n - 1 that the parts decide."""
    return F.pmod(F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("long"), n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(c: Column) -> Column:
    """The letters, digits and underscores of a name."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "")


def recode_missing(c: Column) -> Column:
    """Display label of a discrete value: missing and NaN spellings are one level."""
    return F.when(c.isNull() | c.isin("nan", "NaN"), MISSING).otherwise(c)


def stratum(type_a: Column, type_b: Column) -> Column:
    """The noise stratum of an effect: its feature's type, or both features' types in order."""
    pair = F.concat_ws("_", F.lit("interaction"), F.array_sort(F.array(F.coalesce(type_a, F.lit("continuous")), F.coalesce(type_b, F.lit("continuous")))))
    return F.when(type_b.isNull(), F.concat(F.lit("singleton_"), F.coalesce(type_a, F.lit("continuous")))).otherwise(pair)
