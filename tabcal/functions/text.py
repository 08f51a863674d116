"""Column expressions that clean free text and numeric text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

# Text that means "blank" (case-sensitive, after stripping).
BLANK_MARKERS = ("", " ", "NA", "N/A", "na", "n/a", "None", "none", "null", "Null", "nan", "NaN")
# Numeric text accepted by coercion, a number range, the first number in a cell.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
RANGE_TEXT = r"^\s*([+-]?\d+(?:\.\d+)?)\s*[-–]\s*([+-]?\d+(?:\.\d+)?)\s*$"
FIRST_NUMBER = r"(\d+\.?\d*)"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def blank_to_null(c: Column) -> Column:
    stripped = F.trim(c)
    return F.when(~stripped.isin(*BLANK_MARKERS), stripped)


def normalize_blanks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip text columns and turn blank markers into NULL."""
    chosen = set(columns if columns is not None else text_columns(df))
    return df.select(*[blank_to_null(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def lower_strip(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower-case and strip the chosen columns; NULL stays NULL."""
    return df.select(*[F.lower(F.trim(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def to_number(c: Column) -> Column:
    """Numeric coercion of text: anything that is not wholly a number becomes NULL."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column (done once, at the source)."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def first_number(c: Column) -> Column:
    """First number inside a text cell; no digits gives NULL."""
    return F.regexp_extract(c, FIRST_NUMBER, 1).try_cast("double")


def range_midpoint(c: Column) -> Column:
    """``'60 - 65'`` -> ``'62.5'``; anything else is returned unchanged (as text)."""
    low = F.regexp_extract(c, RANGE_TEXT, 1).try_cast("double")
    high = F.regexp_extract(c, RANGE_TEXT, 2).try_cast("double")
    return F.when(is_range(c), ((low + high) / 2).cast("string")).otherwise(c)


def is_range(c: Column) -> Column:
    return c.rlike(RANGE_TEXT)


def class_code(c: Column) -> Column:
    """Last character as a class code: ``...F`` -> ``class F``, ``...C`` -> ``class C``."""
    last = F.substring(F.trim(c), -1, 1)
    return F.when(last.isin("F", "C"), F.concat(F.lit("class "), last)).otherwise(last)


def title_case(c: Column) -> Column:
    """Capitalise each blank-separated word (letters after digits or hyphens stay lower)."""
    return F.initcap(F.lower(F.trim(c)))


def fill_constants(df: DataFrame, numeric: float | None = None, text: str | None = None) -> DataFrame:
    """Constant fill by column type."""
    if numeric is not None:
        df = df.fillna(numeric)
    if text is not None:
        df = df.fillna(text)
    return df


def number_column(df: DataFrame, name: str) -> Column:
    """A column as a double: numeric columns as they are, text through strict coercion."""
    if isinstance(df.schema[name].dataType, NumericType):
        return F.col(name).cast("double")
    return to_number(F.col(name))
