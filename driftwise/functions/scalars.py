"""Column expressions on text, codes, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Fixed value: sentence ends (with white space behind) and line breaks.
SENTENCE_END = r"(?<=[。；;!?！？。!?.])\s+|\n+"


def strip(c: Column) -> Column:
    """Drops white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised_text(*columns: Column) -> Column:
    """Parts joined by spaces, null as empty, runs of any white space as one space, trimmed."""
    joined = F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.trim(F.regexp_replace(joined, SPACE, " "))


def sentences(text: Column) -> Column:
    """Non-blank sentences, trimmed."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda x: x != "")


def zero_filled(c: Column, width: int = 6) -> Column:
    """Left-padded with zeros; longer values stay as they are."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def code_of_number(c: Column, width: int = 6) -> Column:
    return zero_filled(c.cast("bigint").cast("string"), width)


def canonical_code(c: Column, width: int = 6) -> Column:
    """The padded form under which '2', '02' and '000002' are one code; others only lose outer space."""
    s = strip(c.cast("string"))
    bare = F.ltrim(s, F.lit("0"))
    return F.when(s.rlike("^[0-9]+$"), zero_filled(F.when(bare == "", "0").otherwise(bare), width)).otherwise(s)


def without_zeros(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def count_or_zero(c: Column) -> Column:
    """A non-negative double: text that is no number, null, NaN and negatives are 0."""
    number = c.try_cast("double")
    return F.greatest(F.nanvl(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def is_invalid_count(c: Column) -> Column:
    """Whether a value is there and is no number."""
    return c.isNotNull() & (c.try_cast("double").isNull() | F.isnan(c.try_cast("double")))


def year_of(c: Column) -> Column:
    """An int, or null where the value is no whole number."""
    number = c.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def date_of(c: Column) -> Column:
    """A date, or null where the value isn't one."""
    return c.try_cast("date")


def preview(c: Column, width: int = 200) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def short_model_name(name: str, known: dict[str, str] | None = None) -> str:
    """The name a model has in output files: a known short form, or its first part in lower case."""
    #: fixed values
    known = known or {
        "paraphrase-multilingual-MiniLM-L12-v2": "minilm",
        "distiluse-base-multilingual-cased-v2": "distiluse",
    }
    return known.get(name, name.split("-")[0].lower())


def short_model_name_of(c: Column) -> Column:
    """``short_model_name`` of a column of names without known short forms."""
    return F.lower(F.split_part(c, F.lit("-"), F.lit(1)))


def file_name(c: Column) -> Column:
    """A text as part of a file's name: spaces become underscores."""
    return F.replace(c, F.lit(" "), F.lit("_"))


def is_small_model(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("minilm"))
