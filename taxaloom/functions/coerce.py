"""Cells to values. Every function is total: what does not parse is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0b"


def strip(v: Column) -> Column:
    return F.btrim(v, F.lit(SPACE))


def is_blank(v: Column) -> Column:
    """Null, empty or exactly NA: the rule of nested loading and of curated joins."""
    return v.isNull() | strip(v).isin("", "NA")


def clean(v: Column) -> Column:
    """The stripped cell, or null where blank."""
    return F.when(~is_blank(v), strip(v))


def clean_text(v: Column) -> Column:
    """The stripped cell, or empty where it is null, NA or NULL in any case: the rule of the relational split."""
    return F.when(v.isNull() | F.upper(strip(v)).isin("", "NA", "NULL"), F.lit("")).otherwise(strip(v))


def to_int(v: Column) -> Column:
    """A whole number with an optional sign, its digits grouped by single underscores if at all."""
    s = clean(v)
    return F.when(s.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))


def to_float(v: Column) -> Column:
    s = clean(v)
    number = "[0-9]+(_[0-9]+)*"
    plain = s.rlike(rf"^[+-]?({number}\.?({number})?|\.{number})([eE][+-]?{number})?$")
    word = s.rlike(r"^[+-]?(?i:inf|infinity|nan)$")
    return F.when(plain, F.replace(s, F.lit("_"), F.lit("")).try_cast("double")).when(word, F.regexp_replace(F.lower(s), "^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))


def to_bool(v: Column) -> Column:
    s = F.lower(strip(v))
    return F.when(s.isin("true", "yes"), True).when(s.isin("false", "no"), False)


def to_date_text(v: Column) -> Column:
    """`5 March 2020` as 2020-03-05; anything else as it stands; blank as null."""
    s = clean(v)
    return F.coalesce(F.date_format(F.try_to_timestamp(s, F.lit("d MMMM yyyy")), "yyyy-MM-dd"), s)


def to_member(v: Column, allowed: Sequence[str]) -> Column:
    """The vocabulary's spelling of the cell: an exact member first, else one that differs in case."""
    s = clean(v)
    by_case = F.create_map(*[F.lit(x) for a in allowed for x in (a.lower(), a)])
    return F.when(s.isin(*allowed), s).otherwise(F.try_element_at(by_case, F.lower(s)))


def to_members(v: Column, allowed: Sequence[str]) -> Column:
    """Members of an array, in order and with repeats; the others are dropped."""
    return F.filter(F.transform(v, lambda x: to_member(x, allowed)), lambda x: x.isNotNull())


def let(value: Column, body) -> Column:
    """What body makes of a value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_if_empty(v: Column) -> Column:
    """An empty list as null."""
    return let(v, lambda x: F.when(F.size(x) > 0, x))


def citation_mode(pmid: Column) -> Column:
    return F.when(is_blank(pmid), "Manual").otherwise("Auto")


def region_bounds(v: Column) -> tuple[Column, Column]:
    """First and, of more than one digit, last digit of an all-digit cell."""
    s = clean(v)
    digits = s.rlike("^[0-9]+$")
    return F.when(digits, F.substring(s, 1, 1)), F.when(digits & (F.length(s) > 1), F.right(s, F.lit(1)))


def human_size(n: Column) -> Column:
    """Bytes with a unit, in steps of 1024; a tie in the last digit goes to the even one."""
    x = n.cast("double")
    return (
        F.when(x < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(x < 1024**2, F.format_string("%.1f KB", F.bround(x / 1024, 1)))
        .when(x < 1024**3, F.format_string("%.1f MB", F.bround(x / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(x / 1024**3, 1)))
    )


def direction(v: Column) -> Column:
    s = F.lower(strip(v))
    return F.when(s.isin("increased", "decreased"), s)


def text_list(v: Column, many: Column) -> Column:
    """A string or an array of strings as an array without blanks."""
    return F.filter(F.coalesce(many, F.when(v.isNotNull(), F.array(v)), F.array().cast("array<string>")), lambda x: strip(x) != "")


def retry_after(v: Column) -> Column:
    """Seconds of a header: a number that is not negative, else null."""
    x = to_float(v)
    return F.when(x >= 0, x)
