"""Content predicates over text columns, in integers only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make up text, and those of words alone, as regular-expression classes.
TEXTY, WORDY = r"[A-Za-z0-9À-ɏ \t\r\n.,;:!?'\"()/_-]", r"[A-Za-zÀ-ɏ ]"


def count_of(text: Column, literal: str) -> Column:
    """Occurrences of a single character."""
    return (F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))).cast("long")


def count_class(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def share(part: Column, whole: Column) -> Column:
    """Percent, rounded down, with one added to both so that nothing is divided by zero."""
    return F.floor((part + 1) * 100 / (whole + 1)).cast("long")


def is_text(s9d: Column, s19: Column) -> Column:
    return (s9d >= 88) | ((s9d > 79) & (s19 > 79))


def insert_lf_fits(mean_line: Column) -> Column:
    return mean_line.between(30, 80)


def html_fits(gt: Column, lt: Column, slash: Column) -> Column:
    return (F.floor(gt / 3) <= slash) & (lt - F.shiftright(lt, 4) <= gt)


def enough_digits(n: Column, digits: Column) -> Column:
    return F.shiftright(n, 5) <= digits


def mostly_digits(n: Column, digits: Column) -> Column:
    return F.shiftright(n, 1) + 1024 <= digits


def crlf_fits(n: Column, lf: Column, cr: Column) -> Column:
    return (F.shiftright(n, 7) <= lf) & (lf <= F.shiftright(n, 3)) & (cr - F.shiftright(cr, 6) <= lf) & (lf <= F.shiftright(cr, 6) + cr)


def dotted_numbers(text: Column) -> Column:
    """Whole numbers from 1 to 255 that a dot follows."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+)\."), F.lit(1))
    return F.size(F.filter(found, lambda x: F.regexp_replace(x, "^0+", "").rlike("^([1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))).cast("long")


def text_flags(flags: dict[str, Column]) -> Column:
    """The mask of the transforms that a text calls for, in the order in which they are asked: line ends, line feeds, numbers, markup."""
    first = F.when(flags["crlf"], 1).otherwise(0) + F.when(flags["lf"], 2).otherwise(0)
    number = F.when(flags["number1"] & flags["number2"], 16).otherwise(0)
    html = F.when(flags["html"], 4).otherwise(0)
    later = F.when((first > 0) | flags["enough_digits"], number + html).otherwise(0)
    return F.when(flags["text"], first + later).otherwise(0)
