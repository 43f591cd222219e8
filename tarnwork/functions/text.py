"""Lenient text functions: Unicode trimming, tokens, coercions that never raise. Each takes and gives a Column."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates tokens of a list in a text cell.
SEPARATOR = r"[、,，;；/](?U:\s)*"
HAN = r"[\u4e00-\u9fff]"


def utrim(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return none_if_empty(utrim(c))


def none_if_empty(c: Column) -> Column:
    """regexp_extract says '' for no match; the rules want null. A comparison would compute c twice; as an element it is computed once."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def tokens(c: Column) -> Column:
    """Trimmed, non-empty tokens of a text, in order, repeated ones kept; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATOR), utrim), lambda x: x != "")


def list_tokens(c: Column) -> Column:
    """The same for an array; a null element is the text None."""
    return F.filter(F.transform(c, lambda x: utrim(F.coalesce(x, F.lit("None")))), lambda x: x != "")


def join_list(c: Column, sep: str = "、") -> Column:
    """An array's non-blank elements as one text; null if there are none."""
    return none_if_empty(F.array_join(F.filter(F.transform(c, utrim), lambda x: x != ""), sep))


def first_int(c: Column) -> Column:
    """The first whole number of a text; null if there is none or it is negative."""
    n = F.regexp_extract(c, r"(-?\d+)", 1).try_cast("long")
    return F.when(n >= 0, n)


def rounded_int(c: Column) -> Column:
    """A number rounded half to even; null if negative."""
    n = F.bround(c, 0).cast("long")
    return F.when(n >= 0, n)


def number(c: Column) -> Column:
    """A cell as double; null for blank and for what is no number."""
    return none_if_empty(F.trim(c)).try_cast("double")


def date_millis(c: Column) -> Column:
    """A cell as epoch milliseconds: seconds are scaled up, a text counts by its first ten characters."""
    n = c.try_cast("double")
    day = F.unix_millis(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    return F.when(n.isNotNull(), F.when(n > 1e11, n.cast("long")).otherwise((n * 1000).cast("long"))).otherwise(day)


def shown_millis(c: Column, form: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(c), form), F.lit("—"))


def any_in(text: Column, words) -> Column:
    """Whether the text holds one of the words."""
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])


def words_in(text: Column, words) -> Column:
    """The words that a text holds, letters in either case, longest first. The text is lowered once, not once per word."""
    order = F.array(*[F.lit(w) for w in sorted(set(words), key=lambda w: (-len(w), w))])
    return F.flatten(F.transform(F.array(F.lower(text)), lambda low: F.filter(order, lambda w: F.contains(low, F.lower(w)))))


def han_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, HAN.replace("[", "[^"), ""))


def odd_words(words: Column, long: int, han: tuple[int, int], latin_exempt: bool = False) -> Column:
    """Words with too few or too many Han characters, or (unless exempt) too many characters."""
    over = lambda w: F.length(w) > long
    plain = F.lit(False) if latin_exempt else None
    return F.filter(words, lambda w: F.when(han_count(w) == 0, over(w) if plain is None else plain).otherwise(~han_count(w).between(*han) | over(w)))


def stripped_markup(c: Column) -> Column:
    """Text of marked-up paragraphs: ends of paragraphs and breaks become line ends, tabs stay, all other tags go."""
    c = F.regexp_replace(c, r"(?i)</(?:w:)?p>|<(?:w:)?br[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<w:tab[^>]*>", "\t"), r"(?s)<[^>]*>", "")
