"""Text helpers.  Case-insensitive matching is Unicode-aware everywhere."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, functions as F

from deskgauge.constants import (
    FILL_LOCATION,
    LOCATIONS,
    PATTERN_GREETING,
    PATTERN_HTML_TAG,
    PATTERN_RDV_DATE,
)

# Only a line feed ends a line for "." and "$"; case is ignored in all scripts.
_UNIX_LINES = "(?d)"
_IGNORE_CASE = "(?iud)"
_BLANK = r"^[\s\x1C-\x1F\p{IsWhite_Space}]*$"
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
_CASE_IGNORABLE = r"\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}'.:\x{B7}\x{2018}\x{2019}\x{2024}\x{2027}"

# Precomposed Hangul syllables decompose by arithmetic, not by table.
_HANGUL_FIRST, _HANGUL_COUNT = 0xAC00, 11172
# Code points beyond these neither decompose nor are marks.
_LETTER_PLANES = (range(0x80, 0x30000), range(0xE0000, 0xE1000))
_HANGUL_LEADS = "".join(chr(0x1100 + i) for i in range(19))
_HANGUL_VOWELS = "".join(chr(0x1161 + i) for i in range(21))
_HANGUL_TAILS = "".join(chr(0x11A8 + i) for i in range(27))


def _base_letters(text: str) -> str:
    decomposed = unicodedata.normalize("NFD", text)
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """(letters, their single base letters, letters with several base letters).

    Derived from the Unicode database; letters without a counterpart at the
    end of the first string are the combining marks, which are deleted.
    """
    single, several, marks = {}, {}, []
    for code in chain(*_LETTER_PLANES):
        if 0xD800 <= code < 0xE000 or 0 <= code - _HANGUL_FIRST < _HANGUL_COUNT:
            continue
        letter = chr(code)
        base = _base_letters(letter)
        if base == letter:
            continue
        if not base:
            marks.append(letter)
        elif len(base) == 1:
            single[letter] = base
        else:
            several[letter] = base
    return "".join(single) + "".join(marks), "".join(single.values()), several


def sql_text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(entries: dict[str, str]) -> Column:
    """A map literal, in one expression instead of one per entry."""
    return F.expr("map(" + ", ".join(
        sql_text(part) for entry in entries.items() for part in entry
    ) + ")")


def strip_accents(column: Column) -> Column:
    """Canonical decomposition without its nonspacing marks, without Python.

    ASCII text, the common case, is passed through by one regular expression;
    other text goes through one ``translate``.  Only text with Hangul
    syllables or the few letters that decompose into several base letters
    is first expanded letter by letter.
    """
    letters, bases, several = _accent_tables()
    pairs = literal_map(several)

    def expand(letter: Column) -> Column:
        index = F.ascii(letter) - _HANGUL_FIRST
        tail = index % 28
        syllable = F.concat(
            F.substring(F.lit(_HANGUL_LEADS), (F.floor(index / 588) + 1).cast("int"), F.lit(1)),
            F.substring(F.lit(_HANGUL_VOWELS), (F.floor(index % 588 / 28) + 1).cast("int"), F.lit(1)),
            F.when(tail == 0, F.lit("")).otherwise(
                F.substring(F.lit(_HANGUL_TAILS), tail.cast("int"), F.lit(1))
            ),
        )
        is_syllable = (index >= 0) & (index < _HANGUL_COUNT)
        return F.when(is_syllable, syllable).otherwise(
            F.coalesce(F.try_element_at(pairs, letter), letter)
        )

    # Ranges around the letters to expand: expanding more text is harmless.
    needs_expanding = column.rlike(r"[\x{980}-\x{1BFF}가-힣\x{11300}-\x{1D1FF}]")
    expanded = F.array_join(F.transform(F.split(column, ""), expand), "")
    stripped = F.translate(
        F.when(needs_expanding, expanded).otherwise(column), letters, bases
    )
    return F.when(column.rlike(r"[^\x00-\x7F]"), stripped).otherwise(column)


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, PATTERN_HTML_TAG, "")


def strip_greeting(column: Column) -> Column:
    return F.regexp_replace(column, _IGNORE_CASE + PATTERN_GREETING, "")


def never_null(condition: Column, *columns: Column) -> Column:
    """The condition, false where one of ``columns`` is null.

    Written with IS NOT NULL, not ``coalesce``, so that the condition and its
    negation still reach the parquet reader and runtime filters.
    """
    for column in columns:
        condition = column.isNotNull() & condition
    return condition


def matches(column: Column, pattern: str) -> Column:
    """Pattern found anywhere, ignoring case; null does not match."""
    return never_null(column.rlike(_IGNORE_CASE + pattern), column)


def contains(column: Column, literal: str) -> Column:
    return never_null(column.contains(literal), column)


def startswith(column: Column, prefix: str) -> Column:
    return never_null(column.startswith(prefix), column)


def member(column: Column, values) -> Column:
    """``isin`` that is false, not null, for a null column."""
    return never_null(column.isin(*values), column)


def title_case(column: Column) -> Column:
    """Capital after every character that is not a letter with case.

    ``initcap`` alone only capitalises after blanks, so it is applied to each
    run of cased letters.  A capital sigma inside a word, seen across marks
    and apostrophes, is lowered first because a run would end there.
    """
    inner_sigma = rf"(?<=[{_CASED}])Σ(?=[{_CASE_IGNORABLE}]*[{_CASED}])"
    lowered = F.regexp_replace(column, inner_sigma, "σ")
    runs = F.regexp_extract_all(lowered, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def upper(column: Column) -> Column:
    """Full case mapping: a sharp s becomes two letters."""
    return F.upper(column)


def joined(*parts: Column | str) -> Column:
    """Columns and plain texts as one text; null if a column is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def whole_number(column: Column) -> Column:
    """The number a text shows; null if it shows none."""
    return column.try_cast("bigint")


def shown(column: Column) -> Column:
    return column.cast("string")


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def sentinel_to_null(column: Column) -> Column:
    return F.when((column == "N/A") | column.contains("<NA>"), None).otherwise(column)


def blank_to_null(column: Column) -> Column:
    return F.when(column.rlike(_BLANK), None).otherwise(column)


def display_location(column: Column) -> Column:
    """Known locations by their displayed name, others unchanged, null filled."""
    known = F.try_element_at(literal_map(LOCATIONS), column)
    return F.coalesce(known, column, F.lit(FILL_LOCATION))


def rdv_date_text(column: Column) -> Column:
    """First ``dd?MM?yyyy`` that follows a colon; null when there is none."""
    return F.nullif(
        F.regexp_extract(column, _UNIX_LINES + PATTERN_RDV_DATE, 1), F.lit("")
    )
