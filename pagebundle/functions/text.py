"""Text preparation: folding, counting, previews and file names (Column -> Column)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.functions.bind import bind

# Characters a Unicode-aware "\s" accepts (the ASCII ones include 1C-1F).
# Runs of them that are not already one plain space; single members are listed one by
# one because the regex engine then tests a character with one table lookup.
_BREAKS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
ASCII_SPACES = rf"[{_BREAKS} ]++(?<=[{_BREAKS}]|[{_BREAKS} ]{{2}})"
UNICODE_SPACES = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition restricted to ASCII, per code point.

    Returns the one-to-one pairs as two aligned strings and the expansions
    ("fi" ligature, "1/2", ellipsis ...) as pairs. All other non-ASCII code
    points vanish.
    """
    source, target, expansions = ["ł", "Ł"], ["l", "L"], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if char in "łŁ" or not folded:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            expansions.append((char, folded))
    return "".join(source), "".join(target), tuple(expansions)


def _expand(col: Column) -> Column:
    """Replace the code points that fold to several ASCII characters."""
    _, _, pairs = _folding()
    # one constant, folded into a map when the plan is optimised
    listing = "\x01".join(f"{char}\x02{folded}" for char, folded in pairs)
    table = F.str_to_map(F.lit(listing), F.lit("\x01"), F.lit("\x02"))
    return F.array_join(
        F.transform(
            F.split(col, ""),
            lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(table[c], F.lit(""))),
        ),
        "",
    )


def fold_to_ascii(col: Column) -> Column:
    source, target, pairs = _folding()
    several = "".join(char for char, _ in pairs)

    def folded(simple: Column) -> Column:
        # a hash lookup per character; a regex class of 445 members is far slower
        expands = F.length(F.translate(simple, several, "")) < F.length(simple)
        expanded = F.when(expands, _expand(simple)).otherwise(simple)
        return F.regexp_replace(expanded, r"[^\x00-\x7F]+", "")

    bound = bind(F.translate(col, source, target), folded)
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(bound)


def normalize_text(col: Column) -> Column:
    """Fold to ASCII, upper-case, collapse white space, strip."""
    upper = F.upper(fold_to_ascii(col))
    return F.trim(F.regexp_replace(upper, ASCII_SPACES, " "))


def fold_ocr_digits(col: Column) -> Column:
    # plain substring replacement beats translate(), which looks up every character
    for digit, letter in zip(fixed.OCR_DIGITS, fixed.OCR_LETTERS):
        col = F.replace(col, F.lit(digit), F.lit(letter))
    return col


def header_zone(norm: Column, chars: int = 1200) -> Column:
    return fold_ocr_digits(F.substring(norm, 1, chars))


def alnum_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))


def has_alnum(col: Column, at_least: int) -> Column:
    """alnum_count(col) >= at_least, without reading further than needed."""
    if at_least <= 0:
        return col.isNotNull()
    return col.rlike(rf"(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{at_least}}}")


def page_preview(col: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(col, UNICODE_SPACES, " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit), F.lit("..."))
    )


def document_file_name(document_type: Column, start: Column, end: Column) -> Column:
    safe = F.translate(document_type, " /\\:", "____")
    return F.format_string(fixed.DOCUMENT_FILE_NAME, safe, start, end)


def derive_name(name: Column, suffix: str) -> Column:
    stem = F.regexp_replace(name, r"(?is)\.pdf\z", "")
    return F.concat(stem, F.lit(suffix + ".pdf"))


def clean_file_name(col: Column) -> Column:
    """Last path segment of either separator style, stripped."""
    segments = F.split(F.translate(F.coalesce(col, F.lit("")), "\\", "/"), "/")
    return strip(F.element_at(segments, -1))


def strip(col: Column) -> Column:
    edge = UNICODE_SPACES
    return F.regexp_replace(col, f"^{edge}|{edge}$", "")


def is_pdf_name(col: Column) -> Column:
    return F.lower(col).endswith(".pdf")


def two_decimals(col: Column) -> Column:
    """Two-place rendering rounded from the exact binary value, ties to even.

    200*x is the exact sum of three power-of-two multiples, so comparing it with
    an odd integer tells on which side of a rounding midpoint x lies.
    """

    def render(x: Column) -> Column:
        a, b, c = x * F.lit(128.0), x * F.lit(64.0), x * F.lit(8.0)
        s = a + b
        lost_s = (a - (s - (s - a))) + (b - (s - a))
        t = s + c
        lost_t = (s - (t - (t - s))) + (c - (t - s))
        r = F.floor(x * F.lit(100.0) + F.lit(0.5))
        below = (t - (r * 2 - 1)) + (lost_s + lost_t)
        above = (t - (r * 2 + 1)) + (lost_s + lost_t)
        odd = F.pmod(r, F.lit(2)) == 1
        cents = (
            F.when((below < 0) | ((below == 0) & odd), r - 1)
            .when((above > 0) | ((above == 0) & odd), r + 1)
            .otherwise(r)
        )
        return F.concat(
            F.floor(cents / 100).cast("string"),
            F.lit("."),
            F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
        )

    return bind(col, render)


def json_string_array(col: Column) -> Column:
    """Array of strings as JSON with ", " between items."""
    return F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                col,
                lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", ""),
            ),
            ", ",
        ),
        F.lit("]"),
    )
