"""Templates with {name} placeholders as column expressions over text columns.

A placeholder may index a character ({name[0]}), convert (!s, !r, !a) and carry a format
of texts: [[fill]align][0][width][.precision][s]. Everything else is a fault of the
template, also formats that hold placeholders of their own.
"""

from __future__ import annotations

import re
from functools import reduce
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagebundle.functions.bind import bind

_FIELD = re.compile(r"(\w+)(?:\[([0-9]+)\])?", re.ASCII)
_SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<zero>0)?(?P<width>[0-9]+)?(?:\.(?P<cut>[0-9]+))?s?", re.DOTALL
)
_MAX_SIZE = 2**31 - 1
# what a representation escapes: everything unprintable, or everything beyond ASCII
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_BEYOND_ASCII = r"[^\x20-\x7E]"


def _escaped(value: Column, unsafe: str) -> Column:
    def escape(char: Column) -> Column:
        code = F.ascii(char)
        digits = F.lower(F.hex(code))
        return (
            F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    safe = F.transform(chars, lambda c: F.when(c.rlike(unsafe), escape(c)).otherwise(c))
    return F.when(value.rlike(unsafe), F.array_join(safe, "")).otherwise(value)


def representation(value: Column, unsafe: str = _UNPRINTABLE) -> Column:
    """The text as a quoted literal, in double quotes where it holds single ones alone."""

    def quoted(v: Column) -> Column:
        double = F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"'))
        quote = F.when(double, F.lit('"')).otherwise(F.lit("'"))
        inner = F.replace(v, F.lit("\\"), F.lit("\\\\"))
        inner = F.when(double, inner).otherwise(F.replace(inner, F.lit("'"), F.lit("\\'")))
        for char, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            inner = F.replace(inner, F.lit(char), F.lit(name))
        return F.concat(quote, bind(inner, lambda i: _escaped(i, unsafe)), quote)

    return bind(value, quoted)


def _laid_out(value: Column, spec: str) -> Column:
    found = _SPEC.fullmatch(spec)
    if found is None:
        raise ValueError(f"format {spec!r} is not one of texts")
    fill, zero, width, cut = found["fill"], found["zero"], found["width"], found["cut"]
    if fill is not None and zero:  # with a fill of its own, a zero only begins the width
        width = zero + (width or "")
    fill = fill or ("0" if zero else " ")
    size, end = int(width or 0), int(cut) if cut is not None else None
    if max(size, end or 0) > _MAX_SIZE:
        raise ValueError(f"format {spec!r} is too large")
    if end is not None:
        value = F.substring(value, 1, end)
    if not size:
        return value

    def padded(v: Column) -> Column:
        missing = F.greatest(F.lit(size) - F.length(v), F.lit(0))
        before = {">": missing, "^": F.floor(missing / 2).cast("int")}.get(found["align"], F.lit(0))
        return F.concat(F.repeat(F.lit(fill), before), v, F.repeat(F.lit(fill), missing - before))

    return bind(value, padded)


def compile_template(template: str, names: tuple[str, ...]) -> tuple[Column, Column]:
    """(text, fits) of a template over text columns; ValueError where it is faulty.

    ``fits`` is false on rows where an indexed character does not exist.
    """
    parts: list[Column] = []
    fits: list[Column] = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        named = _FIELD.fullmatch(field)
        if named is None or named[1] not in names:
            raise ValueError(f"unknown placeholder {field!r}")
        value = F.col(named[1])
        if named[2] is not None:
            at = int(named[2])
            if at >= _MAX_SIZE:
                raise ValueError(f"index {at} is too large")
            fits.append(F.length(value) > at)
            value = F.substring(value, at + 1, 1)
        if conversion not in (None, "s", "r", "a"):
            raise ValueError(f"unknown conversion {conversion!r}")
        if conversion in ("r", "a"):
            value = representation(value, _UNPRINTABLE if conversion == "r" else _BEYOND_ASCII)
        parts.append(_laid_out(value, spec) if spec else value)
    text = F.concat(*parts) if parts else F.lit("")
    return text, reduce(lambda a, b: a & b, fits, F.lit(True))


def template_fault(template: str, names: tuple[str, ...]) -> str | None:
    """Why a template cannot be used, or None."""
    try:
        compile_template(template, names)
    except ValueError as fault:
        return str(fault)
    return None
