"""Text normalisation as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgate.constants import WHITESPACE

# U+FF01..U+FF5E sit at a fixed offset above ASCII; U+3000 is the wide space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + chr(0x3000)
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_ASCII_SPACES = "\t\n\x0b\f\r "
# Characters that need the full treatment: wide forms and whitespace outside ASCII.
_UNUSUAL = r"[\x{FF01}-\x{FF5E}" + WHITESPACE.split(r"\x20")[1]
_WIDE_FORM = r"[\x{FF01}-\x{FF5E}\x{3000}]"


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fullwidth_to_halfwidth(c: Column) -> Column:
    """Map wide ASCII forms and the wide space down; text without any passes untouched."""
    return F.when(_is_ascii(c) | ~c.rlike(_WIDE_FORM), c).otherwise(F.translate(c, _WIDE, _NARROW))


def ascii_lower(c: Column) -> Column:
    """Lower A-Z only. On pure ASCII text the built-in `lower` is the same and faster."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def _map_characters(c: Column) -> Column:
    wide_upper = "".join(chr(ord(u) + 0xFEE0) for u in _UPPER)
    plain = [(w, n) for w, n in zip(_WIDE, _NARROW) if w not in wide_upper]
    source = "".join(w for w, _ in plain) + wide_upper + _UPPER
    target = "".join(n for _, n in plain) + _UPPER.lower() * 2
    return F.when(_is_ascii(c), F.lower(c)).otherwise(F.translate(c, source, target))


def _drop_ascii_spaces(c: Column) -> Column:
    for space in _ASCII_SPACES:
        c = F.replace(c, F.lit(space), F.lit(""))
    return c


def normalize(c: Column, mode: str = "collapse") -> Column:
    """Narrow wide forms, lower ASCII, then treat whitespace.

    mode: "collapse" = runs become one space and ends are trimmed, "preserve" = kept,
    "strip" = removed.
    """
    mapped = _map_characters(c)
    if mode == "preserve":
        return mapped
    if mode == "strip":
        return F.when(_is_ascii(c), _drop_ascii_spaces(F.lower(c))).otherwise(
            F.regexp_replace(mapped, WHITESPACE + "+", "")
        )
    if mode == "collapse":
        return F.trim(F.regexp_replace(mapped, WHITESPACE + "+", " "))
    raise ValueError(f"unknown whitespace mode: {mode}")


def match_text(c: Column, case_sensitive: bool = False) -> Column:
    """The text on which wordlist entries are searched and spans are counted.

    Most texts hold neither wide forms nor whitespace outside ASCII; for them byte-wise
    replacements do, without a regex pass. Lower-casing at the end covers the ASCII step.
    """
    if case_sensitive:
        return normalize(c, "strip")
    full = F.regexp_replace(F.translate(c, _WIDE, _NARROW), WHITESPACE + "+", "")
    usual = _is_ascii(c) | ~c.rlike(_UNUSUAL)
    return F.lower(F.when(usual, _drop_ascii_spaces(c)).otherwise(full))


def text_windows(c: Column, size: int, overlap: int) -> Column:
    """Cut a text into windows of `size` code points, each extended by `overlap`.

    Window j starts at code point j*size, so positions inside windows translate back
    exactly and no occurrence of up to overlap+1 characters is lost at a border.
    Reaching code point p inside one string costs O(p); texts of ordinary length are
    cut by offset, longer ones by one linear regex pass.
    """
    if overlap > size:
        raise ValueError("overlap must not exceed the window size")
    length = F.char_length(c)
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size))
    by_offset = F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size + overlap)))
    parts = F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % size), F.lit(0))

    def extend(cut: Column) -> Column:
        return F.transform(
            cut,
            lambda part, j: F.concat(
                part, F.coalesce(F.substring(F.get(cut, j + 1), 1, overlap), F.lit(""))
            ),
        )

    # The parts are bound to a variable: written out, each window would cut the text anew.
    by_pass = F.get(F.transform(F.array(parts), extend), F.lit(0))
    return F.when(length <= 16 * size, by_offset).otherwise(by_pass)
