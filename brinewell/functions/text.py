"""String functions with Python's Unicode rules, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip and \s see it, and word characters as \w sees them.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_pattern(pattern: str) -> str:
    r"""A case-insensitive pattern whose \b, \s and . mean in Java what they mean in Python."""
    return "(?iud)" + pattern.replace(r"\b", _BOUNDARY).replace(r"\s", SPACE)


#: The characters of SPACE.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


#: Letters outside ASCII that match an ASCII one where case is ignored.
_LOOKALIKES = "\u017f\u212a\u0131\u0130"


def matches(c: Column, *patterns: str, needs: tuple[str, ...] = ()) -> Column:
    """Whether any of the patterns is found.

    ``needs``: lower-case words of which every match holds one. They are sought
    first, as plain bytes; most texts have none and run no pattern.
    """
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(java_pattern(p))
    if needs:
        held = F.lit(False)
        for word in needs:
            held = held | F.contains(F.lower(c), F.lit(word))
        for letter in _LOOKALIKES:
            held = held | F.contains(c, F.lit(letter))
        found = held & found
    return found


def drop_kind_prefix(c: Column) -> Column:
    """An id without one leading ``t1_`` or ``t3_``."""
    return F.regexp_replace(c, "^(t1_|t3_)", "")


def fold(c: Column) -> Column:
    """Case folding of community names; these are ASCII, where it equals lower case."""
    return F.lower(c)
