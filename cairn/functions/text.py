"""Text expressions that behave alike for every kind of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))


def strip(c: Column | str) -> Column:
    """The text without outer white space (any Unicode white space); null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text, never null."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def squeeze(c: Column | str) -> Column:
    """The text with all white space removed."""
    return F.translate(F.col(c) if isinstance(c, str) else c, WHITE_SPACE, "")
