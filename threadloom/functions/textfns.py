"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of letter or symbol categories that show nothing (fillers, blank braille, grapheme joiner).
_FILLERS = r"\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}"


def strip(text: Column) -> Column:
    """Outer white space off, as Unicode and Python see it (information separators included)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def has_visible(text: Column) -> Column:
    """Whether a text has a visible character; false for null."""
    return F.coalesce(text.rlike(rf"(?U)[^\s\p{{Cc}}\p{{Cf}}{_FILLERS}]"), F.lit(False))


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])
