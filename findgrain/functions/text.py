"""Unicode helpers as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = r"[^\x00-\x7F]"
BLANK_EDGES = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def nfc(c: Column) -> Column:
    """Canonical composition. Only text outside ASCII pays for it; null stays null.

    The composing function is the ICU one that Spark itself ships for collations, so rows stay in the JVM.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(NON_ASCII), composed).otherwise(c)


def strip_blank(c: Column) -> Column:
    """Trims every Unicode blank, not only U+0020."""
    return F.when(c.rlike(BLANK_EDGES), F.regexp_replace(c, BLANK_EDGES, "")).otherwise(c)


def fold_term(c: Column) -> Column:
    """Composed, lower-cased, trimmed; blank becomes null."""
    folded = strip_blank(F.lower(nfc(c)))
    return F.nullif(folded, F.lit(""))
