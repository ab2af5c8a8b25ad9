"""Words of a text, as DataFrame expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words: ASCII characters that are no letters or digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    t = F.coalesce(text, F.lit(""))
    # of a text with nothing but ASCII these are the same, and the first is faster
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def normalised(text: Column) -> Column:
    """The words of a lower-cased text, each with a space before and one behind the last (no words: one space)."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), BETWEEN, " ")
