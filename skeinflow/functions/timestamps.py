"""Tolerant timestamp parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """A timestamp from RFC 3339, RFC 2822, ISO forms without a zone (UTC), ``... UTC`` or the form of JavaScript's Date; else null.

    Needs a session in UTC for the forms that name no zone.
    """
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},?\s+", "")
    script = F.regexp_replace(F.regexp_replace(bare, r"\s*\(.*\)\s*$", ""), r"GMT([+-])", "GMT$1")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(F.regexp_replace(text, r"\s+UTC$", "Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(script, F.lit("MMM dd yyyy HH:mm:ss 'GMT'xx")),
    )
