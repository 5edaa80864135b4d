"""Small scalar formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_commas(number: Column) -> Column:
    return F.format_number(number.cast("long"), 0)


def duration(seconds: Column) -> Column:
    """`1d 2h 3m 4s`, without leading zero parts."""
    seconds = seconds.cast("long")
    parts = [(F.floor(seconds / 86400), "d"), (F.floor(seconds / 3600) % 24, "h"), (F.floor(seconds / 60) % 60, "m")]
    shown = [F.when(seconds >= size, F.concat(value.cast("string"), F.lit(unit))) for (value, unit), size in zip(parts, (86400, 3600, 60))]
    return F.concat_ws(" ", *shown, F.concat((seconds % 60).cast("string"), F.lit("s")))


def iso_date(text: Column) -> Column:
    """`05-JUL-2004` as `2004-07-05`; anything else as it is."""
    months = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
    place = F.instr(F.lit(months), F.upper(F.substring(text, 4, 3)))
    month = F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0")
    iso = F.concat_ws("-", F.substring(text, 8, 4), month, F.substring(text, 1, 2))
    return F.when(text.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$") & (place % 3 == 1) & F.try_to_date(iso).isNotNull(), iso).otherwise(text)


def comment_parts(comment: Column) -> Column:
    """(type, text) of `TYPE: text`; without a colon the type is UNKNOWN."""
    at = F.instr(comment, ": ")
    return F.struct(
        F.when(at > 0, F.substring(comment, F.lit(1), at - 1)).otherwise("UNKNOWN").alias("type"),
        F.when(at > 0, F.substring(comment, at + 2, F.length(comment))).otherwise(comment).alias("text"),
    )


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """True if [start, end] meets [from_, to], ends included."""
    return ~((end < from_) | (start > to))


def line_category(line: Column, prefixes: tuple[str, ...] = ("STATS", "HIT", "BENCH", "SEQ", "STEP")) -> Column:
    """The prefix that a log line starts with before a colon, lower-cased, else `other`."""
    out = F.lit("other")
    for prefix in reversed(prefixes):
        out = F.when(line.startswith(f"{prefix}:"), prefix.lower()).otherwise(out)
    return out
