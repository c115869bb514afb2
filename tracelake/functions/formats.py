"""Packets as text, in Columns: time of day, TCP flags, hex dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order and names of the flags.
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")
LINE, HALF = 16, 8


def time_of_day(ts_us: Column) -> Column:
    """HH:MM:SS.uuuuuu in UTC of microseconds since 1970."""
    seconds = F.floor(ts_us / 1_000_000)
    part = lambda unit, size: F.lpad((F.floor(seconds / unit) % size).cast("string"), 2, "0")
    return F.concat(part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("."), F.lpad((ts_us % 1_000_000).cast("string"), 6, "0"))


def flag_text() -> Column:
    """Names of the flags that are set, of the columns syn, ack, ..., like [SYN, ACK]."""
    return F.concat(F.lit("["), F.concat_ws(", ", *(F.when(F.col(f), F.lit(f.upper())) for f in FLAGS)), F.lit("]"))


def hex_dump(data: Column) -> Column:
    """Lines of 16 bytes: offset, bytes in hex with a gap after the eighth, the printable ones as text.
    Empty for no bytes, null for null."""
    count = F.octet_length(data)

    def line(at: Column) -> Column:
        chunk = F.substring(data, at + 1, F.lit(LINE))
        digits = F.rpad(F.lower(F.hex(chunk)), 2 * LINE, " ")
        spaced = F.regexp_replace(digits, "(..)", "$1 ")
        halves = F.concat(F.substring(spaced, 1, 3 * HALF), F.lit(" "), F.substring(spaced, 3 * HALF + 1, 3 * HALF))
        # In Latin-1 every byte is one character.
        text = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), "[^ -~]", ".")
        return F.concat(F.lpad(F.lower(F.hex(at.cast("long"))), 4, "0"), F.lit("  "), halves, F.lit(" |"), text, F.lit("|\n"))

    starts = F.sequence(F.lit(0), F.floor((count - 1) / LINE).cast("int") * LINE, F.lit(LINE))
    return F.when(count == 0, F.lit("")).when(count > 0, F.array_join(F.transform(starts, line), ""))
