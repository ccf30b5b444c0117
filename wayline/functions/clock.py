"""Time helpers on TIMESTAMP_NTZ that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, exact."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    gap = ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return (gap.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")


def epoch_s(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01, fraction dropped."""
    return F.floor(epoch_us(ts) / 1000000).cast("bigint")


def from_epoch_us(us: Column | str) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1000000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + step


def stamp(ts: Column | str) -> Column:
    """Lexical stamp YYYYMMDD_HHMMSS of a zone-less timestamp; sorts like the time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.translate(F.substring(ts.cast("string"), 1, 19), " -:", "_")


def iso_seconds(ts: Column | str) -> Column:
    """``YYYY-MM-DDTHH:MM:SS`` with the fraction cut off."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T")


def stamp_from_iso(text: Column | str) -> Column:
    """Lexical stamp of an ISO-8601 text, in the zone the text itself carries."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.substring(text, 1, 19), "T -:", "__")
