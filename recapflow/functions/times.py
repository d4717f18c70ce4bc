"""Clock formats, elapsed stream time and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
RUNNING = ("starting", "live", "degraded")
CLOSED = ("ended", "failed", "interrupted")
FINISHED = ("ended", "interrupted")


def _whole(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0.0))
    return F.greatest(F.lit(0).cast("bigint"), s.cast("bigint"))


def clock_hm(seconds: Column) -> Column:
    s = _whole(seconds)
    return F.format_string("%d:%02d", F.floor(s / HOUR), F.floor((s % HOUR) / 60))


def clock_ms(seconds: Column) -> Column:
    s = _whole(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def clock_hms(seconds: Column) -> Column:
    s = _whole(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / HOUR), F.floor((s % HOUR) / 60), s % 60)


def clock_ui(seconds: Column) -> Column:
    return F.when(_whole(seconds) >= HOUR, clock_hms(seconds)).otherwise(clock_ms(seconds))


def parse_iso(text: Column) -> Column:
    """ISO text to TIMESTAMP, NULL when unreadable; zone-less text is read in the session zone (UTC)."""
    return F.try_to_timestamp(text)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def elapsed(closed: Column, started: Column, w_start: Column, w_end: Column, t_event: Column) -> Column:
    """Wall seconds from session start to an event: its window's closing time minus how long before the
    window end the event began, limited to the window."""
    zero = F.lit(0.0)
    back = F.least(F.greatest(w_end - t_event, zero), F.greatest(w_end - w_start, zero))
    back = F.when(t_event.isNull() | w_end.isNull(), zero).otherwise(back)
    return F.greatest(seconds_between(closed, started) - back, zero)


def hour_index(seconds: Column) -> Column:
    return F.floor(seconds / HOUR).cast("bigint")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def is_running(status: Column) -> Column:
    return status.isin(*RUNNING)


def is_finished(status: Column) -> Column:
    return status.isin(*FINISHED)
