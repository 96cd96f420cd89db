"""Evidence time: text ``yyyy-MM-dd HH:mm:ss.SSS`` in one fixed display zone, so text order is time order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.core import col, int_div

# Fixed values.
EVIDENCE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
DISPLAY_OFFSET_MINUTES = 540
MICROS_1601_TO_1970 = 11_644_473_600_000_000
MICROS_OLE_TO_1970 = 2_209_161_600_000_000
EVIDENCE_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
NAIVE_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"
NANO_RANGE_MICROS = 9_223_372_036_854_775


def _origin() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _padded(text: Column) -> Column:
    """Exactly three fraction digits; further digits are cut."""
    return F.rpad(F.regexp_replace(text, r"^([^.]*)$", "$1."), 23, "0")


def render_micros(micros: Column, offset_minutes: int = DISPLAY_OFFSET_MINUTES) -> Column:
    """Epoch microseconds as evidence text. Zone-free arithmetic, so no session zone and no clock change matters."""
    shifted = micros + F.lit(offset_minutes * 60_000_000)
    return _padded(F.timestamp_add("MICROSECOND", shifted, _origin()).cast("string"))


def _wall_micros(text: Column) -> Column:
    """Microseconds of ``yyyy-MM-dd HH:mm:ss[.f]`` text since 1970 on its own clock, NULL for an impossible time."""
    days = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("bigint")
    hour, minute, second = [F.substring(text, at, 2).try_cast("bigint") for at in (12, 15, 18)]
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,6})", 1), 6, "0").try_cast("bigint")
    whole = ((days * 24 + hour) * 60 + minute) * 60 + second
    return F.when((hour < 24) & (minute < 60) & (second < 60), whole * F.lit(1_000_000) + fraction)


def epoch_millis(ts: Column | str) -> Column:
    """Milliseconds on the display clock, NULL when the text is not evidence time. Only differences carry meaning."""
    value = col(ts)
    return F.when(value.rlike(EVIDENCE_PATTERN), int_div(_wall_micros(F.substring(value, 1, 23)), 1000))


def filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601: half-even to microseconds, floor to milliseconds, blank at or below zero."""
    # Adding 4 rounds sixes and above up; the parity of the tens decides a five.
    micros = int_div(ticks + F.lit(4) + int_div(ticks, 10) % F.lit(2), 10) - F.lit(MICROS_1601_TO_1970)
    return F.when((ticks > 0) & (ticks < F.lit(9_223_372_036_854_775_800)), render_micros(micros))


def filetime_ns(epoch_nanos: Column) -> Column:
    """Epoch nanoseconds: half-even to microseconds; the 64-bit nanosecond range decides what is blank."""
    r = F.pmod(epoch_nanos, F.lit(1000))
    q = int_div(epoch_nanos - r, 1000)
    up = (r > 500) | ((r == 500) & (F.pmod(q, F.lit(2)) != 0))
    return render_micros(q + F.when(up, F.lit(1)).otherwise(F.lit(0)))


def chrome_time(value: Column | str) -> Column:
    """Microseconds since 1601 as text."""
    micros = F.trim(col(value)).try_cast("bigint")
    fits = (micros > 0) & (micros <= F.lit(922_337_203_685_477_580))
    return F.when(fits, render_micros(micros - F.lit(MICROS_1601_TO_1970)))


def unix_seconds(value: Column | str) -> Column:
    seconds = F.trim(col(value)).try_cast("bigint")
    return F.when((seconds > 0) & (seconds < F.lit(9_000_000_000_000)), render_micros(seconds * F.lit(1_000_000)))


def ole_days(value: Column | str) -> Column:
    """Days since 1899-12-30; zero and non-finite are blank."""
    days = col(value).try_cast("double")
    usable = days.isNotNull() & (days != 0) & ~F.isnan(days) & (F.abs(days) < F.lit(1e8))
    micros = F.round(days * F.lit(86_400_000_000.0)).try_cast("bigint") - F.lit(MICROS_OLE_TO_1970)
    return F.when(usable, render_micros(micros))


def _instant_micros(value: Column) -> Column:
    """Epoch microseconds of RFC 3339 text with a zone."""
    sign = F.when(F.regexp_extract(value, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    hours = F.coalesce(F.regexp_extract(value, r"[+-](\d{2}):\d{2}$", 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(value, r"[+-]\d{2}:(\d{2})$", 1).try_cast("int"), F.lit(0))
    return _wall_micros(value) - sign * (hours * 60 + minutes).cast("bigint") * F.lit(60_000_000)


def _local_text(value: Column, pattern: str) -> Column:
    """Stamp without a zone: already display time, only its form is made even."""
    return F.when(value.rlike(pattern) & _wall_micros(value).isNotNull(), _padded(F.regexp_replace(value, "T", " ")))


def zoned_or_local_time(value: Column | str) -> Column:
    """RFC 3339 honours its zone, a naive stamp is already display time, anything else stays as it is."""
    raw = F.trim(col(value))
    zoned = F.when(raw.rlike(RFC3339_PATTERN), render_micros(_instant_micros(raw)))
    return F.nullif(F.coalesce(zoned, _local_text(raw, NAIVE_PATTERN), raw), F.lit(""))


def payload_time(value: Column | str) -> Column:
    """Conversation payload time: local text, epoch seconds or milliseconds, ISO instant; else blank."""
    raw = F.trim(col(value))
    local_pattern = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"
    number = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double"))
    millis = F.round(F.when(number >= 1e12, number).otherwise(number * 1000.0))
    numeric = F.when((number > 1e9) & (millis < 8.64e15), render_micros(millis.try_cast("bigint") * F.lit(1000)))
    iso = F.when(raw.rlike(RFC3339_PATTERN), render_micros(_instant_micros(raw)))
    return F.when(raw.rlike(local_pattern), _local_text(raw, local_pattern)).otherwise(F.coalesce(numeric, iso))


def widen_bound(value: str | None, edge: str) -> str | None:
    """Date, minute or second text to a full bound: starts floor, ends ceil; unparseable text is no bound."""
    if not value:
        return None
    found = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}):(\d{2})(?::(\d{2}))?)?", value.strip())
    if not found:
        return None
    low = edge == "start"
    clock = [part if part is not None else fill for part, fill in zip(found.groups()[1:], ("00",) * 3 if low else ("23", "59", "59"))]
    return f"{found.group(1)} {':'.join(clock)}.{'000' if low else '999'}"


def in_range(ts: Column | str, start: str | None, end: str | None) -> Column:
    """Inclusive range on evidence text. With no bound every row stays; with a bound untimed rows fall out."""
    low, high = widen_bound(start, "start"), widen_bound(end, "end")
    value = col(ts)
    keep = F.lit(True)
    if low or high:
        keep = value.isNotNull() & (value != "")
    if low:
        keep = keep & (value >= F.lit(low))
    if high:
        keep = keep & (value <= F.lit(high))
    return keep


def time_column_for(columns: list[str], declared: str | None, sample: dict[str, str] | None) -> str | None:
    """The column to range-filter: the declared one, else ``timestamp``, else the first whose sample looks like time."""
    if declared and declared in columns:
        return declared
    if "timestamp" in columns:
        return "timestamp"
    for name in columns if sample else []:
        if re.match(EVIDENCE_PATTERN, (sample.get(name) or "")):
            return name
    return None
