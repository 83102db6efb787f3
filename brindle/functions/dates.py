"""Date literals: precision, rounding, time zones and date math. A literal becomes an interval of epoch milliseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ISO = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?)?)?)?(Z|[+-]\d\d:?\d\d)?$")
_STEP = re.compile(r"([+-])(\d*)([yMwdhHms])|/([yMwdhHms])")
#: Java-style pattern -> strptime
_FORMATS = {"yyyy": "%Y", "yyyy-MM": "%Y-%m", "yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "dd/MM/yyyy": "%d/%m/%Y", "MM/dd/yyyy": "%m/%d/%Y", "yyyyMMdd": "%Y%m%d", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "dd-MM-yyyy": "%d-%m-%Y"}


def zone(name: str | None) -> tzinfo:
    if not name or name in ("Z", "UTC"):
        return timezone.utc
    if m := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", name):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return timezone(timedelta(minutes=minutes if m[1] == "+" else -minutes))
    try:
        return ZoneInfo(name)
    except Exception as e:
        raise Refused(f"unknown time zone [{name}]") from e


def millis(t: datetime) -> int:
    d = t.astimezone(timezone.utc) - EPOCH
    return (d.days * 86400 + d.seconds) * 1000 + d.microseconds // 1000


def _add(t: datetime, n: int, unit: str) -> datetime:
    if unit in "yM":
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "y" else 1)
        year, month = divmod(months, 12)
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        last = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month]
        return t.replace(year=year, month=month + 1, day=min(t.day, last))
    return t + timedelta(**{{"w": "weeks", "d": "days", "h": "hours", "H": "hours", "m": "minutes", "s": "seconds"}[unit]: n})


def _floor(t: datetime, unit: str) -> datetime:
    if unit == "w":
        t = t - timedelta(days=t.weekday())
        unit = "d"
    zero = {"y": dict(month=1, day=1, hour=0, minute=0, second=0), "M": dict(day=1, hour=0, minute=0, second=0), "d": dict(hour=0, minute=0, second=0), "h": dict(minute=0, second=0), "H": dict(minute=0, second=0), "m": dict(second=0), "s": {}}[unit]
    return t.replace(microsecond=0, **zero)


def interval(value, format: str | None = None, time_zone: str | None = None, now: datetime | None = None) -> tuple[int, int]:
    """The first and last millisecond that the literal can mean."""
    if isinstance(value, datetime):
        ms = millis(value if value.tzinfo else value.replace(tzinfo=timezone.utc))
        return ms, ms
    if isinstance(value, bool):
        raise Refused(f"[{value}] is not a date")
    if isinstance(value, (int, float)):
        return int(value), int(value)
    text, tz = str(value), zone(time_zone)
    anchor, sep, math = text.partition("||")
    if text.startswith("now"):
        at, step, math = (now or datetime.now(timezone.utc)).astimezone(tz), None, text[3:]
    else:
        at, step = _parse(anchor, format, tz)
    rounded = None
    while math:
        m = _STEP.match(math)
        if not m:
            raise Refused(f"date math [{math}] can't be read")
        if m[4]:
            at, rounded, step = _floor(at, m[4]), m[4], None
        else:
            at = _add(at, int(m[2] or 1) * (1 if m[1] == "+" else -1), m[3])
        math = math[m.end() :]
    unit = rounded or step
    first = millis(at)
    return first, millis(_add(at, 1, unit)) - 1 if unit else first


def _parse(text: str, format: str | None, tz: tzinfo) -> tuple[datetime, str | None]:
    for f in (format or "").split("||"):
        if f in ("epoch_millis", "epoch_second") and re.fullmatch(r"-?\d+", text):
            return EPOCH + timedelta(milliseconds=int(text) * (1 if f == "epoch_millis" else 1000)), None
        if f in _FORMATS:
            try:
                at = datetime.strptime(text, _FORMATS[f]).replace(tzinfo=tz)
            except ValueError:
                continue
            return at, "s" if "ss" in f else "d" if "dd" in f else "M" if "MM" in f else "y"
        if f and f not in ("strict_date_optional_time", "date_optional_time", "epoch_millis", "epoch_second", "strict_date", "date"):
            raise Refused(f"date format [{f}] isn't known")
    m = _ISO.fullmatch(text)
    if not m:
        if re.fullmatch(r"-?\d+", text):
            return EPOCH + timedelta(milliseconds=int(text)), None
        raise Refused(f"[{text}] is not a date")
    year, month, day, hour, minute, second, fraction, offset = m.groups()
    own = zone(offset) if offset else tz
    at = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int((fraction or "0").ljust(6, "0")[:6]), tzinfo=own)
    step = None if fraction else "s" if second else "m" if minute else "h" if hour else "d" if day else "M" if month else "y"
    return at, step


def to_millis(column: Column, kind: str) -> Column:
    """Epoch milliseconds of a date, timestamp or timestamp_ntz column (its local time taken as UTC)."""
    if kind == "timestamp_ntz":
        # interval arithmetic keeps it independent of the session's time zone
        return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column).cast("bigint") * 86_400_000
    return F.unix_millis(column)


def bound(ms: int, at: T.DataType) -> Column:
    """The least value of the type that isn't before the millisecond: a literal, so that comparisons are pushed to the scan."""
    if isinstance(at, T.IntegralType):
        return F.lit(ms)
    if isinstance(at, T.DateType):
        return F.date_from_unix_date(F.lit(-(-ms // 86_400_000)))
    text = (EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(text)) if isinstance(at, T.TimestampNTZType) else F.timestamp_millis(F.lit(ms))
