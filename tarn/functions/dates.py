"""Date and time functions with boundaries counted as the dialect counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each fixed unit.
FIXED = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
#: Months of each calendar unit.
MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}
EPOCH = "1970-01-01 00:00:00"
#: A Monday (weeks and days start from it) and the first of the month that calendar buckets start from.
ORIGIN_FIXED, ORIGIN_MONTH = "2000-01-03 00:00:00", "2000-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), "UTC"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def months(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def from_months(m: Column) -> Column:
    return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1)).cast(
        "timestamp_ntz"
    )


def date_trunc(part: str, ts: Column) -> Column:
    if part in ("decade", "century", "millennium"):
        years = MONTHS[part] // 12
        return from_months((F.floor(F.year(ts) / years) * years * 12).cast("int"))
    return F.date_trunc(part, ts.cast("timestamp")).cast("timestamp_ntz")


def date_diff(part: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit crossed between two timestamps; of weeks, whole sevens of days crossed."""
    if part in MONTHS:
        size = MONTHS[part]
        return (F.floor(months(end) / size) - F.floor(months(start) / size)).cast("long")
    if part == "week":
        return (F.datediff(end, start) / 7).cast("long")
    size = FIXED[part]
    return (F.floor(micros(end) / size) - F.floor(micros(start) / size)).cast("long")


def date_sub(part: str, start: Column, end: Column) -> Column:
    """Whole units elapsed; a month counts as whole from the last day of one to the last of the other."""
    if part in MONTHS:
        early, late = F.least(start, end), F.greatest(start, end)
        whole = months(late) - months(early)
        within_early = F.struct(F.dayofmonth(early), F.pmod(micros(early), F.lit(FIXED["day"])))
        within_late = F.struct(F.dayofmonth(late), F.pmod(micros(late), F.lit(FIXED["day"])))
        at_end = F.dayofmonth(late) == F.dayofmonth(F.last_day(late))
        short = (within_late < within_early) & ~(at_end & (F.dayofmonth(early) > F.dayofmonth(late)))
        count = F.floor((whole - short.cast("int")) / MONTHS[part])
        return F.when(start <= end, count).otherwise(-count).cast("long")
    return ((micros(end) - micros(start)) / FIXED[part]).cast("long")


def time_bucket(ts: Column, count: int, unit: str) -> Column:
    """Start of the bucket of ``count`` units that holds ``ts``."""
    if unit in MONTHS:
        size, origin = count * MONTHS[unit], 2000 * 12
        return from_months((F.floor((months(ts) - origin) / size) * size + origin).cast("int"))
    size = count * FIXED[unit]
    origin = micros(F.lit(ORIGIN_FIXED).cast("timestamp_ntz"))
    return from_micros((F.floor((micros(ts) - origin) / size) * size + origin).cast("long"))


def century(ts: Column) -> Column:
    return F.floor((F.year(ts) + 99) / 100).cast("long")


def decade(ts: Column) -> Column:
    return F.floor(F.year(ts) / 10).cast("long")


def millennium(ts: Column) -> Column:
    return F.floor((F.year(ts) + 999) / 1000).cast("long")


def dow(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("long")


def isodow(ts: Column) -> Column:
    return (F.weekday(ts) + 1).cast("long")


def yearweek(ts: Column) -> Column:
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("long")


#: C format codes and the patterns they stand for.
FORMATS = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD",
    "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%%": "'%'",
}


def pattern_of(codes: str) -> str:
    out, i, text = "", 0, ""

    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'" if any(c.isalpha() for c in t) else t

    while i < len(codes):
        if codes[i] == "%" and codes[i : i + 2] in FORMATS:
            out, text = out + quoted(text) + FORMATS[codes[i : i + 2]], ""
            i += 2
        else:
            text += codes[i]
            i += 1
    return out + quoted(text)


def strftime(ts: Column, codes: str) -> Column:
    return F.date_format(ts, pattern_of(codes))


def strptime(s: Column, codes: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(pattern_of(codes)))


def try_strptime(s: Column, codes: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern_of(codes))).cast("timestamp_ntz")


def isoyear(ts: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), ts).cast("long")


def era(ts: Column) -> Column:
    """1 after the year zero, 0 before."""
    return (F.year(ts) > 0).cast("long")


def julian(ts: Column) -> Column:
    """Days since the start of the Julian period, with the part of the day."""
    return micros(ts) / FIXED["day"] + 2440588


def epoch(ts: Column) -> Column:
    return micros(ts) / 1_000_000


def epoch_ms(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def epoch_ns(ts: Column) -> Column:
    return micros(ts) * 1000


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


#: Months, days and microseconds of one of each unit of an interval.
UNITS = {
    "years": (12, 0, 0), "months": (1, 0, 0), "decades": (120, 0, 0), "centuries": (1200, 0, 0), "millennia": (12000, 0, 0), "quarters": (3, 0, 0),
    "days": (0, 1, 0), "weeks": (0, 7, 0), "hours": (0, 0, 3_600_000_000), "minutes": (0, 0, 60_000_000), "seconds": (0, 0, 1_000_000),
    "milliseconds": (0, 0, 1000), "microseconds": (0, 0, 1),
}


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    """An interval as a struct of months, days and microseconds, which do not carry into each other."""
    fields = ((months, "months", "int"), (days, "days", "int"), (us, "micros", "long"))
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(k).alias(n) for v, n, k in fields))


def to_interval(unit: str, n: Column) -> Column:
    """``to_years`` to ``to_microseconds``; seconds and milliseconds may have fractions."""
    months, days, us = UNITS[unit]
    whole = F.round(n * us).cast("long") if us else 0
    return F.when(n.isNotNull(), interval(n * months if months else 0, n * days if days else 0, whole))


def add_intervals(a: Column, b: Column) -> Column:
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def scale_interval(a: Column, n: Column | int) -> Column:
    return interval(a["months"] * n, a["days"] * n, a["micros"] * n)


def plus(ts: Column, i: Column) -> Column:
    """Months first, cut to the month's last day, then days, then microseconds."""
    us = F.pmod(micros(ts), F.lit(FIXED["day"]))
    day = F.unix_date(F.date_add(F.add_months(F.to_date(ts), i["months"]), i["days"])).cast("long")
    return from_micros(day * FIXED["day"] + us + i["micros"])


def interval_order(i: Column) -> Column:
    """A number by which intervals compare: months of 30 days, days of 24 hours."""
    return (i["months"].cast("decimal(38,0)") * 30 + i["days"]) * FIXED["day"] + i["micros"]


def age(a: Column, b: Column) -> Column:
    """``a - b`` by calendar fields, with borrowed months as long as the earlier time's month."""
    early, late = F.least(a, b), F.greatest(a, b)
    us = F.pmod(micros(late), F.lit(FIXED["day"])) - F.pmod(micros(early), F.lit(FIXED["day"]))
    days = F.dayofmonth(late) - F.dayofmonth(early) - (us < 0).cast("int")
    whole = months(late) - months(early) - (days < 0).cast("int")
    us = us + F.when(us < 0, FIXED["day"]).otherwise(0)
    days = days + F.when(days < 0, F.dayofmonth(F.last_day(early))).otherwise(0)
    sign = F.when(a < b, -1).otherwise(1)
    return F.when(a.isNotNull() & b.isNotNull(), interval(whole * sign, days * sign, us * sign))


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """Text of the time, hh:mm:ss with a fraction if there is one; parts out of range are an error."""
    wrong = (hour < 0) | (hour > 24) | (minute < 0) | (minute > 59) | (second < 0) | (second >= 60)
    whole = F.floor(second).cast("int")
    part = F.round((second - whole) * 1_000_000).cast("int")
    text = F.format_string("%02d:%02d:%02d", hour.cast("int"), minute.cast("int"), whole)
    tail = F.rtrim(F.format_string(".%06d", part), F.lit("0"))
    out = F.when(part > 0, F.concat(text, tail)).otherwise(text)
    return F.when(wrong, F.raise_error(F.lit("time out of range")).cast("string")).otherwise(out)


def make_timestamp(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, minute, second)


def make_timestamptz(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str) -> Column:
    return F.make_timestamp(year, month, day, hour, minute, second, F.lit(zone))


def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def range_by_months(start: Column, end: Column, step: int) -> Column:
    """``range`` by months, without the end: each step is taken from the one before, so that a day cut to a month's last stays cut."""
    count = F.greatest(F.floor((months(end) - months(start)) / step) + 1, F.lit(1)).cast("int")
    one = interval(step)
    grown = F.aggregate(
        F.sequence(F.lit(1), count), F.array(start.cast("timestamp_ntz")), lambda out, _: F.concat(out, F.array(plus(F.element_at(out, -1), one)))
    )
    return F.filter(grown, lambda x: x < end)
