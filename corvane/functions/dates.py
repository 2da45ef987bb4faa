"""Dates `Y/M/D-h:m:s` and durations in days, and a calculator over them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the day from which numbers of days count.
EPOCH = datetime(1900, 1, 1)


def parse(text: Column) -> Column:
    """A timestamp from `Y/M/D-h:m:s`; parts from the right may be missing, and months over 12 carry to years. Parts that
    aren't numbers count as missing; null stays null."""
    part = lambda k: F.get(F.split(F.trim(text), "[/:-]"), F.lit(k))
    number = lambda k, other: F.coalesce(part(k).try_cast("int"), F.lit(other))
    year, month = number(0, 1900), number(1, 1) - 1
    day = F.make_date(year + F.floor(month / 12).cast("int"), F.pmod(month, F.lit(12)) + 1, F.lit(1))
    seconds = (number(2, 1) - 1) * 86400 + number(3, 0) * 3600 + number(4, 0) * 60 + F.coalesce(part(5).try_cast("double"), F.lit(0.0))
    return F.when(text.isNotNull(), F.timestamp_micros((F.unix_date(day).cast("long") * 86_400_000_000) + F.round(seconds * 1_000_000).cast("long")).cast("timestamp_ntz"))


def write(t: Column) -> Column:
    """The shortest form: time fields that are zero from the right are left out; seconds have two decimals in five places, rounded as C does
    from the exact binary value of the seconds."""
    part = F.pmod(micros(t), F.lit(60_000_000))
    hundredths = F.floor(part / 10_000)
    # half-way parts: the sign of 25 s - 25 p / 10^6 of the double s tells on which side of it p lies; products with the upper half of s's bits are exact
    s, over = part / 1_000_000, part % 10_000
    big = s * 134_217_729.0
    upper = big - (big - s)
    side = (25 * upper - part / 40_000) + 25 * (s - upper)
    up = (over > 5000) | ((over == 5000) & ((side > 0) | ((side == 0) & (hundredths % 2 == 1))))
    hundredths = hundredths + up.cast("long")
    seconds = F.concat(F.lpad(F.floor(hundredths / 100).cast("string"), 2, " "), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    short = F.when((F.hour(t) == 0) & (F.minute(t) == 0), "").when(F.minute(t) == 0, F.date_format(t, "-HH")).otherwise(F.date_format(t, "-HH:mm"))
    return F.concat(F.date_format(t, "yyyy/MM/dd"), F.when(part == 0, short).otherwise(F.concat(F.date_format(t, "-HH:mm:"), seconds)))


def now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


def with_fields(t: Column, **fields) -> Column:
    """`t` with some of year, month, day, hour, minute, second set."""
    part = lambda name, own: F.lit(fields[name]) if name in fields else own
    second = part("second", F.second(t) + F.pmod(micros(t), F.lit(1_000_000)) / 1_000_000)
    return F.make_timestamp_ntz(part("year", F.year(t)), part("month", F.month(t)), part("day", F.day(t)), part("hour", F.hour(t)), part("minute", F.minute(t)), second.cast("decimal(16,6)"))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    """a - b in days, with fractions."""
    return (micros(a) - micros(b)) / 86_400_000_000


def add_days(t: Column, days: Column) -> Column:
    return F.timestamp_micros(micros(t) + F.round(days * 86_400_000_000).cast("long")).cast("timestamp_ntz")


def day_of_year(t: Column) -> Column:
    """0 at the year's beginning, with the day's fraction."""
    return F.dayofyear(t) - 1 + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400


def day_of_week(t: Column) -> Column:
    """1 for Monday to 7."""
    return F.weekday(t) + 1


class Calculator:
    """Typed date arithmetic: + and _ (minus), * and | (divide), parentheses; dates, durations and numbers.

    date + duration -> date, date _ date -> duration, duration * number -> duration, duration | duration -> number.
    Durations are dates of year 0, as in 0/0/1-12 (a day and a half).
    """

    TOKEN = re.compile(r"\s*(?:(\d+/\d+(?:/\d+)?(?:-\d+(?::\d+(?::[\d.]+)?)?)?)|(\d+\.?\d*)|([-+_*|()]))")

    def __call__(self, text: str) -> datetime | timedelta | float:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = self.TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append(self._date(m[1]) if m[1] else float(m[2]) if m[2] else m[3])
            at = m.end()
        value = self._sum()
        if self.tokens:
            raise ValueError(f"left over: {self.tokens}")
        return value

    @staticmethod
    def _date(text: str) -> datetime | timedelta:
        year, month, day, hour, minute, second = (float(x) for x in (re.split("[/:-]", text) + ["1", "0", "0", "0"][len(re.split("[/:-]", text)) - 2 :])[:6])
        if year == 0:
            return timedelta(days=day if month == 0 else day + 30 * month, hours=hour, minutes=minute, seconds=second)
        months = int(month) - 1
        return datetime(int(year) + months // 12, months % 12 + 1, 1) + timedelta(days=day - 1, hours=hour, minutes=minute, seconds=second)

    def _sum(self):
        value = self._product()
        while self.tokens and self.tokens[0] in ("+", "_", "-"):
            sign = self.tokens.pop(0)
            other = self._product()
            value = value + other if sign == "+" else value - other
        return value

    def _product(self):
        value = self._atom()
        while self.tokens and self.tokens[0] in ("*", "|"):
            sign = self.tokens.pop(0)
            other = self._atom()
            value = value * other if sign == "*" else value / other
        return value

    def _atom(self):
        if not self.tokens:
            raise ValueError("the expression ends early")
        token = self.tokens.pop(0)
        if token == "(":
            value = self._sum()
            if not self.tokens or self.tokens.pop(0) != ")":
                raise ValueError("a parenthesis isn't closed")
            return value
        if isinstance(token, str):
            raise ValueError(f"{token!r} isn't expected here")
        return token


def days_since_epoch(t: datetime) -> float:
    return (t - EPOCH) / timedelta(days=1)
