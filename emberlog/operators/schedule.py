"""When live samples are due: intervals like 5m and cron expressions, in UTC."""

from __future__ import annotations

import calendar
import datetime
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.cron import synthetic
from emberlog.plans.manifest import interval_seconds

# Fields of an expression and what each may hold, names of months and weekdays, nicknames.
FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
NICKNAMES = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
#: How far ahead a time is looked for; 29 February on a weekday can be 40 years away.
YEARS = 41


class ScheduleError(ValueError):
    """Text that is neither an interval nor a cron expression."""


def _number(text: str, field: str, low: int, high: int) -> int:
    names = {"month": dict(zip(MONTHS, range(1, 13), strict=True)), "weekday": dict(zip(WEEKDAYS, range(7), strict=True))}.get(field, {})
    if text in names:
        return names[text]
    if not (text.isascii() and text.isdigit()) or not low <= int(text) <= high:
        raise ScheduleError(f"no {field}: {text!r}")
    return int(text)


def _values(text: str, field: str, low: int, high: int) -> frozenset[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if step and not (step.isdigit() and int(step)):
            raise ScheduleError(f"no step: {part!r}")
        if span in ("*", "?"):
            first, last = low, 6 if field == "weekday" else high
        elif "-" in span:
            first, last = (_number(x, field, low, high) for x in span.split("-", 1))
        else:
            first = _number(span, field, low, high)
            last = high if step else first
        if last < first:
            raise ScheduleError(f"{part!r} ends before it begins")
        out.update(range(first, last + 1, int(step or 1)))
    return frozenset(v % 7 for v in out) if field == "weekday" else frozenset(out)


@dataclass(frozen=True)
class Cron:
    """Five fields from the minute on, or six from the second on.

    Fields are lists of *, numbers, names and spans, each with a step; L as the day is a month's last. Where day and
    weekday are both stated, either is enough.
    """

    fields: tuple[frozenset[int], ...]
    last_day: bool
    any_day: bool
    any_weekday: bool

    @classmethod
    def parse(cls, text: str) -> Cron:
        own = NICKNAMES.get(text.strip().lower(), text).lower().split()
        own = ["0", *own] if len(own) == 5 else own
        if len(own) != 6:
            raise ScheduleError(f"{text!r} has not five or six fields")
        days = own[3].split(",")
        last_day = "l" in days
        own[3] = ",".join(d for d in days if d != "l")
        fields = tuple(_values(v, *f) if v else frozenset() for v, f in zip(own, FIELDS, strict=True))
        return cls(fields, last_day, own[3] in ("*", "?"), own[5] in ("*", "?"))

    def on(self, day: datetime.date) -> bool:
        if day.month not in self.fields[4]:
            return False
        by_day = day.day in self.fields[3] or (self.last_day and day.day == calendar.monthrange(day.year, day.month)[1])
        by_weekday = (day.weekday() + 1) % 7 in self.fields[5]
        return by_day or by_weekday if not (self.any_day or self.any_weekday) else by_day and by_weekday

    def after(self, t: datetime.datetime) -> datetime.datetime:
        """The first time later than t."""
        day, begin = t.date(), t.replace(microsecond=0).time()
        for _ in range(366 * YEARS):
            if self.on(day):
                for h in sorted(self.fields[2]):
                    for m in sorted(self.fields[1]):
                        for s in sorted(self.fields[0]):
                            if begin is None or (h, m, s) > (begin.hour, begin.minute, begin.second):
                                return datetime.datetime(day.year, day.month, day.day, h, m, s, tzinfo=t.tzinfo)
            day, begin = day + datetime.timedelta(days=1), None
        raise ScheduleError("no such time")


def due_after(text: str, t: datetime.datetime) -> datetime.datetime:
    """When a sample is next due after t, by an interval or a cron expression."""
    if " " in text.strip() or text.strip().startswith("@"):
        return Cron.parse(text).after(t)
    return t + datetime.timedelta(seconds=interval_seconds(text.strip()))


def times(text: str, start: datetime.datetime, end: datetime.datetime) -> Iterator[datetime.datetime]:
    """All due times after start, to end."""
    while (start := due_after(text, start)) <= end:
        yield start


def live_rows(addresses: DataFrame, block: int | Column, at: datetime.datetime) -> DataFrame:
    """addresses with a synthetic event for each row at the head: its block, zero hashes, the time of the tick."""
    return synthetic(addresses.withColumn("tick", (block if isinstance(block, Column) else F.lit(block)).cast("long"))).withColumn("evt_block_timestamp", F.lit(at).cast("timestamp"))


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def run(text: str, act: Callable[[datetime.datetime], None], until: datetime.datetime | None = None, now: Callable[[], datetime.datetime] = _now, sleep: Callable[[float], None] = time.sleep) -> None:
    """Calls act at each due time. One that takes longer than the times are apart misses those in between."""
    while True:
        due = due_after(text, now())
        if until is not None and due > until:
            return
        while (left := (due - now()).total_seconds()) > 0:
            sleep(left)
        act(due)
