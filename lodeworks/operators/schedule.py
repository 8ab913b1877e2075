"""Next runs of five-field cron expressions in a time zone, in column expressions alone.

A field is a set of numbers; the next run is found by carry: in the same hour, else at the first minute of a later hour,
else at the first hour of a later day, the day being sought in two months first and in eight years only if these have
none. Days follow the usual rule: where both the day of the month and the day of the week are restricted, either will do.

The clock is the zone's own. A local time that a zone skips is no time, so the search goes on behind the gap; of a local
time that comes twice, both count. So the next run is the first minute after ``now`` whose local time matches.

Defined cases: a null expression, one without five fields, or with a part that isn't ``*``, ``n``, ``a-b`` or one of these
with a step gives null, as does one that no day matches within eight years; names of months and days count in either
case; 7 is Sunday; seconds of ``now`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY, _MONTHS = 1440, "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
_WEEKDAYS = "SUN MON TUE WED THU FRI SAT".split()
_PART = r"^(\*|\d{1,4}(-\d{1,4})?)(/0*[1-9]\d{0,3})?$"


def _named(text: Column, names: list[str], first: int) -> Column:
    for i, name in enumerate(names, first):
        text = F.regexp_replace(text, rf"\b{name}\b", str(i))
    return text


def field(text: Column, low: int, high: int) -> Column:
    """The numbers of a field in order, null for a field that can't be read."""
    parts = F.split(text, ",")

    def numbers(part: Column) -> Column:
        base, step = F.split_part(part, F.lit("/"), F.lit(1)), F.split_part(part, F.lit("/"), F.lit(2))
        start = F.when(base == "*", low).otherwise(F.try_to_number(F.split_part(base, F.lit("-"), F.lit(1)), F.lit("9999")).cast("int"))
        single = F.when(step == "", start).otherwise(F.lit(high))  # "a/s" runs to the end
        last = F.when(base == "*", high).when(F.contains(base, F.lit("-")), F.try_to_number(F.nullif(F.split_part(base, F.lit("-"), F.lit(2)), F.lit("")), F.lit("9999")).cast("int")).otherwise(single)
        by = F.coalesce(F.try_to_number(F.nullif(step, F.lit("")), F.lit("9999")).cast("int"), F.lit(1))
        good = F.rlike(part, F.lit(_PART)) & (start >= low) & (last <= high) & (start <= last)
        return F.when(good, F.sequence(start, last, by))

    found = F.transform(parts, numbers)
    return F.when(F.forall(found, lambda x: x.isNotNull()), F.array_sort(F.array_distinct(F.flatten(found))))


def parsed(cron: Column) -> Column:
    """A struct of the five sets ``minute, hour, day, month, weekday`` and whether both kinds of day are restricted; null if unreadable."""
    words = F.split(F.trim(F.upper(cron)), r"\s+")
    at = lambda i: F.get(words, F.lit(i))
    weekday = F.transform(field(_named(at(4), _WEEKDAYS, 0), 0, 7), lambda d: d % 7)
    sets = [field(at(0), 0, 59), field(at(1), 0, 23), field(at(2), 1, 31), field(_named(at(3), _MONTHS, 1), 1, 12), F.array_sort(F.array_distinct(weekday))]
    whole = (F.size(words) == 5) & ~F.array_contains(words, "")
    for s in sets:
        whole = whole & s.isNotNull()
    names = ("minute", "hour", "day", "month", "weekday")
    return F.when(whole, F.struct(*(s.alias(n) for s, n in zip(sets, names, strict=True)), ((at(2) != "*") & (at(4) != "*")).alias("either")))


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def _day_fits(c: Column, day: Column) -> Column:
    """``day`` counts days since 1970."""
    date = F.date_from_unix_date(day)
    month_day, week_day = F.array_contains(c["day"], F.dayofmonth(date)), F.array_contains(c["weekday"], F.dayofweek(date) - 1)
    return F.array_contains(c["month"], F.month(date)) & F.when(c["either"], month_day | week_day).otherwise(month_day & week_day)


def next_local(c: Column, minute: Column) -> Column:
    """The first matching minute after ``minute``, both counted since 1970 on the local clock."""
    day, at = F.floor(minute / _DAY).cast("int"), F.pmod(minute, F.lit(_DAY)).cast("int")
    hour, past = F.floor(at / 60).cast("int"), at % 60
    same_hour = F.when(F.array_contains(c["hour"], hour), hour * 60 + _first(F.filter(c["minute"], lambda m: m > past)))
    later_hour = _first(F.filter(c["hour"], lambda h: h > hour)) * 60 + _first(c["minute"])
    today = F.when(_day_fits(c, day), F.coalesce(same_hour, later_hour))
    among = lambda a, b: _first(F.filter(F.sequence(day + a, day + b), lambda d: _day_fits(c, d)))
    later = F.coalesce(among(1, 62), among(63, 366 * 8 + 2))
    first = _first(c["hour"]) * 60 + _first(c["minute"])
    return F.coalesce(day.cast("long") * _DAY + today, later.cast("long") * _DAY + first)


def _local(minute: Column, zone: Column) -> Column:
    """Local minutes of minutes in universal time."""
    return F.floor(F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(minute * 60), zone)) / 60).cast("long")


def _universal(minute: Column, zone: Column) -> Column:
    """Minutes in universal time of local ones; the earlier of two, and for skipped ones as if the clock had not been moved."""
    return F.floor(F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(minute * 60), zone)) / 60).cast("long")


def next_run(cron: Column, now: Column, zone: Column) -> Column:
    """The timestamp of the next run after ``now``."""
    c = parsed(cron)
    # an array of one struct, to which each step adds a value that later ones read
    out = F.array(F.struct(c.alias("c"), F.floor(F.unix_seconds(now) / 60).cast("long").alias("now"), zone.alias("zone")))

    def then(name: str, make) -> None:
        nonlocal out
        out = F.transform(out, lambda s: s.withField(name, make(s)))

    behind = 180  # minutes that a clock is put back or forward at the most
    then("local", lambda s: _local(s["now"], s["zone"]))
    then("first", lambda s: next_local(s["c"], s["local"]))
    then("utc", lambda s: _universal(s["first"], s["zone"]))
    then("skipped", lambda s: _local(s["utc"], s["zone"]) != s["first"])
    # in a gap: the search goes on from its last minute, found as the first minute behind the change of the clock
    offset = lambda m, s: _local(m, s["zone"]) - m
    change = lambda s, a, b: _first(F.filter(F.sequence(a, b), lambda m: offset(m, s) != offset(m - 1, s)))
    then("change", lambda s: F.when(s["skipped"], change(s, s["utc"] - behind, s["utc"])))
    then("first", lambda s: F.when(s["skipped"], next_local(s["c"], _local(s["change"], s["zone"]) - 1)).otherwise(s["first"]))
    then("utc", lambda s: F.when(s["skipped"], _universal(s["first"], s["zone"])).otherwise(s["utc"]))
    # put back after now, or just before: the local hour comes twice
    then("near", lambda s: F.when(offset(s["now"] + behind, s) < offset(s["now"] - behind, s), change(s, s["now"] - behind, s["now"] + behind)))
    then("again", lambda s: F.when(s["near"].isNotNull(), next_local(s["c"], F.greatest(_local(s["near"], s["zone"]) - 1, F.when(s["now"] >= s["near"], s["local"]).otherwise(F.lit(-(1 << 40)))))))
    then("second", lambda s: F.when(s["near"].isNotNull(), s["again"] - offset(s["near"], s)))
    # the second pass counts while its clock shows the time, or behind it where nothing comes in between
    then("second", lambda s: F.when((_local(s["second"], s["zone"]) == s["again"]) & (s["second"] > s["now"]), s["second"]))
    done = _first(out)
    found = F.least(F.when(done["utc"] > done["now"], done["utc"]), done["second"])
    return F.when(done["c"].isNotNull(), F.timestamp_seconds(found * 60))
