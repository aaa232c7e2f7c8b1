"""Dates from metadata strings, file names and folder paths, and labels for them. Instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of dates in metadata, file names and folder names.
STAMP = r"^(\d{4})[:\-](\d{2})[:\-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?\s*(Z|[+\-]\d{2}:?\d{2})?"
NAME_TIME = r"(?:^|[^\d])((?:19|20)\d{2})[-_.]?(\d{2})[-_.]?(\d{2})(?:[ _\-T.]|[ _](?:à|at|um|a las|alle)[ _])?(\d{2})[-_.:h]?(\d{2})[-_.:m]?(\d{2})\d{0,3}(?:[^\d]|$)"
NAME_DAY = r"(?:^|[^\d])((?:19|20)\d{2})[-_.](\d{2})[-_.](\d{2})(?:[^\d]|$)"
PATH_MONTH = r"(?:^|[^\d])((?:19|20)\d{2})[-_.](\d{2})(?:[^\d]|$)"
PATH_YEAR = r"(?:^|[^\d])((?:19|20)\d{2})(?:[^\d]|$)"
HOLIDAYS = {"12-25": "Christmas", "12-24": "Christmas Eve", "12-31": "New Year's Eve", "01-01": "New Year", "07-14": "Bastille Day", "10-31": "Halloween", "02-14": "Valentine's Day"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of the first match as an array, by one pass of the pattern; they are empty without a match."""
    return F.split(F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, ",".join(f"${i}" for i in range(1, n + 1))), ",")


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _wall_of(g: Column, clock: bool = True) -> Column:
    """Wall clock of the groups year, month, day (hour, minute, second, else noon); null if a field is out of range."""
    y, mo, d, h, mi, s = (F.get(g, F.lit(i)).try_cast("int") if clock or i < 3 else F.lit(12 if i == 3 else 0) for i in range(6))
    ok = y.between(1970, 2100) & mo.between(1, 12) & d.between(1, 31) & (h < 24) & (mi < 60) & (s < 60)
    return F.when(ok, F.try_make_timestamp(y, mo, d, h, mi, s.cast("decimal(8,6)")))


def _wall(text: Column, pattern: str, parts: int = 6) -> Column:
    return _bind(_groups(text, pattern, parts), lambda g: _wall_of(g, parts == 6))


def wall_clock(text: Column) -> Column:
    return _wall(F.trim(text), STAMP)


def offset_minutes(text: Column) -> Column:
    """`Z`, `+hh:mm` or `-hhmm` as minutes; anything else is null."""
    zone = r"^([+\-])(\d{2}):?(\d{2})$"
    sign = F.when(F.regexp_extract(text, zone, 1) == "-", -1).otherwise(1)
    return F.when(text == "Z", 0).when(text.rlike(zone), sign * (_part(text, zone, 2) * 60 + _part(text, zone, 3)))


def parse_date(text: Column) -> Column:
    """Struct: taken_ms (UTC), day of the capture zone, offset in minutes (null: UTC is taken); null if no date."""
    def made(g: Column) -> Column:
        digits, zone = F.get(g, F.lit(6)), offset_minutes(F.nullif(F.get(g, F.lit(7)), F.lit("")))
        ms = F.coalesce(F.round(F.concat(F.lit("0."), F.nullif(digits, F.lit(""))).try_cast("double") * 1000).cast("int"), F.lit(0))
        return F.struct(_wall_of(g).alias("wall"), ms.alias("ms"), zone.alias("zone"))

    def shaped(p: Column) -> Column:
        at = F.unix_millis(p["wall"]) + p["ms"] - F.coalesce(p["zone"], F.lit(0)) * 60_000
        return F.when(p["wall"].isNotNull(), F.struct(at.alias("taken_ms"), F.date_format(p["wall"], "yyyy-MM-dd").alias("day"), p["zone"].alias("offset")))

    return _bind(_bind(_groups(F.trim(text), STAMP, 8), made), shaped)


def date_from_name(name: Column) -> Column:
    """A time, or a day at noon, in a file name."""
    return F.coalesce(_wall(name, NAME_TIME), _wall(name, NAME_DAY, 3))


def period_of_segment(seg: Column) -> Column:
    """The day, month or year that a folder name covers, as a struct of two dates (end exclusive)."""
    ymd = [_part(seg, NAME_DAY, i) for i in (1, 2, 3)]
    ym = [_part(seg, PATH_MONTH, i) for i in (1, 2)]
    y = _part(seg, PATH_YEAR, 1)
    # a day beyond the month's end rolls over
    day = F.date_add(F.make_date(ymd[0], ymd[1], F.lit(1)), ymd[2] - 1)
    month = F.make_date(ym[0], ym[1], F.lit(1))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(seg.rlike(NAME_DAY) & ymd[1].between(1, 12) & ymd[2].between(1, 31), span(day, F.date_add(day, 1)))
        .when(seg.rlike(PATH_MONTH) & ym[1].between(1, 12), span(month, F.add_months(month, 1)))
        .when(seg.rlike(PATH_YEAR), span(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1))))
    )


def period_from_path(path: Column) -> Column:
    """The period of the deepest folder that names one."""
    segments = F.filter(F.reverse(F.split(path, r"[\\/]")), lambda s: s != "")
    return F.get(F.filter(F.transform(segments, period_of_segment), lambda p: p.isNotNull()), F.lit(0))


def infer_date(name: Column, path: Column, mtime: Column) -> Column:
    """Struct: taken_at, source. By the name; else by the folder (its first day at noon) if the file's time lies outside
    the folder's period; else by the file's time."""
    named, period = date_from_name(name), period_from_path(path)
    outside = (mtime < period["start"].cast("timestamp")) | (mtime >= period["end"].cast("timestamp"))
    noon = period["start"].cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12))
    return F.when(named.isNotNull(), F.struct(named.alias("taken_at"), F.lit("filename").alias("source"))).when(outside, F.struct(noon.alias("taken_at"), F.lit("folder").alias("source"))).otherwise(F.struct(mtime.alias("taken_at"), F.lit("mtime").alias("source")))


def _month(day: Column, months: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, months)), F.month(day))


def range_label(first: Column, last: Column, months: tuple[str, ...] = MONTHS) -> Column:
    """Two days as a label in one of four shapes: one day, one month, one year, two years."""
    a, b = first.cast("date"), last.cast("date")
    d = lambda x: F.dayofmonth(x).cast("string")
    m, y = (lambda x: _month(x, months)), (lambda x: F.year(x).cast("string"))
    sp, dash = F.lit(" "), F.lit(" – ")
    return (
        F.when(a == b, F.concat(d(a), sp, m(a), sp, y(a)))
        .when(F.trunc(a, "month") == F.trunc(b, "month"), F.concat(d(a), F.lit("–"), d(b), sp, m(a), sp, y(a)))
        .when(F.year(a) == F.year(b), F.concat(d(a), sp, m(a), dash, d(b), sp, m(b), sp, y(b)))
        .otherwise(F.concat(d(a), sp, m(a), sp, y(a), dash, d(b), sp, m(b), sp, y(b)))
    )


def segment_title(first: Column, last: Column, city: Column, country: Column, home: Column, *, home_country: str = "France", holidays: dict[str, str] | None = None) -> Column:
    """Title of a moment: holiday and place, stay, place and country, or weekday and date."""
    known = HOLIDAYS if holidays is None else holidays
    mmdd = F.date_format(first.cast("date"), "MM-dd")
    holiday = F.coalesce(*(F.when(mmdd == k, F.lit(v)) for k, v in known.items()))
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(first.cast("date")))
    label, several = range_label(first, last), first != last
    away = F.coalesce(home.isNotNull() & (city != home), F.lit(False))
    where = F.when(country.isNotNull() & (country != home_country) & away, F.concat_ws(", ", city, country)).otherwise(city)
    placed = F.when(holiday.isNotNull(), F.concat(holiday, F.lit(" in "), city)).when(several & away, F.concat(F.lit("Stay in "), city)).otherwise(where)
    plain = F.when(holiday.isNotNull(), holiday).when(several, label).otherwise(F.concat(weekday, F.lit(" "), label))
    return F.when(city.isNotNull(), placed).otherwise(plain)


def segment_subtitle(first: Column, last: Column, city: Column, country: Column, home: Column, *, home_country: str = "France", holidays: dict[str, str] | None = None) -> Column:
    """What stands below a moment's title: its dates unless the title has them, a weekend's day, the place of a stay."""
    known = HOLIDAYS if holidays is None else holidays
    a = first.cast("date")
    special, several, label = F.date_format(a, "MM-dd").isin(*known), first != last, range_label(first, last)
    weekday = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(a))
    away = F.coalesce(home.isNotNull() & (city != home), F.lit(False))
    where = F.when(country.isNotNull() & (country != home_country) & away, F.concat_ws(", ", city, country)).otherwise(city)
    weekend = ~several & F.dayofweek(a).isin(1, 7)
    placed = F.when(special, label).when(several & away, F.concat(where, F.lit(" · "), label)).when(weekend, F.concat(weekday, F.lit(" "), label)).otherwise(label)
    return F.when(city.isNotNull(), placed).when(special, label).otherwise("")


def trip_title(cities: Column, first: Column, last: Column, months: tuple[str, ...] = MONTHS, *, nowhere: str = "elsewhere") -> Column:
    """`Trip to` (a week or more) or `Getaway to` the first cities, then month and dates."""
    a = first.cast("date")
    n = F.size(cities)
    at = lambda i: F.get(cities, F.lit(i))
    more = F.when(n == 3, " other").otherwise(" others")
    where = F.when(n == 0, nowhere).when(n == 1, at(0)).when(n == 2, F.concat_ws(" and ", at(0), at(1))).otherwise(F.concat(at(0), F.lit(", "), at(1), F.lit(" and "), (n - 2).cast("string"), more))
    kind = F.when(F.datediff(last.cast("date"), a) + 1 >= 7, "Trip to ").otherwise("Getaway to ")
    return F.concat(kind, where, F.lit(" · "), _month(a, months), F.lit(" "), F.year(a).cast("string"), F.lit(" · "), range_label(first, last))
