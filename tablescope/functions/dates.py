"""Dates written as text, Gregorian or Solar Hijri (Jalali)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import fixed_values as fv
from tablescope.functions.numbers import tidy
from tablescope.functions.text import let

# Years a nanosecond timestamp can hold; other years are rejected.
_FIRST_YEAR, _LAST_YEAR = 1678, 2261
# Years of two digits before this one are 20.., the others 19..
_FIRST_OF_19 = "76"
_MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?",
           "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = "(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?"

# The grammar: parts of a date, and the forms they make up. A form is a whole text without
# its time, its replacement the parts in the order year-month-day.
_PART = {
    "Y": r"(\d{4}|\d{2})", "YYYY": r"(\d{4})", "M": r"(\d{1,2})", "D": r"(\d{1,2})(?:st|nd|rd|th)?", "d": r"(\d{1,2})",
    "low": r"(0?[1-9]|1[0-2])", "high": r"(1[3-9]|2\d|3[01])", "MM": r"(\d{2})", "NAME": f"({'|'.join(_MONTHS)})\\.?", "any": r"[-/.]",
    "sep": r"([-/.])", "same": r"\2", "gap": r"[ -]", "maybe": r"[ -]?", "comma": ",?", "month_sep": r"[-/]",
}
_GRAMMAR = {
    "year_first": ("YYYY any M any d", "$1-$2-$3"),
    "month_or_day_first": ("low sep low same Y", None),  # either order, see below
    "month_first": ("low sep high same Y", "$4-$1-$3"),
    "day_first": ("high sep M same Y", "$4-$3-$1"),
    "compact": ("YYYY MM MM", "$1-$2-$3"),
    "year_month": ("YYYY month_sep M", "$1-$2-01"),
    "name_day_year": ("NAME gap D comma gap Y", "$3-$1-$2"),
    "day_name_year": ("D maybe NAME comma maybe Y", "$3-$2-$1"),
    "year_name_day": ("YYYY gap NAME gap D", "$1-$2-$3"),
    "name_year": ("NAME comma gap YYYY", "$2-$1-01"),
}
JALALI = "jalali"
#: Names of all forms; a form's number is its place here.
FORMS = (JALALI, *_GRAMMAR)
#: The form whose reading needs to know which of day and month comes first.
AMBIGUOUS = "month_or_day_first"

# A text that may be a date begins so; everything else is turned away by one look.
_START = (rf"(?i)^(?:\d{{1,4}}[-/. ]|\d{{1,2}}(?::\d\d|(?:st|nd|rd|th)?[ -]?[a-z])|\d{{8}}(?:$|T|\d{{6}}$)"
          rf"|(?:{'|'.join(_MONTHS)}|{_WEEKDAY})\.?,?[ -])")
_CLOCK = r"(?=\d{1,2}(?::| ?[ap]\.?m))(\d{1,2}(?::\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?)(?: ?([ap])\.?m\.?)?"
# The most common moments need no taking apart.
_PLAIN_MOMENT = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)$"
_ZONE = r"(?: ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_TIMED = r"(?i)(?:\d:\d|\d ?[ap]\.?m\.?(?: |$)|^\d{8}T?\d{4})"
# No date begins so, thus only the time can; and a date written together with its time.
_CLOCK_FIRST = r"(?i)^\d{1,2}(?::| ?[ap]\.?m)"
_COMPACT_TIME = r"(?i)^\d{8}T?\d{4}"
# Forms with a time, and what turns them into date|clock|half of the day|zone.
_WITH_TIME = (
    (rf"(?i)^(.+?)(?:,? |T){_CLOCK}{_ZONE}$", "$1|$2|$3|$4"),
    (rf"(?i)^{_CLOCK}{_ZONE},? (.+)$", "$4|$1|$2|$3"),
    (r"(?i)^(\d{8})T?(\d{2})(\d{2})(\d{2})$", "$1|$2:$3:$4||"),
    (r"(?i)^(\d{8})T(\d{2})(\d{2})$", "$1|$2:$3||"),
)

# Norouz 1404 anchors the Solar Hijri calendar.
_ANCHOR_YEAR, _ANCHOR_DATE = 1404, "2025-03-21"


def _leap_days(year):
    """Leap days up to ``year`` in the 33-year cycle with eight leap years."""
    return F.floor((year * 8 + 12792) / 33)


def jalali_year_start(year: Column) -> Column:
    """Gregorian date of the first day of a Solar Hijri year."""
    anchor_leap = (_ANCHOR_YEAR * 8 + 12792) // 33
    days = (year - _ANCHOR_YEAR) * 365 + _leap_days(year) - anchor_leap
    return F.date_add(F.lit(_ANCHOR_DATE).cast("date"), days.cast("int"))


def jalali_to_date(year: Column, month: Column, day: Column, strict_days: bool = False) -> Column:
    """Gregorian date of a Solar Hijri date; NULL unless the month is 1 to 12.

    Days past the end of a month run on into the next month, unless
    ``strict_days`` makes them NULL.
    """
    # Six months of 31 days, then five of 30, then the last.
    offset = (month - 1) * 31 - F.greatest(month - 7, F.lit(0)) + day - 1
    valid = month.between(1, 12)
    if strict_days:
        leap = _leap_days(year + 1) - _leap_days(year)
        last = F.when(month <= 6, 31).when(month <= 11, 30).otherwise(29 + leap)
        valid = valid & day.between(1, last)
    return F.when(valid, F.date_add(jalali_year_start(year), offset.cast("int")))


def _jalali(text: Column, strict_days: bool) -> Column:
    def date_of(parts: Column) -> Column:
        return jalali_to_date(parts[0], parts[1], parts[2], strict_days)
    return let(F.split(text, r"[/\-.]").cast("array<int>"), date_of)


def parse_jalali(col: Column, strict_days: bool = False) -> Column:
    """``1405/02/31`` and the like as a Gregorian timestamp, NULL otherwise."""
    return let(tidy(col), lambda text: F.when(text.rlike(fv.JALALI_DATE), _jalali(text, strict_days).cast("timestamp")))


def _pattern(form: str) -> str:
    return "(?i)^" + "".join(_PART[p] for p in _GRAMMAR[form][0].split()) + "$"


def _day(text: Column, form: str, day_first: bool) -> Column:
    """The date of a text of this form; NULL if there is none or its year is out of range."""
    grammar, replacement = _GRAMMAR[form]
    ordered = F.regexp_replace(text, _pattern(form), replacement or ("$4-$3-$1" if day_first else "$4-$1-$3"))
    if "Y" in grammar.split():
        ordered = let(ordered, lambda x: F.when(F.substring(x, 3, 1) == "-", F.concat(
            F.when(x < _FIRST_OF_19, "20").otherwise("19"), x)).otherwise(x))

    def numbers_only(x: Column) -> Column:
        if "NAME" not in grammar.split():
            return x
        month = F.position(F.lower(F.substring(x, 6, 3)), F.lit(_MONTH_STARTS))
        return F.concat(F.substring(x, 1, 5), F.ceil(month / 3).cast("string"), F.lit("-"), F.substring_index(x, "-", -1))

    return let(ordered, lambda x: F.when(
        (x >= str(_FIRST_YEAR)) & (x < str(_LAST_YEAR + 1)), numbers_only(x).try_cast("date")))


def _kind(form: str) -> str:
    """How texts of a form look at a glance."""
    parts = _GRAMMAR[form][0].split() if form != JALALI else ["YYYY", "any"]
    if "NAME" in parts:
        return "name" if parts[0] == "NAME" else "digits_and_name"
    return "year" if parts[0] == "YYYY" and parts[1] != "MM" else "other"


def _dated(text: Column, forms, strict_days: bool, day_first: bool) -> Column:
    """struct(day, form) of a text without a time, NULL if it has none of ``forms``."""
    def among(kind: str) -> Column:
        out = F
        for form in [f for f in forms if _kind(f) == kind]:
            if form == JALALI:
                fits, day = text.rlike(fv.JALALI_DATE), _jalali(text, strict_days)
            else:
                fits, day = text.rlike(_pattern(form)), _day(text, form, day_first)
            out = out.when(fits, F.struct(day.alias("day"), F.lit(FORMS.index(form)).alias("form")))
        return out

    # at most three looks decide which forms a text may have
    return (F.when(text >= "A", among("name")).when(text.rlike("[A-Za-z]"), among("digits_and_name"))
            .when(text.rlike(r"^\d{4}[-/.]"), among("year")).otherwise(among("other")))


def _without_weekday(text: Column) -> Column:
    return F.when(text >= "A", F.regexp_replace(text, rf"(?i)^{_WEEKDAY}\.?,? ", "")).otherwise(text)


def _timed(text: Column, read) -> Column:
    """struct(value, form) of a text with a time."""
    def cut(forms) -> Column:
        out = F
        for pattern, replacement in forms:
            out = out.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement))
        return out

    behind, before, *compact = _WITH_TIME
    parts = F.when(text.rlike(_CLOCK_FIRST), cut([before])).when(text.rlike(_COMPACT_TIME), cut(compact)).otherwise(cut([behind]))

    def moment(parts: Column) -> Column:
        clock, half = parts[1], parts[2]
        hour = F.substring_index(clock, ":", 1)
        seconds = F.when(F.char_length(clock) <= 2, F.concat(clock, F.lit(":00:00"))).when(
            F.char_length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
        on_24 = F.when(hour.try_cast("int").between(1, 12), F.concat(
            (hour.try_cast("int") % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)).cast("string"),
            F.substring(seconds, F.char_length(hour) + 1, F.lit(20))))
        zone = F.when(parts[3] != "", F.upper(F.regexp_replace(parts[3], r"^([+-]\d\d)(\d\d)$", "$1:$2"))).otherwise("")
        time = F.when(half == "", seconds).otherwise(on_24)
        return let(read(_without_weekday(parts[0])), lambda found: F.struct(
            F.concat(found["day"].cast("string"), F.lit(" "), time, zone).try_cast("timestamp").alias("value"), found["form"].alias("form")))

    plain = let(F.regexp_replace(text, _PLAIN_MOMENT, "$1-$2-$3"), lambda x: F.struct(
        F.when((x >= str(_FIRST_YEAR)) & (x < str(_LAST_YEAR + 1)), x.try_cast("timestamp")).alias("value"),
        F.lit(FORMS.index("year_first")).alias("form")))
    return F.when(text.rlike(_PLAIN_MOMENT), plain).otherwise(let(F.split(parts, r"\|"), moment))


def date_and_form(col: Column, strict_days: bool = False, day_first: bool = False, forms=None) -> Column:
    """struct(value, form) for tidy text: its date, and the number in FORMS of the form it is written in.

    ``forms`` are tried first; all others follow, so they change the cost and not the result.
    """
    # Solar Hijri years would fit another form too, without a date in it
    order = list(dict.fromkeys([JALALI, *(forms or ()), *FORMS]))

    def untimed(text: Column) -> Column:
        return let(_dated(_without_weekday(text), order, strict_days, day_first), lambda found: F.struct(
            found["day"].cast("timestamp").alias("value"), found["form"].alias("form")))

    def timed(text: Column) -> Column:
        return _timed(text, lambda t: _dated(t, order[1:], strict_days, day_first))

    return let(col, lambda text: F.when(text.rlike(_START), F.when(text.rlike(_TIMED), timed(text)).otherwise(untimed(text))))


def parse_dates(col: Column, data_type: T.DataType | None = None,
                strict_days: bool = False, day_first: bool = False) -> Column:
    """Read dates in mixed formats; NULL for anything that is not a date.

    Solar Hijri dates are recognised first. Gregorian forms: ISO dates and
    timestamps, ``y/M/d``, ``M/d/y`` (or ``d/M/y`` where that is impossible, or with
    ``day_first``), ``yyyyMMdd``, ``yyyy-MM``, and with month names ``Jan 5 2026``,
    ``5th Jan 2026``, ``05Jan2026``, ``2026-Jan-05`` and ``Jan 2026``; behind a weekday, with
    a time after or before the date, also on the twelve-hour clock, and with years of two
    digits after day and month. Bare years and bare times are not dates.
    """
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    return date_in_tidy(tidy(col), strict_days, day_first)


def date_in_tidy(col: Column, strict_days: bool = False, day_first: bool = False, forms=None) -> Column:
    """:func:`parse_dates` for text that is already tidy."""
    return date_and_form(col, strict_days, day_first, forms)["value"]


def has_date_name(name: str) -> bool:
    return any(hint in str(name).lower() for hint in fv.DATE_NAME_HINTS)
