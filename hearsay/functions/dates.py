"""Dates written as text or numbers, read by their shape.

A value's shape says where its year, month and day stand. It is rewritten as year-month-day once,
by the rule of its shape, and read once; nothing is tried that cannot fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import as_column, bind

# Names of the months, what may stand before a date and after a time.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAY = r"^\s*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
ZONE = r"(?:(?<=\d)z|\s*(?:utc|gmt)|(?<=:\d\d)\s*[+-]\d\d:?\d\d|(?<=\d\.\d{1,9})[+-]\d\d:?\d\d)\s*$"
OFFSET = r"([+-])(\d\d):?(\d\d)\s*$"

NAME = f"(?:{'|'.join(MONTHS)})[a-z]*\\.?"
ORDINAL = "(?:st|nd|rd|th)?"
BETWEEN = r"[\s,/-]+"
CLOCK = r"\d{1,2}:\d\d(?::\d\d(?:\.\d+)?)?"
HALF = r"(?:\s*[ap]\.?m\.?)"
TIME = rf"(?:(?:\s*t\s*|[\s,]+(?:at\s+)?){CLOCK}{HALF}?|[\s,]+(?:at\s+)?\d{{1,2}}{HALF})?"

# Shapes of the date part: a pattern with three groups, and which of them is what. "number" is
# month-first or, where that cannot be or is not wanted, day-first.
SHAPES = {
    "year_first": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    "number": (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", "mdy"),
    "dotted": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy"),
    "month_name": (rf"({NAME}){BETWEEN}(\d{{1,2}}){ORDINAL}{BETWEEN}(\d{{4}})", "mdy"),
    "day_name": (rf"(\d{{1,2}}){ORDINAL}(?:\s+of)?{BETWEEN}({NAME}){BETWEEN}(\d{{4}})", "dmy"),
    "year_name": (rf"(\d{{4}}){BETWEEN}({NAME}){BETWEEN}(\d{{1,2}}){ORDINAL}", "ymd"),
}
ISO = r"^\d{4}(?:-\d\d(?:-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?)?)?$"
# "jan 05 10:00:00 +0000 2024", as feeds of posts write it, has the year last.
YEAR_LAST = rf"^({NAME})\s+(\d{{1,2}})\s+({CLOCK})\s+([+-]\d{{4}}|utc|gmt|)\s*(\d{{4}})$"
COMPACT = r"^(\d{4})(\d\d)(\d\d)(?:[t ]?(\d\d)(\d\d)(\d\d)?)?$"
# Seconds of 1973 and later; 13, 16 and 19 digits are milli-, micro- and nanoseconds.
EPOCH = r"^[+-]?(?:\d{9,11}(?:\.\d+)?|\d{13}|\d{16}|\d{19})$"
MICROS = {13: 3, 16: 0, 19: -3}


def _from_micros(micros: Column) -> Column:
    """Timestamp without zone, whatever zone the session has."""
    seconds = (micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _epoch_text(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, r"^[+-]|\..*$", ""))
    number = c.try_cast("decimal(38,9)")
    micros = number * 1_000_000
    for n, power in MICROS.items():
        shift = F.lit(10 ** abs(power)).cast("decimal(10,0)")
        micros = F.when(digits == n, number * shift if power >= 0 else number / shift).otherwise(micros)
    return _from_micros(F.floor(micros))


def _epoch_number(c: Column) -> Column:
    """Numbers as seconds, or as the finer unit that their size must mean."""
    number = c.try_cast("decimal(38,9)")
    size = F.abs(number)
    micros = (
        F.when(size < 10**11, number * 1_000_000)
        .when(size < 10**14, number * 1_000)
        .when(size < 10**17, number)
        .otherwise(number / 1_000)
    )
    return _from_micros(F.floor(micros))


def _month(name: Column) -> Column:
    place = F.position(F.substring(name, 1, 3), F.lit("".join(MONTHS)))
    return (F.floor((place - 1) / 3) + 1).cast("string")


def _date_part(c: Column, day_first: bool) -> Column:
    """``year-month-day`` of text that has a known shape."""
    found = F.lit(None).cast("string")
    for shape, (pattern, order) in reversed(SHAPES.items()):
        whole = f"^{pattern}(?!\\d){TIME}$"

        def part(what: str, order: str = order, whole: str = whole, shape: str = shape) -> Column:
            group = F.regexp_extract(c, whole, order.index(what) + 1)
            return _month(group) if what == "m" and shape.endswith("name") else group

        y, m, d = part("y"), part("m"), part("d")
        if shape == "number":
            swap = (m.try_cast("int") > 12) & (d.try_cast("int") <= 12)
            if day_first:
                swap = ~((d.try_cast("int") > 12) & (m.try_cast("int") <= 12))
            m, d = F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)
        found = F.when(c.rlike(whole), F.concat_ws("-", y, m, d)).otherwise(found)
    return found


def _time_part(c: Column) -> Column:
    """``h:m:s`` on a 24-hour clock, empty where there is no time; null for 13 pm and the like."""
    half = F.substring(F.regexp_extract(c, rf"\d({HALF})$", 1), 1, 20)
    clock = F.regexp_extract(c, rf"[\st,]({CLOCK}|\d{{1,2}}(?={HALF}$)){HALF}?$", 1)
    hour = F.regexp_extract(clock, r"^\d+", 0).try_cast("int")
    rest = F.regexp_extract(clock, r"^\d+(.*)$", 1)
    rest = F.when(rest == "", ":00").otherwise(rest)
    is_pm = F.contains(half, F.lit("p"))
    hour = F.when(half == "", hour).when(
        hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(is_pm, 12).otherwise(0)
    )
    return F.when(clock == "", "").otherwise(
        F.concat(F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), rest)
    )


def _everyday(c: Column, day_first: bool) -> Column:
    prepared = F.regexp_replace(F.regexp_replace(F.lower(c), WEEKDAY, ""), YEAR_LAST, "$1 $2 $5 $3 $4")
    prepared = F.trim(F.regexp_replace(prepared, r"\s*\x{b7}\s*", " "))

    def compact(c: Column) -> Column:
        spread = F.regexp_replace(c, COMPACT, "$1-$2-$3 $4:$5:$6")
        return F.regexp_replace(F.regexp_replace(spread, ":$", ":00"), r" :.*$", "")

    def local(c: Column) -> Column:
        shaped = F.concat(_date_part(c, day_first), _time_part(c))
        return F.when(c.rlike(COMPACT), compact(c)).otherwise(shaped).try_cast("timestamp_ntz")

    def offset(zone: Column) -> Column:
        sign, hours, minutes = (F.regexp_extract(zone, OFFSET, i) for i in (1, 2, 3))
        total = hours.try_cast("int") * 60 + minutes.try_cast("int")
        total = F.when(sign == "-", -total).otherwise(total)
        return F.make_dt_interval(mins=F.coalesce(total, F.lit(0)))

    def read(c: Column) -> Column:
        bare = F.trim(F.regexp_replace(c, ZONE, ""))
        return bind(bare, local) - offset(F.regexp_extract(c, ZONE, 0))

    return bind(prepared, read)


def to_datetime(
    c: Column | str, dtype: T.DataType, formats: Sequence[str] = (), day_first: bool = False
) -> Column:
    """Timestamp without zone, or null where the value cannot be read.

    Text may be: ISO; year first with ``/`` or ``.``; ``20240105`` with or without a time; month and
    day in numbers before the year (``day_first`` decides where both could be; with dots the day is
    first); month names, short or long, before or after the day; epoch seconds, or milli-, micro- or
    nanoseconds by the number of digits. A time may follow on a 12- or 24-hour clock. A weekday
    before it, commas, ordinals and a middle dot do not matter, nor does case. A time with an offset
    is converted to UTC. Columns of numbers are epochs. ``formats`` are tried before all these.
    """
    c = as_column(c)
    if isinstance(dtype, T.NumericType):
        return _epoch_number(c)
    if not isinstance(dtype, T.StringType):
        return c.try_cast("timestamp_ntz")
    text = F.trim(c)
    read = (
        F.when(text.rlike(ISO), text.try_cast("timestamp_ntz"))
        .when(text.rlike(EPOCH), _epoch_text(text))
        .otherwise(_everyday(text, day_first))
    )
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tried, read)
