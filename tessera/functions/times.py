"""Time functions as Column expressions. Times are seconds since 1970, in the session's time zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directives of C's strftime and the pattern letters of Spark that stand for them.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "p": "a",
    "a": "EEE", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM", "Z": "zzz", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "R": "HH:mm", "D": "MM/dd/yy", "x": "MM/dd/yy", "X": "HH:mm:ss", "r": "hh:mm:ss a",
}


#: Fixed value: the format of a time where none is given.
DEFAULT = "%a %b %e %H:%M:%S %Z %Y"


def strftime(template: str, seconds: Column, utc: bool = False) -> Column:
    """Format by strftime directives; some, such as ``%e`` and ``%V``, are computed. An unknown one is an error."""
    at, parts = F.timestamp_seconds(seconds.cast("double")), []
    if utc:
        at = F.to_utc_timestamp(at, F.current_timezone())
        template = template.replace("%Z", "UTC").replace("%z", "+0000")
    template = template.replace("%c", "%a %b %e %H:%M:%S %Y")
    monday = F.date_sub(at.cast("date"), F.weekday(at))
    computed = {
        "e": F.lpad(F.dayofmonth(at).cast("string"), 2, " "),
        "k": F.lpad(F.hour(at).cast("string"), 2, " "),
        "l": F.lpad(((F.hour(at) + 11) % 12 + 1).cast("string"), 2, " "),
        "C": F.lpad(F.floor(F.year(at) / 100).cast("string"), 2, "0"),
        "V": F.lpad(F.weekofyear(at).cast("string"), 2, "0"),
        "G": F.year(F.date_add(monday, 3)).cast("string"),
        "U": F.lpad(F.floor((F.dayofyear(at) + 7 - F.dayofweek(at)) / 7).cast("string"), 2, "0"),
        "W": F.lpad(F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7).cast("string"), 2, "0"),
        "s": F.floor(seconds).cast("string"),
        "u": (F.weekday(at) + 1).cast("string"),
        "w": ((F.weekday(at) + 1) % 7).cast("string"),
        "n": F.lit("\n"),
        "t": F.lit("\t"),
        "%": F.lit("%"),
    }
    for part in re.split(r"(%.)", template):
        if not part:
            continue
        if part[0] != "%" or len(part) < 2:
            parts.append(F.lit(part))
        elif part[1] in computed:
            parts.append(computed[part[1]])
        elif part[1] in DIRECTIVES:
            parts.append(F.date_format(at, DIRECTIVES[part[1]]))
        else:
            raise ValueError(f"unknown directive {part}")
    return F.concat(*parts)


def systime() -> Column:
    """Whole seconds of now, the same for all rows of a query."""
    return F.unix_seconds(F.current_timestamp())


def mktime(value: Column, utc: bool = False) -> Column:
    """Seconds of a text ``Y M D h m s``, in the session's time zone or ``utc``; -1 if a part is missing or out of range."""
    parts = F.split(F.trim(value), r"\s+")
    names = [F.get(parts, i).try_cast("int") for i in range(6)]
    zone = {"timezone": F.lit("UTC")} if utc else {}
    return F.coalesce(F.unix_seconds(F.try_make_timestamp(*names, **zone)), F.lit(-1).cast("bigint"))


def calendar(seconds: Column) -> Column:
    """Struct of year, month, day, hour, minute, second, weekday (Sunday 0) and yearday (from 1)."""
    at = F.timestamp_seconds(seconds.cast("double"))
    return F.struct(
        F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"),
        F.minute(at).alias("minute"), F.second(at).alias("second"), (F.dayofweek(at) - 1).alias("weekday"),
        F.dayofyear(at).alias("yearday"),
    )
