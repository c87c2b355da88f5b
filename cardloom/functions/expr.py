"""Money, rounding, date and text expressions with the rules the whole library shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they decompose to.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(x: Column | str) -> Column:
    """The nearest whole number as a long; halves go up, also below zero."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def money(x: Column | str) -> Column:
    """Two decimals as a double; halves go up, also below zero."""
    return F.floor(col(x) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def clamp(x: Column | str, low, high) -> Column:
    """x within low .. high; null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(lit(high), F.greatest(lit(low), x)))


def days_before(then: Column | str, now: Column | str) -> Column:
    """Fractional days from then to now, 0 for later times, null for a null time."""
    gap = F.unix_micros(col(now).cast("timestamp")) - F.unix_micros(col(then).cast("timestamp"))
    return F.when(gap.isNotNull(), F.greatest(gap / F.lit(86400000000.0), F.lit(0.0)))


def window_days(text: Column | str, default: int = 90, longest: int = 3650) -> Column:
    """Days of a window text such as 90d, within 1 .. longest; default where it is none."""
    found = F.try_to_number(F.nullif(F.regexp_extract(F.trim(col(text)), r"^(\d{1,9})d?$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return F.coalesce(clamp(found, 1, longest), F.lit(default)).cast("int")


def normalize_text(text: Column | str) -> Column:
    """Marks off, lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    plain = F.lower(F.translate(F.regexp_replace(col(text), "[̀-ͯ]", ""), MARKED, PLAIN))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(text: Column | str) -> Column:
    return F.replace(normalize_text(text), F.lit(" "), F.lit("-"))


def tokens(text: Column | str) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normalize_text(text), " "), lambda t: t != "")


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def natural_key(text: Column | str) -> Column:
    """A sort key that orders digit runs by value and letters without case."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def choose(pairs: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, lit(value)) if out is None else out.when(condition, lit(value))
    return out.otherwise(lit(otherwise))


def listed(*pairs: tuple[Column, str]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(message)) for condition, message in pairs]))
