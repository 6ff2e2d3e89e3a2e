"""Clock, calendar and size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiscope.functions.catalog import WEEKDAYS
from kpiscope.functions.exprs import col, labelled


def weekday_name(day_offset: str | Column, start_weekday: int, width: int = 0) -> Column:
    """Name of the day that lies day_offset days after a start weekday (0 = Monday)."""
    names = [d[:width] if width else d for d in WEEKDAYS]
    table = F.array(*[F.lit(n) for n in names])
    return F.element_at(table, ((F.lit(start_weekday) + col(day_offset)) % 7 + 1).cast("int"))


def hour_period(hour: str | Column) -> Column:
    """Part of the day an hour belongs to."""
    h = col(hour)
    return labelled(
        h,
        [
            ((h >= 6) & (h < 10), "morning-rush"),
            ((h >= 10) & (h < 16), "midday"),
            ((h >= 16) & (h < 20), "evening-rush"),
        ],
        "night",
    )


def hour_window_label(t_start: str | Column, t_end: str | Column, start_weekday: int = 0) -> Column:
    """Clock label of an inclusive hour range; a range that ends at midnight ends at 24:00."""
    s, stop = col(t_start), col(t_end) + 1
    first = F.floor(s / 24)
    at_midnight = stop % 24 == 0
    last = F.floor(stop / 24) - at_midnight.cast("int")
    stop_hour = F.when(at_midnight, F.lit(24)).otherwise(stop % 24)

    def day(d: Column) -> Column:
        return F.format_string("Day %d (%s)", d + 1, weekday_name(d, start_weekday, 3))

    begin = F.format_string("%s %02d:00", day(first), s % 24)
    same_day = F.format_string("%s–%02d:00", begin, stop_hour.cast("int"))
    cross_day = F.format_string("%s → %s %02d:00", begin, day(last), stop_hour.cast("int"))
    return F.when(first == last, same_day).otherwise(cross_day)


def sensitivity_magnitude(s_norm: str | Column) -> Column:
    """Size class of a cap-normalised sensitivity; the sign is ignored."""
    a = F.abs(col(s_norm))
    return labelled(a, [(a < 0.001, "negligible"), (a < 0.01, "weak"), (a < 1.0, "meaningful")], "strong")
