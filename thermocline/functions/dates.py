"""Flexible dates, dates in file names, day and month numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date and year patterns in file names.
DAY_IN_NAME = r"(\d{4}-\d{2}-\d{2})"
YEAR_IN_NAME = r"(?:19|20)\d{2}"


def parse_date(value: Column) -> Column:
    """YYYY, YYYYMM, YYYYMMDD or an ISO stamp to a date; any other length is an error."""
    digits = F.replace(F.split_part(value.cast("string"), F.lit("T"), F.lit(1)), F.lit("-"), F.lit(""))
    size = F.length(digits)
    year = F.substring(digits, 1, 4).cast("int")
    month = F.substring(digits, 5, 2).cast("int")
    day = F.substring(digits, 7, 2).cast("int")
    return (
        F.when(size == 4, F.make_date(year, F.lit(1), F.lit(1)))
        .when(size == 6, F.make_date(year, month, F.lit(1)))
        .when(size == 8, F.make_date(year, month, day))
        .when(value.isNotNull(), F.raise_error(F.concat(F.lit("Invalid date format: "), digits)).cast("date"))
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_dates(path: Column) -> Column:
    """Struct(start, end) from the first two dates in a file name; fewer is an error."""
    found = F.regexp_extract_all(base_name(path), F.lit(DAY_IN_NAME), 1)
    short = F.raise_error(F.concat(F.lit("No start and end date in file name: "), path)).cast("date")
    return F.struct(
        *[
            F.when(F.size(found) < 2, short).otherwise(F.to_date(F.get(found, i))).alias(name)
            for i, name in enumerate(("start", "end"))
        ]
    )


def year_in_name(path: Column) -> Column:
    return F.nullif(F.regexp_extract(base_name(path), YEAR_IN_NAME, 0), F.lit("")).cast("int")


def day_number(time: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(time))


def month_number(time: Column) -> Column:
    """Months since year 0, a key that counts through year ends."""
    return F.year(time) * 12 + F.month(time) - 1
