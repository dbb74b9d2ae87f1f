"""Calendar parts, cycles, flags, and lags and windows over ordered rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series

#: Formats tried in this order, where a text's format is not known.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd"]


def parse_mixed(text: Column, formats=FORMATS) -> Column:
    """A timestamp from text in any of the formats, or epoch seconds or milliseconds; null if none fits."""
    t = F.trim(text)
    epoch = F.when(t.rlike(r"^\d{13}$"), F.timestamp_millis(F.try_to_number(t, F.lit("9999999999999")).cast("long"))).when(t.rlike(r"^\d{10}$"), F.timestamp_seconds(F.try_to_number(t, F.lit("9999999999")).cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def calendar_features(df: DataFrame, col: str, reference: str | None = None) -> DataFrame:
    """Parts of a date, their sines and cosines, calendar flags, epoch seconds, and days to a reference time."""
    ts = F.col(col) if dict(df.dtypes)[col] != "string" else F.try_to_timestamp(F.col(col))
    ts = ts.cast("timestamp")
    month, day, hour, dow = F.month(ts), F.dayofmonth(ts), F.hour(ts), F.weekday(ts)
    last = F.dayofmonth(F.last_day(ts)) == day
    new = {"year": F.year(ts), "month": month, "day": day, "quarter": F.quarter(ts), "hour": hour, "minute": F.minute(ts), "dayofyear": F.dayofyear(ts), "dayofweek": dow, "weekofyear": F.weekofyear(ts), "is_weekend": (dow >= 5).cast("int")}
    for name, v, period in (("month", month, 12), ("day", day, 31), ("dayofweek", dow, 7), ("hour", hour, 24)):
        new |= {f"{name}_sin": F.sin(2 * math.pi * v / period), f"{name}_cos": F.cos(2 * math.pi * v / period)}
    new |= {"is_month_start": (day == 1).cast("int"), "is_month_end": last.cast("int"), "is_quarter_start": ((day == 1) & month.isin(1, 4, 7, 10)).cast("int"), "is_quarter_end": (last & month.isin(3, 6, 9, 12)).cast("int")}
    new |= {"is_year_start": ((month == 1) & (day == 1)).cast("int"), "is_year_end": ((month == 12) & (day == 31)).cast("int"), "timestamp": F.unix_timestamp(ts)}
    if reference:
        now = F.unix_timestamp(F.lit(reference).cast("timestamp"))
        new |= {"days_since_today": F.floor((now - F.unix_timestamp(ts)) / 86400), "is_future": (F.unix_timestamp(ts) > now).cast("int")}
    return df.withColumns({f"{col}_{k}": v for k, v in new.items()})


def series_features(df: DataFrame, value: str, order: list[str], partition: list[str], lags=(1, 2, 3), windows=(3, 7), expanding: bool = False, most: int = series.MOST) -> DataFrame:
    """{x}_lag_{k}, {x}_rolling_{mean,std,min,max}_{w} over the last w rows, and on demand expanding mean, std and sum.

    Without a partition key the whole table is one series. Series of over `most` rows are worked on in pieces; the order is then to tell rows apart.
    """
    return series.series_statistics(df, value, order, partition, lags, windows, expanding, most)
