"""Dates in mixed formats: parsing with precision, checks, standard forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import FORMATS

#: Formats that leave parts of a date out, with the parts that they have.
PARTIAL = [("yyyy-MM", "month", r"^\d{4}-\d{2}$"), ("MM/yyyy", "month", r"^\d{2}/\d{4}$"), ("MMM yyyy", "month", r"^[A-Za-z]{3} \d{4}$"), ("MMMM yyyy", "month", r"^[A-Za-z]{4,} \d{4}$"), ("yyyy", "year", r"^\d{4}$")]


def parse_date(text: Column, formats=FORMATS, day_first: bool = False) -> Column:
    """struct(ts, precision): the time that a text gives, and the finest part that it names (second, minute, day, month, year or epoch); null if nothing fits.

    Ambiguous dates with slashes are month first unless day_first. Ten digits are epoch seconds, thirteen milliseconds.
    """
    t = F.trim(text)
    order = (["dd/MM/yyyy", *formats] if day_first else [*formats, "dd/MM/yyyy"]) if "MM/dd/yyyy" in formats else list(formats)
    epoch = {r"^\d{13}$": F.timestamp_millis(F.try_to_number(t, F.lit("9999999999999")).cast("long")), r"^\d{10}$": F.timestamp_seconds(F.try_to_number(t, F.lit("9999999999")).cast("long"))}

    def found(ts: Column, precision: str) -> Column:
        return F.when(ts.isNotNull(), F.struct(ts.cast("timestamp").alias("ts"), F.lit(precision).alias("precision")))

    tried = [found(F.when(t.rlike(rx), v), "epoch") for rx, v in epoch.items()]
    tried += [found(F.when(t.rlike(rx), F.try_to_timestamp(t, F.lit(f))), p) for f, p, rx in PARTIAL]
    for f in order:
        tried.append(found(F.try_to_timestamp(t, F.lit(f)), "second" if "ss" in f else "minute" if "mm" in f else "day"))
    return F.coalesce(*tried)


def check_date(text: Column, parsed: Column, now: str, earliest: str = "1900-01-01") -> Column:
    """What is wrong with a date: 'missing', 'unparsable', 'future', 'too early', or null if nothing is."""
    ts = parsed["ts"]
    return F.when(text.isNull() | (F.trim(text) == ""), "missing").when(ts.isNull(), "unparsable").when(ts > F.lit(now).cast("timestamp"), "future").when(ts < F.lit(earliest).cast("timestamp"), "too early")


def date_columns(df: DataFrame, col: str, now: str, style: str = "iso", day_first: bool = False) -> DataFrame:
    """{col}_parsed, _precision, _problem, and _text in a standard form (iso or us), to the precision that is known."""
    forms = {"iso": {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}, "us": {"year": "yyyy", "month": "MM/yyyy", "day": "MM/dd/yyyy"}}[style]
    out = df.withColumn("_p", parse_date(F.col(col), day_first=day_first))
    ts, precision = F.col("_p.ts"), F.col("_p.precision")
    text = F.date_format(ts, f"{forms['day']} HH:mm:ss")
    for part, form in forms.items():
        text = F.when(precision == part, F.date_format(ts, form)).otherwise(text)
    return out.withColumns({f"{col}_parsed": ts, f"{col}_precision": precision, f"{col}_problem": check_date(F.col(col), F.col("_p"), now), f"{col}_text": text}).drop("_p")
