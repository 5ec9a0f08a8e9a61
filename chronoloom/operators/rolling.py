"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.readings import readings

#: Days that one step of a gap makes at a time; bounds the arrays, not the result.
STEP = 4096


def daily_totals(samples: DataFrame) -> DataFrame:
    """Sparse daily totals of the readings: series_key, day (number), total, n."""
    return readings(samples).groupBy("series_key", "day").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def with_calendar(daily: DataFrame) -> DataFrame:
    """`daily` with a row for every day between a series' first and last active day.

    Inactive days get total 0, n 0 and active 0. Each sparse row brings the calendar rows up to the next active
    day of its series, so no calendar is joined and the window's partitioning by series serves both steps.
    """
    w = Window.partitionBy("series_key").orderBy("day")
    upto = F.coalesce(F.lead("day").over(w) - 1, F.col("day"))
    spread = daily.withColumn("_to", upto).withColumn("_s", F.explode(F.sequence("day", "_to", F.lit(STEP).cast("long"))))
    spread = spread.withColumn("_d", F.explode(F.sequence("_s", F.least(F.col("_to"), F.col("_s") + (STEP - 1)))))
    real = F.col("_d") == F.col("day")
    return spread.select(
        "series_key",
        F.col("_d").alias("day"),
        F.when(real, F.col("total")).otherwise(0.0).alias("total"),
        F.when(real, F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"),
        real.cast("long").alias("active"),
    )


def rolling_totals(samples: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and averages over trailing periods for each series and UTC day.

    Method: range frames over integer day numbers on sparse daily totals, with calendar rows for inactive days and
    fixed denominators. For each period p the columns are total_p, n_p (readings), active_p (days with a reading),
    per_day_p (total / p, whatever days were active) and mean_p (total / n, null without a reading).

    Null keys, times and values and NaN are no readings; equal rows count once; an empty table gives no rows; other
    columns of `samples` are ignored. Days run from the first reading's to the last one's.
    """
    out = with_calendar(daily_totals(samples))
    w = Window.partitionBy("series_key").orderBy("day")
    cols = [F.col("series_key"), F.col("day"), F.col("total"), F.col("n")]
    for p in periods:
        f = w.rangeBetween(-(p - 1), 0)
        total, n = F.sum("total").over(f), F.sum("n").over(f)
        cols += [
            total.alias(f"total_{p}"),
            n.alias(f"n_{p}"),
            F.sum("active").over(f).alias(f"active_{p}"),
            (total / F.lit(float(p))).alias(f"per_day_{p}"),
            F.when(n > 0, total / n).alias(f"mean_{p}"),
        ]
    return out.select(*cols)


def day_text(day: Column) -> Column:
    """YYYY-MM-DD of a day number."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd")


def busy_weeks(samples: DataFrame, share: float = 0.5, active: int = 20) -> DataFrame:
    """Days on which the trailing 7 days hold more than `share` of the trailing 30 days' total (series_key, active_day).

    At least `active` of the 30 days must have a reading.
    """
    r = rolling_totals(samples, (7, 30))
    return r.where((F.col("total_7") > F.lit(share) * F.col("total_30")) & (F.col("active_30") >= active)).select(
        "series_key", day_text(F.col("day")).alias("active_day")
    )
