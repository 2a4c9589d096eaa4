"""Trading calendars and sequences of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = "America/New_York"


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All dates from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("calendar_date"))


def trading_calendar(spark: SparkSession, start: str, end: str, exchanges: list[str], holidays: dict[str, str], early_closes: list[str] = ()) -> DataFrame:
    """Per exchange and date: whether it trades, local sessions 09:30 to 16:00 (13:00 on early closes) in UTC, and the holiday.

    The zone is part of the text that is cast, so the session's zone has no say in the instants."""
    days = date_spine(spark, start, end).withColumn("exchange_mic", F.explode(F.array(*[F.lit(x) for x in exchanges])))
    names = F.create_map(*[F.lit(x) for pair in holidays.items() for x in pair]) if holidays else F.create_map().cast("map<string,string>")
    day = F.col("calendar_date").cast("string")
    days = days.withColumn("holiday_name", F.try_element_at(names, day)).withColumn("is_weekend", F.dayofweek("calendar_date").isin(1, 7))
    days = days.withColumn("is_trading_day", ~F.col("is_weekend") & F.col("holiday_name").isNull())
    days = days.withColumn("is_early_close", F.col("is_trading_day") & day.isin(*early_closes) if early_closes else F.lit(False))

    def at(time):
        return F.when(F.col("is_trading_day"), F.concat_ws(" ", day, time, F.lit(ZONE)).cast("timestamp"))

    return days.withColumns({"market_open_utc": at(F.lit("09:30:00")), "market_close_utc": at(F.when(F.col("is_early_close"), "13:00:00").otherwise("16:00:00"))})


def calendar_checks(calendar: DataFrame) -> DataFrame:
    """Per exchange: days, sessions, early closes, and whether dates are without gap and sessions of the right length."""
    minutes = (F.unix_timestamp("market_close_utc") - F.unix_timestamp("market_open_utc")) / 60
    right = ~F.col("is_trading_day") | (minutes == F.when(F.col("is_early_close"), 210).otherwise(390))
    return calendar.groupBy("exchange_mic").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if("is_trading_day").alias("sessions"),
        F.count_if("is_early_close").alias("early_closes"),
        (F.datediff(F.max("calendar_date"), F.min("calendar_date")) + 1 == F.count_distinct("calendar_date")).alias("is_contiguous"),
        F.bool_and(right).alias("has_right_durations"),
    )


def session_pairs(sessions: DataFrame, date_col: str = "calendar_date", by: str = "exchange_mic") -> DataFrame:
    """Each session with the next one of its exchange."""
    w = Window.partitionBy(by).orderBy(date_col)
    return sessions.withColumn("next_date", F.lead(date_col).over(w)).where("next_date is not null")


def publish_calendar(target: DataFrame, rows: DataFrame, hash_col: str = "record_hash") -> DataFrame:
    """New rows only. Raises if a key is there already with other content."""
    from riskloom.operators.merge import insert_only

    keys = ["exchange_mic", "calendar_date"]
    clash = rows.join(target.select(*keys, F.col(hash_col).alias("__have")), keys).where(F.col("__have") != F.col(hash_col))
    if not clash.isEmpty():
        raise ValueError("the calendar holds other content for some of these dates")
    return insert_only(target, rows, keys)
