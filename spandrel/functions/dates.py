"""The Swedish calendar: holidays, working days and date shifts, as tables and Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 2005, 2100


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous algorithm of Meeus, Jones and Butcher."""
    q = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, q(year, 100), year % 100
    g = q(b - q(b + 8, 25) + 1, 3)
    h = (19 * a + b - q(b, 4) - g + 15) % 30
    m = (32 + 2 * (b % 4) + 2 * q(c, 4) - h - c % 4) % 7
    n = q(a + 11 * h + 22 * m, 451)
    s = h + m - 7 * n + 114
    return F.make_date(year, q(s, 31), s % 31 + 1)


def _saturday_from(day: Column) -> Column:
    return F.date_add(day, F.pmod(F.lit(7) - F.dayofweek(day), F.lit(7)))


def _fixed(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def holidays(year: Column) -> Column:
    """array<struct<day, name>>: the 13 public holidays of a year; every Sunday is one as well."""
    easter = easter_sunday(year)
    # Names and rules of Lag 1989:253.
    days = [
        (_fixed(year, 1, 1), "nyårsdagen"),
        (_fixed(year, 1, 6), "trettondedag jul"),
        (F.date_sub(easter, 2), "långfredagen"),
        (easter, "påskdagen"),
        (F.date_add(easter, 1), "annandag påsk"),
        (_fixed(year, 5, 1), "första maj"),
        (F.date_add(easter, 39), "Kristi himmelsfärdsdag"),
        (F.date_add(easter, 49), "pingstdagen"),
        (_fixed(year, 6, 6), "Sveriges nationaldag"),
        (_saturday_from(_fixed(year, 6, 20)), "midsommardagen"),
        (_saturday_from(_fixed(year, 10, 31)), "alla helgons dag"),
        (_fixed(year, 12, 25), "juldagen"),
        (_fixed(year, 12, 26), "annandag jul"),
    ]
    return F.array(*[F.struct(d.alias("day"), F.lit(n).alias("name")) for d, n in days])


def eves(year: Column) -> Column:
    """array<struct<day, name>>: eves that are no holidays by law but often counted as such."""
    days = [(F.date_sub(_saturday_from(_fixed(year, 6, 20)), 1), "midsommarafton"), (_fixed(year, 12, 24), "julafton"), (_fixed(year, 12, 31), "nyårsafton")]
    return F.array(*[F.struct(d.alias("day"), F.lit(n).alias("name")) for d, n in days])


def calendar(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """(day, holiday, eve, working, working_eves_off, ordinal, ordinal_eves_off): a dimension of a fixed number of days.

    ordinal counts working days up to and including the day.
    """
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    listed = lambda f, name: years.select(F.explode(f(F.col("year"))).alias("x")).groupBy("x.day").agg(F.min("x.name").alias(name))
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("day"))
    days = days.join(F.broadcast(listed(holidays, "holiday")), "day", "left").join(F.broadcast(listed(eves, "eve")), "day", "left")
    weekday = ~F.dayofweek("day").isin(1, 7) & F.col("holiday").isNull()
    days = days.withColumn("working", weekday).withColumn("working_eves_off", weekday & F.col("eve").isNull())
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("ordinal", F.sum(F.col("working").cast("int")).over(upto)).withColumn("ordinal_eves_off", F.sum(F.col("working_eves_off").cast("int")).over(upto))


def add_working_days(df: DataFrame, day: str, count: str, out: str, days: DataFrame, eves_off: bool = False) -> DataFrame:
    """df with out: the working day `count` working days after day (before it, if negative); the start is never counted.

    Zero gives the day itself; beyond the calendar the result is null.
    """
    work, ordinal = ("working_eves_off", "ordinal_eves_off") if eves_off else ("working", "ordinal")
    at = days.select(F.col("day").alias("at_"), F.col(ordinal).alias("have_"), F.col(work).cast("int").alias("is_"))
    to = days.filter(work).select(F.col("day").alias("to_"), F.col(ordinal).alias("want_"))
    started = df.join(F.broadcast(at), df[day] == F.col("at_"), "left")
    want = F.when(F.col(count) > 0, F.col("have_") + F.col(count)).when(F.col(count) < 0, F.col("have_") - F.col("is_") + 1 + F.col(count))
    met = started.withColumn("goal_", want).join(F.broadcast(to), F.col("goal_") == F.col("want_"), "left")
    return met.withColumn(out, F.when(F.col(count) == 0, F.col(day)).otherwise(F.col("to_"))).drop("at_", "have_", "is_", "goal_", "to_", "want_")


def shift(df: DataFrame, day: str, amount: str, unit: str, out: str, days: DataFrame) -> DataFrame:
    """df with out: day moved by amount units of days, working_days, weeks, months or years; months keep the day or take the month's last."""
    worked = add_working_days(df, day, amount, "worked_", days)
    n = F.col(amount)
    moved = (
        F.when(F.col(unit) == "days", F.date_add(day, n))
        .when(F.col(unit) == "weeks", F.date_add(day, n * 7))
        .when(F.col(unit) == "months", F.add_months(day, n))
        .when(F.col(unit) == "years", F.add_months(day, n * 12))
        .when(F.col(unit) == "working_days", F.col("worked_"))
    )
    return worked.withColumn(out, moved).drop("worked_")


def last_day_of_period(start: Column, months: Column) -> Column:
    """Start + months - 1 day: 2022-12-01 and 24 months end on 2024-11-30."""
    return F.date_sub(F.add_months(start, months), 1)


def end_outcome(end: Column, extension_months: Column, valid_to: Column, max_extension_to: Column) -> Column:
    """MATCH, EXTENSION_USED or DEVIATES: a stated end against the register's."""
    extended = F.date_sub(F.add_months(F.date_add(end, 1), extension_months), 1)
    limit = F.when(extension_months.isNotNull(), extended).otherwise(F.coalesce(max_extension_to, end))
    return F.when(end == valid_to, "MATCH").when((end < valid_to) & (valid_to <= limit), "EXTENSION_USED").otherwise("DEVIATES")


def iso_date(text: Column) -> Column:
    """A date written yyyy-MM-dd; null for anything else. A cast reads it several times as fast as a pattern does."""
    return F.when(F.trim(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.trim(text).try_cast("date"))
