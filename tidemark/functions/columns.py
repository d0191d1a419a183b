"""Column expressions: casts, calendar parts, guarded arithmetic, rule labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_wall_clock(c: Column | str, pattern: str) -> Column:
    """Text to TIMESTAMP_NTZ; null when it does not parse.

    The text is read as if it were UTC, so no wall-clock time is shifted by the session zone.
    """
    instant = F.try_to_timestamp(
        F.concat(to_column(c), F.lit(" +0000")), F.lit(f"{pattern} Z")
    )
    seconds = F.unix_seconds(instant).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds
    )


def to_int(c: Column | str) -> Column:
    """Tolerant whole number: text with a fraction is rounded, null outside the range of an int."""
    value = F.round(to_double(c))
    return F.when(value.between(-(2**31), 2**31 - 1), value).cast("int")


def to_double(c: Column | str) -> Column:
    """Tolerant number: null instead of an error, and null instead of NaN."""
    value = to_column(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def is_weekend(c: Column | str) -> Column:
    return F.weekday(to_column(c)) >= 5


def with_calendar(df: DataFrame, column: str) -> DataFrame:
    """Add year, month, day, dayofweek (Monday = 0), hour, is_weekend and date parts."""
    c = F.col(column)
    return df.withColumns(
        {
            "year": F.year(c),
            "month": F.month(c),
            "day": F.dayofmonth(c),
            "dayofweek": F.weekday(c),
            "hour": F.hour(c.cast("timestamp_ntz")),
            "is_weekend": is_weekend(c),
            "date": F.to_date(c),
        }
    )


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(to_column(year), to_column(month), F.lit(1))


def year_month(year: Column | str, month: Column | str) -> Column:
    return F.concat_ws(
        "-", to_column(year).cast("string"), F.lpad(to_column(month).cast("string"), 2, "0")
    )


def same_text(c: Column | str, text: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(to_column(c)) == F.lower(F.lit(text))


def inside(c: Column | str, low: float, high: float) -> Column:
    """Open interval; null is outside."""
    c = to_column(c)
    return (c > low) & (c < high)


def positive(c: Column | str) -> Column:
    c = to_column(c)
    return c.isNotNull() & (c > 0)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division with null for a zero denominator."""
    return F.try_divide(to_column(numerator).cast("double"), to_column(denominator).cast("double"))


def zero_to_one(c: Column | str) -> Column:
    c = to_column(c)
    return F.when(c == 0, F.lit(1)).otherwise(c)


def clip(c: Column | str, low=None, high=None) -> Column:
    """Bound a column; null stays null. Bounds may be numbers or columns."""
    source = to_column(c)
    bounded = source
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(source.isNotNull(), bounded)


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows where the condition holds (null rows are skipped)."""
    return F.avg(condition.cast("double"))


def masked_mean(mask: Column, value: Column | str) -> Column:
    """Aggregate: mean over the rows where the mask holds."""
    return F.avg(F.when(mask, to_column(value)))


def rule_label(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching rule wins."""
    condition, label = rules[0]
    chain = F.when(condition, F.lit(label))
    for condition, label in rules[1:]:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def significance_stars(p: Column | str) -> Column:
    p = to_column(p)
    return rule_label([(p < 0.001, "***"), (p < 0.01, "**"), (p < 0.05, "*")], "ns")


def recovery_tier(rate: Column | str) -> Column:
    rate = to_column(rate)
    return rule_label([(rate >= 0.9, "HIGH"), (rate >= 0.75, "MID")], "LOW")


def map_code(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Code to label; an unknown code stays as it is. The mapping is a parameter, so it is small."""
    c = to_column(c)
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def positive_count(columns: Sequence[str]) -> Column:
    """Row-wise number of columns above zero."""
    return row_sum([F.when(F.col(c) > 0, 1).otherwise(0) for c in columns])


def row_sum(columns: Sequence[Column | str]) -> Column:
    total = to_column(columns[0])
    for c in columns[1:]:
        total = total + to_column(c)
    return total
