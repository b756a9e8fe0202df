"""Calendar helpers over zone-free timestamps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_moment(df: DataFrame, name: str) -> Column:
    """A column as TIMESTAMP_NTZ; text that is not a timestamp becomes null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.trim(F.col(name)).try_cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down also when negative."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    days = F.datediff(later, earlier)
    overshoot = earlier + F.make_dt_interval(days) > later
    return (days - overshoot.cast("int")).cast("int")


def month_of(moment: Column | str) -> Column:
    return F.date_format(F.to_date(moment), "yyyy-MM")


def month_index(month: Column | str) -> Column:
    """Months since year 0 of a ``yyyy-MM`` text, for month differences."""
    month = F.col(month) if isinstance(month, str) else month
    return month.substr(1, 4).cast("int") * 12 + month.substr(6, 2).cast("int")
