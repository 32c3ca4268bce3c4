"""Column expressions that the queries share. Rounding is half up; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flown() -> Column:
    return F.col("CANCELLED") == 0


def completed() -> Column:
    return flown() & (F.col("DIVERTED") == 0)


def hour() -> Column:
    """hhmm to its hour, as bigint; null stays null and 2400 is 24."""
    return F.floor(F.col("CRS_DEP_TIME") / 100)


def share(flag: str, digits: int = 4) -> Column:
    """The percentage of rows whose flag is 1, of all rows."""
    return F.round(F.sum(flag) / F.count("*") * 100, digits)


def mean(value: Column | str, where: Column | None = None, digits: int = 4) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.round(F.avg(v if where is None else F.when(where, v)), digits)


def zero_filled(cause: str) -> Column:
    return F.coalesce(F.col(cause), F.lit(0.0))


def text(value: str) -> Column:
    """A value as served: text, and empty for null."""
    return F.coalesce(F.col(value).cast("string"), F.lit(""))


#: Feature names in their order.
BASE = ("avg_dep_delay", "avg_arr_delay", "cancellation_rate", "avg_carrier_delay", "avg_weather_delay", "avg_nas_delay", "avg_security_delay", "avg_late_aircraft")
EXTRA = ("std_dep_delay", "on_time_rate", "diverted_rate")


def features() -> dict[str, Column]:
    """Carrier features by name. Diverted flights count among the causes, as flown flights without one."""
    on_time, departed = F.count_if(flown() & (F.col("DEP_DELAY") <= 0)), F.count_if(flown())
    causes = dict(zip(BASE[3:], ("CARRIER_DELAY", "WEATHER_DELAY", "NAS_DELAY", "SECURITY_DELAY", "LATE_AIRCRAFT_DELAY"), strict=True))
    return {
        "avg_dep_delay": mean("DEP_DELAY", flown()),
        "avg_arr_delay": mean("ARR_DELAY", completed()),
        "cancellation_rate": share("CANCELLED"),
        **{name: mean(zero_filled(cause), flown()) for name, cause in causes.items()},
        "std_dep_delay": F.round(F.stddev_samp(F.when(flown(), F.col("DEP_DELAY"))), 4),
        "on_time_rate": F.round(F.try_divide(on_time, departed) * 100, 4),
        "diverted_rate": share("DIVERTED"),
    }
