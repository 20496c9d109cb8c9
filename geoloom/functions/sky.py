"""The sun, the weather and the air at a place, in numbers and in words, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geo import half_up

# Upper ends of the bands of what to advise, least concentrations (in micrograms a cubic metre) worth a word.
AIR_ADVICE = (
    (20, "advisory: clean air - no constraint"),
    (40, "advisory: fair air - no constraint for most people"),
    (60, "advisory: moderate air - long outdoor exertion has a polluting cost"),
    (80, "advisory: poor air - sensitive groups should shorten outdoor exertion"),
    (100, "advisory: very poor air - sensitive groups stay in if they can, everyone shortens exertion"),
    (None, "advisory: extremely poor air - keep outdoor exposure minimal for everyone"),
)
AIR_UNKNOWN = "advisory: air quality unknown - do not describe conditions"
GASES = (("no2", "NO2", 50), ("ozone", "O3", 100), ("so2", "SO2", 100), ("co", "CO", 4000))
ADVICE = {
    "snow": "advisory: snow or sleet - expect longer journey times and check for disruption before leaving.",
    "hail": "advisory: thunderstorm with hail - staying indoors is the safe choice.",
    "ice": "advisory: rain and near freezing - surfaces will be icy, allow much longer on foot.",
    "rain": "advisory: rain - take a jacket, and expect a slower drive than usual.",
    "wind": "advisory: strong wind - cycling and walking exposed routes will be unpleasant.",
    "frost": "advisory: below freezing - icy surfaces, allow extra time.",
    "none": "advisory: nothing that should change an outdoor plan.",
}
SEVERITY = {"severe": 5, "heavy": 4, "moderate": 3, "light": 2, "free": 1}


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def number(x: Column) -> Column:
    """``x`` to one place, without a trailing zero; ? where it is unknown."""
    v = half_up(x.cast("double"), 1)
    whole = v == F.floor(v)
    return F.when(~_known(x), "?").otherwise(F.when(whole, F.floor(v).cast("string")).otherwise(v.cast("string")))


def precipitation(rain: Column, snow: Column, code: Column) -> Column:
    """What falls, by the amounts of rain and snow and the weather code."""
    wet = F.when((code >= 51) & (code <= 57), "drizzle").otherwise("rain")
    e = F.when((snow > 0) & (rain > 0), "sleet").when(snow > 0, "snow").when(code >= 95, "hail")
    return e.when(code.isin(85, 86), "snow").when(rain > 0, wet).otherwise("none")


def weather_advice(falls: Column, celsius: Column, wind_kmh: Column) -> Column:
    e = F.when(falls.isin("snow", "sleet"), ADVICE["snow"]).when(falls == "hail", ADVICE["hail"])
    e = e.when(falls.isin("rain", "drizzle") & _known(celsius) & (celsius <= 3), ADVICE["ice"]).when(falls.isin("rain", "drizzle"), ADVICE["rain"])
    return e.when(_known(wind_kmh) & (wind_kmh >= 40), ADVICE["wind"]).when(_known(celsius) & (celsius <= 0), ADVICE["frost"]).otherwise(ADVICE["none"])


def air_advice(index: Column) -> Column:
    e = F.when(~_known(index), AIR_UNKNOWN)
    for most, words in AIR_ADVICE:
        e = e.otherwise(words) if most is None else e.when(index <= most, words)
    return e


def elevated_gases(**readings: Column) -> Column:
    """Names and readings of the gases (no2, ozone, so2, co) beyond their good bound, as an array."""
    told = [F.when(_known(readings[k]) & (readings[k] > least), F.concat(F.lit(f"{name} "), readings[k].cast("string"))) for k, name, least in GASES if k in readings]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def severity(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[level], F.lit(0))


def delay_seconds(stated: Column, free_flow_seconds: Column, mean_ratio: Column) -> Column:
    """A delay: the stated one if there is any, else what the mean share of free speed makes of the time without traffic."""
    return F.when(stated > 0, stated.cast("double")).otherwise(half_up(free_flow_seconds * (F.lit(1.0) / F.greatest(F.lit(0.2), F.coalesce(mean_ratio, F.lit(1.0))) - 1)).cast("double"))


def sun(lat: Column, lon: Column, at: Column) -> dict[str, Column]:
    """Elevation and azimuth of the sun in degrees, twilight, minutes of sunrise and sunset from UTC midnight, and polar.

    By the low-precision formulas of the almanac: mean anomaly, ecliptic longitude and obliquity from the days since 2000,
    then the equation of time. Sunrise and sunset are null where the sun does not cross -0.833 degrees.
    """
    julian = F.unix_micros(at.cast("timestamp")) / 86_400_000_000.0 + 2440587.5
    d = julian - 2451545.0
    anomaly, tilt = F.radians(d * 0.98560028 + 357.5291), F.radians(F.lit(23.439) - d * 0.0000004)
    declination = F.asin(F.sin(tilt) * F.sin(F.radians(d * 0.98564736 + 280.459)))
    y, e = F.pow(F.tan(tilt / 2), 2), 0.016708634
    equation = F.degrees(y * F.sin(anomaly * 2) - F.sin(anomaly) * (2 * e) + y * F.sin(anomaly) * F.cos(anomaly * 2) * (4 * e) - y * y * F.sin(anomaly * 4) * 0.5 - F.sin(anomaly * 2) * (1.25 * e * e)) * 4
    solar = F.pmod(F.pmod(julian + 0.5, F.lit(1.0)) * 1440 + equation + lon * 4, F.lit(1440.0))
    hour, here = solar / 4 - 180, F.radians(lat)
    bounded = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    zenith = F.acos(bounded(F.sin(here) * F.sin(declination) + F.cos(here) * F.cos(declination) * F.cos(F.radians(hour))))
    elevation = F.lit(90.0) - F.degrees(zenith)
    across = F.cos(here) * F.sin(zenith)
    turned = F.degrees(F.acos(bounded((F.sin(here) * F.cos(zenith) - F.sin(declination)) / across)))
    azimuth = F.when(F.abs(across) > 1e-9, F.when(hour > 0, F.lit(360.0) - turned).otherwise(turned)).otherwise(F.when(lat >= 0, 180.0).otherwise(0.0))
    cut = (math.sin(math.radians(-0.833)) - F.sin(here) * F.sin(declination)) / (F.cos(here) * F.cos(declination))
    noon, half = F.lit(720.0) - lon * 4 - equation, F.degrees(F.acos(cut)) * 4
    rises = (cut >= -1) & (cut <= 1)
    return {
        "elevation": half_up(elevation, 1),
        "azimuth": half_up(azimuth).cast("long"),
        "twilight": F.when(elevation > 6, "day").when(elevation > -0.833, "civil").when(elevation > -12, "nautical").otherwise("night"),
        "sunrise": F.when(rises, half_up(noon - half).cast("long")),
        "sunset": F.when(rises, half_up(noon + half).cast("long")),
        "polar": F.when(cut > 1, "night").when(cut < -1, "day"),
    }


def needs_light(elevation: Column) -> Column:
    return elevation < 6


def local_clock(instant: Column, zone: str) -> dict[str, Column]:
    """Minute of the day, date as a number and weekday (0 is Sunday) of a UTC instant in a named time zone."""
    local = F.from_utc_timestamp(instant, zone)
    return {
        "minute": F.hour(local) * 60 + F.minute(local),
        "date": F.date_format(local, "yyyyMMdd").cast("int"),
        "weekday": F.dayofweek(local) - 1,
    }


def service_epoch(date: Column, minutes: Column, zone: str) -> Column:
    """Epoch seconds of a service clock, past 24 hours too, on a date (as a number) in a named time zone."""
    day = F.to_timestamp(date.cast("string"), "yyyyMMdd")
    wall = F.timestamp_seconds(F.unix_timestamp(day) + minutes * 60)
    return F.unix_timestamp(F.to_utc_timestamp(wall, zone))


def forecast_rows(at: Column, **series: Column) -> Column:
    """Rows of a forecast that comes as one array for each reading; readings a series lacks are null."""
    names = list(series)
    return F.transform(at, lambda t, i: F.struct(t.alias("at"), *[F.get(series[n], i).alias(n) for n in names]))
