"""The Chinese lunar calendar, computed from the motion of moon and sun (DT5, SUP2).

A month begins on the civil day of a new moon in China. The month that holds the winter solstice is the
eleventh. Where thirteen months run from one such month to the next, the first of them without a major
solar term (the sun passing a multiple of 30 degrees) is a leap month and bears the number before it.

New moons follow the series in Jean Meeus, Astronomical Algorithms, chapter 49, the sun chapter 25 with
the main perturbations, and the difference of dynamical and universal time the polynomials that NASA
publishes for eclipses. All are column expressions: the table of months is made by Spark from a range of
lunations, some 12.4 rows a year, and is the same at every size of data that is joined with it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Coefficient in days, power of the eccentricity factor, multiples of the sun's anomaly, the
#: moon's anomaly, the moon's argument of latitude and the longitude of its node.
_MOON = (
    (-0.40720, 0, 0, 1, 0, 0), (0.17241, 1, 1, 0, 0, 0), (0.01608, 0, 0, 2, 0, 0), (0.01039, 0, 0, 0, 2, 0), (0.00739, 1, -1, 1, 0, 0),
    (-0.00514, 1, 1, 1, 0, 0), (0.00208, 2, 2, 0, 0, 0), (-0.00111, 0, 0, 1, -2, 0), (-0.00057, 0, 0, 1, 2, 0), (0.00056, 1, 1, 2, 0, 0),
    (-0.00042, 0, 0, 3, 0, 0), (0.00042, 1, 1, 0, 2, 0), (0.00038, 1, 1, 0, -2, 0), (-0.00024, 1, -1, 2, 0, 0), (-0.00017, 0, 0, 0, 0, 1),
    (-0.00007, 0, 2, 1, 0, 0), (0.00004, 0, 0, 2, -2, 0), (0.00004, 0, 3, 0, 0, 0), (0.00003, 0, 1, 1, -2, 0), (0.00003, 0, 0, 2, 2, 0),
    (-0.00003, 0, 1, 1, 2, 0), (0.00003, 0, -1, 1, 2, 0), (-0.00002, 0, -1, 1, -2, 0), (-0.00002, 0, 1, 3, 0, 0), (0.00002, 0, 0, 4, 0, 0),
)
#: Degrees at lunation 0, degrees a lunation, coefficient in days (planets).
_PLANETS = (
    (299.77, 0.107408, 0.000325), (251.88, 0.016321, 0.000165), (251.83, 26.651886, 0.000164), (349.42, 36.412478, 0.000126), (84.66, 18.206239, 0.000110),
    (141.74, 53.303771, 0.000062), (207.14, 2.453732, 0.000060), (154.84, 7.306860, 0.000056), (34.52, 27.261239, 0.000047), (207.19, 0.121824, 0.000042),
    (291.34, 1.844379, 0.000040), (161.72, 24.198154, 0.000037), (239.56, 25.513099, 0.000035), (331.55, 3.592518, 0.000023),
)
#: Last year of a stretch, its origin, and seconds of dynamical minus universal time as a polynomial of the years since.
_DELTA = (
    (1920, 1900, (-2.79, 1.494119, -0.0598939, 0.0061966, -0.000197)),
    (1941, 1920, (21.20, 0.84493, -0.076100, 0.0020936)),
    (1961, 1950, (29.07, 0.407, -1 / 233, 1 / 2547)),
    (1986, 1975, (45.45, 1.067, -1 / 260, -1 / 718)),
    (2005, 2000, (63.86, 0.3345, -0.060374, 0.0017275, 0.000651814, 0.00002373599)),
    (2050, 2000, (62.92, 0.32217, 0.005589)),
    (2150, 1820, (-205.724, 0.5628, 0.0032)),
)
#: The festivals of a lunar month and day, with their names in questions.
LUNAR_FESTIVALS = {
    "春节": (1, 1, ("农历新年", "大年初一", "正月初一", "过年", "春节")),
    "元宵节": (1, 15, ("元宵节", "上元节", "正月十五", "元宵")),
    "端午节": (5, 5, ("端午节", "龙舟节", "端阳节", "端午")),
    "七夕节": (7, 7, ("七夕节", "乞巧节", "七夕", "中国情人节")),
    "中秋节": (8, 15, ("中秋节", "八月节", "中秋")),
    "重阳节": (9, 9, ("重阳节", "老年节", "重阳", "九九重阳节")),
    "腊八节": (12, 8, ("腊八节", "腊八")),
}
_DAY_ZERO = 2451545  # the Julian day number of 2000-01-01


def _poly(x: Column, *coefficients: float) -> Column:
    return reduce(lambda total, c: total * x + F.lit(float(c)), reversed(coefficients), F.lit(0.0))


def _sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def _with_delta(df: DataFrame, jd: str) -> DataFrame:
    """``df`` with ``delta`` and ``zone`` in days: dynamical minus universal time, and China's civil time (Peking's own until 1928)."""
    df = df.withColumn("_year", (F.col(jd) - 2451544.5) / 365.2425 + 2000)
    delta = None
    for last, origin, series in _DELTA:
        value = _poly(F.col("_year") - origin, *series) / 86400
        delta = F.when(F.col("_year") < last, value) if delta is None else delta.when(F.col("_year") < last, value)
    zone = F.when(F.col(jd) < 2425612.5, F.lit((7 * 3600 + 45 * 60 + 40) / 86400)).otherwise(F.lit(8 / 24))
    return df.withColumns({"delta": delta, "zone": zone}).drop("_year")


def new_moons(lunations: DataFrame) -> DataFrame:
    """k and day: the civil day in China, as days since 2000-01-01, of each new moon k; 0 is that of January 2000."""
    k, t = F.col("k").cast("double"), F.col("t")
    df = lunations.select("k", (k / 1236.85).alias("t"))
    df = df.select(
        "k",
        "t",
        (_poly(t, 2451550.09766, 0, 0.00015437, -0.000000150, 0.00000000073) + k * 29.530588861).alias("mean"),
        _poly(t, 1, -0.002516, -0.0000074).alias("e"),
        (k * 29.10535670 + _poly(t, 2.5534, 0, -0.0000014, -0.00000011)).alias("sun"),
        (k * 385.81693528 + _poly(t, 201.5643, 0, 0.0107582, 0.00001238, -0.000000058)).alias("moon"),
        (k * 390.67050284 + _poly(t, 160.7108, 0, -0.0016118, -0.00000227, 0.000000011)).alias("latitude"),
        (k * -1.56375588 + _poly(t, 124.7746, 0, 0.0020672, 0.00000215)).alias("node"),
    )
    sun, moon, latitude, node = map(F.col, ("sun", "moon", "latitude", "node"))
    terms = [_sin(sun * a + moon * b + latitude * c + node * d) * F.lit(size) * F.pow(F.col("e"), F.lit(p)) for size, p, a, b, c, d in _MOON]
    terms += [_sin(k * rate + F.lit(start) + (t * t * -0.009173 if i == 0 else F.lit(0.0))) * F.lit(size) for i, (start, rate, size) in enumerate(_PLANETS)]
    df = _with_delta(df.select("k", reduce(add, terms, F.col("mean")).alias("exact")), "exact")
    return df.select("k", (F.floor(F.col("exact") - F.col("delta") + F.col("zone") + 0.5) - _DAY_ZERO).cast("int").alias("day"))


def with_sun(df: DataFrame, day: str) -> DataFrame:
    """``df`` with the sun's apparent longitude in degrees when ``day`` (as above) begins in China, as ``longitude``."""
    t, u, m = F.col("_t"), F.col("_t") + 1, F.col("_m")  # u: centuries since 1900, near enough for the perturbations
    out = _with_delta(df.withColumn("_local", F.col(day) + F.lit(_DAY_ZERO - 0.5)), "_local")
    out = out.withColumn("_t", (F.col("_local") - F.col("zone") + F.col("delta") - 2451545.0) / 36525)
    out = out.withColumn("_m", _poly(t, 357.52911, 35999.05029, -0.0001537))
    centre = _poly(t, 1.914602, -0.004817, -0.000014) * _sin(m) + _poly(t, 0.019993, -0.000101) * _sin(m * 2) + _sin(m * 3) * 0.000289
    planets = (
        _sin(u * 22518.7541 + 153.23 + 90) * 0.00134
        + _sin(u * 45037.5082 + 216.57 + 90) * 0.00154
        + _sin(u * 32964.3577 + 312.69 + 90) * 0.00200
        + _sin(_poly(u, 350.74, 445267.1142, -0.00144)) * 0.00179
        + _sin(u * 20.20 + 231.19) * 0.00178
    )
    nutation = _sin(_poly(t, 125.04, -1934.136)) * -0.00478 - 0.00569
    longitude = F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032) + centre + planets + nutation, F.lit(360.0))
    return out.select(*df.columns, longitude.alias("longitude"))


def lunar_months(spark: SparkSession, first: int = 1900, last: int = 2099) -> DataFrame:
    """lunar_year, lunar_month, leap, start (date) and days of every month of the lunar years from ``first`` to ``last``."""
    begin, end = (int((y - 2000) * 12.3685) for y in (first - 2, last + 3))
    along = Window.orderBy("k")  # over a few thousand rows, made here
    moons = with_sun(new_moons(spark.range(begin, end).withColumnRenamed("id", "k")), "day").select("k", "day", F.floor(F.col("longitude") / 30).alias("a"))
    moons = moons.withColumns({"next": F.lead("day").over(along), "b": F.lead("a").over(along)})
    eleventh = F.col("a").between(7, 8) & (F.col("b") >= 9)
    marked = moons.select("k", "day", "next", (F.col("a") == F.col("b")).alias("bare"), F.when(eleventh, F.col("k")).alias("k11"))
    placed = marked.select(
        "*",
        F.max("k11").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("from"),
        F.min("k11").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("to"),
    ).where(F.col("from").isNotNull() & F.col("to").isNotNull())
    round_ = Window.partitionBy("from")
    date = F.date_add(F.lit("2000-01-01").cast("date"), F.col("day"))
    placed = placed.select(
        "day",
        "next",
        (F.col("k") - F.col("from")).alias("place"),
        F.min(F.when(F.col("bare") & (F.col("to") - F.col("from") == 13) & (F.col("k") > F.col("from")), F.col("k") - F.col("from"))).over(round_).alias("leap_place"),
        F.min(F.year(date)).over(round_).alias("solstice_year"),
    )
    number = F.pmod(F.col("place") + 10 - F.when(F.col("place") >= F.col("leap_place"), 1).otherwise(0), F.lit(12)) + 1
    out = placed.select(
        (F.col("solstice_year") + F.when(number >= 11, 0).otherwise(1)).cast("int").alias("lunar_year"),
        number.cast("int").alias("lunar_month"),
        F.coalesce(F.col("place") == F.col("leap_place"), F.lit(False)).alias("leap"),
        date.alias("start"),
        (F.col("next") - F.col("day")).cast("int").alias("days"),
    )
    return out.where(F.col("lunar_year").between(first, last))


def festival_days(months: DataFrame, festivals: dict[str, tuple[int, int, tuple[str, ...]]] = LUNAR_FESTIVALS) -> DataFrame:
    """festival, year, day: the first day of each solar year on which each lunar festival falls; leap months have none."""
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("festival"), F.lit(m).alias("month"), F.lit(d).alias("date")) for n, (m, d, _) in festivals.items()]))
    hit = months.where(~F.col("leap")).withColumn("f", listed).where((F.col("f.month") == F.col("lunar_month")) & (F.col("f.date") <= F.col("days")))
    day = F.date_add("start", F.col("f.date") - 1)
    return hit.groupBy(F.col("f.festival").alias("festival"), F.year(day).alias("year")).agg(F.min(day).alias("day"))
