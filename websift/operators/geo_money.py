"""Currency conversion (J14) and spatial filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Exchange rates of the shipped currency configuration (from, to, rate).
RATES = [
    ("USD", "ARS", 4.333871),
    ("USD", "AUD", 1.025768),
    ("USD", "EUR", 0.743676),
    ("USD", "BRL", 1.881093),
    ("USD", "CAD", 1.030815),
    ("USD", "CLP", 519.0996),
    ("USD", "CNY", 6.387310),
    ("USD", "CZK", 18.47134),
    ("USD", "DKK", 5.515436),
    ("USD", "HKD", 7.801922),
    ("USD", "HUF", 215.6169),
    ("USD", "ISK", 118.1280),
    ("USD", "INR", 49.49088),
    ("USD", "XDR", 0.641358),
    ("USD", "ILS", 3.709739),
    ("USD", "JPY", 76.32419),
    ("USD", "KRW", 1169.173),
    ("USD", "KWD", 0.275142),
    ("USD", "MXN", 13.85895),
    ("USD", "NZD", 1.285159),
    ("USD", "NOK", 5.859035),
    ("USD", "PKR", 87.57007),
    ("USD", "PEN", 2.730683),
    ("USD", "PHP", 43.62039),
    ("USD", "PLN", 3.310139),
    ("USD", "RON", 3.100932),
    ("USD", "RUB", 32.14663),
    ("USD", "SAR", 3.750465),
    ("USD", "SGD", 1.299352),
    ("USD", "ZAR", 8.329761),
    ("USD", "SEK", 6.883442),
    ("USD", "CHF", 0.906035),
    ("USD", "TWD", 30.40283),
    ("USD", "THB", 30.89487),
    ("USD", "AED", 3.672955),
    ("USD", "UAH", 7.988582),
    ("USD", "GBP", 0.647910),
    ("EUR", "GBP", 0.869914),
    ("EUR", "NOK", 7.800095),
    ("GBP", "NOK", 8.966508),
]
DEFAULT_CURRENCY = "USD"
EARTH_RADIUS_KM = 6371.0087714


def rate_rows(rates=RATES) -> list[tuple[str, str, float]]:
    """(src, dst, rate): direct rates and their inverses, plus identity."""
    rows = {}
    for a, b, r in rates:
        rows.setdefault((a, b), r)
        rows.setdefault((b, a), 1.0 / r)
    for c in {x for a, b, _ in rates for x in (a, b)}:
        rows[(c, c)] = 1.0
    return [(a, b, r) for (a, b), r in sorted(rows.items())]


def rate_table(spark: SparkSession, rates=RATES) -> DataFrame:
    return spark.createDataFrame(rate_rows(rates), "src string, dst string, rate double")


def with_converted(df: DataFrame, amount: str, code: str, target: str, rates: DataFrame, out: str) -> DataFrame:
    """Amount in ``code`` → ``target`` by the direct (or inverse) rate, else through USD.

    The rate table is fixed configuration (a few dozen rows): broadcast joins."""
    r = F.broadcast(rates)
    direct = r.where(F.col("dst") == target).select(F.col("src").alias("_c1"), F.col("rate").alias("_direct"))
    to_usd = r.where(F.col("dst") == DEFAULT_CURRENCY).select(F.col("src").alias("_c2"), F.col("rate").alias("_to_usd"))
    usd_to = r.where((F.col("src") == DEFAULT_CURRENCY) & (F.col("dst") == target)).select(F.col("rate").alias("_usd_to"))
    usd_rate = usd_to.first()
    usd_rate = usd_rate[0] if usd_rate else None
    d = df.join(direct, F.col(code) == F.col("_c1"), "left").join(to_usd, F.col(code) == F.col("_c2"), "left")
    via = F.col("_to_usd") * F.lit(usd_rate) if usd_rate is not None else F.lit(None).cast("double")
    return d.withColumn(out, F.col(amount) * F.coalesce(F.col("_direct"), via)).drop("_c1", "_direct", "_c2", "_to_usd")


def haversine_km(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(F.lit(lat2))
    dlat = F.radians(F.lit(lat2) - lat1)
    dlon = F.radians(F.lit(lon2) - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def within(df: DataFrame, lat: str, lon: str, pt: tuple[float, float], km: float) -> DataFrame:
    """rows within ``km`` of ``pt``; a latitude box is checked first (prunable)."""
    dlat = km / 111.19492664455873  # km per degree of latitude on the sphere
    box = F.col(lat).between(pt[0] - dlat, pt[0] + dlat)
    return df.where(box).withColumn("dist_km", haversine_km(F.col(lat), F.col(lon), pt[0], pt[1])) \
        .where(F.col("dist_km") <= km)


KM_PER_DEGREE = 111.19492664455873  # of latitude on the sphere
MAX_LEVEL = 16  # cells of level j are 360 / 2**j degrees wide and high
EDGE = 1e-9  # degrees that a cover reaches beyond its box, for rounding


def _cell_x(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * cells), cells)


def _cell_y(lat: Column, cells: Column) -> Column:
    return F.floor((lat + 90) / 360 * cells)


def boxes(points: DataFrame) -> DataFrame:
    """Points (point_id, lat, lon, km) with the half height ``dlat`` and half width ``dlon`` of the box around their
    circle, in degrees; a box that holds a pole has all longitudes."""
    r = F.col("km") / EARTH_RADIUS_KM
    polar = F.abs("lat") + F.degrees(r) >= 90
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(r) / F.cos(F.radians("lat")))))
    return points.where("lat between -90 and 90 and lon is not null and km >= 0").withColumns({
        "dlat": F.degrees(r), "dlon": F.when(polar, F.lit(180.0)).otherwise(width)})


def near_points(rows: DataFrame, points: DataFrame, lat: str = "lat", lon: str = "lon", mode: str = "circle") -> DataFrame:
    """F14 for a batch of points: the rows within ``km`` of each point (``circle``) or in the box around that circle
    (``box``), as point_id, the columns of ``rows``, dist_km.

    Every point takes the level whose cells are about as high as its radius, and covers its box by cells of it; longitudes
    wrap at 180 degrees.  A row lies in one cell of each level in use, so (level, cell) is an equi-join that gives a
    pair once, and the exact test follows.  A cover has three or four rows of cells; only a box that holds a pole or comes
    near it covers whole circles of latitude.  The join is followed by filters alone, so Spark can split a hot cell.

    Longitudes may have any turn; rows and points with a null coordinate or a latitude beyond 90 degrees find nothing, nor
    does a null or negative ``km``.  ``rows`` may not have columns named like those this adds (``_`` before their names)."""
    if mode not in ("circle", "box"):
        raise ValueError(f"unknown mode {mode}")
    p = boxes(points)
    level = F.when(F.col("dlat") > 0, F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(1), F.floor(F.log2(F.lit(360.0) / F.col("dlat")))))).otherwise(MAX_LEVEL)
    p = p.withColumn("level", level.cast("int"))
    levels = sorted(r["level"] for r in p.select("level").distinct().collect())  # at most MAX_LEVEL numbers
    cells = F.pow(F.lit(2.0), F.col("level")).cast("long")
    low, high = (_cell_y(x, cells) for x in (F.greatest(F.lit(-90.0), F.col("lat") - F.col("dlat") - EDGE),
                                             F.least(F.lit(90.0), F.col("lat") + F.col("dlat") + EDGE)))
    west, east = (F.floor((F.col("lon") + s * (F.col("dlon") + EDGE) + 180) / 360 * cells) for s in (-1, 1))
    xs = F.when(east - west + 1 >= cells, F.sequence(F.lit(0).cast("long"), cells - 1)) \
        .otherwise(F.transform(F.sequence(west, east), lambda x: F.pmod(x, cells)))
    p = p.select(F.col("point_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("km").alias("_km"), F.col("dlat").alias("_dlat"),
                 F.col("dlon").alias("_dlon"), F.col("level").alias("_level"), F.explode(F.sequence(low, high)).alias("_y"), xs.alias("_xs")) \
        .withColumn("_x", F.explode("_xs")).drop("_xs")
    row_cells = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    r = rows.where(F.col(lat).between(-90, 90) & F.col(lon).isNotNull()) \
        .withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))) \
        .withColumns({"_y": _cell_y(F.col(lat), row_cells), "_x": _cell_x(F.col(lon), row_cells)})
    cell = ["_level", "_y", "_x"]
    # few bytes make many pairs, so Spark would put all cells into few tasks: their number is set, and both sides are shuffled
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = r.repartition(tasks, *cell).join(p.repartition(tasks, *cell).hint("shuffle_hash"), cell)
    p1, p2 = F.radians(F.col(lat)), F.radians(F.col("_lat"))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(F.col("_lon") - F.col(lon)) / 2), 2)
    pairs = pairs.withColumn("dist_km", F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))
    turn = F.abs(F.pmod(F.col(lon) - F.col("_lon") + 180, F.lit(360.0)) - 180)
    inside = F.col("dist_km") <= F.col("_km") if mode == "circle" else (F.abs(F.col(lat) - F.col("_lat")) <= F.col("_dlat")) & (turn <= F.col("_dlon"))
    # most pairs of a cell fail at the latitude, which costs far less than the distance
    near = F.abs(F.col(lat) - F.col("_lat")) <= F.col("_dlat") + EDGE
    return pairs.where(near & inside).select("point_id", *rows.columns, "dist_km")
