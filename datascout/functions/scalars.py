"""Column expressions that the catalog, discovery and profiling jobs share.  All give null, never an error, on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column names that hint at latitudes, longitudes and dates; a WKT point of two numbers.
LAT_NAME = r"(?i)(^|[^a-z])(lat|latitude)([^a-z]|$)"
LON_NAME = r"(?i)(^|[^a-z])(lon|lng|long|longitude)([^a-z]|$)"
DATE_NAME = r"(?i)(^|[^a-z])(date|time|timestamp|created|updated|opened|closed|start|end)([^a-z]|$)"
WKT_POINT = r"(?i)POINT\s*\(\s*([-+]?\d+(?:\.\d+)?)\s+([-+]?\d+(?:\.\d+)?)\s*\)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FOUR_BY_FOUR = r"(?i)^[a-z0-9]{4}-[a-z0-9]{4}$"
#: Seconds from 1970 that timestamps reach, either way.
MOST_SECONDS = 9.2e12
#: Date layouts tried in order when a text is no ISO timestamp.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")


def non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def safe_float(x: Column) -> Column:
    """Finite number of a text, trimmed; anything else (blank, nan, infinity, suffixes) is null."""
    t = F.trim(x.cast("string"))
    value = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def epoch_to_timestamp(x: Column, unit: str | None = None) -> Column:
    """Time since 1970 as a timestamp: unit is 's' or 'ms'; without one, numbers above 1e10 are taken as milliseconds and others as seconds.

    Times that timestamps don't reach are null.
    """
    if unit not in (None, "s", "ms"):
        raise ValueError("a unit is 's' or 'ms'")
    n = x.cast("double")
    seconds = {"s": n, "ms": n / 1000.0}.get(unit, F.when(n > 1e10, n / 1000.0).otherwise(n))
    return F.timestamp_seconds(F.when(F.abs(seconds) < MOST_SECONDS, seconds))


def parse_time(x: Column, unit: str | None = None) -> Column:
    """Timestamp of a text: a number is an epoch (in the unit, if one is given), a text without a zone is UTC."""
    t = F.trim(x.cast("string"))
    number = F.when(t.rlike(r"^[0-9]{9,13}(\.[0-9]+)?$"), epoch_to_timestamp(t.try_cast("double"), unit))
    return F.coalesce(number, F.when(~t.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.try_to_timestamp(t)))


def parse_date_like(x: Column) -> Column:
    """Timestamp of a text in ISO form or one of DATE_FORMATS."""
    t = F.trim(x.cast("string"))
    return F.coalesce(parse_time(x), *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def iso_seconds(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ, sub-seconds cut (session time zone UTC)."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_time(*columns: Column) -> Column:
    """iso_seconds() of the first of the columns that can be parsed."""
    return F.coalesce(*[iso_seconds(parse_time(c)) for c in columns])


def wkt_lon(x: Column) -> Column:
    return safe_float(F.regexp_extract(x, WKT_POINT, 1))


def wkt_lat(x: Column) -> Column:
    return safe_float(F.regexp_extract(x, WKT_POINT, 2))


def valid_bbox(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """In WGS84 range, and strictly larger than a line or point; null counts as invalid."""
    lon_ok = min_lon.between(-180, 180) & max_lon.between(-180, 180) & (min_lon < max_lon)
    lat_ok = min_lat.between(-90, 90) & max_lat.between(-90, 90) & (min_lat < max_lat)
    return F.coalesce(lon_ok & lat_ok, F.lit(False))


def choose_bbox(profiled: Column, inferred: Column, fallback: Column) -> Column:
    """Arrays of four numbers: the profiled box if valid; the inferred one only if there is no profiled one; the fallback; the world."""
    ok = lambda b: valid_bbox(*[F.get(b, i) for i in range(4)])
    world = F.array(*[F.lit(float(x)) for x in (-180, -90, 180, 90)])
    return F.when(profiled.isNotNull() & ok(profiled), profiled).when(profiled.isNull() & inferred.isNotNull() & ok(inferred), inferred).otherwise(F.coalesce(F.when(ok(fallback), fallback), world))


def envelope(box: Column) -> Column:
    """[minLon, minLat, maxLon, maxLat] as [[minLon, maxLat], [maxLon, minLat]]; null unless it has four numbers."""
    return F.when(F.size(box) == 4, F.array(F.array(F.get(box, 0), F.get(box, 3)), F.array(F.get(box, 2), F.get(box, 1))))


def corners_bbox(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.array(F.least(lon1, lon2), F.least(lat1, lat2), F.greatest(lon1, lon2), F.greatest(lat1, lat2))


def text_bbox(x: Column) -> Column:
    """Box of a comma text with exactly four numbers, else null."""
    parts = F.transform(F.split(x, ","), safe_float)
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull()), parts)


def boxes_touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (minLon, minLat, maxLon, maxLat) that share at least an edge; one with minLon > maxLon crosses the dateline."""

    def plain(lo1, hi1, lo2, hi2):
        return (lo1 <= hi2) & (lo2 <= hi1)

    lat = plain(a[1], a[3], b[1], b[3])
    a_over, b_over = a[0] > a[2], b[0] > b[2]
    west, east = F.lit(-180.0), F.lit(180.0)
    one = F.when(~a_over & ~b_over, plain(a[0], a[2], b[0], b[2]))
    one = one.when(a_over & ~b_over, plain(a[0], east, b[0], b[2]) | plain(west, a[2], b[0], b[2]))
    one = one.when(~a_over & b_over, plain(a[0], a[2], b[0], east) | plain(a[0], a[2], west, b[2]))
    return lat & one.otherwise(F.lit(True))


def domain_label(domain: Column) -> Column:
    """Portal label: without 'data.', '.gov' and '.org', each run of letters capitalised."""
    bare = F.replace(F.replace(F.replace(domain, F.lit("data."), F.lit("")), F.lit(".gov"), F.lit("")), F.lit(".org"), F.lit(""))
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), F.initcap), "")


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1)


def csv_url(base: Column, dataset_id: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/api/views/"), dataset_id, F.lit("/rows.csv?accessType=DOWNLOAD"))


def embed_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(description, F.lit("")))


def dataset_id(*candidates: Column) -> Column:
    """The first candidate that is a 4x4 id, lower-cased."""
    trimmed = [F.trim(c.cast("string")) for c in candidates]
    return F.lower(F.coalesce(*[F.when(c.rlike(FOUR_BY_FOUR), c) for c in trimmed]))


def readable_bytes(n: Column) -> Column:
    """Bytes with a unit, two decimals."""
    shown = lambda d, u: F.concat(F.format_string("%.2f", F.bround(n / F.lit(float(d)), 2)), F.lit(" " + u))
    return F.when(n < 1024, shown(1, "B")).when(n < 1 << 20, shown(1 << 10, "KiB")).when(n < 1 << 30, shown(1 << 20, "MiB")).otherwise(shown(1 << 30, "GiB"))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
