"""Scalar features; every one is a built-in expression inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import col_or_null, double_of, named

# The city-centre point distances are measured from (degrees).
CENTRE_LATITUDE = 51.5074
CENTRE_LONGITUDE = -0.1278

LEADING_LETTERS = "^([A-Za-z]+)"


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def leading_letters(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, LEADING_LETTERS, 1), F.lit(""))


def planar_distance(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Distance in degrees on the plane, not along the globe."""
    dlat, dlon = lat - F.lit(lat0), lon - F.lit(lon0)
    return F.sqrt(dlat * dlat + dlon * dlon)


def with_calendar(df: DataFrame, date: str = "history_date") -> DataFrame:
    d = named(date)
    return df.withColumns({
        "history_year": F.year(d),
        "history_month": F.month(d),
        "history_quarter": F.quarter(d),
    })


def with_rooms(df: DataFrame) -> DataFrame:
    rooms = [zero_if_null(double_of(df, c)) for c in ("bedrooms", "bathrooms", "livingRooms")]
    return df.withColumn("total_rooms", rooms[0] + rooms[1] + rooms[2])


def with_ratios(df: DataFrame) -> DataFrame:
    """Needs ``total_rooms`` (see :func:`with_rooms`)."""
    bed, bath, living, area = (
        double_of(df, c) for c in ("bedrooms", "bathrooms", "livingRooms", "floorAreaSqM"))
    return df.withColumns({
        "floor_area_per_room": safe_ratio(area, named("total_rooms")),
        "bed_bath_ratio": safe_ratio(bed, bath),
        "living_bed_ratio": safe_ratio(living, bed),
    })


def with_geo_radial(
    df: DataFrame, latitude: float = CENTRE_LATITUDE, longitude: float = CENTRE_LONGITUDE
) -> DataFrame:
    return df.withColumn("geo_radial", planar_distance(
        double_of(df, "latitude"), double_of(df, "longitude"), latitude, longitude))


def with_location(df: DataFrame) -> DataFrame:
    """String-typed outcode and postcode plus the coarse outcode area."""
    outcode = col_or_null(df, "outcode")
    return df.withColumns({
        "outcode": outcode,
        "postcode": col_or_null(df, "postcode"),
        "outcode_area": leading_letters(outcode),
    })


def with_features(df: DataFrame, date: str = "history_date") -> DataFrame:
    """All row-level features of the clean table, one narrow projection."""
    for step in (lambda d: with_calendar(d, date), with_rooms, with_ratios, with_geo_radial, with_location):
        df = step(df)
    return df
