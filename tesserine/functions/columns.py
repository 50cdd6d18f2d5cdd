"""Scalar expressions: cleaning, calendar arithmetic, sphere geometry, rounding."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the published conventions).
EARTH_RADIUS_KM = 6371.0088
WGS84_A_KM = 6378.137
WGS84_F = 1.0 / 298.257223563


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str, digits: int = 6) -> Column:
    """Round for publication; the added zero turns -0.0 into 0.0."""
    return F.round(_c(x), digits) + F.lit(0.0)


def nan_to_null(x: Column | str) -> Column:
    """NaN and NULL both mean missing; only NULL is skipped by aggregates."""
    return F.when(~F.isnan(_c(x)), _c(x))


def significant(x: Column | str, digits: int = 10) -> Column:
    """Keep `digits` significant figures."""
    return F.format_string(f"%.{digits - 1}e", _c(x)).cast("double")


def parse_coordinate(x: Column | str, bound: float | None = None) -> Column:
    """`57.05N` -> 57.05, `10.33W` -> -10.33; anything else stops the query."""
    text = F.trim(_c(x))
    sign = (
        F.when(F.upper(F.right(text, F.lit(1))).isin("N", "E"), F.lit(1.0))
        .when(F.upper(F.right(text, F.lit(1))).isin("S", "W"), F.lit(-1.0))
    )
    magnitude = text.substr(F.lit(1), F.length(text) - 1).try_cast("double")
    value = sign * magnitude
    checked = F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("bad coordinate: "), F.coalesce(text, F.lit("NULL")))).cast("double")
    )
    if bound is None:
        return checked
    return F.when(F.abs(checked) <= bound, checked).otherwise(
        F.raise_error(F.concat(F.lit(f"coordinate beyond {bound}: "), text)).cast("double")
    )


def decimal_decades(date: Column | str) -> Column:
    """Mid-month time axis in decades."""
    return (F.year(_c(date)) + (F.month(_c(date)) - 0.5) / 12.0) / 10.0


def parse_window(text: str) -> tuple[dt.date, dt.date]:
    """`start..end` with ISO dates, start not after end."""
    match = re.fullmatch(r"\s*(\d{4}-\d{2}-\d{2})\s*\.\.\s*(\d{4}-\d{2}-\d{2})\s*", text)
    if not match:
        raise ValueError(f"window must look like start..end, got {text!r}")
    start, end = (dt.date.fromisoformat(part) for part in match.groups())
    if start >= end:
        raise ValueError(f"window must start before it ends: {text!r}")
    return start, end


def months_in_window(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + end.month - start.month + 1


def in_window(date: Column | str, start: dt.date, end: dt.date) -> Column:
    """Inclusive range predicate; reaches the parquet scan as a pushed filter."""
    return _c(date).between(F.lit(start), F.lit(end))


def hemisphere(lat: Column | str) -> Column:
    return F.when(_c(lat) >= 0, F.lit("N")).otherwise(F.lit("S"))


def lon_to_360(lon: Column | str) -> Column:
    return F.when(_c(lon) < 0, _c(lon) + 360.0).otherwise(_c(lon))


def lon_to_180(lon: Column | str) -> Column:
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def fractional_year_to_month(t: Column | str, tolerance: float = 0.01) -> Column:
    """Mid-month fractional year -> first day of that month; off-grid stamps stop the query."""
    year = F.floor(_c(t))
    slot = (_c(t) - year) * 12.0 - 0.5
    nearest = F.round(slot)
    date = F.make_date(year.cast("int"), (nearest + 1).cast("int"), F.lit(1))
    return F.when(F.abs(slot - nearest) <= tolerance, date).otherwise(
        F.raise_error(F.concat(F.lit("time stamp off the monthly grid: "), _c(t).cast("string"))).cast("date")
    )


def mapped(x: Column | str, table: dict, default: Column | None = None) -> Column:
    """Lookup through a small literal map; unmapped -> NULL or `default`."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    hit = F.try_element_at(F.create_map(*pairs), _c(x))
    return hit if default is None else F.coalesce(hit, default)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlam = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlam / 2), 2)
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def ecef_km(lat, lon) -> tuple[Column, Column, Column]:
    """WGS84 surface point in earth-centred coordinates."""
    e2 = WGS84_F * (2.0 - WGS84_F)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    n = F.lit(WGS84_A_KM) / F.sqrt(1.0 - e2 * F.pow(F.sin(phi), 2))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1.0 - e2) * F.sin(phi)


def chord_to_km(chord) -> Column:
    """Unit-sphere chord -> great-circle kilometres."""
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.least(_c(chord) / 2.0, F.lit(1.0)))


def km_to_chord(km: float) -> float:
    return 2.0 * math.sin(min(km / (2.0 * EARTH_RADIUS_KM), math.pi / 2.0))


def band_cell_area_km2(lat_south, lat_north, dlon_degrees: float) -> Column:
    """Area of a latitude-longitude cell on the sphere."""
    return (
        EARTH_RADIUS_KM**2
        * math.radians(dlon_degrees)
        * (F.sin(F.radians(_c(lat_north))) - F.sin(F.radians(_c(lat_south))))
    )


def axis_index(x, origin: float, step: float, size: int) -> Column:
    """Nearest index on a regular axis, clamped at both ends."""
    return F.least(F.greatest(F.round((_c(x) - origin) / step), F.lit(0)), F.lit(size - 1)).cast("bigint")


def cell_index(x, origin: float, step: float, size: int) -> Column:
    """Containing cell on a regular axis, clamped at both ends."""
    return F.least(F.greatest(F.floor((_c(x) - origin) / step), F.lit(0)), F.lit(size - 1)).cast("bigint")


def natural_cubic_columns(x, knots: list) -> list[Column]:
    """Non-linear columns of a natural cubic basis: one per knot beyond the second."""
    last = knots[-1]

    def cube(knot) -> Column:
        t = F.greatest(_c(x) - knot, F.lit(0.0))
        return t * t * t

    def scaled(k: int) -> Column:
        return (cube(knots[k]) - cube(last)) / (last - knots[k])

    tail = len(knots) - 2
    return [scaled(k) - scaled(tail) for k in range(tail)]


def hash_uniform(*parts: Column | str) -> Column:
    """Reproducible uniform in [0, 1) from an MD5 digest of the given columns."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)
