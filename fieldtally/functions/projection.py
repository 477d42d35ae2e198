"""Universal transverse Mercator as column arithmetic (Krueger series to fourth
order in the third flattening), so that it stays inside generated code."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS 1980 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0

_F = 1.0 / INVERSE_FLATTENING
_N = _F / (2.0 - _F)
RADIUS = SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
ALPHA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 5.0 * _N**3 / 16.0 + 41.0 * _N**4 / 180.0,
    13.0 * _N**2 / 48.0 - 3.0 * _N**3 / 5.0 + 557.0 * _N**4 / 1440.0,
    61.0 * _N**3 / 240.0 - 103.0 * _N**4 / 140.0,
    49561.0 * _N**4 / 161280.0,
)
ECCENTRICITY = 2.0 * sqrt(_N) / (1.0 + _N)


def with_utm(
    places: DataFrame, latitude: str = "Latitude", longitude: str = "Longitude", zone: int = 10
) -> DataFrame:
    """Add easting ``x`` and northing ``y`` in metres (northern hemisphere). Each
    stage of the series is a projection of its own: as one expression the shared
    terms would be repeated in it many times over."""
    e = F.lit(ECCENTRICITY)
    sine = F.sin(F.radians(latitude))
    angle = F.radians(F.col(longitude) - F.lit(zone * 6.0 - 183.0))
    staged = (
        places.withColumns({"utm_sine": sine, "utm_angle": angle})
        .withColumn(
            "utm_t", F.sinh(F.atanh("utm_sine") - e * F.atanh(e * F.col("utm_sine")))
        )
        .withColumns(
            {
                "utm_xi": F.atan2("utm_t", F.cos("utm_angle")),
                "utm_eta": F.atanh(
                    F.sin("utm_angle") / F.sqrt(F.lit(1.0) + F.col("utm_t") * F.col("utm_t"))
                ),
            }
        )
    )
    xi, eta = F.col("utm_xi"), F.col("utm_eta")
    east, north = eta, xi
    for k, a in enumerate(ALPHA, start=1):
        m = F.lit(2.0 * k)
        east = east + F.lit(a) * F.cos(m * xi) * F.sinh(m * eta)
        north = north + F.lit(a) * F.sin(m * xi) * F.cosh(m * eta)
    scale = F.lit(SCALE * RADIUS)
    return staged.withColumns({"x": F.lit(FALSE_EASTING) + scale * east, "y": scale * north}).drop(
        "utm_sine", "utm_angle", "utm_t", "utm_xi", "utm_eta"
    )


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
