"""Level of service from the number of vehicles ahead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density bounds in vehicles per mile and lane with the level at the lower bound,
# metres per mile, and the shortest remaining length that counts.
DENSITY_LEVELS = [(0, 12, 0.0), (12, 20, 0.2), (20, 30, 0.4), (30, 42, 0.6), (42, 67, 0.8)]
MILE_M = 1609.344
ENDING_M = 200


def density(vehicles_ahead: Column, length_m: Column, offset_m: Column, lanes: Column) -> Column:
    rest = F.greatest(F.lit(ENDING_M).cast("double"), length_m - offset_m)
    return vehicles_ahead * MILE_M / (rest * lanes)


def service_level(vehicles_ahead: Column, length_m: Column, offset_m: Column, lanes: Column) -> Column:
    """1.0 on a free road, falling to 0.0; infinity marks a jam, which stops the vehicle."""
    x = density(vehicles_ahead, length_m, offset_m, lanes)
    level = F.lit(float("inf"))
    for low, high, base in reversed(DENSITY_LEVELS):
        level = F.when(x < high, 1.0 - (base + (x - low) * 0.2 / (high - low))).otherwise(level)
    return level
