"""Bounded, deterministic training samples and the folds of the contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def unit_hash(id_col: str, seed: int) -> F.Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / float(1 << 53)


def stratified(df: DataFrame, stratum: str, id_col: str, per: int, seed: int) -> tuple[DataFrame, dict]:
    """About `per` rows of each stratum (all where there are fewer), and the strata's sizes.

    Strata are class values, of which there are few; their counts are all that
    reaches the driver.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect() if r[0] is not None}
    spot = unit_hash(id_col, seed)
    keep = F.lit(False)
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(stratum) == F.lit(value)) & (spot < per / n))
    return df.where(keep), sizes


def capped(sample: DataFrame, stratum: str, order: list[str], per: int) -> DataFrame:
    """At most 2 * per rows of each stratum, the first in `order`: a sample by id is larger only where an id is repeated very often. Each task passes on no more than that."""
    place = Window.partitionBy(stratum).orderBy(*order)
    return sample.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= 2 * per).drop("_place")
