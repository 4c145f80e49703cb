"""Feature tables: values with flags of what is unknown, and rows for every entry of a roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import checks


def flattened(df: DataFrame, keys: list[str], counts: dict[str, Column], measures: dict[str, Column], fill: float = 0.0) -> DataFrame:
    """The keys, each count and each measure as doubles, and <name>_is_missing for each measure.

    An unknown count is 0.  An unknown measure is ``fill`` and its flag 1.0, so that no data can
    be told from a measurement.
    """
    plain = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in counts.items()]
    pairs = [x for n, c in measures.items() for x in (F.coalesce(c.cast("double"), F.lit(float(fill))).alias(n), c.isNull().cast("double").alias(f"{n}_is_missing"))]
    return df.select(*keys, *plain, *pairs)


def for_roster(roster: DataFrame, crosswalk: DataFrame, table: DataFrame, key: str, person: str, counts: dict[str, Column], measures: dict[str, Column], fill: float = 0.0) -> DataFrame:
    """One row for each distinct key of the roster, flattened, with has_history.

    crosswalk names at most one person a key (else the query fails); keys without a person, or
    with one that the table lacks, keep a row of their own without history.
    """
    known = checks.join_checked(roster.select(key).distinct(), crosswalk.select(key, person), [key])
    rows = checks.join_checked(known, table.withColumn("_has", F.lit(1)), [person])
    return flattened(rows, [key], {"has_history": F.col("_has"), **counts}, measures, fill)


def numeric_block(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns of a feature table but for keys and labels."""
    return [c for c in df.columns if c not in names]
