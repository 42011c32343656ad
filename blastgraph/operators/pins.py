"""Pins of lockfiles against known releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(pins: DataFrame, releases: DataFrame) -> DataFrame:
    """Pins with the release they name: source, package, version, direct, target."""
    known = releases.select("package", "version", F.col("key").alias("target"))
    return pins.select("source", "package", "version", "direct").join(known, ["package", "version"])


def unmatched(pins: DataFrame, releases: DataFrame) -> DataFrame:
    """Pins of releases that aren't known."""
    return pins.join(releases.select("package", "version"), ["package", "version"], "left_anti")


def unmatched_sample(pins: DataFrame, releases: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` unmatched coordinates by name: coordinate."""
    names = unmatched(pins, releases).select(F.concat_ws("@", "package", "version").alias("coordinate")).distinct()
    return names.orderBy("coordinate").limit(n)
