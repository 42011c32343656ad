"""Versions and ranges: ordering, grammar, native expressions against Python."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blastgraph.functions import semver

ORDER = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.9.0", "1.10.0", "2.0.0"]
YES = [
    ("1.2.3", "1.2.3"), ("1.2.3", "=1.2.3"), ("v1.2.3", "1.2"), ("1.9.9", "^1.2.3"), ("0.2.9", "^0.2.3"), ("0.0.3", "^0.0.3"), ("1.2.9", "~1.2.3"), ("1.2.9", "~1.2"), ("1.5.0", "~1"),
    ("1.2.3", "1.x"), ("1.2.3", "1.2.*"), ("1.2.3", "*"), ("9.9.9", ">=1 <10"), ("2.0.0", "1.0.0 - 2.0.0"), ("2.9.9", "1 - 2"), ("3.0.0", "^1 || ^3"), ("1.2.4", ">1.2.3"),
    ("1.3.0", ">1.2"), ("1.2.9", "<=1.2"), ("1.2.3-rc.2", "^1.2.3-rc.1"), ("1.2.3+build", "1.2.3"), ("1.2.3", ">= 1.0.0"), ("1.2.3beta", ">1.2.3-alpha <1.2.3"),
]
NO = [
    ("2.0.0", "^1.2.3"), ("0.3.0", "^0.2.3"), ("0.0.4", "^0.0.3"), ("1.3.0", "~1.2.3"), ("1.2.3-rc.1", "^1.0.0"), ("1.2.3-rc.1", "*"), ("1.2.3", ">1.2"), ("1.3.0", "<=1.2"),
    ("1.2.4-rc.1", "^1.2.3-rc.1"), ("junk", "*"), ("1.2", "*"), ("1.2.3", "latest"), ("1.0.0", "<0.0.0 || >5"),
]
NOT_RANGES = ["git+ssh://git@x/y.git", "file:../x", "npm:other@1", "workspace:*", "latest", "https://x/y.tgz", "user/repo", "link:x"]


def test_order(spark):
    rows = spark.createDataFrame([(v,) for v in ORDER[::-1]], "v string").orderBy(semver.version_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ORDER == sorted(ORDER, key=semver.key_of)
    assert spark.createDataFrame([("x",), ("1.2",), ("",), (None,)], "v string").where(semver.version_key(F.col("v")).isNotNull()).isEmpty()


def test_ranges_in_python_and_native(spark):
    cases = [(*c, True) for c in YES] + [(*c, False) for c in NO]
    assert all(semver.satisfies_py(v, r) == ok for v, r, ok in cases), [c for c in cases if semver.satisfies_py(*c[:2]) != c[2]]
    rows = spark.createDataFrame(cases, "v string, r string, ok boolean").withColumn("k", semver.version_key(F.col("v"))).withColumn("p", semver.parsed_range(F.col("r")))
    assert rows.where(semver.satisfies(F.col("k"), F.col("p")) != F.col("ok")).isEmpty()
    for v, r, ok in cases:
        if r != "*":
            one = spark.createDataFrame([(v,)], "v string").select(semver.in_range(semver.version_key(F.col("v")), r).alias("ok"))
            assert one.first().ok == ok, (v, r)


@pytest.mark.parametrize("spec", NOT_RANGES)
def test_not_ranges(spec):
    assert semver.parse_range(spec) is None


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[st.integers(0, 30)] * 3), st.tuples(*[st.integers(0, 30)] * 3))
def test_caret_means_same_leading_number(low, v):
    text = ".".join(map(str, low))
    got = semver.satisfies_py(".".join(map(str, v)), f"^{text}")
    place = next((i for i in range(3) if low[i]), 2)
    assert got == (v >= low and v[: place + 1] == low[: place + 1])
