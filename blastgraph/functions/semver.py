"""Semantic versions as orderable structs, and version ranges over them.

``version_key`` is native: a struct whose Spark ordering is the precedence of semantic versions,
build metadata left out. A range is parsed once per distinct string into alternatives of
comparators, which native expressions evaluate. Ranges written by users or in manifests leave
prereleases out unless a comparator of the same alternative names one of the same
major.minor.patch; advisory intervals (``operators.advisories``) use plain ordering.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = r"^\s*[v=\s]*(\d{1,15})\.(\d{1,15})\.(\d{1,15})(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\s*$"
KEY = T.StructType([
    T.StructField("major", T.LongType()), T.StructField("minor", T.LongType()), T.StructField("patch", T.LongType()),
    T.StructField("release", T.BooleanType()),
    T.StructField("pre", T.ArrayType(T.StructType([
        T.StructField("alpha", T.BooleanType()), T.StructField("num", T.LongType()), T.StructField("txt", T.StringType())]))),
])
RANGE = T.ArrayType(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("key", KEY)])))


def version_key(version: Column) -> Column:
    """Orderable key of a version string; null where it is none."""

    def number(i: int) -> Column:
        return F.try_to_number(F.regexp_extract(version, VERSION, i), F.lit("9" * 15)).cast("bigint")

    pre = F.regexp_extract(version, VERSION, 4)
    parts = F.transform(
        F.split(pre, r"\."),
        lambda x: F.when(
            x.rlike(r"^\d{1,18}$"), F.struct(F.lit(False).alias("alpha"), x.try_cast("bigint").alias("num"), F.lit("").alias("txt"))
        ).otherwise(F.struct(F.lit(True).alias("alpha"), F.lit(0).cast("bigint").alias("num"), x.alias("txt"))),
    )
    key = F.struct(
        number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"),
        F.when(pre == "", F.array().cast(KEY["pre"].dataType)).otherwise(parts).alias("pre"),
    )
    return F.when(version.rlike(VERSION), key)


def key_of(version: str) -> tuple | None:
    """The same key in Python: a tuple that compares alike."""
    m = re.match(VERSION, version)
    if not m:
        return None
    pre = tuple((False, int(x), "") if x.isdigit() else (True, 0, x) for x in m[4].split(".")) if m[4] else ()
    return int(m[1]), int(m[2]), int(m[3]), not pre, pre


_PARTIAL = re.compile(
    r"^[v=\s]*(\d+|[xX*])(?:\.(\d+|[xX*])(?:\.(\d+|[xX*])(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?)?)?(?:\+[0-9A-Za-z.-]+)?$"
)
_COMPARATOR = re.compile(r"(\^|~>?|>=|<=|>|<|=)?\s*([^\s<>=~^|]+)")


def _partial(text: str) -> tuple | None:
    """(numbers given, their values padded with 0, prerelease) of a partial version."""
    m = _PARTIAL.match(text)
    if not m:
        return None
    given = []
    for part in m.groups()[:3]:
        if part is None or part in "xX*":
            break
        given.append(int(part))
    pre = key_of(f"0.0.0-{m[4]}")[4] if m[4] and len(given) == 3 else ()
    return len(given), (*given, 0, 0, 0)[:3], pre


def _key(numbers: tuple, pre: tuple = ()) -> tuple:
    return (*numbers, not pre, pre)


def _next(numbers: tuple, place: int) -> tuple:
    """The smallest version whose number at ``place`` is one higher."""
    return (*numbers[:place], numbers[place] + 1, 0, 0)[:3]


def _comparators(op: str, text: str) -> list[tuple[str, tuple]] | None:
    found = _partial(text)
    if found is None:
        return None
    n, v, pre = found
    low = (">=", _key(v, pre))
    if op == "^":
        place = next((i for i in range(n) if v[i]), max(n - 1, 0))
        return [low, ("<", _key(_next(v, place)))] if n else []
    if op in ("~", "~>"):
        return [low, ("<", _key(_next(v, 0 if n == 1 else 1)))] if n else []
    if n == 3:
        return [(op or "=", _key(v, pre))]
    if n == 0:
        return [("<", _key((0, 0, 0)))] if op in ("<", ">") else []
    above = _key(_next(v, n - 1))
    return {
        "": [low, ("<", above)], "=": [low, ("<", above)], ">": [(">=", above)], ">=": [low],
        "<": [("<", _key(v))], "<=": [("<", above)],
    }[op]


def parse_range(spec: str | None) -> list[list[tuple[str, tuple]]] | None:
    """Alternatives of comparators (op, key) that must all hold; None where it is no range.
    Empty text and "*" are the alternative without comparators."""
    if spec is None:
        return None
    out = []
    for part in spec.strip().split("||"):
        part = part.strip()
        hyphen = re.match(r"^(\S+)\s+-\s+(\S+)$", part)
        if hyphen:
            low, high = _comparators(">=", hyphen[1]), _comparators("<=", hyphen[2])
            if low is None or high is None:
                return None
            out.append(low + high)
            continue
        every, at = [], 0
        for m in _COMPARATOR.finditer(part):
            if part[at : m.start()].strip(" ,"):
                return None
            found = _comparators(m[1] or "", m[2].strip(","))
            if found is None:
                return None
            every += found
            at = m.end()
        if part[at:].strip():
            return None
        out.append(every)
    return out


_TESTS = {
    "=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def satisfies_py(version: str, spec: str) -> bool:
    """Whether a version is in a range, in Python: for tests and single values."""
    key, parsed = key_of(version), parse_range(spec)
    if key is None or parsed is None:
        return False
    for every in parsed:
        if all(_TESTS[op](key, k) for op, k in every) and (key[3] or any(not k[3] and k[:3] == key[:3] for _, k in every)):
            return True
    return False


def _literal(key: tuple) -> Column:
    major, minor, patch, release, pre = key
    parts = [F.struct(F.lit(a).alias("alpha"), F.lit(n).cast("bigint").alias("num"), F.lit(t).alias("txt")) for a, n, t in pre]
    empty = F.array().cast(KEY["pre"].dataType)
    return F.struct(
        F.lit(major).cast("bigint").alias("major"), F.lit(minor).cast("bigint").alias("minor"), F.lit(patch).cast("bigint").alias("patch"),
        F.lit(release).alias("release"), (F.array(*parts) if parts else empty).alias("pre"),
    )


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def in_range(key: Column, spec: str) -> Column:
    """Whether a version key is in one given range, as a plain boolean expression. Empty and "*"
    take every release, also unparsable ones and prereleases, as a user's "any" does."""
    if spec.strip() in ("", "*"):
        return F.lit(True)
    parsed, any_of = parse_range(spec), F.lit(False)
    for every in parsed or []:
        named = {k[:3] for _, k in every if not k[3]}
        pre_ok = F.lit(False)
        for a, b, c in named:
            pre_ok = pre_ok | ((key["major"] == a) & (key["minor"] == b) & (key["patch"] == c))
        any_of = any_of | (_all([_TESTS[op](key, _literal(k)) for op, k in every]) & (key["release"] | pre_ok))
    return F.coalesce(any_of, F.lit(False))


@F.pandas_udf(RANGE)
def _parsed(specs: pd.Series) -> pd.Series:
    def struct(key: tuple) -> dict:
        return dict(zip(("major", "minor", "patch", "release"), key[:4])) | {"pre": [dict(zip(("alpha", "num", "txt"), p)) for p in key[4]]}

    def one(spec: str | None):
        parsed = parse_range(spec)
        return None if parsed is None else [[{"op": op, "key": struct(k)} for op, k in every] for every in parsed]

    return specs.map(one)


def parsed_range(spec: Column) -> Column:
    """Parsed form of a column of ranges, null where it is no range; apply to distinct strings."""
    return _parsed(spec)


def satisfies(key: Column, parsed: Column) -> Column:
    """Whether a version key is in a parsed range."""

    def holds(c: Column) -> Column:
        tests = F.lit(False)
        for op, test in _TESTS.items():
            tests = tests | ((c["op"] == op) & test(key, c["key"]))
        return tests

    def named(c: Column) -> Column:
        k = c["key"]
        return ~k["release"] & (k["major"] == key["major"]) & (k["minor"] == key["minor"]) & (k["patch"] == key["patch"])

    ok = F.exists(parsed, lambda every: F.forall(every, holds) & (key["release"] | F.exists(every, named)))
    return F.coalesce(ok, F.lit(False))
