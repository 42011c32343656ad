"""Package coordinates: "name@version" in the spellings of lockfiles, release keys, module paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def release_key(package: Column, version: Column) -> Column:
    return F.concat(package, F.lit("@"), version)


def package_of(key: Column) -> Column:
    """The package of a release key: what stands before its last "@", scoped names kept whole."""
    return F.left(key, F.length(key) - F.length(F.substring_index(key, "@", -1)) - 1)


def version_of(key: Column) -> Column:
    return F.substring_index(key, "@", -1)


def from_module_path(path: Column) -> Column:
    """The innermost package of a path of nested node_modules folders."""
    return F.regexp_replace(F.substring_index(path, "node_modules/", -1), r"^/+|/+$", "")


def split_coordinate(text: Column) -> Column:
    """struct(name, version): quotes, peer suffix in brackets, leading slash and "npm:" go; the
    last "@" behind the scope divides, else a slash before a digit; empty strings where neither does."""
    bare = F.regexp_replace(F.trim(text), r"^[\"']+|[\"']+$", "")
    bare = F.coalesce(F.regexp_replace(F.substring_index(bare, "(", 1), r"^/", ""), F.lit(""))
    slash = r"^(.+)/(\d[^/]*)$"

    def divided(bare: Column) -> Column:
        return F.struct(bare.alias("bare"), F.regexp_extract(bare, r"^(@?[^@]+(?:@[^@]+)*)@([^@]*)$", 1).alias("at"))

    def named(x: Column) -> Column:
        version = F.regexp_replace(F.regexp_extract(x["bare"], r"^.+@([^@]*)$", 1), "^npm:", "")
        by_slash = F.struct(F.regexp_extract(x["bare"], slash, 1).alias("name"), F.regexp_extract(x["bare"], slash, 2).alias("version"))
        return F.when(x["at"] != "", F.struct(x["at"].alias("name"), version.alias("version"))).otherwise(by_slash)

    found = F.transform(F.transform(F.transform(F.array(bare), divided), named), lambda c: F.struct(F.when(c["version"] == "", "").otherwise(c["name"]).alias("name"), c["version"].alias("version")))
    return F.get(found, F.lit(0))  # each step is computed once
