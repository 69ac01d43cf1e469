"""Semantic versions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERN = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.\-]+))?(?:\+([0-9A-Za-z.\-]+))?$"


def part(version: Column, name: str) -> Column:
    """major, minor or patch as an integer, prerelease or build as text."""
    names = ["major", "minor", "patch", "prerelease", "build"]
    found = F.regexp_extract(version, _PATTERN, names.index(name) + 1)
    return F.coalesce(found.try_cast("int"), F.lit(0)) if name in names[:3] else found


def is_valid(version: Column) -> Column:
    return version.rlike(_PATTERN)


def sort_key(version: Column) -> Column:
    """A struct in whose order versions precede each other: numbers first, then a release after its prereleases, whose
    identifiers compare one by one, numeric ones by value and before others, a shorter list first."""
    pre = part(version, "prerelease")
    idents = F.transform(F.when(pre == "", F.array().cast("array<string>")).otherwise(F.split(pre, r"\.")), lambda p: F.struct(
        (~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.try_cast("long")).alias("number"), p.alias("text")))
    return F.struct(part(version, "major").alias("major"), part(version, "minor").alias("minor"), part(version, "patch").alias("patch"),
                    (pre == "").alias("release"), idents.alias("idents"))


def less(a: Column, b: Column) -> Column:
    return sort_key(a) < sort_key(b)


def bump(version: Column, name: str) -> Column:
    """The next major, minor or patch version, without prerelease and build."""
    numbers = ["major", "minor", "patch"]
    at = numbers.index(name)
    values = [part(version, n) if i < at else part(version, n) + 1 if i == at else F.lit(0) for i, n in enumerate(numbers)]
    return F.concat_ws(".", *[v.cast("string") for v in values])


def bump_prerelease(version: Column, label: str = "rc") -> Column:
    """label.1 after a release, else the last number of the prerelease one higher."""
    core = F.concat_ws(".", *[part(version, n).cast("string") for n in ("major", "minor", "patch")])
    last = F.regexp_extract(part(version, "prerelease"), r"(\d+)$", 1).try_cast("int")
    head = F.regexp_replace(part(version, "prerelease"), r"\d+$", "")
    return F.when(last.isNull(), F.concat(core, F.lit(f"-{label}.1"))).otherwise(F.concat(core, F.lit("-"), head, (last + 1).cast("string")))


def with_part(version: Column, name: str, value: str) -> Column:
    core = F.concat_ws(".", *[F.lit(value) if n == name else part(version, n).cast("string") for n in ("major", "minor", "patch")])
    pre = F.lit(value) if name == "prerelease" else part(version, "prerelease")
    build = F.lit(value) if name == "build" else part(version, "build")
    return F.concat(core, F.when(pre != "", F.concat(F.lit("-"), pre)).otherwise(""), F.when(build != "", F.concat(F.lit("+"), build)).otherwise(""))


def is_prerelease(version: Column) -> Column:
    return part(version, "prerelease") != ""


def is_stable(version: Column) -> Column:
    return ~is_prerelease(version) & (part(version, "major") > 0)
