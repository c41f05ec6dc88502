"""Keypoints, boxes and landmarks as text, both ways."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trimmed(x: Column, places: int = 3) -> Column:
    """A number with up to `places` decimals, trailing zeros gone."""
    s = F.format_string(f"%.{places}f", x.cast("double"))
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")
    return F.when(s.isin("", "-"), "0").otherwise(s)


def plain(x: Column) -> Column:
    """A double in plain digits: no exponent, no trailing `.0`."""
    d = x.cast("double")
    as_text = d.cast("string")
    big = F.regexp_replace(F.regexp_replace(d.cast("decimal(38,17)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(as_text.contains("E"), big).otherwise(F.regexp_replace(as_text, "\\.0$", ""))


def points_text(points: Column, form=trimmed) -> Column:
    """[[x, y, …], …] to `x,y,…;x,y,…`."""
    return F.array_join(F.transform(points, lambda p: F.array_join(F.transform(p, lambda x: form(x)), ",")), ";")


def numbers_text(xs: Column, form=plain) -> Column:
    return F.array_join(F.transform(xs, lambda x: form(x)), ",")


def parse_numbers(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda x: x.try_cast("double"))


def parse_points(c: Column) -> Column:
    """`x,y,c;…` back to an array of number arrays; blank text is no points."""
    return F.when(F.trim(c) == "", F.array().cast("array<array<double>>")).otherwise(
        F.transform(F.split(c, ";"), lambda p: parse_numbers(p)))
