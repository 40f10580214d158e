"""Complex arithmetic on pairs of columns (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(prefix: str = "") -> Pair:
    """The columns <prefix>re and <prefix>im."""
    return F.col(f"{prefix}re"), F.col(f"{prefix}im")


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj_mul(a: Pair, b: Pair) -> Pair:
    """conj(a) * b."""
    return a[0] * b[0] + a[1] * b[1], a[0] * b[1] - a[1] * b[0]


def abs2(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def turn(angle: Column) -> Pair:
    """exp(i angle)."""
    return F.cos(angle), F.sin(angle)


def named(a: Pair, prefix: str = "") -> tuple[Column, Column]:
    return a[0].alias(f"{prefix}re"), a[1].alias(f"{prefix}im")
