"""Pixel expressions: band indices of red, green, blue and near infrared columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
R, G, B, NIR = "red", "green", "blue", "nir"


def exg() -> Column:
    return 2 * F.col(G) - F.col(R) - F.col(B)


def gli() -> Column:
    return exg() / (2 * F.col(G) + F.col(R) + F.col(B) + EPS)


def brightness() -> Column:
    return (F.col(R) + F.col(G) + F.col(B)) / 3


def green_dominance() -> Column:
    return F.col(G) - F.greatest(R, B)


def saturation() -> Column:
    return F.greatest(R, G, B) - F.least(R, G, B)


def ndvi() -> Column:
    return (F.col(NIR) - F.col(R)) / (F.col(NIR) + F.col(R) + EPS)


def green_ratio() -> Column:
    return F.col(G) / (F.col(R) + F.col(B) + EPS)
