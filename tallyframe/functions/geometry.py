"""Normalised boxes (x, y, w, h; y grows downward) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{n}") for n in "xywh"))

    @property
    def mid_x(self) -> Column:
        return self.x + self.w / 2

    @property
    def mid_y(self) -> Column:
        return self.y + self.h / 2

    @property
    def max_x(self) -> Column:
        return self.x + self.w

    @property
    def max_y(self) -> Column:
        return self.y + self.h

    def from_bottom_left(self) -> Box:
        return Box(self.x, 1 - self.y - self.h, self.w, self.h)

    def inset(self, dx: Column, dy: Column) -> Box:
        zero = F.lit(0.0)
        return Box(self.x + dx, self.y + dy, F.greatest(zero, self.w - dx * 2), F.greatest(zero, self.h - dy * 2))

    def rotated(self, angle: Column, px: Column, py: Column) -> Box:
        """The centre turned about a point; the extent stays."""
        dx, dy = self.mid_x - px, self.mid_y - py
        x = px + dx * F.cos(angle) - dy * F.sin(angle)
        y = py + dx * F.sin(angle) + dy * F.cos(angle)
        return Box(x - self.w / 2, y - self.h / 2, self.w, self.h)


def _share(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    overlap = F.least(high_a, high_b) - F.greatest(low_a, low_b)
    smaller = F.least(high_a - low_a, high_b - low_b)
    return F.when((overlap > 0) & (smaller > 0), overlap / smaller).otherwise(0.0)


def vertical_overlap(a: Box, b: Box) -> Column:
    return _share(a.y, a.max_y, b.y, b.max_y)


def horizontal_overlap(a: Box, b: Box) -> Column:
    return _share(a.x, a.max_x, b.x, b.max_x)


def intersection_over_union(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0.0), F.least(a.max_x, b.max_x) - F.greatest(a.x, b.x))
    height = F.greatest(F.lit(0.0), F.least(a.max_y, b.max_y) - F.greatest(a.y, b.y))
    union = a.w * a.h + b.w * b.h - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def angle_to(a: Box, b: Box, most: float = 0.21) -> Column:
    """From a's centre to b's, if b lies to the right and the angle is small; else null."""
    dx, dy = b.mid_x - a.mid_x, b.mid_y - a.mid_y
    angle = F.atan2(dy, dx)
    return F.when((dx > 1e-6) & (F.abs(angle) <= most), angle)
