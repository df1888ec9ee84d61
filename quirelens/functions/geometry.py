"""Rectangle functions on (left, top, right, bottom) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> dict[str, Column]:
    """Rectangle with negative extents flipped, clipped to its page."""
    x0, x1 = F.least(left, left + width), F.greatest(left, left + width)
    y0, y1 = F.least(top, top + height), F.greatest(top, top + height)
    bound = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    return {"left": bound(x0, page_width), "top": bound(y0, page_height), "right": bound(x1, page_width), "bot": bound(y1, page_height)}


def area(left: Column, top: Column, right: Column, bot: Column) -> Column:
    return (right - left) * (bot - top)


def overlap(a: str, b: str) -> Column:
    """Overlap area of the rectangles whose columns are prefixed by a and b; null where they do not even touch."""
    c = lambda p, n: F.col(f"{p}{n}")
    dx = F.least(c(a, "right"), c(b, "right")) - F.greatest(c(a, "left"), c(b, "left"))
    dy = F.least(c(a, "bot"), c(b, "bot")) - F.greatest(c(a, "top"), c(b, "top"))
    return F.when((dx >= 0) & (dy >= 0), dx * dy)
