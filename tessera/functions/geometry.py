"""Boxes, points and bins. A box is an array of points, structs of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def center(box: Column, axis: str) -> Column:
    return _mean(F.transform(box, lambda p: p[axis].cast("double")))


def extent(box: Column, axis: str) -> Column:
    values = F.transform(box, lambda p: p[axis].cast("double"))
    return F.array_max(values) - F.array_min(values)


def relative(box: Column, width: Column, height: Column) -> dict[str, Column]:
    """Place and width of a box as shares of the image."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return {"y_rel": center(box, "y") / h, "x_rel": center(box, "x") / w, "width_rel": extent(box, "x") / w}


def rescale(box: Column, scale: Column) -> Column:
    return F.transform(box, lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y")))


def order_points(box: Column) -> Column:
    """Corners as top left, top right, bottom right, bottom left: least and greatest x + y and y - x, the first
    such point on ties."""
    pick = lambda key, sign: F.array_min(F.transform(box, lambda p, i: F.struct((sign * key(p)).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    total, gap = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    corners = [pick(total, F.lit(1.0)), pick(gap, F.lit(1.0)), pick(total, F.lit(-1.0)), pick(gap, F.lit(-1.0))]
    return F.array(*[F.struct(c["x"].alias("x"), c["y"].alias("y")) for c in corners])


def side(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def target_size(corners: Column) -> tuple[Column, Column]:
    """Width and height of the straightened card: the longer of opposite sides, in whole pixels."""
    tl, tr, br, bl = (F.get(corners, i) for i in range(4))
    return F.greatest(side(br, bl), side(tr, tl)).cast("int"), F.greatest(side(tr, br), side(tl, bl)).cast("int")


def warp_is_sane(width: Column, height: Column, full_area: Column) -> Column:
    """Not under a tenth of the picture, nor longer than 3.5 times its other side."""
    long, short = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    return (width * height >= 0.1 * full_area) & (long / short <= 3.5)


# Edges of ten equal bins from 0 to 1, as binary fractions have them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def confidence_bin(x: Column) -> Column:
    """Lower edge, to one decimal, of the bin (a, b] that holds x; null outside (0, 1]."""
    out = F.when(F.lit(False), F.lit(0.0))
    for low, high in zip(EDGES, EDGES[1:], strict=False):
        out = out.when((x > F.lit(low)) & (x <= F.lit(high)), F.lit(round(low, 1)))
    return out


def sharpness_class(blur: Column) -> Column:
    return F.when((blur > 0) & (blur <= 50), "Buram").when((blur > 50) & (blur <= 300), "Sedang").when(blur > 300, "Tajam")
