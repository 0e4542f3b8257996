"""Boxes (x1, y1, x2, y2), and what kind of mark a field is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _side(a: Column, k: int) -> Column:
    return F.get(a, F.lit(k))


def area(a: Column) -> Column:
    return (_side(a, 2) - _side(a, 0)) * (_side(a, 3) - _side(a, 1))


def overlap(a: Column, b: Column) -> Column:
    """The common area as a share of the smaller box; 0 where a box has no area."""
    w = F.least(_side(a, 2), _side(b, 2)) - F.greatest(_side(a, 0), _side(b, 0))
    h = F.least(_side(a, 3), _side(b, 3)) - F.greatest(_side(a, 1), _side(b, 1))
    least = F.least(area(a), area(b))
    share = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) / F.when(least > 0, least)
    return F.coalesce(share, F.lit(0.0))


def clamp(box: Column, width: Column, height: Column) -> Column:
    """The box within an image, one pixel wide and high at least."""
    x1 = F.greatest(F.lit(0), F.least(_side(box, 0), width - 1))
    y1 = F.greatest(F.lit(0), F.least(_side(box, 1), height - 1))
    x2, y2 = (F.greatest(low + 1, F.least(_side(box, k), most)) for low, k, most in ((x1, 2, width), (y1, 3, height)))
    return F.array(x1, y1, x2, y2)


def hull(polygon: Column) -> Column:
    """The box around a polygon of (x, y) points."""
    xs, ys = F.transform(polygon, lambda p: _side(p, 0)), F.transform(polygon, lambda p: _side(p, 1))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def font_size(box: Column, text: Column) -> Column:
    """Points from 8 to 60: three quarters of the height, or a blend of height and width where there is text."""
    w, h, n = _side(box, 2) - _side(box, 0), _side(box, 3) - _side(box, 1), F.length(text)
    by_height = (h * F.lit(0.75)).cast("int")
    by_width = (w / (n * F.lit(0.55))).cast("int")
    blend = (by_height * F.lit(0.7) + by_width * F.lit(0.3)).cast("int")
    return F.greatest(F.lit(8), F.least(F.lit(60), F.when(n > 0, blend).otherwise(by_height)))


def is_mark(field_type: Column, method: Column) -> Column:
    """Signatures, stamps and the like, which are covered and not rewritten."""
    kind = F.lower(F.coalesce(field_type, F.lit("")))
    named = kind.isin("stamp", "signature", "seal", "handwriting", "kase", "imza", "muhur")
    return F.coalesce(method == "visual_detection", F.lit(False)) | named | (kind.rlike("signature|stamp") & ~kind.rlike("name|number"))


def masking_method(field_type: Column, method: Column, given: Column | None = None) -> Column:
    contour = F.lower(F.coalesce(field_type, F.lit(""))).isin("stamp", "signature", "seal", "handwriting") | method.isin("visual_detection", "llm_visual_detection")
    rest = F.lit("white_box_overlay")
    return F.when(contour, "contour").otherwise(rest if given is None else F.coalesce(given, rest))
