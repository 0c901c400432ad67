"""Column expressions on points, boxes, frames and cubic curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def intersection(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two ``[x0, y0, x1, y1]`` boxes; 0 for empty unions."""
    inter = intersection(a, b)
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the smaller area."""
    smaller = F.least(area(*a), area(*b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def box_cols(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def box_center(x0, y0, x1, y1) -> tuple[Column, Column]:
    return (x0 + x1) / 2, (y0 + y1) / 2


def box_pad_clip(box: list[Column], pad: float, width, height) -> list[Column]:
    """Whole-pixel box padded on every side and clipped to the page."""
    zero = F.lit(0)
    return [F.greatest(zero, F.floor(box[0] - pad)), F.greatest(zero, F.floor(box[1] - pad)),
            F.least(width, F.ceil(box[2] + pad)), F.least(height, F.ceil(box[3] + pad))]


def box_to_int(box: list[Column]) -> list[Column]:
    """Covering integer ``x, y, width, height`` with 1e-6 slack and extent >= 1."""
    x, y = F.floor(box[0] + 1e-6), F.floor(box[1] + 1e-6)
    return [x, y, F.greatest(F.lit(1), F.ceil(box[2] - 1e-6) - x), F.greatest(F.lit(1), F.ceil(box[3] - 1e-6) - y)]


def detection_window(box: list[Column], margin: int = 24) -> list[Column]:
    """Crop around a detection: floor/ceil of the box plus a margin on every side."""
    return [F.floor(box[0]) - margin, F.floor(box[1]) - margin, F.ceil(box[2]) + margin, F.ceil(box[3]) + margin]


def centered_window(x: Column, y: Column, size: int = 128) -> list[Column]:
    """Square crop of ``size`` pixels whose centre is nearest to the point."""
    left, top = F.floor(x - size / 2 + 0.5), F.floor(y - size / 2 + 0.5)
    return [left, top, left + size, top + size]


def clip_window(win: list[Column], width, height) -> tuple[list[Column], Column]:
    """Clip a window to the page and tell whether anything was cut off."""
    zero = F.lit(0)
    cut = [F.greatest(win[0], zero), F.greatest(win[1], zero), F.least(win[2], width), F.least(win[3], height)]
    clipped = (win[0] < 0) | (win[1] < 0) | (win[2] > width) | (win[3] > height)
    return cut, clipped


def frame_size_px(extent_pt: Column, dpi: int = 200) -> Column:
    return F.ceil(extent_pt * (dpi / 72.0) - 1e-9)


def user_to_px(x, y, crop: list[Column], rotate: Column, dpi: int = 200) -> tuple[Column, Column]:
    """Page user space (points, y up) to canonical pixels (y down) for a clockwise page turn."""
    s = dpi / 72.0
    w, h = crop[2] - crop[0], crop[3] - crop[1]
    u, v = x - crop[0], crop[3] - y
    px = F.when(rotate == 90, h - v).when(rotate == 180, w - u).when(rotate == 270, v).otherwise(u)
    py = F.when(rotate == 90, u).when(rotate == 180, h - v).when(rotate == 270, w - u).otherwise(v)
    return px * s, py * s


# The eight poses "mirror left-right, then turn clockwise" as (rotation, mirrored, m11, m12, m21, m22).
POSES = [
    (0, False, 1, 0, 0, 1), (90, False, 0, -1, 1, 0), (180, False, -1, 0, 0, -1), (270, False, 0, 1, -1, 0),
    (0, True, -1, 0, 0, 1), (90, True, 0, -1, -1, 0), (180, True, 1, 0, 0, -1), (270, True, 0, 1, 1, 0),
]


def decompose(m11, m12, m21, m22) -> tuple[Column, Column, Column]:
    """Clockwise angle in degrees, mirrored flag and scale of a 2x2 map."""
    det = m11 * m22 - m12 * m21
    mirrored = det < 0
    c = F.when(mirrored, -m11).otherwise(m11)
    s = F.when(mirrored, -m21).otherwise(m21)
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), mirrored, F.sqrt(F.abs(det))


def snap_quarter(angle: Column) -> tuple[Column, Column]:
    """Nearest quarter turn and the absolute deviation from it."""
    snapped = F.pmod(F.bround(angle / 90.0).cast("int") * 90, F.lit(360))
    return snapped, F.abs(F.pmod(angle - snapped + 180.0, F.lit(360.0)) - 180.0)


def rotate_box(box: list[Column], width, height, rotation: Column) -> list[Column]:
    """Where ``x, y, w, h`` lands after turning its frame clockwise."""
    x, y, w, h = box
    turned = rotation.isin(90, 270)
    return [
        F.when(rotation == 90, height - (y + h)).when(rotation == 180, width - (x + w)).when(rotation == 270, y).otherwise(x),
        F.when(rotation == 90, x).when(rotation == 180, height - (y + h)).when(rotation == 270, width - (x + w)).otherwise(y),
        F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)]


def unrotate_box(box: list[Column], width, height, rotation: Column) -> list[Column]:
    """Inverse of :func:`rotate_box`; the size is that of the frame before turning."""
    turned = rotation.isin(90, 270)
    rw, rh = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return rotate_box(box, rw, rh, F.pmod(F.lit(360) - rotation, F.lit(360)))


def unscale_box(box: list[Column], scale: Column, width, height) -> list[Column]:
    """Map ``x, y, w, h`` from an enlarged image back, rounding outwards inside the page."""
    x, y, w, h = box
    x0 = F.least(F.greatest(F.floor(x / scale), F.lit(0)), width - 1)
    y0 = F.least(F.greatest(F.floor(y / scale), F.lit(0)), height - 1)
    x1 = F.greatest(F.least(F.ceil((x + w) / scale), width), x0 + 1)
    y1 = F.greatest(F.least(F.ceil((y + h) / scale), height), y0 + 1)
    same = scale == 1.0
    return [F.when(same, a).otherwise(b) for a, b in zip((x, y, w, h), (x0, y0, x1 - x0, y1 - y0))]


def cubic(c: list[Column], t: Column) -> Column:
    """One coordinate of a cubic with control values ``c`` at ``t``."""
    u = F.lit(1.0) - t
    return u * u * u * c[0] + 3.0 * u * u * t * c[1] + 3.0 * u * t * t * c[2] + t * t * t * c[3]


def control_length(xs: list[Column], ys: list[Column]) -> Column:
    legs = [F.sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) for i in range(3)]
    return legs[0] + legs[1] + legs[2]


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    ex, ey = bx - ax, by - ay
    inv = 1.0 / F.greatest(ex * ex + ey * ey, F.lit(1e-12))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * ex + (py - ay) * ey) * inv))
    dx, dy = px - ax - t * ex, py - ay - t * ey
    return F.sqrt(dx * dx + dy * dy)


def tile_starts(extent: Column, size: int, overlap: int) -> Column:
    """Tile origins along one axis; the last tile is shifted back inside the page."""
    stride = size - overlap
    last = extent - size
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(stride).cast("bigint"))
    return F.when(extent <= size, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_distinct(F.concat(steps, F.array(last.cast("bigint")))))


def clip_to_tile(box: list[Column], tile: list[Column], min_visible: float = 0.5) -> tuple[Column, list[Column]]:
    """Whether at least ``min_visible`` of the box lies in the tile, and the box in tile coordinates."""
    inter = [F.greatest(box[0], tile[0]), F.greatest(box[1], tile[1]), F.least(box[2], tile[2]), F.least(box[3], tile[3])]
    full = (box[2] - box[0]) * (box[3] - box[1])
    seen = (inter[2] > inter[0]) & (inter[3] > inter[1]) & (full > 0) & (
        (inter[2] - inter[0]) * (inter[3] - inter[1]) / full >= min_visible)
    return seen, [inter[0] - tile[0], inter[1] - tile[1], inter[2] - tile[0], inter[3] - tile[1]]


def title_block_region(width: Column, height: Column, fractions=(0.65, 0.55, 1.0, 1.0)) -> list[Column]:
    """Search area for the title block as ``x, y, w, h``."""
    x0, y0 = F.floor(width * fractions[0]), F.floor(height * fractions[1])
    x1 = F.greatest(F.bround(width * fractions[2]).cast("bigint"), x0 + 1)
    y1 = F.greatest(F.bround(height * fractions[3]).cast("bigint"), y0 + 1)
    return [x0, y0, x1 - x0, y1 - y0]


def point_box(x: Column, y: Column, size: float = 40.0, whole: bool = False) -> list[Column]:
    """Fixed-size box around a detected point; ``whole`` rounds the corner half to even."""
    left, top = x - size / 2, y - size / 2
    if whole:
        left, top = F.bround(left), F.bround(top)
    return [left, top, F.lit(size), F.lit(size)]


def tolerance_of(w: Column, h: Column, rel: float | None, px: float | None) -> tuple[Column, Column]:
    """Matching radius of a prediction and what is wrong with it.

    With ``rel`` the radius is that share of the shorter side of the prediction's box; without a box, or without
    ``rel``, it is ``px``. Where neither gives one the radius is null and the problem is ``no_box_for_relative``.
    """
    for v in (rel, px):
        if v is not None and not 0 <= v < float("inf"):
            raise ValueError("a tolerance must be finite and not negative")
    if rel is None and px is None:
        raise ValueError("give a relative or a pixel tolerance")
    fixed = F.lit(px).cast("double")
    own = F.when(w.isNotNull() & h.isNotNull(), F.lit(rel).cast("double") * F.least(w, h))
    radius = fixed if rel is None else F.coalesce(own, fixed)
    return radius, F.when(radius.isNull(), F.lit("no_box_for_relative"))
