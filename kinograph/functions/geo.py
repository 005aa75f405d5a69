"""Plane geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the pitch's length and width in metres, the boundary of its outer thirds, the width of one of five lanes, frames a second.
HALF_LENGTH_M, HALF_WIDTH_M, THIRD_M, LANE_M, FRAME_RATE = 52.5, 34.0, 17.5, 13.6, 25


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean distance; null if a coordinate is missing."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The place of p's projection on the line through a and b: 0 at a, 1 at b; null if a is b."""
    dx, dy = bx - ax, by - ay
    sq = dx * dx + dy * dy
    return F.when(sq > 0, ((px - ax) * dx + (py - ay) * dy) / sq)


def to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p from the endless line through a and b."""
    t = along(px, py, ax, ay, bx, by)
    return dist(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p from the segment between a and b."""
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along(px, py, ax, ay, bx, by))), F.lit(0.0))
    return dist(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; null if one has no length."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    c = (ax * bx + ay * by) / F.when(n > 0, n)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees of a vector's direction, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def side(y: Column, buffer: float) -> Column:
    return F.when(y > buffer, F.lit("RIGHT")).when(y < -buffer, F.lit("LEFT")).when(y.isNotNull(), F.lit("CENTER"))


def lane(y: Column) -> Column:
    """One of five lanes across the pitch, each open above but the last; null outside the pitch."""
    return F.when((y < -HALF_WIDTH_M) | (y > HALF_WIDTH_M), F.lit(None).cast("int")).when(
        y.isNotNull() & ~F.isnan(y), F.least(F.floor((y + HALF_WIDTH_M) / LANE_M), F.lit(4)).cast("int")
    )


def point(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x_m"), y.alias("y_m")))


def zone(nx: Column, name: str, buffer: float) -> tuple[Column, Column]:
    """Whether x (along the attack) is in a zone, and whether it is too close to a boundary of the zone to tell."""
    near = lambda b: F.abs(nx - b) <= buffer
    inside, bounds = {
        "own_half": (nx < 0, (0.0,)),
        "attacking_half": (nx > 0, (0.0,)),
        "defensive_half": (nx < 0, (0.0,)),
        "defensive_third": (nx < -THIRD_M, (-THIRD_M,)),
        "middle_third": ((nx > -THIRD_M) & (nx < THIRD_M), (-THIRD_M, THIRD_M)),
        "final_third": (nx > THIRD_M, (THIRD_M,)),
    }[name]
    close = F.lit(False)
    for b in bounds:
        close = close | near(b)
    return inside, close


#: Shares of half the width at which lanes begin.
HALF_SPACE, WIDE = 0.33, 0.66


def destination(y: Column) -> tuple[Column, Column, Column]:
    """The side (right of the axis: y > 0), the lane and the bounds of the lane's band on that side, for a target at y; at the axis itself the central band of both sides."""
    away = F.abs(y)
    side = F.when(y > 0, "right").when(y < 0, "left").otherwise("central")
    inner, outer = HALF_WIDTH_M * HALF_SPACE, HALF_WIDTH_M * WIDE
    lane = F.when(away >= outer, "wide").when(away >= inner, "half_space").otherwise("central")
    least = F.when(away >= outer, round(outer, 3)).when(away >= inner, round(inner, 3)).otherwise(0.0)
    most = F.when(away >= outer, float(HALF_WIDTH_M)).when(away >= inner, round(outer, 3)).otherwise(round(inner, 3))
    low = F.when(y > 0, least).otherwise(-most)
    high = F.when(y < 0, -least).otherwise(most)
    return side, lane, F.struct(low.alias("min_y_m"), high.alias("max_y_m"))
