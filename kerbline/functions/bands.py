"""Score bands, colours and distance factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits and the colours of the maps.
SAFE_MAX = 0.33
CAUTION_MAX = 0.66
DANGER_MAX = 0.85
BAND_COLOURS = {"safe": "#1D9E75", "caution": "#FFE066", "danger": "#FF9933", "severe": "#E63946"}
NO_SCORE_COLOUR = "#9ca3af"
WALK_COLOURS = ["#1a9850", "#66bd63", "#a6d96a", "#fee08b", "#f46d43", "#d73027"]
ROAD_COLOURS = ["#1a9850", "#91cf60", "#ffffbf", "#fc8d59", "#d73027"]
STEPS = [0.2, 0.4, 0.6, 0.8]


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def risk_band(score) -> Column:
    s = _c(score)
    return (
        F.when(s <= SAFE_MAX, "safe").when(s <= CAUTION_MAX, "caution").when(s <= DANGER_MAX, "danger")
        .when(s.isNotNull(), "severe")
    )


def _colour(s: Column, colours: list[str], first: Column) -> Column:
    out = F.when(s.isNull(), NO_SCORE_COLOUR).when(first, colours[0])
    for limit, colour in zip(STEPS[len(STEPS) - len(colours) + 2 :], colours[1:]):
        out = out.when(s < limit, colour)
    return out.otherwise(colours[-1])


def walk_colour(score) -> Column:
    """Six steps: zero, then below 0.2, 0.4, 0.6, 0.8, and above."""
    s = _c(score)
    return _colour(s, WALK_COLOURS, s <= 0)


def road_colour(score) -> Column:
    """Five steps of width 0.2."""
    s = _c(score)
    return _colour(s, ROAD_COLOURS, s < STEPS[0])


def distance_discount(d, near=5.0, mid=25.0, far=80.0) -> Column:
    """1 up to ``near``, falling to 0.5 at ``mid`` and to 0 at ``far``."""
    d, near, mid, far = (_c(v) if isinstance(v, (str, Column)) else F.lit(float(v)) for v in (d, near, mid, far))
    factor = (
        F.when(d <= near, 1.0)
        .when(d <= mid, F.lit(1.0) - F.lit(0.5) * F.try_divide(d - near, mid - near))
        .when(d <= far, F.lit(0.5) - F.lit(0.5) * F.try_divide(d - mid, far - mid))
        .when(d.isNotNull(), 0.0)
    )
    return F.when(factor.isNotNull(), F.least(F.greatest(factor, F.lit(0.0)), F.lit(1.0)))
