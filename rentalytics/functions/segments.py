"""Bands and segment labels. A null never matches a bound, so it takes the last label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions.scalars import _col, percent_difference

_COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def first_match(*cases: tuple[Column, str], default: str) -> Column:
    """Label of the first true condition."""
    (condition, label), *rest = cases
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def band(c: str | Column, cuts: Sequence[float], labels: Sequence[str], op: str) -> Column:
    """Label of the first cut the value satisfies; the last label is the rest."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one more label than cuts is needed")
    test = _COMPARE[op]
    cases = [(test(_col(c), F.lit(v)), label) for v, label in zip(cuts, labels)]
    return first_match(*cases, default=labels[-1])


def dist_bucket(c: str | Column = "dist") -> Column:
    return band(c, C.DIST_CUTS, C.DIST_LABELS, "<")


def metro_bucket(c: str | Column = "metro_dist") -> Column:
    return band(c, C.METRO_CUTS, C.METRO_LABELS, "<")


def satisfaction_bucket(c: str | Column = "guest_satisfaction_overall") -> Column:
    return band(c, C.SATISFACTION_CUTS, C.SATISFACTION_LABELS, ">=")


def attraction_band(c: str | Column = "attr_index_norm") -> Column:
    return band(c, C.INDEX_CUTS, C.ATTRACTION_LABELS, ">=")


def food_band(c: str | Column = "rest_index_norm") -> Column:
    return band(c, C.INDEX_CUTS, C.FOOD_LABELS, ">=")


def amenity_tier(c: str | Column = "amenity_count") -> Column:
    return band(c, C.TIER_CUTS, C.TIER_LABELS, "<=")


def amenity_bundle(c: str | Column = "amenity_count") -> Column:
    return band(c, C.BUNDLE_CUTS, C.BUNDLE_LABELS, ">=")


def gauge_band(c: str | Column) -> Column:
    return band(c, C.GAUGE_CUTS, C.GAUGE_LABELS, "<")


def biz_multi_segment(biz: str = "biz", multi: str = "multi") -> Column:
    is_biz, is_multi = F.col(biz) == 1, F.col(multi) == 1
    return first_match(
        (is_biz & is_multi, "BIZ+MULTI"),
        (is_biz, "BIZ_ONLY"),
        (is_multi, "MULTI_ONLY"),
        default="STANDARD",
    )


def privacy_segment(shared: str = "room_shared", private: str = "room_private") -> Column:
    return first_match(
        (F.col(shared) == 1, "SHARED"), (F.col(private) == 1, "PRIVATE"), default="OTHER"
    )


def accessibility_segment(
    metro: str = "metro_dist", dist: str = "dist", metro_km: float = 0.5, center_km: float = 1.0
) -> Column:
    return first_match(
        (F.col(metro) <= metro_km, "METRO_ADVANTAGE"),
        (F.col(dist) <= center_km, "CENTER_ADVANTAGE"),
        default="REMOTE",
    )


def pricing_status(diff: str = "diff_percent", limit: float = 20.0) -> Column:
    return first_match(
        (F.col(diff) <= -limit, "UNDERPRICED"),
        (F.col(diff) >= limit, "OVERPRICED"),
        default="FAIR",
    )


def value_segment(
    diff: str = "diff_percent",
    clean: str = "cleanliness_rating",
    satisfaction: str = "guest_satisfaction_overall",
    limit: float = 20.0,
    good: tuple[float, float] = (4.5, 90.0),
    poor: tuple[float, float] = (4.2, 88.0),
) -> Column:
    cheap, dear = F.col(diff) <= -limit, F.col(diff) >= limit
    is_good = (F.col(clean) >= good[0]) & (F.col(satisfaction) >= good[1])
    is_poor = (F.col(clean) < poor[0]) | (F.col(satisfaction) < poor[1])
    return first_match(
        (cheap & is_good, "GEM"), (dear & is_poor, "OVERPRICED_LOW_VALUE"), default="FAIR"
    )


def weekend_strategy(
    weekend: str = "weekend_avg",
    weekday: str = "weekday_avg",
    push: float = 10.0,
    risk: float = -5.0,
) -> Column:
    premium = percent_difference(weekend, weekday)
    return first_match(
        (premium >= push, "PUSH_WEEKEND_PRICING"),
        (premium <= risk, "WEEKEND_DISCOUNT_RISK"),
        default="STABLE_WEEKEND",
    )


def amenity_strategy(
    typical_price: Column,
    bundle: str = "amenity_bundle",
    price: str = "avg_price",
    satisfaction: str = "avg_sat",
    min_satisfaction: float = 88.0,
) -> Column:
    """``typical_price`` is the price to compare with, e.g. the mean of all group means."""
    basic = F.col(bundle) == C.BUNDLE_LABELS[2]
    full = F.col(bundle) == C.BUNDLE_LABELS[0]
    return first_match(
        (basic & (F.col(price) > typical_price), "UPGRADE_AMENITIES_HIGH_ROI"),
        (full & (F.col(satisfaction) < min_satisfaction), "QUALITY_ISSUE_NOT_AMENITIES"),
        default="KEEP_CURRENT_BUNDLE",
    )
