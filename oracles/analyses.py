"""DuckDB SQL for the nine analyses and their building blocks."""

from oracles.inputs import LISTINGS, hash_id, r6, with_

AMENITY_SUM = "(wifi + kitchen + air_conditioning + parking + tv + heating)"
BENCH = """bench as (
 select city, room_type, avg(realSum) as bench_avg, count(*) as bench_n
 from listings where realSum is not null group by city, room_type)"""
SCORED = f"""scored as (
 select l.*, {AMENITY_SUM} as amenity_count, bench_avg, bench_n,
  realSum - bench_avg as diff_amount,
  100.0 * (realSum - bench_avg) / nullif(bench_avg, 0) as diff_percent
 from listings l join bench b using (city, room_type)
 where bench_n >= 50 and realSum is not null)"""
DIST = """case when dist < 1 then '0–1 km' when dist < 3 then '1–3 km' when dist < 6 then '3–6 km'
 else '6+ km' end"""
METRO = """case when metro_dist < 0.5 then '0–0.5 km' when metro_dist < 1 then '0.5–1 km'
 when metro_dist < 2 then '1–2 km' else '2+ km' end"""
SATISFACTION = """case when guest_satisfaction_overall >= 95 then '95–100'
 when guest_satisfaction_overall >= 90 then '90–94'
 when guest_satisfaction_overall >= 80 then '80–89' else '<80' end"""
BIZ_MULTI = """case when biz = 1 and multi = 1 then 'BIZ+MULTI' when biz = 1 then 'BIZ_ONLY'
 when multi = 1 then 'MULTI_ONLY' else 'STANDARD' end"""
PRIVACY = """case when room_shared = 1 then 'SHARED' when room_private = 1 then 'PRIVATE'
 else 'OTHER' end"""


def bundle(c: str) -> str:
    return (f"case when {c} >= 5 then 'AMENITIES_FULL' when {c} >= 3 then 'AMENITIES_COMFORT'"
            " else 'AMENITIES_BASIC' end")


def tier(c: str) -> str:
    return f"case when {c} <= 1 then 'BASIC' when {c} <= 3 then 'COMFORT' else 'FULL' end"


def index_band(c: str, word: str) -> str:
    return (f"case when {c} >= 4 then 'HIGH_{word}' when {c} >= 2 then 'MID_{word}'"
            f" else 'LOW_{word}' end")


LISTING_SCORE = with_(LISTINGS, BENCH, SCORED, body=f"""
select listing_id, city, country, room_type, realSum, {r6('bench_avg')} as bench_avg, bench_n,
 {r6('diff_amount')} as diff_amount, {r6('diff_percent')} as diff_percent, cleanliness_rating,
 guest_satisfaction_overall, person_capacity, bedrooms, dist, metro_dist, {DIST} as dist_bucket,
 {METRO} as metro_bucket, is_weekend, host_is_superhost, amenity_count,
 {SATISFACTION} as satisfaction_bucket
from scored order by scored.diff_percent desc nulls last, listing_id limit 200""")

SEGMENT_DASHBOARD = with_(LISTINGS, BENCH, SCORED, body=f"""
select country, city, room_type, {DIST} as dist_bucket, {METRO} as metro_bucket, is_weekend,
 count(*) as n, {r6('avg(realSum)')} as avg_price,
 {r6('avg(diff_percent)')} as avg_vs_benchmark_percent,
 {r6('avg(cleanliness_rating)')} as avg_clean,
 {r6('avg(guest_satisfaction_overall)')} as avg_satisfaction,
 cast(sum(amenity_count) // count(amenity_count) as bigint) as avg_amenities,
 {r6('avg(amenity_count)')} as avg_amenities_exact
from scored group by all having count(*) >= 50""")

_DEAL = f"""listing_id, city, country, room_type, realSum, {r6('bench_avg')} as bench_avg,
 {r6('diff_amount')} as diff_amount, {r6('diff_percent')} as diff_percent, cleanliness_rating,
 guest_satisfaction_overall, amenity_count"""
BEST_DEALS = with_(LISTINGS, BENCH, SCORED, body=f"""
select 'UNDERPRICED' as label, {_DEAL} from scored
where cleanliness_rating >= 4.5 and guest_satisfaction_overall >= 90
order by scored.diff_percent asc nulls first, listing_id limit 30""")
WORST_DEALS = with_(LISTINGS, BENCH, SCORED, body=f"""
select 'OVERPRICED' as label, {_DEAL} from scored
order by scored.diff_percent desc nulls last, listing_id limit 30""")

ACCESSIBILITY = with_(LISTINGS, body="""
select listing_id, city, country, room_type, realSum, dist, metro_dist, cleanliness_rating,
 guest_satisfaction_overall, is_weekend, host_is_superhost,
 case when metro_dist <= 0.5 then 'METRO_ADVANTAGE' when dist <= 1.0 then 'CENTER_ADVANTAGE'
  else 'REMOTE' end as accessibility_segment
from listings where realSum is not null""")
AMENITY_TIERS = with_(LISTINGS, body=f"""
select listing_id, city, country, room_type, realSum, cleanliness_rating,
 guest_satisfaction_overall, {AMENITY_SUM} as amenity_count, {tier(AMENITY_SUM)} as amenity_tier
from listings where realSum is not null""")

INSIGHT_COLUMNS = with_(LISTINGS, BENCH, SCORED, body=f"""
select {_DEAL},
 case when diff_percent <= -20 then 'UNDERPRICED' when diff_percent >= 20 then 'OVERPRICED'
  else 'FAIR' end as pricing_status,
 case when diff_percent <= -20 and cleanliness_rating >= 4.5 and guest_satisfaction_overall >= 90
   then 'GEM'
  when diff_percent >= 20 and (cleanliness_rating < 4.2 or guest_satisfaction_overall < 88)
   then 'OVERPRICED_LOW_VALUE'
  else 'FAIR' end as value_segment,
 {tier('amenity_count')} as amenity_tier
from scored""".replace("when diff_percent", "when scored.diff_percent"))

_FEATURES = {
    "segment_biz_multi": BIZ_MULTI,
    "privacy_segment": PRIVACY,
    "amenity_bundle": bundle("amenity_count"),
    "host_is_superhost": "cast(host_is_superhost as varchar)",
    "weekend": "cast(is_weekend as varchar)",
    "attraction_band": index_band("attr_index_norm", "ATTRACTION"),
    "food_band": index_band("rest_index_norm", "FOOD"),
}
_IMPACT = "impact as (" + "\n union all ".join(
    f"select '{f}' as feature, {e} as feature_value, count(*) as n,"
    " avg(diff_percent) as pct, avg(diff_amount) as amount from scored group by 2"
    for f, e in _FEATURES.items()) + ")"
FEATURE_IMPACT = with_(LISTINGS, BENCH, SCORED, _IMPACT, body=f"""
select feature, feature_value, n, {r6('pct')} as avg_premium_pct,
 {r6('amount')} as avg_premium_amount,
 cast(dense_rank() over (partition by feature order by pct desc nulls last) as int) as feature_rank
from impact where n >= 200""")

_GROUP_AVGS = """count(*) as n, avg(realSum) as avg_price, avg(attr_index_norm) as avg_attr,
  avg(rest_index_norm) as avg_food, avg(guest_satisfaction_overall) as avg_sat,
  avg(case when is_weekend = 1 then realSum end) as weekend_avg,
  avg(case when is_weekend = 0 then realSum end) as weekday_avg"""
GEO_HOTSPOTS = with_(LISTINGS, f"""agg as (
 select country, city, room_type,
  cast(round(latitude / cast(0.02 as double), 0) as int) as lat_cell,
  cast(round(longitude / cast(0.02 as double), 0) as int) as lon_cell, {_GROUP_AVGS},
  avg(case when metro_dist <= 0.7 then realSum end) as near_avg,
  avg(case when metro_dist > 0.7 then realSum end) as far_avg
 from listings
 where realSum is not null and latitude is not null and longitude is not null
 group by 1, 2, 3, 4, 5 having count(*) >= 80)""", """scored as (
 select *, 100.0 * (near_avg - far_avg) / nullif(far_avg, 0) as metro_pct,
  100.0 * (weekend_avg - weekday_avg) / nullif(weekday_avg, 0) as weekend_pct,
  avg_price * 0.45 + avg_attr * 8.0 + avg_food * 8.0 + avg_sat * 0.4 as score
 from agg)""", body=f"""
select country, city, room_type, lat_cell, lon_cell, n, {r6('avg_price')} as avg_price,
 {r6('avg_attr')} as avg_attr, {r6('avg_food')} as avg_food, {r6('avg_sat')} as avg_sat,
 {r6('metro_pct')} as metro_premium_pct, {r6('weekend_pct')} as weekend_premium_pct,
 {r6('score')} as hotspot_score,
 cast(dense_rank() over (partition by city, room_type order by score desc nulls last) as int)
  as hotspot_rank_in_city
from scored order by score desc nulls last, country, city, room_type, lat_cell, lon_cell
limit 150""")

STRATEGY_SCORES = with_(LISTINGS, f"""agg as (
 select country, city, room_type, {BIZ_MULTI} as biz_multi_segment,
  {bundle(AMENITY_SUM)} as amenity_bundle, host_is_superhost, {_GROUP_AVGS}
 from listings where realSum is not null group by 1, 2, 3, 4, 5, 6 having count(*) >= 80)""",
 """scored as (
 select *, 100.0 * (weekend_avg - weekday_avg) / nullif(weekday_avg, 0) as weekend_pct,
  avg_sat * 0.55 + avg_attr * 6.0 + avg_food * 6.0 + avg_price * 0.08 as score
 from agg)""", body=f"""
select country, city, room_type, biz_multi_segment, amenity_bundle, host_is_superhost, n,
 {r6('avg_price')} as avg_price, {r6('avg_sat')} as avg_sat, {r6('avg_attr')} as avg_attr,
 {r6('avg_food')} as avg_food, {r6('weekend_pct')} as weekend_premium_pct,
 {r6('score')} as strategy_score,
 case when weekend_pct >= 10 then 'PUSH_WEEKEND_PRICING'
  when weekend_pct <= -5 then 'WEEKEND_DISCOUNT_RISK' else 'STABLE_WEEKEND' end as weekend_strategy,
 case when amenity_bundle = 'AMENITIES_BASIC'
   and scored.avg_price > (select avg(a.avg_price) from agg a) then 'UPGRADE_AMENITIES_HIGH_ROI'
  when amenity_bundle = 'AMENITIES_FULL' and scored.avg_sat < 88 then 'QUALITY_ISSUE_NOT_AMENITIES'
  else 'KEEP_CURRENT_BUNDLE' end as amenity_strategy,
 cast(dense_rank() over (partition by country order by score desc nulls last) as int) as country_rank
from scored
order by score desc nulls last, country, city, room_type, biz_multi_segment, amenity_bundle,
 host_is_superhost limit 200""")

# --- warehouse ------------------------------------------------------------------
_KEYS = {
    "location_id": ("city", "country", "latitude", "longitude"),
    "host_id": ("host_is_superhost",),
    "room_type_id": ("room_type", "room_shared", "room_private"),
    "amenity_id": ("wifi", "kitchen", "air_conditioning", "parking", "tv", "heating"),
    "day_id": ("day_type", "is_weekend", "biz", "multi"),
}
_MEASURES = (
    "realSum, person_capacity, bedrooms, beds, cleanliness_rating, guest_satisfaction_overall,"
    " dist, metro_dist, attr_index, attr_index_norm, rest_index, rest_index_norm")


def dim(key: str) -> str:
    cols = _KEYS[key]
    return with_(LISTINGS, body=f"select distinct {hash_id(*cols)} as {key}, {', '.join(cols)} from listings")


_FKS = ", ".join(f"{hash_id(*c)} as {k}" for k, c in _KEYS.items())
_FKS_10 = ", ".join(f"{hash_id(*c, hex_digits=10)} as {k}" for k, c in _KEYS.items())
FACT_10 = with_(LISTINGS, body=f"select listing_id, {_FKS_10}, {_MEASURES} from listings")
WIDE_10 = with_(LISTINGS, body=f"select *, {_FKS_10} from listings")
FACT = with_(LISTINGS, body=f"select listing_id, {_FKS}, {_MEASURES} from listings")
WIDE = with_(LISTINGS, body=f"select *, {_FKS} from listings")
_CHECKS = " union all ".join(
    [f"""select 'primary_key' as check_name, '{t}' as table_name, count(*) as bad_keys,
 cast(coalesce(sum(n), 0) as bigint) as bad_rows from (select k, count(*) as n from
 (select distinct {hash_id(*c)} as k, {', '.join(c)} from listings) group by k having count(*) > 1)
 union all select 'foreign_key', '{t}', 0, 0"""
     for t, c in zip(("dim_location", "dim_host", "dim_room_type", "dim_amenities", "dim_day"),
                     _KEYS.values())]
    + ["""select 'primary_key', 'fact_listings', count(*), cast(coalesce(sum(n), 0) as bigint)
 from (select listing_id, count(*) as n from listings group by 1 having count(*) > 1)"""])
CHECK_STAR = with_(LISTINGS, body=_CHECKS)
DIM_LOCATION_10 = with_(LISTINGS, body=(
    f"select distinct {hash_id(*_KEYS['location_id'], hex_digits=10)} as location_id,"
    f" {', '.join(_KEYS['location_id'])} from listings"))
STAR_JOIN = with_(LISTINGS, body="""
select listing_id, city, country, room_type, room_shared, room_private, host_is_superhost,
 day_type, is_weekend, biz, multi, wifi, kitchen, air_conditioning, parking, tv, heating, realSum,
 dist from listings where realSum is not null""")
BENCHMARK = with_(LISTINGS, BENCH, body=f"select city, room_type, {r6('bench_avg')} as bench_avg, bench_n from bench")
GRID_CELLS = with_(LISTINGS, body="""
select country, city, cast(round(latitude / cast(0.02 as double), 0) as int) as lat_cell,
 cast(round(longitude / cast(0.02 as double), 0) as int) as lon_cell, count(*) as n
from listings group by all having count(*) >= 80""")

SQL = {
    "listing_score": LISTING_SCORE,
    "segment_dashboard": SEGMENT_DASHBOARD,
    "best_deals": BEST_DEALS,
    "worst_deals": WORST_DEALS,
    "accessibility_segments": ACCESSIBILITY,
    "amenity_tiers": AMENITY_TIERS,
    "insight_columns": INSIGHT_COLUMNS,
    "feature_impact": FEATURE_IMPACT,
    "geo_hotspots": GEO_HOTSPOTS,
    "strategy_scores": STRATEGY_SCORES,
    "listing_score_star": LISTING_SCORE,
    "segment_dashboard_star": SEGMENT_DASHBOARD,
    "feature_impact_star": FEATURE_IMPACT,
    "geo_hotspots_star": GEO_HOTSPOTS,
    "strategy_scores_star": STRATEGY_SCORES,
    "star_join": STAR_JOIN,
    "benchmark": BENCHMARK,
    "grid_cells": GRID_CELLS,
    "dim_location": dim("location_id"),
    "dim_host": dim("host_id"),
    "dim_room_type": dim("room_type_id"),
    "dim_amenities": dim("amenity_id"),
    "dim_day": dim("day_id"),
    "fact_listings": FACT,
    "fact_listings_joined": FACT,
    "keyed_listings": WIDE,
    "dim_location_10": DIM_LOCATION_10,
    "fact_listings_10": FACT_10,
    "keyed_listings_10": WIDE_10,
    "check_star": CHECK_STAR,
}
