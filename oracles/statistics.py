"""DuckDB SQL for statistics and the dashboard."""

from oracles.inputs import LISTINGS, r6, with_
from rentalytics import constants as C

YS = ("realSum", "guest_satisfaction_overall", "cleanliness_rating")


def listings(body: str, *ctes: str) -> str:
    return with_(LISTINGS, *ctes, body=body)


def moments(group: str = "room_type", source: str = "listings") -> str:
    pairs = ", ".join(
        f"covar_pop({a}, {b}) as cov_{a}_{b}" for i, a in enumerate(YS) for b in YS[i:])
    return f"""m as materialized (
 select {group} as g, count(*) as n, {', '.join(f'avg({y}) as mean_{y}' for y in YS)}, {pairs}
 from {source} group by 1),
grand as materialized (
 select {', '.join(f'sum(n * mean_{y}) / sum(n) as grand_{y}' for y in YS)} from m)"""


def ss(y: str) -> str:
    return f"""ss_{y} as (
 select count(*) - 1 as df1, sum(n) - count(*) as df2,
  sum(n * (mean_{y} - grand_{y}) * (mean_{y} - grand_{y})) as ssb, sum(n * cov_{y}_{y}) as ssw
 from m, grand)"""


def leading(x: str, digits: int = 9) -> str:
    """Leading digits of a value; see ``significant`` in the query catalog."""
    power = f"floor(log10(abs({x})))"
    return (f"case when {x} = 0 then 0.0e0 else sign({x}) *"
            f" round(abs({x}) / pow(10.0e0, {power}) + 1.234567e-11, {digits - 1}) end")


def power(x: str) -> str:
    return f"case when {x} <> 0 then cast(floor(log10(abs({x}))) as int) end"


def anova_rows(y: str) -> str:
    return f"""
select '{y}' as response, 'group' as term, cast(df1 as bigint) as df, {leading('ssb')} as sum_sq,
 {leading('(ssb / df1)')} as mean_sq, {r6('(ssb / df1) / (ssw / df2)')} as f_value,
 {power('ssb')} as sum_sq_power, {power('(ssb / df1)')} as mean_sq_power from ss_{y}
union all
select '{y}', 'residuals', cast(df2 as bigint), {leading('ssw')}, {leading('(ssw / df2)')}, null,
 {power('ssw')}, {power('(ssw / df2)')} from ss_{y}"""


_E = {(a, b): f"sum(n * cov_{a}_{b})" for i, a in enumerate(YS) for b in YS[i:]}
_H = {(a, b): f"sum(n * (mean_{a} - grand_{a}) * (mean_{b} - grand_{b}))"
      for i, a in enumerate(YS) for b in YS[i:]}


def _det(prefix: str) -> str:
    def c(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        e = f"e{i}{j}" if prefix == "e" else f"(e{i}{j} + h{i}{j})"
        return f"({e} / sqrt((e{i}{i} + h{i}{i}) * (e{j}{j} + h{j}{j})))"
    return (f"({c(0,0)} * ({c(1,1)} * {c(2,2)} - {c(1,2)} * {c(2,1)})"
            f" - {c(0,1)} * ({c(1,0)} * {c(2,2)} - {c(1,2)} * {c(2,0)})"
            f" + {c(0,2)} * ({c(1,0)} * {c(2,1)} - {c(1,1)} * {c(2,0)}))")


_SUMS = ", ".join(
    [f"{x} as e{YS.index(a)}{YS.index(b)}" for (a, b), x in _E.items()]
    + [f"{x} as h{YS.index(a)}{YS.index(b)}" for (a, b), x in _H.items()])
_MANOVA = f"""sums as (select count(*) - 1 as q, sum(n) - count(*) as ve, {_SUMS} from m, grand),
w as (select *, {_det('e')} / {_det('eh')} as wilks, ve - (3 - q + 1) / 2 as w,
 case when 9 + q * q - 5 > 0 then sqrt((9.0 * q * q - 4) / (9 + q * q - 5)) else 1 end as t from sums),
r as (select *, 3.0 * q as d1, w * t - (3.0 * q - 2) / 2 as d2 from w)"""
_TUKEY = f"""total as (select sum(n * cov_realSum_realSum) / (sum(n) - count(*)) as mse from m),
pairs as (
 select a.g as group_1, b.g as group_2, a.mean_realSum - b.mean_realSum as diff,
  sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) as se from m a join m b on a.g > b.g, total)"""


def box(y: str, group: str, source: str) -> str:
    return f"""q as (
 select {group} as g, quantile_cont({y}, 0.25) as q1, quantile_cont({y}, 0.5) as median,
  quantile_cont({y}, 0.75) as q3 from {source} where {y} is not null group by 1)"""


def box_rows(y: str, group: str, source: str) -> str:
    inside = f"{y} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"
    return f"""
select {group}, {r6('q1')} as q1, {r6('median')} as median, {r6('q3')} as q3, count(*) as n,
 min(case when {inside} then {y} end) as whisker_low,
 max(case when {inside} then {y} end) as whisker_high,
 count(*) filter (not ({inside})) as outliers
from {source} join q on {group} = g where {y} is not null group by {group}, q1, median, q3"""


def summary(y: str, source: str) -> str:
    return f"""select '{y}' as column_name, min({y}) as minimum,
 {r6(f'quantile_cont({y}, 0.25)')} as q1, {r6(f'quantile_cont({y}, 0.5)')} as median,
 {r6(f'quantile_cont({y}, 0.75)')} as q3, {r6(f'avg({y})')} as mean, max({y}) as maximum,
 count(*) - count({y}) as nulls from {source}"""


_IQR = """iqr as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)"""
_SPEC = """city in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7', 'NATION_15')
 and room_type in ('STANDARD', 'ECONOMY', 'PROMO') and realSum between 5000 and 60000
 and person_capacity between 2 and 5 and guest_satisfaction_overall >= 75
 and host_is_superhost = 1 and is_weekend = 0"""
SQL = {
    "complete_cases": """
select l_extendedprice as realSum, l_quantity / cast(10 as double) as cleanliness_rating,
 p_type as room_type from lineitem join part on l_partkey = p_partkey""",
    "level_counts": listings("select room_type, count(*) as n from listings group by 1"),
    "numeric_summary": listings(summary("realSum", "listings")),
    "numeric_summary_events": summary("value", "events"),
    "quantiles_by_group": f"""select event_type, {r6('quantile_cont(value, 0.1)')} as p10,
 {r6('quantile_cont(value, 0.5)')} as p50, {r6('quantile_cont(value, 0.99)')} as p99
 from events group by 1""",
    "anova_price": listings(anova_rows("realSum"), moments(), ss("realSum")),
    "anova_each": listings(
        " union all ".join(anova_rows(y) for y in YS),
        moments(), *[ss(y) for y in YS]),
    "tukey_pairs": listings(
        f"select group_1, group_2, {r6('diff')} as diff, {r6('se')} as se,"
        f" {r6('abs(diff) / se')} as q from pairs", moments(), _TUKEY),
    "manova_wilks": listings(
        f"select {r6('wilks', 9)} as wilks, {r6('(pow(wilks, -1.0 / t) - 1) * d2 / d1')} as approx_f,"
        " cast(d1 as double) as df1, " + r6("d2") + " as df2 from r", moments(), _MANOVA),
    "group_error_bars": listings(f"""
select room_type, {r6('avg(realSum)')} as mean, {r6('stddev_samp(realSum)')} as sd, count(*) as n,
 {r6('stddev_samp(realSum) / sqrt(count(*))')} as se,
 {r6('avg(realSum) - stddev_samp(realSum) / sqrt(count(*))')} as lower,
 {r6('avg(realSum) + stddev_samp(realSum) / sqrt(count(*))')} as upper from listings group by 1"""),
    "box_stats": with_(box("value", "event_type", "events"),
                       body=box_rows("value", "event_type", "events")),
    "group_means": listings(f"""
select room_type, {', '.join(f"{r6(f'avg({y})')} as mean_{y}" for y in YS)} from listings group by 1"""),
    "scatter_sample": listings(f"""
select listing_id, {', '.join(YS)}, room_type from listings
order by md5(listing_id || '_42'), listing_id limit 1500"""),
    "iqr_filter": with_(_IQR, body="""
select event_id, value from events, iqr
where value between a - 1.5 * (b - a) and b + 1.5 * (b - a)"""),
    "apply_filters": listings(f"""
select listing_id, city, room_type, realSum, person_capacity, guest_satisfaction_overall,
 host_is_superhost, is_weekend from listings where {_SPEC}"""),
    "filter_domains": listings("""
select 'city' as field, city as choice, null::bigint as low, null::bigint as high from listings group by 2
union all select 'room_type', room_type, null, null from listings group by 2
union all select 'realSum', null, cast(trunc(min(realSum)) as bigint), cast(trunc(max(realSum)) as bigint) from listings
union all select 'person_capacity', null, min(person_capacity), max(person_capacity) from listings"""),
    "kpis": listings(f"""
select count(*) filter ({_SPEC}) as listings, count(*) as total,
 {r6(f'avg(realSum) filter ({_SPEC})')} as avg_price,
 {r6(f'avg(guest_satisfaction_overall) filter ({_SPEC})')} as avg_rating from listings"""),
    "value_share": listings(f"""
select room_type as value, count(*) as n, {r6('count(*) / sum(count(*)) over ()')} as share
from listings group by 1"""),
    "superhost_share": listings(f"""
select host_is_superhost as value, count(*) as n, {r6('count(*) / sum(count(*)) over ()')} as share,
 case when host_is_superhost = 1 then 'Superhost' else 'Regular' end as label
from listings group by host_is_superhost"""),
    "map_sample": listings("""
select listing_id, city, room_type, latitude, longitude, realSum, dist from listings
order by md5(listing_id || '_42'), listing_id limit 1500"""),
    "price_by_day": listings(f"""
select is_weekend, {r6('avg(realSum)')} as avg_price,
 case when is_weekend = 1 then 'Weekend' else 'Weekday' end as day_label from listings group by is_weekend"""),
    "price_by_capacity": listings(
        f"select person_capacity, {r6('avg(realSum)')} as avg_price from listings group by 1"),
    "satisfaction_gauge": listings(f"""
select {r6('avg(guest_satisfaction_overall)')} as avg_satisfaction,
 case when avg(guest_satisfaction_overall) < 50 then '0–50'
  when avg(guest_satisfaction_overall) < 80 then '50–80' else '80–100' end as gauge_band from listings"""),
    "price_box": listings(box_rows("realSum", "room_type", "listings"),
                          box("realSum", "room_type", "listings")),
    "what_if_base_rows": listings("""
select city, arg_min(room_type, listing_id) as room_type,
 arg_min(person_capacity, listing_id) as person_capacity,
 arg_min(cleanliness_rating, listing_id) as cleanliness_rating,
 arg_min(dist, listing_id) as dist, arg_min(is_weekend, listing_id) as is_weekend
from listings group by city"""),
}
