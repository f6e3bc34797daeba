"""DuckDB SQL for sources, cleaning and imputation."""

from oracles.inputs import LISTINGS, LISTING_PAGES, SOURCE_A, SOURCE_B, gaps, hash_id, r6, with_
from rentalytics import constants as C
from rentalytics.sources.binding import SOURCE_A_RULES, SOURCE_B_RULES


def texts(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CITY = "nullif(lower(trim(split_part(host_location, ',', 1))), '~')"
# Text behind the first comma; null without a comma.
LAND = ("case when strpos(host_location, ',') > 0 then"
        " trim(substr(host_location, strpos(host_location, ',') + 1)) end")
DAY = ("try_strptime(calendar_last_scraped, ['%Y-%m-%d', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S',"
       " '%B %d, %Y', '%Y%m%d'])")
MAP_BOOL = ("case when host_is_superhost in ('t', 'True') then 1"
            " when host_is_superhost in ('f', 'False') then 0 end")
PCT = "try_cast(replace(host_acceptance_rate, '%', '') as double)"
CLEAN = "coalesce(round_even(review_scores_cleanliness * 10, 0) / 10, 0)"
ROOM = """cast(coalesce(room_type = 'Shared room', false) as int) as room_shared,
 cast(coalesce(room_type = 'Private room', false) as int) as room_private"""
MULTI = "coalesce(cast(host_listings_count > 1 as int), 0)"
AMEN = ", ".join(
    f"cast(coalesce(contains(lower(amenities), '{a.replace('_', ' ')}'), false) as int) as {a}"
    for a in C.AMENITIES)
NULLS = ", ".join(f"cast(null as double) as {m}" for m in C.DISTANCE_MEASURES)
MAPPED = "case " + " ".join(
    f"when lower(country) = '{k}' then '{v}'" for k, v in C.COUNTRY_TO_CITY.items()) + " end"
RESOLVED = f"case when coalesce(city in {texts(C.ALLOWED_CITIES)}, false) then city else {MAPPED} end"
LOCATED = f"located as (select *, {CITY} as city, {LAND} as country from source_b)"
UNWANTED = texts(C.UNWANTED_REGIONS)


def clean_b(keep_only_allowed: bool) -> str:
    only = f"and city in {texts(C.ALLOWED_CITIES)}" if keep_only_allowed else ""
    return f"""kept as (
 select *, {RESOLVED} as final_city from located
 where {MAP_BOOL} is not null and {PCT} is not null {only}),
clean_b as (
 select price as realSum, room_type, accommodates as person_capacity,
  {MAP_BOOL} as host_is_superhost, {CLEAN} as cleanliness_rating,
  {PCT} as guest_satisfaction_overall, bedrooms, beds, latitude, longitude, {ROOM},
  {MULTI} as multi, {MULTI} as biz, {NULLS}, final_city as city, lower(country) as country,
  case when isodow({DAY}) >= 6 then 'weekend' when isodow({DAY}) < 6 then 'weekday' end as day_type,
  cast(isodow({DAY}) >= 6 as int) as is_weekend, {AMEN}
 from kept
 where final_city is not null and lower(final_city) not in {UNWANTED}
  and lower(coalesce(country, '')) not in {UNWANTED})"""


_A_COLUMNS = [n for n in SOURCE_A_RULES if n not in (
    "cleanliness_rating", "lng", "lat", "room_shared", "room_private")]
_A_FLAGS = "cast(room_shared as int) as room_shared, cast(room_private as int) as room_private"
CLEAN_A = f"""clean_a as (
 select {', '.join(_A_COLUMNS)}, {_A_FLAGS}, cleanliness_rating * 0.5 as cleanliness_rating,
  lng as longitude, lat as latitude from source_a)"""
_B_ONLY = ["beds", *C.AMENITIES]
_ALL = [*_A_COLUMNS, "room_shared", "room_private", "cleanliness_rating", "longitude", "latitude", *_B_ONLY]
MERGED = f"""merged as (
 select {', '.join(c if c not in _B_ONLY else f'null as {c}' for c in _ALL)} from clean_a
 union all select {', '.join(_ALL)} from clean_b)"""


def b_query(select: str, tail: str = "", cte: str = "source_b") -> str:
    ctes = (SOURCE_B,) if cte == "source_b" else (SOURCE_B, LOCATED)
    return with_(*ctes, body=f"select {select} from {cte} {tail}")


_NULL_PROFILE = with_(SOURCE_B, body=" union all ".join(
    f"select '{c}' as column_name, '{t}' as data_type, count(*) as row_count,"
    f" count(*) - count({c}) as null_count from source_b"
    for c, t in {n: "double" if n in (
        "price", "accommodates", "host_listings_count", "review_scores_cleanliness", "bedrooms",
        "beds", "latitude", "longitude") else "string" for n in SOURCE_B_RULES}.items()))

# --- imputation -----------------------------------------------------------------
PASSES = {
    "amenities": (("realSum", "person_capacity", "bedrooms", "longitude", "latitude"),
                  C.AMENITIES, ("person_capacity", "bedrooms", *C.AMENITIES), 1000),
    "distances": (("realSum", "longitude", "latitude", "person_capacity"),
                  C.DISTANCE_MEASURES, ("person_capacity", *C.DISTANCE_MEASURES), None),
    "rooms": (("person_capacity", "realSum", "longitude", "latitude"),
              C.ROOM_COUNTS, ("person_capacity", *C.ROOM_COUNTS), 2000),
}


def knn(name: str) -> str:
    helpers, targets, missing, n = PASSES[name]
    cols = (*helpers, *targets)
    full = " and ".join(f"{t} is not null" for t in targets)
    holes = [c for c in cols if c in missing]
    donors = f"""donors as materialized (
 select row_number() over (order by md5(listing_id || '_42'), listing_id) as did,
  {', '.join(cols)} from gaps where {full}{'' if n is None else f' order by did limit {n}'})"""
    scaler = "scaler as materialized (select " + ", ".join(
        f"avg({c}) as {c}_m, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as {c}_s"
        for c in cols) + f" from gaps where {full})"
    def scaled(c: str, table: str) -> str:
        return f"({table}.{c} - s.{c}_m) / s.{c}_s as z_{c}"

    prepared = f"""todo as materialized (
 select listing_id, {', '.join(holes)}, {', '.join(scaled(c, 'g') for c in cols)}
 from gaps g, scaler s where not ({full})),
pool as materialized (
 select did, {', '.join(holes)}, {', '.join(scaled(c, 'd') for c in cols)} from donors d, scaler s)"""
    total = " + ".join(
        f"coalesce((t.z_{c} - p.z_{c}) * (t.z_{c} - p.z_{c}), 0)" for c in cols)
    present = " + ".join(f"cast(t.z_{c} - p.z_{c} is not null as int)" for c in cols)
    near = ", ".join(
        f"arg_min({{'d': d2, 'r': rank, 'v': {c}, 'did': did}}, {{'r': rank, 'did': did}}, 3)"
        f" filter ({c} is not null) as near_{c}" for c in holes)
    few = ""
    pairs = f"""pairs as (
 select t.listing_id, p.did, {', '.join('p.' + c for c in holes)},
  ({total}) * {len(cols)} / ({present}) as d2, round(d2, 9) as rank from todo t, pool p)"""
    if n is None:
        # All donors: no row is further off than the third of any 500 donors, so pairs beyond it need no sorting.
        some = "".join(f", coalesce(list_extract(min(rank, 3) filter ({c} is not null), 3), 'infinity'::double)" for c in holes)
        few = pairs.replace("pairs as", "tried as").replace("pool p)", "pool p where p.did <= 500)") + f""",
few as materialized (select listing_id, greatest(0{some}) as bound from tried group by listing_id),
"""
        pairs = pairs.replace("pairs as (", "pairs as (select * from (").replace("as rank from todo t, pool p)", """as rank, f.bound
 from todo t join few f using (listing_id), pool p) where rank <= bound)""")
    pairs = few + pairs + f""",
nearest as materialized (select listing_id, {near} from pairs group by listing_id)"""

    def value(c: str) -> str:
        near_c = f"near_{c}"
        exact = f"list_filter({near_c}, lambda x: x.r = 0)"
        weights = f"list_sum(list_transform({near_c}, lambda x: 1 / sqrt(x.d)))"
        return (f"case when len({exact}) > 0 then list_avg(list_transform({exact}, lambda x: x.v))"
                f" else list_sum(list_transform({near_c}, lambda x: x.v / sqrt(x.d))) / {weights} end")

    def out(c: str) -> str:
        if c not in holes:
            return f"g.{c}"
        raw = f"case when n.listing_id is null then g.{c} else coalesce(g.{c}, {value(c)}) end"
        filled = f"round({raw}, 9)"
        if c in C.AMENITIES:
            return f"cast({filled} >= 0.5 as int) as {c}"
        if c in C.ROOM_COUNTS and name == "rooms":
            return f"cast(round_even({filled}, 0) as int) as {c}"
        return f"{r6(raw)} as {c}"

    body = (f"select g.listing_id, {', '.join(out(c) for c in cols)}"
            " from gaps g left join nearest n using (listing_id)")
    return with_(gaps(cols, missing), donors, scaler, prepared, pairs, body=body)


def _scaler() -> str:
    cols = (*PASSES["rooms"][1], *PASSES["rooms"][0])
    full = "bedrooms is not null and beds is not null"
    parts = ", ".join(
        f"{r6(f'avg({c})')} as {c}_mean, {r6(f'stddev_pop({c})')} as {c}_scale" for c in cols)
    return with_(gaps(cols, PASSES["rooms"][2]), body=f"select {parts} from gaps where {full}")


def _split() -> str:
    cols = (*PASSES["rooms"][1], *PASSES["rooms"][0])
    return with_(gaps(cols, PASSES["rooms"][2]), body="""
select case when bedrooms is not null and beds is not null then 'complete' else 'missing' end
 as part, count(*) as n from gaps group by 1""")


def _donors() -> str:
    cols = (*PASSES["rooms"][1], *PASSES["rooms"][0])
    return with_(gaps(cols, PASSES["rooms"][2]), body="""
select listing_id, realSum from gaps where bedrooms is not null and beds is not null
order by md5(listing_id || '_42'), listing_id limit 2000""")


_STAGING = """cast(listing_id as varchar) as listing_id, realSum, room_type, room_shared, room_private, person_capacity, host_is_superhost, multi, biz,
 cleanliness_rating, guest_satisfaction_overall, bedrooms, dist, metro_dist, attr_index,
 attr_index_norm, rest_index, rest_index_norm, longitude, latitude, city, country, day_type,
 is_weekend, beds, wifi, kitchen, air_conditioning, parking, tv, heating"""
_KEY_COLUMNS = ", ".join((
    hash_id("city", "country", "latitude", "longitude") + " as location_id",
    hash_id("host_is_superhost") + " as host_id",
    hash_id("room_type", "room_shared", "room_private") + " as room_type_id",
    hash_id(*C.AMENITIES) + " as amenity_id",
    hash_id("day_type", "is_weekend", "biz", "multi") + " as day_id"))
_A_READ = ", ".join(
    f"cast({n} as varchar) as {n}" if n == "host_is_superhost" else
    f"cast({n} as int) as {n}" if n in ("room_shared", "room_private") else
    f"cast({n} as double) as {n}" if n in ("person_capacity", "bedrooms") else n
    for n in SOURCE_A_RULES)
_MISSING = texts(v for v in C.MISSING_TEXTS)
_B_READ = ", ".join(
    f"cast({n} as varchar) as {n}" if n == "price" else
    f"case when {n} not in {_MISSING} then {n} end as {n}"
    if n in ("amenities", "host_acceptance_rate", "room_type", "host_is_superhost",
             "host_location", "calendar_last_scraped") else n
    for n in SOURCE_B_RULES)

_INTS = {*C.AMENITIES, "room_shared", "room_private", "host_is_superhost", "multi", "biz", "is_weekend"}
_INTS_A = {"person_capacity", "bedrooms"}
_NAMES = ("room_type", "city", "country", "day_type")


def _filled(table: str) -> str:
    """One row per column: its type and the rows that fill it."""
    names = [*_A_COLUMNS, "room_shared", "room_private", "cleanliness_rating", "longitude", "latitude"]
    names += _B_ONLY if table == "clean_b" else []
    ints = _INTS | (_INTS_A if table == "clean_a" else set())
    return " union all ".join(
        f"select '{n}' as name, '{'int' if n in ints else 'string' if n in _NAMES else 'double'}' as kind,"
        f" count({n}) as filled from {table}" for n in names)


SQL = {
    "read_source_a": with_(SOURCE_A, body=f"select {_A_READ} from source_a"),
    "read_source_b": with_(SOURCE_B, body=f"select {_B_READ} from source_b").replace(
        "cast(price as varchar)", "price"),
    "load_staging": with_(LISTINGS, body=f"select {_STAGING}, {_KEY_COLUMNS} from listings"),
    "write_listings": with_(LISTINGS, body="select realSum, room_type, city, beds from listings"),
    "write_json": with_(LISTINGS, body="select listing_id, city, realSum from listings"),
    "write_by_city": with_(LISTINGS, body="select city, lower(city) as city_file, realSum from listings"),
    "write_table": with_(LISTINGS, body="select listing_id, city, realSum from listings"),
    "read_pages": "select page_id, url, html from pages",
    "rescale_rating": with_(SOURCE_A, body=(
        "select realSum, cleanliness_rating * 0.5 as cleanliness_rating from source_a")),
    "rename_columns": with_(SOURCE_A, body="select lat as latitude, lng as longitude from source_a"),
    "room_flags": b_query(f"room_type, {ROOM}"),
    "drop_null": b_query("*", "where host_is_superhost is not null"),
    "map_bool": b_query(f"host_is_superhost as raw, {MAP_BOOL} as host_is_superhost"),
    "flag_gt": b_query(f"host_listings_count, {MULTI} as multi"),
    "round_fill": b_query(f"review_scores_cleanliness, {CLEAN} as cleanliness_rating"),
    "parse_pct": b_query(f"host_acceptance_rate, {PCT} as guest_satisfaction_overall"),
    "add_nulls": b_query(f"price, {NULLS}"),
    "split_location": b_query("host_location, city, country", cte="located"),
    "filter_cities": b_query("city, country", f"where city in {texts(C.ALLOWED_CITIES)}", "located"),
    "resolve_city": b_query(
        f"host_location, {RESOLVED} as city,"
        f" case when {RESOLVED} is not null then lower(country) end as country", cte="located"),
    "exclude_tokens": b_query(
        "city, country", f"where lower(coalesce(city, '')) not in {UNWANTED}"
        f" and lower(coalesce(country, '')) not in {UNWANTED}", "located"),
    "day_features": b_query(
        f"calendar_last_scraped, case when isodow({DAY}) >= 6 then 'weekend' when isodow({DAY}) < 6 then"
        f" 'weekday' end as day_type, cast(isodow({DAY}) >= 6 as int) as is_weekend"),
    "amenity_flags": b_query(f"amenities, {AMEN}"),
    "coerce_numeric": b_query("host_acceptance_rate as raw, try_cast(host_acceptance_rate as double)"
                              " as host_acceptance_rate"),
    "cast_ints": b_query("price, cast(bedrooms as int) as bedrooms, cast(beds as int) as beds"),
    "clean_source_a": with_(SOURCE_A, CLEAN_A, body="select * from clean_a"),
    "clean_source_b": with_(SOURCE_B, LOCATED, clean_b(True), body="select * from clean_b"),
    "clean_source_b_fallback": with_(
        SOURCE_B, LOCATED, clean_b(False), body="select * from clean_b"),
    "union_sources": with_(
        SOURCE_A, CLEAN_A, SOURCE_B, LOCATED, clean_b(True), MERGED, body="select * from merged"),
    "null_profile": _NULL_PROFILE,
    "schema_diff": with_(
        SOURCE_A, CLEAN_A, SOURCE_B, LOCATED, clean_b(True), body=f"""
select coalesce(a.name, b.name) as column_name,
 case when b.name is null then 'only_a' when a.name is null then 'only_b' else 'both' end as side,
 a.kind as type_a, b.kind as type_b, a.filled as filled_a, b.filled as filled_b
from ({_filled('clean_a')}) a full join ({_filled('clean_b')}) b using (name)"""),
    "split_complete": _split(),
    "fit_scaler": _scaler(),
    "donor_sample": _donors(),
    "impute_amenities": knn("amenities"),
    "impute_distances": knn("distances"),
    "impute_rooms": knn("rooms"),
}
