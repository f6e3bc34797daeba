"""Rental data derived from the generic test tables (orders, lineitem, ...).

Column rules are SQL texts valid in Spark and in DuckDB, so the correctness check can
build exactly the same input. ``{weekday}`` and ``{id}`` are the two dialect slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions.scalars import hash_id

_LISTING_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_cents")

# column -> (SQL rule, tables it needs besides lineitem)
LISTING_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "listing_id": ("{id}", ()),
    "city": ("n_name", ("nation",)),
    "country": ("r_name", ("region",)),
    "latitude": (
        "cast(40 as double) + s_nationkey * cast(0.5 as double)"
        " + (o_custkey % 3) * cast(0.02 as double)", ("supplier", "orders")),
    "longitude": (
        "cast(-3 as double) + s_nationkey * cast(0.5 as double)"
        " + (o_custkey % 2) * cast(0.02 as double)", ("supplier", "orders")),
    "room_type": ("p_type", ("part",)),
    "room_shared": ("case when l_returnflag = 'R' then 1 else 0 end", ()),
    "room_private": ("case when l_returnflag = 'A' then 1 else 0 end", ()),
    "host_is_superhost": ("case when c_acctbal >= 5000 then 1 else 0 end", ("customer",)),
    "day_type": ("case when {weekday} then 'weekend' else 'weekday' end", ("orders",)),
    "is_weekend": ("case when {weekday} then 1 else 0 end", ("orders",)),
    "biz": ("case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end", ("orders",)),
    "multi": ("case when o_orderstatus = 'F' then 1 else 0 end", ("orders",)),
    "wifi": ("case when l_discount >= 0.05 then 1 else 0 end", ()),
    "kitchen": ("case when l_tax >= 0.04 then 1 else 0 end", ()),
    "air_conditioning": ("case when l_linestatus = 'O' then 1 else 0 end", ()),
    "parking": ("case when p_size % 2 = 0 then 1 else 0 end", ("part",)),
    "tv": ("case when l_linenumber % 2 = 1 then 1 else 0 end", ()),
    "heating": ("case when p_size >= 25 then 1 else 0 end", ("part",)),
    "realSum": ("l_extendedprice", ()),
    "person_capacity": ("cast(1 + l_linenumber % 6 as int)", ()),
    "bedrooms": ("cast(1 + p_size % 4 as int)", ("part",)),
    "beds": ("cast(1 + p_size % 5 as int)", ("part",)),
    "cleanliness_rating": ("l_quantity / cast(10 as double)", ()),
    "guest_satisfaction_overall": (
        "cast(100 as double) - cast(300 as double) * l_discount", ()),
    "dist": ("l_tax * cast(100 as double)", ()),
    "metro_dist": ("cast(p_size as double) / cast(20 as double)", ("part",)),
    "attr_index": ("cast(p_size % 11 as double) * cast(12.5 as double)", ("part",)),
    "attr_index_norm": ("cast(p_size % 11 as double) / cast(2 as double)", ("part",)),
    "rest_index": ("cast(l_partkey % 13 as double) * cast(12.5 as double)", ()),
    "rest_index_norm": ("cast(l_partkey % 13 as double) / cast(2 as double)", ()),
}
SPARK_WEEKEND = "weekday(o_orderdate) >= 5"
ORDERS_TO_SHUFFLE = 500_000  # more orders than this are no broadcast side


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One generic table.

    ``spread`` deals the rows of a table that is read by fewer tasks than there are cores out
    to all cores, for steps that cost far more than the read. Larger tables are read in
    parallel as they are and never dealt out.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def joined(spark: SparkSession, sf_dir: str, needed: set[str], spread: bool = False) -> DataFrame:
    """lineitem with only those lookup tables whose columns are asked for.

    Every foreign key has its row (checked by the tests), so a join left out changes
    no row. Sides are not hinted: file sizes decide between broadcast and shuffle. Orders too
    many to be broadcast get their customers first, so that lineitem is not shuffled once
    more on a column of theirs.
    """
    needed = set(needed)
    if "region" in needed:
        needed.add("nation")
    if "nation" in needed:
        needed.add("supplier")
    if "customer" in needed:
        needed.add("orders")
    df = table(spark, sf_dir, "lineitem", spread).withColumn(
        "l_cents", F.round(F.col("l_extendedprice") * 100).cast("long")
    )
    sides = {name: table(spark, sf_dir, name) for name in needed}
    if "customer" in needed and sides["orders"].count() > ORDERS_TO_SHUFFLE:
        sides["orders"] = sides["orders"].join(sides["customer"], F.expr("o_custkey = c_custkey"))
        needed.remove("customer")
    for name, on in (
        ("orders", "l_orderkey = o_orderkey"),
        ("part", "l_partkey = p_partkey"),
        ("supplier", "l_suppkey = s_suppkey"),
        ("nation", "s_nationkey = n_nationkey"),
        ("region", "n_regionkey = r_regionkey"),
        ("customer", "o_custkey = c_custkey"),
    ):
        if name in needed:
            df = df.join(sides[name], F.expr(on))
    return df


def listings(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, spread: bool = False
) -> DataFrame:
    """The flat listing table, one row per lineitem."""
    names = list(columns or LISTING_RULES)
    needed = {t for n in names for t in LISTING_RULES[n][1]}
    df = joined(spark, sf_dir, needed, spread)

    def rule(name: str):
        if name == "listing_id":
            return hash_id(*_LISTING_KEY, hex_digits=15).alias(name)
        return F.expr(LISTING_RULES[name][0].replace("{weekday}", SPARK_WEEKEND)).alias(name)

    return df.select([rule(n) for n in names])


# --- listings with gaps (imputation input) ------------------------------------
# column -> condition under which the value is missing
GAP_RULES: dict[str, str] = {
    **{a: f"(l_orderkey + {i}) % 17 = 0" for i, a in enumerate(C.AMENITIES)},
    **{m: "l_suppkey % 4 = 0" for m in C.DISTANCE_MEASURES},
    "bedrooms": "l_partkey % 7 = 0",
    "beds": "l_partkey % 5 = 0",
    "person_capacity": "l_orderkey % 31 = 0",
}


def gap_rule(name: str, gaps: Sequence[str]) -> str:
    rule = LISTING_RULES[name][0]
    if name not in gaps:
        return rule
    return f"case when not ({GAP_RULES[name]}) then {rule} end"


def listings_with_gaps(
    spark: SparkSession, sf_dir: str, columns: Sequence[str], gaps: Sequence[str],
    spread: bool = False,
) -> DataFrame:
    """Listings where the columns in ``gaps`` miss some values."""
    needed = {t for n in columns for t in LISTING_RULES[n][1]}
    df = joined(spark, sf_dir, needed, spread)
    cols = [hash_id(*_LISTING_KEY, hex_digits=15).alias("listing_id")]
    cols += [
        F.expr(gap_rule(n, gaps).replace("{weekday}", SPARK_WEEKEND)).alias(n)
        for n in columns if n != "listing_id"
    ]
    return df.select(cols)


# --- the two raw listing sources ----------------------------------------------
SOURCE_A_RULES: dict[str, str] = {
    **{n: LISTING_RULES[n][0] for n in (
        "realSum", "room_type", "person_capacity", "multi", "biz",
        "guest_satisfaction_overall", "dist", "metro_dist", "attr_index", "attr_index_norm",
        "rest_index", "rest_index_norm", "country", "day_type", "is_weekend")},
    "room_shared": "l_returnflag = 'R'",
    "room_private": "l_returnflag = 'A'",
    "host_is_superhost": LISTING_RULES["host_is_superhost"][0],
    "cleanliness_rating": "l_quantity / cast(5 as double)",
    "bedrooms": "case when l_partkey % 11 <> 0 then cast(1 + p_size % 4 as int) end",
    "lng": LISTING_RULES["longitude"][0],
    "lat": LISTING_RULES["latitude"][0],
    "city": "lower(n_name)",
}


def source_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = joined(spark, sf_dir, {"region", "orders", "part", "customer"})
    return df.select([
        F.expr(r.replace("{weekday}", SPARK_WEEKEND)).alias(n) for n, r in SOURCE_A_RULES.items()
    ])


def _pick(key: str, values: Sequence[str | None]) -> str:
    """A CASE that picks a text by ``key`` modulo the number of texts."""
    cases = " ".join(
        f"when {i} then '{v}'" for i, v in enumerate(values) if v is not None
    )
    return f"case {key} % {len(values)} {cases} end"


SOURCE_B_RULES: dict[str, str] = {
    "price": "o_totalprice / cast(1000 as double)",
    "room_type": _pick("o_orderkey", (
        "Entire home/apt", "Private room", "Shared room", "Hotel room", None)),
    "accommodates": "cast(1 + o_orderkey % 6 as double)",
    "host_is_superhost": _pick("o_orderkey", ("t", "f", "True", "False", "x", None, "t")),
    "host_listings_count":
        "case when o_custkey % 9 <> 0 then cast(o_custkey % 4 as double) end",
    "review_scores_cleanliness":
        "case when o_orderkey % 13 <> 0 then cast(o_orderkey % 101 as double) / cast(20 as double) end",
    "host_acceptance_rate": _pick("o_custkey", ("97%", "100%", None, "N/A", "81%", "0%", "55%")),
    "host_location": _pick("o_orderkey", (
        "Paris, France", "Athens, GA", "Rome, NY", "Paris", "Lyon, France", ", Spain",
        " LONDON , United Kingdom", None, "Berlin, Germany", "Amsterdam, Netherlands",
        "Vienna, Austria, Europe", "Lisbon, Portugal", "Budapest, Hungary", "Toronto, Canada",
        "Barcelona, Spain", "Athens, Greece", "Rome, Italy")),
    "calendar_last_scraped":
        "case when o_orderkey % 19 = 1 then concat(cast(year(o_orderdate) as {text}), '-',"
        " lpad(cast(month(o_orderdate) as {text}), 2, '0'), '-',"
        " lpad(cast(day(o_orderdate) as {text}), 2, '0'), case when o_orderkey % 2 = 0 then ' ' else 'T' end, '10:30:00')"
        " when o_orderkey % 19 = 2 then concat(cast(year(o_orderdate) as {text}),"
        " lpad(cast(month(o_orderdate) as {text}), 2, '0'), lpad(cast(day(o_orderdate) as {text}), 2, '0'))"
        " when o_orderkey % 19 = 3 then concat('January ', cast(day(o_orderdate) as {text}), ', 2024')"
        " when o_orderkey % 19 = 4 then 'some day'"
        " when o_orderkey % 3 = 0"
        " then concat(cast(month(o_orderdate) as {text}), '/', cast(day(o_orderdate) as {text}),"
        " '/', cast(year(o_orderdate) as {text}))"
        " else concat(cast(year(o_orderdate) as {text}), '-',"
        " lpad(cast(month(o_orderdate) as {text}), 2, '0'), '-',"
        " lpad(cast(day(o_orderdate) as {text}), 2, '0')) end",
    "amenities": _pick("o_custkey", (
        '["Wifi", "Air conditioning", "HDTV"]', '["Kitchen", "Free parking", "Heating"]', "",
        None, '["WIFI", "TV with ""cable"" box", "Central heating"]', '["Parking garage"]')),
    "bedrooms": "case when o_orderkey % 6 <> 0 then cast(1 + o_custkey % 3 as double) end",
    "beds": "case when o_orderkey % 10 <> 0 then cast(1 + o_custkey % 5 as double) end",
    "latitude": "cast(41 as double) + (o_orderkey % 997) / cast(100 as double)",
    "longitude": "cast(-3 as double) + (o_custkey % 701) / cast(50 as double)",
}


def source_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select([
        F.expr(r.replace("{text}", "string")).alias(n) for n, r in SOURCE_B_RULES.items()
    ])


# --- listing pages ------------------------------------------------------------
_T = "cast({} as {{text}})"
_CITY = _pick("o_custkey", ("Paris", "Rome", "New York", "Berlin", "Lisbon"))
_LAND = _pick("o_custkey", ("France", "Italy", "United States", "Germany", "Portugal"))
_ROOM = _pick("o_orderkey", ("Entire home", "Private room", "Shared room", "Hotel room", "Loft"))
_PRICE = _T.format("cast(floor(o_totalprice / 100) as bigint)")
_BEDS, _ROOMS = _T.format("1 + o_orderkey % 5"), _T.format("1 + o_orderkey % 4")
_GUESTS, _BATHS = _T.format("1 + o_custkey % 6"), _T.format("1 + o_custkey % 3")
_KEY = _T.format("o_orderkey")
_LAT = "concat('41.', lpad(" + _T.format("o_orderkey % 97") + ", 2, '0'))"
_LNG = "concat('-2.', lpad(" + _T.format("o_custkey % 71") + ", 2, '0'))"


def _join(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


_TITLE = (
    "case o_orderkey % 9 when 3 then 'Oops' when 7 then 'Page not found' else "
    + _join(_ROOM, "' in centre - '", _CITY, "', '", _LAND, "' - Stays'") + " end"
)
_JSON = (
    "case o_orderkey % 9"
    " when 0 then " + _join(
        "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\": {\"bed_count\": '", _BEDS,
        "', \"listing\": {\"room_type_category\": \"'", _ROOM, "'\", \"bedroom-count\": '", _ROOMS,
        "', \"lat\": '", _LAT, "', \"lng\": '", _LNG, "'}}}</script>'")
    + " when 1 then " + _join(
        "'<script type=\"application/ld+json\">[{\"name\": \"'", _ROOM, "' for you\", \"beds\": '", _BEDS,
        "', \"geo\": {\"latitude\": '", _LAT, "', \"longitude\": '", _LNG, "'}}]</script>'")
    + " when 4 then " + _join(
        "'<script>var a = {\"lat\": 0.0, \"lng\": 0.0, \"latitude\": '", _LAT, "', \"longitude\": '", _LNG,
        "'};</script>'")
    + " when 5 then " + _join(
        "'<script type=\"application/json\">{\"beds\": 0, \"priceString\": \"$'", _PRICE,
        "'\"}</script><script type=\"application/json\">{\"beds\": </script>'")
    + " else '' end"
)
_PRICE_LINE = (
    "case o_orderkey % 9"
    " when 0 then " + _join("'<span class=\"main price\">$'", _PRICE, "'</span>'")
    + " when 2 then " + _join("'<p>&euro;'", _PRICE, "' night</p>'")
    + " when 5 then '' when 6 then '<p>$3 per night</p>' when 8 then '<p>from $60,000 today</p>'"
    " else " + _join("'<p>$'", _PRICE, "' per night</p>'") + " end"
)
_RATING_LINE = (
    "case o_orderkey % 4"
    " when 0 then '<span aria-label=\"4.87 rating of 5\">good</span>'"
    " when 1 then '<p>rated 9.1 by some, rating: 4.5</p>'"
    " when 2 then '<p>★ 4.25 and cleanliness: 4.9</p>' else '' end"
)
_WORDS = _pick("o_custkey", (
    "A nice place near the market", "Superhost, wifi and a desk for work",
    "Several rooms, kitchen, A/C and garage", "TV, heating, internet", "Quiet flat"))
PAGE_RULES: dict[str, str] = {
    "page_id": "o_orderkey",
    "url": "case when o_orderkey % 11 = 0 then "
           + _join("'https://stay.example.com/s/'", f"replace({_CITY}, ' ', '-')", "'/homes?x='", _KEY)
           + " else " + _join("'https://stay.example.com/rooms/'", _KEY, "'?x=1'") + " end",
    "html": _join(
        "'<html><head><title>'", _TITLE, "'</title></head><body><h1>'", _TITLE, "'</h1><h2>'",
        "case when o_orderkey % 2 = 0 then 'About' else 'Room in a shared home' end", "'</h2>'",
        _JSON, "'<p>'", _WORDS, "'</p><p>'", _GUESTS, "' guests · '", _ROOMS, "' bedrooms · '", _BEDS,
        "' beds · '", _BATHS, "' baths</p>'", _PRICE_LINE, _RATING_LINE, "'<p>1,2'", _BATHS,
        "'4 reviews</p>'", "'<a href=\"/rooms/'", _KEY, "'?from=list\">this</a><a href=\"/rooms/'",
        _T.format("o_orderkey + 1"), "'\">next</a><a href=\"/help\">help</a></body></html>'"),
}


# Parsing a page costs far more than reading its order: a few splits of a file hold too many.
PAGES_PER_TASK = 50_000


def listing_pages(
    spark: SparkSession, sf_dir: str, spread: bool = False, per_task: int = PAGES_PER_TASK
) -> DataFrame:
    """One raw listing page per order; the page kinds cover every extraction rule.

    ``spread`` deals the orders out to as many tasks as their number asks for, and to all
    cores at least.
    """
    orders = table(spark, sf_dir, "orders")
    if spread:
        tasks = max(spark.sparkContext.defaultParallelism, -(-orders.count() // per_task))
        if orders.rdd.getNumPartitions() < tasks:
            orders = orders.repartition(tasks)
    key, *fields = [F.expr(r.replace("{text}", "string")).alias(n) for n, r in PAGE_RULES.items()]
    # A generator keeps the page text a stored value: filters on it do not rebuild it.
    return orders.select(key, F.inline(F.array(F.struct(*fields))))
