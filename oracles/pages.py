"""DuckDB SQL for page extraction."""

from oracles.inputs import LISTING_PAGES, hash_id, with_
from rentalytics import constants as C
from rentalytics.constants import CITY_FILE_COLUMNS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {quote(pattern)}, 1), '')"


def plain(html: str) -> str:
    out = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for entity, char in C.ENTITIES.items():
        out = f"replace({out}, {quote(entity)}, {quote(char)})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_HIDDEN = (r"(?is)<head(?:\s[^>]*)?>.*?</head>|<script[^>]*>.*?</script>"
           r"|<style[^>]*>.*?</style>|<!--.*?-->")


def tag(name: str) -> str:
    return plain(f"regexp_extract(html, '(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>', 1)")


def parsed(source: str) -> str:
    h2 = "regexp_extract_all(html, '(?is)<h2(?:\\s[^>]*)?>(.*?)</h2>', 1)"
    hidden = f"regexp_replace(html, {quote(_HIDDEN)}, ' ', 'g')"
    return f"""parsed as materialized (
 select page_id, url, html, {tag('title')} as title, {tag('h1')} as h1,
  list_transform({h2}, lambda x: {plain('x')}) as h2, {plain(hidden)} as page_text,
  array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), ' ') as scripts
 from {source}),
good as materialized (
 select *, lower(page_text) as text from parsed where not (contains(lower(title), 'oops')
  or contains(lower(title), 'not found') or contains(lower(h1), 'oops')))"""


def whole(text: str) -> str:
    return f"try_cast(replace({text}, ',', '') as int)"


def number(text: str) -> str:
    return f"try_cast({text} as double)"


def has_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def strict_any(text: str, words) -> str:
    return "(" + " or ".join(
        f"regexp_matches({text}, {quote('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'd])' + w + '($|[^' + chr(92) + 'p{L}' + chr(92) + 'd])')})"
        for w in words) + ")"


BEDS = r"(\d+)\s*bed(?:[^r]|r[^o]|ro[^o]|roo[^m]|r?o?o?$)"
COUNTS = (f"{whole(found('text', C.GUESTS_PATTERN))} as person_capacity,"
          f" {whole(found('text', C.BEDROOMS_PATTERN))} as bedrooms,"
          f" {whole(found('text', BEDS))} as beds,"
          f" {whole(found('text', C.BATHS_PATTERN))} as bathrooms")
PRICE_TEXT = (f"coalesce({whole(found('text', C.NIGHT_PRICE_PATTERN))},"
              f" {whole(found('text', C.ANY_PRICE_PATTERN))})")
REVIEWS = whole(found("text", C.REVIEWS_PATTERN))
_LABEL = number(found(found("html", C.RATING_LABEL_PATTERN), r"([\d.]+)"))
RATING = "coalesce(" + ", ".join(
    f"case when {v} > 0 and {v} <= 5 then {v} end"
    for v in [_LABEL, *[number(found("text", p)) for p in C.RATING_PATTERNS]]) + ")"
_CLEAN = number(found("text", C.CLEANLINESS_PATTERN))
CLEAN = f"case when {_CLEAN} <= 5 then {_CLEAN} end"


def flags(test) -> str:
    return (f"{test('text', ['superhost'])} as host_is_superhost,"
            f" {test('text', C.MULTI_WORDS)} as multi, {test('text', C.BIZ_WORDS)} as biz, "
            + ", ".join(f"{test('text', w)} as {a}" for a, w in C.AMENITY_WORDS.items()))


ROOM_TEXT = "case " + " ".join(
    f"when contains(lower(h1), '{p}') or contains(text, '{p}') then '{p.title()}'"
    for p in C.ROOM_PHRASES) + " end"
CITY_URL = found("url", "/s/([^/]+)/homes")
# Title words: last usable part first.
_WORDS = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"


def city_title(site: str) -> str:
    return f"""list_filter(list_transform(list_filter(list_reverse(string_split(title, ' - ')),
 lambda p: not contains(lower(p), '{site}') and length(p) > 2),
 lambda p: regexp_extract(p, '{_WORDS}', 1)), lambda w: w <> '')[1]"""


CITY = (f"case when {CITY_URL} is not null then case when {CITY_URL} = 'New-York' then 'New York'"
        f" else {CITY_URL} end else {city_title('stays')} end")
_JSON_BEDS = whole(found("html", r'"(?:bed_count|beds)": (\d+)'))
_JSON_BEDROOMS = whole(found("html", r'"bedroom-count": (\d+)'))


def first_count(json: str, patterns) -> str:
    return "coalesce(" + ", ".join(
        [f"nullif({json}, 0)"] + [f"nullif({whole(found('text', p))}, 0)" for p in patterns]) + ")"


BEDS_FULL = first_count(_JSON_BEDS, C.BED_LINE_PATTERNS)
BEDROOMS_FULL = first_count(_JSON_BEDROOMS, C.BEDROOM_LINE_PATTERNS)


def coordinate(which: int) -> str:
    def value(text: str, key: str) -> str:
        return number(found(text, f'"{key}"{C.COORDINATE_NUMBER}'))

    options = []
    for text, (lat, lng) in (("scripts", C.COORDINATE_KEYS[0]), ("scripts", C.COORDINATE_KEYS[1]),
                             ("html", C.COORDINATE_KEYS[0])):
        a, b = value(text, lat), value(text, lng)
        options.append(f"case when abs({a}) > 0.1 and abs({b}) > 0.1 then {(a, b)[which]} end")
    return "coalesce(" + ", ".join(options) + ")"


def in_range(v: str) -> str:
    return f"case when {v} > 5 and {v} < 50000 then {v} end"


_SHOWN = whole(found(found("html", r'(?is)<span[^>]*class="[^"]*price[^"]*"[^>]*>(.*?)</span>'), r"([\d,]+)"))
_STATED = whole(found(found("scripts", C.PRICE_STRING_PATTERN), r"([\d,]+)"))
PRICE_FULL = "coalesce(" + ", ".join(
    [in_range(_SHOWN), _STATED]
    + [in_range(whole(found("text", p))) for p in C.TEXT_PRICE_PATTERNS]) + ")"


def phrased(t: str, entire, private=("private room",), shared="shared room") -> str:
    return (f"case when {has_any(t, entire)} then 'Entire home/apt'"
            f" when {has_any(t, private)} then 'Private room'"
            f" when contains({t}, '{shared}') then 'Shared room'"
            f" when contains({t}, 'hotel room') then 'Hotel room' end")


_CATEGORY = found("html", r'"room_type_category": "([^"]+)"')
_NAME = f"lower({found('html', chr(34) + 'name' + chr(34) + ': ' + chr(34) + '([^' + chr(34) + ']+)' + chr(34))})"
_NAMED = f"case when {_CATEGORY} = 'Entire home' then 'Entire home/apt' else {_CATEGORY} end"
_HTML_TOP = "lower(html)"
ROOM_FULL = ("coalesce(" + ", ".join([
    _NAMED, phrased(_NAME, ("entire place", "entire home", "entire apartment")),
    "case when contains(lower(h2[1]), 'room in') then 'Private room' end",
    f"case when contains({_HTML_TOP}, 'room in') then 'Private room' else "
    + phrased(_HTML_TOP, ("entire home", "entire apartment", "entire place"),
              ("private room in",), "shared room in") + " end",
    phrased("text", ("entire home", "entire apartment"))]) + ")")
LISTING_KEY = f"coalesce({found('url', '/rooms/([0-9]+)')}, 'scraped_' || cast({hash_id('url')} as varchar))"


def links(path: str) -> str:
    return f"""links as (
 select page_id, unnest(hrefs) as href, generate_subscripts(hrefs, 1) as i,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) as site
 from (select page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]+)"', 1) as hrefs from src)),
clean as (
 select page_id, split_part(case when starts_with(href, '/') then site || href else href end, '?', 1) as url, min(i) as i
 from links where contains(href, '{path}') group by 1, 2),
placed as (
 select page_id, url, cast(row_number() over (partition by page_id order by i) - 1 as int) as position from clean)"""


_FIRST = """select url, min(page_id) as page_id, arg_min(position, page_id) as position
from placed group by url"""
LP = LISTING_PAGES
_SRC_PAGES, _SRC_LP = "src as (select * from pages)", "src as (select * from listing_pages)"


def pages(body: str) -> str:
    return with_(parsed("pages"), body=body)


def lp(body: str) -> str:
    return with_(LP, parsed("listing_pages"), body=body)


_RECORDS = f"""records as (
 select page_id, {LISTING_KEY} as listing_key, {REVIEWS} as review_count,
  {whole(found('text', C.BATHS_PATTERN))} as bathrooms, url, {PRICE_FULL} as realSum,
  {ROOM_FULL} as room_type, {whole(found('text', C.GUESTS_PATTERN))} as person_capacity,
  {CLEAN} as cleanliness_rating, {RATING} as guest_satisfaction_overall,
  {BEDROOMS_FULL} as bedrooms, {CITY} as city, {coordinate(1)} as lng, {coordinate(0)} as lat,
  {BEDS_FULL} as beds, {flags(has_any)} from good)"""
_SELECT = ", ".join(
    {"room_shared": "coalesce(contains(lower(room_type), 'shared room'), false) as room_shared",
     "room_private": "coalesce(contains(lower(room_type), 'private room'), false) as room_private",
     }.get(c, c) for c in CITY_FILE_COLUMNS)
RECORDS = with_(LP, parsed("listing_pages"), _RECORDS, body=f"""
select page_id, listing_key, review_count, bathrooms, {_SELECT} from records
where beds is not null or room_type is not null""")

SQL = {
    "listing_urls": with_(LP, _SRC_LP, links("/rooms/"), body=_FIRST),
    "listing_urls_pages": with_(_SRC_PAGES, links("/"), body=_FIRST),
    "with_currency": """select url, case when contains(url, 'currency=') then url
 when contains(url, '?') then url || '&currency=USD' else url || '?currency=USD' end as priced_url from pages""",
    "page_listing_id": with_(LP, body=f"""
select url, {LISTING_KEY} as listing_key from listing_pages
union all select url, {LISTING_KEY} from pages"""),
    "drop_error_pages": lp("select page_id, title from good"),
    "page_text": pages("select page_id, title, h1, page_text, scripts from parsed"),
    "page_city": lp(f"select page_id, {CITY} as city from good"),
    "page_city_pages": pages(
        f"select page_id, {city_title('stays')} as city from parsed"),
    "room_type_text": lp(f"select page_id, {ROOM_TEXT} as room_type from good"),
    "room_type_full": lp(f"select page_id, {ROOM_FULL} as room_type from good"),
    "page_json": with_(LP, body=f"""
select page_id, cast(len(list_filter(list_concat(
  regexp_extract_all(html, {quote(r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>')}, 1),
  regexp_extract_all(html, {quote(r'(?s)<script[^>]*type="application/ld[+]json"[^>]*>(.*?)</script>')}, 1),
  list_filter(regexp_extract_all(html, {quote(r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>')}, 1),
   lambda x: starts_with(trim(x), '{{') and ends_with(trim(x), '}}'))), lambda x: json_valid(x))) as int) as n_json
from listing_pages"""),
    "deep_find": lp(f"""
select page_id, {_JSON_BEDS} as beds, {_JSON_BEDROOMS} as bedrooms, {_CATEGORY} as room_type,
 {found('html', chr(34) + 'name' + chr(34) + ': ' + chr(34) + '([^' + chr(34) + ']+)' + chr(34))} as name
from parsed where regexp_matches(html, {quote('(?s)<script[^>]*(id="__NEXT_DATA__"|type="application/(ld[+])?json")')})"""),
    "room_counts": lp(f"select page_id, {COUNTS} from good"),
    "beds_bedrooms": lp(f"select page_id, {BEDS_FULL} as beds, {BEDROOMS_FULL} as bedrooms from good"),
    "page_coordinates": lp(f"select page_id, {coordinate(0)} as lat, {coordinate(1)} as lng from good"),
    "price_text": lp(f"select page_id, {PRICE_TEXT} as price from good"),
    "price_full": lp(f"select page_id, {PRICE_FULL} as price from good"),
    "review_count": lp(f"select page_id, {REVIEWS} as review_count from good"),
    "page_ratings": lp(f"""
select page_id, {RATING} as guest_satisfaction_overall, {CLEAN} as cleanliness_rating from good"""),
    "page_flags": lp(f"select page_id, {flags(has_any)} from good"),
    "page_flags_pages": pages(f"select page_id, {flags(has_any)} from good"),
    "page_flags_strict": pages(f"select page_id, {flags(strict_any)} from good"),
    "weekend_stay": """
select o_orderkey, cast(d + cast((4 - (isodow(d) - 1) + 6) % 7 + 1 as int) as date) as checkin,
 cast(d + cast((4 - (isodow(d) - 1) + 6) % 7 + 3 as int) as date) as checkout,
 o_totalprice / cast(2 as double) as price_per_night
from (select *, cast(o_orderdate as date) as d from orders)""",
    "extract_listings": RECORDS,
}
_PRICED = found("html", r'(?is)<span[^>]*class="[^"]*price[^"]*"[^>]*>\$(\d+)</span>')
SQL["search_prices"] = with_(LP, _SRC_LP, links("/rooms/"), body=f"""
select page_id, placed.url,
 case when position = 0 and {whole(_PRICED)} > 5 and {whole(_PRICED)} < 50000 then {whole(_PRICED)} end as search_price
from placed join listing_pages using (page_id)""")

_SHOWN_PRICE = (f"case when position = 0 and {whole(_PRICED)} > 5 and {whole(_PRICED)} < 50000"
                f" then {whole(_PRICED)} end")
SQL["extract_listings_search"] = with_(
    LP, _SRC_LP, links("/rooms/"), parsed("listing_pages"), _RECORDS, f"""first_price as (
 select url as address, arg_min(price, (page_id, position)) as shown from (
  select page_id, position, placed.url, {_SHOWN_PRICE} as price
  from placed join listing_pages using (page_id)) where price is not null group by 1)""", body=f"""
select page_id, listing_key, review_count, bathrooms,
 {_SELECT.replace("realSum", "coalesce(realSum, shown) as realSum", 1)}
from records left join first_price on split_part(url, '?', 1) = address
where beds is not null or room_type is not null""")
SQL["ingest_city_files"] = with_(LP, parsed("listing_pages"), _RECORDS, f"""kept as (
 select {_SELECT} from records where beds is not null or room_type is not null)""", body=f"""
select * from kept qualify row_number() over (partition by url order by
 realSum nulls first, room_type nulls first) = 1""")
