"""Listing records from raw pages (page_id, url, html). Every step is narrow and reads whole pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions import html as H
from rentalytics.functions.scalars import hash_id

LOOKUPS = {
    "beds": (C.BED_KEYS, "int"),
    "bedrooms": (C.BEDROOM_KEYS, "int"),
    "room_type": (C.ROOM_TYPE_KEYS, "string"),
    **{k: ((k,), "string") for k in C.TEXT_KEYS},
}


# --- links ----------------------------------------------------------------------
def page_links(path: str = "/rooms/") -> Column:
    """Canonical links of one page in order, each once: site added, query cut. Any style of quotes."""
    raw = H.all_found("html", r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)""")
    links = F.transform(raw, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))
    site = H.site_of("url")
    full = F.transform(
        F.filter(links, lambda x: x.contains(path)),
        lambda x: F.substring_index(
            F.when(x.startswith("/"), F.concat(site, x)).otherwise(x), "?", 1),
    )
    return F.array_distinct(full)


def listing_urls(pages: DataFrame, path: str = "/rooms/") -> DataFrame:
    """(url, page_id, position): every link once, where it was seen first."""
    links = pages.select("page_id", F.posexplode(page_links(path)).alias("position", "url"))
    first = links.groupBy("url").agg(F.min(F.struct("page_id", "position")).alias("first"))
    return first.select("url", "first.page_id", "first.position")


def search_prices(pages: DataFrame, path: str = "/rooms/") -> DataFrame:
    """(page_id, position, url, search_price): the i-th link of a search page takes its i-th price."""
    links = page_links(path)
    texts = F.zip_with(
        H.all_found("html", C.SEARCH_PRICE_ELEMENT, 1), H.all_found("html", C.SEARCH_PRICE_ELEMENT, 2),
        lambda a, b: H.plain(F.concat(a, b)))
    low, high = C.PRICE_RANGE
    values = F.transform(texts, lambda x: H.whole(H.capture(x, r"\$(\d+)")))
    prices = F.filter(values, lambda x: (x > low) & (x < high))
    pairs = F.transform(links, lambda x, i: F.struct(
        i.alias("position"), x.alias("url"), F.get(prices, i).alias("search_price")))
    return pages.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.*")


def price_per_url(prices: DataFrame) -> DataFrame:
    """(url, search_price), one row per address: the first price shown for it, by page and place on it.

    Prices from elsewhere, without page and place, give the lowest.
    """
    shown = prices.filter(F.col("search_price").isNotNull())
    order = [c for c in ("page_id", "position", "search_price") if c in prices.columns]
    return shown.groupBy("url").agg(F.min_by("search_price", F.struct(*order)).alias("search_price"))


def page_listing_id(url: str | Column = "url") -> Column:
    """Number in the address; other addresses get a hash."""
    return F.coalesce(
        H.found(url, r"/rooms/(\d+)"), F.concat(F.lit("scraped_"), hash_id(url).cast("string"))
    )


# --- page parts -----------------------------------------------------------------
def page_text(pages: DataFrame) -> DataFrame:
    """Adds title, h1, h2 (array), page_text, its lower-case form text, and scripts."""
    return pages.withColumns({
        "title": H.element("html", "title"),
        "h1": H.element("html", "h1"),
        "h2": H.elements("html", "h2"),
        "page_text": H.visible_text("html"),
        "scripts": H.script_text("html"),
    }).withColumn("text", F.lower("page_text"))


def drop_error_pages(pages: DataFrame) -> DataFrame:
    """Without pages whose title or first heading reports an error.

    Looks at the raw page, so that it runs before any page is parsed.
    """
    title, h1 = [
        F.lower(H.capture("html", rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")) for tag in ("title", "h1")
    ]
    return pages.filter(
        ~H.once(title, lambda t: t.contains("oops") | t.contains("not found"))
        & ~h1.contains("oops"))


# --- fields ---------------------------------------------------------------------
def city_from_url(url: str | Column = "url") -> Column:
    return H.readable(F.coalesce(
        H.found(url, r"/s/([^/]+)/homes"), H.found(url, r"/rooms/.*[?&].*city=([^&]+)")))


def city_from_title(site_name: str, title: str = "title") -> Column:
    """Capitalized words of the last title part that does not name the site."""
    parts = F.reverse(F.split(F.col(title), " - "))
    usable = F.filter(
        parts, lambda x: ~F.lower(x).contains(site_name.lower()) & (F.length(x) > 2))
    words = F.transform(
        usable, lambda x: F.regexp_extract(x, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1))
    return F.get(F.filter(words, lambda x: x != ""), F.lit(0))


def city_from_title_part(site_name: str, title: str = "title") -> Column:
    """Text up to the comma of the part before the site name; needs two parts."""
    parts = F.split(F.col(title), " - ")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    part = F.when(last.contains(site_name), before).otherwise(last)
    return F.when(F.size(parts) >= 2, F.trim(F.substring_index(part, ",", 1)))


def page_city(site_name: str, search_city: Column | None = None) -> Column:
    """The searched city if known, else the city of the address, else of the title."""
    options = [city_from_url(), city_from_title(site_name)]
    return F.coalesce(*([search_city] if search_city is not None else []), *options)


def room_type_text(text: Column, h1: Column) -> Column:
    """First of the room phrases in the heading or the page."""
    first, *rest = [(h1.contains(p) | text.contains(p), p.title()) for p in C.ROOM_PHRASES]
    chain = F.when(first[0], F.lit(first[1]))
    for test, label in rest:
        chain = chain.when(test, F.lit(label))
    return chain


def _named_room(name: Column) -> Column:
    t = F.lower(name)
    home = t.contains("home") | t.contains("apartment") | t.contains("place")
    return (
        F.when(t.contains("entire") & home, F.lit("Entire home/apt"))
        .when(t.contains("private room") | t.contains("room in"), F.lit("Private room"))
        .when(t.contains("shared room"), F.lit("Shared room"))
        .when(t.contains("hotel"), F.lit("Hotel room"))
        .otherwise(name)
    )


def _first(labels: Column) -> Column:
    return F.get(F.filter(labels, lambda x: x.isNotNull()), F.lit(0))


def _phrased_room(text: Column, entire: Sequence[str], private: Sequence[str] = ("private room",),
                  shared: str = "shared room", hotel: str = "hotel room") -> Column:
    return (
        F.when(H.has_any(text, entire), F.lit("Entire home/apt"))
        .when(H.has_any(text, private), F.lit("Private room"))
        .when(text.contains(shared), F.lit("Shared room"))
        .when(text.contains(hotel), F.lit("Hotel room"))
    )


def _json_room(found: Column) -> Column:
    entire = ("entire place", "entire home", "entire apartment")
    named = F.transform(found, lambda x: _named_room(x["room_type"]))
    texts = F.flatten(F.transform(found, lambda x: F.array(*[x[k] for k in C.TEXT_KEYS])))
    phrased = F.transform(texts, lambda x: _phrased_room(F.lower(x), entire))
    return F.coalesce(_first(named), _first(phrased))


def _heading_room(h2: Column) -> Column:
    def label(x: Column) -> Column:
        t = F.lower(x)
        entire = t.contains("entire") & (t.contains("home") | t.contains("apartment"))
        return (
            F.when(t.contains("room in"), F.lit("Private room"))
            .when(entire, F.lit("Entire home/apt"))
            .when(t.contains("shared room"), F.lit("Shared room"))
            .when(t.contains("hotel room"), F.lit("Hotel room"))
        )

    return _first(F.transform(h2, label))


def _source_room(html: Column) -> Column:
    def label(page: Column) -> Column:
        return F.when(page.contains("room in"), F.lit("Private room")).otherwise(
            _phrased_room(page, ("entire home", "entire apartment", "entire place"),
                          private=("private room in",), shared="shared room in"))

    return H.once(F.lower(html), label)


def room_type_full(found: Column, text: Column, html: Column, h2: Column) -> Column:
    """Embedded JSON, then second headings, then page source, then (lower-case) page text."""
    return F.coalesce(
        _json_room(found), _heading_room(h2), _source_room(html),
        _phrased_room(text, ("entire home", "entire apartment")),
    )


def room_counts(text: Column) -> dict[str, Column]:
    """Guests, bedrooms, beds and baths named in the (lower-case) text."""
    patterns = {
        "person_capacity": C.GUESTS_PATTERN, "bedrooms": C.BEDROOMS_PATTERN,
        "beds": C.BEDS_PATTERN, "bathrooms": C.BATHS_PATTERN,
    }
    return {n: H.whole(H.capture(text, p)) for n, p in patterns.items()}


def beds_bedrooms(found: Column, text: Column) -> dict[str, Column]:
    """From JSON, else from the text; 0 counts as missing."""
    def count(name: str, patterns: Sequence[str]) -> Column:
        value = _first(F.transform(found, lambda x: x[name]))
        return F.coalesce(H.keep_if(value, lambda x: x != 0), H.first_count(text, patterns))

    return {
        "beds": count("beds", C.BED_LINE_PATTERNS),
        "bedrooms": count("bedrooms", C.BEDROOM_LINE_PATTERNS),
    }


def page_coordinates(scripts: Column, html: Column) -> Column:
    """(lat, lng) of the first pair of patterns that both match and are not near zero."""
    def pair(text: Column, lat_key: str, lng_key: str, prefix: str = "") -> Column:
        lat, lng = [
            H.number(H.capture(text, f'{prefix}"{k}"{C.COORDINATE_NUMBER}'))
            for k in (lat_key, lng_key)
        ]
        return H.keep_if(
            F.struct(lat.alias("lat"), lng.alias("lng")),
            lambda x: (F.abs(x["lat"]) > 0.1) & (F.abs(x["lng"]) > 0.1))

    plain, longer = C.COORDINATE_KEYS
    return F.coalesce(
        pair(scripts, *plain), pair(scripts, *longer),
        *[pair(scripts, *plain, prefix) for prefix in C.COORDINATE_PREFIXES[1:]],
        pair(html, *plain),
    )


def price_text(text: Column) -> Column:
    """Price per night, else the first amount on the page."""
    return F.coalesce(
        H.whole(H.capture(text, C.NIGHT_PRICE_PATTERN)),
        H.whole(H.capture(text, C.ANY_PRICE_PATTERN)),
    )


def price_full(html: Column, scripts: Column, text: Column) -> Column:
    """Price element, then JSON price text, then price phrases. Only the JSON price may
    lie outside the usual range."""
    low, high = C.PRICE_RANGE
    shown = [
        F.when(html.contains(token), H.within(
            H.whole(H.capture(H.plain(H.capture(html, p)), r"([\d,]+)")), low, high))
        for token, p in C.PRICE_ELEMENTS.items()
    ]
    stated = H.whole(H.capture(H.capture(scripts, C.PRICE_STRING_PATTERN), r"([\d,]+)"))
    phrases = [H.within(H.whole(H.capture(text, p)), low, high) for p in C.TEXT_PRICE_PATTERNS]
    return F.coalesce(*shown, stated, *phrases)


def review_count(text: Column) -> Column:
    return H.whole(H.capture(text, C.REVIEWS_PATTERN))


def page_ratings(html: Column, text: Column) -> dict[str, Column]:
    """Overall rating (label first, then phrases) and cleanliness, on the 5 scale."""
    label = F.when(html.contains("aria-label"), H.capture(
        H.capture(html, C.RATING_LABEL_PATTERN), r"([\d.]+)"))
    options = [label, *[H.capture(text, p) for p in C.RATING_PATTERNS]]
    clean = H.number(H.capture(text, C.CLEANLINESS_PATTERN))
    return {
        "guest_satisfaction_overall": F.coalesce(
            *[H.keep_if(H.number(v), lambda x: (x > 0) & (x <= 5)) for v in options]),
        "cleanliness_rating": H.keep_if(clean, lambda x: x <= 5),
    }


def amenity_text(html: Column, text: Column) -> Column:
    """Lower-case text of the amenity rows if the page has any, else the whole text."""
    return F.coalesce(H.amenity_rows(html), text)


def page_flags(
    text: Column, amenities: Column | None = None, strict_words: bool = False,
) -> dict[str, Column]:
    """Host, multi and business flags, and the six amenities (see ``amenity_text``)."""
    where = text if amenities is None else amenities
    return {
        "host_is_superhost": H.has_any(text, ("superhost",), strict_words),
        "multi": H.has_any(text, C.MULTI_WORDS, strict_words),
        "biz": H.has_any(text, C.BIZ_WORDS, strict_words),
        **{a: H.has_any(where, w, strict_words) for a, w in C.AMENITY_WORDS.items()},
    }


# --- stay dates -----------------------------------------------------------------
def weekend_stay(day: str | Column) -> dict[str, Column]:
    """Next Friday after the day, and the Sunday that follows it."""
    friday = F.next_day(day, "FRI")
    return {"checkin": friday, "checkout": F.date_add(friday, 2)}


def per_night(price: str | Column, nights: int = 2) -> Column:
    return (F.col(price) if isinstance(price, str) else price) / F.lit(nights)


# --- records --------------------------------------------------------------------
def found_json(pages: DataFrame) -> DataFrame:
    """Adds ``found``: per embedded JSON object, the values under the known keys."""
    return pages.withColumn("found", H.deep_find(H.page_json("html"), LOOKUPS))


def extract_listings(
    pages: DataFrame,
    site_name: str = "Stays",
    search_city: Column | None = None,
    strict_words: bool = False,
    search: DataFrame | None = None,
) -> DataFrame:
    """One listing record per usable page.

    A page without beds and room type is dropped, as are error pages. ``search`` is the
    result of ``search_prices``; it fills prices the page does not state, one per address.
    """
    parsed = found_json(page_text(drop_error_pages(pages))).withColumn(
        "amenities", amenity_text(F.col("html"), F.col("text")))
    text, found, html, scripts = (F.col(c) for c in ("text", "found", "html", "scripts"))
    counts = room_counts(text)
    fields = {
        "listing_key": page_listing_id(),
        "realSum": price_full(html, scripts, text),
        "room_type": room_type_full(found, text, html, F.col("h2")),
        "person_capacity": counts["person_capacity"],
        "bathrooms": counts["bathrooms"],
        "review_count": review_count(text),
        "city": page_city(site_name, search_city),
        "position": page_coordinates(scripts, html),
        **beds_bedrooms(found, text),
        **page_ratings(html, text),
        **page_flags(text, F.col("amenities"), strict_words),
    }
    # The record is built inside a generator, so that the test on it and the columns taken
    # from it do not make Spark compute the fields again.
    record = H.keep_if(
        F.struct(*[c.alias(n) for n, c in fields.items()]),
        lambda r: r["beds"].isNotNull() | r["room_type"].isNotNull())
    out = parsed.select("page_id", "url", F.inline(F.array_compact(F.array(record)))).withColumns({
        "room_shared": F.coalesce(F.lower("room_type").contains("shared room"), F.lit(False)),
        "room_private": F.coalesce(F.lower("room_type").contains("private room"), F.lit(False)),
        "lat": F.col("position.lat"), "lng": F.col("position.lng"),
    })
    if search is not None:
        prices = price_per_url(search).withColumnRenamed("url", "_url")
        out = out.join(prices, F.substring_index("url", "?", 1) == F.col("_url"), "left").withColumn(
            "realSum", F.coalesce("realSum", "search_price"))
    return out.select("page_id", "listing_key", "review_count", "bathrooms", *C.CITY_FILE_COLUMNS)
