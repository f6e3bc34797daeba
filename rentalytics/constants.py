"""Cut points, labels, weights and word lists.

Results only agree with the market reports people already use when these hold,
so they live together here. Every operator takes them as overridable defaults.
"""

# --- fixed values: data model -------------------------------------------------
AMENITIES = ("wifi", "kitchen", "air_conditioning", "parking", "tv", "heating")
DISTANCE_MEASURES = (
    "dist", "metro_dist", "attr_index", "attr_index_norm", "rest_index", "rest_index_norm",
)
ROOM_COUNTS = ("bedrooms", "beds")
LISTING_COLUMNS = (
    "realSum", "room_type", "room_shared", "room_private", "person_capacity",
    "host_is_superhost", "multi", "biz", "cleanliness_rating",
    "guest_satisfaction_overall", "bedrooms", "city", "lng", "lat", "beds", "bathrooms",
    "wifi", "kitchen", "air_conditioning", "parking", "tv", "heating",
)
CITY_FILE_COLUMNS = ("url",) + tuple(c for c in LISTING_COLUMNS if c != "bathrooms")

# --- fixed values: cleaning ---------------------------------------------------
ALLOWED_CITIES = (
    "amsterdam", "athens", "barcelona", "berlin", "budapest",
    "vienna", "lisbon", "london", "paris", "rome",
)
COUNTRY_TO_CITY = {
    "netherlands": "amsterdam",
    "greece": "athens",
    "spain": "barcelona",
    "germany": "berlin",
    "hungary": "budapest",
    "austria": "vienna",
    "portugal": "lisbon",
    "united kingdom": "london",
    "france": "paris",
    "italy": "rome",
}
UNWANTED_REGIONS = ("ga", "in", "canada", "ny")
TRUE_TEXTS = ("t", "True", "true")
FALSE_TEXTS = ("f", "False", "false")
# Texts a CSV reader of the original data takes for "missing".
MISSING_TEXTS = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DATE_FORMATS = (
    "yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyyMMdd",
    "yyyy-MM-dd H:mm[:ss][.SSS]", "M/d/yyyy H:mm[:ss]", "yyyy/MM/dd H:mm[:ss]", "d MMM yyyy H:mm[:ss]",
    "d MMMM yyyy H:mm[:ss]",
)

# --- fixed values: bands and segments (labels use an en dash) -----------------
DIST_CUTS = (1.0, 3.0, 6.0)
DIST_LABELS = ("0–1 km", "1–3 km", "3–6 km", "6+ km")
METRO_CUTS = (0.5, 1.0, 2.0)
METRO_LABELS = ("0–0.5 km", "0.5–1 km", "1–2 km", "2+ km")
SATISFACTION_CUTS = (95.0, 90.0, 80.0)
SATISFACTION_LABELS = ("95–100", "90–94", "80–89", "<80")
INDEX_CUTS = (4.0, 2.0)
ATTRACTION_LABELS = ("HIGH_ATTRACTION", "MID_ATTRACTION", "LOW_ATTRACTION")
FOOD_LABELS = ("HIGH_FOOD", "MID_FOOD", "LOW_FOOD")
TIER_CUTS = (1, 3)
TIER_LABELS = ("BASIC", "COMFORT", "FULL")
BUNDLE_CUTS = (5, 3)
BUNDLE_LABELS = ("AMENITIES_FULL", "AMENITIES_COMFORT", "AMENITIES_BASIC")
GAUGE_CUTS = (50.0, 80.0)
GAUGE_LABELS = ("0–50", "50–80", "80–100")

# --- fixed values: group sizes, limits and weights of the analyses ------------
MIN_BENCHMARK = 50
MIN_SEGMENT = 50
MIN_FEATURE = 200
MIN_HOTSPOT = 80
MIN_STRATEGY = 80
GRID_DEGREES = 0.02
NEAR_METRO_KM = 0.7
HOTSPOT_WEIGHTS = {"avg_price": 0.45, "avg_attr": 8.0, "avg_food": 8.0, "avg_sat": 0.4}
STRATEGY_WEIGHTS = {"avg_sat": 0.55, "avg_attr": 6.0, "avg_food": 6.0, "avg_price": 0.08}

# --- fixed values: page reading -----------------------------------------------
ROOM_PHRASES = ("entire home", "entire place", "private room", "shared room", "hotel room")
MULTI_WORDS = ("multiple rooms", "several rooms", "多个房间")
BIZ_WORDS = ("business", "work", "desk", "workspace", "entrepreneur")
AMENITY_WORDS = {
    "wifi": ("wifi", "internet", "wi-fi"),
    "kitchen": ("kitchen",),
    "air_conditioning": ("air conditioning", "ac", "a/c", "cooling"),
    "parking": ("parking", "garage"),
    "tv": ("tv", "television", "hdtv"),
    "heating": ("heating",),
}
ROOM_TYPE_KEYS = (
    "roomType", "room_type", "roomTypeCategory", "roomTypeName", "room_type_category",
    "room_type_name", "propertyType", "property_type",
)
BED_KEYS = ("beds", "bedCount", "bed_count", "numberOfBeds", "bedsCount")
BEDROOM_KEYS = (
    "bedrooms", "bedroomCount", "bedroom_count", "numberOfBedrooms", "bedroomsCount",
)
TEXT_KEYS = ("name", "title", "description")
GUESTS_PATTERN = r"(\d+)\s*guest"
BEDROOMS_PATTERN = r"(\d+)\s*bedroom"
BEDS_PATTERN = r"(\d+)\s*bed(?!room)"
BATHS_PATTERN = r"(\d+)\s*bath"
BED_LINE_PATTERNS = (
    r"(\d+)\s*(?:single|double|queen|king|twin|full)\s*beds?",
    r"(\d+)\s*beds?\s*·",
    r"(\d+)\s*beds?\s*•",
)
BEDROOM_LINE_PATTERNS = (
    r"(\d+)\s*bedrooms?\s*·",
    r"(\d+)\s*bedrooms?\s*•",
    r"(\d+)\s*bedrooms?[^a-z]",
)
COORDINATE_KEYS = (("lat", "lng"), ("latitude", "longitude"))
COORDINATE_NUMBER = r"\s*:\s*([-\d.]+)"
NIGHT_PRICE_PATTERN = r"(?i)[$€£¥₹]\s*([\d,]+)\s*(?:per\s*)?(?:/\s*)?night"
ANY_PRICE_PATTERN = r"[$€£]([\d,]+)"
TEXT_PRICE_PATTERNS = (
    r"(?i)[$€£]\s*([\d,]+)\s*night",
    r"(?i)[$€£]\s*([\d,]+)\s*per\s*night",
    r"(?i)([\d,]+)\s*[$€£]\s*night",
)
PRICE_STRING_PATTERN = r'"priceString"\s*:\s*"([^"]+)"'
REVIEWS_PATTERN = r"([\d,]+)\s*review"
RATING_PATTERNS = (
    r"([\d.]+)\s*rating",
    r"rated\s*([\d.]+)",
    r"rating[:\s]*([\d.]+)",
    r"★\s*([\d.]+)",
)
CLEANLINESS_PATTERN = r"cleanliness\s*[:\s]*([\d.]+)"
PRICE_RANGE = (5, 50000)
SCRIPT_KINDS = ("__NEXT_DATA__", "application/ld+json", "application/json")
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&copy;": "©", "&middot;": "·", "&bull;": "•",
    "&amp;": "&",
}
# Elements tried in order, by a text the page must hold; group 1 is the inner HTML.
PRICE_ELEMENTS = {
    "_1y74zjx": r'(?is)<span[^>]*class="[^"]*\b_1y74zjx\b[^"]*"[^>]*>(.*?)</span>',
    "_tyxjp1": r'(?is)<span[^>]*class="[^"]*\b_tyxjp1\b[^"]*"[^>]*>(.*?)</span>',
    "_1jo4hgw": r'(?is)<div[^>]*class="[^"]*\b_1jo4hgw\b[^"]*"[^>]*>.*?<span[^>]*>(.*?)</span>',
    "price": r'(?is)<span[^>]*class="[^"]*price[^"]*"[^>]*>(.*?)</span>',
}
SEARCH_PRICE_ELEMENT = (
    r'(?is)<span[^>]*class="[^"]*(?:\b_tyxjp1\b|price)[^"]*"[^>]*>(.*?)</span>'
    r'|data-testid="price-availability-row"[^>]*>\s*(?:<(?!/?span)[^>]*>\s*)*<span[^>]*>(.*?)</span>'
)
# Amenity rows: list items of the amenity section, else elements marked as rows.
AMENITY_SECTION = ("data-section-id", "AMENITIES_DEFAULT")
AMENITY_ITEM = ("role", "listitem")
AMENITY_ROW = ("data-testid", "amenity-row")
RATING_LABEL_PATTERN = r'(?is)<span[^>]*aria-label="([^"]*rating[^"]*)"'
COORDINATE_PREFIXES = ("", '"pdp_listing_detail".*?', "listing.*?", '"location".*?')
