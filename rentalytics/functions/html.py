"""Column expressions that read fields out of page HTML and text."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics import constants as C
from rentalytics.functions.scalars import _col


# --- evaluate once --------------------------------------------------------------
# A page field is costly, and a column expression used twice may be computed twice.
def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keep_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value where it passes the test, else null; computed a single time."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


# --- text -----------------------------------------------------------------------
def capture(text: str | Column, pattern: str, group: int = 1) -> Column:
    """Capture of the first match, empty without one."""
    return F.regexp_extract(_col(text), pattern, group)


def found(text: str | Column, pattern: str, group: int = 1) -> Column:
    """Capture of the first match, null without one."""
    return keep_if(capture(text, pattern, group), lambda x: x != "")


def all_found(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def _code_point(name: Column) -> Column:
    """Number of a numeric entity such as ``#233`` or ``#xE9``, else null."""
    hex_digits = F.regexp_extract(name, r"^#[xX]([0-9A-Fa-f]{1,6})$", 1)
    digits = F.regexp_extract(name, r"^#([0-9]{1,7})$", 1)
    return F.coalesce(F.when(hex_digits != "", F.conv(hex_digits, 16, 10)).try_cast("int"), digits.try_cast("int"))


def _character(code: Column) -> Column:
    """Text of one code point, by way of JSON escapes; null for none that a text can hold."""
    def unit(c: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.hex(c), 4, "0"))

    above = code - F.lit(0x10000)
    escapes = F.when(code < 0x10000, unit(code)).otherwise(F.concat(
        unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(0x3FF))))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.get(F.from_json(F.concat(F.lit('["'), escapes, F.lit('"]')), "array<string>"), F.lit(0)))


def unescape(text: str | Column) -> Column:
    """Named and numeric entities to characters, once; unknown ones stay. A fixed blank is a blank."""
    named = F.create_map(*[F.lit(x) for n, c in name2codepoint.items() for x in (n, " " if n == "nbsp" else chr(c))],
                         F.lit("apos"), F.lit("'"))

    def decode(t: Column) -> Column:
        names = F.array_distinct(all_found(t, r"&(#?[0-9A-Za-z]{1,10});"))
        # What "&amp;" gives is no entity again, so it goes last.
        ordered = F.concat(F.filter(names, lambda n: n != "amp"), F.filter(names, lambda n: n == "amp"))
        char = lambda n: F.coalesce(F.try_element_at(named, n), _character(_code_point(n)))
        return F.aggregate(ordered, t, lambda out, n: F.coalesce(
            F.replace(out, F.concat(F.lit("&"), n, F.lit(";")), char(n)), out))

    return once(_col(text), lambda t: F.when(t.contains("&"), decode(t)).otherwise(t))


def plain(html: str | Column) -> Column:
    """Markup to text: tags to blanks, entities decoded, blanks collapsed."""
    text = unescape(F.regexp_replace(_col(html), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def visible_text(html: str | Column) -> Column:
    hidden = (
        r"(?is)<head(?:\s[^>]*)?>.*?</head>|<script[^>]*>.*?</script>"
        r"|<style[^>]*>.*?</style>|<!--.*?-->"
    )
    return plain(F.regexp_replace(_col(html), hidden, " "))


def element(html: str | Column, tag: str) -> Column:
    """Text of the first such element, empty without one."""
    return plain(F.regexp_extract(_col(html), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def elements(html: str | Column, tag: str) -> Column:
    inner = all_found(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")
    return F.transform(inner, lambda x: plain(x))


def script_text(html: str | Column) -> Column:
    return F.concat_ws(" ", all_found(html, r"(?is)<script[^>]*>(.*?)</script>"))


def has_any(text: str | Column, words: Sequence[str], strict_words: bool = False) -> Column:
    """True if the text holds one of the words. By default a word may be part of another
    ("ac" in "place"); ``strict_words`` asks for word limits around it."""
    t = _col(text)
    if strict_words:
        tests = [t.rlike(rf"(?<![\p{{L}}\d])\Q{w}\E(?![\p{{L}}\d])") for w in words]
    else:
        tests = [t.contains(w) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


# --- numbers --------------------------------------------------------------------
# A missing match is an empty text, which reads as null.
def whole(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("int")


def number(text: Column) -> Column:
    return text.try_cast("double")


def within(value: Column, low: float, high: float) -> Column:
    """The value if strictly between the limits."""
    return keep_if(value, lambda x: (x > low) & (x < high))


def first_count(text: str | Column, patterns: Sequence[str]) -> Column:
    """First pattern with a match; a count of 0 is no count."""
    return F.coalesce(*[keep_if(whole(capture(text, p)), lambda x: x != 0) for p in patterns])


# --- urls -----------------------------------------------------------------------
def with_currency(url: str | Column, currency: str = "USD") -> Column:
    u = _col(url)
    separator = F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(u.contains("currency="), u).otherwise(
        F.concat(u, separator, F.lit(f"currency={currency}"))
    )


def site_of(url: str | Column) -> Column:
    return F.regexp_extract(_col(url), r"^(https?://[^/?#]+)", 1)


def readable(name: Column) -> Column:
    return F.initcap(F.replace(F.replace(name, F.lit("-"), F.lit(" ")), F.lit("%20"), F.lit(" ")))


# --- elements by attribute --------------------------------------------------------
class _Rows(HTMLParser):
    """Texts of marked elements, whatever is nested in them."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[str] = []
        self.rows: list[str] = []
        self._open: list[tuple[str, bool, list[str] | None, list[str] | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        has = lambda mark: (mark[0], mark[1]) in attrs
        section = bool(self._open and self._open[-1][1]) or has(C.AMENITY_SECTION)
        item = [] if section and tag == "div" and has(C.AMENITY_ITEM) else None
        row = [] if tag == "div" and has(C.AMENITY_ROW) else None
        self._open.append((tag, section, item, row))

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == tag), None)
        if depth is not None:
            self._close(depth)

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            _, _, item, row = self._open.pop()
            for found, texts in ((item, self.items), (row, self.rows)):
                if found is not None:
                    texts.append(" ".join("".join(found).split()))

    def handle_data(self, data):
        for _, _, item, row in self._open:
            for found in (item, row):
                if found is not None:
                    found.append(data + " ")

    def finish(self) -> str | None:
        self.close()
        self._close(0)
        for texts in (self.items, self.rows):
            if any(texts):
                return " ".join(t for t in texts if t).lower()
        return None


@F.pandas_udf(T.StringType())
def _amenity_rows(pages: pd.Series) -> pd.Series:
    def read(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Rows()
        parser.feed(page)
        return parser.finish()

    return pages.map(read)


def amenity_rows(html: str | Column) -> Column:
    """Lower-case text of the list items of the amenity section, else of the marked rows, else null.

    Elements nest, which patterns cannot follow, so pages that hold such a mark (and only
    these) go through a parser in Arrow batches.
    """
    page = _col(html)
    marked = page.contains(C.AMENITY_SECTION[1]) | page.contains(C.AMENITY_ROW[1])
    return _amenity_rows(F.when(marked, page))


# --- embedded JSON --------------------------------------------------------------
def page_json(html: str | Column) -> Column:
    """Texts of the data scripts: app state first, then linked data, then plain JSON objects.

    Whether a text can be read shows when it is read: see ``deep_find`` and ``json_count``.
    """
    state, linked, other = C.SCRIPT_KINDS

    def scripts(attribute: str) -> Column:
        pattern = rf'(?s)<script[^>]*{attribute}[^>]*>(.*?)</script>'
        return F.transform(all_found(html, pattern), lambda x: F.trim(x))

    objects = F.filter(
        scripts(f'type="{other}"'), lambda x: x.startswith("{") & x.endswith("}")
    )
    return F.concat(
        scripts(f'id="{state}"'), scripts('type="' + linked.replace("+", r"\+") + '"'), objects)


def _norm(key: str) -> str:
    return key.lower().replace("_", "").replace("-", "")


def _parse(text: str):
    """The value of a JSON text, or None where it has none or nests deeper than the parser goes."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _search(node, keys: frozenset[str]):
    """First value under one of the keys: own keys before children, children in order."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            own = [v for k, v in node.items() if _norm(k) in keys]
            if own:
                if own[0] is not None:
                    return own[0]
                continue
            waiting += reversed(node.values())
        elif isinstance(node, list):
            waiting += reversed(node)
    return None


def _as_count(value):
    """Whole number of a found value; 0 when it is none."""
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return 0


def json_count(texts: Column) -> Column:
    """How many of the texts can be read as JSON."""
    @F.pandas_udf(T.IntegerType())
    def count(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sum(_parse(x) is not None for x in (t if t is not None else ())))

    return count(texts)


def deep_find(texts: Column, lookups: Mapping[str, tuple[Sequence[str], str]]) -> Column:
    """For each JSON object of the page, the values found under each key list.

    ``lookups`` maps a name to (keys, "string" or "int"). Key case, ``_`` and ``-`` do
    not matter; of a repeated key the last value counts. A text that cannot be read has no
    object. Nested JSON without a schema has no built-in search, so this is a Python
    function over Arrow batches; all lookups share one parse.
    """
    wanted = {n: (frozenset(map(_norm, keys)), kind) for n, (keys, kind) in lookups.items()}
    fields = [
        T.StructField(n, T.IntegerType() if kind == "int" else T.StringType())
        for n, (_, kind) in wanted.items()
    ]

    def read(texts) -> list[dict]:
        known = {t: _parse(t) for t in set(texts) if t}  # app state may also be plain JSON
        parsed = [known[t] for t in texts if t]
        flat = [x for p in parsed for x in (p if isinstance(p, list) else [p])]
        rows = []
        for obj in (x for x in flat if isinstance(x, dict)):
            row = {}
            for name, (keys, kind) in wanted.items():
                value = _search(obj, keys)
                if kind == "int":
                    count = None if value is None else _as_count(value)
                    row[name] = count if count is None or abs(count) < 1 << 31 else 0
                else:
                    row[name] = value if isinstance(value, str) and value else None
            rows.append(row)
        return rows

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def search(column: pd.Series) -> pd.Series:
        return column.map(lambda t: read(t if t is not None else ()))

    return search(texts)
