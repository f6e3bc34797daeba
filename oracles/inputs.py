"""The derived inputs as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from rentalytics.sources import binding as B

WEEKEND = "isodow(o_orderdate) >= 6"
JOINED = """lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey"""


def hash_id(*cols: str, hex_digits: int | None = None) -> str:
    parts = " || '_' || ".join(f"coalesce(cast({c} as varchar), 'nan')" for c in cols)
    if hex_digits is None:
        return f"md5({parts})"
    return f"cast(concat('0x', substr(md5({parts}), 1, {hex_digits})) as bigint)"


LISTING_ID = hash_id(
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "cast(round(l_extendedprice * 100) as bigint)", hex_digits=15,
)


def _fill(rule: str) -> str:
    return rule.replace("{weekday}", WEEKEND).replace("{text}", "varchar").replace("{id}", LISTING_ID)


def _select(rules: dict[str, str]) -> str:
    return ",\n  ".join(f"{_fill(r)} as {n}" for n, r in rules.items())


LISTINGS = (
    "listings as materialized (select\n  "
    + _select({n: r for n, (r, _) in B.LISTING_RULES.items()})
    + f"\n from {JOINED})"
)
SOURCE_A = f"source_a as (select\n  {_select(B.SOURCE_A_RULES)}\n from {JOINED})"
SOURCE_B = f"source_b as (select\n  {_select(B.SOURCE_B_RULES)}\n from orders)"
LISTING_PAGES = f"listing_pages as (select\n  {_select(B.PAGE_RULES)}\n from orders)"


def gaps(columns: Sequence[str], missing: Sequence[str]) -> str:
    rules = {"listing_id": "{id}", **{n: B.gap_rule(n, missing) for n in columns}}
    return f"gaps as materialized (select\n  {_select(rules)}\n from {JOINED})"


def r6(expr: str, digits: int = 6) -> str:
    """Rounding used for every computed double; see ``rounded`` in the query catalog."""
    return f"round({expr} + 1.234567e-9, {digits}) + 0.0"


def with_(*ctes: str, body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body
