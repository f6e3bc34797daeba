"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import read

TOKEN = "[a-z0-9]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``text`` names the rule; ``pattern`` is searched in host and path; ``tokens`` are whole tokens of every match.

    The longest ``text`` that fits wins within a rank; a lower ``rank`` comes first.
    """

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0
    named: bool = True


def site_rule(verdict: str, text: str) -> Rule:
    """``host/path``: the host and all its subdomains, and every path that begins like that."""
    host, slash, path = text.partition("/")
    tail = path.rsplit("/", 1)[0] if "/" in path else ""  # the last piece may be cut inside a token
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN, tail.lower())
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(text, verdict, pattern, tuple(tokens))


def word_rule(verdict: str, word: str) -> Rule:
    """A word of the host, whole between dots, hyphens and ends, on whatever site."""
    return Rule(word, verdict, rf"\A(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?![a-z0-9])", (word,), rank=1, named=False)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered. Empty if there is none."""
    host = F.regexp_extract(_behind_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs. As many rows reach the driver as the rules have tokens."""
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    found = seen.groupBy("token").count().join(F.broadcast(asked), "token")
    return {**dict.fromkeys(wanted, 0), **{r.token: r["count"] for r in found.collect()}}


class Index:
    """Rules under their rarest token. A rule without a token is tried on every URL."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self.rules = list(rules)
        for i, rule in enumerate(self.rules):
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)
        self._compiled: dict[int, re.Pattern] = {}

    def best(self, place: str) -> Rule | None:
        """The winning rule for host and path."""
        found = None
        near = set(self.always)
        for token in set(re.findall(TOKEN, place.translate(_LOWER))):
            near.update(self.by_token.get(token, ()))
        for i in near:
            if i not in self._compiled:
                self._compiled[i] = re.compile(self.rules[i].pattern, re.DOTALL)
            if self._compiled[i].search(place):
                rule = self.rules[i]
                order = (rule.rank, -len(rule.text), rule.text, rule.verdict)
                if found is None or order < found[0]:
                    found = (order, rule)
        return found[1] if found else None


def judge(rows: DataFrame, url: str, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """``rows`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    Rules are a parameter, so their index has a known size and goes to the tasks with the
    code. The corpus decides under which token a rule stands: the rarest over all URLs.

    A null URL, or one without ``://``, has an empty host and path, on which only rules
    without a token could match. Ties between rules of equal length go to the smaller text,
    then to ``allow``. Repeated rows are judged alike; an empty table stays empty; columns of
    the four new names are replaced.
    """
    kept = [c for c in rows.columns if c not in ("host", "path", "rule", "verdict")]
    parts = rows.select(F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
                        rows[url].alias("_url"))
    parts = parts.select("row", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    index = Index(rules, token_counts(parts, (t for r in rules for t in r.tokens)))
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.best(h + p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            names = pa.array([r.text if r and r.named else None for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, verdicts],
                                             names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", "verdict")


SITE_RULES = (
    site_rule("allow", "org/"),
    site_rule("block", "example.org/es/"),
    site_rule("block", "example.org/en/1"),
    site_rule("allow", "com/fr/"),
    site_rule("block", "com/de/"),
)
# Words in names of sites that only sell or advertise.
WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "casino", "clickbait", "doubleclick", "escort", "gambling",
    "jackpot", "loans", "lottery", "payday", "pills", "poker", "popup", "porn", "replica", "scam", "sex", "slots",
    "spam", "spyware", "torrent", "tracker", "viagra", "warez", "xxx",
)
WORD_RULES = tuple(word_rule("block", w) for w in WORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of ``op10_url_rules``: every page's URL."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, "url", (*SITE_RULES, *WORD_RULES)).select("page_id", "host", "path", "rule", "verdict")


# The same verdicts by trying every rule on every row, without an index.
SQL = f"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when instr(url, '://') > 0 then url end as url from pages)
), site(rule_host, rule_path, verdict) as (values
  {", ".join("('" + r.text.split("/", 1)[0] + "', '/" + r.text.split("/", 1)[1] + "', '" + r.verdict + "')"
             for r in SITE_RULES)}
), fits as (
  select page_id, host, path, rule_host || rule_path as rule, verdict,
    row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc,
      rule_host || rule_path) as place
  from (select distinct * from parts), site
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case
  when regexp_matches(p.host, '(^|[^a-z0-9])({"|".join(WORDS)})($|[^a-z0-9])') then 'block' else 'allow' end) as verdict
from parts p left join fits f on p.page_id is not distinct from f.page_id and p.host = f.host and p.path = f.path
  and f.place = 1
"""
