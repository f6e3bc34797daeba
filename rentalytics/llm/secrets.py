"""Secret scans: credential patterns, and values in credential context that would be hard to guess.

How hard a value is to guess is the smallest cost, over all ways to cut it, of guessing
its pieces as words, separators, dates, repeats, keyboard walks or plain brute force. A placeholder
such as ``changeme`` is cheap; a generated key is not. Words are those guessers try first and
the most frequent ones of all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics.llm.common import bounded, read
from rentalytics.runtime import stage

# The base kinds, in the order they are listed in.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the first match of a run takes the whole run: as AKIA[A-Z0-9]+, 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6

# Credential context: a name whose last dotted part holds one of these words, an assignment, a value. Every name is
# tried, also one inside the value of another. A quoted value has any length; behind a quote that its line does not
# close, the value is read as a bare one.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["']?[\x20\t]*+(?::=|=>|[:=])[\x20\t]*+""")
NAME = re.compile(
    r"""(?ai:passw(?:or)?d|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key"""
    r"""|private[_-]?key|auth[_-]?key|credentials?|client[_-]?key)""")
QUOTED = re.compile(r""""([^"\r\n]+)"|'([^'\r\n]+)'""")
BARE = re.compile(r"""["']?([^\s"'<>,;()]+)""")
# A bare value that is itself the name of an assignment: a key behind a bracket, or letters only, then a separator and
# a further value that is not part of the same token. A ``=`` right behind a value is padding.
INNER = re.compile(
    r"""(?:[{\[]+[\w.-]+|[^\W\d]+(?:[.-][^\W\d]+)*)["']?[\x20\t]*"""
    r"""(?:(?::=|=>|:|(?<=[\x20\t])=(?!=))(?:[\x20\t]+(?=\S)|(?=["']))|=(?=["']))""")
# A value needs at least 10**GUESSES_LOG10 guesses to count as a secret, whatever its length and characters.
GUESSES_LOG10 = 10.0
# Costs of values up to this length are kept for values that come again; longer ones are costed each time.
KEPT_CHARS = 256

# Words guessers try first, most common first.
WORDS = (
    "password", "admin", "welcome", "letmein", "secret", "login", "master", "dragon", "monkey", "shadow", "sunshine",
    "princess", "football", "baseball", "iloveyou", "trustno", "superman", "batman", "michael", "charlie", "jordan",
    "changeme", "change", "default", "example", "sample", "test", "testing", "guest", "user", "username", "root",
    "toor", "token", "access", "private", "public", "server", "client", "database", "backup", "service", "account",
    "hello", "world", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "october", "company",
    "internet", "computer", "mobile", "google", "apple", "amazon", "your", "here", "none", "null", "undefined",
    "placeholder", "dummy", "redacted", "replace", "insert", "todo", "string", "value", "key", "pass", "code", "the",
    "and", "for", "this", "that", "with", "from", "not", "you", "are", "have", "new", "old", "demo", "dev", "prod",
    "staging", "local", "host", "localhost", "config", "setting", "system", "network", "security", "manager", "office",
)
# Passwords that leaked most often, most common first; those that are walks, repeats or digits are cheap without a list.
COMMON = tuple("""
password iloveyou princess rockyou nicole daniel babygirl monkey lovely jessica michael ashley sunshine chocolate anthony
angel friends butterfly purple jordan liverpool justin loveme football secret andrea carlos jennifer joshua bubbles
superman hannah amanda loveyou pretty basketball andrew angels tweety flower playboy hello elizabeth hottie tinkerbell
charlie samantha barbie chelsea lovers teamo jasmine brandon shadow melissa eminem matthew robert danielle forever family
jonathan computer whatever dragon vanessa cookie naruto summer sweety spongebob joseph junior softball taylor yellow
daniela lauren mickey princesa alexandra alexis jesus estrella miguel william thomas beautiful mylove angela poohbear
patrick iloveme sakura adrian alexander destiny christian sayang america dancer monica richard diamond princesse orange
carolina steven rangers louise trustno letmein welcome master baseball access hunter ranger batman buster soccer harley
hockey george killer pepper maggie ginger abcdef cheese thunder matrix phoenix silver merlin cowboy corvette mustang
ferrari mercedes porsche maverick camaro yankees lakers dallas steelers packers arsenal chester bailey cooper peanut
snoopy scooter tigger winner gandalf starwars pokemon samsung nintendo metallica nirvana slipknot blink greenday queen
freedom heaven hello pass admin administrator guest root oracle changeit default system manager operator support test
tester demo temp temporary public private backup login passw qwerty azerty asdf zxcvbn whatsup nothing internet service
cisco linux ubuntu debian windows apache tomcat mysql postgres mongo redis docker kubernetes jenkins github gitlab
raspberry vagrant ansible hunter zaq trustme open sesame money power success winter spring autumn flower banana
""".split())
# The dictionary counted from the texts: at most so many words, each of so many letters and in so many texts at least.
DICTIONARY, WORD_CHARS, WORD_TEXTS = 50_000, 24, 3
_RUNS = re.compile(r"[^\W\d_]{3,}")
# Different words a task counts before it passes them on.
_HELD_WORDS = 500_000


def _ranked(*lists: Sequence[str]) -> dict[str, int]:
    """The best rank of each word in any of the lists."""
    ranks: dict[str, int] = {}
    for words in lists:
        for i, w in enumerate(words, 1):
            ranks[w] = min(i, ranks.get(w, i))
    return ranks


RANKS = _ranked(WORDS, COMMON)
_LEET = str.maketrans("@4310$5!7+", "aaeiossitt")
SEPARATORS = " _-."  # between words
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEYS = {c: (r, k + r / 2) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._ ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._ ]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:19|20)\d\d)")
_PIECE_COST = math.log10(2)  # each further piece doubles the ways to combine pieces


def _letters(piece: str) -> float:
    """Size of the alphabet a brute-force guesser has to try."""
    n = 0
    n += 26 * any("a" <= c <= "z" for c in piece)
    n += 26 * any("A" <= c <= "Z" for c in piece)
    n += 10 * any("0" <= c <= "9" for c in piece)
    n += 33 * any(" " <= c <= "~" and not c.isalnum() for c in piece)
    n += 100 * any(c > "~" for c in piece)
    return float(max(n, 10))


def _next_keys(a: str, b: str) -> bool:
    p, q = _KEYS.get(a), _KEYS.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _pieces(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of the guesses) of everything that is easier than brute force."""
    low, n = value.lower(), len(value)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + WORD_CHARS) + 1):
            rank = ranks.get(low[i:j])
            leet = 0.0
            if rank is None and (rank := ranks.get(plain[i:j])):
                leet = math.log10(2.0) * sum(x != y for x, y in zip(low[i:j], plain[i:j]))
            if rank:
                piece = value[i:j]
                case = 0.0 if piece == piece.lower() else math.log10(2.0 if piece in (piece.upper(), piece.title()) else 64.0)
                yield i, j, math.log10(rank) + leet + case
        if m := _DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 120) if m.end() - i > 4 else math.log10(120)
        if value[i] in SEPARATORS:
            yield i, i + 1, math.log10(len(SEPARATORS))
    for size in (1, 2, 3, 4):  # the same stretch again and again
        i = 0
        while i + 2 * size <= n:
            j = i + size
            while low[j:j + size] == low[i:i + size]:
                j += size
            if j - i >= max(3, 2 * size):
                base = math.log10(_letters(value[i:i + size])) * size
                yield i, j, base + math.log10((j - i) / size)
                i = j - size + 1
            else:
                i += 1
    for near in (_next_keys, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(b) - ord(a) == -1):
        i = 0
        while i < n - 2:
            j = i + 1
            while j < n and near(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                turns = 0
                if near is _next_keys:
                    steps = [(_KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] > _KEYS[a][1]) for a, b in zip(low[i:j], low[i + 1:j])]
                    turns = sum(s != t for s, t in zip(steps, steps[1:]))
                yield i, j, math.log10(47 * (j - i)) + turns * math.log10(4.0)
            i = j if j - i >= 3 else i + 1


def guess_cost(value: str) -> float:
    """log10 of the guesses the cheapest cut of ``value`` needs. An empty value needs one guess.

    Brute force costs the same per character wherever it stands, so a stretch of it grows by
    one character in one step, and the search is linear in the length plus the pieces found.
    """
    return _guess_cost(value)


def _cost(value: str, ranks: dict[str, int]) -> float:
    n = len(value)
    per_char = math.log10(_letters(value))
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _pieces(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + per_char
        for i, cost in ends.get(j, ()):
            best[j] = min(best[j], best[i] + cost + _PIECE_COST)
    return best[n]


def coster(ranks: dict[str, int]) -> Callable[[str], float]:
    """``guess_cost`` by the given words."""
    kept: dict[str, float] = {}

    def cost(value: str) -> float:
        if len(value) > KEPT_CHARS:
            return _cost(value, ranks)
        if value not in kept:
            if len(kept) >= 20_000:
                kept.clear()
            kept[value] = _cost(value, ranks)
        return kept[value]

    return cost


_guess_cost = coster(RANKS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed kinds, sorted by start, then kind as listed."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=_order)


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every value in credential context, in order of the names.

    A bare value ends where the next credential name in it begins, so ``a_token=x&b_token=y``
    holds two values, and each stretch of text is read for one bare value only.
    """
    if ":" not in text and "=" not in text:
        return
    names = [(m.start(), m.end()) for m in CONTEXT.finditer(text) if NAME.search(m[1].rpartition(".")[2])]
    for (_, at), (stop, _) in zip(names, [*names[1:], (len(text), 0)]):
        if m := QUOTED.match(text, at):
            yield m.span(m.lastindex)
        elif (m := BARE.match(text, at, max(at, stop))) and not INNER.match(text, m.start(1)):
            yield m.start(1), m.start(1) + len(m[1].rstrip(".!?:*#$%&|"))  # without sentence marks


def guessed_spans(
    text: str, threshold: float = GUESSES_LOG10, cost: Callable[[str], float] = guess_cost,
) -> list[tuple[int, int, str]]:
    """Values in credential context that cost at least 10**threshold guesses."""
    found = []
    for start, end in context_values(text):
        if cost(text[start:end]) >= threshold:
            found.append((start, end, "guess"))
    return found


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: Sequence[tuple[int, int, str]], mark: str) -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def text_words(text: str) -> set[str]:
    """The words of a text, in small letters. Values in credential context are no words, however often they are copied."""
    at, parts = 0, []
    for start, end in context_values(text):
        if start >= at:
            parts.append(text[at:start])
        at = max(at, end)
    return set(_RUNS.findall(" ".join([*parts, text[at:]]).lower()))


def frequent_words(rows: DataFrame, text: str) -> list[str]:
    """The words that most texts hold, most frequent first, at most ``DICTIONARY``.

    Every text is read. Counts are binned by eighths of a doubling, and whole bins are taken
    while they fit, so no task ever sorts the words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in held if len(w) <= WORD_CHARS]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                              names=["word", "n"])

        for batch in bounded(batches, "text"):
            for t in batch.column("text").to_pylist():
                held.update(text_words(t or ""))
            if len(held) > _HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    counts = rows.select(rows[text].cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= WORD_TEXTS)
    counts = stage(counts.withColumn("bin", F.floor(8 * F.log2("n")).cast("int")), "words")
    total, least = 0, None
    for r in sorted(counts.groupBy("bin").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.bin):
        total += r.words
        if total > DICTIONARY:
            break
        least = r.bin
    if least is None:
        return []
    return [r.word for r in sorted(counts.filter(F.col("bin") >= least).collect(), key=lambda r: (-r.n, r.word))]


def scan(
    rows: DataFrame, text: str, *, mark: str | None = None, threshold: float = GUESSES_LOG10, keep_text: bool = True,
) -> DataFrame:
    """``rows`` plus ``secret_base`` and ``secret_spans`` (``kind:start:end``, comma-joined, code points).

    With ``mark`` the text column holds the redacted text: what spans cover becomes the mark.
    Without ``keep_text`` that column is left out and does not travel back from Python.
    The words of ``rows`` are counted first, by a job of their own.

    A null text has no spans and stays null; an empty one too. Long texts are scanned whole.
    Rows keep their other columns, whatever their names but the two new ones, which are
    replaced. Repeated rows are scanned alike; an empty table stays empty.
    """
    kept = [c for c in rows.columns if c not in ("secret_base", "secret_spans")]
    rest = [c for c in kept if c != text]
    packed = rows.select(F.struct(F.lit(0).alias("_"), *[rows[c].alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
                         rows[text].cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T.StringType()) for c in ("base", "spans")),
                           *([T.StructField("text", T.StringType())] if keep_text else [])])

    words = rows.sparkSession.sparkContext.broadcast(frequent_words(rows, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = coster(_ranked(WORDS, COMMON, words.value))
        for batch in bounded(batches, "text"):
            base, spans, texts = [], [], []
            for t in batch.column("text").to_pylist():
                fixed = base_spans(t or "")
                every = sorted([*fixed, *guessed_spans(t or "", threshold, cost)], key=_order)
                base.append(joined(fixed))
                spans.append(joined(every))
                if keep_text:
                    texts.append(redacted(t, every, mark) if every and mark is not None else t)
            columns = [batch.column("row"), *(pa.array(x, pa.string()) for x in (base, spans, texts)[:2 + keep_text])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)} | {text: F.col("text")}
    return packed.mapInArrow(run, schema).select(
        *[place[c].alias(c) for c in kept if keep_text or c != text], F.col("base").alias("secret_base"),
        F.col("spans").alias("secret_spans"))


def redact(rows: DataFrame, text: str, mark: str = "<SECRET>") -> DataFrame:
    """``rows`` with every secret in the text replaced."""
    return scan(rows, text, mark=mark).select(*rows.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of ``op5_secrets``: every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, "text", keep_text=False)
    count = lambda kind: F.regexp_count("secret_base", F.lit(rf"\b{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.col("secret_base").cast("binary"), 256).alias("base_sha256"),
        F.col("secret_spans").alias("spans"))
