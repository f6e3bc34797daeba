"""Mixing sources to target weights: pivotal dependent rounding of copy counts.

Every row of a source should appear ``target / size`` times. The whole part of that is
certain; the rest is a probability. Rows duel in pairs: words are moved from one
probability to the other, in a direction drawn so that no expectation changes, until one
of them is 0 or 1. The loser stays fractional and duels on. Duels run inside leaves of
bounded size; what a leaf leaves over (one row at most) duels in the next level of a tree
until one row of the source is left, which a coin decides.

The last row can be a long one, and the words taken would miss the target by its length.
So long rows go first and what their coin adds or takes is spread over the probabilities
of the shorter rows before these duel. Three such steps bring the miss down to the length
of a short row, unless the source has too few rows to make up for its longest one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentalytics.llm.common import mix64, n_words, numbered, read
from rentalytics.runtime import join_lookup, stage

LEAF_ROWS = 2_000
FAN_IN = 64
STEPS = 4
_EPS = 1e-12


def fill_targets(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """``sources`` (columns ``weight``, ``source_size``) plus ``target``.

    The budget is shared by weight; a target stops at ``cap`` times the source's size and the
    excess is shared again among the others. Each round is one sum over the sources.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    level, full = 0.0, -1
    while True:
        capped = limit <= F.col("weight") * F.lit(level)
        r = sources.agg(
            F.sum(F.when(capped, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(capped).alias("n"),
        ).first()
        if not r.open:
            level = math.inf
            break
        if r.n == full:
            break
        full, level = r.n, (budget - r.held) / r.open
    share = limit if math.isinf(level) else F.least(limit, F.col("weight") * F.lit(level))
    return sources.withColumn("target", share)


def _plan(pdf: pd.DataFrame, leaf_rows: int) -> pd.DataFrame:
    """Size limits of the steps of one source, from its word counts per size class."""
    pdf = pdf.sort_values("size_class")
    total, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    copies = target / total if total else 0.0
    whole = math.floor(copies + 1e-9)
    part = max(copies - whole, 0.0)
    sized = pdf[pdf.size_class >= 0]
    room = min(part, 1 - part)
    below = np.cumsum(sized.words.to_numpy())
    classes = sized.size_class.to_numpy()
    need = float(sized.longest.max()) if len(sized) else 0.0
    limits, words = [], []
    for _ in range(STEPS - 1):
        room /= 2
        shorter = classes < (limits[-1] if limits else (classes[-1] if len(classes) else -1))
        if not shorter.any():
            limits += [-1] * (STEPS - 1 - len(limits))
            words += [0.0] * (STEPS - 1 - len(words))
            break
        fits = np.flatnonzero(shorter & (below * room >= need))
        at = fits[0] if len(fits) else np.flatnonzero(shorter)[-1]  # the best there is, in a source of few rows
        limits.append(int(classes[at]))
        words.append(float(below[at]))
        need = float(sized.longest[classes <= limits[-1]].max())
    steps = np.array([sum(c <= b for b in limits) for c in classes], int)
    rows = sized["rows"].to_numpy()
    leaves = [max(1, -(-int(rows[steps == k].sum()) // leaf_rows)) for k in range(STEPS)]
    return pd.DataFrame([{
        "tag": pdf.tag.iloc[0], "source_size": total, "target": target, "whole": whole, "part": part,
        "limits": limits, "words": words, "leaves": leaves, "shift": 0.0,
    }])


_PLAN = ("tag string, source_size long, target double, whole int, part double, limits array<int>, "
         "words array<double>, leaves array<long>, shift double")
_DUEL = "tag string, node long, h1 long, h2 long, at long, size long, p double, now double, x int"


def _uniform(a: int, b: int, seed: int) -> float:
    h = mix64(mix64(np.array([a], np.int64).view(np.uint64) + np.uint64(seed)) ^ np.array([b], np.int64).view(np.uint64))
    return int(h[0] >> np.uint64(11)) / (1 << 53)


def _duels(pdf: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """All duels of one node. ``x`` is null for the one row that stays fractional."""
    pdf = pdf.sort_values(["h2", "h1", "size", "at"], ignore_index=True)
    size, now = pdf["size"].to_numpy(float), pdf["now"].to_numpy(float).copy()
    keys = pdf["h2"].to_numpy()
    coins = mix64(keys.view(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)
    holder = -1
    for i in range(len(pdf)):
        if now[i] <= _EPS or now[i] >= 1 - _EPS:
            continue
        if holder < 0:
            holder = i
            continue
        j, a, b = holder, size[holder], size[i]
        up = min(a * (1 - now[j]), b * now[i])
        down = min(a * now[j], b * (1 - now[i]))
        moved = up if int(coins[i]) / (1 << 53) * (up + down) < down else -down
        now[j] += moved / a
        now[i] -= moved / b
        for k in (j, i):
            if now[k] <= 1e-9 or now[k] >= 1 - 1e-9:
                now[k] = round(now[k])
        open_ = [k for k in (j, i) if 0 < now[k] < 1]
        holder = open_[0] if open_ else -1
    if last and holder >= 0:
        now[holder] = float(_uniform(int(keys[holder]), 1, seed) < now[holder])
    done = (now <= _EPS) | (now >= 1 - _EPS)
    pdf["now"] = now
    pdf["x"] = pd.Series(np.where(done, np.rint(now), np.nan)).astype("Int32")
    return pdf[["tag", "node", "h1", "h2", "at", "size", "p", "now", "x"]]


def _resolve(items: DataFrame, leaves: int, seed: int, fan_in: int) -> DataFrame:
    """All rows of one step decided: leaves first, then the tree over what they leave."""
    duel = lambda last: lambda pdf: _duels(pdf, seed, last)
    decided = []
    level = stage(items.groupBy("tag", "node").applyInPandas(duel(False), _DUEL), "mix-leaves")
    while True:
        decided.append(level.filter("x is not null"))
        last = leaves <= fan_in
        nodes = level.filter("x is null").drop("x").withColumn("node", F.floor(F.col("node") / fan_in))
        level = stage(nodes.groupBy("tag", "node").applyInPandas(duel(last), _DUEL), "mix-nodes")
        if last:
            break
        leaves = -(-leaves // fan_in)
    out = level
    for d in decided:
        out = out.unionByName(d)
    return out


def mix(
    rows: DataFrame, size: Column, source: str, *, weights: Sequence[float], share: float = 1.5, cap: float = 2.0,
    seed: int = 20_240_601, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``rows`` plus ``size``, ``source_size``, ``target`` and ``copies`` (0, 1, ... per row).

    Sources are taken by code point, a null one last, and get the weights in turn, again and
    again. All targets together are ``share`` times all sizes, none above ``cap`` times its
    source. The same rows give the same copies on any partitioning: chance comes from a
    hash of the row and ``seed``.

    Null sizes count as 0, negative ones too. Rows of size 0 are drawn one by one, and not
    taken where all of a source is empty. Equal rows share their draws: which of them gets a
    copy more is not told apart. An empty table stays empty. Columns of the four new names
    are replaced. Rows travel once, to be joined with their copies.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in rows.columns if c not in new]
    kinds = dict(rows.dtypes)
    content = [rows[c] for c in rows.columns if not kinds[c].startswith(("map", "variant"))]
    tag = F.when(rows[source].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), rows[source]))
    whole_rows = rows.select(
        F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"),
        F.xxhash64(F.lit(seed), *content).alias("h1"), F.xxhash64(*content, F.lit(seed)).alias("h2"),
        tag.alias("tag"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"),
    )
    items = stage(whole_rows.select("h1", "h2", "tag", "size", F.monotonically_increasing_id().alias("at")), "mix-items")
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    classes = stage(items.groupBy("tag", size_class.alias("size_class")).agg(
        F.sum("size").alias("words"), F.max("size").alias("longest"), F.count("*").alias("rows")), "mix-classes")
    sources = numbered(classes.groupBy("tag").agg(F.sum("words").alias("source_size")), [F.col("tag")], "rank")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(sources.select("tag", "source_size", turn.alias("weight")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = fill_targets(sources, share * total, cap)
    plan = stage(classes.join(targets, "tag").groupBy("tag").applyInPandas(
        lambda pdf: _plan(pdf, leaf_rows), _PLAN), "mix-plan")
    most = plan.agg(*[F.max(F.col("leaves")[k]).alias(f"n{k}") for k in range(STEPS)]).first()

    step = F.size(F.filter("limits", lambda b: b >= F.col("size_class")))
    decided = None
    for k in range(STEPS):
        asked = plan.select("tag", "whole", "part", "limits", "leaves", "shift", "source_size")
        here = join_lookup(items.filter("size > 0").withColumn("size_class", size_class), asked, ["tag"], ["h1"])
        p = F.col("part") + F.col("shift")
        now = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        here = here.filter(step == k).select(
            "tag", F.pmod("h2", F.col("leaves")[k]).alias("node"), "h1", "h2", "at", "size", p.alias("p"), now.alias("now"))
        out = _resolve(here, int(most[f"n{k}"] or 1), seed + k, fan_in).select("tag", "h1", "h2", "size", "p", "x")
        decided = out if decided is None else decided.unionByName(out)
        if k + 1 < STEPS:
            owed = out.groupBy("tag").agg(F.sum((F.col("p") - F.col("x")) * F.col("size")).alias("owed"))
            spread = F.coalesce(F.col("owed") / F.nullif(F.col("words")[k], F.lit(0.0)), F.lit(0.0))
            plan = stage(plan.join(owed, "tag", "left").withColumn("shift", F.col("shift") + spread).drop("owed"),
                         "mix-plan")
    empty = join_lookup(items.filter("size = 0"), plan.select("tag", "part"), ["tag"], ["h1"])
    draw = F.shiftrightunsigned("h2", 11) / F.lit(float(1 << 53)) < F.col("part")
    decided = decided.select("h1", "h2", "x").unionByName(empty.select("h1", "h2", draw.cast("int").alias("x")))
    # Equal rows are one group: their copies are counted together and dealt out evenly.
    draws = decided.groupBy("h1", "h2").agg(F.sum("x").alias("x"), F.count("*").alias("m"))
    n = F.when(F.col("m") == 1, F.lit(1)).otherwise(
        F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.lit(0))))
    joined = whole_rows.join(draws, ["h1", "h2"]).withColumn("n", n)
    joined = join_lookup(joined, plan.select("tag", "whole", "source_size", "target"), ["tag"], ["h1"])
    extra = F.floor(F.col("x") / F.col("m")) + (F.col("n") <= F.col("x") % F.col("m")).cast("int")
    return joined.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target",
        (F.col("whole") + extra).cast("int").alias("copies"))


def mixed_rows(rows: DataFrame, size: Column, source: str, **options) -> DataFrame:
    """The mix itself: every row as often as it has copies, with the columns of ``rows``."""
    taken = mix(rows.select(F.struct("*").alias("row"), rows[source].alias("source"), size.alias("size_asked")),
                F.col("size_asked"), "source", **options)
    return taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of ``op1_mix``: all documents, weights 3, 1, 2, 150 % of all words, twice at most."""
    slim = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n_words"))
    mixed = mix(slim, F.col("n_words"), "source", weights=(3, 1, 2))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
