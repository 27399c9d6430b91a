"""Mixing sources at tempered weights, in DataFrame operations only.

Source shares are raised to an exponent that is bisected until the weights meet a target entropy or no source repeats
too often; each source then contributes whole passes over its documents and one cut short by its budget, every pass
in a scattered order, and blocks of all sources follow one another at the wanted weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..state import maybe_broadcast, written, written_counted
from .common import new_name, split_words

#: Each round of the search tries this many exponents at once, and so narrows the interval by as much.
TRIES, ROUNDS = 32, 5
#: Bits of the order key, bits decided by one histogram, and histograms.
KEY_BITS, STEP_BITS, STEPS = 60, 10, 4
BLOCKS = 1_000
SEED = 11


def scattered(*parts: Column) -> Column:
    """A 60-bit order key: leading digits of the MD5 of the parts; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, KEY_BITS // 4), 16, 10).cast("long")


def exponent(shares: DataFrame, entropy: float | None, max_repeats: float | None, budget: float | None) -> float:
    """The exponent in [0, 1] for ``shares(p > 0)`` of all tokens.

    ``entropy`` is a target as a part of the largest possible one; the exponent is the largest whose weights reach it
    (0 if none does). ``max_repeats`` then raises it to the smallest at which no source repeats more often;
    1 keeps the natural shares. ``budget`` is in parts of all tokens, None for the least that holds
    every source once. Only sums and extremes for a grid of exponents reach the driver.
    """
    def search(lowest_with, default):
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / TRIES for i in range(TRIES + 1)]
            row = shares.agg(F.count(F.lit(1)).alias("n"), *[x for i, a in enumerate(grid) for x in _sums(a, i)]).first()
            good = [lowest_with(row, i) for i in range(TRIES + 1)]
            if not any(good):
                return default
            k = good.index(True)
            if k == 0:
                return low
            low, high = grid[k - 1], grid[k]
        return high

    def _sums(a, i):
        w = F.pow("p", F.lit(a))
        return (F.sum(w).alias(f"z{i}"), F.sum(w * F.ln("p")).alias(f"l{i}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"most{i}"),
                F.min(F.pow("p", F.lit(a - 1))).alias(f"least{i}"), F.lit(a).alias(f"a{i}"))

    def below(row, i):  # the entropy falls as the exponent grows; bisect for the point where it reaches the target
        return math.log(row[f"z{i}"]) - row[f"a{i}"] * row[f"l{i}"] / row[f"z{i}"] <= entropy * math.log(row["n"]) + 1e-12

    def seldom(row, i):
        times = row[f"most{i}"] / row[f"least{i}"] if budget is None else budget * row[f"most{i}"] / row[f"z{i}"]
        return times <= max_repeats + 1e-9

    found = 1.0 if entropy is None else search(below, 1.0)
    if max_repeats is not None:
        found = max(found if entropy is not None else 0.0, search(seldom, 1.0))
    return found


def plan(sources: DataFrame, entropy: float | None, max_repeats: float | None, budget: float | None) -> DataFrame:
    """``(source, tokens, weight, repeats, passes, rest)`` from ``sources(source, tokens)``.

    ``passes`` are whole passes; ``rest`` are the tokens of the one cut short. A source without tokens has weight 0 and one
    pass. With a ``budget`` beyond what the limit allows at the natural shares, passes follow the budget.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n")).first()
    if not total["t"]:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"),
                              F.lit(1).cast("long").alias("passes"), F.lit(0.0).alias("rest"))
    shares = written(sources.where("tokens > 0").select((F.col("tokens") / F.lit(total["t"])).alias("p")), "mix-shares")
    a = exponent(shares, entropy, max_repeats, None if budget is None else budget / total["t"])
    z = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max(F.pow("p", F.lit(1 - a))).alias("m")).first()
    whole = total["t"] * z["m"] * z["z"] if budget is None else float(budget)
    p = F.col("tokens") / F.lit(total["t"])
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z["z"])).otherwise(0.0)
    repeats = F.when(F.col("tokens") > 0, F.lit(whole) * weight / F.col("tokens")).otherwise(1.0)
    passes = F.floor(repeats + 1e-9)
    return sources.select("source", "tokens", weight.alias("weight"), repeats.alias("repeats"), passes.alias("passes"),
                          F.greatest(F.lit(0.0), (repeats - passes) * F.col("tokens")).alias("rest"))


def cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, cut)``: documents of the source whose key is below the cut have at most its ``rest`` tokens.

    ``rows(source, tokens, key)``. Histograms over leading bits of the key narrow to the block where the running total
    passes ``rest``, so no source is ever sorted as a whole; documents that agree in the leading
    ``STEP_BITS * STEPS`` bits stay together.
    """
    state = sources.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("block"))
    for step in range(1, STEPS + 1):
        shift = KEY_BITS - STEP_BITS * step
        top = F.shiftright("key", shift)
        inside = rows.withColumn("b", top).groupBy("source", "b").agg(F.sum("tokens").alias("t"))
        inside = inside.join(state, inside["source"].eqNullSafe(state["s"]) & (F.shiftright("b", STEP_BITS) == state["block"]))
        run = Window.partitionBy("source").orderBy("b")
        upto = F.sum("t").over(run)
        fits = inside.select("source", "b", "t", "rest", upto.alias("upto")).where(F.col("upto") <= F.col("rest"))
        fits = fits.groupBy(F.col("source").alias("f")).agg(F.max("upto").alias("used"), F.max("b").alias("b"))
        over = inside.select("source", "b", "rest", upto.alias("upto")).where(F.col("upto") > F.col("rest"))
        over = over.groupBy(F.col("source").alias("o")).agg(F.min("b").alias("next"))
        joined = state.join(fits, state["s"].eqNullSafe(fits["f"]), "left").join(over, state["s"].eqNullSafe(over["o"]), "left")
        # Without a block that passes the rest, everything of the block before fits: go on after its end.
        state = written(joined.select("s", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
                                      F.coalesce("next", F.shiftleft(F.col("block") + 1, STEP_BITS)).alias("block")), "mix-cuts")
    return state.select(F.col("s").alias("source"), F.shiftleft("block", KEY_BITS - STEP_BITS * STEPS).alias("cut"))


def mix(documents: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None,
        source: str = "source", text: str = "text", id_: str = "doc_id", seed: int = SEED,
        epoch: str = "epoch", block: str = "block") -> DataFrame:
    """The mixture: a row per document and pass, with all columns of ``documents``, ``epoch`` and ``block``.

    Rows sorted by ``block`` hold the sources at their weights throughout: pass e of a source that repeats r times fills
    the part from e / r to (e + 1) / r of the blocks. Tokens are words. A null source is a source of its own; null and
    empty texts have no tokens, ride along with their source, and never pass a budget. Rows that repeat id and
    text stay or go together. An empty table stays empty. ``epoch`` and ``block`` must be new names.
    """
    clash = {epoch.lower(), block.lower()} & {c.lower() for c in documents.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    n, key = new_name(documents, "mix_tokens"), new_name(documents, "mix_key")
    marked = documents.withColumns({n: F.size(split_words(F.col(text))).cast("long"),
                                    key: scattered(F.lit(seed), F.col(id_), F.coalesce(F.col(text), F.lit("")))})
    slim = written(marked.select(F.col(source).alias("source"), F.col(n).alias("tokens"), F.col(key).alias("key")), "mix-rows")
    sources, seen = written_counted(plan(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy, max_repeats, budget), "mix-plan")
    limits = cuts(slim, sources)
    sources = sources.join(limits, sources["source"].eqNullSafe(limits["source"])).select(
        sources["source"].alias((s := new_name(documents, "mix_source"))), F.col("passes").alias((p := new_name(documents, "mix_passes"))),
        F.col("repeats").alias((r := new_name(documents, "mix_repeats"))), F.col("cut").alias((c := new_name(documents, "mix_cut"))))
    # A row a source: texts move only where the sources are too many to send along.
    joined = marked.join(maybe_broadcast(sources, seen["rows"]), marked[source].eqNullSafe(F.col(s)))
    copies = F.col(p) + (F.col(key) < F.col(c)).cast("long")
    rows = joined.where(copies > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("int"), (copies - 1).cast("int"))))
    order = F.when(F.col(epoch) == F.col(p), F.col(key)).otherwise(scattered(F.col(key), F.col(epoch)))
    place = (F.col(epoch) + order / F.lit(float(1 << KEY_BITS))) / F.greatest(F.col(r), F.lit(1e-12))
    at = F.least(F.lit(BLOCKS - 1), F.floor(place * BLOCKS).cast("int"))
    return rows.withColumn(block, at).select(*documents.columns, epoch, block)
