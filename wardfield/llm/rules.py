"""Quality rules as learned decision lists, in DataFrame operations only.

Statistics of every text feed ordered rules, each a conjunction of thresholds. Sequential covering learns them from
labelled rows: a rule grows by the condition with the largest gain, is pruned on rows it did not grow on, and
what it covers leaves. The list becomes one conditional expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import written
from .common import fold, split_words

WINDOW = 8
#: Rules and conditions in a rule at most; thresholds tried per statistic.
RULES, CONDITIONS, THRESHOLDS = 8, 3, 24
#: A rule must be right for this share of the rows it covers on the pruning part, and cover so many bad rows there.
PRECISION, SUPPORT = 0.9, 3
STATISTICS = ["n_words", "mean_chars", "symbol_share", "dup_share", "repeat_share", "short_share", "upper_share", "mark_share"]


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without its text, with the base counts of the whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an
    earlier line), ``n_repeat_words`` (words in 8-word windows that occur twice or more), and further counts that
    the rules use. A null text counts as empty; all counts of an empty text are zero. The columns' names must be
    new. A window is compared by a 64-bit hash within its text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in documents.columns if c != text]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step1 = documents.select(*rest, split_words(t).alias("qr_words"), lines.alias("qr_lines"), t.alias("qr_text"))
    n = F.size("qr_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("qr_words", i, F.lit(WINDOW))))
    step2 = step1.select(
        *rest, n.cast("long").alias("n_words"), F.length(F.array_join("qr_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("qr_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("qr_lines").alias("qr_n_lines"),
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("qr_words", lambda w: F.length(w) <= 3)).alias("qr_short"),
        F.size(F.filter("qr_words", lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"))).alias("qr_upper"),
        F.size(F.filter("qr_words", lambda w: w.rlike(r"[!?#*$%&|<>]$"))).alias("qr_marks"),
        hashes.alias("qr_hashes"))
    sorted_ = F.when(F.size(F.array_distinct("qr_hashes")) < F.size("qr_hashes"),
                     F.array_sort(F.transform("qr_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step3 = step2.withColumn("qr_sorted", sorted_).drop("qr_hashes")
    same = lambda a, i: F.coalesce(F.get("qr_sorted", i)["h"] == a["h"], F.lit(False))
    again = F.filter("qr_sorted", lambda a, i: ((i > 0) & same(a, i - 1)) | same(a, i + 1))
    step4 = step3.withColumn("qr_again", F.array_sort(F.transform(again, lambda a: a["i"]))).drop("qr_sorted")
    # Windows that start within eight words of the next one share words: each adds the gap to the next, the last eight.
    gaps = F.transform("qr_again", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get("qr_again", j + 1) - s, F.lit(WINDOW))))
    repeat = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    return step4.withColumn("n_repeat_words", repeat).drop("qr_again")


def _shares() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {"n_words": F.col("n_words").cast("double"), "mean_chars": per_word("word_chars"), "symbol_share": per_word("n_symbols"),
            "dup_share": F.col("n_dup_lines") / F.greatest(F.col("qr_n_lines"), F.lit(1)), "repeat_share": per_word("n_repeat_words"),
            "short_share": per_word("qr_short"), "upper_share": per_word("qr_upper"), "mark_share": per_word("qr_marks")}


Condition = tuple[str, str, float]


def holds(rule: list[Condition]) -> Column:
    """A rule as a condition."""
    out = F.lit(True)
    for name, sign, value in rule:
        out = out & (F.col(name) >= value if sign == ">=" else F.col(name) < value)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(holds(rule), i) if out is None else out.when(holds(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def _gain(p0, n0, p1, n1):
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def learn(rows: DataFrame) -> list[list[Condition]]:
    """Rules for bad rows from ``rows`` with STATISTICS and booleans ``bad`` and ``grow``.

    Every number that decides is a count over all rows; the driver receives counts per statistic and threshold only.
    """
    good_rows = rows.where("bad is not null")
    quantiles = good_rows.where("grow").agg(*[F.percentile_approx(c, F.array(*[F.lit((i + 0.5) / THRESHOLDS) for i in range(THRESHOLDS)])).alias(c)
                                              for c in STATISTICS],
                                            *[F.percentile_approx(F.when(F.col("bad"), F.col(c)), F.array(*[F.lit((i + 0.5) / THRESHOLDS) for i in range(THRESHOLDS)])).alias(f"bad_{c}")
                                              for c in STATISTICS]).first()
    cuts = {c: sorted({x for q in (quantiles[c], quantiles[f"bad_{c}"]) for x in q or []}) for c in STATISTICS}
    found: list[list[Condition]] = []
    if not any(cuts.values()):
        return found
    while len(found) < RULES:
        left = good_rows.where(verdict(found) == 0)
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            p0, n0, best = _best(left.where(F.col("grow") & holds(rule)), cuts)
            if not p0 or not n0 or best is None or best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        tried = [rule[:i] for i in range(1, len(rule) + 1)]
        checks = left.where("not grow").agg(*[F.count_if(holds(r) & (F.col("bad") == b)).alias(f"{'p' if b else 'n'}{i}")
                                              for i, r in enumerate(tried) for b in (True, False)]).first()
        worth = [(checks[f"p{i}"] - checks[f"n{i}"]) / (checks[f"p{i}"] + checks[f"n{i}"] + 2) for i in range(len(tried))]
        i = max(range(len(tried)), key=lambda i: (worth[i], -i))
        p, n = checks[f"p{i}"], checks[f"n{i}"]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        found.append(tried[i])
    return found


def _best(rows: DataFrame, cuts: dict[str, list[float]]):
    """Bad and good rows, and the condition with the largest gain."""
    def step(c):  # how many thresholds a value reaches
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[c]]), lambda x: x <= F.col(c)))
    used = [c for c in STATISTICS if cuts[c]]
    cells = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), step(c).alias("k")) for c in used])).alias("x"))
    counts = cells.groupBy("x.c", "x.k").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["c"], {})[r["k"]] = (r["p"], r["n"])
    if not by:
        return 0, 0, None
    any_ = next(iter(by.values())).values()
    p0, n0 = sum(x[0] for x in any_), sum(x[1] for x in any_)
    best = None
    if p0:
        for c in sorted(by):
            for k, value in enumerate(cuts[c], 1):
                p1 = sum(p for j, (p, _) in by[c].items() if j >= k)
                n1 = sum(n for j, (_, n) in by[c].items() if j >= k)
                for sign, p, n in ((">=", p1, n1), ("<", p0 - p1, n0 - n1)):
                    g = _gain(p0, n0, p, n)
                    if best is None or g > best[0] + 1e-9:
                        best = (g, (c, sign, float(value)))
    return p0, n0, best


def judge(documents: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[DataFrame, list]:
    """Every row of ``documents(id, text)`` with its counts, ``base_failed``, ``rule`` and ``kept``; and the rules.

    ``base_failed`` is true for fewer than 20 words, or more than 30 per cent in repeated windows; such rows are not kept. Others
    are kept unless a learned rule holds (``rule`` is its number, 0 if none). A document with several labels has
    the worst; labels without a document, null ids and null labels teach nothing. Without labels there are no rules.
    """
    stats = statistics(documents.select(id_, text), text)
    shares = {k: c for k, c in _shares().items() if k != "n_words"}
    table = written(stats.withColumns(shares).drop("qr_n_lines", "qr_short", "qr_upper", "qr_marks"), "rules-stats")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    worst = labels.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("label_id")).agg((F.min(quality) == 0).alias("bad"))
    known = table.where("not base_failed").join(worst, F.col(id_) == F.col("label_id")).select(
        "bad", (fold(F.col(id_), 3) != 0).alias("grow"), *[F.col(c).cast("double").alias(c) for c in STATISTICS])
    found = learn(written(known, "rules-labelled"))
    judged = table.withColumn("rule", verdict(found))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), found
