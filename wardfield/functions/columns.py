"""Column helpers: null-safe arithmetic, labels and keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: index codes, chart labels and criteria ------------------
INDEX_LABELS = {
    "Sil": "Silhouette (Rousseeuw, 1987) -- Max",
    "Dunn": "Dunn (1974) -- Max",
    "McClain": "McClain and Rao (1975) -- Min",
    "Cindex": "C-index (Hubert and Levin, 1976) -- Min",
    "CH": "Calinski and Harabasz (1974) -- Max",
}
CRITERION_LABELS = [
    ("max", "Morelli et al. (2024)"),
    ("ch", "Chavent et al. (2018)"),
]
# The indices whose best value is the smallest one.
MIN_IS_BEST = ["Cindex", "McClain"]
# ----------------------------------------------------------------------------


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (a plain division raises in ANSI mode)."""
    return F.try_divide(a, b)


def no_nan(c: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not reach a max."""
    return F.when(F.isnan(c), None).otherwise(c)


def pct_change(value: Column, base: Column) -> Column:
    return safe_div(value - base, base) * 100


def round_label(c: Column, digits: int = 2) -> Column:
    return F.round(c, digits)


def cast_numeric(c: Column) -> Column:
    """Text to number; text that is no number becomes NULL."""
    return F.trim(c).try_cast("double")


def cast_label(c: Column) -> Column:
    return F.trim(c.cast("string"))


def recode(c: Column, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace known codes, keep the others (or ``default``). Long dictionaries belong in a table: see ``reshape.recode_by``."""
    other = c if default is None else default
    out = None
    for code, label in labels.items():
        out = (F if out is None else out).when(c == code, F.lit(label))
    return other if out is None else out.otherwise(other)


def match_pattern(c: Column, text: str) -> Column:
    return c.contains(text)


def recode_matching(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """First rule whose text occurs in the value wins; unmatched values stay."""
    out = None
    for text, label in rules:
        out = (F if out is None else out).when(match_pattern(c, text), F.lit(label))
    return c if out is None else out.otherwise(c)


def in_list(c: Column, values: Iterable) -> Column:
    return c.isin(list(values))


def not_in_list(c: Column, values: Iterable) -> Column:
    return ~c.isin(list(values))


def sign_part(c: Column) -> Column:
    """'up' for values >= 0, 'down' below, NULL where there is no value."""
    return F.when(c >= 0, "up").when(c < 0, "down")


def alpha_of(step: Column) -> Column:
    return step / F.lit(100.0)


def alpha_text(step: Column) -> Column:
    """0, 0.6, 0.62, 1: the shortest decimal form of step / 100."""
    whole, rest = F.floor(step / 100).cast("string"), F.pmod(step, F.lit(100))
    digits = F.when(rest % 10 == 0, (rest / 10).cast("int").cast("string")).otherwise(
        F.lpad(rest.cast("string"), 2, "0"))
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), digits))


def combo_key(k: Column, step: Column) -> Column:
    return F.concat(F.lit("K="), k.cast("string"), F.lit(" & Alpha="), alpha_text(step))


def combo_column(k: Column, step: Column) -> Column:
    return F.concat(F.lit("Cluster_K="), k.cast("string"), F.lit("Alpha="), alpha_text(step))


def scenario_key(scenario: Column, combo: Column) -> Column:
    return F.concat(scenario, F.lit(" - "), combo)
