"""Choosing, widening and lengthening tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..state import maybe_broadcast, written, written_counted

# A key with more than this share of all rows is dealt out over several tasks.
HOT_SHARE = 1 / 64


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select and rename: new name -> source column."""
    return df.select(*[F.col(src).alias(new) for new, src in columns.items()])


def with_period(df: DataFrame, period: str, keep: list[str]) -> DataFrame:
    """Keep ``keep`` plus the period column as ``period``; a missing period is left out."""
    extra = [F.col(period).alias("period")] if period in df.columns else []
    return df.select(*keep, *extra)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def drop_matching(df: DataFrame, text: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if text.lower() in c.lower()])


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ("Lon", "Lat")) -> list[str]:
    """Numeric columns whose name holds none of ``without`` (any case)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
            and not any(t.lower() in f.name.lower() for t in without)]


def drop_geometry(df: DataFrame) -> DataFrame:
    return df.drop("parts")


def recode_by(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Replace the codes of ``column`` by a table ``labels(code, label)``; codes it lacks stay, NULL too.

    For dictionaries too long for an expression. A code listed twice takes its smallest label. The
    dictionary is broadcast only if its counted rows are few.
    """
    one = labels.groupBy(F.col("code").alias("recoded_from")).agg(F.min("label").alias("recoded_to"))
    known, seen = written_counted(one, "labels")
    found = df.join(maybe_broadcast(known, seen["rows"]), F.col(column) == F.col("recoded_from"), "left")
    return found.withColumn(column, F.coalesce("recoded_to", column)).drop("recoded_from", "recoded_to")


def known_units(df: DataFrame, column: str = "entity") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_points(df: DataFrame, points: DataFrame) -> DataFrame:
    """Rows equal to some row of ``points`` on all its columns."""
    return df.join(points, points.columns, "left_semi")


def join_geometry(boundaries: DataFrame, panel: DataFrame) -> DataFrame:
    """Every boundary with its panel rows; boundaries without rows stay with NULLs.

    A unit may own a large share of the panel. Units whose counted share is above HOT_SHARE, of which there are
    fewer than 1 / HOT_SHARE, have their rows dealt out and their boundary repeated once for each
    such share, so no task gets more than about one share of the panel, whatever the sizes of the two tables.
    """
    counts = panel.where("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = {r["code"]: int(r["n"] / (total * HOT_SHARE)) + 1 for r in counts.where(F.col("n") > total * HOT_SHARE).collect()}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col("code")], F.lit(1)) if hot else F.lit(1)
    dealt = panel.withColumn("deal", F.pmod(F.xxhash64(*panel.columns), parts).cast("int"))
    spread = boundaries.withColumn("deal", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    found = dealt.join(spread.hint("merge"), ["code", "deal"]).drop("deal")
    alone = boundaries.join(counts.select("code"), "code", "left_anti")
    return alone.unionByName(found, allowMissingColumns=True).select(
        *boundaries.columns, *[c for c in panel.columns if c != "code"])


def pivot_variables(panel: DataFrame, variables: list[str], value: str,
                    keys: tuple[str, ...] = ("code", "entity")) -> DataFrame:
    """One row per unit, one column per variable; a missing cell is NULL.

    One hash aggregate with map-side partial sums. Two rows for one cell are an error.
    """
    def cell(v: str):
        mine = F.col("variable") == v
        twice = F.raise_error(F.lit(f"more than one row per unit for variable {v}")).cast("double")
        return F.when(F.count_if(mine) > 1, twice).otherwise(
            F.max(F.when(mine, F.col(value)))).alias(v)

    wanted = panel.where(F.col("variable").isin(variables))
    return wanted.groupBy(*keys).agg(*[cell(v) for v in variables])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def unpivot_rest(df: DataFrame, first: int = 2, name: str = "name", value: str = "value") -> DataFrame:
    """Unpivot from column number ``first`` to the last one; the leading columns stay."""
    return df.unpivot(df.columns[:first], df.columns[first:], name, value)


def unpivot_criteria(indices: DataFrame, paired: bool = True) -> DataFrame:
    """(index_ch, alpha_star_ch), (index_max, alpha_star_max) columns to rows.

    ``paired=False`` crosses the two criteria with the two weights, four rows per input row.
    """
    values = {"Index_ch": "index_ch", "Index_max": "index_max"}
    alphas = {"alpha_star_ch": "alpha_star_ch", "alpha_star_max": "alpha_star_max"}
    combos = [(v, a) for v in values for a in alphas
              if not paired or v.rsplit("_", 1)[1] == a.rsplit("_", 1)[1]]
    rows = F.array(*[F.struct(F.lit(v).alias("criterion"), F.col(values[v]).alias("index_val"),
                              F.lit(a).alias("alpha"), F.col(alphas[a]).alias("alpha_val"))
                     for v, a in combos])
    return indices.select("index", "k", F.explode(rows).alias("r")).select("index", "k", "r.*")


def bulk_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def stacked(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def row_index(df: DataFrame, order: str) -> DataFrame:
    """Number rows 1..n in the order of a unique column, without one task seeing all rows.

    A range-partitioned sort is written with (partition, row in partition) ids; the
    running number is that row's offset plus the sizes of the partitions before it.
    """
    split = F.shiftrightunsigned(F.col("pos"), 33)
    sorted_rows = written(df.orderBy(order).withColumn("pos", F.monotonically_increasing_id()),
                          "row-index")
    sizes = sorted_rows.groupBy(split.alias("part")).count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    offset = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (sorted_rows.withColumn("part", split).join(starts, "part")
            .withColumn("idx", F.col("start") + offset + 1).drop("part", "pos", "start"))
