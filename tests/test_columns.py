import pytest
from pyspark.sql import functions as F

from wardfield.functions import columns as C
from wardfield.operators import reshape


def one(spark, expr, **values):
    cols = ", ".join(f"{v} AS {k}" for k, v in values.items()) or "1 AS x"
    return spark.sql(f"SELECT {cols}").select(expr.alias("r")).first()["r"]


def test_pct_change_of_zero_is_null(spark):
    assert one(spark, C.pct_change(F.col("v"), F.col("z")), v="5D", z="0D") is None
    assert one(spark, C.pct_change(F.col("v"), F.col("z")), v="5D", z="4D") == 25.0


def test_cast_numeric_keeps_bad_text_out(spark):
    assert one(spark, C.cast_numeric(F.col("t")), t="' 1.5 '") == 1.5
    assert one(spark, C.cast_numeric(F.col("t")), t="'x'") is None


@pytest.mark.parametrize("step,text", [(0, "0"), (5, "0.05"), (29, "0.29"), (60, "0.6"), (62, "0.62"), (100, "1")])
def test_alpha_text(spark, step, text):
    assert one(spark, C.alpha_text(F.col("s")), s=str(step)) == text


def test_pattern_order_matters(spark):
    assert one(spark, C.recode_matching(F.col("c"), C.CRITERION_LABELS), c="'Index_max'") == "Morelli et al. (2024)"
    assert one(spark, C.recode_matching(F.col("c"), C.CRITERION_LABELS), c="'Index_ch'") == "Chavent et al. (2018)"
    assert one(spark, C.recode_matching(F.col("c"), C.CRITERION_LABELS), c="'other'") == "other"


def test_sign_part(spark):
    assert one(spark, C.sign_part(F.col("v")), v="0D") == "up"
    assert one(spark, C.sign_part(F.col("v")), v="-1D") == "down"
    assert one(spark, C.sign_part(F.col("v")), v="CAST(NULL AS DOUBLE)") is None


def test_pivot_refuses_duplicate_cells(spark):
    rows = [("A", "a", "R12", 1.0), ("A", "a", "R12", 2.0)]
    df = spark.createDataFrame(rows, "code string, entity string, variable string, v double")
    with pytest.raises(Exception, match="more than one row per unit"):
        reshape.pivot_variables(df, ["R12"], "v").collect()


def test_pivot_missing_cell_is_null(spark):
    df = spark.createDataFrame([("A", "a", "R12", 1.0)], "code string, entity string, variable string, v double")
    assert reshape.pivot_variables(df, ["R12", "R34"], "v").first()["R34"] is None


def test_drop_and_pick_by_name(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 3.0, 4)], "code string, R12 double, oilShare double, Lon double, n int")
    assert reshape.drop_matching(df, "share").columns == ["code", "R12", "Lon", "n"]
    assert reshape.numeric_columns(df) == ["R12", "oilShare", "n"]


def test_row_index_numbers_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("id")).repartition(7)
    got = {r["id"]: r["idx"] for r in reshape.row_index(df, "id").collect()}
    assert got == {i: i + 1 for i in range(500)}


def test_unpivot_criteria_row_counts(spark):
    df = spark.createDataFrame([("Sil", 2, 10, 0.1, 20, 0.2)],
                               "index string, k int, alpha_star_ch int, index_ch double, alpha_star_max int, index_max double")
    assert reshape.unpivot_criteria(df).count() == 2
    crossed = reshape.unpivot_criteria(df, paired=False)
    assert crossed.count() == 4 and crossed.select("criterion", "index_val").distinct().count() == 2


def test_long_dictionaries_are_joined(spark):
    df = spark.createDataFrame([("c1", 1), ("c299", 2), ("other", 3), (None, 4)], "code string, x int")
    labels = spark.createDataFrame([(f"c{i}", f"label {i}") for i in range(300)] + [("c1", "a smaller label")], "code string, label string")
    got = {r["x"]: r["code"] for r in reshape.recode_by(df, "code", labels).collect()}
    assert got == {1: "a smaller label", 2: "label 299", 3: "other", 4: None}
