"""The engine's inputs derived from the star-schema tables.

Each view is one pass over the fact tables; rows are summed per order and per
customer before they move, so no shuffle carries single line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import star

EARLY, FULL = "avg_1995_1998", "avg_1995_2001"
PERIODS = [EARLY, FULL]
VARIABLES = ["R12", "R34", "hd40", "HDI", "rgdpna", "TradeOpenness", "cdd", "tas", "UrgentShare"]
EARLY_END = "1999-01-01"


def nation_code(key):
    return F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))


def coords(key):
    """Tie-free synthetic position for an integer key."""
    k = key.cast("double")
    return [((k * 137.507764) % 360 - 180).alias("lon"), ((k * 77.319) % 140 - 70).alias("lat")]


def line_sums() -> dict:
    """Sums over the lines of an order."""
    return {"n": F.count(F.lit(1)), "tax": F.sum("l_tax"), "qty": F.sum("l_quantity"),
            "ext": F.sum("l_extendedprice"), "disc": F.sum("l_discount"),
            "net": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))}


def order_sums() -> dict:
    """The order's own columns, weighted by its line count."""
    return {"price": F.col("o_totalprice") * F.col("n"),
            "price2": F.col("o_totalprice") * F.col("o_totalprice") * F.col("n"),
            "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", F.col("n")).otherwise(0)}


_SUMS = ["n", "tax", "qty", "ext", "disc", "net", "price", "price2", "urgent"]


def _measures(p: str) -> dict:
    """The nine variables from the summed columns of period prefix ``p``."""
    s = {c: F.col(f"{p}_{c}") for c in _SUMS}
    mean = {c: F.try_divide(s[c], s["n"]) for c in _SUMS}
    spread = F.sqrt(F.try_divide(s["price2"] - s["price"] * mean["price"], s["n"] - 1))
    return {"R12": F.col("r12"), "R34": mean["price"], "hd40": mean["tax"], "HDI": mean["qty"],
            "rgdpna": s["ext"], "TradeOpenness": mean["disc"], "cdd": mean["net"],
            "tas": spread, "UrgentShare": mean["urgent"]}


def nation_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Summed columns per nation for both periods: prefixes ``e`` (early) and ``f`` (full)."""
    lines = star(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *[e.alias(c) for c, e in line_sums().items()])
    orders = star(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumns(order_sums())
    early = F.col("o_orderdate") < F.lit(EARLY_END).cast("timestamp")
    per_customer = joined.groupBy("o_custkey").agg(
        *[F.sum(F.when(early, F.col(c))).alias(f"e_{c}") for c in _SUMS],
        *[F.sum(c).alias(f"f_{c}") for c in _SUMS])
    customers = star(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return (customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
            .groupBy("c_nationkey")
            .agg(F.avg("c_acctbal").alias("r12"),
                 *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in "ef" for c in _SUMS]))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Long panel: one row per nation and variable, one column per period."""
    facts = nation_facts(spark, folder)
    early, full = _measures("e"), _measures("f")
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), early[v].cast("double").alias(EARLY),
                               full[v].cast("double").alias(FULL)) for v in VARIABLES])
    nation = star(spark, folder, "nation")
    return (facts.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(nation_code(F.col("n_nationkey")).alias("code"),
                    F.col("n_name").alias("entity"), F.explode(cells).alias("cell"))
            .select("code", "entity", "cell.*"))


def nation_points(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return star(spark, folder, "nation").select(nation_code(key).alias("code"), *coords(key))


def supplier_units(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier: four features, a position, and its nation as a given partition."""
    lines = star(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("avg_qty"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("n_lines"))
    key = F.col("s_suppkey")
    return (star(spark, folder, "supplier").join(lines, key == F.col("l_suppkey"))
            .select(key.alias("unit"), F.col("s_nationkey").alias("nation"),
                    F.col("s_acctbal").alias("acctbal"), "avg_qty", "revenue", "n_lines",
                    *coords(key)))


def vec_units(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder, "embeddings").select(
        F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("x"),
        "label", (F.col("vec_id") % 7).cast("int").alias("mod7"))


def _square(lon, lat, width, height):
    def at(dx, dy):
        return F.struct((lon + dx).cast("double").alias("lon"), (lat + dy).cast("double").alias("lat"))
    zero = F.lit(0.0)
    return F.array(at(zero, zero), at(width, zero), at(width, height), at(zero, height),
                   at(zero, zero))


def raw_boundaries(spark: SparkSession, folder: str, touching: bool = False) -> DataFrame:
    """A square per nation on a 5 x 5 grid, plus one dependency and one country without data.

    ``touching`` fills the grid cells, so neighbours share edges.
    """
    k = F.col("n_nationkey")
    squares = star(spark, folder, "nation").select(
        nation_code(k).alias("iso_a3_eh"), k,
        (-100.0 + 40 * (k % 5)).alias("lon"), (-50.0 + 20 * F.floor(k / 5)).alias("lat"))
    side = (8.0 + 2 * (k % 3))
    width, height = (F.lit(40.0), F.lit(20.0)) if touching else (side, side)
    main = _part(0, _square(F.col("lon"), F.col("lat"), width, height))
    islet = _part(1, _square(F.col("lon") + 14, F.col("lat") + 14, F.lit(1.0), F.lit(1.0)))
    parts = F.array(main) if touching else F.when(k % 4 == 0, F.array(main, islet)).otherwise(
        F.array(main))
    real = squares.select("iso_a3_eh", F.lit("Country").alias("type"), parts.alias("parts"))
    extra_kind = F.explode(F.array(
        F.struct(F.lit("X98").alias("iso_a3_eh"), F.lit("Country").alias("type"), F.lit(150.0).alias("lon")),
        F.struct(F.lit("X99").alias("iso_a3_eh"), F.lit("Dependency").alias("type"), F.lit(165.0).alias("lon"))))
    extras = (squares.where(k == 0).select(extra_kind.alias("e"))
              .select("e.iso_a3_eh", "e.type", F.array(
                  _part(0, _square(F.col("e.lon"), F.lit(-20.0), F.lit(5.0), F.lit(5.0)))).alias("parts")))
    return real.unionByName(extras)


def _part(part_id: int, ring, *holes):
    return F.struct(F.lit(part_id).alias("part_id"), ring.alias("ring"),
                    F.array(*holes).cast("array<array<struct<lon:double,lat:double>>>").alias("holes"))


def _inset(lon, lat, side):
    """A square and its hole, which lies off the middle."""
    return _square(lon, lat, side, side), _square(lon + 0.5, lat + 1, side - 2, side - 2)


def _fraction(k, step: float):
    """Scattered number in [0, 1) of a key."""
    return (k * step) % 1


def scattered_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """(code, parts): a square per nation, off the grid so that no two distances tie.

    Every third nation is a frame round a lake; every second owns a smaller square as well, which has the larger area where
    the lake has taken most of the frame.
    """
    k = F.col("n_nationkey")
    named = star(spark, folder, "nation").select(
        nation_code(k).alias("code"), k,
        (-100.0 + 40 * (k % 5) + 4 * _fraction(k, 0.6180339)).alias("lon"),
        (-50.0 + 20 * F.floor(k / 5) + 3 * _fraction(k, 0.7548777)).alias("lat"),
        (8.0 + 2 * (k % 3) + 0.5 * _fraction(k, 0.5698403)).alias("side"))
    outer, lake = _inset(F.col("lon"), F.col("lat"), F.col("side"))
    main = F.when(k % 3 == 0, _part(0, outer, lake)).otherwise(_part(0, outer))
    second = _part(1, _square(F.col("lon") + 20, F.col("lat") + 2, F.lit(6.0), F.lit(6.0)))
    return named.select("code", F.when(k % 2 == 0, F.array(main, second)).otherwise(F.array(main)).alias("parts"))


def boundary_cases(spark: SparkSession, folder: str) -> DataFrame:
    """(code, parts): five nations a region of the key that touch, cross, nest, lie in each other's lakes, or span the antimeridian."""
    k = F.col("n_nationkey")
    m = F.col("m")
    named = star(spark, folder, "nation").select(
        nation_code(k).alias("code"), F.floor(k / 5).cast("int").alias("case"), (k % 5).cast("double").alias("m"))
    lon = (F.when(F.col("case") == 0, -100.0 + 10 * m).when(F.col("case") == 1, -100.0 + 6 * m).when(F.col("case") == 2, -10.0 + 2 * m)
           .when(F.col("case") == 3, 60.0 + 3 * m).otherwise(167.25 + 6 * m))
    lat = (F.when(F.col("case") == 0, F.lit(-50.0)).when(F.col("case") == 1, -20.0 + 3 * m).when(F.col("case") == 2, 5.0 + 2 * m)
           .when(F.col("case") == 3, -40.0 + 3 * m).otherwise(20.0 + m))
    side = (F.when(F.col("case") < 2, F.lit(10.0)).when(F.col("case") == 2, 20.0 - 4 * m).when(F.col("case") == 3, 30.0 - 6 * m)
            .otherwise(F.lit(4.0)))
    placed = named.select("code", "case", lon.alias("lon"), lat.alias("lat"), side.alias("side"))
    outer, lake = _inset(F.col("lon"), F.col("lat"), F.col("side"))
    framed = placed.select("code", F.when(F.col("case") == 3, _part(0, outer, lake)).otherwise(_part(0, outer)).alias("part"))

    def wrapped(ring):
        return F.transform(ring, lambda p: F.struct(((p["lon"] + 180) % 360 - 180).alias("lon"), p["lat"].alias("lat")))

    return framed.select("code", F.array(F.struct(
        F.col("part.part_id").alias("part_id"), wrapped(F.col("part.ring")).alias("ring"),
        F.transform("part.holes", wrapped).alias("holes"))).alias("parts"))
