"""Model tables over the driver's tables: each view in DataFrame form and as a SQL sub-query.

Cells are the nations on a periodic 5 x 5 lattice; agents are customers, predators suppliers;
genomes come from digests, ancestors from order numbers, rasters from line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import grid
from cohortspark.registry import cte

SIDE = 5
RASTER_H, RASTER_W = 12, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("cell"))
    x, y = F.pmod("cell", F.lit(SIDE)), F.floor(F.col("cell") / SIDE).cast("int")
    return n.select("cell", x.alias("x"), y.alias("y"), (x * 10 - 20).cast("double").alias("lon"), (y * 10 - 20).cast("double").alias("lat"))


cte("cells", "SELECT n_nationkey AS cell, n_nationkey % 5 AS x, n_nationkey // 5 AS y, CAST((n_nationkey % 5) * 10 - 20 AS DOUBLE) AS lon, CAST((n_nationkey // 5) * 10 - 20 AS DOUBLE) AS lat FROM nation")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return grid.lattice_edges(cells(spark, sf), SIDE, SIDE, periodic=True)


cte("edges", """SELECT cell, k, CASE k WHEN 0 THEN y * 5 + (x + 4) % 5 WHEN 1 THEN ((y + 4) % 5) * 5 + x
  WHEN 2 THEN y * 5 + (x + 1) % 5 ELSE ((y + 1) % 5) * 5 + x END AS nbr FROM {cells}, (VALUES (0), (1), (2), (3)) t(k)""")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def env(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell; means are made of whole cents, so that no order of summation shows."""
    mean = F.floor(F.sum(_cents("c_acctbal")) / F.count("*")) / 100.0
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(mean.alias("mean"))
    k = F.col("cell")
    return c.select(
        "cell",
        (F.col("mean") - 4500.0).alias("altitude"),
        (F.pmod(k, F.lit(5)) * 0.2).alias("water"),
        (k % 7 == 0).alias("ice"),
        (k % 3 == 0).alias("coastal"),
        (F.pmod(k * 7, F.lit(33)) - 4).cast("double").alias("temp"),
        (F.pmod(k * 97, F.lit(1500)) + 200).cast("double").alias("rain"),
        (F.pmod(k * 131, F.lit(1900)) + 50).cast("double").alias("npp"),
    )


cte("env", """SELECT c_nationkey AS cell, floor(sum(CAST(round(c_acctbal * 100) AS BIGINT)) / count(*)) / 100.0 - 4500.0 AS altitude,
  (c_nationkey % 5) * CAST(0.2 AS DOUBLE) AS water, c_nationkey % 7 = 0 AS ice, c_nationkey % 3 = 0 AS coastal, CAST(c_nationkey * 7 % 33 - 4 AS DOUBLE) AS temp,
  CAST(c_nationkey * 97 % 1500 + 200 AS DOUBLE) AS rain, CAST(c_nationkey * 131 % 1900 + 50 AS DOUBLE) AS npp FROM customer GROUP BY c_nationkey""")


def agents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        i.alias("id"),
        F.col("c_nationkey").alias("cell"),
        F.when(i % 17 == 0, 0).when(i % 11 == 0, 13).when(i % 5 == 0, 1).otherwise(5).alias("life_state"),
        (-(i % 60)).cast("double").alias("birth_time"),
        (i % 2).cast("int").alias("gender"),
        (-(i % 13)).cast("double").alias("last_birth"),
        (F.abs("c_acctbal") / 1000).alias("mass"),
    )


cte("agents", """SELECT c_custkey AS id, c_nationkey AS cell, CASE WHEN c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN 13 WHEN c_custkey % 5 = 0 THEN 1 ELSE 5 END AS life_state,
  CAST(-(c_custkey % 60) AS DOUBLE) AS birth_time, CAST(c_custkey % 2 AS INTEGER) AS gender, CAST(-(c_custkey % 13) AS DOUBLE) AS last_birth, abs(c_acctbal) / 1000 AS mass FROM customer""")


def predators(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        i.alias("id"), F.col("s_nationkey").alias("cell"), F.lit(5).alias("life_state"), (-(i % 40)).cast("double").alias("birth_time"),
        (i % 2).cast("int").alias("gender"), (F.abs("s_acctbal") / 1000).alias("mass"),
    )


cte("predators", "SELECT s_suppkey AS id, s_nationkey AS cell, 5 AS life_state, CAST(-(s_suppkey % 40) AS DOUBLE) AS birth_time, CAST(s_suppkey % 2 AS INTEGER) AS gender, abs(s_acctbal) / 1000 AS mass FROM supplier")


def crowd(spark: SparkSession, sf: str) -> DataFrame:
    """Agents of the benchmark: one per order, in its customer's cell."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cell"))
    return o.join(c, "o_custkey").select("id", "cell", (F.col("id") % 2).cast("int").alias("gender"), F.lit(5).alias("life_state"))


cte("crowd", "SELECT o_orderkey AS id, c_nationkey AS cell, CAST(o_orderkey % 2 AS INTEGER) AS gender, 5 AS life_state FROM orders JOIN customer ON o_custkey = c_custkey")


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals of goods as moves: from the supplier's cell to the customer's, day by day."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("source"))
    days = F.datediff("l_shipdate", F.lit("1990-01-01"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "source", "target", days.alias("step"))


cte("moves", """SELECT l_orderkey * 10 + l_linenumber AS id, s_nationkey AS source, c_nationkey AS target, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS step
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")


def _piece(tag: str, at: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(tag), F.col("id").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")


def genomes(spark: SparkSession, sf: str) -> DataFrame:
    """Two strands of three 32-bit blocks (one bit a locus) for every customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cell"))
    return c.select("id", "cell", *(F.array(*(_piece(s, 1 + 8 * b) for b in range(3))).alias(s) for s in ("strand1", "strand2")))


def _strand_sql(s: str) -> str:
    return "[" + ", ".join(f"('0x' || substr(md5(concat_ws('|', '{s}', c_custkey)), {1 + 8 * b}, 8))::BIGINT" for b in range(3)) + f"] AS {s}"


cte("genomes", f"SELECT c_custkey AS id, c_nationkey AS cell, {_strand_sql('strand1')}, {_strand_sql('strand2')} FROM customer")
cte("sampled_genomes", "SELECT * FROM {genomes} WHERE id % 50 = 0")


def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of parents: both have smaller numbers, or both are 0 (founders)."""
    i = F.col("o_orderkey")
    mom, dad = i - 1 - i * 7 % 200, i - 1 - i * 13 % 170
    born = (mom > 0) & (dad > 0)
    return table(spark, sf, "orders").select(
        i.alias("id"), F.when(born, mom).otherwise(0).alias("mom"), F.when(born, dad).otherwise(0).alias("dad"),
        (i % 2).cast("int").alias("gender"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("time"), (i % 25).cast("int").alias("cell"),
    )


cte("ancestors", """SELECT o_orderkey AS id, CASE WHEN o_orderkey - 1 - o_orderkey * 7 % 200 > 0 AND o_orderkey - 1 - o_orderkey * 13 % 170 > 0 THEN o_orderkey - 1 - o_orderkey * 7 % 200 ELSE 0 END AS mom,
  CASE WHEN o_orderkey - 1 - o_orderkey * 7 % 200 > 0 AND o_orderkey - 1 - o_orderkey * 13 % 170 > 0 THEN o_orderkey - 1 - o_orderkey * 13 % 170 ELSE 0 END AS dad,
  CAST(o_orderkey % 2 AS INTEGER) AS gender, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS time, CAST(o_orderkey % 25 AS INTEGER) AS cell FROM orders""")


def raster(spark: SparkSession, sf: str, which: str = "a") -> DataFrame:
    """A 12 x 10 map with undefined (NaN) pixels: mean quantity, or summed discount in percent."""
    li = table(spark, sf, "lineitem")
    y, x = F.pmod("l_partkey", F.lit(RASTER_H)).cast("int"), F.pmod("l_suppkey", F.lit(RASTER_W)).cast("int")
    if which == "a":
        v, hole = F.floor(F.sum(F.col("l_quantity").cast("bigint")) * 100 / F.count("*")) / 100.0, 11
    else:
        v, hole = F.pmod(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")), F.lit(50)).cast("double"), 13
    grouped = li.groupBy(y.alias("y"), x.alias("x")).agg(v.alias("v"))
    nan = (F.col("y") * RASTER_W + F.col("x")) % hole == 0
    return grouped.select("y", "x", F.when(nan, F.lit(float("nan"))).otherwise(F.col("v")).alias("v"))


cte("raster_a", """SELECT y, x, CASE WHEN (y * 10 + x) % 11 = 0 THEN 'nan'::DOUBLE ELSE v END AS v FROM (
  SELECT CAST(l_partkey % 12 AS INTEGER) AS y, CAST(l_suppkey % 10 AS INTEGER) AS x, floor(sum(CAST(l_quantity AS BIGINT)) * 100 / count(*)) / 100.0 AS v FROM lineitem GROUP BY 1, 2)""")
cte("raster_b", """SELECT y, x, CASE WHEN (y * 10 + x) % 13 = 0 THEN 'nan'::DOUBLE ELSE v END AS v FROM (
  SELECT CAST(l_partkey % 12 AS INTEGER) AS y, CAST(l_suppkey % 10 AS INTEGER) AS x, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 50 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)""")


def locations(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling places: every fourth cell, with a radius and a number of agents (-1: all)."""
    c = cells(spark, sf).where("cell % 4 = 1")
    n = F.when(F.col("cell") % 8 == 1, F.lit(3)).otherwise(F.lit(-1))
    return c.select(F.concat(F.lit("L"), F.lpad(F.col("cell").cast("string"), 2, "0")).alias("name"), "lon", "lat", (F.lit(900.0) + F.col("cell") * 40).alias("dist"), n.alias("num"))


cte("locations", "SELECT 'L' || lpad(CAST(cell AS VARCHAR), 2, '0') AS name, lon, lat, CAST(900.0 + cell * 40 AS DOUBLE) AS dist, CASE WHEN cell % 8 = 1 THEN 3 ELSE -1 END AS num FROM {cells} WHERE cell % 4 = 1")


def clean(c: str) -> Column:
    """NaN as null, for results that are compared."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(F.round(c, 6)).alias(c)
