"""Geometry that is derived from the relational tables, the same in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.functions import segments as S
from linework.schema import STYLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(v: Views) under a name, with SQL that gives the same rows."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql.strip()
        return f

    return keep


def r6(c: Column) -> Column:
    """Rounded to 6 decimals as the engine of the SQL does it, without a negative zero: the millionfold as a double, halves
    away from zero, a millionth of that. F.round goes by the decimal digits, which are on the other side of some halves."""
    many = F.abs(c) * 1e6
    whole = F.rint(many)
    whole = whole + F.when(many - whole == 0.5, 1.0).otherwise(0.0)
    return F.when(whole < float("inf"), F.signum(c) * whole / 1e6).otherwise(c) + F.lit(0.0)


class Views:
    """The derived tables. drawing_id is d, positions in a drawing are i."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def points(self) -> DataFrame:
        e = F.col("embedding")
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * 100, 3).alias("x"), F.round(e[1].cast("double") * 100, 3).alias("y"), "label")

    def vertices(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity")
        li = self.table("lineitem")
        return li.select(F.col("l_orderkey").alias("d"), (F.row_number().over(w) - 1).alias("i"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").cast("double").alias("y"))

    def segs(self) -> DataFrame:
        w = Window.partitionBy("d").orderBy("i")
        v = self.vertices().withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).where("x1 is not null")
        return v.select("d", "i", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")

    def lines(self) -> DataFrame:
        """segs as segment structs s."""
        return self.segs().withColumn("s", S.line("x0", "y0", "x1", "y1"))

    def ring_rows(self) -> DataFrame:
        """d, ring (array of points) of orders with at least three lines."""
        p = self.vertices().groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
        return p.where(F.size("p") >= 3).select("d", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))

    def boxes(self) -> DataFrame:
        p = self.table("part")
        k, h = F.col("p_partkey"), F.col("p_size") / 2.0
        cx, cy = (k * 37 % 1000) / 10.0, (k * 61 % 1000) / 10.0
        b = p.select((k % 5).alias("d"), k.alias("id"), (cx - h).alias("x_lo"), (cy - h).alias("y_lo"), (cx + h).alias("x_hi"), (cy + h).alias("y_hi"))
        return b.withColumn("area", (F.col("x_hi") - F.col("x_lo")) * (F.col("y_hi") - F.col("y_lo")))

    def arcs(self) -> DataFrame:
        k = F.col("p_partkey")
        deg = lambda c: (c % 360).cast("double") * F.lit(0.017453292519943295)
        a = self.table("part").select(k.alias("id"), ((k * 37 % 1000) / 10.0).alias("cx"), ((k * 61 % 1000) / 10.0).alias("cy"), F.col("p_size").cast("double").alias("r"), deg(k).alias("a0"), deg(k * 7 + 90).alias("a1"), (k % 2 == 0).alias("ccw"))
        return a.withColumn("s", S.arc("cx", "cy", "r", "a0", "a1", F.col("ccw")))

    def circles(self) -> DataFrame:
        return self.points().select("id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("label") + 1).cast("double").alias("r"), "label")

    def intervals(self) -> DataFrame:
        lo = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
        return self.table("events").select(F.col("user_id").alias("d"), "event_id", lo.alias("lo"), (lo + F.abs("value")).alias("hi"))

    def edges(self) -> DataFrame:
        """Closed outlines of orders as an edge table, for the drawing operators."""
        w = Window.partitionBy("d").orderBy("i")
        v = self.vertices().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("d"))).where("n >= 3")
        first = Window.partitionBy("d").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        v = v.withColumn("x1", F.coalesce(F.lead("x").over(w), F.first("x").over(first))).withColumn("y1", F.coalesce(F.lead("y").over(w), F.first("y").over(first)))
        return v.select(F.col("d").alias("drawing_id"), F.col("i").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), S.line("x", "y", "x1", "y1").alias("seg"), F.lit(None).cast(STYLE).alias("style"))

    def plates(self) -> DataFrame:
        """Plates with a hole and a chord, one drawing a part: a rectangle of the part's size, a circle inside, a chord."""
        k, w = F.col("p_partkey"), F.col("p_size").cast("double")
        h = w / 2 + 1
        x, y = (k % 100).cast("double"), (k % 50).cast("double")
        side = lambda a, b, c, d: S.line(x + a, y + b, x + c, y + d)
        z = F.lit(0.0)
        segs = F.array(side(z, z, w, z), side(w, z, w, h), side(w, h, z, h), side(z, h, z, z), S.circle(x + w / 2, y + h / 2, F.least(w, h) / 4), side(z, z, w, h))
        p = self.table("part").select(k.alias("drawing_id"), F.posexplode(segs).alias("edge_id", "seg"))
        return p.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), "seg", F.lit(None).cast(STYLE).alias("style"))


POINTS = "points AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y, label FROM embeddings)"
VERTICES = "vertices AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) - 1 AS i, l_extendedprice / 1000 AS x, l_quantity::DOUBLE AS y FROM lineitem)"
SEGS = f"{VERTICES}, segs AS (SELECT * FROM (SELECT d, i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vertices WINDOW w AS (PARTITION BY d ORDER BY i)) WHERE x1 IS NOT NULL)"
#: Sides of the rings, with the ring's first point.
SIDES = f"{VERTICES}, sides AS (SELECT d, i, n, x AS x0, y AS y0, coalesce(lead(x) OVER w, xf) AS x1, coalesce(lead(y) OVER w, yf) AS y1, xf, yf FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n, first_value(x) OVER (PARTITION BY d ORDER BY i) AS xf, first_value(y) OVER (PARTITION BY d ORDER BY i) AS yf FROM vertices) WHERE n >= 3 WINDOW w AS (PARTITION BY d ORDER BY i))"
BOXES = "boxes AS (SELECT *, (x_hi - x_lo) * (y_hi - y_lo) AS area FROM (SELECT p_partkey % 5 AS d, p_partkey AS id, (p_partkey * 37 % 1000) / 10.0::DOUBLE - p_size / 2.0::DOUBLE AS x_lo, (p_partkey * 61 % 1000) / 10.0::DOUBLE - p_size / 2.0::DOUBLE AS y_lo, (p_partkey * 37 % 1000) / 10.0::DOUBLE + p_size / 2.0::DOUBLE AS x_hi, (p_partkey * 61 % 1000) / 10.0::DOUBLE + p_size / 2.0::DOUBLE AS y_hi FROM part))"
ARCS = "arcs AS (SELECT *, CASE WHEN t < 1e-9 AND abs(a1 - a0) > 1e-9 THEN 2 * pi() ELSE t END AS sweep FROM (SELECT *, CASE WHEN ccw THEN ((a1 - a0) % (2 * pi()) + 2 * pi()) % (2 * pi()) ELSE ((a0 - a1) % (2 * pi()) + 2 * pi()) % (2 * pi()) END AS t FROM (SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 10.0::DOUBLE AS cx, (p_partkey * 61 % 1000) / 10.0::DOUBLE AS cy, p_size::DOUBLE AS r, (p_partkey % 360)::DOUBLE * 0.017453292519943295::DOUBLE AS a0, ((p_partkey * 7 + 90) % 360)::DOUBLE * 0.017453292519943295::DOUBLE AS a1, p_partkey % 2 = 0 AS ccw FROM part)))"
CIRCLES = f"{POINTS}, circles AS (SELECT id, x AS cx, y AS cy, (label + 1)::DOUBLE AS r, label FROM points)"
INTERVALS = "intervals AS (SELECT user_id AS d, event_id, epoch_us(ts) / 1e6 AS lo, epoch_us(ts) / 1e6 + abs(value) AS hi FROM events)"


def rnd(e: str) -> str:
    return f"(round({e}, 6) + 0e0)"


#: What is added before rounding values that are exact decimals: engines differ on ties.
NUDGE = 1e-8
