"""Edges from records: dictionaries, JSON lines, tables of the record schema."""

from __future__ import annotations

import json
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.functions import build
from linework.functions import segments as S
from linework.functions.roles import normalize_role
from linework.schema import RECORD, SEGMENT, STYLE

KINDS = ("line", "arc", "circle", "polygon", "spline", "ellipse")
RECORDS = T.StructType([T.StructField("drawing_id", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("r", RECORD)])


def segments_of(r: Column) -> Column:
    """Segments of one record: angles are degrees, polygons are closed and give one line a side; other types raise."""
    deg = lambda f, d: F.coalesce(r[f], F.lit(d)) * (pi / 180)
    k, one = r["type"], F.array
    c, m = r["center"], r["major_axis"]
    arc = S.arc(c["x"], c["y"], r["radius"], deg("start_angle", 0.0), deg("end_angle", 360.0), F.coalesce(r["ccw"], F.lit(True)))
    ell = S.ellipse(c["x"], c["y"], m["x"], m["y"], F.coalesce(r["ratio"], F.lit(1.0)), F.coalesce(r["start_param"], F.lit(0.0)), F.coalesce(r["end_param"], F.lit(2 * pi)), F.coalesce(r["ccw"], F.lit(True)))
    spl = S.spline(r["control_points"], r["knots"], F.coalesce(r["degree"], F.lit(3)), r["weights"], r["fit_points"])
    wrong = F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce(k, F.lit("none")))).cast(T.ArrayType(SEGMENT))
    short = F.raise_error(F.lit("a polygon needs three points")).cast(T.ArrayType(SEGMENT))
    return (
        F.when(k == "line", one(S.line(r["start"]["x"], r["start"]["y"], r["end"]["x"], r["end"]["y"])))
        .when(k == "arc", one(arc)).when(k == "circle", one(S.circle(c["x"], c["y"], r["radius"]))).when(k == "polygon", F.when(F.size(r["points"]) >= 3, build.polygon(r["points"])).otherwise(short))
        .when(k == "spline", one(spl)).when(k == "ellipse", one(ell)).otherwise(wrong)
    )


def edges_from_records(records: DataFrame) -> DataFrame:
    """records: drawing_id, ord, r (RECORD): edges numbered in order within each drawing."""
    s = records.select("drawing_id", "ord", normalize_role(F.col("r.role")).alias("role"), F.posexplode(segments_of(F.col("r"))).alias("part", "seg"))
    numbered = s.withColumn("edge_id", (F.row_number().over(_by("drawing_id", "ord", "part")) - 1).cast("int"))
    return numbered.select("drawing_id", "edge_id", "role", "seg", F.lit(None).cast(STYLE).alias("style"))


def _by(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def load_geometry(spark: SparkSession, drawings: dict[int, list[dict]]) -> DataFrame:
    """Edges of drawings given as lists of dictionaries, points as pairs."""

    def tidy(rec: dict) -> dict:
        pt = lambda p: {"x": float(p[0]), "y": float(p[1])} if not isinstance(p, dict) else p
        out = dict(rec)
        for f in ("start", "end", "center", "major_axis"):
            if f in out:
                out[f] = pt(out[f])
        for f in ("points", "control_points", "fit_points"):
            if f in out:
                out[f] = [pt(p) for p in out[f]]
        return out

    rows = [(d, i, json.dumps(tidy(r))) for d, own in drawings.items() for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "drawing_id long, ord int, j string")
    return edges_from_records(df.select("drawing_id", "ord", F.from_json("j", RECORD).alias("r")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Edges from JSON lines: {"drawing_id": .., "ord": .., "r": {record}}."""
    return edges_from_records(spark.read.schema(RECORDS).json(path))


def load_segments(segments: DataFrame, role: str = "unknown") -> DataFrame:
    """segments: drawing_id, segs (array of SEGMENT): edges of one role."""
    s = segments.select("drawing_id", F.posexplode("segs").alias("edge_id", "seg"))
    return s.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), normalize_role(F.lit(role)).alias("role"), "seg", F.lit(None).cast(STYLE).alias("style"))


#: Millimetres of a typographic point, and how near points of a page are one.
PDF_POINT, PDF_SNAP = 25.4 / 72, 0.15


def page_point(x: Column, y: Column, page_height: Column) -> Column:
    """A point of a page (points, down) in millimetres, up."""
    return S.point(x * PDF_POINT, (page_height - y) * PDF_POINT)
