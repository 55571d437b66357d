"""Table and struct types of the engine. An edge is one primitive of a drawing; geometry is a tagged struct."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)
_D = T.DoubleType()

#: kind: line, arc, circle, ellipse or spline; each kind fills its own fields and leaves the others null.
SEGMENT = T.StructType(
    [T.StructField("kind", T.StringType())]
    + [T.StructField(n, _D) for n in ("x0", "y0", "x1", "y1", "cx", "cy", "r", "a0", "a1")]
    + [T.StructField("ccw", T.BooleanType())]
    + [T.StructField(n, _D) for n in ("mx", "my", "ratio")]
    + [T.StructField("degree", T.IntegerType()), T.StructField("ctrl", POINTS), T.StructField("knots", T.ArrayType(_D)), T.StructField("weights", T.ArrayType(_D)), T.StructField("samples", POINTS)]
)
STYLE = T.StructType([T.StructField("linetype", T.StringType()), T.StructField("pattern", T.ArrayType(_D)), T.StructField("color", T.IntegerType())])
EDGES = T.StructType([T.StructField("drawing_id", T.LongType()), T.StructField("edge_id", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("seg", SEGMENT), T.StructField("style", STYLE)])
#: One input record, as callers write them down.
RECORD = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("start", POINT), T.StructField("end", POINT), T.StructField("center", POINT)]
    + [T.StructField(n, _D) for n in ("radius", "start_angle", "end_angle")]
    + [T.StructField("ccw", T.BooleanType()), T.StructField("points", POINTS), T.StructField("control_points", POINTS), T.StructField("knots", T.ArrayType(_D)), T.StructField("degree", T.IntegerType()), T.StructField("weights", T.ArrayType(_D)), T.StructField("fit_points", POINTS), T.StructField("major_axis", POINT)]
    + [T.StructField(n, _D) for n in ("ratio", "start_param", "end_param")]
    + [T.StructField("role", T.StringType())]
)
ANNOTATIONS = T.StructType(
    [T.StructField("drawing_id", T.LongType()), T.StructField("ann_id", T.IntegerType()), T.StructField("subtype", T.StringType()), T.StructField("x", _D), T.StructField("y", _D), T.StructField("layer", T.StringType()), T.StructField("text", T.StringType()), T.StructField("height", _D), T.StructField("rotation", _D)]
    + [T.StructField("measured_value", _D), T.StructField("dim_type", T.StringType()), T.StructField("text_override", T.StringType()), T.StructField("measured_points", POINTS), T.StructField("vertices", POINTS), T.StructField("width_factor", _D)]
)
#: What reading a drawing gives: one row a contour or open edge.
CONTOURS = T.StructType(
    [T.StructField("drawing_id", T.LongType()), T.StructField("cluster_id", T.IntegerType()), T.StructField("contour_id", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("role", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("parent_id", T.IntegerType())]
    + [T.StructField("area", _D), T.StructField("perimeter", _D), T.StructField("ring", POINTS), T.StructField("edge_ids", T.ArrayType(T.IntegerType())), T.StructField("message", T.StringType())]
)

DEFAULT_TOLERANCE, SAGITTA, NODE_DECIMALS = 0.05, 0.01, 3
UNKNOWN, OUTER, INNER = "unknown", "outer", "inner"
