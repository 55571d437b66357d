"""Results as tables, JSON, XML, SVG, text and drawing files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions import roles, rings
from linework.functions.segments import bulge, start_point

#: Parts with a smaller outer area are not written as files of their own.
LEAST_PART_AREA = 50.0
# Output name, default and origin of the metadata fields of a cluster.
METADATA = {
    "label": ("label", "", "cluster"), "source_file": ("source_file", "", "cluster"), "quantity": ("quantity", "1", "custom"), "material": ("material", "S275JR", "custom"), "thickness": ("thickness_mm", "0.0", "custom"),
    "area": ("area_mm2", None, "calculated"), "inner_contours_count": ("inner_contours_count", None, "calculated"), "outer_perimeter": ("outer_perimeter_mm", None, "calculated"),
    "inner_perimeter": ("inner_perimeter_mm", None, "calculated"), "total_perimeter": ("total_perimeter_mm", None, "calculated"), "bbox": ("bbox", None, "calculated"),
}


def passes_min_area(outer_area: Column, least: float = LEAST_PART_AREA) -> Column:
    """No limit if it is not positive."""
    return F.lit(least <= 0) | (outer_area >= least)


def parts(clusters: DataFrame, least: float = LEAST_PART_AREA, label: str = "") -> DataFrame:
    """Clusters that become files of their own, with their label _P1, _P2, ..."""
    named = F.concat(F.lit(label), F.lit("_P"), (F.col("cluster_id") + 1).cast("string"))
    return clusters.where(passes_min_area(F.col("outer_area"), least)).withColumn("label", named)


def metadata(clusters: DataFrame, schema: dict[str, tuple] = METADATA, extra: dict[str, Column] | None = None) -> DataFrame:
    """drawing_id, cluster_id, meta (map): fields by schema, from the cluster, its custom map or what was measured (the
    whole perimeter is that of outer and inners; bbox, a struct or array, becomes JSON). A value that is missing takes the
    default; without one the field is left out."""
    pairs = []
    for field, (name, default, origin) in schema.items():
        if origin == "custom":
            value = F.try_element_at(F.col("custom"), F.lit(field)) if "custom" in clusters.columns else F.lit(None)
        elif field == "inner_contours_count" and field not in clusters.columns and "inners" in clusters.columns:
            value = F.col("inners")
        elif field not in clusters.columns:
            both = field == "total_perimeter" and {"outer_perimeter", "inner_perimeter"} <= set(clusters.columns)
            value = F.round(F.col("outer_perimeter") + F.col("inner_perimeter"), 4) if both else F.lit(None)
        elif field == "bbox":
            value = F.to_json("bbox")
        else:
            value = F.round(F.col(field), 4) if dict(clusters.dtypes)[field] == "double" else F.col(field)
        pairs.append(F.struct(F.lit(name).alias("key"), F.coalesce(value.cast("string"), F.lit(default).cast("string")).alias("value")))
    pairs += [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (extra or {}).items()]
    return clusters.select("drawing_id", "cluster_id", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("meta"))


def to_json(meta: DataFrame) -> DataFrame:
    """drawing_id, json: the metadata of all clusters of a drawing, in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "meta_json"))), lambda c: c["meta_json"])
    return meta.withColumn("meta_json", F.to_json("meta")).groupBy("drawing_id").agg(F.concat(F.lit('{"clusters":['), F.array_join(own, ","), F.lit("]}")).alias("json"))


def read_metadata(json: Column) -> Column:
    """Metadata that was written before; an empty map where there is none or it cannot be read."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def to_xml(meta: DataFrame) -> DataFrame:
    """drawing_id, xml: the same fields as nested elements."""
    safe = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), safe(e["value"]), F.lit("</"), e["key"], F.lit(">"))), "")
    one = meta.select("drawing_id", "cluster_id", F.concat(F.lit("<cluster>"), fields, F.lit("</cluster>")).alias("x"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "x"))), lambda c: c["x"])
    return one.groupBy("drawing_id").agg(F.concat(F.lit("<result>"), F.array_join(own, ""), F.lit("</result>")).alias("xml"))


def _number(c: Column, decimals: int = 4) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def view_model(contours: DataFrame, styles: dict | None = None) -> DataFrame:
    """drawing_id, view: polylines with role and colour, the box of all outers and the trash, for renderers."""
    ring = F.transform("ring", lambda p: F.array(F.round(p["x"], 4), F.round(p["y"], 4)))
    item = F.struct("contour_id", "cluster_id", "kind", "role", roles.role_hex(F.when(F.col("kind") == "inner", "inner").otherwise("outer"), styles).alias("color"), F.col("depth"), ring.alias("points"))
    own = contours.where("contour_id is not null").withColumn("b", rings.bbox(F.col("ring"))).withColumn("item", item)
    box = F.struct(F.round(F.min("b.x_lo"), 4).alias("x_lo"), F.round(F.min("b.y_lo"), 4).alias("y_lo"), F.round(F.max("b.x_hi"), 4).alias("x_hi"), F.round(F.max("b.y_hi"), 4).alias("y_hi"))
    return own.groupBy("drawing_id").agg(F.struct(box.alias("box"), F.array_sort(F.collect_list("item")).alias("contours")).alias("view"))


def to_svg(contours: DataFrame, padding: float = 0.03, background: str = "#1e1e1e", size: int | None = None) -> DataFrame:
    """drawing_id, svg: each contour as a path, y up, with room around; strokes are a 400th of the diagonal."""
    views = view_model(contours).select("drawing_id", "view.*")
    w, h = F.col("box.x_hi") - F.col("box.x_lo"), F.col("box.y_hi") - F.col("box.y_lo")
    pad = padding * F.greatest(w, h)
    stroke = F.sqrt(w * w + h * h) / 400
    x = lambda p: _number(p[0])
    y = lambda p: _number(-p[1])
    path = lambda c: F.concat(F.lit('<path d="M'), F.array_join(F.transform(c["points"], lambda p: F.concat(x(p), F.lit(" "), y(p))), " L"), F.lit(' Z" fill="none" stroke="'), c["color"], F.lit('" stroke-width="'), _number(stroke), F.lit('"/>'))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"'), F.lit(f' width="{size}"' if size else ""), F.lit(' viewBox="'), F.concat_ws(" ", _number(F.col("box.x_lo") - pad), _number(-F.col("box.y_hi") - pad), _number(w + 2 * pad), _number(h + 2 * pad)), F.lit(f'"><style>svg{{background:{background}}}</style>'))
    return views.select("drawing_id", F.concat(head, F.array_join(F.transform("contours", path), ""), F.lit("</svg>")).alias("svg"))


def to_text(contours: DataFrame, decimals: int = 3) -> DataFrame:
    """drawing_id, text: a reading of the drawing, a line for each contour with its short name, then what is left over."""
    own = contours.where("contour_id is not null").withColumn("b", rings.bbox(F.col("ring")))
    indent = F.repeat(F.lit("  "), F.col("depth"))
    n = lambda c: _number(c, decimals)
    line = F.concat(indent, F.lit("- C"), (F.col("cluster_id") + 1).cast("string"), F.when(F.col("kind") == "inner", F.concat(F.lit("."), F.col("contour_id").cast("string"))).otherwise(""), F.lit(" "), F.col("kind"), F.lit(" area "), n(F.col("area")), F.lit(" perimeter "), n(F.col("perimeter")), F.lit(" box "), F.concat_ws(" ", n(F.col("b.x_lo")), n(F.col("b.y_lo")), n(F.col("b.x_hi")), n(F.col("b.y_hi"))))
    rows = own.select("drawing_id", F.struct(F.lit(0).alias("part"), "cluster_id", "contour_id", line.alias("line")).alias("r"))
    left = contours.where("kind = 'trash'").select("drawing_id", F.struct(F.lit(1).alias("part"), F.lit(0).alias("cluster_id"), F.col("edge_ids")[0].alias("contour_id"), F.concat(F.lit("- left over: edge "), F.col("edge_ids")[0].cast("string"), F.lit(" "), F.col("role")).alias("line")).alias("r"))
    both = rows.unionAll(left).groupBy("drawing_id").agg(F.array_sort(F.collect_list("r")).alias("all"))
    return both.select("drawing_id", F.concat(F.lit("# Drawing "), F.col("drawing_id").cast("string"), F.lit("\n"), F.array_join(F.transform("all", lambda r: r["line"]), "\n")).alias("text"))


def dxf_entity(seg: Column, layer: Column) -> Column:
    """The tag pairs of one segment."""
    tag = lambda code, v: F.concat(F.lit(f"{code}\n"), v if isinstance(v, Column) else F.lit(str(v)), F.lit("\n"))
    num = lambda code, v: tag(code, F.format_string("%.9f", v))
    head = lambda name: F.concat(tag(0, name), tag(8, layer))
    deg = lambda c: F.pmod(F.degrees(c), F.lit(360.0))
    a0, a1 = F.when(seg["ccw"], seg["a0"]).otherwise(seg["a1"]), F.when(seg["ccw"], seg["a1"]).otherwise(seg["a0"])
    line = F.concat(head("LINE"), num(10, seg["x0"]), num(20, seg["y0"]), num(11, seg["x1"]), num(21, seg["y1"]))
    circle = F.concat(head("CIRCLE"), num(10, seg["cx"]), num(20, seg["cy"]), num(40, seg["r"]))
    arc = F.concat(head("ARC"), num(10, seg["cx"]), num(20, seg["cy"]), num(40, seg["r"]), num(50, deg(a0)), num(51, deg(a1)))
    ell = F.concat(head("ELLIPSE"), num(10, seg["cx"]), num(20, seg["cy"]), num(11, seg["mx"]), num(21, seg["my"]), num(40, seg["ratio"]), num(41, a0), num(42, a1))
    pts = lambda f, x, y: F.array_join(F.transform(F.coalesce(seg[f], F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.concat(num(x, p["x"]), num(y, p["y"]))), "")
    knots = F.array_join(F.transform(F.coalesce(seg["knots"], F.array().cast("array<double>")), lambda k: num(40, k)), "")
    spl = F.concat(head("SPLINE"), tag(71, seg["degree"].cast("string")), knots, pts("ctrl", 10, 20), pts("samples", 11, 21))
    return F.when(seg["kind"] == "line", line).when(seg["kind"] == "circle", circle).when(seg["kind"] == "arc", arc).when(seg["kind"] == "ellipse", ell).otherwise(spl)


def to_dxf(edges: DataFrame, contours: DataFrame | None = None) -> DataFrame:
    """drawing_id, dxf: one drawing file's text each; edges go to the layer of the contour they belong to, or of their role."""
    if contours is not None:
        of = contours.select("drawing_id", F.explode("edge_ids").alias("edge_id"), F.col("kind").alias("_kind")).groupBy("drawing_id", "edge_id").agg(F.min("_kind").alias("_kind"))
        edges = edges.join(of, ["drawing_id", "edge_id"], "left")
        layer = F.when(F.col("_kind").isin("outer", "inner"), roles.role_layer(F.col("_kind"))).otherwise(roles.role_layer(F.col("role")))
    else:
        layer = roles.role_layer(F.col("role"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "e"))), lambda x: x["e"])
    text = F.concat(F.lit("0\nSECTION\n2\nHEADER\n9\n$INSUNITS\n70\n4\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n"), F.array_join(own, ""), F.lit("0\nENDSEC\n0\nEOF\n"))
    return edges.select("drawing_id", "edge_id", dxf_entity(F.col("seg"), layer).alias("e")).groupBy("drawing_id").agg(text.alias("dxf"))


def nester_input(contours: DataFrame) -> DataFrame:
    """drawing_id, cluster_id, area, bbox, outer_coords, holes_coords: plain closed coordinates of each cluster, for nesting."""
    closed = F.concat(F.col("ring"), F.slice("ring", 1, 1))
    own = contours.where("contour_id is not null").withColumn("closed", closed)
    outer = F.col("kind") == "outer"
    first = lambda c: F.min_by(c, F.when(outer, F.col("contour_id")))
    holes = F.transform(F.array_sort(F.collect_list(F.when(~outer, F.struct("contour_id", "closed")))), lambda h: h["closed"])
    net = F.sum(F.when(outer, F.col("area")).otherwise(-F.col("area")))
    return own.groupBy("drawing_id", "cluster_id").agg(net.alias("area"), first(rings.bbox(F.col("ring"))).alias("bbox"), first(F.col("closed")).alias("outer_coords"), holes.alias("holes_coords"))


#: Application whose extended data holds the metadata, and signs in one piece of it.
XDATA_APP, XDATA_PIECE = "LINEWORK", 250


def with_metadata(dxf: Column, json: Column) -> Column:
    """The drawing file's text with metadata as extended data of its first entity on the layer of outers."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(json) - 1) / XDATA_PIECE)), lambda i: F.concat(F.lit("1000\n"), F.substring(json, (i * XDATA_PIECE + 1).cast("int"), F.lit(XDATA_PIECE)), F.lit("\n")))
    data = F.concat(F.lit(f"1001\n{XDATA_APP}\n"), F.array_join(pieces, ""))
    at = F.instr(dxf, f"\n8\n{roles.LAYERS['outer']}\n")
    end = F.locate("\n0\n", F.substring(dxf, at + 3, F.length(dxf))) + at + 2
    return F.when(at > 0, F.concat(F.substring(dxf, F.lit(1), end), data, F.substring(dxf, end + 1, F.length(dxf)))).otherwise(dxf)


def metadata_of(dxf: Column) -> Column:
    """What with_metadata() wrote, as a map; empty where there is none or it cannot be read."""
    own = F.regexp_extract(dxf, f"\n1001\n{XDATA_APP}\n((?:1000\n[^\n]*\n)*)", 1)
    return read_metadata(F.array_join(F.regexp_extract_all(own, F.lit("1000\n([^\n]*)\n"), F.lit(1)), ""))


def polyline_tags(segs: Column) -> Column:
    """x, y and bulge of each vertex of a closed run of lines and arcs."""
    return F.transform(segs, lambda s: F.struct(start_point(s)["x"].alias("x"), start_point(s)["y"].alias("y"), F.when(s["kind"] == "arc", bulge(s)).otherwise(0.0).alias("bulge")))


def save(df: DataFrame, path: str, column: str) -> None:
    """One text file a drawing, in a folder for each."""
    df.select("drawing_id", F.col(column).alias("value")).repartition("drawing_id").write.mode("overwrite").partitionBy("drawing_id").option("lineSep", "").text(path)
