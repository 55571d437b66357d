"""Drawing files in the text interchange format: pairs of a group code and a value.

read_dxf() parses many files at once, one task a group of files; DrawingSource is the same as a Spark data source."""

from __future__ import annotations

import glob
import json
import zlib
from collections.abc import Iterator
from math import atan2, cos, hypot, pi, radians, sin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linework.functions.roles import resolve_role
from linework.functions.segments import segment_key
from linework.functions.texts import clean_mtext, decode_override, dimension_type
from linework.schema import EDGES

#: Layers that the engine itself writes and does not read back as geometry.
OWN_LAYERS = ("TRASH", "ANNOTATION")
GEOMETRY = ("LINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE", "LWPOLYLINE", "POLYLINE")
NOTES = ("TEXT", "MTEXT", "DIMENSION", "LEADER", "MULTILEADER")
DEEPEST = 16
ENTITY_SCHEMA = "path string, drawing_id long, ord int, type string, layer string, linetype string, color int, segs array<string>, text string, x double, y double, height double, rotation double, value double, code int, vertices array<struct<x:double,y:double>>"


def tags(data: str) -> Iterator[tuple[int, str]]:
    lines = data.splitlines()
    for i in range(0, len(lines) - 1, 2):
        code = lines[i].strip()
        if code.lstrip("-").isdigit():
            yield int(code), lines[i + 1].strip()


def entities(data: str) -> tuple[list[dict], dict[str, list[dict]], dict[str, dict]]:
    """(entities of the drawing, those of each block, layers): an entity is its type and its tags in order."""
    section, block, out, blocks, layers, now = "", None, [], {}, {}, None
    for code, value in tags(data):
        if code == 0:
            if value in ("SECTION", "ENDSEC", "EOF", "TABLE", "ENDTAB"):
                section, now = ("" if value != "SECTION" else "?"), None
                section = section if value != "TABLE" else "TABLES"
                continue
            now = {"type": value, "tags": []}
            if value == "BLOCK":
                block = "?"
            elif value == "ENDBLK":
                block, now = None, None
            elif section == "ENTITIES":
                out.append(now)
            elif section == "BLOCKS" and block not in (None, "?"):
                blocks.setdefault(block, []).append(now)
            continue
        if code == 2 and section == "?":
            section = value
        elif now is not None:
            now["tags"].append((code, value))
            if now["type"] == "BLOCK" and code == 2:
                block = value
                blocks.setdefault(block, [])
            if now["type"] == "LAYER" and code == 2:
                layers[value] = now
    return out, blocks, layers


def get(e: dict, code: int, default=None, kind=float):
    return next((kind(v) for c, v in e["tags"] if c == code), default)


def every(e: dict, code: int) -> list[float]:
    return [float(v) for c, v in e["tags"] if c == code]


def pairs(e: dict, x: int, y: int) -> list[tuple[float, float]]:
    return list(zip(every(e, x), every(e, y)))


def seg(kind: str, **fields) -> dict:
    return dict.fromkeys(f.name for f in EDGES["seg"].dataType.fields) | {"kind": kind} | fields


def bulged(p, q, b: float) -> dict:
    """A side of a polyline: a line, or the arc with this bulge."""
    if abs(b) < 1e-12:
        return seg("line", x0=p[0], y0=p[1], x1=q[0], y1=q[1])
    half = (1 / b - b) / 4
    cx, cy = (p[0] + q[0]) / 2 - (q[1] - p[1]) * half, (p[1] + q[1]) / 2 + (q[0] - p[0]) * half
    return seg("arc", cx=cx, cy=cy, r=hypot(p[0] - cx, p[1] - cy), a0=atan2(p[1] - cy, p[0] - cx), a1=atan2(q[1] - cy, q[0] - cx), ccw=b > 0)


def segments(e: dict) -> list[dict]:
    """Segments of one entity in its own plane; a mirrored plane (extrusion -1) turns x round; heights are dropped."""
    k, x, y = e["type"], get(e, 10, 0.0), get(e, 20, 0.0)
    if k == "LINE":
        return [seg("line", x0=x, y0=y, x1=get(e, 11, 0.0), y1=get(e, 21, 0.0))]
    if k == "CIRCLE":
        out = [seg("circle", cx=x, cy=y, r=get(e, 40, 0.0))] if get(e, 40, 0.0) > 0 else []
    elif k == "ARC":
        out = [seg("arc", cx=x, cy=y, r=get(e, 40, 0.0), a0=radians(get(e, 50, 0.0)), a1=radians(get(e, 51, 360.0)), ccw=True)]
    elif k == "ELLIPSE":
        return [seg("ellipse", cx=x, cy=y, mx=get(e, 11, 1.0), my=get(e, 21, 0.0), ratio=get(e, 40, 1.0), a0=get(e, 41, 0.0), a1=get(e, 42, 2 * pi), ccw=get(e, 230, 1.0) > 0)]
    elif k == "SPLINE":
        pt = lambda v: [{"x": a, "y": b} for a, b in v] or None
        ctrl = pairs(e, 10, 20)
        return [seg("spline", degree=get(e, 71, 3, int), ctrl=pt(ctrl), knots=every(e, 40), weights=every(e, 41) or None, samples=pt(pairs(e, 11, 21)) if not ctrl else None)] if ctrl or pairs(e, 11, 21) else []
    elif k == "LWPOLYLINE":
        points, bulges = [], []
        for c, v in e["tags"]:
            if c == 10:
                points.append([float(v), 0.0])
                bulges.append(0.0)
            elif c == 20 and points:
                points[-1][1] = float(v)
            elif c == 42 and points:
                bulges[-1] = float(v)
        closed = bool(get(e, 70, 0, int) & 1)
        if closed and len(points) > 1 and points[0] == points[-1]:
            points.pop()
            bulges.pop()
        ends = list(zip(points, points[1:] + points[:1] if closed else points[1:], bulges))
        out = [bulged(p, q, b) for p, q, b in ends if p != q]
    else:
        return []
    return [mirrored(s) for s in out] if get(e, 230, 1.0) < 0 else out


def mirrored(s: dict) -> dict:
    m = dict(s)
    for f in ("x0", "x1", "cx"):
        if m[f] is not None:
            m[f] = -m[f]
    if m["kind"] == "arc":
        m |= {"a0": pi - s["a0"], "a1": pi - s["a1"], "ccw": not s["ccw"]}
    return m


def placed(s: dict, ox: float, oy: float, scale: float, angle: float) -> dict:
    """A segment of a block where the block is inserted: scaled evenly, turned and moved."""
    turn = lambda x, y: (ox + scale * (x * cos(angle) - y * sin(angle)), oy + scale * (x * sin(angle) + y * cos(angle)))
    m = dict(s)
    for a, b in (("x0", "y0"), ("x1", "y1"), ("cx", "cy")):
        if s[a] is not None:
            m[a], m[b] = turn(s[a], s[b])
    if s["r"] is not None:
        m["r"] = abs(scale) * s["r"]
    if s["kind"] == "arc":
        m["a0"], m["a1"] = s["a0"] + angle, s["a1"] + angle
    if s["mx"] is not None:
        m["mx"], m["my"] = scale * (s["mx"] * cos(angle) - s["my"] * sin(angle)), scale * (s["mx"] * sin(angle) + s["my"] * cos(angle))
    for f in ("ctrl", "samples"):
        if s[f]:
            m[f] = [dict(zip("xy", turn(p["x"], p["y"]))) for p in s[f]]
    return m


def old_polylines(found: list[dict]) -> list[dict]:
    """Old polylines, whose vertices are entities of their own, as light ones."""
    out, open_ = [], None
    for e in found:
        if e["type"] == "POLYLINE":
            open_ = {"type": "LWPOLYLINE", "tags": [t for t in e["tags"] if t[0] in (8, 6, 62, 70, 230)]}
            out.append(open_)
        elif e["type"] == "VERTEX" and open_ is not None:
            open_["tags"] += [t for t in e["tags"] if t[0] in (10, 20, 42)]
        elif e["type"] == "SEQEND":
            open_ = None
        else:
            out.append(e)
    return out


def exploded(found: list[dict], blocks: dict[str, list[dict]], depth: int = 0) -> Iterator[tuple[dict, list[dict]]]:
    """(entity, segments), insertions replaced by what their block holds, blocks in blocks too."""
    for e in old_polylines(found):
        if e["type"] != "INSERT":
            yield e, segments(e)
        elif depth < DEEPEST:
            at = get(e, 10, 0.0), get(e, 20, 0.0), get(e, 41, 1.0), radians(get(e, 50, 0.0))
            for inner, own in exploded(blocks.get(get(e, 2, "", str), []), blocks, depth + 1):
                layer = get(inner, 8, "0", str)
                if layer == "0":
                    inner = inner | {"tags": [(8, get(e, 8, "0", str)), *[t for t in inner["tags"] if t[0] != 8]]}
                yield inner, [placed(s, *at) for s in own]


def rows_of(path: str, data: str) -> list[tuple]:
    """ENTITY_SCHEMA rows of one file; what cannot be read as geometry or note keeps its type alone."""
    found, blocks, layers = entities(data)
    drawing, out = zlib.crc32(path.encode()), []
    for e, own in exploded(found, blocks):
        layer = get(e, 8, "0", str)
        style = layers.get(layer, {"tags": []})
        linetype, color = get(e, 6, "BYLAYER", str), get(e, 62, 256, int)
        linetype = get(style, 6, "CONTINUOUS", str) if linetype.upper() == "BYLAYER" else linetype
        color = abs(get(style, 62, 7, int)) if color == 256 else color
        note = e["type"] in NOTES
        text = "".join(v for c, v in e["tags"] if c in (3, 1)) if note else None
        points = [{"x": a, "y": b} for a, b in (pairs(e, 10, 20) if e["type"] == "LEADER" else pairs(e, 13, 23) + pairs(e, 14, 24))] if note else None
        out.append((path, drawing, len(out), e["type"], layer, linetype, color, [json.dumps(s) for s in own], text, get(e, 10, None), get(e, 20, None), get(e, 40, None), get(e, 50, None), get(e, 42, None) if note else None, get(e, 70, None, int), points))
    return out


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """ENTITY_SCHEMA of every file under a path or pattern."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for p, content in zip(x.path, x.content):
                yield pd.DataFrame(rows_of(p, bytes(content).decode("utf-8", "replace")), columns=[c.split()[0] for c in ENTITY_SCHEMA.replace("struct<x:double,y:double>", "s").split(", ")]).astype({"color": "Int32", "code": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ENTITY_SCHEMA)


def edges_from_entities(found: DataFrame, rules: list | None = None, ignore_layers: tuple[str, ...] = ()) -> DataFrame:
    """Edges: layers that hold an ignored name are left out, as are the engine's own; sides of polylines that repeat
    another edge are dropped; roles come from rules over the layer and its line type."""
    low = F.upper("layer")
    keep = F.lit(True)
    for name in ignore_layers:
        keep = keep & ~F.contains(low, F.lit(name.upper()))
    keep = keep & ~low.isin(*OWN_LAYERS)
    pattern = F.when(F.upper("linetype").rlike("DASH|HIDDEN|CENTER|PHANTOM"), F.array(F.lit(1.0), F.lit(-1.0))).otherwise(F.array().cast("array<double>"))
    seg_type = EDGES["seg"].dataType
    s = found.where(keep).select("drawing_id", "ord", "type", "layer", "linetype", "color", F.posexplode("segs").alias("part", "j"), pattern.alias("pattern")).withColumn("seg", F.from_json("j", seg_type))
    s = s.withColumn("k", segment_key(F.col("seg"))).withColumn("nth", F.row_number().over(Window.partitionBy("drawing_id", "k").orderBy("ord", "part")))
    s = s.where("nth = 1 or type not in ('LWPOLYLINE', 'POLYLINE')")
    number = (F.row_number().over(Window.partitionBy("drawing_id").orderBy("ord", "part")) - 1).cast("int")
    role = resolve_role(rules, F.col("layer"), F.col("pattern"), F.col("color")) if rules else F.lit("unknown")
    return s.select("drawing_id", number.alias("edge_id"), role.alias("role"), "seg", F.struct("linetype", "pattern", "color").alias("style"))


def annotations_from_entities(found: DataFrame) -> DataFrame:
    """Notes, dimensions and leaders with their texts cleaned."""
    n = found.where(F.col("type").isin(*NOTES))
    dim = F.col("type") == "DIMENSION"
    kind = F.when(dim, "dimension").when(F.col("type").isin("LEADER", "MULTILEADER"), "leader").otherwise("note")
    return n.select("drawing_id", F.col("ord").alias("ann_id"), kind.alias("subtype"), "x", "y", "layer", F.when(~dim, clean_mtext(F.col("text"))).alias("text"), "height", "rotation", F.when(dim, F.col("value")).alias("measured_value"), F.when(dim, dimension_type(F.coalesce("code", F.lit(0)))).alias("dim_type"), F.when(dim, decode_override(F.col("text"))).alias("text_override"), F.when(dim, F.col("vertices")).alias("measured_points"), F.when(kind == "leader", F.col("vertices")).alias("vertices"), F.lit(1.0).alias("width_factor"))


def unsupported_types(found: DataFrame) -> DataFrame:
    """drawing_id, type, n of entities that cannot be written back."""
    return found.where(~F.col("type").isin(*GEOMETRY, *NOTES, "INSERT", "VERTEX", "SEQEND")).groupBy("drawing_id", "type").agg(F.count(F.lit(1)).alias("n"))


def deduplicate(found: DataFrame) -> DataFrame:
    """Without entities that repeat an earlier one's type, layer and geometry to two decimals."""
    key = F.array_join(F.transform("segs", lambda j: segment_key(F.from_json(j, EDGES["seg"].dataType), 2)), "|")
    told = found.withColumn("_k", F.when(F.size("segs") > 0, key))
    n = F.row_number().over(Window.partitionBy("drawing_id", "type", "layer", "_k").orderBy("ord"))
    return told.withColumn("_n", n).where("_k is null or _n = 1").drop("_k", "_n")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DrawingReader(DataSourceReader):
    """Local files, a partition each."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [Files([p]) for p in sorted(glob.glob(self.path))]

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            with open(p, encoding="utf-8", errors="replace") as f:
                for r in rows_of(p, f.read()):
                    yield (*r[:-1], [(v["x"], v["y"]) for v in r[-1]] if r[-1] is not None else None)


class DrawingSource(DataSource):
    """spark.dataSource.register(DrawingSource); spark.read.format("drawing").load(pattern)"""

    @classmethod
    def name(cls) -> str:
        return "drawing"

    def schema(self) -> str:
        return ENTITY_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DrawingReader(self.options)
