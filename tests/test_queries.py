"""Registered queries against their SQL on the smallest tables, and files written and read again."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from linework.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each family; the driver compares all of them.
SOME = ["proj37_segment_length", "agg5_ring_area", "pred11_point_in_ring", "join3_node_graph", "agg9_merge_intervals", "win4_cluster_values", "join25_containment_tree", "join2_cluster_points", "join14_anchor_cover", "str1_normalize_role", "str4_resolve_role", "proj42_contour_shape", "sink14_build_metadata", "recipe1_heal", "recipe2_island", "join23_contour_minus", "agg14_merge_collinear", "q_events_sessions"]
SOME += ["src6_load_segments", "str12_role_to_color", "str13_role_to_hex", "str14_role_to_layer", "str15_color_for_layer", "pred9_splits_polygon", "pred10_point_on_contour", "join21_bridged_runs", "join22_cut_by", "join27_on_border", "join28_spanning_lines", "sink18_write_metadata", "sort6_inspect_document", "udf3_register_role_style"]
#: With ALL_QUERIES set, every query that has SQL: ten minutes more.
if os.environ.get("ALL_QUERIES"):
    SOME = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    same = lambda v: None if v is None else (round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(same(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert tidy(map(tuple, got.select(*columns).collect())) == tidy(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_drawing_files_round_trip(spark, tmp_path):
    from linework.operators import drawings as D
    from linework.sinks import export
    from linework.sources import dxf, records

    own = {1: [{"type": "polygon", "points": [(0, 0), (40, 0), (40, 30), (0, 30)]}, {"type": "circle", "center": (20, 15), "radius": 5}], 2: [{"type": "arc", "center": (0, 0), "radius": 3, "start_angle": 0, "end_angle": 180}, {"type": "line", "start": (-3, 0), "end": (3, 0)}]}
    edges = records.load_geometry(spark, own)
    before = sorted(round(r.area, 3) for r in D.heal_drawings(edges).where("area is not null").collect())
    for r in export.to_dxf(edges, D.heal_drawings(edges)).collect():
        (tmp_path / f"{r.drawing_id}.dxf").write_text(r.dxf)
    found = dxf.read_entities(spark, f"{tmp_path}/*.dxf")
    again = D.heal_drawings(dxf.edges_from_entities(found))
    assert sorted(round(r.area, 3) for r in again.where("area is not null").collect()) == pytest.approx(before, rel=1e-6)
    spark.dataSource.register(dxf.DrawingSource)
    assert spark.read.format("drawing").load(f"{tmp_path}/*.dxf").count() == found.count()


def test_blocks_polylines_and_notes(spark, tmp_path):
    from linework.sources import dxf

    text = "0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n0\nLINE\n8\n0\n10\n0\n20\n0\n11\n1\n21\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nINSERT\n2\nB\n8\nCUT\n10\n5\n20\n5\n50\n90\n0\nLWPOLYLINE\n8\nCUT\n70\n1\n10\n0\n20\n0\n10\n2\n20\n0\n42\n1\n10\n2\n20\n2\n0\nMTEXT\n8\nT\n10\n1\n20\n1\n1\n{\\fArial;Hello}\\Pyou\n0\nHATCH\n8\nT\n0\nENDSEC\n0\nEOF\n"
    (tmp_path / "a.dxf").write_text(text)
    found = dxf.read_entities(spark, f"{tmp_path}/a.dxf").cache()
    edges = dxf.edges_from_entities(found).collect()
    assert [e.seg.kind for e in edges] == ["line", "line", "arc", "line"]
    assert (round(edges[0].seg.x1, 6), round(edges[0].seg.y1, 6)) == (5, 6)
    assert dxf.annotations_from_entities(found).first().text == "Hello\nyou"
    assert [r.type for r in dxf.unsupported_types(found).collect()] == ["HATCH"]


def test_unknown_records_raise(spark):
    from linework.sources import records

    with pytest.raises(Exception, match="unknown record type"):
        records.load_geometry(spark, {1: [{"type": "blob"}]}).collect()


def test_stream_of_records(spark, tmp_path):
    import json

    from linework.operators.drawings import heal_drawings
    from linework.streaming.sessions import drawing_stream

    os.makedirs(tmp_path / "in")
    r = {"type": "polygon", "points": [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 4, "y": 3}]}
    (tmp_path / "in/a.json").write_text(json.dumps({"drawing_id": 7, "ord": 0, "r": r}))
    out = []
    q = drawing_stream(spark, str(tmp_path / "in"), heal_drawings, lambda df, n: out.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(x.drawing_id, x.area) for x in out] == [(7, 6.0)]


def test_injection_tells_failures(spark):
    from linework.operators import drawings as D

    clusters = spark.createDataFrame([(1, 0), (1, 1)], "drawing_id long, cluster_id int")
    texts = spark.createDataFrame([(1, 0, ["S235"]), (1, 1, [])], "drawing_id long, cluster_id int, texts array<string>")
    got = {r.cluster_id: (r.custom, r.warning) for r in D.inject(clusters, texts, lambda t: {"material": t[0]}).collect()}
    assert got[0] == ({"material": "S235"}, None) and got[1][1].startswith("IndexError")
