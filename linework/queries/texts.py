"""Queries for roles, rules, styles, texts and exported metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import roles, texts
from linework.functions.roles import RoleRule, RoleStyle
from linework.functions import segments as S
from linework.functions import rings
from linework.queries.views import NUDGE, SEGS, SIDES, Views, query, r6, rnd
from linework.sinks import export

SLUG = "CASE WHEN trim(regexp_replace(lower(trim({0})), '[^a-z0-9_-]+', '_', 'g'), '_-') = '' THEN 'unknown' ELSE substr(trim(regexp_replace(lower(trim({0})), '[^a-z0-9_-]+', '_', 'g'), '_-'), 1, 64) END"


@query("str1_normalize_role", f"SELECT p_partkey AS id, {SLUG.format('p_type')} AS role FROM part")
def normalize_role(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), roles.normalize_role(F.col("p_type")).alias("role"))


@query("str2_role_str", f"SELECT c_mktsegment AS segment, {SLUG.format('c_mktsegment')} AS role, count(*) AS n FROM customer GROUP BY ALL")
def role_str(v: Views) -> DataFrame:
    return v.table("customer").groupBy(F.col("c_mktsegment").alias("segment"), roles.normalize_role(F.col("c_mktsegment")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


ROLE = "CASE l_returnflag WHEN 'A' THEN 'outer' WHEN 'R' THEN 'bend' ELSE 'unknown' END"


def role(v: Views) -> DataFrame:
    return v.table("lineitem").withColumn("role", F.when(F.col("l_returnflag") == "A", "outer").when(F.col("l_returnflag") == "R", "bend").otherwise("unknown"))


@query("str3_feature_role", f"WITH r AS (SELECT {ROLE} AS role, l_linestatus FROM lineitem) SELECT CASE WHEN role NOT IN ('unknown', 'outer', 'inner') THEN role ELSE l_linestatus END AS role, count(*) AS n FROM r GROUP BY 1")
def feature_role(v: Views) -> DataFrame:
    return role(v).groupBy(roles.feature_role(F.col("role"), F.col("l_linestatus")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("pred12_is_structural", f"WITH r AS (SELECT {ROLE} AS role FROM lineitem) SELECT role, role IN ('outer', 'inner') AS structural, count(*) AS n FROM r GROUP BY ALL")
def is_structural(v: Views) -> DataFrame:
    return role(v).groupBy("role", roles.is_structural(F.col("role")).alias("structural")).agg(F.count(F.lit(1)).alias("n"))


@query("pred2_split_labeled", f"WITH r AS (SELECT l_orderkey AS d, {ROLE} AS role FROM lineitem) SELECT d, count(*) FILTER (role = 'bend') AS labelled, count(*) FILTER (role <> 'bend') AS free FROM r GROUP BY d")
def split_labeled(v: Views) -> DataFrame:
    own = (F.col("role") != "unknown") & ~roles.is_structural(F.col("role"))
    return role(v).groupBy(F.col("l_orderkey").alias("d")).agg(F.sum(own.cast("long")).alias("labelled"), F.sum((~own).cast("long")).alias("free"))


RULES = [RoleRule("Hot Rolled", name_contains="promo"), RoleRule("bend", color=7), RoleRule("cut", name="ECONOMY BRASS"), RoleRule("mark", dashed=True)]
PATTERN = "CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [3.0, -1.0] ELSE [3.0, -1.0, 0.5, -1.0] END"


def styled(v: Views) -> DataFrame:
    k = F.col("p_partkey") % 3
    a = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    pattern = F.when(k == 0, F.array().cast("array<double>")).when(k == 1, a(3, -1)).otherwise(a(3, -1, 0.5, -1))
    return v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), pattern.alias("pattern"), F.col("p_size").alias("color"))


RULE_SQL = "CASE WHEN contains(lower(p_type), 'promo') THEN 'hot_rolled' WHEN p_size = 7 THEN 'bend' WHEN lower(p_type) = 'economy brass' THEN 'cut' WHEN p_partkey % 3 <> 0 THEN 'mark' ELSE 'unknown' END"


@query("str4_resolve_role", f"SELECT p_partkey AS id, {RULE_SQL} AS role FROM part")
def resolve_role(v: Views) -> DataFrame:
    return styled(v).select("id", roles.resolve_role(RULES, F.col("name"), F.col("pattern"), F.col("color")).alias("role"))


@query("pred13_rule_matches", "SELECT p_partkey AS id, contains(lower(p_type), 'brass') AND p_partkey % 3 = 2 AS matches FROM part")
def rule_matches(v: Views) -> DataFrame:
    rule = RoleRule("x", name_contains="BRASS", dash="chain")
    return styled(v).select("id", rule.matches(F.col("name"), F.col("pattern"), F.col("color")).alias("matches"))


@query("str5_name_rules", "SELECT n_nationkey AS id, CASE n_name WHEN 'FRANCE' THEN 'a' WHEN 'GERMANY' THEN 'b' ELSE 'unknown' END AS role FROM nation")
def name_rules(v: Views) -> DataFrame:
    rules = roles.name_rules({"france": "a", "Germany": "b"})
    none = F.array().cast("array<double>")
    return v.table("nation").select(F.col("n_nationkey").alias("id"), roles.resolve_role(rules, F.col("n_name"), none, F.lit(7)).alias("role"))


@query("proj64_dash_kind", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'continuous' WHEN 1 THEN 'uniform' ELSE 'chain' END AS kind FROM part")
def dash_kind(v: Views) -> DataFrame:
    return styled(v).select("id", roles.dash_kind(F.col("pattern")).alias("kind"))


@query("proj65_is_dashed", "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS dashed FROM part")
def is_dashed(v: Views) -> DataFrame:
    return styled(v).select("id", roles.is_dashed(F.col("pattern")).alias("dashed"))


@query("str6_color_index", "SELECT 'red' AS name, 1 AS color UNION ALL SELECT 'bylayer', 256 UNION ALL SELECT '42', 42")
def color_index(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(n, roles.color_index(n)) for n in ("red", "bylayer", "42")], "name string, color int")


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w!r}" for k, w in values.items()) + f" ELSE {default} END"


STYLES = {"bend": RoleStyle(color=(0, 128, 255), layer_name="BENDS")}


@query("str12_role_to_color", f"WITH r AS (SELECT DISTINCT {ROLE} AS role FROM lineitem) SELECT role, {_case('role', {'outer': 3, 'inner': 2, 'unknown': 1}, '8')} AS color FROM r")
def role_to_color(v: Views) -> DataFrame:
    return role(v).select("role").distinct().select("role", roles.role_color(F.col("role")).alias("color"))


@query("str13_role_to_hex", f"WITH r AS (SELECT DISTINCT {ROLE} AS role FROM lineitem) SELECT role, {_case('role', {'outer': '#00ff00', 'inner': '#ffff00', 'bend': '#0080ff', 'unknown': '#ff0000'}, "'#808080'")} AS hex FROM r")
def role_to_hex(v: Views) -> DataFrame:
    return role(v).select("role").distinct().select("role", roles.role_hex(F.col("role"), STYLES).alias("hex"))


@query("str14_role_to_layer", f"WITH r AS (SELECT DISTINCT {ROLE} AS role FROM lineitem) SELECT role, {_case('role', {'outer': 'OuterContour', 'inner': 'InnerContour', 'bend': 'BENDS', 'unknown': 'Trash'}, 'role')} AS layer FROM r")
def role_to_layer(v: Views) -> DataFrame:
    return role(v).select("role").distinct().select("role", roles.role_layer(F.col("role"), STYLES).alias("layer"))


@query("str15_color_for_layer", f"WITH r AS (SELECT DISTINCT {ROLE} AS role FROM lineitem) SELECT role, {_case('role', {'outer': 3, 'inner': 2, 'unknown': 1}, '8')} AS color FROM r")
def color_for_layer(v: Views) -> DataFrame:
    return role(v).select("role").distinct().select("role", roles.layer_color(roles.role_layer(F.col("role"))).alias("color"))


@query("str7_clean_mtext", "SELECT n_nationkey AS id, n_name || chr(10) || 'x y' || n_nationkey || '/2' AS text FROM nation")
def clean_mtext(v: Views) -> DataFrame:
    raw = F.concat(F.lit(r"{\fArial|b0;\H2.5;"), F.col("n_name"), F.lit(r"}\Px\~y\S"), F.col("n_nationkey").cast("string"), F.lit("^2;"))
    return v.table("nation").select(F.col("n_nationkey").alias("id"), texts.clean_mtext(raw).alias("text"))


@query("str8_dimension_override", "SELECT n_nationkey AS id, '⌀' || n_nationkey || ' ±0.1 90°' AS text FROM nation")
def dimension_override(v: Views) -> DataFrame:
    raw = F.concat(F.lit("%%c"), F.col("n_nationkey").cast("string"), F.lit(r" %%P0.1 90\U+00B0"))
    return v.table("nation").select(F.col("n_nationkey").alias("id"), texts.decode_override(raw).alias("text"))


VALUE = "regexp_replace(regexp_replace(printf('%.4f', p_retailprice), '0+$', ''), '\\.$', '')"


@query("str11_shown_value", f"SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '12.5' ELSE {VALUE} END AS text FROM part")
def shown_value(v: Views) -> DataFrame:
    t = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("R"), F.lit("12.5"))).otherwise(F.array(F.lit("R")))
    return v.table("part").select(F.col("p_partkey").alias("id"), texts.shown_value(t, F.col("p_retailprice").cast("double")).alias("text"))


@query("proj62_dimension_text", f"SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'L=' || {VALUE} WHEN 1 THEN '' ELSE 'ab' END AS text FROM part")
def dimension_text(v: Views) -> DataFrame:
    k = F.col("p_size") % 3
    override = F.when(k == 0, "L=<>").when(k == 1, " ").otherwise("")
    t = F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return v.table("part").select(F.col("p_partkey").alias("id"), texts.dimension_text(override, t, F.col("p_retailprice").cast("double")).alias("text"))


@query("proj63_leader_text", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'first' END AS text FROM orders")
def leader_text(v: Views) -> DataFrame:
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")
    return v.table("orders").select(F.col("o_orderkey").alias("id"), texts.leader_text(own, F.array(F.lit("first"), F.lit("second"))).alias("text"))


@query("proj72_note_text", "SELECT o_orderkey AS id, o_orderpriority AS text FROM orders")
def note_text(v: Views) -> DataFrame:
    return v.table("orders").select(F.col("o_orderkey").alias("id"), texts.clean_mtext(F.col("o_orderpriority")).alias("text"))


@query("str10_dimension_semantics", "SELECT p_partkey AS id, CASE p_size & 7 WHEN 0 THEN 'linear' WHEN 1 THEN 'aligned' WHEN 2 THEN 'angular' WHEN 3 THEN 'diameter' WHEN 4 THEN 'radius' WHEN 5 THEN 'angular3p' WHEN 6 THEN 'ordinate' ELSE 'unknown' END AS kind FROM part")
def dimension_semantics(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), texts.dimension_type(F.col("p_size")).alias("kind"))


@query("str16_label", "SELECT p_partkey AS id, 'C' || (p_partkey + 1) || CASE WHEN p_size % 2 = 0 THEN '.' || (p_size + 1) ELSE '' END AS label FROM part")
def label(v: Views) -> DataFrame:
    inner = F.concat(F.lit("clusters["), F.col("p_partkey").cast("string"), F.lit("].inners["), F.col("p_size").cast("string"), F.lit("]"))
    outer = F.concat(F.lit("clusters["), F.col("p_partkey").cast("string"), F.lit("].outer"))
    return v.table("part").select(F.col("p_partkey").alias("id"), texts.path_label(F.when(F.col("p_size") % 2 == 0, inner).otherwise(outer)).alias("label"))


@query("join17_resolve_target", f"WITH {SIDES}, r AS (SELECT DISTINCT d FROM sides) SELECT o_orderkey AS id, r.d AS target FROM orders LEFT JOIN r ON r.d = o_orderkey")
def resolve_target(v: Views) -> DataFrame:
    """Paths of all orders back to their rings: null where there is none."""
    path = v.table("orders").select(F.col("o_orderkey").alias("id"), F.format_string("clusters[%d].outer", F.col("o_orderkey")).alias("path"))
    number = F.regexp_extract("path", r"clusters\[(\d+)\]", 1).cast("long")
    return path.withColumn("d", number).join(v.ring_rows().select("d", F.col("d").alias("target")), "d", "left").select("id", "target")


@query("src11_page_point", f"WITH {SEGS} SELECT d, i, {rnd('1e-8 + x0 * 25.4 / 72')} AS x, {rnd('1e-8 + (842 - y0) * 25.4 / 72')} AS y FROM segs")
def page_point(v: Views) -> DataFrame:
    from linework.sources.records import page_point as of

    p = of(F.col("x0"), F.col("y0"), F.lit(842.0))
    return v.segs().select("d", "i", r6(p["x"] + NUDGE).alias("x"), r6(p["y"] + NUDGE).alias("y"))


META = f"WITH {SIDES}, r AS (SELECT d, round(abs(sum((x0 - xf) * (y1 - yf) - (x1 - xf) * (y0 - yf))) / 2 + 1e-8, 2) AS area, count(*) AS n FROM sides GROUP BY d)"


def ring_clusters(v: Views) -> DataFrame:
    r = v.ring_rows().select(F.col("d").alias("drawing_id"), F.lit(0).alias("cluster_id"), F.round(rings.area(F.col("ring")) + NUDGE, 2).alias("area"), F.size("ring").alias("inner_contours_count"))
    return r.withColumn("custom", F.when(F.col("inner_contours_count") > 4, F.create_map(F.lit("material"), F.lit("ALU"))))


@query("sink14_build_metadata", f"{META} SELECT d, CASE WHEN n > 4 THEN 'ALU' ELSE 'S275JR' END AS material, '1' AS quantity, area, n AS inners FROM r")
def build_metadata(v: Views) -> DataFrame:
    m = export.metadata(ring_clusters(v))
    return m.select(F.col("drawing_id").alias("d"), m.meta["material"].alias("material"), m.meta["quantity"].alias("quantity"), m.meta["area_mm2"].cast("double").alias("area"), m.meta["inner_contours_count"].cast("long").alias("inners"))


@query("sink15_to_json", f"{META} SELECT d, area, n AS inners FROM r")
def to_json(v: Views) -> DataFrame:
    """Metadata written as JSON and read again."""
    j = export.to_json(export.metadata(ring_clusters(v)))
    back = F.from_json("json", "clusters array<map<string,string>>")["clusters"][0]
    return j.select(F.col("drawing_id").alias("d"), back["area_mm2"].cast("double").alias("area"), back["inner_contours_count"].cast("long").alias("inners"))


@query("src29_read_metadata", f"{META} SELECT d, CASE WHEN d % 2 = 0 THEN area END AS area FROM r")
def read_metadata(v: Views) -> DataFrame:
    m = export.metadata(ring_clusters(v)).withColumn("j", F.when(F.col("drawing_id") % 2 == 0, F.to_json("meta")).otherwise(F.lit("{broken")))
    back = export.read_metadata(F.col("j"))
    return m.select(F.col("drawing_id").alias("d"), F.try_element_at(back, F.lit("area_mm2")).cast("double").alias("area"))


@query("sink17_to_xml", f"{META} SELECT d, '<result><cluster>' AS head, area FROM r")
def to_xml(v: Views) -> DataFrame:
    x = export.to_xml(export.metadata(ring_clusters(v)))
    return x.select(F.col("drawing_id").alias("d"), F.substring("xml", 1, 17).alias("head"), F.regexp_extract("xml", "<area_mm2>([^<]*)<", 1).cast("double").alias("area"))


@query("sink3_min_area", f"{META} SELECT d, area >= 50 AS kept FROM r")
def min_area(v: Views) -> DataFrame:
    return ring_clusters(v).select(F.col("drawing_id").alias("d"), export.passes_min_area(F.col("area")).alias("kept"))


@query("agg2_summary", "SELECT l_orderkey AS d, count(*) FILTER (l_returnflag = 'A') AS a_count, count(*) FILTER (l_returnflag = 'N') AS n_count FROM lineitem GROUP BY l_orderkey")
def summary(v: Views) -> DataFrame:
    per = v.table("lineitem").groupBy(F.col("l_orderkey").alias("d"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    at = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long"))
    return m.select("d", at("A").alias("a_count"), at("N").alias("n_count"))


@query("udf6_features", "SELECT l_orderkey AS d, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey")
def features(v: Views) -> DataFrame:
    """Items of one overlay collection."""
    m = v.table("lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_returnflag").alias("name")).agg(F.collect_list("l_linenumber").alias("items"))
    over = m.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("detected"))
    return over.select("d", F.size(F.coalesce(F.try_element_at("detected", F.lit("R")), F.array().cast("array<int>"))).cast("long").alias("n")).where("n > 0")


@query("proj24_sub_segment_half", f"WITH {SEGS} SELECT d, i, {rnd('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 2')} AS half FROM segs")
def half_length(v: Views) -> DataFrame:
    """Half of each line, as what lies before its middle."""
    s = S.line("x0", "y0", (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    return v.segs().select("d", "i", r6(S.length(s)).alias("half"))
