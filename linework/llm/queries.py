"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm import fingerprints, licenses, line_dedup, mixing, packing, pii, quality, simhash_gph, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own evidence, the posteriors of its host and path, its score and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id over links of at most 4 differing bits of 4-word shingles."""
    found = simhash_gph.simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", simhash_gph.hex_of(F.col("f")).alias("fingerprint"), "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates in place of personal data: doc_id, text, n_entities."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("entities_", "n_entities")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 with lines of at least 10 documents dropped."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_").alias("n_lines"), F.col("dropped_").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mix of three fifths of all tokens takes, and how much of them."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 512 to 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license of the whole text, its digest, and the licences of notices among its lines."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("license_").alias("license"), F.col("license_digest_").alias("license_digest"), F.array_join("notices_", ",").alias("notices"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors, by Hamming distance of their sign codes, of every vector whose id 20 divides."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.code_of(F.col("embedding")).alias("code"))
    return topk.top_k(rows, rows.where(F.col("id") % topk.QUERY_EVERY == 0), topk.K)


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash_near_dedup, op3_fingerprints, op4_pii_surrogates, op5_line_dedup, op6_mixing, op7_packing, op8_toxicity, op9_licenses, op10_topk)}

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


def level_sql(level: str, above: list[str], given: str) -> str:
    """One level of the budget tree: shares of `given` among the children of each node."""
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    on = f"JOIN {given} USING ({', '.join(above)})" if above else f"CROSS JOIN {given}"
    keys = ", ".join([*above, level])
    weight = "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END" if level == "lang" else "1"
    return f"""
{level}_n AS (SELECT n.*, given, {weight} AS w FROM (SELECT {keys}, sum(room)::BIGINT AS room FROM leaves WHERE room > 0 GROUP BY ALL) n {on}),
{level}_f AS (SELECT *, (given - coalesce(sum(room) OVER ({part}ORDER BY room / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
  >= room * sum(w) OVER ({part}ORDER BY room / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM {level}_n),
{level}_b AS (SELECT {keys}, (CASE WHEN filled THEN room ELSE ((given - sum(CASE WHEN filled THEN room ELSE 0 END) OVER ({part})) * w) // (sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part})) END)::BIGINT AS given FROM {level}_f)"""


MIXING_SQL = f"""
WITH counted AS (SELECT doc_id, 'd' || regexp_extract(coalesce(source, ''), '[0-9]$', 0) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS room FROM counted GROUP BY ALL),
total AS (SELECT least(sum(tokens) * 3 // 5, sum(tokens) * 2)::BIGINT AS given FROM leaves),
{level_sql("domain", [], "total")},
{level_sql("lang", ["domain"], "domain_b")},
{level_sql("source", ["domain", "lang"], "lang_b")},
plan AS (SELECT domain, lang, source, given // tokens AS full_epochs, given % tokens AS rest FROM source_b JOIN leaves USING (domain, lang, source) WHERE given > 0),
o AS (SELECT c.*, full_epochs, rest, md5('20:' || full_epochs || ':' || doc_id) AS o FROM counted c JOIN plan USING (domain, lang, source)),
r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o),
s AS (SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, full_epochs::BIGINT AS full_epochs, greatest(0, least(n_tokens, rest - ahead))::BIGINT AS last_tokens FROM r)
SELECT * FROM s WHERE full_epochs > 0 OR last_tokens > 0
"""

TOPK_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
u AS (SELECT vec_id, unnest(b) AS bit, generate_subscripts(b, 1) - 1 AS i FROM c),
code AS (SELECT vec_id, sum(CASE WHEN bit AND i < 32 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN bit AND i >= 32 THEN 1::BIGINT << (i - 32) ELSE 0 END)::BIGINT AS hi FROM u GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, (bit_count(xor(q.lo, r.lo)) + bit_count(xor(q.hi, r.hi)))::INTEGER AS distance FROM code q JOIN code r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM k WHERE rank <= 10
"""

SQL = {"op5_line_dedup": LINE_DEDUP_SQL, "op6_mixing": MIXING_SQL, "op10_topk": TOPK_SQL}
