"""A knowledge base projected from the driver's tables, as DataFrames and as DuckDB SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: SQL that both engines read the same way. Views named as the driver's tables stand below them.
VIEWS = {
    "kb_sources": """
SELECT CAST(s_suppkey AS BIGINT) AS id, concat('sources/', s_name, '.txt') AS path,
  CASE WHEN s_suppkey % 4 = 0 THEN 'binary' ELSE 'text' END AS kind FROM supplier""",
    "kb_facts": """
SELECT event_id AS id, concat('user/', CAST(user_id % 50 AS STRING)) AS subject,
  CASE event_id % 5 WHEN 0 THEN 'founded' WHEN 1 THEN 'established_on' WHEN 2 THEN 'born_on' WHEN 3 THEN 'role' ELSE 'knows' END AS relation,
  CASE WHEN event_id % 5 IN (0, 1, 2) THEN concat('20', CAST(10 + (event_id * 7) % 3 AS STRING), '-0', CAST(1 + event_id % 2 AS STRING), '-01')
       WHEN event_id % 5 = 3 THEN event_type
       ELSE concat('user/', CAST((user_id * 13 + event_id) % 50 AS STRING)) END AS object,
  CASE (event_id * 3 + user_id) % 10 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'confirmed' WHEN 4 THEN 'accepted'
       WHEN 5 THEN 'candidate' WHEN 6 THEN 'needs_review' WHEN 7 THEN 'candidate' WHEN 8 THEN 'superseded' ELSE 'candidate' END AS status,
  CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 5 THEN -1 - event_id % 3 ELSE event_id % 97 END AS source_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 150 END AS job_id,
  event_id % 17 = 0 AS stale FROM events""",
    "kb_jobs": """
SELECT c_custkey AS id, c_custkey % 100 AS source_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 40 END AS artifact_id,
  CASE c_nationkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' ELSE 'done' END AS status,
  CASE WHEN c_nationkey % 7 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS failed_chunks FROM customer""",
    "kb_chunks": """
SELECT p_partkey AS id, p_partkey % 150 AS job_id, CAST(floor(p_partkey / 150) AS BIGINT) AS chunk_index,
  CASE p_size % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' ELSE 'done' END AS status,
  CAST(p_size % 4 AS BIGINT) AS attempts FROM part""",
    "kb_evidence": """
SELECT o_orderkey AS id, CAST(floor(o_orderkey * 2 / 3) AS BIGINT) AS fact_id, o_custkey % 100 AS source_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 40 END AS artifact_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS chunk_id, concat(o_orderpriority, ' ', o_orderstatus) AS snippet FROM orders""",
    "kb_events": """
SELECT event_id AS id, CAST(floor(event_id / 3) AS BIGINT) * 2 AS fact_id,
  CASE (event_id + user_id) % 9 WHEN 0 THEN 'created' WHEN 1 THEN 'rejected' WHEN 2 THEN 'auto_accept_applied' WHEN 3 THEN 'amended' WHEN 4 THEN 'created'
       WHEN 5 THEN 'auto_accept_applied' ELSE 'created' END AS event_type,
  CASE user_id % 3 WHEN 0 THEN 'system' WHEN 1 THEN 'human' ELSE 'rule' END AS actor,
  CASE (event_id * 5 + user_id) % 7 WHEN 0 THEN 'toggle' WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' WHEN 3 THEN 'amend' WHEN 4 THEN 'toggle' ELSE 'accept' END AS action,
  CASE user_id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'confirmed' END AS observed FROM events""",
    "kb_artifacts": """
SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 3 AS BIGINT) AS source_id, CASE WHEN n_regionkey = 0 THEN 'original_text' ELSE 'extracted_text' END AS kind,
  concat('artifacts/', n_name, '.txt') AS path FROM nation""",
    "kb_terms": """
SELECT fact_id, subject, rel, object, CASE WHEN fact_id % 19 = 4 THEN 'stale' ELSE sha2(concat(subject, chr(31), rel, chr(31), object), 256) END AS term_token
FROM (SELECT id AS fact_id, concat('{"t":"string","v":"', subject, '"}') AS subject, concat('{"t":"string","v":"', relation, '"}') AS rel,
  concat('{"t":"string","v":"', object, '"}') AS object FROM kb_facts WHERE object <> 'view')""",
    "kb_loose": """
SELECT id, concat('Réné ', subject) AS subject, relation, CASE WHEN id % 3 = 0 THEN concat('가́ ', object) ELSE object END AS object FROM kb_facts""",
    "kb_items": """
SELECT id, id % 200 AS batch, CASE id % 16 WHEN 1 THEN 'date(2020)' WHEN 6 THEN '漢字' WHEN 8 THEN '회사' ELSE subject END AS subject, CASE WHEN id % 16 = 1 THEN 'term' ELSE 'string' END AS subject_kind,
  CASE id % 16 WHEN 2 THEN 'subject' WHEN 3 THEN '값' WHEN 4 THEN '완료 여부' WHEN 5 THEN 'role' WHEN 7 THEN 'made_up' WHEN 9 THEN '값' ELSE relation END AS relation, 'string' AS relation_kind,
  CASE id % 16 WHEN 2 THEN 'number(3)' WHEN 3 THEN '이다' WHEN 5 THEN concat('user/', CAST((user_id + 1) % 50 AS STRING)) WHEN 8 THEN '5명' WHEN 9 THEN '1,200 원' WHEN 10 THEN '명' WHEN 11 THEN '３ 개' ELSE object END AS object,
  CASE WHEN id % 16 = 2 THEN 'term' ELSE 'string' END AS object_kind,
  CASE WHEN id % 2 = 0 THEN '한국어 원문. 회사 5명! role user/1' WHEN id % 16 = 9 THEN concat(subject, ' 값 1,200원; x') ELSE 'plain source' END AS source_text FROM (SELECT f.*, f.id * 7 AS user_id FROM kb_facts f)""",
    "kb_repairs": """
SELECT CAST(c_custkey AS BIGINT) AS id, CASE c_nationkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN c_nationkey % 4 = 1 THEN concat('worker-', CAST(c_custkey % 3 AS STRING)) END AS owner,
  CASE WHEN c_nationkey % 4 = 1 THEN CAST(1000 + c_custkey % 60 AS BIGINT) END AS lease_until FROM customer""",
    "kb_repair_items": """
SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS job_id, CASE p_partkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' ELSE 'pending' END AS status FROM part""",
    "kb_names": """
SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 2 = 1 THEN concat('sources/René ', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING), '.txt') WHEN s_suppkey % 6 = 0 THEN concat('sources/', s_name, '.txt')
    ELSE concat('sources/René ', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING), '.txt') END AS path,
  CASE WHEN s_suppkey % 26 = 0 THEN 'binary' ELSE 'text' END AS kind, CASE WHEN s_nationkey = 3 THEN NULL WHEN s_nationkey = 4 THEN s_name ELSE concat('sum ', CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING)) END AS checksum FROM supplier""",
    "kb_name_jobs": """
SELECT c_custkey AS id, c_custkey AS source_id, CAST(c_custkey * 2 AS BIGINT) AS artifact_id, CASE c_nationkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS status FROM customer""",
    "kb_name_artifacts": """
SELECT CAST(p_partkey AS BIGINT) AS id, CAST(floor(p_partkey / 4) AS BIGINT) AS source_id, CASE WHEN p_size % 3 = 0 THEN 'original_text' ELSE 'extracted_text' END AS kind, concat('c', CAST(p_size % 2 AS STRING)) AS checksum FROM part""",
    "kb_alias": """
SELECT * FROM (VALUES ('founded', 'established_on'), ('established', 'established_on'), ('born', 'born_on'), ('goal', 'purpose')) AS t(raw, canonical)""",
    "kb_functional": """
SELECT * FROM (VALUES ('established_on'), ('born_on'), ('died_on')) AS t(rel)""",
    "kb_relation": """
SELECT DISTINCT f.subject, COALESCE(a.canonical, f.relation) AS rel, f.object
FROM kb_facts f LEFT JOIN kb_alias a ON a.raw = f.relation WHERE f.status IN ('accepted', 'confirmed')""",
}
BASE_TABLES = {"kb_sources": ["supplier"], "kb_facts": ["events"], "kb_jobs": ["customer"], "kb_chunks": ["part"], "kb_evidence": ["orders"], "kb_events": ["events"], "kb_terms": ["events"], "kb_loose": ["events"], "kb_items": ["events"], "kb_artifacts": ["nation"], "kb_repairs": ["customer"], "kb_repair_items": ["part"], "kb_names": ["supplier"], "kb_name_jobs": ["customer"], "kb_name_artifacts": ["part"]}
ALIASES = {"founded": "established_on", "established": "established_on", "born": "born_on", "goal": "purpose"}


def kb(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the projected tables, over the driver's tables of a folder."""
    text = VIEWS[name]
    if "FROM kb_facts" in text:
        text = f"WITH kb_facts AS ({VIEWS['kb_facts']}) {text}"
    text = text.replace("{", "{{").replace("}", "}}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES.get(name, [])}
    for t in frames:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **frames)


def sql(query: str) -> str:
    """A DuckDB query over the tables above."""
    other = lambda q: q.replace("AS STRING", "AS VARCHAR").replace("sha2(", "sha256(").replace(", 256)", ")")
    ctes = ",\n".join(f"{n} AS ({other(q)})" for n, q in VIEWS.items())
    body = query.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {ctes},\n{body[5:]}"
    return f"WITH RECURSIVE {ctes}\n{body}"
