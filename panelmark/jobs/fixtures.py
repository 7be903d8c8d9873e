"""Label sets derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "labels", "lineitem", "orders", "events", "benchmark", "pages", "conversations")

DOC = "cast(d.doc_id as varchar(20))"
R_LABEL = f"""CASE r.rater_id WHEN 'r_len' THEN CASE WHEN d.n_chars >= 1200 THEN 'HIGH' ELSE 'LOW' END
 WHEN 'r_words' THEN CASE WHEN length(d.text) - length(replace(d.text, ' ', '')) >= 150 THEN 'HIGH' ELSE 'LOW' END
 ELSE CASE WHEN substr(md5(concat({DOC}, '|r_hash')), 1, 1) < 'c' THEN 'HIGH' ELSE 'LOW' END END"""
RATERS = "(SELECT 'r_len' AS rater_id UNION ALL SELECT 'r_words' UNION ALL SELECT 'r_hash')"

SQL = {
    "items": "SELECT lang AS domain, doc_id AS item_id, source AS cluster_id, text FROM {documents}",
    "ratings": f"SELECT d.lang AS domain, d.doc_id AS item_id, r.rater_id, {R_LABEL} AS label FROM {{documents}} d CROSS JOIN {RATERS} r",
    "human": f"""SELECT d.lang AS domain, CAST(1 + d.doc_id % 2 AS int) AS round, d.doc_id AS item_id, concat('h', cast(k.k as varchar(2))) AS annotator_id,
 d.doc_id % 50 = 0 AS is_attention_check, NOT (k.k = 3 AND d.doc_id % 40 = 1) AS included_in_consensus,
 CASE WHEN (l.quality = 1) = (substr(md5(concat({DOC}, '|h', cast(k.k as varchar(20)))), 1, 1) >= '3') THEN 'HIGH' ELSE 'LOW' END AS label
 FROM {{labels}} l JOIN {{documents}} d ON l.doc_id = d.doc_id CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "gappy": f"""SELECT d.lang AS domain, d.doc_id AS item_id, r.rater_id,
 CASE WHEN substr(md5(concat({DOC}, '|', r.rater_id, '|miss')), 1, 1) = '0' THEN NULL ELSE {R_LABEL} END AS label FROM {{documents}} d CROSS JOIN {RATERS} r""",
    "draws": f"""SELECT v.variant, d.lang AS domain, d.doc_id AS item_id, n.n AS repeat,
 CASE WHEN (d.n_chars >= 1200) = (substr(md5(concat({DOC}, '|', v.variant, '|', cast(n.n as varchar(2)))), 1, 2) >= '10') THEN 'HIGH' ELSE 'LOW' END AS label
 FROM {{documents}} d CROSS JOIN (SELECT 'a' AS variant UNION ALL SELECT 'b') v CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n""",
    "nominal": "SELECT o.o_orderpriority AS domain, l.l_orderkey AS item_id, l.l_linenumber AS rater_id, l.l_returnflag AS label FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey",
    "calls": "SELECT 'run' AS run_tag, event_type AS domain, user_id AS item_id, event_id AS ingest_seq, ts, CASE WHEN value >= 10 THEN 'HIGH' ELSE 'LOW' END AS label FROM {events}",
    "probes": "SELECT 'en' AS domain, item_id AS probe_id, text FROM {benchmark}",
    "corpus": "SELECT lang AS domain, doc_id AS item_id, source AS cluster_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS corpus, text FROM {documents}",
    "pages": "SELECT page_id AS item_id, html FROM {pages}",
    "conversations": "SELECT role AS domain, conv_id AS item_id, turn, text FROM {conversations}",
}
MAJORITY = "SELECT domain, item_id, CASE WHEN sum(CASE WHEN label = 'HIGH' THEN 1 ELSE 0 END) >= 2 THEN 'HIGH' ELSE 'LOW' END AS label FROM ({ratings}) m GROUP BY domain, item_id"
SQL["system"] = MAJORITY.replace("{ratings}", SQL["ratings"])
#: Ratings of ten iterations: a rater follows the item's majority ever more often.
SQL["iterations"] = f"""SELECT r.domain, r.item_id, r.rater_id, i.i AS iteration,
 CASE WHEN substr(md5(concat(cast(r.item_id as varchar(20)), '|', r.rater_id, '|', cast(i.i as varchar(2)))), 1, 1) < substr('123456789a', i.i, 1) THEN s.label ELSE r.label END AS label
 FROM ({SQL["ratings"]}) r JOIN ({SQL["system"]}) s ON r.domain = s.domain AND r.item_id = s.item_id
 CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) i"""
SQL["versions"] = f"SELECT domain, item_id, rater_id, label, CASE WHEN iteration = 1 THEN 'v0' ELSE 'v1' END AS rubric_version FROM ({SQL['iterations']}) v WHERE iteration IN (1, 8)"
SQL["consensus"] = f"SELECT * FROM ({SQL['human']}) h WHERE NOT is_attention_check AND included_in_consensus"


#: Tables of narrow rows that a label set joins to others.  Spark would broadcast them up to 10 MB of files, and millions of
#: such rows fit those but not a driver.
JOINED = ("labels", "orders")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The label set as a DataFrame; only tables that its SQL names are read."""
    text = SQL[name].replace("varchar(20)", "string").replace("varchar(2)", "string")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **{t: df.hint("merge") if t in JOINED else df for t, df in used.items()})


def duck(name: str) -> str:
    """The same as a DuckDB subquery."""
    out = SQL[name]
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return f"({out})"
