"""Registered queries of the label-audit operators and the SQL to compare them with, one pair per operator.

Names start with the operator's number in the blueprint.  Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions import text as tx
from panelmark.jobs.fixtures import duck, fixture
from panelmark.operators import history as hs
from panelmark.operators import metrics as mt
from panelmark.operators import pairs as pr
from panelmark.operators import raters as rt
from panelmark.operators import reference as rf
from panelmark.operators import resample as rs
from panelmark.operators import votes as vt
from panelmark.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places (no negative zero), integers as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, 6) + 0.0).alias(name) if kind in ("double", "decimal") else c.cast("long").alias(name) if kind in ("int", "short", "tinyint") else c)
    return df.select(*out)


class LabelSets:
    """``get(name)`` gives a label set; ``get.path(name)`` a new place in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)

    def path(self, name: str) -> str:
        return shared_path(self.spark, name)


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register ``f(get)``, see ``LabelSets``.  In the SQL, [name] stands for the same label set."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: rounded(f(LabelSets(spark, sf_dir)))
        if sql:
            out = sql
            for x in ("items", "ratings", "human", "gappy", "draws", "nominal", "calls", "probes", "corpus", "conversations", "pages", "system", "iterations", "versions", "consensus"):
                out = out.replace(f"[{x}]", duck(x))
            SQL[name] = out
        return f

    return add


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


H = "sum(CASE WHEN label = 'HIGH' THEN 1 ELSE 0 END)"
L = "sum(CASE WHEN label = 'LOW' THEN 1 ELSE 0 END)"


def panel_sql(source: str, keys: str = "domain", item: str = "domain, item_id", w: str = "0.667") -> str:
    """Panel metrics straight from their definitions, item by item."""
    names = ", ".join(dict.fromkeys([*keys.split(", "), *item.split(", ")]))
    return f"""(WITH i AS (SELECT {names}, count(*)::DOUBLE AS n, {H}::DOUBLE AS h FROM {source} s WHERE label IN ('HIGH', 'LOW') GROUP BY {names}),
 g AS (SELECT {keys}, count(*) AS n, avg(CASE WHEN h = 0 OR h = n THEN 1.0::DOUBLE ELSE {w}::DOUBLE END) AS weighted, avg(CASE WHEN h = 0 OR h = n THEN 1.0::DOUBLE ELSE 0 END) AS all_agree,
 sum(h * (h - 1) + (n - h) * (n - h - 1)) / nullif(sum(n * (n - 1)), 0) AS pairwise, sum(h) / sum(n) AS p FROM i GROUP BY {keys})
 SELECT {keys}, n, weighted, all_agree, pairwise, (pairwise - (p * p + (1 - p) * (1 - p))) / nullif(1 - (p * p + (1 - p) * (1 - p)), 0) AS fleiss_kappa,
 (pairwise - 2 * p * (1 - p)) / nullif(1 - 2 * p * (1 - p), 0) AS gwet_ac1 FROM g)"""


def panel_columns(alias: str = "") -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in ("weighted", "all_agree", "pairwise", "fleiss_kappa", "gwet_ac1"))


def two_sql(pairs: str, keys: str) -> str:
    return f"""(WITH g AS (SELECT {keys}, count(*) AS n, avg((label_a = label_b)::INT)::DOUBLE AS po, avg((label_a = 'HIGH')::INT)::DOUBLE AS pa, avg((label_b = 'HIGH')::INT)::DOUBLE AS pb FROM {pairs} p GROUP BY {keys}),
 e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS ce, (pa + pb) * (1 - (pa + pb) / 2) AS ge FROM g)
 SELECT * EXCLUDE (po, pa, pb, ce, ge), {r6('po')} AS agreement, {r6('(po - ce) / nullif(1 - ce, 0)')} AS cohen_kappa, {r6('(po - ge) / nullif(1 - ge, 0)')} AS gwet_ac1 FROM e)"""


SYSTEM_PAIRS = "(SELECT s.domain, s.item_id, s.label AS label_a, h.label AS label_b FROM [system] s JOIN (SELECT domain, item_id, CASE WHEN " + H + " > " + L + " THEN 'HIGH' ELSE 'LOW' END AS label FROM [consensus] c GROUP BY domain, item_id) h ON s.domain = h.domain AND s.item_id = h.item_id)"
SHAPES = "(SELECT domain, item_id, sum(c)::DOUBLE AS n, count(*) AS kinds, max(c)::DOUBLE AS most, sum(c * (c - 1) / 2)::DOUBLE AS agreeing FROM (SELECT domain, item_id, label, count(*) AS c FROM [nominal] x GROUP BY ALL) y GROUP BY domain, item_id)"
VOTES = f"(SELECT domain, item_id, {H} AS h, {L} AS l FROM [gappy] g GROUP BY domain, item_id)"


def consensus_labels(get):  # noqa: ANN001, ANN201
    return vt.majority(get("consensus"), "plurality_tie_low")


def system_pairs(get):  # noqa: ANN001, ANN201
    return pr.pair_labels(vt.majority(get("ratings")), consensus_labels(get))


# --- text -----------------------------------------------------------------------------------------------------------
@query("p1_truncate", "SELECT item_id, turn, substr(text, 1, 150) AS excerpt FROM [conversations] c")
def _(get):  # noqa: ANN001, ANN202
    return get("conversations").select("item_id", "turn", tx.truncate(F.col("text"), 150).alias("excerpt"))


RESPONSE = "CASE item_id % 5 WHEN 0 THEN concat('REASON: ', text, chr(10), 'LABEL: high', chr(10), 'MATCHED_HIGH: 1, 3,x') WHEN 1 THEN concat('LABEL: LOW', chr(10), 'LABEL: HIGH', chr(10), 'CONFIDENCE: LOW') WHEN 2 THEN concat('I think HIGH', chr(10), 'LABEL: MAYBE') WHEN 3 THEN 'nothing here' ELSE concat('<scratchpad>LABEL: HIGH</scratchpad>', chr(10), 'label: low') END"
#: What the cases above have to give, by hand.
@query("p3_parse_response", "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'HIGH' END AS label, CASE item_id % 5 WHEN 1 THEN 'LOW' END AS confidence, CASE item_id % 5 WHEN 0 THEN trim(coalesce(string_split(text, chr(10))[1], ''), ' ' || chr(9) || chr(13)) ELSE '' END AS reason, CASE item_id % 5 WHEN 0 THEN '1,3' ELSE '' END AS matched FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    df = get("items").select("item_id", F.expr(RESPONSE).alias("response"))
    out = tx.parse_response(df)
    return out.select("item_id", "label", "confidence", "reason", F.array_join(F.transform("matched_high", lambda x: x.cast("string")), ",").alias("matched"))


@query("p4_parse_reasoned", "SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS label FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return tx.parse_reasoned_response(get("items").select("item_id", F.expr(RESPONSE).alias("response"))).select("item_id", "label")


@query("p5_parse_label_only", "SELECT item_id, CASE item_id % 5 WHEN 2 THEN 'LOW' WHEN 3 THEN 'LOW' ELSE 'HIGH' END AS label FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return tx.parse_label_only(get("items").select("item_id", F.expr(RESPONSE).alias("response"))).select("item_id", "label")


@query("p6_parse_int_list", "SELECT item_id, concat(item_id, ',', item_id % 7) AS numbers FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    c = F.concat_ws(", ", F.col("item_id").cast("string"), F.lit("x1"), F.lit(""), (F.col("item_id") % 7).cast("string"))
    return get("items").select("item_id", F.array_join(F.transform(tx.parse_int_list(c), lambda x: x.cast("string")), ",").alias("numbers"))


@query("p7_sanitize_quote", "SELECT item_id, substr(replace(replace(html, '\"', ''''), '\\', ''), 1, 150) AS quote FROM [pages] p")
def _(get):  # noqa: ANN001, ANN202
    return get("pages").select("item_id", tx.sanitize_quote(F.col("html")).alias("quote"))


@query("p9_strip_fences", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '{' || text || '}' ELSE text END AS body FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    head = F.col("text")
    fenced = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("x ```json\n{"), head, F.lit("}\n``` y"))).when(F.col("item_id") % 4 == 2, F.concat(F.lit("```{"), head, F.lit("}```"))).otherwise(head)
    return get("items").select("item_id", tx.strip_fences(fenced).alias("body"))


@query("p12_short_rater_name", "SELECT DISTINCT source AS cluster_id, string_split(concat(source, ':7b'), ':')[1] AS name FROM documents")
def _(get):  # noqa: ANN001, ANN202
    return get("items").select("cluster_id", tx.short_rater_name(F.concat("cluster_id", F.lit(":7b"))).alias("name")).distinct()


@query("p13_labels_to_string", "SELECT domain, item_id, string_agg(label, '|' ORDER BY rater_id) AS labels FROM [ratings] r GROUP BY domain, item_id")
def _(get):  # noqa: ANN001, ANN202
    folded = get("ratings").groupBy("domain", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rater_id", "label"))), lambda x: x.label).alias("labels"))
    back = tx.string_to_labels(tx.labels_to_string(F.col("labels")))
    return folded.select("domain", "item_id", tx.labels_to_string(back).alias("labels"))


@query("p14_content_hash", "SELECT item_id, substr(sha256(text), 1, 16) AS hash FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return get("items").select("item_id", tx.content_hash(F.col("text")).alias("hash"))


@query("p14_dataset_fingerprint", "SELECT count(*) AS n_rows, coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), coalesce(cluster_id, chr(0)), coalesce(domain, chr(0)), coalesce(item_id::VARCHAR, chr(0)))), 1, 12))::BIGINT::HUGEINT), 0)::VARCHAR AS fingerprint FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return tx.dataset_fingerprint(get("items").select("item_id", "domain", "cluster_id"))


@query("p15_valid_labels", "SELECT domain, item_id, rater_id, label FROM [gappy] g WHERE (domain, item_id) NOT IN (SELECT (domain, item_id) FROM [gappy] b WHERE label IS NULL)")
def _(get):  # noqa: ANN001, ANN202
    return vt.valid_labels(get("gappy"), missing="drop_item")


@query("p16_consensus_ratings", "SELECT domain, item_id, annotator_id, label FROM [consensus] c")
def _(get):  # noqa: ANN001, ANN202
    return vt.consensus_ratings(get("human")).select("domain", "item_id", "annotator_id", "label")


@query("p17_word_count_filter", "SELECT item_id FROM [items] i WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) BETWEEN 300 AND 8000")
def _(get):  # noqa: ANN001, ANN202
    return tx.word_count_filter(get("items")).select("item_id")


QUOTED = "concat(chr(34), rater_id, chr(34), ' of ', cast(item_id as varchar(20)), chr(92))"


@query("p18_disagreement_cases", f"""WITH v AS (SELECT domain, item_id, {H} AS votes_high, string_agg(concat(rater_id, '=', label), ',' ORDER BY rater_id) AS votes, string_agg(concat(rater_id, '=', replace(replace({QUOTED}, chr(34), chr(39)), chr(92), '')), ',' ORDER BY rater_id) AS quotes, string_agg(concat(rater_id, '=', label, ' of ', item_id), ',' ORDER BY rater_id) AS reasons, string_agg(concat(rater_id, '=', item_id % 4, '+', item_id % 9), ',' ORDER BY rater_id) AS matched, {L} AS l FROM [ratings] r GROUP BY domain, item_id)
 SELECT v.domain, v.item_id, votes_high, votes, quotes, reasons, matched, substr(i.text, 1, 300) AS excerpt FROM v JOIN [items] i ON v.item_id = i.item_id AND v.domain = i.domain WHERE votes_high > 0 AND l > 0""")
def _(get):  # noqa: ANN001, ANN202
    r = get("ratings").withColumn("criterion_quote", F.concat(F.lit('"'), "rater_id", F.lit('" of '), F.col("item_id").cast("string"), F.lit("\\")))
    numbers = F.array((F.col("item_id") % 4).cast("int"), (F.col("item_id") % 9).cast("int"))
    r = r.withColumns({"reason": F.concat("label", F.lit(" of "), F.col("item_id").cast("string")), "matched_high": numbers, "matched_low": F.array().cast("array<int>")})
    cases = vt.disagreement_cases(vt.panel_vote(r, details=True), get("items"))
    cases = cases.withColumn("matched", F.transform_values("matched_high", lambda _, x: F.array_join(F.transform(x, lambda n: n.cast("string")), "+")))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x.key, F.lit("="), x.value)), ",")
    return cases.select("domain", "item_id", "votes_high", text("votes").alias("votes"), text("quotes").alias("quotes"), text("reasons").alias("reasons"), text("matched").alias("matched"), "excerpt")


# --- joins ----------------------------------------------------------------------------------------------------------
@query("j1_pair_labels", f"SELECT * FROM {SYSTEM_PAIRS} p")
def _(get):  # noqa: ANN001, ANN202
    return system_pairs(get)


@query("j2_pair_many", f"SELECT r.rater_id AS ref, s.domain, s.item_id, s.label AS label_a, r.label AS label_b FROM [system] s JOIN [ratings] r ON s.domain = r.domain AND s.item_id = r.item_id WHERE r.rater_id <> 'r_hash'")
def _(get):  # noqa: ANN001, ANN202
    r = get("ratings")
    return pr.pair_many(get("system"), {x: r.where(F.col("rater_id") == x) for x in ("r_len", "r_words")})


@query("j3_missing_keys", "SELECT domain, item_id, 'human' AS label_set FROM [system] s WHERE item_id NOT IN (SELECT item_id FROM [human] h)")
def _(get):  # noqa: ANN001, ANN202
    return pr.missing_keys(get("system"), {"human": get("human")})


@query("j4_plan_calls", "SELECT 'run' AS run_tag, i.domain, i.item_id, v.v AS rubric_version, r.r AS rater_id, n.n AS repeat FROM [items] i CROSS JOIN (SELECT DISTINCT rater_id AS r FROM [ratings] x) r CROSS JOIN (SELECT unnest(['v0', 'v1']) AS v) v CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS n) n")
def _(get):  # noqa: ANN001, ANN202
    v = get("versions")
    return pr.plan_calls(get("items"), v.select("rater_id").distinct(), v.select("rubric_version").distinct(), 2)


@query("j5_pending_calls", "SELECT 'run' AS run_tag, domain, item_id, 'v0' AS rubric_version, rater_id, 0::BIGINT AS repeat FROM [gappy] g WHERE label IS NULL")
def _(get):  # noqa: ANN001, ANN202
    g = get("gappy").select(F.lit("run").alias("run_tag"), "domain", F.lit("v0").alias("rubric_version"), "item_id", "rater_id", F.lit(0).alias("repeat"), "label")
    return pr.pending_calls(g.drop("label"), g.where("label is not null"))


@query("j7_verify_alignment", "SELECT domain, item_id, CASE WHEN item_id % 11 = 0 THEN 'missing_b' ELSE 'text' END AS problem FROM [items] i WHERE item_id % 11 = 0 OR item_id % 7 = 0")
def _(get):  # noqa: ANN001, ANN202
    i = get("items")
    other = i.where("item_id % 11 <> 0").withColumn("text", F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit("  "), "text", F.lit(" "))))
    return pr.verify_alignment(i, other)


@query("j8_attach_cluster", "SELECT s.domain, i.cluster_id, count(*) AS n FROM [system] s JOIN [items] i ON s.item_id = i.item_id AND s.domain = i.domain GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    return pr.attach_cluster(get("system"), get("items")).groupBy("domain", "cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("j9_link_by_excerpt", "SELECT b.probe_id, min(i.item_id) AS item_id FROM (SELECT probe_id, substr(trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))), 51, 100) AS s FROM [probes] p) b JOIN (SELECT item_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM [items] x) i ON contains(i.t, b.s) WHERE length(b.s) > 0 GROUP BY b.probe_id")
def _(get):  # noqa: ANN001, ANN202
    return pr.link_by_excerpt(get("probes"), get("items"), by=())


@query("j10_paired_versions", f"WITH w AS (SELECT domain, item_id, rubric_version, CASE WHEN {H} IN (0, 3) THEN 1.0::DOUBLE ELSE 0.667::DOUBLE END AS w FROM [versions] v GROUP BY ALL) SELECT a.domain, a.item_id, a.w AS before, b.w AS after, {r6('b.w - a.w')} AS difference FROM w a JOIN w b ON a.domain = b.domain AND a.item_id = b.item_id WHERE a.rubric_version = 'v0' AND b.rubric_version = 'v1'")
def _(get):  # noqa: ANN001, ANN202
    votes = vt.panel_vote(get("versions"), item=("domain", "item_id", "rubric_version"))
    return pr.paired_versions(votes.withColumn("weight", F.when(F.col("all_agree"), 1.0).otherwise(0.667)), "v0", "v1")


@query("j11_swap_rater", "SELECT domain, item_id, rater_id, label FROM [ratings] r WHERE rater_id <> 'r_hash' UNION ALL SELECT h.domain, h.item_id, h.annotator_id AS rater_id, h.label FROM [human] h WHERE h.annotator_id = 'h1'")
def _(get):  # noqa: ANN001, ANN202
    new = get("human").where("annotator_id = 'h1'").withColumnRenamed("annotator_id", "rater_id")
    return pr.swap_rater(get("ratings"), "r_hash", new)


@query("j12_exclude_items", "SELECT domain, item_id FROM [items] i WHERE item_id NOT IN (SELECT item_id FROM [human] h WHERE is_attention_check)")
def _(get):  # noqa: ANN001, ANN202
    return pr.exclude_items(get("items"), get("human").where("is_attention_check")).select("domain", "item_id")


@query("j13_dedup_against", "WITH n AS (SELECT item_id, corpus, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM [corpus] c) SELECT min(item_id) AS item_id FROM n WHERE corpus = 'new' AND t NOT IN (SELECT t FROM n WHERE corpus = 'old') GROUP BY t")
def _(get):  # noqa: ANN001, ANN202
    c = get("corpus")
    return pr.dedup_against(c.where("corpus = 'new'"), c.where("corpus = 'old'")).select("item_id")


# --- aggregations ---------------------------------------------------------------------------------------------------
@query("a1_panel_vote", f"SELECT domain, item_id, CASE WHEN h >= 2 THEN 'HIGH' ELSE 'LOW' END AS signal_level, {r6('CASE WHEN h + l > 0 THEN greatest(h, l)::DOUBLE / (h + l) ELSE 0 END')} AS agreement, h AS votes_high, l AS votes_low, (h + l > 0 AND (h = 0 OR l = 0)) AS all_agree FROM {VOTES} v")
def _(get):  # noqa: ANN001, ANN202
    return vt.panel_vote(get("gappy"))


@query("a2_majority", "SELECT domain, item_id, first(label ORDER BY n DESC, seen, label) AS label FROM (SELECT domain, item_id, label, count(*) AS n, min(rater_id) AS seen FROM [nominal] x GROUP BY ALL) c GROUP BY domain, item_id")
def _(get):  # noqa: ANN001, ANN202
    return vt.majority(get("nominal"), "plurality_first")


@query("a2_majority_tie_low", f"SELECT domain, item_id, CASE WHEN h > l THEN 'HIGH' ELSE 'LOW' END AS label FROM {VOTES} v")
def _(get):  # noqa: ANN001, ANN202
    return vt.majority(get("gappy"), "plurality_tie_low")


@query("a3_weighted_agreement", f"SELECT domain, {r6('avg(CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 3 END)')} AS weighted FROM {SHAPES} s GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return mt.weighted_agreement(get("nominal"))


@query("a4_majority_fraction", f"SELECT domain, {r6('avg(most / n)')} AS agreement FROM {SHAPES} s GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return mt.majority_fraction_agreement(get("nominal"))


@query("a5_all_agree_rate", f"SELECT domain, {r6('avg(CASE WHEN kinds = 1 THEN 1.0::DOUBLE ELSE 0 END)')} AS all_agree FROM {SHAPES} s GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return mt.all_agree_rate(get("nominal"))


@query("a6_pairwise_agreement", f"SELECT domain, {r6('sum(agreeing) / sum(n * (n - 1) / 2)')} AS pairwise FROM {SHAPES} s GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return mt.pairwise_agreement(get("nominal"))


@query("a7_fleiss_kappa", f"SELECT domain, {r6('fleiss_kappa')} AS fleiss_kappa FROM {panel_sql('[ratings]')} p")
def _(get):  # noqa: ANN001, ANN202
    return mt.fleiss_kappa(get("ratings"))


@query("a8_gwet_ac1_panel", f"SELECT domain, {r6('gwet_ac1')} AS gwet_ac1 FROM {panel_sql('[ratings]')} p")
def _(get):  # noqa: ANN001, ANN202
    return mt.gwet_ac1_panel(get("ratings"))


def ac1_sql(source: str, keys: str = "domain", item: str = "item_id") -> str:
    """AC1 for any labels and items of any size from two labels on."""
    k = keys
    return f"""(WITH c AS (SELECT {k}, {item}, label, count(*)::DOUBLE AS c FROM {source} x WHERE label IS NOT NULL GROUP BY ALL), n AS (SELECT {k}, {item}, sum(c) AS n FROM c GROUP BY ALL HAVING sum(c) >= 2),
 i AS (SELECT {k}, count(*) AS k FROM n GROUP BY {k}), po AS (SELECT {k}, sum(c * (c - 1) / (n * (n - 1))) AS s FROM c JOIN n USING ({k}, {item}) GROUP BY {k}),
 pi AS (SELECT {k}, label, sum(c / n) / any_value(k) AS pi FROM c JOIN n USING ({k}, {item}) JOIN i USING ({k}) GROUP BY {k}, label),
 e AS (SELECT {k}, count(*) AS q, sum(pi * (1 - pi)) / nullif(count(*) - 1, 0) AS pe FROM pi GROUP BY {k})
 SELECT {k}, k AS n_items, q AS categories, (s / k - pe) / nullif(1 - pe, 0) AS ac1 FROM i JOIN po USING ({k}) JOIN e USING ({k}))"""


@query("a9_gwet_ac1_nominal", f"SELECT domain, n_items, categories, {r6('ac1')} AS ac1 FROM {ac1_sql('[nominal]')} a")
def _(get):  # noqa: ANN001, ANN202
    return mt.gwet_ac1_nominal(get("nominal"))


@query("a10_panel_metrics", f"SELECT domain, n, {panel_columns()} FROM {panel_sql('[ratings]')} p")
def _(get):  # noqa: ANN001, ANN202
    return mt.panel_metrics(get("ratings"))


@query("a11_two_rater_metrics", f"SELECT * FROM {two_sql(SYSTEM_PAIRS, 'domain')} t")
def _(get):  # noqa: ANN001, ANN202
    return mt.two_rater_metrics(system_pairs(get))


@query("a12_two_rater_rollup", f"SELECT *, false AS overall FROM {two_sql(SYSTEM_PAIRS, 'domain')} t UNION ALL BY NAME SELECT * EXCLUDE (x), NULL AS domain, true AS overall FROM {two_sql('(SELECT *, 1 AS x FROM ' + SYSTEM_PAIRS + ' q)', 'x')} u")
def _(get):  # noqa: ANN001, ANN202
    return mt.two_rater_metrics(system_pairs(get), rollup=True)


@query("a13_rater_prevalence", f"SELECT domain, rater_id, count(*) AS n, {r6('avg(CASE WHEN label = ' + chr(39) + 'HIGH' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0 END)')} AS high_rate FROM [gappy] g WHERE label IS NOT NULL GROUP BY domain, rater_id")
def _(get):  # noqa: ANN001, ANN202
    return rt.rater_prevalence(get("gappy"))


@query("a14_degenerate_raters", f"SELECT domain, rater_id, sum(c) AS n, {r6('(sum(c) - max(c))::DOUBLE / sum(c)')} AS minor_share FROM (SELECT domain, rater_id, label, count(*) AS c FROM [ratings] r GROUP BY ALL) x GROUP BY domain, rater_id HAVING (sum(c) - max(c))::DOUBLE / sum(c) <= 0.3")
def _(get):  # noqa: ANN001, ANN202
    return rt.degenerate_raters(get("ratings"), 0.3)


CELL = f"(SELECT h.domain, h.round, h.item_id, h.label AS label_a, s.label AS label_b FROM (SELECT domain, round, item_id, CASE WHEN {H} > {L} THEN 'HIGH' ELSE 'LOW' END AS label FROM [consensus] c GROUP BY ALL) h JOIN [system] s ON h.domain = s.domain AND h.item_id = s.item_id)"
CELLS = f"(SELECT domain, round, count(*) AS n, sum((label_a = label_b)::INT) AS match, sum((label_b = 'HIGH')::INT) AS system_high, sum((label_a = 'HIGH')::INT) AS reference_high FROM {CELL} c GROUP BY domain, round)"


def cells(get):  # noqa: ANN001, ANN201
    human = vt.majority(get("consensus"), "plurality_tie_low", ("domain", "round", "item_id"))
    pairs = human.withColumnRenamed("label", "label_a").join(get("system").withColumnRenamed("label", "label_b"), ["domain", "item_id"])
    return rf.match_vs_baseline(pairs, ("domain", "round"))


@query("a15_match_vs_baseline", f"SELECT domain, round::BIGINT AS round, n, match, system_high, reference_high, {r6('match::DOUBLE / n')} AS match_rate, {r6('greatest(system_high, n - system_high)::DOUBLE / n')} AS baseline, match > greatest(system_high, n - system_high) AS beats_baseline FROM {CELLS} c")
def _(get):  # noqa: ANN001, ANN202
    return cells(get)


@query("a16_pooled_baseline", f"SELECT sum(n)::BIGINT AS n, sum(match)::BIGINT AS match, {r6('sum(match)::DOUBLE / sum(n)')} AS match_rate, {r6('sum(greatest(system_high, n - system_high))::DOUBLE / sum(n)')} AS baseline, sum((match > greatest(system_high, n - system_high))::INT)::BIGINT AS cells_above FROM {CELLS} c")
def _(get):  # noqa: ANN001, ANN202
    return rf.pooled_baseline(cells(get))


@query("a17_build_gold", f"SELECT h.domain, h.round::BIGINT AS round, h.item_id, CASE WHEN nh > nl THEN 'HIGH' ELSE 'LOW' END AS human_consensus_label, annotator_labels, nh AS n_high, nl AS n_low, s.label AS system_label, ((CASE WHEN nh > nl THEN 'HIGH' ELSE 'LOW' END) = s.label)::BIGINT AS match FROM (SELECT domain, round, item_id, string_agg(label, '|' ORDER BY annotator_id) AS annotator_labels, {H} AS nh, {L} AS nl FROM [consensus] c GROUP BY ALL) h JOIN [system] s ON h.domain = s.domain AND h.item_id = s.item_id")
def _(get):  # noqa: ANN001, ANN202
    return rf.build_gold(get("consensus"), get("system"))


@query("a18_agreement_breakdown", f"WITH v AS (SELECT domain, (h + l > 0 AND (h = 0 OR l = 0)) AS u, greatest(h, l) AS m FROM {VOTES} x), g AS (SELECT domain, count(*) AS evaluated, sum(u::INT) AS unanimous, sum((NOT u AND m >= 2)::INT) AS partial, sum((NOT u)::INT) AS disagreeing FROM v GROUP BY domain) SELECT *, {r6('unanimous::DOUBLE / evaluated')} AS unanimous_rate, {r6('partial::DOUBLE / evaluated')} AS partial_rate, {r6('disagreeing::DOUBLE / evaluated')} AS disagreeing_rate FROM g")
def _(get):  # noqa: ANN001, ANN202
    return vt.agreement_breakdown(vt.panel_vote(get("gappy")))


STABLE = "(SELECT variant, domain, item_id, greatest(h, 5 - h) AS votes, h FROM (SELECT variant, domain, item_id, " + H + " AS h FROM [draws] d GROUP BY ALL) x)"


@query("a19_repeat_stability", f"SELECT variant, domain, count(*) AS n, sum((votes = 5)::INT) AS stable, {r6('avg(votes / 5.0::DOUBLE)')} AS mean_ratio, {r6('avg((votes = 5)::INT)')} AS stable_share FROM {STABLE} s GROUP BY variant, domain UNION ALL SELECT variant, NULL, count(*), sum((votes = 5)::INT), {r6('avg(votes / 5.0::DOUBLE)')}, {r6('avg((votes = 5)::INT)')} FROM {STABLE} s GROUP BY variant")
def _(get):  # noqa: ANN001, ANN202
    return rf.stability_summary(rf.repeat_stability(get("draws"), 5))


@query("a19_repeat_items", "WITH x AS (SELECT variant, domain, item_id, string_agg(label, '|' ORDER BY repeat) AS labels, list(label ORDER BY repeat) AS ls, count(*) AS draws FROM [draws] d GROUP BY ALL), y AS (SELECT *, len(list_filter(ls, lambda z: z = 'HIGH')) AS h FROM x) SELECT variant, domain, item_id, labels, CASE WHEN 2 * h > draws OR (2 * h = draws AND ls[1] = 'HIGH') THEN 'HIGH' ELSE 'LOW' END AS label, greatest(h, draws - h) AS votes, draws, round(greatest(h, draws - h)::DOUBLE / draws, 6) AS ratio, h IN (0, draws) AS stable, draws = 5 AS complete FROM y")
def _(get):  # noqa: ANN001, ANN202
    return rf.repeat_stability(get("draws"), 5).withColumn("labels", F.array_join("labels", "|"))


DRAW_PAIRS = f"(SELECT variant, 'majority' AS labels, s.item_id, CASE WHEN h >= 3 THEN 'HIGH' ELSE 'LOW' END AS label_a, m.label AS label_b FROM {STABLE} s JOIN [system] m ON s.item_id = m.item_id AND s.domain = m.domain UNION ALL SELECT variant, 'single', d.item_id, d.label, m.label FROM [draws] d JOIN [system] m ON d.item_id = m.item_id AND d.domain = m.domain WHERE repeat = 0)"


@query("a20_repeat_majority_vs_reference", f"SELECT * FROM {two_sql(DRAW_PAIRS, 'variant, labels')} t")
def _(get):  # noqa: ANN001, ANN202
    return rf.repeat_majority_vs_reference(get("draws"), get("system"))


RATER_PAIRS = "(SELECT a.domain, a.rater_id AS rater_a, b.rater_id AS rater_b, a.label AS label_a, b.label AS label_b FROM [gappy] a JOIN [gappy] b ON a.domain = b.domain AND a.item_id = b.item_id AND a.rater_id < b.rater_id WHERE a.label IS NOT NULL AND b.label IS NOT NULL)"


@query("a21_rater_pair_matrix", f"SELECT * FROM {two_sql(RATER_PAIRS, 'domain, rater_a, rater_b')} t")
def _(get):  # noqa: ANN001, ANN202
    return rt.rater_pair_matrix(get("gappy"))


@query("a22_panel_subset_sweep", f"""WITH s AS (SELECT unnest(['r_hash+r_len', 'r_hash+r_words', 'r_len+r_words', 'r_hash+r_len+r_words']) AS subset), x AS (SELECT subset, domain, item_id, count(label) AS got, len(string_split(subset, '+')) AS k, {H} AS h FROM s JOIN [gappy] g ON list_contains(string_split(subset, '+'), g.rater_id) GROUP BY ALL),
 a AS (SELECT domain, subset, k, count(*) AS n, sum(greatest(h, k - h))::DOUBLE / (count(*) * k) AS a, ceil(k / 2.0) / k AS floor FROM x WHERE got = k GROUP BY domain, subset, k)
 SELECT domain, subset, k, n, {r6('a')} AS a, round(floor::DOUBLE, 6) AS floor, {r6('(a - floor) / (1 - floor)')} AS a_star, rank() OVER (PARTITION BY domain ORDER BY round(a, 9) DESC) AS rank_a, rank() OVER (PARTITION BY domain ORDER BY round((a - floor) / (1 - floor), 9) DESC) AS rank_a_star FROM a""")
def _(get):  # noqa: ANN001, ANN202
    return rt.panel_subset_sweep(get("gappy"), ["r_hash", "r_len", "r_words"])


VERSION_LABELS = f"(SELECT domain, item_id, rubric_version, CASE WHEN {H} >= 2 THEN 'HIGH' ELSE 'LOW' END AS label FROM [versions] v GROUP BY ALL)"


@query("a23_majority_flips", f"SELECT a.domain, count(*) AS n, sum((a.label <> b.label)::INT) AS flips, sum((a.label = 'HIGH' AND b.label = 'LOW')::INT) AS to_low, sum((a.label = 'LOW' AND b.label = 'HIGH')::INT) AS to_high FROM (SELECT domain, item_id, label FROM [ratings] r WHERE rater_id = 'r_hash') a JOIN [system] b ON a.domain = b.domain AND a.item_id = b.item_id GROUP BY a.domain")
def _(get):  # noqa: ANN001, ANN202
    return rf.majority_flips(get("ratings").where("rater_id = 'r_hash'"), vt.majority(get("ratings")))


@query("a24_inclusion_sensitivity", f"WITH w AS (SELECT domain, item_id, CASE WHEN {H} IN (0, 3) THEN 1.0::DOUBLE ELSE 0.667::DOUBLE END AS w, item_id IN (SELECT item_id FROM [human] h WHERE is_attention_check) AS flag FROM [ratings] r GROUP BY domain, item_id), g AS (SELECT domain, count(*) AS n_all, sum(flag::INT) AS n_flagged, avg(w) AS a, avg(CASE WHEN NOT flag THEN w END) AS b FROM w GROUP BY domain) SELECT domain, n_all, n_flagged, {r6('a')} AS with_flagged, {r6('b')} AS without_flagged, {r6('b - a')} AS difference, (round(a, 9) >= 0.8) <> (round(b, 9) >= 0.8) AS verdict_changes FROM g")
def _(get):  # noqa: ANN001, ANN202
    return rf.inclusion_sensitivity(get("ratings"), get("human").where("is_attention_check"))


@query("a25_leave_one_out_fit", """WITH o AS (SELECT domain, item_id, list_sort(list(label)) AS recorded FROM [ratings] r WHERE rater_id <> 'r_words' GROUP BY ALL), f AS (SELECT r.domain, x.dropped, r.item_id, list_sort(list(r.label)) AS rest FROM [ratings] r CROSS JOIN (SELECT unnest(['r_hash', 'r_len', 'r_words']) AS dropped) x WHERE r.rater_id <> x.dropped GROUP BY ALL),
 g AS (SELECT f.domain, dropped, count(*) AS n, sum((rest = recorded)::INT) AS fitting FROM f JOIN o ON f.domain = o.domain AND f.item_id = o.item_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY domain ORDER BY fitting DESC, dropped) AS rank FROM g""")
def _(get):  # noqa: ANN001, ANN202
    official = get("ratings").where("rater_id <> 'r_words'").groupBy("domain", "item_id").agg(F.array_join(F.collect_list("label"), "|").alias("labels"))
    return rt.leave_one_out_fit(get("ratings"), official)


@query("a26_reinstate_rater", f"SELECT a.domain, a.item_id, CASE WHEN h > l THEN 'HIGH' ELSE 'LOW' END AS with_all, CASE WHEN h2 > l2 THEN 'HIGH' ELSE 'LOW' END AS without, s.label AS other, (h > l) <> (h2 > l2) AS changed FROM (SELECT domain, item_id, {H} AS h, {L} AS l, sum((label = 'HIGH' AND rater_id <> 'r_words')::INT) AS h2, sum((label = 'LOW' AND rater_id <> 'r_words')::INT) AS l2 FROM [ratings] r GROUP BY ALL) a JOIN (SELECT * FROM [ratings] z WHERE rater_id = 'r_len') s ON a.domain = s.domain AND a.item_id = s.item_id")
def _(get):  # noqa: ANN001, ANN202
    return rt.reinstate_rater(get("ratings"), "r_words", get("ratings").where("rater_id = 'r_len'"))


REINSTATED = f"(SELECT a.domain, a.item_id, CASE WHEN h > l THEN 'HIGH' ELSE 'LOW' END AS with_all, CASE WHEN h2 > l2 THEN 'HIGH' ELSE 'LOW' END AS without, s.label AS other FROM (SELECT domain, item_id, {H} AS h, {L} AS l, sum((label = 'HIGH' AND rater_id <> 'r_words')::INT) AS h2, sum((label = 'LOW' AND rater_id <> 'r_words')::INT) AS l2 FROM [ratings] r GROUP BY ALL) a JOIN (SELECT * FROM [ratings] z WHERE rater_id = 'r_len') s ON a.domain = s.domain AND a.item_id = s.item_id)"
BOTH_SIDES = f"(SELECT domain, 'with_all' AS consensus, with_all AS label_a, other AS label_b FROM {REINSTATED} q UNION ALL SELECT domain, 'without', without, other FROM {REINSTATED} q)"


@query("a26_reinstatement_metrics", f"SELECT * FROM {two_sql(BOTH_SIDES, 'domain, consensus')} t")
def _(get):  # noqa: ANN001, ANN202
    return rt.reinstatement_metrics(rt.reinstate_rater(get("ratings"), "r_words", get("ratings").where("rater_id = 'r_len'")))


@query("a27_missing_label_report", "WITH r AS (SELECT domain, rater_id, count(*) AS n, count(label) AS valid FROM [gappy] g GROUP BY ALL), i AS (SELECT domain, item_id, count(*) - count(label) AS lacking, count(DISTINCT label) AS kinds FROM [gappy] g GROUP BY ALL) SELECT r.domain, rater_id, n, valid, n - valid AS missing, items_lacking, rest_agrees FROM r JOIN (SELECT domain, sum((lacking > 0)::INT) AS items_lacking, sum((lacking > 0 AND kinds = 1)::INT) AS rest_agrees FROM i GROUP BY domain) j USING (domain)")
def _(get):  # noqa: ANN001, ANN202
    return rt.missing_label_report(get("gappy"))


@query("a27_complete_cases", f"SELECT domain, n, {panel_columns()} FROM {panel_sql('(SELECT * FROM [gappy] a WHERE item_id NOT IN (SELECT item_id FROM [gappy] b WHERE label IS NULL))')} p")
def _(get):  # noqa: ANN001, ANN202
    return mt.panel_metrics(rt.complete_cases(get("gappy")))


@query("a28_compare_conditions", f"WITH p AS (SELECT * FROM {panel_sql('[versions]', 'domain, rubric_version')} q) SELECT p.domain, p.rubric_version, p.n, {', '.join(r6('p.' + c) + ' AS ' + c for c in ('weighted', 'all_agree', 'pairwise', 'fleiss_kappa', 'gwet_ac1'))}, {r6('p.weighted - b.weighted')} AS weighted_delta, {r6('p.gwet_ac1 - b.gwet_ac1')} AS ac1_delta FROM p JOIN p b ON p.domain = b.domain AND b.rubric_version = 'v0'")
def _(get):  # noqa: ANN001, ANN202
    return rf.compare_conditions(get("versions"), "rubric_version", "v0")


@query("a29_split_profile", f"SELECT domain, count(*) AS n_items, sum((kinds = 1)::INT) AS unanimous, sum((kinds > 1 AND kinds < n)::INT) AS partly, sum((kinds = n)::INT) AS all_different, {r6('avg(agreeing / (n * (n - 1) / 2))')} AS mean_pair_agreement FROM {SHAPES} s WHERE n >= 2 GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return rt.split_profile(get("nominal"))


@query("a30_cluster_coverage", "SELECT corpus, count(*) AS clusters, max(n) AS most_items, sum(n)::BIGINT AS items FROM (SELECT corpus, cluster_id, count(*) AS n FROM [corpus] c GROUP BY ALL) x GROUP BY corpus")
def _(get):  # noqa: ANN001, ANN202
    return rt.cluster_coverage(get("corpus"))


@query("a30_merged_coverage", "SELECT corpus, count(*) AS items, count(DISTINCT concat(cluster_id, '|', item_id % 997)) AS clusters, true AS within FROM [corpus] c GROUP BY corpus")
def _(get):  # noqa: ANN001, ANN202
    """Sketches of seven batches, merged, beside the exact number of clusters: within four standard errors of it."""
    named = get("corpus").select("corpus", "item_id", F.concat("cluster_id", F.lit("|"), (F.col("item_id") % 997).cast("string")).alias("cluster_id"))
    batches = rt.cluster_sketches(named.withColumn("batch", F.col("item_id") % 7), ("corpus", "batch"))
    merged = rt.merged_coverage(batches).withColumnRenamed("clusters", "estimate")
    exact = rt.cluster_coverage(named.where("cluster_id is not null"), ("corpus",)).select("corpus", "clusters")
    return merged.join(exact, "corpus").select("corpus", "items", "clusters", (F.abs(F.col("estimate") - F.col("clusters")) <= 0.026 * F.col("clusters") + 1).alias("within"))


@query("a31_label_distribution", f"WITH x AS (SELECT domain, rater_id, label FROM [ratings] r UNION ALL SELECT domain, 'majority', label FROM [system] s) SELECT domain, rater_id, count(*) AS n, {r6('avg((label = ' + chr(39) + 'HIGH' + chr(39) + ')::INT)')} AS high_rate FROM x GROUP BY domain, rater_id UNION ALL SELECT NULL, rater_id, count(*), {r6('avg((label = ' + chr(39) + 'HIGH' + chr(39) + ')::INT)')} FROM x GROUP BY rater_id")
def _(get):  # noqa: ANN001, ANN202
    return rt.label_distribution(get("ratings"))


@query("a32_criterion_counts", f"WITH s AS (SELECT domain, item_id FROM [ratings] r GROUP BY ALL HAVING {H} IN (1, 2)), m AS (SELECT domain, rater_id, label AS side, unnest([item_id % 3 + 1, item_id % 2 + 4]) AS criterion FROM [ratings] r WHERE (domain, item_id) IN (SELECT (domain, item_id) FROM s)) SELECT domain, rater_id, side, criterion, count(*) AS n FROM m GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    pair = F.array(F.col("item_id") % 3 + 1, F.col("item_id") % 2 + 4)
    empty = F.array().cast("array<bigint>")
    r = get("ratings").withColumns({"matched_high": F.when(F.col("label") == "HIGH", pair).otherwise(empty), "matched_low": F.when(F.col("label") == "LOW", pair).otherwise(empty)})
    return rt.criterion_counts(r, vt.panel_vote(get("ratings")))


@query("a32_quote_counts", f"SELECT domain, rater_id, q AS quote, count(*) AS n FROM (SELECT domain, rater_id, concat(chr(39), label, chr(39), item_id % 5) AS q FROM [ratings] r WHERE (domain, item_id) IN (SELECT (domain, item_id) FROM (SELECT domain, item_id, {H} AS h, {L} AS l FROM [ratings] x GROUP BY ALL) v WHERE h > 0 AND l > 0)) y GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    r = get("ratings").withColumn("criterion_quote", F.concat(F.lit('"'), "label", F.lit('"\\'), (F.col("item_id") % 5).cast("string")))
    return rt.quote_counts(r, vt.panel_vote(r))


@query("a33_cost_rollup", f"WITH c AS (SELECT domain AS role, length(text) AS i, turn AS o FROM [conversations] x), g AS (SELECT role, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM c GROUP BY role), p AS (SELECT *, (input_tokens * 1.0::DOUBLE + output_tokens * 5.0::DOUBLE) / 1000000 AS cost FROM g) SELECT role, calls, input_tokens, output_tokens, {r6('cost')} AS cost, {r6('input_tokens::DOUBLE / calls')} AS mean_input, {r6('output_tokens::DOUBLE / calls')} AS mean_output, {r6('cost * 1000 / calls')} AS cost_per_1k, {r6('(cost * 1000 / calls) / min(cost * 1000 / calls) OVER ()')} AS ratio FROM p")
def _(get):  # noqa: ANN001, ANN202
    calls = get("conversations").select(F.col("domain").alias("role"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return rf.cost_rollup(calls, calls.select("role").distinct().withColumns({"input_price": F.lit(1.0), "output_price": F.lit(5.0)}))


@query("a34_reliability_table")
def _(get):  # noqa: ANN001, ANN202
    return rf.reliability_table(get("consensus").withColumnRenamed("annotator_id", "rater_id"), get("ratings"))


# --- resampling -----------------------------------------------------------------------------------------------------
MATCHES = f"(SELECT domain, item_id, (label_a = label_b)::INT::DOUBLE AS value FROM {SYSTEM_PAIRS} p)"


def matches(get):  # noqa: ANN001, ANN201
    return system_pairs(get).withColumn("value", rs.value_of(F.col("label_a") == F.col("label_b")))


@query("r1_bootstrap_mean_ci")
def _(get):  # noqa: ANN001, ANN202
    return rs.bootstrap_mean_ci(matches(get), "value")


@query("r2_cluster_bootstrap_ci")
def _(get):  # noqa: ANN001, ANN202
    return rs.both_cis(pr.attach_cluster(matches(get), get("items")), "value")


@query("r3_bootstrap_ac1_ci")
def _(get):  # noqa: ANN001, ANN202
    return rs.bootstrap_ac1_ci(get("nominal"))


@query("r4_bootstrap_panel_ci")
def _(get):  # noqa: ANN001, ANN202
    return rs.bootstrap_panel_ci(get("ratings"), "weighted")


@query("r5_difference_ci")
def _(get):  # noqa: ANN001, ANN202
    domains = sorted(r.domain for r in get("ratings").where("domain is not null").select("domain").distinct().collect())  # configuration-sized
    return rs.difference_ci(get("ratings"), list(combinations(domains, 2)))


@query("r6_cohort_shift")
def _(get):  # noqa: ANN001, ANN202
    return rs.cohort_shift(get("consensus").withColumnRenamed("annotator_id", "rater_id"), "round", 1, 2)


@query("r7_percentile_at", "WITH x AS (SELECT source AS g, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT g, max(CASE WHEN i = floor(n * 0.025::DOUBLE) THEN v END) AS low, max(CASE WHEN i = greatest(0, floor(n * 0.975::DOUBLE) - 1) THEN v END) AS high, max(n) AS kept FROM x GROUP BY g")
def _(get):  # noqa: ANN001, ANN202
    return rs.percentile_at(get("items").select(F.col("cluster_id").alias("g"), F.length("text").cast("double").alias("value")), ["g"], "count")


@query("r7_percentile_span", "WITH x AS (SELECT source AS g, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT g, max(CASE WHEN i = floor((n - 1) * 0.025::DOUBLE) THEN v END) AS low, max(CASE WHEN i = floor((n - 1) * 0.975::DOUBLE) THEN v END) AS high, max(n) AS kept FROM x GROUP BY g")
def _(get):  # noqa: ANN001, ANN202
    return rs.percentile_at(get("items").select(F.col("cluster_id").alias("g"), F.length("text").cast("double").alias("value")), ["g"], "span")


@query("r8_hash_bootstrap", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_id) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM {MATCHES} x),
 d AS (SELECT m.domain, b.b, ('0x' || substr(md5(concat('s|', b.b, '|', m.i)), 1, 8))::BIGINT % m.n AS i FROM m CROSS JOIN (SELECT unnest(range(0, 40)) AS b) b),
 v AS (SELECT d.domain, d.b, sum(m.value) / count(*)::DOUBLE AS v FROM d JOIN m ON d.domain = m.domain AND d.i = m.i GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM v)
 SELECT domain, {r6('max(CASE WHEN i = floor(n * 0.025::DOUBLE) THEN v END)')} AS low, {r6('max(CASE WHEN i = greatest(0, floor(n * 0.975::DOUBLE) - 1) THEN v END)')} AS high, max(n) AS kept FROM k GROUP BY domain""")
def _(get):  # noqa: ANN001, ANN202
    return rs.md5_ratio_ci(rs.sized(matches(get)), 40, "s").select("domain", "low", "high", "kept")


@query("r9_metric_floor", f"WITH g AS (SELECT domain, n::BIGINT AS k, count(*) AS n, avg(most / n) AS a FROM {SHAPES} s GROUP BY domain, n), f AS (SELECT *, ceil(k / 3.0::DOUBLE) / k::DOUBLE AS floor FROM g) SELECT domain, k, {r6('a')} AS agreement, {r6('floor')} AS floor, CASE WHEN floor < 1 THEN greatest(0, ceil(round(n * (0.8::DOUBLE - floor) / (1 - floor), 9))) ELSE 0 END::BIGINT AS required_unanimous, CASE WHEN floor < 1 THEN {r6('(a - floor) / (1 - floor)')} END AS normalised FROM f")
def _(get):  # noqa: ANN001, ANN202
    sized = mt.item_shapes(get("nominal")).groupBy("domain", F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("most") / F.col("n")).alias("agreement"))
    return mt.with_metric_floor(sized, "agreement", F.col("k"), F.lit(3), 0.8, F.col("n")).drop("n")


# --- history --------------------------------------------------------------------------------------------------------
HISTORY = f"(SELECT domain, iteration::BIGINT AS iteration, weighted, all_agree FROM {panel_sql('[iterations]', 'domain, iteration', 'domain, item_id, iteration')} p)"
WIN = "OVER (PARTITION BY domain ORDER BY iteration)"


def history(get):  # noqa: ANN001, ANN201
    p = mt.panel_metrics(get("iterations"), ("domain", "iteration"), ("domain", "item_id", "iteration"))
    return p.select("domain", "iteration", "weighted", "all_agree")


W2 = f"{r6('weighted')} AS weighted, {r6('all_agree')} AS all_agree"


@query("w1_iteration_delta", f"SELECT domain, iteration, {W2}, {r6(f'weighted - coalesce(lag(weighted) {WIN}, 0)')} AS delta FROM {HISTORY} h")
def _(get):  # noqa: ANN001, ANN202
    return hs.iteration_delta(history(get))


@query("w2_stagnation_flag", f"SELECT domain, iteration, {W2}, coalesce(abs(weighted - lag(weighted) {WIN}) < 0.02 AND abs(lag(weighted) {WIN} - lag(weighted, 2) {WIN}) < 0.02, false) AS stagnated FROM {HISTORY} h")
def _(get):  # noqa: ANN001, ANN202
    return hs.stagnation_flag(history(get))


PAPER = f"coalesce(round(weighted - lag(weighted) {WIN}, 12) <= 0 AND round(lag(weighted) {WIN} - lag(weighted, 2) {WIN}, 12) <= 0 AND round(lag(weighted, 2) {WIN} - lag(weighted, 3) {WIN}, 12) <= 0, false)"
#: The history read backwards, in which agreement falls.
FALLING = f"(SELECT domain, 11 - iteration AS iteration, weighted, all_agree FROM {HISTORY} f)"


@query("w2_stagnation_paper", f"SELECT domain, iteration, {W2}, {PAPER} AS stagnated FROM {FALLING} h")
def _(get):  # noqa: ANN001, ANN202
    return hs.stagnation_flag(history(get).withColumn("iteration", 11 - F.col("iteration")), "paper")


@query("w3_best_labels", f"SELECT i.domain, i.item_id, i.rater_id, i.iteration::BIGINT AS iteration, i.label FROM [iterations] i JOIN (SELECT domain, iteration FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weighted DESC, iteration) AS k FROM {HISTORY} h) x WHERE k = 1) b ON i.domain = b.domain AND i.iteration = b.iteration")
def _(get):  # noqa: ANN001, ANN202
    return hs.best_labels(get("iterations"), history(get))


@query("w3_best_iteration", f"SELECT domain, iteration, {W2} FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weighted DESC, iteration) AS k FROM {HISTORY} h) x WHERE k = 1")
def _(get):  # noqa: ANN001, ANN202
    return hs.best_iteration(history(get))


@query("w3_best_so_far", f"SELECT domain, iteration, {W2}, {r6(f'max(weighted) {WIN}')} AS best FROM {HISTORY} h")
def _(get):  # noqa: ANN001, ANN202
    return hs.best_so_far(history(get))


@query("w4_converged_at", f"SELECT domain, min(CASE WHEN weighted >= 0.95 THEN iteration END) AS converged_at FROM {HISTORY} h GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    return hs.converged_at(history(get), 0.95)


@query("w5_regression_flag", f"SELECT domain, iteration, {W2}, coalesce(bool_or(weighted >= 0.9) OVER (PARTITION BY domain ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AND round(lag(weighted) {WIN} - weighted, 12) > 0.005, false) AS regressed FROM {FALLING} h")
def _(get):  # noqa: ANN001, ANN202
    return hs.regression_flag(history(get).withColumn("iteration", 11 - F.col("iteration")), 0.9, 0.005)


REGRESSED = f"(SELECT *, coalesce(bool_or(weighted >= 0.9) OVER (PARTITION BY domain ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AND round(lag(weighted) {WIN} - weighted, 12) > 0.005, false) AS regressed FROM {FALLING} h)"


@query("w6_calibration_summary", f"""WITH h AS (SELECT *, coalesce(max(CASE WHEN weighted >= 0.9 THEN iteration END) OVER (PARTITION BY domain), 0) AS reached, coalesce(max(CASE WHEN regressed THEN iteration END) OVER (PARTITION BY domain), 0) AS fell FROM {REGRESSED} r),
 x AS (SELECT domain, count(DISTINCT item_id) AS n FROM [human] y WHERE is_attention_check GROUP BY domain)
 SELECT h.domain, {r6('last(weighted ORDER BY iteration)')} AS final_weighted, {r6('last(all_agree ORDER BY iteration)')} AS final_all_agree, {r6('max(weighted)')} AS best_weighted, first(iteration ORDER BY weighted DESC, iteration) AS best_iteration,
 string_agg(round(round(weighted, 3) * 1000)::BIGINT::VARCHAR, ',' ORDER BY iteration) AS weighted_history, string_agg(round(round(all_agree, 3) * 1000)::BIGINT::VARCHAR, ',' ORDER BY iteration) AS all_agree_history,
 max(reached) > 0 AND max(reached) >= max(fell) AS converged, bool_or(regressed) AS regression_detected, count(*) AS iterations, last((10 - iteration)::VARCHAR ORDER BY iteration) AS final_version, first((10 - iteration)::VARCHAR ORDER BY weighted DESC, iteration) AS best_version,
 coalesce(any_value(x.n), 0) AS irreducible_count, count(*) - 1 AS rubric_changes FROM h LEFT JOIN x ON h.domain = x.domain GROUP BY h.domain""")
def _(get):  # noqa: ANN001, ANN202
    flagged = get("human").where("is_attention_check").select("domain", "item_id")
    backwards = history(get).withColumns({"iteration": 11 - F.col("iteration"), "rubric_version": (F.col("iteration") - 1).cast("string")})
    out = hs.calibration_summary(backwards, 0.9, 0.005, irreducible=flagged)
    thousandths = lambda c: F.array_join(F.transform(c, lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return out.withColumns({c: thousandths(c) for c in ("weighted_history", "all_agree_history")})


@query("w7_latest_call", "SELECT domain, item_id, ingest_seq, label FROM [calls] c QUALIFY row_number() OVER (PARTITION BY domain, item_id ORDER BY ingest_seq DESC) = 1")
def _(get):  # noqa: ANN001, ANN202
    return vt.latest_call(get("calls"), ("domain", "item_id")).select("domain", "item_id", "ingest_seq", "label")


@query("w8_round_of", "SELECT domain, item_id, item_id % 2 + 1 AS round FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return vt.round_of(get("items")).select("domain", "item_id", "round")


@query("w9_loop_action", f"WITH s AS (SELECT *, coalesce(abs(weighted - lag(weighted) {WIN}) < 0.02 AND abs(lag(weighted) {WIN} - lag(weighted, 2) {WIN}) < 0.02, false) AS st FROM {HISTORY} h) SELECT domain, iteration, {W2}, CASE WHEN weighted >= 0.97 THEN 'converged' WHEN st THEN 'stagnated' WHEN iteration >= 10 THEN 'done' ELSE 'revise' END AS action FROM s")
def _(get):  # noqa: ANN001, ANN202
    return hs.loop_action(history(get), 0.97, 10)


# --- top-k and sets -------------------------------------------------------------------------------------------------
@query("k1_top_cases", f"SELECT domain, item_id FROM (SELECT domain, item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS k FROM (SELECT domain, item_id FROM [ratings] r GROUP BY ALL HAVING {H} IN (1, 2)) x) y WHERE k <= 8")
def _(get):  # noqa: ANN001, ANN202
    return pr.top_cases(vt.panel_vote(get("ratings")).where(~F.col("all_agree"))).select("domain", "item_id")


@query("k2_last_changes", f"SELECT domain, iteration FROM {HISTORY} h QUALIFY row_number() OVER (PARTITION BY domain ORDER BY iteration DESC) <= 3")
def _(get):  # noqa: ANN001, ANN202
    return pr.last_changes(history(get)).select("domain", "iteration")


@query("k3_ordered_output", "SELECT domain, item_id, label, row_number() OVER (ORDER BY domain, item_id) - 1 AS position FROM [system] s")
def _(get):  # noqa: ANN001, ANN202
    return vt.with_row_index(vt.majority(get("ratings")), order=["domain", "item_id"], name="position")


@query("k4_best_subset", "WITH o AS (SELECT domain, item_id, list_sort(list(label)) AS recorded FROM [ratings] r WHERE rater_id <> 'r_words' GROUP BY ALL), f AS (SELECT r.domain, x.dropped, r.item_id, list_sort(list(r.label)) AS rest FROM [ratings] r CROSS JOIN (SELECT unnest(['r_hash', 'r_len', 'r_words']) AS dropped) x WHERE r.rater_id <> x.dropped GROUP BY ALL), g AS (SELECT f.domain, dropped, count(*) AS n, sum((rest = recorded)::INT) AS fitting FROM f JOIN o ON f.domain = o.domain AND f.item_id = o.item_id GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY domain ORDER BY fitting DESC, dropped) = 1")
def _(get):  # noqa: ANN001, ANN202
    official = get("ratings").where("rater_id <> 'r_words'").groupBy("domain", "item_id").agg(F.array_join(F.collect_list("label"), "|").alias("labels"))
    return rt.best_subset(rt.leave_one_out_fit(get("ratings"), official))


@query("u1_pool_rounds", "SELECT domain, item_id, round::BIGINT AS round, annotator_id, label FROM [consensus] c")
def _(get):  # noqa: ANN001, ANN202
    c = get("consensus").select("domain", "item_id", "round", "annotator_id", "label")
    return pr.pool_rounds(c.where("round = 1"), c.where("round = 2"))


@query("u2_shared_clusters", "SELECT cluster_id FROM [corpus] c WHERE corpus = 'new' INTERSECT SELECT cluster_id FROM [corpus] c WHERE corpus = 'old'")
def _(get):  # noqa: ANN001, ANN202
    c = get("corpus")
    return pr.shared_clusters(c.where("corpus = 'new'"), c.where("corpus = 'old'"))


@query("u3_keys_minus", "SELECT domain, item_id FROM [system] s EXCEPT ALL SELECT DISTINCT domain, item_id FROM [human] h")
def _(get):  # noqa: ANN001, ANN202
    return pr.keys_minus(get("system"), get("human").select("domain", "item_id").distinct())


@query("u4_common_items", "SELECT domain, item_id FROM [system] s INTERSECT SELECT domain, item_id FROM [human] h INTERSECT SELECT domain, item_id FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return pr.common_items(get("system"), get("human"), get("items"))


#: Columns that DuckDB's sums make wider than a long.
WHOLE = {
    "p18_disagreement_cases": "votes_high",
    "a1_panel_vote": "votes_high votes_low",
    "a14_degenerate_raters": "n",
    "a15_match_vs_baseline": "match system_high reference_high",
    "a17_build_gold": "n_high n_low",
    "a18_agreement_breakdown": "unanimous partial disagreeing",
    "a19_repeat_stability": "stable",
    "a23_majority_flips": "flips to_low to_high",
    "a24_inclusion_sensitivity": "n_flagged",
    "a25_leave_one_out_fit": "fitting",
    "a27_missing_label_report": "items_lacking rest_agrees",
    "a29_split_profile": "unanimous partly all_different",
    "k4_best_subset": "fitting",
}

for _name, _columns in WHOLE.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in _columns.split())}) FROM ({SQL[_name]}) whole"
