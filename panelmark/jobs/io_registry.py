"""Queries of the readers, writers, prompts, plug-ins and streams.  What they read is first written from the given
tables to the shared folder, in the form that the reader takes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmark.functions import text as tx
from panelmark.jobs import loop
from panelmark.jobs.registry import CELLS, H, L, VOTES, cells, panel_columns, panel_sql, query, r6
from panelmark.operators import metrics as mt
from panelmark.operators import pairs as pr
from panelmark.operators import reference as rf
from panelmark.operators import votes as vt
from panelmark.operators.keys import joined
from panelmark.sources import tables as tb
from panelmark.sources.calls import CallLog
from panelmark.streaming import intake


def put_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


# --- sources and sinks ----------------------------------------------------------------------------------------------
@query("s1_read_items_csv", "SELECT domain, sha256(coalesce(text, '')) AS hash, count(*) AS n FROM [items] i GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    path = put_csv(get("items").select("domain", F.col("text").alias("transcript")), get.path("items-csv"))
    return tb.read_items_csv(get.spark, path).groupBy("domain", digest("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def name_by_domain(spark: SparkSession, path: str) -> str:
    """Rename the files of a table partitioned by domain to <domain>_<number>.jsonl, all in one folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}-named"))
    for part in [x.getPath() for x in system.listStatus(folder) if x.getPath().getName().startswith("domain=")]:
        files = [x.getPath() for x in system.listStatus(part)]
        for i, file in enumerate(x for x in files if x.getName().startswith("part-")):
            system.rename(file, spark._jvm.org.apache.hadoop.fs.Path(f"{path}-named/{part.getName().split('=')[1]}_{i}.jsonl"))
    return f"{path}-named"


@query("s2_read_items_jsonl", "SELECT domain, sha256(coalesce(text, '')) AS hash, count(*) AS n FROM [items] i GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    path = get.path("items-jsonl")
    get("items").select("domain", F.concat(F.to_json(F.struct(F.col("text").alias("transcript"))), F.lit("\n")).alias("value")).write.partitionBy("domain").text(path)
    return tb.read_items_jsonl(get.spark, name_by_domain(get.spark, path)).groupBy("domain", digest("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"))


def rubrics(get) -> DataFrame:  # noqa: ANN001
    """A rubric per domain, from the items."""
    by = get("items").where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    d = F.col("domain")
    return by.select("domain", F.col("n").cast("string").alias("version"), F.concat(F.lit("about "), d).alias("domain_context"), F.array(F.concat(F.lit("clear "), d), F.lit("new")).alias("HIGH"), F.array(F.lit("thin")).alias("LOW"), F.lit("LOW wins").alias("conflict_rule"))


@query("s3_read_rubrics", "SELECT domain, count(*)::VARCHAR AS version, concat('about ', domain) AS domain_context, concat('clear ', domain, '|new') AS high, 'thin' AS low, 'LOW wins' AS conflict_rule FROM [items] i WHERE domain IS NOT NULL GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    path = get.path("rubrics")
    entry = F.struct("domain", F.struct(F.col("version").cast("int").alias("version"), "domain_context", "HIGH", "LOW", "conflict_rule"))
    rubrics(get).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)  # one row per domain
    return tb.read_rubrics(get.spark, path).select("domain", "version", "domain_context", F.array_join("HIGH", "|").alias("high"), F.array_join("LOW", "|").alias("low"), "conflict_rule")


RATERS = ["r_hash", "r_len", "r_words"]


def wide(get) -> DataFrame:  # noqa: ANN001
    labels = get("gappy").groupBy("domain", "item_id").pivot("rater_id", RATERS).agg(F.first("label"))
    return vt.panel_vote(get("gappy")).join(labels, ["domain", "item_id"])


@query("s4_read_panel_labels", f"SELECT g.domain, g.item_id, g.rater_id, g.label, greatest(h, l)::BIGINT AS most, (h + l > 0 AND (h = 0 OR l = 0)) AS all_agree FROM [gappy] g JOIN {VOTES} v ON g.domain = v.domain AND g.item_id = v.item_id")
def _(get):  # noqa: ANN001, ANN202
    panel = wide(get).withColumnRenamed("item_id", "transcript_index").withColumn("all_agree", F.initcap(F.col("all_agree").cast("string")))
    read = tb.read_panel_labels(get.spark, put_csv(panel, get.path("panel-csv")))
    long = tb.panel_to_ratings(read, {r: r for r in RATERS})
    return long.join(read.select("domain", "item_id", F.greatest("votes_high", "votes_low").alias("most"), "all_agree"), ["domain", "item_id"])


@query("s5_read_human_ratings", "SELECT domain, round::BIGINT AS round, item_id, annotator_id, label FROM [consensus] c")
def _(get):  # noqa: ANN001, ANN202
    title = lambda c: F.initcap(F.col(c).cast("string"))
    h = get("human").select("domain", "round", F.col("item_id").alias("transcript_index"), F.col("item_id").cast("string").alias("item_id"), title("is_attention_check").alias("is_attention_check"), "annotator_id", title("included_in_consensus").alias("included_in_consensus"), "label", F.lit(3).alias("confidence"), F.lit('so "it" is\nhere').alias("justification"))
    read = tb.read_human_ratings(get.spark, put_csv(h, get.path("human-csv")))
    return vt.consensus_ratings(read.where("justification like 'so \"it\"%here'")).select("domain", "round", "item_id", "annotator_id", "label")


@query("s6_read_batch_export", "SELECT item_id::VARCHAR AS transcript_id, concat('Annotator', substr(annotator_id, 2)) AS rater_id, label FROM [human] h WHERE domain = 'en' AND NOT is_attention_check")
def _(get):  # noqa: ANN001, ANN202
    h = get("human").groupBy("domain", "item_id").pivot("annotator_id", ["h1", "h2", "h3"]).agg(F.first(F.when(~F.col("is_attention_check"), F.concat(F.lower("label"), F.lit(" "))).otherwise(" ")))
    export = h.select(F.concat("domain", F.lit(": is it good?")).alias("Question"), F.lit("t").alias("transcript"), F.col("item_id").alias("transcript_id"), *(F.col(f"h{k}").alias(f"Annotator{k}_Response") for k in (1, 2, 3)))
    return tb.read_batch_export(get.spark, put_csv(export, get.path("batch-csv")), "en: ").select("transcript_id", "rater_id", "label")


@query("s7_write_panel_labels", f"SELECT v.domain, v.item_id, h::BIGINT AS votes_high, l::BIGINT AS votes_low, a.label AS r_len_label FROM {VOTES} v JOIN [gappy] a ON a.domain = v.domain AND a.item_id = v.item_id AND a.rater_id = 'r_len'")
def _(get):  # noqa: ANN001, ANN202
    path = get.path("panel-labels")
    tb.write_panel_labels(vt.panel_vote(get("gappy")), get("gappy"), RATERS, path)
    return get.spark.read.parquet(path).select("domain", "item_id", "votes_high", "votes_low", "r_len_label")


@query("s8_write_gold", f"SELECT h.domain, h.round::BIGINT AS round, h.item_id, CASE WHEN nh > nl THEN 'HIGH' ELSE 'LOW' END AS human_consensus_label, labels AS annotator_labels, s.label AS system_label FROM (SELECT domain, round, item_id, string_agg(label, '|' ORDER BY annotator_id) AS labels, {H} AS nh, {L} AS nl FROM [consensus] c GROUP BY ALL) h JOIN [system] s ON h.domain = s.domain AND h.item_id = s.item_id")
def _(get):  # noqa: ANN001, ANN202
    path = get.path("gold")
    tb.write_gold(rf.build_gold(get("consensus"), get("system")), path)
    read = get.spark.read.option("header", True).schema("domain string, item_id long, round int, human_consensus_label string, annotator_labels string, n_high int, n_low int, system_label string, match int").csv(path)
    return read.drop("n_high", "n_low", "match")


@query("s9_append_calls", "SELECT 'run' AS run_tag, domain, 'v0' AS rubric_version, item_id, rater_id, 0::BIGINT AS repeat, label FROM [gappy] g")
def _(get):  # noqa: ANN001, ANN202
    path, none = get.path("calls"), F.lit(None).cast("string")
    g = get("gappy").select(F.lit("run").alias("run_tag"), "domain", F.lit("v0").alias("rubric_version"), "item_id", "rater_id", F.lit(0).alias("repeat"), "label", none.alias("confidence"), none.alias("reason"), none.alias("criterion_quote"))
    for half in (0, 1):
        tb.append_calls(g.where(F.pmod("item_id", F.lit(2)) == half), path)
    return loop.read_log(get.spark, path).drop("confidence", "reason", "criterion_quote")


@query("s9_bucketed_log", f"SELECT domain, item_id, h::BIGINT AS votes_high, l::BIGINT AS votes_low, 2 AS pending FROM {VOTES} v")
def _(get):  # noqa: ANN001, ANN202
    """Votes folded from a log of two appends, and how many calls of each item are still to make: two of four raters'."""
    path, none = get.path("bucketed-calls"), F.lit(None).cast("string")
    log = CallLog(get.spark, f"calls_{path.rsplit('-', 1)[1]}", path, buckets=8)
    g = get("gappy").select(F.lit("run").alias("run_tag"), "domain", F.lit("v0").alias("rubric_version"), "item_id", "rater_id", F.lit(0).alias("repeat"), "label", none.alias("confidence"), none.alias("reason"), none.alias("criterion_quote"))
    log.append(g.where("rater_id = 'r_len'"))
    log.append(g.where("rater_id <> 'r_len'"))
    raters = get.spark.createDataFrame([(r,) for r in [*RATERS, "r_new", "r_other"]], "rater_id string")
    plan = pr.plan_calls(get("items"), raters, get.spark.createDataFrame([("v0",)], "rubric_version string"))
    left = log.pending(plan).groupBy("domain", "item_id").agg(F.count(F.lit(1)).alias("pending"))
    return joined(vt.panel_vote(log.read()).select("domain", "item_id", "votes_high", "votes_low"), left, ["domain", "item_id"])


@query("s10_write_report", f"SELECT 'cells' AS section, domain, round::BIGINT AS round, n, {r6('match::DOUBLE / n')} AS value FROM {CELLS} c UNION ALL SELECT 'agreement', domain, NULL, n, {r6('weighted')} FROM {panel_sql('[ratings]')} p")
def _(get):  # noqa: ANN001, ANN202
    path = get.path("report")
    agreement = mt.panel_metrics(get("ratings")).select(F.lit("agreement").alias("section"), "domain", F.lit(None).cast("int").alias("round"), "n", F.col("weighted").alias("value"))
    parts = cells(get).select(F.lit("cells").alias("section"), "domain", "round", "n", F.col("match_rate").alias("value"))
    tb.write_report(parts.unionByName(agreement), path, keys=("domain", "round"))
    return tb.read_report(get.spark, path, "domain string, round int, n long, value double")


@query("s11_with_row_index", "SELECT domain, item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) - 1 AS position FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return vt.with_row_index(get("items").select("domain", "item_id"), order=["item_id"], by=["domain"], name="position")


@query("s11_row_index_of_a_scan", "SELECT count(*) AS n, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS different, sum(item_id)::BIGINT AS ids FROM (SELECT DISTINCT domain, item_id FROM [ratings] r) x")
def _(get):  # noqa: ANN001, ANN202
    numbered = vt.with_row_index(get("ratings").groupBy("domain", "item_id").agg(F.count(F.lit(1)).alias("part")), name="position")
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.count_distinct("position").alias("different"), F.sum("item_id").alias("ids"))


# --- prompts, repairs, plug-ins -------------------------------------------------------------------------------------
ASK = "LABEL: HIGH or LOW\nCONFIDENCE: HIGH, MEDIUM or LOW\nMATCHED_HIGH: numbers\nMATCHED_LOW: numbers\nREASON: one sentence\nCRITERION_QUOTE: the criterion that decided"


@query("p2_render_prompt", f"SELECT item_id, sha256('Domain: about ' || domain || chr(10) || 'HIGH criteria:' || chr(10) || '1. clear ' || domain || chr(10) || '2. new' || chr(10) || 'LOW criteria:' || chr(10) || '1. thin' || chr(10) || 'If both match: LOW wins' || chr(10) || chr(10) || 'Transcript:' || chr(10) || substr(text, 1, 3000) || chr(10) || chr(10) || '{ASK}') AS prompt FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return tx.render_prompt(get("items"), rubrics(get)).select("item_id", F.sha2("prompt", 256).alias("prompt"))


def answers() -> Column:
    """The item's number in an answer that is whole, has a tail, a head and a tail, a quote with a bad escape, a quote
    that holds the text's own words between unescaped quotation marks (last or in the middle), or is none."""
    item = F.col("item_id").cast("string")
    whole = F.concat(F.lit('{"n": '), item, F.lit(', "criterion_quote": "x"}'))
    said = F.translate(F.col("text"), ",}\\\"", "    ")
    kind = F.pmod("item_id", F.lit(7))
    return (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(whole, F.lit(" so be it")))
        .when(kind == 2, F.concat(F.lit("Well: "), whole, F.lit(" yes")))
        .when(kind == 3, F.concat(F.lit('{"criterion_quote": "a \\q b", "n": '), item, F.lit("}")))
        .when(kind == 4, F.concat(F.lit('So {"n": '), item, F.lit(', "criterion_quote": "says "'), said, F.lit('" and more" }.')))
        .when(kind == 5, F.concat(F.lit('{"criterion_quote" : "says "'), said, F.lit('" here" , "n": '), item, F.lit("}")))
        .otherwise(F.concat(F.lit("n is "), item))
    )


@query("p8_repair_json", "SELECT item_id, CASE WHEN item_id % 7 < 4 OR (item_id % 7 < 6 AND text IS NOT NULL) THEN item_id END AS n FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    return get("items").select("item_id", F.try_variant_get(tx.repair_json(answers()), "$.n", "bigint").alias("n"))


@query("p10_validate_revision", "SELECT item_id, item_id % 3 < 2 AS success, CASE WHEN item_id % 3 < 2 THEN (item_id + 1)::VARCHAR ELSE item_id::VARCHAR END AS version, CASE WHEN item_id % 3 < 2 THEN 'a,b' ELSE 'old' END AS high, CASE WHEN item_id % 3 < 2 THEN 'r' ELSE 'rule' END AS conflict_rule, CASE WHEN item_id % 3 < 2 THEN item_id::VARCHAR ELSE '' END AS irreducible FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    good = F.concat(F.lit('{"updated_HIGH": ["a", "b"], "updated_LOW": [], "updated_conflict_rule": "r", "irreducible_transcripts": ['), F.col("item_id").cast("string"), F.lit("]}"))
    kind = F.pmod("item_id", F.lit(3))
    response = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("so "), good, F.lit(" there"))).otherwise('{"updated_HIGH": ["a"]}')
    old = get("items").select("item_id", response.alias("response"), F.col("item_id").cast("string").alias("version"), F.lit("c").alias("domain_context"), F.array(F.lit("old")).alias("HIGH"), F.array(F.lit("l")).alias("LOW"), F.lit("rule").alias("conflict_rule"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return tx.validate_revision(old).select("item_id", "success", "version", F.array_join("HIGH", ",").alias("high"), "conflict_rule", text("irreducible").alias("irreducible"))


@query("p11_normalize_text", "SELECT item_id, sha256(trim(lower(regexp_replace(concat(replace(text, '&', '+'), ' X & Y <Z>' || chr(233)), '\\s+', ' ', 'g')))) AS hash FROM [items] i")
def _(get):  # noqa: ANN001, ANN202
    marked = F.concat(F.translate("text", "&", "+"), F.lit(" X &amp; Y &lt;Z&gt;&eacute;"))
    return get("items").select("item_id", F.sha2(tx.normalize_text(marked), 256).alias("hash"))


@query("j6_attach_rubric", "SELECT i.item_id, i.domain, n::VARCHAR AS version, CASE WHEN n IS NOT NULL THEN 'LOW wins' END AS conflict_rule FROM [items] i LEFT JOIN (SELECT domain, count(*) AS n FROM [items] x GROUP BY domain) d ON i.domain = d.domain")
def _(get):  # noqa: ANN001, ANN202
    return pr.attach_rubric(get("items"), rubrics(get)).select("item_id", "domain", "version", "conflict_rule")


#: Limits of the test double for raters a, b and c.
RULED = "(SELECT domain, item_id, rater_id, CASE WHEN coalesce(length(text), 0) >= lim THEN 'HIGH' ELSE 'LOW' END AS label FROM [items] i CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS rater_id, unnest([1000, 1400, 1800]) AS lim) r)"


@query("f1_label_items", f"SELECT 'run' AS run_tag, domain, item_id, 'v0' AS rubric_version, rater_id, 0::BIGINT AS repeat, label, 'HIGH' AS confidence FROM {RULED} r")
def _(get):  # noqa: ANN001, ANN202
    items = get("items")
    plan = pr.plan_calls(items, get.spark.createDataFrame([("a",), ("b",), ("c",)], "rater_id string"), get.spark.createDataFrame([("v0",)], "rubric_version string"))
    return loop.label_items(joined(plan, items, ["domain", "item_id"]), loop.rule_rater).drop("reason", "criterion_quote")


@query("f2_revise", "SELECT domain, domain <> 'de' AS success, CASE domain WHEN 'de' THEN 3 WHEN 'en' THEN 1 ELSE 2 END::BIGINT AS attempts, (count(*) + (domain <> 'de')::INT)::VARCHAR AS version FROM [items] i WHERE domain IS NOT NULL GROUP BY domain")
def _(get):  # noqa: ANN001, ANN202
    good, tries = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"}), {}

    def reviser(domain, *_):  # noqa: ANN001, ANN202
        tries[domain] = tries.get(domain, 0) + 1
        if domain == "de" or domain != "en" and tries[domain] < 2:
            raise RuntimeError("busy")
        return good

    current = rubrics(get)
    asked = {r.domain: (r.asDict(), [], []) for r in current.collect()}  # one row per domain
    rows = [(d, r["success"], r["attempts"], r["version"]) for d, r in loop.revise(current, asked, reviser, 3).items()]
    return get.spark.createDataFrame(rows, "domain string, success boolean, attempts int, version string")


@query("f3_calibrate", f"SELECT domain, iteration, {r6('weighted')} AS weighted, {r6('all_agree')} AS all_agree, CASE WHEN converged THEN n WHEN iteration = 3 THEN n + split + split ELSE n + (iteration - 1) * split END::VARCHAR AS rubric_version FROM (SELECT p.domain, weighted, all_agree, p.n, weighted >= 0.9 AS converged, (all_agree < 1)::INT AS split FROM {panel_sql(RULED)} p WHERE domain IS NOT NULL) x CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS iteration) i WHERE iteration <= 2 OR NOT converged")
def _(get):  # noqa: ANN001, ANN202
    good = json.dumps({"updated_HIGH": ["a"], "updated_LOW": ["b"], "updated_conflict_rule": "c"})
    found = loop.calibrate(get("items"), rubrics(get), ["a", "b", "c"], loop.rule_rater, lambda *_: good, get.path("loop-calls"), tau=0.9, max_iterations=3)
    return found.history


# --- streams --------------------------------------------------------------------------------------------------------
@query("x1_stream_intake", "SELECT domain, item_id FROM [calls] c GROUP BY ALL")
def _(get):  # noqa: ANN001, ANN202
    source, path = get.path("stream-calls"), get.path("stream-log")
    calls = get("calls").withColumn("ts", F.col("ts").cast("timestamp"))
    calls.write.parquet(source)
    stream = get.spark.readStream.schema(calls.schema).parquet(source)
    intake.stream_intake(stream, path, get.path("stream-checkpoint"), key=("domain", "item_id"), event_time="ts", delay="3650 days").awaitTermination()
    return get.spark.read.parquet(path).select("domain", "item_id")


@query("x1_stream_latest", "SELECT domain, item_id, ingest_seq, label FROM (SELECT * FROM [calls] c QUALIFY row_number() OVER (PARTITION BY domain, item_id ORDER BY ts DESC, ingest_seq DESC) = 1) l WHERE ts < (SELECT max(ts) FROM [calls] c) - INTERVAL 3 DAY")
def _(get):  # noqa: ANN001, ANN202
    source, path = get.path("stream-calls"), get.path("stream-log")
    calls = get("calls").withColumn("ts", F.col("ts").cast("timestamp"))
    calls.write.parquet(source)
    stream = get.spark.readStream.schema(calls.schema).parquet(source)
    intake.stream_latest(stream, path, get.path("stream-checkpoint"), key=("domain", "item_id"), event_time="ts", delay="3 days", sequence="ingest_seq").awaitTermination()
    return get.spark.read.schema(calls.schema).parquet(path).select("domain", "item_id", "ingest_seq", "label")


@query("x2_stream_panel_metrics", f"SELECT domain, n, {panel_columns()} FROM {panel_sql('[ratings]')} p")
def _(get):  # noqa: ANN001, ANN202
    source, checkpoint, ratings = get.path("stream-ratings"), get.path("stream-checkpoint"), get("ratings")
    sink = intake.PatternTable(get.path("stream-patterns"), compact_every=2)
    for rater in RATERS:  # three arrivals
        ratings.where(F.col("rater_id") == rater).write.mode("append").parquet(source)
        stream = get.spark.readStream.schema(ratings.schema).parquet(source)
        intake.stream_panel_patterns(stream, sink, checkpoint).awaitTermination()
    return sink.metrics(get.spark)
