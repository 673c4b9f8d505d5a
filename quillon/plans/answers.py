"""Queries over answers: sentences, verification, scores, metrics, samples and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answers, evaluate, logs, probes
from quillon.plans.base import query, table


def _fact(m: int):
    return F.concat(F.lit("d_c"), F.lpad((F.col("doc_id") % m).cast("string"), 4, "0"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an answer: sentences end in 。, the second is cited behind its stop."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", r"[.!?]\s*", "。").alias("text"))
    return d.withColumn("answer", F.concat(F.lit("**Fact one** is told here。Fact two stands beside it。["), _fact(7), F.lit("]"), F.col("text")))


ANSWERS = r"""
WITH a AS (SELECT doc_id, lang, 'd_c' || lpad(CAST(doc_id % 7 AS VARCHAR), 4, '0') AS id, regexp_replace(text, '[.!?]\s*', '。', 'g') AS text FROM documents),
p AS (SELECT doc_id, id, list_concat(['Fact one** is told here', 'Fact two stands beside it [' || id || ']'], string_split_regex(text, '[。！？\n]')) AS parts FROM a),
s AS (SELECT doc_id, id, list_filter(list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^[*#>•· \t-]+|[*#>•· \t-]+$', '', 'g')), lambda x: length(x) >= 10 AND NOT regexp_matches(x, '[：:]$')) AS parts FROM p)
"""


@query(
    ANSWERS
    + r"""SELECT doc_id, len(list_filter(parts, lambda x: length(regexp_replace(x, '^[*•·| -]+|[*•·| -]+$', '', 'g')) >= 2)) AS sentences, len(list_filter(parts, lambda x: contains(x, id))) AS cited,
          CAST(sum(length(regexp_replace(regexp_replace(replace(x.p, '[' || id || ']', ''), '^[*•·| -]+|[*•·| -]+$', '', 'g'), '^$', ''))) AS BIGINT) AS chars
          FROM s, (SELECT unnest(s.parts) AS p) x GROUP BY ALL"""
)
def substantive_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that say something, those that are cited, and their letters without citations."""
    s = T.substantive_sentences(F.col("answer"))
    d = _answers(spark, sf_dir).withColumn("s", s)
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + F.length(x["text"]))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size(F.filter("s", lambda x: F.size(x["cited"]) > 0)).cast("long").alias("cited"), chars.alias("chars"))


@query(
    r"""WITH a AS (SELECT doc_id, 'd_c' || lpad(CAST(doc_id % 7 AS VARCHAR), 4, '0') AS c7, 'd_c' || lpad(CAST(doc_id % 11 AS VARCHAR), 4, '0') AS c11, regexp_replace(text, '[.!?]\s*', '。', 'g') AS t FROM documents),
    p AS (SELECT doc_id, c7, c11, list_concat(['It is so [' || c7 || ']', 'and so ' || c11], string_split_regex(t, '[。！？\n]')) AS parts FROM a),
    s AS (SELECT doc_id, c7, c11, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: length(x) > 5) AS parts FROM p)
    SELECT doc_id, doc_id % 5 <> 0 AS checked, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(parts) END AS sentences, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE len(list_filter(parts, lambda x: length(x) > 15 AND NOT regexp_matches(x, '[A-Za-z0-9_]+_c[0-9]{4}'))) END AS uncited,
           CASE WHEN doc_id % 5 = 0 OR c7 = c11 THEN '' ELSE c11 END AS fabricated FROM s"""
)
def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers with a citation that was retrieved and one that may not have been; every fifth has no evidence and isn't checked."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", r"[.!?]\s*", "。"))
    answer = F.concat(F.lit("It is so。["), _fact(7), F.lit("]and so "), _fact(11), F.lit("。"), F.col("t"))
    retrieved = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_fact(7)))
    v = d.select("doc_id", T.verified(answer, retrieved, F.lit("")).alias("v"))
    return v.select("doc_id", "v.checked", F.col("v.sentences").cast("long").alias("sentences"), F.size("v.uncited").cast("long").alias("uncited"), F.array_join("v.fabricated", ",").alias("fabricated"))


@query(
    r"""WITH r AS (SELECT doc_id, doc_id % 5 AS m, CASE doc_id % 5 WHEN 0 THEN ' 检索内容不足，无法 回答' WHEN 1 THEN '`知识库无相关内容` [d_c0001] 。资料 (引用 d_c0002) ；' WHEN 2 THEN '知识库 无相关内容 ' || text
                     WHEN 3 THEN chr(10) || '> **知识库无相关内容**，' || text || ' 【d_c0003】 ' ELSE text END AS a FROM documents),
    t AS (SELECT *, regexp_replace(a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS b, length(regexp_replace(a, '[\s\p{Z}]+', '', 'g')) <= 40 AS short FROM r)
    SELECT doc_id, m IN (0, 2) AS refusal, m <> 4 AND short AS short_refusal,
           CASE m WHEN 1 THEN '`知识库无相关内容`。资料；' WHEN 3 THEN regexp_replace(regexp_replace(regexp_replace(b, '【d_c0003】$', ''), '[ \t]+([，。；：、,.;:）)])', '\1', 'g'), '[\s\p{Z}]+$', '') ELSE b END AS cleaned FROM t"""
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that refuse, that refuse behind marks and cite, that name a mark in a long text, and that answer; both forms of the test, and the clean-up."""
    m = F.col("doc_id") % 5
    a = F.when(m == 0, " 检索内容不足，无法 回答").when(m == 1, "`知识库无相关内容` [d_c0001] 。资料 (引用 d_c0002) ；").when(m == 2, F.concat(F.lit("知识库 无相关内容 "), "text"))
    a = a.when(m == 3, F.concat(F.lit("\n> **知识库无相关内容**，"), "text", F.lit(" 【d_c0003】 "))).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").withColumn("a", a)
    return d.select("doc_id", T.is_refusal(F.col("a")).alias("refusal"), T.is_short_refusal(F.col("a")).alias("short_refusal"), T.refusal_cleaned(F.col("a")).alias("cleaned"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as items: an answer names `speed {id % 2}` and cites m_c000x; two facts, one of them a number."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    i = F.col("doc_id")
    cid = lambda x: F.concat(F.lit("m_c000"), x.cast("string"))
    status = F.when(i % 10 == 3, "rejected_gate").when(i % 10 == 4, "error").otherwise("done")
    answer = F.when(i % 10 == 5, "无法回答").otherwise(F.concat(F.lit("The pump turns at speed "), (i % 2).cast("string"), F.lit(" as is told in the manual ["), cid(i % 3), F.lit("]。")))
    fact = lambda p, n: F.struct(F.array(F.lit(p)).alias("patterns"), F.lit(n).alias("numeric"))
    rows = d.select(
        i.alias("id"), F.col("lang").alias("type"), F.when(F.col("quality") == 1, "answer").otherwise("refuse").alias("expect"), F.when(i % 2 == 0, "dev").otherwise("test").alias("split"), status.alias("status"),
        answer.alias("answer"), F.array(cid(F.lit(0)), cid(F.lit(1))).alias("retrieved"), F.array(F.lit("m")).alias("docs"), F.array(F.array(cid(F.lit(0)), cid(F.lit(1)))).alias("groups"),
        F.array(fact("pump", False), fact("speed1", True)).alias("facts"), F.create_map(F.lit("m_c0000"), F.lit("m"), F.lit("m_c0001"), F.lit("m"), F.lit("m_c0002"), F.lit("n")).alias("chunk_docs"),
    )
    return answers.scored(rows)


SCORES = """
WITH r AS (SELECT d.doc_id AS id, lang AS type, CASE WHEN l.quality = 1 THEN 'answer' ELSE 'refuse' END AS expect, CASE WHEN d.doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
  CASE d.doc_id % 10 WHEN 3 THEN 'rejected_gate' WHEN 4 THEN 'error' WHEN 5 THEN 'refused_model' ELSE 'answered' END AS behavior, d.doc_id % 3 AS c, (d.doc_id % 10) NOT IN (3, 4, 5) AS ok FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT *, behavior IN ('rejected_gate', 'refused_model') AS refused, expect = 'answer' AS due, CASE WHEN ok THEN 1 + id % 2 ELSE 0 END AS met, CASE WHEN ok THEN id % 2 ELSE 0 END AS met_n, ok AND c = 2 AS astray FROM r)
"""


@query(
    SCORES
    + """SELECT id, behavior, refused, CASE WHEN ok THEN 1 ELSE 0 END AS n_sentences, CASE WHEN astray THEN 1 ELSE 0 END AS n_fabricated, CASE WHEN due THEN 1 ELSE -1 END AS evidence_all, CASE WHEN due THEN CASE WHEN ok AND c < 2 THEN 1 ELSE 0 END ELSE -1 END AS n_cited_gold,
         CASE WHEN due THEN CAST(astray AS INTEGER) ELSE -1 END AS wrong_manual, CASE WHEN due THEN met ELSE -1 END AS n_facts_matched, CASE WHEN due THEN met_n ELSE -1 END AS n_numeric_matched, CASE WHEN due THEN CAST(met = 2 AS INTEGER) ELSE -1 END AS all_facts FROM s"""
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due only of items to be answered is -1 elsewhere."""
    due = [F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("evidence_all", "n_cited_gold", "wrong_manual", "n_facts_matched", "n_numeric_matched", "all_facts")]
    return _scored(spark, sf_dir).select("id", "behavior", "refused", "n_sentences", "n_fabricated", *due)


METRICS = """, k AS (SELECT type, split, metric, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM (
 SELECT type, split, unnest(['errors', 'evidence_all', 'false_refusal', 'false_refusal_gate', 'false_refusal_model', 'fact_recall', 'fact_recall_answered', 'strict_correct', 'numeric', 'numeric_items', 'cited_gold', 'wrong_manual', 'strict_grounded', 'refusal_recall', 'refusal_precision', 'uncited', 'fabricated', 'cites_sample']) AS metric,
 unnest([count(*) FILTER (behavior = 'error'), count(*) FILTER (a), count(*) FILTER (a AND refused), count(*) FILTER (a AND behavior = 'rejected_gate'), count(*) FILTER (a AND behavior = 'refused_model'), coalesce(sum(met) FILTER (a), 0), coalesce(sum(met) FILTER (a AND ok), 0),
  count(*) FILTER (a AND met = 2), coalesce(sum(met_n) FILTER (a), 0), count(*) FILTER (a AND met_n = 1), count(*) FILTER (a AND ok AND c < 2), count(*) FILTER (a AND astray), count(*) FILTER (a AND met = 2 AND c < 2), count(*) FILTER (b AND refused), count(*) FILTER (b AND refused), 0, count(*) FILTER (astray), 0]) AS k,
 unnest([count(*), count(*) FILTER (a), count(*) FILTER (a), count(*) FILTER (a), count(*) FILTER (a), 2 * count(*) FILTER (a), 2 * count(*) FILTER (a AND ok), count(*) FILTER (a), count(*) FILTER (a), count(*) FILTER (a), count(*) FILTER (a AND ok), count(*) FILTER (a AND ok), count(*) FILTER (a),
  count(*) FILTER (b), count(*) FILTER (refused), count(*) FILTER (ok), count(*) FILTER (ok), count(*) FILTER (ok)]) AS n FROM (SELECT *, due AND behavior <> 'error' AS a, NOT due AND behavior <> 'error' AS b FROM s) GROUP BY type, split))
"""


@query(SCORES + METRICS + "SELECT type, split, metric, k, n, round(k / nullif(n, 0)::DOUBLE, 6) AS rate FROM k")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratios by type and split, with their Wilson intervals left out here."""
    return answers.metrics(_scored(spark, sf_dir), ["type", "split"]).select("type", "split", "metric", "k", "n", "rate")


@query(
    SCORES + METRICS
    + """SELECT CASE type WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS place, type, split, metric, k, n, round(k / nullif(n, 0)::DOUBLE, 6) AS rate FROM k
         WHERE type IN ('de', 'en', 'es', 'fr') AND metric IN ('evidence_all', 'false_refusal', 'fact_recall', 'strict_correct', 'numeric', 'refusal_recall')"""
)
def metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main ratios in a fixed order of types, which are languages here."""
    return answers.by_type(_scored(spark, sf_dir), ("de", "en", "es", "fr"))


@query(
    """WITH r AS (SELECT lang, source, n_chars, CASE doc_id % 10 WHEN 3 THEN 'rejected_gate' WHEN 4 THEN 'error' ELSE 'done' END AS status, doc_id % 9 AS k, 9 AS n FROM documents)
    SELECT lang, CAST(coalesce(sum(k) FILTER (status = 'done'), 0) AS BIGINT) AS k, CAST(coalesce(sum(n) FILTER (status = 'done'), 0) AS BIGINT) AS n, round(sum(k) FILTER (status = 'done') / nullif(sum(n) FILTER (status = 'done'), 0)::DOUBLE, 6) AS rate FROM r GROUP BY lang"""
)
def micro_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select("lang", F.when(i % 10 == 3, "rejected_gate").when(i % 10 == 4, "error").otherwise("done").alias("status"), (i % 9).alias("k"), F.lit(9).alias("n"))
    return answers.micro_ratio(r, "k", "n", ["lang"])


@query(
    """WITH r AS (SELECT event_type AS expect, CASE WHEN event_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, value / 100.0::DOUBLE AS distance FROM events)
    SELECT split, expect, count(*) AS n, min(distance) AS least, round(quantile_cont(distance, 0.5), 6) AS median, max(distance) AS most, count(*) FILTER (distance <= 0.3567) AS within FROM r WHERE distance IS NOT NULL GROUP BY split, expect"""
)
def distance_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("expect"), F.when(F.col("event_id") % 2 == 0, "dev").otherwise("test").alias("split"), (F.col("value") / F.lit(100.0)).alias("distance"))
    return answers.separation(e, 0.3567, ["split", "expect"])


@query(
    """WITH c AS (SELECT event_type, CAST(event_id % 4 AS VARCHAR) AS v, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, array_to_string(list(v || '=' || n ORDER BY v), ',') AS counts FROM c GROUP BY event_type"""
)
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts for each event type, shown as text."""
    d = answers.distribution(table(spark, sf_dir, "events").withColumn("calls", F.col("event_id") % 4), ["event_type"], "calls")
    return d.select("event_type", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


@query("SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    """WITH p AS (SELECT lang AS a, source AS b FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS s FROM p),
    e AS (SELECT coalesce(sum(x.n * y.n), 0)::DOUBLE AS e FROM (SELECT a, count(*) AS n FROM p GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM p GROUP BY b) y ON x.a = y.b)
    SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS agreement, CASE WHEN e / (n * n) < 1 THEN round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) END AS kappa FROM n, e"""
)
def kappa_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of labels of many kinds, by their confusion table."""
    return evaluate.kappa_of(evaluate.confusion(table(spark, sf_dir, "documents"), "lang", "source"))


STAGES = ("l_quantity", "l_discount", "l_tax")


@query(
    """WITH x AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS stage, unnest([l_quantity, l_discount, l_tax]) AS ms, l_extendedprice AS t FROM lineitem)
    SELECT stage, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(avg(ms), 6) AS mean, max(ms) AS most, round(sum(ms) / sum(t), 6) AS share FROM x WHERE ms IS NOT NULL GROUP BY stage"""
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of order lines as the times of stages, their price as the whole."""
    return logs.latencies(table(spark, sf_dir, "lineitem"), list(STAGES), "l_extendedprice")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = e.select(
        i.cast("string").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("mode"), F.when(i % 7 == 0, "rejected").when(i % 11 == 0, "error").when(i % 13 == 0, "aborted").otherwise("done").alias("status"), (i % 5 == 0).alias("refused"),
        F.col("value").alias("elapsed_ms"), (F.col("value") / F.lit(1000.0)).alias("cost_yuan"), (i % 3).cast("int").alias("numbers_checked"), F.when(i % 6 == 2, 1).otherwise(0).alias("number_issues"), F.when(i % 12 == 2, "repaired").when(i % 12 == 8, "draft").alias("repaired"),
    )
    f = e.where(i % 4 == 0)
    given = f.select(i.cast("string").alias("id"), F.when(i % 8 == 0, 1).otherwise(-1).alias("rating"), F.lit(" c ").alias("comment"), F.col("ts").alias("rated_at"))
    back = f.where(i % 16 == 0).select(i.cast("string").alias("id"), F.lit(None).cast("int").alias("rating"), F.lit("gone").alias("comment"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("rated_at"))
    return logs.rated(logs.record(rows), given.union(back))


LOG = """
WITH r AS (SELECT event_id AS i, ts, event_type AS mode, CASE WHEN event_id % 7 = 0 THEN 'rejected' WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'aborted' ELSE 'done' END AS status, value AS ms, value / 1000.0::DOUBLE AS cost, event_id % 3 > 0 AS checked,
  CASE WHEN event_id % 4 = 0 AND event_id % 16 <> 0 THEN CASE WHEN event_id % 8 = 0 THEN 1 ELSE -1 END END AS rating FROM events)
"""


@query(
    LOG
    + """SELECT mode, count(*) AS requests, min(ts) AS first, max(ts) AS last, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'aborted') AS aborted,
         count(*) FILTER (status = 'done' AND i % 5 = 0) AS refused, round(quantile_cont(ms, 0.5) FILTER (status = 'done'), 6) AS p50_ms, round(quantile_cont(ms, 0.95) FILTER (status = 'done'), 6) AS p95_ms, round(sum(cost) FILTER (status = 'done'), 6) AS cost, round(avg(cost) FILTER (status = 'done'), 8) AS cost_mean,
         count(*) FILTER (status = 'done' AND checked) AS checked, count(*) FILTER (status = 'done' AND checked AND i % 6 = 2) AS with_issues, count(*) FILTER (status = 'done' AND checked AND i % 12 IN (2, 8)) AS repairs, count(*) FILTER (status = 'done' AND checked AND i % 12 = 2) AS repaired,
         count(rating) AS rated, count(*) FILTER (rating = 1) AS up, count(*) FILTER (rating = -1) AS down FROM r GROUP BY mode"""
)
def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log's report by mode; events are the requests, some rated and some of these taken back."""
    return logs.summary(_log(spark, sf_dir), ["mode"])


@query(LOG + "SELECT CAST(i AS VARCHAR) AS id, ts AS created_at, 'c' AS comment FROM r WHERE rating = -1 AND ts >= TIMESTAMP '2024-01-05 00:00:00' ORDER BY ts DESC, CAST(i AS VARCHAR) DESC LIMIT 10")
def last_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten requests rated down since a time."""
    rows = _log(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return logs.last_down(rows).select("id", "created_at", "comment")


@query("SELECT lang, count(*) FILTER (doc_id % 3 = 0) AS dev, count(*) FILTER (doc_id % 3 = 1) AS test, count(*) AS total FROM documents GROUP BY ROLLUP (lang)")
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("split", F.element_at(F.array(F.lit("dev"), F.lit("test"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int")))
    return evaluate.split_table(d, "lang")


@query(
    """WITH o AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'dev' WHEN doc_id % 7 = 0 THEN 'test' END AS old FROM documents),
    l AS (SELECT source, count(*) FILTER (old = 'dev') - count(*) FILTER (old = 'test') AS lead FROM o GROUP BY source),
    k AS (SELECT o.*, lead, row_number() OVER (PARTITION BY o.source ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM o JOIN l ON o.source IS NOT DISTINCT FROM l.source WHERE old IS NULL)
    SELECT doc_id, old AS split FROM o WHERE old IS NOT NULL
    UNION ALL SELECT doc_id, CASE WHEN k <= abs(lead) THEN CASE WHEN lead > 0 THEN 'test' ELSE 'dev' END WHEN (k - abs(lead)) % 2 = 1 THEN 'dev' ELSE 'test' END FROM k"""
)
def split_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items make up for what the frozen split lacks, then alternate."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    old = F.when(F.col("doc_id") % 5 == 0, "dev").when(F.col("doc_id") % 7 == 0, "test")
    return evaluate.alternating_split(d, "source", "doc_id", d.select("doc_id", old.alias("split")).where("split IS NOT NULL")).select("doc_id", "split")


@query("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def split_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with no item: customers of orders that aren't in one segment."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return evaluate.strays(table(spark, sf_dir, "orders").select("o_custkey"), c, "o_custkey")


@query(
    """WITH r AS (SELECT doc_id, n_chars % 100 = 0 AS f, (doc_id * 37) % 101 AS overlap FROM documents), m AS (SELECT greatest(60 - count(*), 0) AS left_ FROM r WHERE f),
    l AS (SELECT doc_id, row_number() OVER (ORDER BY overlap, doc_id) AS n FROM r WHERE NOT f QUALIFY n <= (SELECT floor(left_ / 2) FROM m) AND n <= 30),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM r WHERE NOT f AND doc_id NOT IN (SELECT doc_id FROM l) QUALIFY n <= (SELECT ceil(left_ / 2) FROM m))
    SELECT doc_id, 'flagged' AS why FROM r WHERE f UNION ALL SELECT doc_id, 'low_overlap' FROM l UNION ALL SELECT doc_id, 'random' FROM o"""
)
def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("doc_id") * 37) % 101).alias("overlap"))
    return evaluate.calibration_sample(d, "doc_id", F.col("n_chars") % 100 == 0, "overlap", 60).select("doc_id", "why")


@query("SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND value > 50) AS off, count(*) FILTER (user_id % 2 = 1 AND value > 50) AS on, count(*) AS n FROM events GROUP BY event_type")
def attack_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("guard", F.col("user_id") % 2 == 1).withColumn("success", F.col("value") > 50)
    return evaluate.attack_table(e, "event_type", "guard", "success")


@query(
    """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_size + 7.5 WHEN p_partkey % 3 = 1 AND p_size = 3 THEN 16.5 WHEN p_partkey % 3 = 1 THEN 3 * (p_size + 0.5) ELSE 2 * (p_size + 0.5) END AS n FROM part)
    SELECT p_partkey, '1. Tighten M8 to ' || printf('%.1f', n) || ' mm and open it' AS number, '1. Tighten M8 to ' || p_size || '.5 m and open it' AS unit, '1. Tighten M8 to ' || p_size || '.5 mm and close it' AS antonym FROM p"""
)
def perturbed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a number changed into one that the evidence lacks, a unit swapped and a word turned round; the list's and the model's number stay."""
    old, m = F.col("p_size") + F.lit(0.5).cast("double"), F.col("p_partkey") % 3
    a = F.concat(F.lit("1. Tighten M8 to "), F.col("p_size"), F.lit(".5 mm and open it"))
    allowed = F.when(m == 0, F.array(2 * old)).when(m == 1, F.array(2 * old, old + 7)).otherwise(F.array().cast("array<double>"))
    kinds = probes.perturbed(F.col("a"), "It is blue", F.col("allowed"))
    p = table(spark, sf_dir, "part").withColumn("a", a).withColumn("allowed", allowed).withColumn("m", F.map_from_entries(kinds))
    return p.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("number", "unit", "antonym")])


@query("SELECT p_brand, count(*) FILTER (p_size > 25) AS k, count(*) AS n, round(count(*) FILTER (p_size > 25) / count(*)::DOUBLE, 6) AS rate FROM part GROUP BY p_brand")
def probe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") > 25)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN printf('%.2f', p_size + 0.507) ELSE '' END AS wrong FROM part")
def derived_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared numbers held against a sum: every second part declares one that is no rounding of it."""
    size = F.col("p_size")
    right = F.format_string("%.1f", size * 2 / F.lit(4.0) + F.lit(0.25))
    off = F.format_string("%.2f", size + F.lit(0.507))
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size % 2 == 0, F.array(right, off)).otherwise(F.array(right)).alias("numbers"), F.array(F.concat(size, F.lit(" * 2 / 4 + 0.25"))).alias("calc"))
    return answers.derived_wrong(facts).select(F.col("id").alias("p_partkey"), F.array_join("wrong", ",").alias("wrong"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN p_partkey % 2 = 0 THEN '777.5' ELSE '' END AS untraced FROM part"""
)
def number_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of answers held against what was retrieved; every second one has a number of its own."""
    p = table(spark, sf_dir, "part")
    price = F.format_string("%.2f", "p_retailprice")
    chunks = p.select(F.col("p_partkey").cast("string").alias("chunk_id"), F.concat(F.lit("costs "), price).alias("text"))
    answer = F.concat(F.lit("It costs "), price, F.when(F.col("p_partkey") % 2 == 0, " or 777.5").otherwise(""), F.lit("."))
    a = p.select(F.col("p_partkey").alias("id"), F.lit("what does it cost").alias("question"), answer.alias("answer"), F.array(F.col("p_partkey").cast("string")).alias("retrieved"), F.array().cast("array<string>").alias("outputs"))
    out = answers.numbers_traced(a, chunks)
    return out.select(F.col("id").alias("p_partkey"), "n", F.array_join("untraced", ",").alias("untraced"))


@query(
    """WITH x AS (SELECT event_type AS metric, CASE WHEN event_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, round(avg(value) FILTER (day(ts) <= 15) / 100, 6) AS a, round(avg(value) FILTER (day(ts) > 15) / 100, 6) AS b FROM events GROUP BY ALL)
    SELECT metric, split, a, b, round(b - a, 6) AS delta, printf('%+.1f', 100 * round(b - a, 6)) AS points FROM x WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def compare_runs_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("split", F.when(F.col("event_id") % 2 == 0, "dev").otherwise("test")).withColumnRenamed("event_type", "metric")
    half = lambda c: e.where(c).groupBy("metric", "split").agg(F.round(F.avg("value") / 100, 6).alias("v"))
    return evaluate.compared_runs(half(F.dayofmonth("ts") <= 15), half(F.dayofmonth("ts") > 15), ["metric", "split"], "v")


@query(
    """SELECT c_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS correct, count(*) AS n, CASE WHEN c_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def evaluation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their answers, split and judgments: customers with their orders and these with their status."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    given = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("answer"))
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer"), (F.col("o_orderstatus") == "F").alias("correct"))
    split = items.select("id", F.when(F.col("id") % 2 == 0, "dev").otherwise("test").alias("split"))
    return items.join(given, "id").join(split, "id").join(verdicts, "answer").groupBy("id", "split").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH b AS (SELECT item_id, text, doc_id FROM benchmark JOIN (SELECT doc_id, text AS t FROM documents) d ON contains(regexp_replace(regexp_replace(lower(t), '([0-9.])\s+([0-9.])', '\1' || chr(1) || '\2', 'g'), '[\s\p{Z}]+', '', 'g'), regexp_replace(regexp_replace(lower(text), '([0-9.])\s+([0-9.])', '\1' || chr(1) || '\2', 'g'), '[\s\p{Z}]+', '', 'g'))),
    g AS (SELECT i.item_id, coalesce(array_to_string(list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)) FILTER (doc_id IS NOT NULL))), ','), '') AS ids FROM benchmark i LEFT JOIN b ON b.item_id = i.item_id GROUP BY i.item_id)
    SELECT item_id, ids FROM g"""
)
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as evidence: the documents that hold it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("doc"), F.array("text").alias("quotes"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), "text")
    return answers.evidence(items, chunks).select(F.col("id").alias("item_id"), F.array_join("ids", ",").alias("ids"))


@query(
    "SELECT n_nationkey AS id, substr(n_name, 2, 1) AS term, CAST(r_regionkey AS VARCHAR) AS chunk_id FROM nation JOIN region ON contains(lower(r_name), lower(substr(n_name, 2, 1)))"
)
def absent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that are declared absent and that a region's name holds all the same."""
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.substring("n_name", 2, 1).alias("term"))
    chunks = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("chunk_id"), F.col("r_name").alias("text"))
    return answers.absent_found(terms, chunks)


@query(
    """SELECT n_nationkey AS id, n_nationkey % 3 <> 1 AS quote_ok, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 5 = 0 THEN 'open' WHEN n_nationkey % 5 <> 1 THEN 'true' ELSE 'false' END AS cited_ok FROM nation"""
)
def judged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks after a judge: the quote stands in the chunk it names, the sentence cites one of those."""
    n, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    chunks = n.select(F.concat(F.lit("n"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("It is: "), "n_name", F.lit("!")).alias("text"))
    own = F.array(F.concat(F.lit("n"), i.cast("string")))
    none = F.array().cast("array<string>")
    s = n.select(i.alias("id"), F.lit(1).alias("n"), F.when(i % 5 == 0, "na").when(i % 5 == 1, "none").otherwise("full").alias("support"), F.when(i % 3 == 1, "no such words at all").otherwise(F.concat(F.lit("IT is "), F.lower("n_name"))).alias("quote"), own.alias("by"), F.when(i % 4 == 0, none).otherwise(own).alias("cited"), own.alias("sources"))
    return answers.judged(s, chunks).select("id", "quote_ok", F.coalesce(F.col("cited_ok").cast("string"), F.lit("open")).alias("cited_ok"))


@query(
    """SELECT event_id AS id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS tool_calls, CASE WHEN event_id % 2 = 0 THEN 'check_value,convert_unit' ELSE 'check_value' END AS tools_used, CAST(event_id % 3 = 0 AS INTEGER) AS tool_errors,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm_c0001' END AS source, event_id % 2 = 0 AS expected_ok FROM events"""
)
def tool_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each answer: an automatic search, a check that may fail, and a conversion in every second."""
    i = F.col("event_id")
    step = lambda name, args, ok, auto, out: F.struct(F.lit(name).alias("name"), F.lit(args).alias("args"), ok.alias("ok"), F.lit(auto).alias("auto"), F.lit(out).alias("output"))
    own = F.array(step("search_manuals", "{}", F.lit(True), True, "x"), step("check_value", '{"source_chunk_id": "m_c0001", "limit_max": 3}', i % 3 != 0, False, "within"))
    steps = F.when(i % 2 == 0, F.concat(own, F.array(step("convert_unit", '{"value": 2}', F.lit(True), False, "2 m = 2000 mm")))).otherwise(own)
    d = table(spark, sf_dir, "events").select(i.alias("id"), answers.steps_summary(steps, F.array(F.lit("search_manuals"), F.lit("convert_unit"))).alias("s"))
    found = F.array_join(F.array_compact(F.transform("s.computed", lambda c: c["source"])), ",")
    return d.select("id", "s.tool_calls", F.array_join("s.tools_used", ",").alias("tools_used"), F.col("s.tool_errors"), found.alias("source"), F.col("s.tools_expected_ok").alias("expected_ok"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 ELSE round((value * 2.0::DOUBLE + event_id % 10 * 8.0::DOUBLE) / 1e6::DOUBLE, 9) END AS cost FROM events")
def upper_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that each answer cost: nothing for the gate's, -1 where tokens aren't known."""
    i = F.col("event_id")
    cost = answers.expected_cost(F.when(i % 3 == 0, "rejected_gate").otherwise("answered"), F.when(i % 3 == 2, F.col("value")), i % 10, 2.0, 8.0)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(cost, F.lit(-1.0)).alias("cost"))


@query(
    """WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name || p_type), '[^0-9a-z]', '', 'g') AS a, regexp_replace(lower(p_name || p_brand), '[^0-9a-z]', '', 'g') AS b FROM part),
    g AS (SELECT id, b, list_distinct(list_transform(range(1, length(a) - 2), lambda i: substr(a, i, 4))) AS grams FROM p)
    SELECT id, round(len(list_filter(grams, lambda x: contains(b, x))) / len(grams)::DOUBLE, 3) AS overlap FROM g"""
)
def gram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a part's name and type stands in its name and brand."""
    p = table(spark, sf_dir, "part").withColumns({"a": T.loose(F.concat("p_name", "p_type")), "b": T.loose(F.concat("p_name", "p_brand"))})
    return p.select(F.col("p_partkey").alias("id"), T.gram_overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(
    """WITH a AS (SELECT doc_id, 'd_c' || lpad(CAST(doc_id % 7 AS VARCHAR), 4, '0') AS x, 'd_c' || lpad(CAST(doc_id % 11 AS VARCHAR), 4, '0') AS y FROM documents)
    SELECT doc_id, 'So [cite](#cite-' || x || ')[cite](#cite-' || y || ')。' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Thus [cite](#cite-' || y || ')' END AS shown FROM a"""
)
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as links; a citation that breaks off at the end goes."""
    a = F.concat(F.lit("So （chunk_id: "), _fact(7), F.lit("，"), _fact(11), F.lit("）。"), F.when(F.col("doc_id") % 2 == 0, "[d_c0").otherwise(F.concat(F.lit("Thus 【"), _fact(11), F.lit("】"))))
    return table(spark, sf_dir, "documents").select("doc_id", T.linked_citations(a).alias("shown"))


@query(
    r"""SELECT p_partkey, regexp_matches(lower(p_name || ' of ' || p_size || '.50 mm to ' || p_size + 1 || ' mm'), '(^|[^0-9.])' || p_size || '\.50* ?mm') AS matched, p_size % 2 = 0 AS grounded FROM part"""
)
def fact_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key fact's number in each part's text, whatever zeros follow it; and whether its numbers are in the evidence."""
    from quillon.operators import facts

    size = F.col("p_size")
    p = table(spark, sf_dir, "part")
    told = T.match_text(F.concat("p_name", F.lit(" of "), size, F.lit(".50 mm to "), size + 1, F.lit(" mm")))
    sizes = [r[0] for r in p.select("p_size").distinct().collect()]  # 50 sizes at most
    known = F.create_map(*[F.lit(x) for n in sorted(sizes) for x in (n, facts.expanded(f"{{n:{n}.5}}{{mm}}"))])
    declared = F.array(F.array(size.cast("string")))
    evidence = F.when(size % 2 == 0, F.concat(F.lit("it is "), size)).otherwise("nothing")
    return p.withColumn("told", told).select("p_partkey", facts.matches(F.col("told"), F.array(known[size])).alias("matched"), facts.numbers_grounded(evidence, declared).alias("grounded"))


@query("SELECT event_id, CASE WHEN value >= 1000 THEN printf('%.1f', value) ELSE CAST(CAST(round(value, 3 - CAST(floor(log10(greatest(abs(value), 1e-9))) AS INTEGER)) AS DOUBLE) AS VARCHAR) END AS shown FROM (SELECT event_id, CAST(event_id % 9 + 1 AS DOUBLE) * 12.5 AS value FROM events)")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with four significant digits."""
    from quillon.operators import units

    v = units.shown((F.col("event_id") % 9 + 1).cast("double") * 12.5)
    return table(spark, sf_dir, "events").select("event_id", F.when(F.contains(v, F.lit(".")), v).otherwise(F.concat(v, F.lit(".0"))).alias("shown"))
