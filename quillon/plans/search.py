"""Queries of what is stored: indexes of words and vectors, patterns, samples, kept answers and judgments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answers, evaluate, lexical, logs, retrieval, runs, units, vectors
from quillon.plans.base import query, questions, table
from quillon.storage import shared_folder


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT a.vec_id AS q_id, b.vec_id AS key, round(1.0 - list_dot_product(b.e, a.e), 6) + 0.0 AS distance FROM v a CROSS JOIN v b WHERE a.vec_id % 20 = 0)
    SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, key) AS INTEGER) AS rank FROM n QUALIFY rank <= 20"""
)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector index with every cell read."""
    v, q = _vectors(spark, sf_dir)
    return vectors.probed(vectors.vector_index(v, "vec_id", "embedding"), q, probes=vectors.CELLS)


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS questions, count(*) AS indexed, true AS enough FROM embeddings")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index, as it was set by trial, finds nine tenths of the exact hits of every question, and how many rows it has."""
    v, q = _vectors(spark, sf_dir)
    index = vectors.vector_index(v, "vec_id", "embedding")
    found = vectors.recall(vectors.probed(index, q), retrieval.cosine_topk(v, q, "vec_id", "embedding"))
    return found.crossJoin(F.broadcast(index.cells.agg(F.sum("n").alias("indexed")))).select("questions", "indexed", (F.col("recall") >= 0.9).alias("enough"))  # one row each


@query("SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS postings, max(n) AS most FROM (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM documents) GROUP BY term)")
def postings_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and postings of the stored word index, blocks of one term added up."""
    index = lexical.bm25_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    each = index.postings.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"), F.max("n").alias("most"))


@query()
def bm25_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that the questions' terms have, and how many are read. It depends on the layout, so that SQL has no counterpart."""
    index = lexical.bm25_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lexical.bm25_search(index, questions(spark, sf_dir))[1].withColumn("share", F.round(F.try_divide("read", "blocks"), 6))


NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace({0}, chr(92), '')), '<[^>]+>', '', 'g'), '[‐‑‒–—―−]', '-', 'g'), '([0-9.])\s+([0-9.])', '\1' || chr(1) || '\2', 'g'), '[\s\p{{Z}}]+', '', 'g')"


@query(
    f"""WITH d AS (SELECT doc_id, source, {NORMAL.format('text')} AS t FROM documents), q AS (SELECT item_id AS id, w AS term, CASE WHEN item_id % 3 = 0 THEN 'src' || item_id % 7 END AS absent_in, {NORMAL.format('w')} AS p
         FROM (SELECT item_id, unnest([text[1:24], text[-9:], split_part(text, ' ', 2)]) AS w FROM benchmark))
    SELECT DISTINCT id, term, CAST(doc_id AS VARCHAR) AS chunk_id FROM d JOIN q ON p <> '' AND contains(t, p) AND (absent_in IS NULL OR absent_in = source)"""
)
def absent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings, ends and second words of passages, declared absent from all documents or from one source's, that documents hold all the same."""
    b = table(spark, sf_dir, "benchmark")
    phrases = F.array(F.substring("text", 1, 24), F.expr("right(text, 9)"), F.split_part("text", F.lit(" "), F.lit(2)))
    source = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")))
    terms = b.select(F.col("item_id").alias("id"), F.explode(phrases).alias("term"), source.alias("absent_in")).distinct()
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), "text")
    return answers.absent_found(terms, chunks)


@query(
    """WITH d AS (SELECT doc_id, source, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) ELSE '' END AS heading, n_chars FROM documents),
    c AS (SELECT source, count(*) AS c FROM d GROUP BY source), a AS (SELECT greatest(0, 60 - count(*)) AS rest, sum(c - 1) AS more FROM c), x AS (SELECT source, c, CASE WHEN more > 0 THEN rest * (c - 1)::DOUBLE / more ELSE 0 END AS x FROM c, a),
    r AS (SELECT source, floor(x) AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source NULLS FIRST) AS nth FROM x WHERE c > 1),
    q AS (SELECT c.source, 1 + coalesce(base, 0) + CASE WHEN nth <= (SELECT rest FROM a) - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS quota FROM c LEFT JOIN r ON r.source = c.source),
    n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN heading <> '' AND n_chars BETWEEN 100 AND 500 THEN 1 ELSE 0 END DESC, sha1(CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM d)
    SELECT doc_id, n.source FROM n JOIN q ON n.source = q.source WHERE nth <= quota"""
)
def quota_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents, one of each source at least; such as have a first line for a heading and a middling length come first."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.contains("text", F.lit("\n")), first).otherwise("").alias("heading"))
    return evaluate.quota_sample(d, "source", "doc_id", 60, evaluate.preferred_chunk(F.col("heading"), F.col("n_chars")), floor=1).select("doc_id", "source")


def _length(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stands for a model: an answer that the text alone decides."""
    for b in batches:
        yield pd.DataFrame({"item_id": b["item_id"], "answer": [f"{len(t)} letters" for t in b["text"]]})


@query("SELECT item_id, length(text) || ' letters' AS answer FROM benchmark")
def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers kept in steps of ten; the run is called twice, first for a part of the items."""
    folder, items = shared_folder(spark), table(spark, sf_dir, "benchmark").select("item_id", "text")
    for part in (items.where("item_id % 3 = 0"), items):
        found = runs.kept_run(part, "item_id", _length, "item_id long, answer string", folder)
    return found


def _verdict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"key": b["key"], "verdict": [f"{p}{len(g) % 3}" for p, g in zip(b["prompt"], b["given"], strict=True)]})


@query("SELECT doc_id, 'size' || length(text) % 3 AS verdict FROM documents")
def judged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each text from the kept judgments; copies share one, and a second run would ask for none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.judged_once(d, F.lit("size"), F.col("text"), _verdict, "size", "none", shared_folder(spark)).select("doc_id", "verdict")


#: Scored answers made of events; the same columns in SQL.
SCORED = """
WITH s AS (SELECT event_type AS type, event_id AS i, CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'rejected_gate' WHEN 2 THEN 'refused_model' ELSE 'answered' END AS behavior, CASE WHEN event_id % 3 = 0 THEN 'refuse' ELSE 'answer' END AS expect,
    event_id % 5 <> 0 AS has_judge, event_id % 35 = 1 AS failed, event_id % 7 = 2 AS declined, ['full', 'partial', 'none', 'na'][1 + event_id % 4] AS support1, ['full', 'none', 'full'][1 + event_id % 3] AS support2, event_id % 2 = 0 AS quote_ok,
    CASE WHEN event_id % 4 <> 3 THEN event_id % 9 < 6 END AS cited_ok, event_id % 6 <> 0 AS has_facts, event_id % 31 = 3 AS fact_failed, ['present', 'absent', 'contradicted'][1 + event_id % 3] AS v1, ['present', 'contradicted'][1 + event_id % 2] AS v2, event_id % 4 = 1 AS m1,
    event_id % 8 AS numbers, event_id % 8 // 3 AS untraced, CASE WHEN event_id % 13 <> 0 THEN value / 100 END AS o1, (event_id % 10) / 10.0::DOUBLE AS o2, event_id % 17 = 0 AS cut, value AS ms, event_id % 1000 AS tin, event_id % 300 AS tout, event_id % 4 <> 1 AS agent,
    1 + event_id % 3 AS calls, event_id % 4 AS tools, CASE WHEN event_id % 19 = 0 THEN 2 ELSE 0 END AS errors, event_id % 23 = 0 AS forced, event_id % 2 = 0 AS wants, event_id % 6 < 4 AS wants_ok, CASE WHEN event_id % 3 <> 1 THEN event_id % 6 END AS checked,
    event_id % 29 // 14 AS issues, [NULL, 'draft', 'repaired', ''][1 + event_id % 4] AS repair, event_id % 8 = 6 AS fixed FROM events),
t AS (SELECT *, behavior <> 'error' AS ok, behavior = 'answered' AS a, behavior <> 'error' AND agent AND event.calls IS NOT NULL AS g FROM s event)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda m, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + i % m).cast("int"))
    no = lambda c, x: F.when(c, x)
    sentence = lambda support, quote, cited: F.struct(support.alias("support"), quote.alias("quote_ok"), cited.alias("cited_ok"))
    judge = F.struct((i % 35 == 1).alias("failed"), (i % 7 == 2).alias("declined"), F.array(sentence(pick(4, "full", "partial", "none", "na"), i % 2 == 0, no(i % 4 != 3, i % 9 < 6)), sentence(pick(3, "full", "none", "full"), F.lit(True), F.lit(None).cast("boolean"))).alias("sentences"))
    facts = F.struct((i % 31 == 3).alias("failed"), F.array(pick(3, "present", "absent", "contradicted"), pick(2, "present", "contradicted")).alias("verdicts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("type"), F.when(i % 11 == 0, "error").when(i % 11 == 1, "rejected_gate").when(i % 11 == 2, "refused_model").otherwise("answered").alias("behavior"), F.when(i % 3 == 0, "refuse").otherwise("answer").alias("expect"),
        no(i % 5 != 0, judge).alias("judge"), no(i % 6 != 0, facts).alias("fact_judge"), F.array(i % 4 == 1, F.lit(True)).alias("matched"), (i % 8).alias("n_numbers"), F.floor(i % 8 / 3).alias("n_untraced"),
        F.array(no(i % 13 != 0, F.col("value") / 100), (i % 10) / F.lit(10.0)).cast("array<double>").alias("overlaps"), F.when(i % 17 == 0, "length").otherwise("stop").alias("finish_reason"), F.col("value").cast("double").alias("t_total_ms"), (F.col("value") / 2).cast("double").alias("t_first_token_ms"),
        (i % 1000).alias("input_tokens"), (i % 300).alias("output_tokens"), (i % 100).alias("cache_read_tokens"), no(i % 7 != 3, (i % 50) / F.lit(8.0)).alias("cost_upper"), no(i % 7 != 4, (i % 40) / F.lit(8.0)).alias("cost_yuan"), F.when(i % 4 != 1, "agent").otherwise("rag").alias("mode"),
        (1 + i % 3).alias("llm_calls"), (i % 4).alias("tool_calls"), F.when(i % 19 == 0, 2).otherwise(0).alias("tool_errors"), (i % 23 == 0).alias("forced_final"), no(i % 2 == 0, F.array(F.lit("convert_unit"))).alias("tools_expected"), (i % 6 < 4).alias("tools_expected_ok"),
        no(i % 3 != 1, i % 6).alias("numbers_checked"), F.floor(i % 29 / 14).alias("number_issues"), F.when(i % 4 == 1, "draft").when(i % 4 == 2, "repaired").when(i % 4 == 3, "").alias("repair"), (i % 8 == 6).alias("repair_fixed"),
    )


_COUNTS = {
    "answered_but_declined": ("count(*) FILTER (a AND expect = 'answer' AND has_judge AND declined)", None), "refusal_gate": ("count(*) FILTER (expect = 'refuse' AND behavior = 'rejected_gate')", None),
    "refusal_model": ("count(*) FILTER (expect = 'refuse' AND behavior = 'refused_model')", None), "refusal_declined_by_judge": ("count(*) FILTER (a AND expect = 'refuse' AND has_judge AND declined)", None),
    "numbers_traced": ("sum(numbers - untraced) FILTER (a)", "sum(numbers) FILTER (a)"), "overlap_low": ("count(*) FILTER (a AND o1 < 0.5) + count(*) FILTER (a AND o2 < 0.5)", "count(o1) FILTER (a) + count(o2) FILTER (a)"), "truncated": ("count(*) FILTER (a AND cut)", None),
    "judge_failed": ("count(*) FILTER (j AND failed)", "count(*) FILTER (j)"), "faithful_strict": ("count(*) FILTER (u AND support1 = 'full' AND quote_ok) + count(*) FILTER (u AND support2 = 'full')", "{can}"),
    "faithful_full": ("count(*) FILTER (u AND support1 = 'full') + count(*) FILTER (u AND support2 = 'full')", "{can}"), "partial": ("count(*) FILTER (u AND support1 = 'partial')", "{can}"),
    "unsupported": ("count(*) FILTER (u AND support1 = 'none') + count(*) FILTER (u AND support2 = 'none')", "{can}"), "citation_ok": ("count(*) FILTER (u AND cited_ok)", "count(cited_ok) FILTER (u)"),
    "fact_agree": ("count(*) FILTER (f AND m1 = (v1 = 'present')) + count(*) FILTER (f AND v2 = 'present')", "2 * count(*) FILTER (f)"), "fact_only_regex": ("count(*) FILTER (f AND m1 AND v1 <> 'present') + count(*) FILTER (f AND v2 <> 'present')", None),
    "fact_only_judge": ("count(*) FILTER (f AND NOT m1 AND v1 = 'present')", None), "fact_contradicted": ("count(*) FILTER (f AND v1 = 'contradicted') + count(*) FILTER (f AND v2 = 'contradicted')", None),
    "fact_judge_failed": ("count(*) FILTER (d AND fact_failed)", None), "fact_recall_judge": ("count(*) FILTER (f AND v1 = 'present') + count(*) FILTER (f AND v2 = 'present')", "2 * count(*) FILTER (f)"),
    "presearch_only": ("count(*) FILTER (g AND calls = 1)", "count(*) FILTER (g)"), "tool_errors": ("sum(errors) FILTER (g)", None), "tool_errors_items": ("count(*) FILTER (g AND errors > 0)", "count(*) FILTER (g)"),
    "forced_final": ("count(*) FILTER (g AND forced)", "count(*) FILTER (g)"), "tools_expected_ok": ("count(*) FILTER (g AND expect = 'answer' AND wants AND wants_ok)", "count(*) FILTER (g AND expect = 'answer' AND wants)"),
    "cache_read_share": ("sum(i % 100) FILTER (g)", "sum(tin) FILTER (g)"), "numbers_checked": ("sum(checked) FILTER (g)", None), "repairs": ("count(*) FILTER (c AND repair <> '')", "count(*) FILTER (c)"), "repairs_fixed": ("count(*) FILTER (c AND fixed)", None),
    "repairs_kept_draft": ("count(*) FILTER (c AND repair = 'draft')", None), "issue_answers": ("count(*) FILTER (c AND issues > 0)", "count(*) FILTER (c)"),
}
_CAN = "(count(*) FILTER (u AND support1 <> 'na') + count(*) FILTER (u))"
_ROWS = SCORED.rstrip() + ", w AS (SELECT *, a AND has_judge AS j, a AND has_judge AND NOT failed AS u, a AND expect = 'answer' AND has_facts AS d, a AND expect = 'answer' AND has_facts AND NOT fact_failed AS f, g AND checked IS NOT NULL AS c FROM t)"


@query(
    _ROWS + " SELECT type, metric, k, coalesce(n, -1) AS n, round(k / nullif(n, 0)::DOUBLE, 6) AS rate FROM ("
    + " UNION ALL ".join(f"SELECT type, '{name}' AS metric, CAST(coalesce({k}, 0) AS BIGINT) AS k, CAST({f'coalesce({n}, 0)' if n else 'NULL'} AS BIGINT) AS n FROM w GROUP BY type".replace("{can}", _CAN) for name, (k, n) in _COUNTS.items()) + ")"
)
def judged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty counts (n is -1) and ratios over verdicts, calls, tools and repairs of scored answers, by type."""
    return answers.judged_metrics(_scored(spark, sf_dir), ["type"]).na.fill(-1, ["n"])


_MEASURES = {
    "input_mean": "round(avg(tin) FILTER (a), 6)", "output_mean": "round(avg(tout) FILTER (a), 6)", "input_sum": "sum(tin) FILTER (a)", "output_sum": "sum(tout) FILTER (a)", "cost_upper_mean": "round(avg((i % 50) / 8.0::DOUBLE) FILTER (ok AND i % 7 <> 3), 6)",
    "cost_mean": "round(avg((i % 40) / 8.0::DOUBLE) FILTER (ok AND i % 7 <> 4), 6)", "llm_calls_mean": "round(avg(calls) FILTER (g), 6)", "tool_calls_mean": "round(avg(tools) FILTER (g), 6)", "p50_ms": "round(quantile_cont(ms, 0.5) FILTER (a), 6)",
    "p95_ms": "round(quantile_cont(ms, 0.95) FILTER (a), 6)", "first_token_p50_ms": "round(quantile_cont(ms / 2, 0.5) FILTER (a), 6)", "reject_p50_ms": "round(quantile_cont(ms, 0.5) FILTER (behavior = 'rejected_gate'), 6)",
}


@query(
    _ROWS + " " + " UNION ALL ".join(f"SELECT type, '{name}' AS metric, CAST({v} AS DOUBLE) AS value FROM w GROUP BY type" for name, v in _MEASURES.items())
    + "".join(f" UNION ALL SELECT type, '{name}', round(quantile_cont(o, {q}), 6) FROM (SELECT type, o1 AS o FROM w WHERE a UNION ALL SELECT type, o2 FROM w WHERE a) GROUP BY type" for name, q in (("overlap_median", 0.5), ("overlap_p10", 0.1)))
)
def answer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, sums and exact percentiles of tokens, cost, calls, times and overlaps of scored answers, by type."""
    return answers.measures(_scored(spark, sf_dir), ["type"])


@query(
    r"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
    SELECT doc_id, CASE WHEN length(flat) > 100 THEN left(flat, 100) || '…' ELSE flat END AS preview, 'what is ' || left(replace(text, chr(10), ' '), 7) || 'x' AS question,
           true AS own_id, true AS recent FROM d"""
)
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's preview, a question of it without its quotation marks, and whether its request id is one and of this run."""
    head = F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 7)
    asked = F.concat(F.lit(' "“what is '), head, F.lit("x”\" "))
    d = table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.question_cleaned(asked).alias("question"))
    own = F.col("id").rlike("^[0-9a-f]{32}$")
    return logs.new_ids(d).select("doc_id", "preview", "question", own.alias("own_id"), (F.col("created_at") > F.lit("2020-01-01").cast("timestamp")).alias("recent"))


#: Pairs of units, and what an amount of the first is in the second.
PAIRS = (
    ("mm", "in", "v / 25.4::DOUBLE"), ("bar", "psi", "v * 100000 / 6894.757293168::DOUBLE"), ("kW", "W", "v * 1000"), ("°C", "°F", "v * 9 / 5 + 32"), ("°F", "K", "(v + 459.67::DOUBLE) * 5 / 9"), ("K", "℃", "v - 273.15::DOUBLE"),
    ("m", "mm", "v * 1000"), ("kg", "lb", "v / 0.45359237::DOUBLE"), ("kg", "mm", "NULL"), ("bar", "°C", "NULL"), ("parrot", "kg", "NULL"), ("no unit", "no unit", "v"), ("KG", "kg", "v"),
)


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS v, (l_orderkey + l_linenumber) % 13 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE p "
    + " ".join(f"WHEN {i} THEN {rule}" for i, (_, _, rule) in enumerate(PAIRS)) + " END, 6) AS converted, CASE p WHEN 8 THEN 'dimension_mismatch' WHEN 9 THEN 'dimension_mismatch' WHEN 10 THEN 'unknown_unit' ELSE '' END AS error FROM l"
)
def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in many units: lengths, pressures, powers, temperatures with their zero points, and pairs that can't be converted."""
    p = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(PAIRS) + 1).cast("int")
    of = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in PAIRS]), p)
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("v"), of(0).alias("u"), of(1).alias("w"))
    return units.convert(r, "v", "u", "w").select("l_orderkey", "l_linenumber", F.round("converted", 6).alias("converted"), F.coalesce("error", F.lit("")).alias("error"))
