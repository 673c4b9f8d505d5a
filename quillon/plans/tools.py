"""Queries over the agent's tools, evidence pools, histories and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import evaluate, retrieval, tools
from quillon.plans.base import query, questions, table
from quillon.streaming import events as stream


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a manual's chunks, in the order of keys."""
    place = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("position")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_brand").alias("doc_id"), F.concat(F.lit("Torque: "), "p_size", F.lit(" N·m")).alias("text"), place, "p_size", "p_partkey")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one session has seen: every chunk whose key isn't divisible by 3."""
    return _chunks(spark, sf_dir).where(F.col("p_partkey") % 3 != 0).select(F.lit("s").alias("session"), "chunk_id")


@query(
    """WITH c AS (SELECT p_partkey AS k, p_brand AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part), q AS (SELECT k, d, pos, k % 3 AS b, k % 4 AS a FROM c)
    SELECT CAST(q.k AS VARCHAR) AS call_id, q.k % 3 <> 0 AS ok, CASE WHEN q.k % 3 = 0 THEN 'not_in_evidence' END AS error, CASE WHEN q.k % 3 = 0 THEN '' ELSE array_to_string(list(CAST(c.k AS VARCHAR) ORDER BY c.pos), ',') END AS ids
    FROM q JOIN c ON c.d = q.d AND c.pos BETWEEN q.pos - least(b, 2) AND q.pos + least(a, 2) GROUP BY q.k"""
)
def read_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's surroundings, as far as it was shown before."""
    c = _chunks(spark, sf_dir)
    calls = c.select(F.col("chunk_id").alias("call_id"), F.lit("s").alias("session"), "chunk_id", (F.col("p_partkey") % 3).alias("before"), (F.col("p_partkey") % 4).alias("after"))
    out = tools.read_section(calls, c, _pool(spark, sf_dir))
    return out.select("call_id", "ok", "error", F.array_join("ids", ",").alias("ids"))


def _sources(told):
    return F.array(F.struct(F.lit("doc").alias("kind"), told.alias("text")))


@query(
    """SELECT p_partkey AS call_id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown_unit' WHEN 2 THEN 'unit_mismatch' ELSE 'no_source' END AS error, CASE WHEN p_partkey % 4 = 0 THEN round(p_size * 10.0::DOUBLE, 6) END AS result FROM part"""
)
def convert_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions that work, of an unknown unit, of a value with another unit in its source, and of one that no source has."""
    m, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    told = F.when(m == 2, F.concat(F.lit("Torque: "), size, F.lit(" kgf·m"))).when(m == 3, F.lit("Torque: 9999 N·m")).otherwise(F.concat(F.lit("Torque: "), size, F.lit(" daN·m")))
    calls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("call_id"), F.col("p_size").cast("double").alias("value"), F.when(m == 1, "parsec").otherwise("daN·m").alias("from_unit"), F.lit("N·m").alias("to_unit"), F.lit(None).cast("boolean").alias("is_difference"), F.lit("how many").alias("question"), _sources(told).alias("sources"))
    return tools.convert_unit(calls).select("call_id", "error", F.round("result", 6).alias("result"))


@query(
    """WITH c AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 3 = 0 THEN 'not_in_evidence' WHEN p_partkey % 5 = 1 THEN 'limit_not_in_chunk' WHEN p_partkey % 5 = 2 THEN 'dimension_mismatch' WHEN p_partkey % 5 = 3 THEN 'bad_limits' END AS e FROM part)
    SELECT k AS call_id, e AS error, CASE WHEN e IS NULL THEN CASE WHEN s < 30 THEN 'above_max' WHEN s > 30 THEN 'within' ELSE 'at_limit' END END AS verdict,
           CASE WHEN e IS NULL AND s <> 30 THEN round(abs(s - 30)::DOUBLE, 6) END AS margin, CASE WHEN e IS NULL AND s < 30 THEN round(100.0::DOUBLE * (30 - s) / s, 6) END AS margin_pct FROM c"""
)
def check_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 N·m held against each chunk's torque as the most that is allowed, with each error in turn."""
    c, m = _chunks(spark, sf_dir), F.col("p_partkey") % 5
    none = F.lit(None).cast("double")
    size = F.col("p_size").cast("double")
    calls = c.select(F.col("p_partkey").alias("call_id"), F.lit("s").alias("session"), F.lit(30.0).alias("value"), F.lit("N·m").alias("unit"), F.col("chunk_id").alias("source_chunk_id"), none.alias("limit_min"), F.when(m == 1, 7777.0).when(m == 3, none).otherwise(size).alias("limit_max"), F.when(m == 2, "mm").otherwise("N·m").alias("limit_unit"), F.lit("is 30 N·m allowed").alias("question"), _sources(F.lit("is 30 N·m allowed")).alias("sources"))
    return tools.check_value(calls, c, _pool(spark, sf_dir)).select("call_id", "error", "verdict", "margin", "margin_pct")


@query(
    """SELECT event_id AS call_id, CASE event_id % 6 WHEN 0 THEN 'unknown_tool' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'missing:query' WHEN 3 THEN 'unknown:colour' WHEN 4 THEN 'type:value' END AS error FROM events"""
)
def checked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls held against the tools' arguments."""
    m = F.col("event_id") % 6
    name = F.when(m == 0, "fly").when(m == 4, "convert_unit").otherwise("search_manuals")
    args = F.when(m == 1, "{query").when(m == 2, '{"manual": "m"}').when(m == 3, '{"query": "q", "colour": "red"}').when(m == 4, '{"value": "many", "from_unit": "m", "to_unit": "mm"}').otherwise('{"query": "q", "kind": "text"}')
    return tools.checked_calls(table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), name.alias("name"), args.alias("args"))).select("call_id", "error")


@query(
    """WITH a AS (SELECT DISTINCT replace(lower(x), ' ', '') AS name, n_nationkey AS d FROM nation, (SELECT unnest([CAST(n_nationkey AS VARCHAR), left(n_name, 4), n_name]) AS x)),
    q AS (SELECT n_nationkey AS call_id, lower(CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN left(n_name, 2) ELSE 'the ' || n_name || ' manual' END) AS k FROM nation), k AS (SELECT call_id, replace(k, ' ', '') AS k FROM q),
    f AS (SELECT call_id, max(CASE WHEN name = k THEN d END) AS exact, count(DISTINCT d) AS n, min(d) AS one FROM k LEFT JOIN a ON contains(name, k) OR contains(k, name) GROUP BY call_id)
    SELECT call_id, CAST(coalesce(exact, CASE WHEN n = 1 THEN one END) AS VARCHAR) AS doc_id, CASE WHEN exact IS NULL AND n <> 1 THEN 'unknown_manual' END AS error FROM f"""
)
def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as manuals, asked for by name, by its beginning and by a longer name."""
    n, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    manuals = n.select(i.cast("string").alias("doc_id"), F.substring("n_name", 1, 4).alias("short"), F.col("n_name").alias("title"), F.lit(None).cast("array<string>").alias("aliases"))
    asked = n.select(i.alias("call_id"), F.when(i % 3 == 0, F.col("n_name")).when(i % 3 == 1, F.substring("n_name", 1, 2)).otherwise(F.concat(F.lit("the "), "n_name", F.lit(" manual"))).alias("manual"))
    return tools.resolved(asked, tools.aliases(manuals)).select("call_id", "doc_id", "error")


@query(
    """WITH e AS (SELECT user_id AS session, event_type AS chunk_id, event_id AS seq, event_id % 3 + 1 AS r FROM events)
    SELECT session, chunk_id, ['rows', 'head', 'full'][max(r)] AS shown, min(seq) AS seq FROM e GROUP BY session, chunk_id"""
)
def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was shown of each chunk in a session, never less than before."""
    shown = F.element_at(F.array(F.lit("rows"), F.lit("head"), F.lit("full")), (F.col("event_id") % 3 + 1).cast("int"))
    return tools.pooled(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("seq"), shown.alias("shown")))


@query(
    """WITH e AS (SELECT user_id AS r, event_type AS c, min(event_id) AS at FROM events GROUP BY ALL), s AS (SELECT user_id AS r, event_id AS seq FROM events)
    SELECT s.r AS request_id, s.seq, array_to_string(list(e.c ORDER BY e.at), ',') AS sources FROM s JOIN e ON e.r = s.r AND e.at <= s.seq GROUP BY s.r, s.seq"""
)
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of all sources so far at each of a request's retrievals."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("chunk_id"))
    return tools.source_lists(e).select("request_id", "seq", F.array_join("sources", ",").alias("sources"))


@query(
    """WITH r AS (SELECT l_orderkey AS q_id, l_linenumber AS rank, p_partkey AS key, p_name AS text FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT q_id, array_to_string(list('[' || key || ']' || chr(10) || text ORDER BY rank, key), chr(10) || chr(10)) AS context FROM r GROUP BY q_id"""
)
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts as the context of a prompt."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("key"))
    return tools.context_text(hits, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text")))


@query("SELECT array_to_string(list('- ' || CAST(n_nationkey AS VARCHAR) || '：' || n_name ORDER BY '- ' || CAST(n_nationkey AS VARCHAR) || '：' || n_name), chr(10)) AS catalogue FROM nation")
def catalogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.catalogue_text(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("title")))


@query(
    """SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN left(n_name, 3) END, n_name, CAST(c_nationkey + 20 AS VARCHAR)) AS display FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 20"""
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names, else titles, else ids."""
    n = table(spark, sf_dir, "nation")
    manuals = n.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, F.substring("n_name", 1, 3)).alias("short"), F.col("n_name").alias("title"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 20).cast("string").alias("doc_id"))
    return tools.display_names(rows, manuals).select("c_custkey", "display")


@query(
    """WITH u AS (SELECT conv_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user')
    SELECT conv_id, text AS question, concat_ws(' ', before, text) AS search FROM u WHERE n = 1"""
)
def history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.history_query(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(regexp_replace(text, '[^0-9]', '', 'g')) > 0.3 * length(text) THEN 'hard' WHEN doc_id % 3 = 0 THEN 'medium' ELSE 'easy' END AS difficulty FROM documents"""
)
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    near = F.when(i % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.difficulty(F.when(i % 2 == 0, "table").otherwise("text"), F.col("text"), near).alias("difficulty"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'moved' ELSE n_name END AS gold FROM nation WHERE n_nationkey NOT IN (1, 7)")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("gold"))
    dropped = spark.createDataFrame([(1,), (7,)], "n_nationkey int")
    return evaluate.overridden(n, "n_nationkey", dropped, spark.createDataFrame([(4, "moved")], "n_nationkey int, gold string"), "gold")


@query(
    """WITH a AS (SELECT o_orderkey AS position, o_custkey AS k FROM orders), b AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS k FROM orders WHERE o_orderkey % 101 <> 0)
    SELECT position, coalesce(a.k, -2) AS first, coalesce(b.k, -2) AS second FROM a FULL JOIN b USING (position) WHERE a.k IS DISTINCT FROM b.k"""
)
def ordered_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which two lists of keys differ; -2 where one has none."""
    i = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(i.alias("position"), F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").where(i % 101 != 0).select(i.alias("position"), F.when(i % 97 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).cast("long").alias("k"))
    return evaluate.ordered_gate(a, b, "position", "k").na.fill(-2)


@query(
    """WITH a AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IN ('de', 'es')), b AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'es'))
    SELECT 'first' AS side, line FROM (SELECT line FROM a EXCEPT ALL SELECT line FROM b) UNION ALL SELECT 'second', line FROM (SELECT line FROM b EXCEPT ALL SELECT line FROM a)"""
)
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of German and Spanish documents, and of all others, that the other side lacks."""
    d = table(spark, sf_dir, "documents")
    first = F.coalesce(F.col("lang").isin("de", "es"), F.lit(False))
    return evaluate.line_diff(d.where(first), d.where(~first), "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that was broken off still has to do: orders without a fourth line."""
    done = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluate.resumed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


VECTORS = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT a.vec_id AS q_id, b.vec_id AS key, round(1.0 - list_dot_product(b.e, a.e), 6) + 0.0 AS distance FROM v a CROSS JOIN v b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY distance, key) AS INTEGER) AS rank FROM n QUALIFY rank <= 20),
g AS (SELECT q_id, min(rank) AS hit FROM (SELECT a.vec_id AS q_id, b.vec_id AS key FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) LEFT JOIN r USING (q_id, key) GROUP BY q_id)
"""


@query(VECTORS + "SELECT q_id, hit AS base, CASE WHEN q_id % 40 = 0 THEN hit + 3 ELSE 0 END AS other FROM g WHERE hit IS NOT NULL")
def worse_than_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose first hit comes later, or not at all (0), in another run."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    base = retrieval.first_hits_alike(retrieval.cosine_topk(v, q, "vec_id", "embedding"), q, v.select(F.col("vec_id").alias("key"), "label"), "label").select("q_id", "hit")
    return retrieval.worse(base, base.withColumn("hit", F.when(F.col("q_id") % 40 == 0, F.col("hit") + 3))).na.fill(0)


@query(
    """WITH r AS (SELECT item_id AS q_id, doc_id AS key, text, dtext, row_number() OVER (PARTITION BY item_id ORDER BY abs(n_chars - length(text)), doc_id) AS rank FROM benchmark CROSS JOIN (SELECT doc_id, text AS dtext, n_chars FROM documents) QUALIFY rank <= 20),
    s AS (SELECT q_id, key, CAST(length(dtext) % 7 + length(text) % 3 AS DOUBLE) AS score, rank FROM r)
    SELECT q_id, key, score, nr AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rank) AS INTEGER) AS nr FROM s) WHERE nr <= 10"""
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents nearest in length to a question, in the order of another scorer."""
    d, q = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    ranked = retrieval.nearest_by(d.select(F.col("doc_id").alias("key"), "n_chars"), q.select("q_id", F.length("q_text").cast("long").alias("n_chars")), "n_chars")

    def scorer(question, text):
        return (text.str.len() % 7 + question.str.len() % 3).astype("float64")

    import pandas as pd

    scorer.__annotations__ = {"question": pd.Series, "text": pd.Series, "return": pd.Series}
    return retrieval.reranked(ranked, d.select(F.col("doc_id").alias("key"), "text"), q, scorer)


EVENTS = """
WITH e AS (SELECT user_id AS r, event_id AS seq, event_id // 8 AS rd, CASE event_id % 8 WHEN 0 THEN 'thought' WHEN 7 THEN 'step' ELSE 'token' END AS event, event_type || ' ' AS data FROM events)
"""


def _request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 8 == 0, "thought").when(i % 8 == 7, "step").otherwise("token")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), i.alias("seq"), F.floor(i / 8).alias("round"), kind.alias("event"), F.concat("event_type", F.lit(" ")).alias("data"))


@query(
    EVENTS
    + """, g AS (SELECT r, rd, bool_or(event = 'thought') AS t, string_agg(data, '' ORDER BY seq) FILTER (event = 'token') AS told FROM e GROUP BY r, rd)
    SELECT CAST(u.r AS VARCHAR) AS request_id, arg_max(told, rd) FILTER (NOT t AND told IS NOT NULL) AS answer FROM (SELECT DISTINCT r FROM e) u JOIN g ON g.r = u.r GROUP BY u.r"""
)
def round_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each request's last round that isn't a thought."""
    return stream.round_answers(_request_events(spark, sf_dir))


@query(
    """WITH e AS (SELECT user_id AS r, event_id AS seq, CASE event_id % 40 WHEN 13 THEN 'done' WHEN 27 THEN 'error' ELSE 'token' END AS event, event_type || ' ' AS data FROM events),
    l AS (SELECT r, arg_max(event, seq) FILTER (event <> 'token') AS final, string_agg(data, '' ORDER BY seq) FILTER (event = 'token') AS told FROM e GROUP BY r)
    SELECT CAST(r AS VARCHAR) AS request_id, coalesce(final, 'aborted') AS status, CASE WHEN final = 'done' THEN coalesce(told, '') END AS answer FROM l"""
)
def request_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's events as one row of the log."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), i.alias("seq"), F.when(i % 40 == 13, "done").when(i % 40 == 27, "error").otherwise("token").alias("event"), F.concat("event_type", F.lit(" ")).alias("data"))
    return stream.request_rows(stream.once_each(e))


@query(
    """SELECT CAST(event_id AS VARCHAR) AS call_id, event_id % 6 IN (5) AS ok, CASE event_id % 6 WHEN 0 THEN 'unknown_tool' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'missing:query' WHEN 3 THEN 'no_handler' WHEN 4 THEN 'no_result' ELSE '' END AS error,
    CASE WHEN event_id % 6 = 5 THEN 'found ' || event_type ELSE '' END AS content FROM events"""
)
def dispatched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a handler answers, that it leaves out, that have none, and that don't fit."""
    m = F.col("event_id") % 6
    name = F.when(m == 0, "fly").when(m == 3, "lookup_table").otherwise("search_manuals")
    args = F.when(m == 1, "{query").when(m == 2, "{}").when(m == 3, '{"keywords": "k"}').when(m == 4, '{"query": ""}').otherwise(F.concat(F.lit('{"query": "'), "event_type", F.lit('"}')))
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), name.alias("name"), args.alias("args"))

    def search(own: DataFrame) -> DataFrame:
        asked = own.where(F.col("args")["query"] != "")
        return asked.select("call_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("found "), F.col("args")["query"]).alias("content"))

    return tools.dispatched(calls, {"search_manuals": search}).na.fill("")


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS term FROM documents), c AS (SELECT doc_id, CAST('0x' || left(md5(term), 8) AS BIGINT) % 64 AS place, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS places, round(sum(n) / sqrt(sum(n * n)), 6) AS total, round(max(n) / sqrt(sum(n * n)), 6) AS most FROM c GROUP BY doc_id"""
)
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of hashed terms: how many places they fill, their sum and their largest."""
    v = retrieval.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").where("embedding IS NOT NULL")
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("places"), F.round(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.round(F.array_max("embedding"), 6).alias("most"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_name, c_acctbal, c_mktsegment, c_custkey % 5 AS m FROM customer)
    SELECT id, 'about.deep.a.b.c.balance' AS path, 'differs' AS kind FROM c WHERE m = 1 UNION ALL SELECT id, 'about.segment', 'new' FROM c WHERE m = 2 UNION ALL SELECT id, 'list', 'differs' FROM c WHERE m = 3
    UNION ALL SELECT id, 'about.deep.a.b.c.extra', 'old' FROM c WHERE m = 4"""
)
def json_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON, six levels deep, in two spellings that order and space their keys otherwise, with a difference by the key's remainder."""
    c, m = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    text = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.lit(10**6))  # a JSON string and a closing brace
    quoted = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    d = c.withColumn("_s", text(F.col("c_mktsegment"))).withColumn("_n", text(F.col("c_name"))).withColumn("seg", quoted("_s")).withColumn("name", quoted("_n"))
    old = F.format_string('{"name": %s, "about": {"segment": %s, "deep": {"a": {"b": {"c": {"balance": %s, "one": 1.0}}}}}, "list": [1, {"x": 1, "y": [2]}]}', "name", "seg", F.col("c_acctbal").cast("string"))
    balance = F.when(m == 1, (F.col("c_acctbal") + 1)).otherwise(F.col("c_acctbal")).cast("string")
    extra = F.when(m == 4, ', "extra": null').otherwise("")
    segment = F.when(m == 2, "").otherwise(F.concat(F.lit(', "segment" : '), "seg"))
    ends = F.when(m == 3, '[{"y":[2],"x":1},1]').otherwise('[1,{"y":[2],"x":1}]')
    new = F.concat(F.lit('{"list":'), ends, F.lit(',"about":{"deep":{"a":{"b":{"c":{"one":1,"balance":'), balance, extra, F.lit("}}}}"), segment, F.lit('},"name":'), F.col("name"), F.lit("}"))
    found = evaluate.json_diff(d.select("c_custkey", old.alias("j")), d.select("c_custkey", new.alias("j")), "j", ["c_custkey"])
    return found.select(F.col("c_custkey").alias("id"), "path", F.coalesce("missing", F.lit("differs")).alias("kind"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS r, event_id AS seq, event_id // 8 AS rd, CASE WHEN event_id % 211 = 5 THEN 'done' WHEN event_id % 307 = 6 THEN 'error' WHEN event_id % 409 = 6 THEN 'rejected' ELSE ['thought', 'token', 'token', 'retrieval', 'token', 'token', 'token', 'step'][1 + event_id % 8] END AS event,
         event_type || ' ' AS word, 'c' || event_id % 13 AS c1, 'c' || event_id % 7 AS c2, epoch(ts) AS t FROM events),
    n AS (SELECT r, rd, bool_or(event = 'thought') AS thought, string_agg(word, '' ORDER BY seq) FILTER (event = 'token') AS told, min(t) FILTER (event = 'token') AS spoke FROM e GROUP BY r, rd),
    s AS (SELECT r, arg_max(told, rd) AS told, arg_max(spoke, rd) AS spoke FROM n WHERE NOT thought AND told IS NOT NULL GROUP BY r),
    x AS (SELECT r, chunk, min(seq * 2 + nth) AS place FROM (SELECT r, seq, unnest([c1, c2]) AS chunk, unnest([0, 1]) AS nth FROM e WHERE event = 'retrieval') GROUP BY r, chunk),
    o AS (SELECT r, string_agg(chunk, ',' ORDER BY place) AS sources FROM x GROUP BY r),
    g AS (SELECT r, min(t) AS first, max(t) AS last, count(*) FILTER (event = 'step') AS steps, max(seq) FILTER (event = 'done') AS done, arg_max(event, seq) FILTER (event IN ('error', 'rejected')) AS final FROM e GROUP BY r)
    SELECT g.r AS request_id, CASE final WHEN 'error' THEN 'error' WHEN 'rejected' THEN 'rejected_gate' ELSE 'answered' END AS status, CASE WHEN done IS NOT NULL THEN 'told at ' || done ELSE trim(coalesce(told, '')) END AS answer,
           round((spoke - first) * 1000, 3) AS first_token_ms, round((last - first) * 1000, 3) AS total_ms, coalesce(sources, '') AS sources, steps FROM g LEFT JOIN s ON s.r = g.r LEFT JOIN o ON o.r = g.r"""
)
def round_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request by rounds: the answer, the time to its first token, all sources and the steps."""
    i = F.col("event_id")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("thought", "token", "token", "retrieval", "token", "token", "token", "step")]), (1 + i % 8).cast("int"))
    kind = F.when(i % 211 == 5, "done").when(i % 307 == 6, "error").when(i % 409 == 6, "rejected").otherwise(kinds)
    chunk = lambda n: F.concat(F.lit("c"), (i % n).cast("string"))
    data = F.when(kind == "done", F.to_json(F.struct(F.concat(F.lit(" told at "), i.cast("string")).alias("answer")))).when(kind == "retrieval", F.to_json(F.array(chunk(13), chunk(7)))).otherwise(F.concat("event_type", F.lit(" ")))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), i.alias("seq"), F.floor(i / 8).alias("round"), kind.alias("event"), data.alias("data"), "ts")
    rows = stream.round_rows(e.unionByName(e.where(i % 3 == 0)))  # every third is sent again
    return rows.withColumn("sources", F.array_join("sources", ","))
