"""Queries over blocks, chunks, headings and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunk, evaluate, ingest, quotes, tables
from quillon.plans.base import query, table

contained = quotes.contained


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each region's nations, the region in one cell of several rows."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    first = F.concat(F.lit('<tr><td rowspan="'), F.size("names"), F.lit('">'), F.col("r_name"), F.lit("</td><td>"), F.element_at("names", 1), F.lit("</td></tr>"))
    rest = F.array_join(F.transform(F.slice("names", 2, F.size("names")), lambda n: F.concat(F.lit("<tr><td>"), n, F.lit("</td></tr>"))), "")
    return g.select("r_regionkey", "r_name", F.concat(F.lit("<table>"), first, rest, F.lit("</table>")).alias("html"))


LINES = """
WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, lang, source, unnest(range(len(s))) AS idx, unnest(s) AS text FROM d)
"""


@query(
    LINES
    + r""", f AS (SELECT CASE WHEN text = '' THEN 'empty' END AS a, CASE WHEN text <> '' AND length(text) < 10 THEN 'short' END AS b, CASE WHEN length(text) > 2000 THEN 'long' END AS c,
        CASE WHEN length(text) - length(replace(replace(text, '.', ''), '…', '')) >= 20 THEN 'toc' END AS d,
        CASE WHEN text <> '' AND length(regexp_replace(text, '[\s\x20-\x7E\x{A0}-\x{FF}\x{2000}-\x{206F}\x{2100}-\x{214F}\x{2200}-\x{22FF}\x{2500}-\x{257F}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]', '', 'g')) / length(text)::DOUBLE > 0.3 THEN 'garbage' END AS e FROM l)
    SELECT class, count(*) AS n FROM (SELECT unnest([a, b, c, d, e]) AS class FROM f) WHERE class IS NOT NULL GROUP BY class"""
)
def qc_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by anomaly; a line may be of several classes."""
    none = F.lit(None).cast("string")
    rows = lines(spark, sf_dir).withColumns({"table_html": none, "img_path": none, "char_len": F.length("text")})
    return ingest.anomalies(rows).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS nth, count(*) OVER (PARTITION BY lang) AS total FROM documents WHERE n_chars < 500)
    SELECT lang, doc_id, CAST(nth AS INTEGER) AS nth, total, greatest(total - 10, 0) AS omitted FROM c WHERE nth <= 10"""
)
def qc_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language's documents under 500 characters the ten shortest, and how many are left out."""
    d = table(spark, sf_dir, "documents").where("n_chars < 500").select("lang", "doc_id", "n_chars")
    return ingest.shortlist(d, "lang", ["n_chars", "doc_id"]).select("lang", "doc_id", "nth", "total", "omitted")


@query("SELECT n_regionkey AS r_regionkey, 2 AS columns, count(*) > 1 AS uneven FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each table's rows: only the first has the region's cell."""
    return ingest.uneven_tables(nation_tables(spark, sf_dir), "html").select("r_regionkey", F.col("columns").cast("int").alias("columns"), "uneven")


@query(
    LINES
    + """, a AS (SELECT lang, count(*) AS before, count(*) FILTER (text <> '' AND length(text) >= 10) AS kept FROM l GROUP BY lang)
    SELECT lang, before, kept AS after, before - kept AS deleted FROM a"""
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each language, all and those of 10 characters at least."""
    rows = lines(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return ingest.before_after(rows, rows.where(F.length("text") >= 10), "lang")


@query("SELECT CAST(CASE WHEN url IS NULL OR url = '' THEN 0 ELSE len(string_split(replace(url, '/', ' > '), ' > ')) END AS INTEGER) AS depth, count(*) AS n FROM pages GROUP BY ALL")
def heading_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of pages' addresses as heading paths."""
    p = table(spark, sf_dir, "pages").withColumn("heading_path", F.replace("url", F.lit("/"), F.lit(" > ")))
    return ingest.heading_depths(p).select(F.col("depth").cast("int").alias("depth"), "n")


@query("SELECT conv_id, CAST(max(turn) + 1 AS BIGINT) AS pages FROM conversations GROUP BY conv_id")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.page_count(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.col("pages").cast("long").alias("pages"))


@query(
    """WITH n AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT r_regionkey, 'Regions > ' || r_name || chr(10) || '表头: ' || r_name || ' | ' || names[1] || chr(10) || r_name || ' ' || array_to_string(names, ' ') AS search_text FROM n"""
)
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched of each table chunk: its heading, first row and cells."""
    none = F.lit(None).cast("string")
    out = chunk.search_text(F.lit("table"), none, F.col("html"), F.concat(F.lit("Regions > "), F.col("r_name")))
    return nation_tables(spark, sf_dir).select("r_regionkey", out.alias("search_text"))


BLOCKS = (
    LINES
    + """, t AS (SELECT doc_id, idx, text, CASE WHEN idx % 13 = 12 THEN 'footer' WHEN idx % 9 = 8 THEN 'table' ELSE 'text' END AS type, 'Part ' || (idx // 6) AS h FROM l),
    k AS (SELECT *, type = 'table' AS tb FROM t WHERE type <> 'footer'),
    m AS (SELECT *, lag(tb) OVER o AS before_tb, last_value(CASE WHEN NOT tb THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_h FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY idx)),
    s AS (SELECT *, sum(CASE WHEN NOT tb AND (coalesce(before_tb, false) OR before_h IS NULL OR before_h <> h) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM m),
    g AS (SELECT doc_id, run, min(idx) AS begins, arg_min(h, idx) AS h, list(length(text) ORDER BY idx) AS n, list(text ORDER BY idx) AS texts FROM s WHERE NOT tb GROUP BY doc_id, run),
    c AS (SELECT *, list_transform(range(len(n) + 1), lambda k: coalesce(list_sum(n[:k]), 0)) AS c FROM g),
    r AS (SELECT doc_id, run, 0 AS nth, 0 AS a, least(len(n), len(list_filter(c, lambda x: x < 400)), greatest(len(list_filter(c, lambda x: x <= 800)) - 1, len(list_filter(c, lambda x: x <= 0)))) AS b FROM c
          UNION ALL
          SELECT doc_id, run, nth + 1, i, least(len(n), len(list_filter(c, lambda x: x < c[i + 1] + 400)), greatest(len(list_filter(c, lambda x: x <= c[i + 1] + 800)) - 1, len(list_filter(c, lambda x: x <= c[i + 1]))))
          FROM (SELECT r.doc_id, r.run, r.nth, greatest(r.b - 1, r.a + 1) AS i, c.n, c.c FROM r JOIN c ON r.doc_id = c.doc_id AND r.run = c.run WHERE r.b < len(c.n))),
    e AS (SELECT r.doc_id, c.begins, r.nth, 'text' AS chunk_type, c.h, array_to_string(list_filter(c.texts[r.a + 1:r.b], lambda x: x <> ''), chr(10) || chr(10)) AS body FROM r JOIN c ON r.doc_id = c.doc_id AND r.run = c.run),
    w AS (SELECT doc_id, begins, nth, chunk_type, length(h) + 2 + length(body) AS char_len FROM e
          WHERE length(regexp_replace(body, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) >= 30
            AND CAST(regexp_matches(body, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+') AS INTEGER) + CAST(regexp_matches(body, '(?i)(https?://|www\\.)[\\p{L}\\p{N}_./?=&#-]+') AS INTEGER)
              + CAST(regexp_matches(body, '(\\+\\d{1,3}[- ]?)?\\d{3,4}([- ]\\d{3,4})+') AS INTEGER) + CAST(contains(body, '热线') AS INTEGER)
              + CAST(regexp_matches(body, '(?i)(straße|strasse|street|road|地址|邮编|postal|Dortmund|Germany|Deutschland|GmbH|有限公司|集团|股份)') AS INTEGER) < 2
          UNION ALL SELECT doc_id, idx, 0, 'table', length(text) FROM s WHERE tb)
    SELECT doc_id || '_c' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY begins, nth) - 1 AS VARCHAR), 4, '0') AS chunk_id, chunk_type, CAST(char_len AS INTEGER) AS char_len FROM w"""
).replace("WITH d AS", "WITH RECURSIVE d AS")


@query(BLOCKS)
def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks under headings of six lines, some of them tables and footers, made into numbered chunks."""
    i = F.col("idx")
    kind = F.when(i % 13 == 12, "footer").when(i % 9 == 8, "table").otherwise("text")
    b = lines(spark, sf_dir).withColumn("type", kind).withColumn("heading_path", F.concat(F.lit("Part "), F.floor(i / 6)))
    t = F.col("type") == "table"
    b = b.select(F.col("doc_id").cast("string").alias("doc_id"), "idx", F.format_string("%s_%04d", F.col("doc_id").cast("string"), i).alias("block_id"), "type", "heading_path", F.when(~t, F.col("text")).alias("text"), F.when(t, F.col("text")).alias("table_html"), F.length("text").alias("char_len"), (i / 40).cast("int").alias("page_idx"))
    return chunk.assembled(b).where(F.col("dropped").isNull()).select("chunk_id", "chunk_type", F.col("char_len").cast("int").alias("char_len"))


@query(
    """SELECT doc_id, source || ' · ' || CASE WHEN lang = 'en' THEN '（无章节标题）' ELSE lang END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' · 第 ' || (doc_id % 7 + 1) || ' 页' END || ' · 正文' AS header,
    CASE WHEN lang <> 'en' THEN text ELSE 'All > en' || chr(10) || chr(10) || text END AS body, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7 + 1) || '-' || (doc_id % 7 + 2) END AS pages FROM documents"""
)
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk below the heading `All > its language` (English ones below none): header line, text without the heading, pages."""
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("lang") != "en", F.concat(F.lit("All > "), F.col("lang")))
    full = F.concat(F.lit("All > "), F.col("lang"), F.lit("\n\n"), F.col("text"))
    page = (F.col("doc_id") % 7).cast("int")
    pages = F.when(F.col("doc_id") % 3 != 0, F.array(page, page + 1)).otherwise(F.array(page))
    return d.select("doc_id", chunk.header_line(F.col("source"), path, pages, F.lit("text")).alias("header"), chunk.body_text(full, path).alias("body"), F.array_join(chunk.pages_shown(pages), "-").alias("pages"))


@query(
    """SELECT doc_id AS chunk_id, coalesce(lang, '') AS heading_path, '[' || doc_id % 5 || ',' || (doc_id % 5 + 1) || ']' AS page_range, '["b' || doc_id || '"]' AS source_block_ids,
    CASE WHEN doc_id % 4 = 0 THEN '' END AS table_html FROM documents"""
)
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("doc_id") % 5).cast("int")
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "table").otherwise("text").alias("chunk_type"), F.col("lang").alias("heading_path"), F.array(p, p + 1).alias("page_range"), F.array(F.concat(F.lit("b"), F.col("doc_id"))).alias("source_block_ids"), F.lit(None).cast("string").alias("table_html"))
    return chunk.metadata(c).select("chunk_id", "heading_path", "page_range", "source_block_ids", "table_html")


@query(
    """WITH c AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE left(n_name, 1) END AS h FROM nation)
    SELECT a.n_nationkey AS chunk_id, coalesce(array_to_string(list(b.n_nationkey ORDER BY b.n_nationkey) FILTER (b.n_nationkey IS NOT NULL), ','), '') AS neighbours
    FROM c a LEFT JOIN c b ON a.n_regionkey = b.n_regionkey AND a.h = b.h AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_nationkey"""
)
def section_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region under one heading, their first letter; some have none."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"), F.col("n_regionkey").alias("doc_id"), F.when(F.col("n_nationkey") % 4 != 0, F.substring("n_name", 1, 1)).alias("heading_path"))
    return chunk.section_neighbours(n).select("chunk_id", F.array_join("neighbours", ",").alias("neighbours"))


@query("SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query(
    """WITH h AS (SELECT CAST('0x' || left(sha1(concat_ws(chr(31), CAST(doc_id AS VARCHAR), coalesce(text, ''))), 14) AS BIGINT) AS x FROM documents)
    SELECT count(*) AS rows, left(sha1(count(*) || ':' || coalesce(sum(x), 0)), 16) AS fingerprint FROM h"""
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"""SELECT doc_id, left(regexp_replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), '|', chr(92) || '|'), '^\s+', ''), 60) AS cell, sha1(text) AS key,
    round(coalesce(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0), 6) AS digits, CASE WHEN n_chars >= 1000 THEN CAST(round(n_chars::DECIMAL(18, 0) * 0.001::DECIMAL(4, 3), 1) AS VARCHAR) || ' 秒' ELSE n_chars || ' 毫秒' END AS duration,
    printf('%+.3f', n_chars / 1000.0) AS signed, '第 ' || (doc_id % 5 + 1) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '–' || (doc_id % 5 + 2) END || ' 页' AS pages, to_json([source, lang]) AS listed FROM documents"""
)
def display_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report cells, keys, shares and labels of every document."""
    n, p = F.col("n_chars"), F.col("doc_id") % 5 + 1
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.report_cell(F.col("text")).alias("cell"), F.sha1("text").alias("key"), F.round(T.digit_share(F.col("text")), 6).alias("digits"), T.duration_label(n).alias("duration"),
        T.signed(n / F.lit(1000.0)).alias("signed"), T.page_label(p, F.when(F.col("doc_id") % 2 == 0, p).otherwise(p + 1)).alias("pages"), F.to_json(F.array("source", "lang")).alias("listed"),
    )


@query(
    """WITH t AS (SELECT r_regionkey, r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS row_idx, r_name || ' | ' || n_name AS text, count(*) OVER (PARTITION BY r_regionkey) AS n_rows, r_name || ' | ' || min(n_name) OVER (PARTITION BY r_regionkey) AS header FROM nation JOIN region ON n_regionkey = r_regionkey),
    q AS (SELECT n_nationkey AS q_id, CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 2, 1) ELSE substr(n_name, 2, 1) || ', ' || substr(r_name, 1, 2) END AS words FROM nation JOIN region ON n_regionkey = r_regionkey),
    k AS (SELECT q_id, list_filter(list_transform(regexp_split_to_array(words, '[\\s,]+'), lambda w: lower(w)), lambda w: w <> '') AS keys FROM q),
    h AS (SELECT q_id, t.*, row_number() OVER (PARTITION BY q_id, text ORDER BY r_regionkey, row_idx) AS copy FROM k JOIN t ON len(list_filter(keys, lambda w: contains(replace(lower(text), ' ', ''), w))) > 0
          AND len(list_filter(keys, lambda w: NOT contains(replace(lower(text), ' ', ''), w) AND NOT contains(replace(lower('Regions' || header), ' ', ''), w))) = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY q_id, r_regionkey ORDER BY row_idx) AS nth FROM h WHERE copy = 1),
    g AS (SELECT q_id, r_regionkey, count(*) AS c, coalesce(sum(count(*)) OVER (PARTITION BY q_id ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o GROUP BY q_id, r_regionkey),
    s AS (SELECT o.q_id, o.r_regionkey, o.row_idx, o.text FROM o JOIN g ON o.q_id = g.q_id AND o.r_regionkey = g.r_regionkey WHERE before < 12 AND (n_rows <= 6 OR nth <= 12 - before))
    SELECT s.q_id, s.r_regionkey, CAST(s.row_idx AS INTEGER) AS row_idx, s.text, (SELECT count(*) FROM o WHERE o.q_id = s.q_id) - count(*) OVER (PARTITION BY s.q_id) AS omitted FROM s"""
)
def lookup_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords taken from each nation's name looked up in all regions' tables, within the row budget."""
    t = nation_tables(spark, sf_dir).withColumn("heading", F.lit("Regions")).withColumn("manual", F.col("r_regionkey").cast("string"))
    rows, about = tables.store(t, "r_regionkey", "manual", "html", "heading")
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    second = F.substring("n_name", 2, 1)
    words = F.when(F.col("n_nationkey") % 3 == 0, second).otherwise(F.concat(second, F.lit(", "), F.substring("r_name", 1, 2)))
    asked = j.select(F.col("n_nationkey").alias("q_id"), words.alias("words"), F.lit(None).cast("string").alias("manual"))
    hits = tables.looked_up(rows, about.withColumnRenamed("manual", "doc"), asked, "r_regionkey", "doc")
    return tables.presented(hits, "r_regionkey", "doc").select("q_id", "r_regionkey", "row_idx", "text", "omitted")
