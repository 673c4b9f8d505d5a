"""Importance resampling towards a target distribution, by hashed n-grams.

Each task hands its texts, a few at a time, to a DuckDB of its own: SQL splits them into words, unnests
them, forms n-grams with window functions and counts each text's buckets, a registered function giving
the zlib CRC of an n-gram. These bucket counts are spilled to Parquet in the shared folder. Spark
merges them into the bucket totals of corpus and target, scores each document by the log ratio of
both, adds a hash-random Gumbel key and takes the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.storage import numbered

from .common import documents, lean, ready, stored

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that a task's DuckDB is given at a time, unless one text is longer, and what it may hold.
CHARS, MEMORY = 2_000_000, "512MB"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counting_sql(order: int = ORDER, buckets: int = BUCKETS) -> str:
    """DuckDB SQL from the table `texts` (place, text) to place, n_words, n_features, buckets, times; texts without words give no row."""
    runs = ["SELECT place, word AS gram FROM words"]
    for n in range(2, order + 1):
        run = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER run" for k in range(1, n)]])
        runs.append(f"SELECT place, gram FROM (SELECT place, {run} AS gram FROM words WINDOW run AS (PARTITION BY place ORDER BY nth)) WHERE gram IS NOT NULL")
    return f"""
    WITH lists AS (SELECT place, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{SPLIT}') AS list FROM texts),
    words AS (SELECT place, unnest(list) AS word, generate_subscripts(list, 1) AS nth FROM lists),
    grams AS ({" UNION ALL ".join(runs)}),
    counted AS (SELECT place, gram, count(*) AS n FROM grams GROUP BY ALL),
    hashed AS (SELECT gram, zlib_crc32(gram) % {int(buckets)} AS bucket FROM (SELECT DISTINCT gram FROM counted)),
    spread AS (SELECT place, CAST(bucket AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL)
    SELECT place, any_value(len(list)) AS n_words, CAST(sum(n) AS BIGINT) AS n_features, list(bucket) AS buckets, list(n) AS times
    FROM spread JOIN lists USING (place) GROUP BY place"""


def bucket_counts(rows: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, buckets, times for each of rows (id, text), spilled to Parquet: the buckets of its n-grams, each once, and how often.

    A null, empty or wordless text has 0 words and empty lists; a very long one is counted whole, by itself.
    Repeated rows stay rows, null ids stay null.
    """
    sql = counting_sql(order, buckets)

    def crc(grams: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], type=pa.uint32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        lean()
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        con.create_function("zlib_crc32", crc, ["VARCHAR"], "UINTEGER", type="arrow")
        for batch in batches:
            texts, start = batch["text"].to_pylist(), 0
            while start < len(texts):
                end, size = start + 1, len(texts[start] or "")
                while end < len(texts) and size + len(texts[end] or "") <= CHARS:
                    size += len(texts[end] or "")
                    end += 1
                con.register("texts", pa.table({"place": pa.array(range(start, end), pa.int64()), "text": pa.array(texts[start:end], pa.string())}))
                made = con.sql(sql).to_arrow_table().sort_by("place")
                con.unregister("texts")
                found = dict(zip(made["place"].to_pylist(), range(made.num_rows), strict=True))
                take = pa.array([found.get(i) for i in range(start, end)], pa.int64())
                got = [made[c].combine_chunks().take(take) for c in ("n_words", "n_features", "buckets", "times")]
                counts = [c.cast(pa.int64()).fill_null(0) for c in got[:2]]
                lists = [c.cast(t).fill_null(pa.scalar([], t)) for c, t in zip(got[2:], (pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(start, end - start), *counts, *lists], names=["id", "n_words", "n_features", "buckets", "times"])
                start = end
        con.close()

    plain = rows.select(F.col("id").cast("long"), F.col("text").cast("string"))
    return stored(plain.mapInArrow(run, "id long, n_words long, n_features long, buckets array<int>, times array<long>"))


def totals(counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features each bucket holds; one row for each bucket reaches the driver."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "times")).alias("f")).groupBy(F.col("f.buckets").alias("bucket")).agg(F.sum("f.times").alias("n"))
    found = {r.bucket: r.n for r in each.collect()}
    return [found.get(b, 0) for b in range(buckets)]


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """1000 times the log ratio of a bucket's share in the target to that in the corpus, both with one feature more in each bucket, rounded down."""
    s_all, t_all, n = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus, target, strict=True)]


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, rounded down, that the id alone decides (null: the empty string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text); target has texts in `text`. Other columns, of any name, are not read.

    weight: the sum of the gains of a document's features, 0 without any (null, empty or wordless text). Of the N rows
    with at least `least` words the floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the
    smaller doc_id, null ids last; all others have a null rank. Repeated rows are rows of their own; those equal in id
    and score share their ranks in any order. An empty table gives no rows, an empty target counts as no features.
    Ranks come from ranges of scores, so that no task holds all of them; only bucket totals reach the driver.
    """
    counts = bucket_counts(docs.select(F.col("doc_id").alias("id"), "text"), order, buckets)
    aims = bucket_counts(target.select(F.lit(0).alias("id"), "text"), order, buckets)
    gain = F.split(F.lit(",".join(map(str, gains(totals(counts, buckets), totals(aims, buckets))))), ",").cast("array<long>")
    parts = F.zip_with("buckets", "times", lambda b, n: F.get(gain, b) * n)
    weight = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    scored = counts.select(F.col("id").alias("doc_id"), "n_words", "n_features", weight.alias("weight"))
    scored = stored(scored.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")))
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    own = ["doc_id", "n_features", "weight", "score"]
    placed = numbered(scored.where(able).select(*own), [], [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    placed = placed.select(*own, F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
    return placed.unionByName(scored.where(~able).select(*own, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of docs, with all their columns. Rows equal in doc_id are drawn together, if one of them is; rows without an id are not drawn."""
    drawn = stored(importance(docs, target, **options).where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    return docs.join(drawn, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them drawn to be like the benchmark's texts; nulls, ties, empty and long texts, repeated rows and tables as in importance."""
    return importance(documents(spark, sf_dir), ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 in SQL goes over a word's half bytes, lower one first, by a table that its polynomial gives.
SQL = r"""
WITH nibble(k, v) AS (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                      FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS k)),
steps AS (SELECT list(v ORDER BY k) AS step FROM nibble),
texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS place, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
lists AS (SELECT side, doc_id, place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM texts),
words AS (SELECT side, place, unnest(list) AS word FROM lists),
hex AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
halves AS (SELECT word, list_transform(range(CAST(len(h) AS BIGINT)), lambda i: CAST(instr('0123456789ABCDEF', h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT)) AS half FROM hex),
hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), half), lambda c, n: xor(c >> 4, step[1 + (xor(c, n) & 15)])), 4294967295) % 10000 AS bucket
           FROM halves, steps),
spread AS (SELECT side, place, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM spread GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS gain FROM sums, alls),
weights AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM spread JOIN gains USING (bucket) WHERE side = 0 GROUP BY place),
scored AS (SELECT doc_id, len(list) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM lists LEFT JOIN weights USING (place) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM ranked) * 10 // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20
"""
