"""Blocks: projection, heading paths, running heads, the cleaning cascade and quality counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from quillon.functions.text import blank, char_len, contact_classes, only_symbols, strip_invisible, stripped
from quillon.operators.quantiles import beside, percentiles
from quillon.storage import stored

TOC_DOTS, SHORT, LONG, GARBAGE = 20, 10, 2000, 0.3
BUCKETS = ((0, 10), (10, 50), (50, 100), (100, 200), (200, 500), (500, 2001))


def blocks(content: DataFrame) -> DataFrame:
    """Blocks from parser items (doc_id, idx, type, text, table_body, img_path, image_caption, code_body, page_idx).

    Page numbers go; ids count them, so ids may have gaps.
    """
    caption = F.nullif(F.trim(F.array_join("image_caption", " ")), F.lit(""))
    text = F.when(F.col("type") == "table", F.lit(None)).when(F.col("type") == "image", caption).when(F.col("type") == "code", F.col("code_body")).otherwise(F.col("text"))
    kept = content.where(F.col("type") != "page_number")
    return kept.select(F.format_string("%s_%04d", "doc_id", "idx").alias("block_id"), "doc_id", "idx", "page_idx", "type", text.alias("text"), F.when(F.col("type") == "table", F.col("table_body")).alias("table_html"), "img_path", char_len(text).alias("char_len"))


Stack = list[tuple[int, str | None]]


def grown(stack: Stack, level: int | None, title: str | None) -> Stack:
    """The headings that hold after a row: one of level k ends those of level k or more; without a level nothing changes."""
    return stack if level is None else [x for x in stack if x[0] < level] + [(level, title)]


def heading_paths(rows: DataFrame, doc: str, idx: str, level: str, title: str) -> DataFrame:
    """rows with heading_path: a heading of level k, however deep, holds until one of level k or less; null where none with a title holds. Rows without a level, or of level 0, are no headings.

    Rows are dealt by ranges of document and place, so that a huge document is many tasks. What a range does to the
    headings before it is its least level and the stack that it leaves; joined in order these give the stack that each range
    begins with. One such row for each task reaches the driver. A null document is a document.
    """
    n = max(1, rows.rdd.getNumPartitions())
    ranged = stored(rows.repartitionByRange(n, doc, idx).withColumn("_task", F.spark_partition_id()))
    heading = [F.col(doc).cast("string").alias("_d"), F.when(F.col(level) > 0, F.col(level)).cast("long").alias("_l"), F.col(title).cast("string").alias("_t")]
    in_order = ranged.select(*rows.columns, "_task", *heading).repartition(n, "_task").sortWithinPartitions("_task", doc, idx)
    names = ["_task", "_d", "_l", "_t"]

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task: its first and last document, and of the last one's part the least level and the stack."""
        seen: dict[int, tuple] = {}
        for b in batches:
            for task, d, k, t in zip(*[b[c].to_pylist() for c in names], strict=True):
                first, last, least, stack = seen.get(task, (d, d, None, []))
                if d != last:
                    least, stack = None, []
                least = k if least is None else least if k is None else min(k, least)
                seen[task] = first, d, least, grown(stack, k, t)
        for task, (first, last, least, stack) in seen.items():
            columns = [[task], [first], [last], [least], [[x[0] for x in stack]], [[x[1] for x in stack]]]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["task", "first", "last", "least", "levels", "titles"])

    found = in_order.select(*names).mapInArrow(effect, "task int, first string, last string, least long, levels array<long>, titles array<string>").collect()
    begins: dict[int, tuple[str | None, Stack]] = {}
    carried: tuple[str | None, Stack] | None = None
    for r in sorted(found, key=lambda r: r.task):
        if carried is not None and carried[0] == r.first:
            begins[r.task] = carried
        base = begins[r.task][1] if r.first == r.last and r.task in begins else []
        carried = r.last, [x for x in base if r.least is None or x[0] < r.least] + list(zip(r.levels, r.titles, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            paths = []
            for task, d, k, t in zip(*[b[c].to_pylist() for c in names], strict=True):
                if at != (task, d):
                    stack = begins[task][1] if (at is None or at[0] != task) and task in begins else []
                    at = task, d
                stack = grown(stack, k, t)
                paths.append(" > ".join(x for _, x in stack if x is not None) or None)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(b.columns) - 4], pa.array(paths, pa.string())], names=[*b.schema.names[:-4], "heading_path"])

    return in_order.mapInArrow(run, StructType([*rows.schema.fields, StructField("heading_path", StringType())]))


def running_heads(rows: DataFrame, doc: str, page: str, text: str, share: float = 0.5) -> DataFrame:
    """doc, text, pages, share of texts that stand on at least `share` of a document's pages."""
    pages = rows.groupBy(doc).agg(F.countDistinct(page).alias("all_pages"))
    on = rows.where(~blank(F.col(text))).groupBy(doc, text).agg(F.countDistinct(page).alias("pages"))
    return on.join(pages, doc).withColumn("share", F.round(F.col("pages") / F.col("all_pages"), 6)).where(F.col("share") >= share).select(doc, text, "pages", "share")


def clean(rows: DataFrame) -> DataFrame:
    """rows (type, text, table_html, img_path) with clean_text and rule, the first that fires.

    Nothing at all, blank once invisible characters are gone, a table of contents, symbols alone, a table
    without a body: dropped. What stays is marked if characters went or if it is short. Rules after the second see the text without invisible characters.
    """
    has = lambda c: ~blank(F.col(c))
    seen = rows.withColumn("clean_text", strip_invisible(F.col("text")))  # once, for all rules
    text = F.col("clean_text")
    changed = has("text") & (text != F.col("text"))
    dots = F.regexp_count(text, F.lit("[.…]"))
    rule = (
        F.when(~has("text") & ~has("table_html") & ~has("img_path"), "drop_empty")
        .when(changed & (stripped(text) == ""), "drop_control_chars")
        .when(has("text") & (dots >= TOC_DOTS), "drop_toc")
        .when(has("text") & only_symbols(text), "drop_pure_symbol")
        .when((F.col("type") == "table") & ~has("table_html") & ~has("img_path"), "drop_empty_table")
        .when(changed, "strip_control_chars")
        .when(has("text") & (F.length(text) < SHORT), "keep_short")
        .otherwise("keep")
    )
    return seen.withColumn("rule", rule).select(*[F.col(c) for c in rows.columns if c not in ("rule", "clean_text")], "rule", "clean_text")


#: What a text may hold without being garbage: white space, and these ranges (fixed values).
READABLE = r"\x{20}-\x{7E}\x{A0}-\x{FF}\x{2000}-\x{206F}\x{2100}-\x{214F}\x{2200}-\x{22FF}\x{2500}-\x{257F}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}"


def garbage_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(rf"(?U)[^\s{READABLE}]")) / F.length(c)).otherwise(0.0)


def anomalies(blocks_: DataFrame) -> DataFrame:
    """A row for each block and class (empty, short, long, toc, garbage) that it is in; a block may be in several."""
    text, has = F.col("text"), ~blank(F.col("text"))
    flags = {
        "empty": ~has & blank(F.col("table_html")) & blank(F.col("img_path")), "short": has & (F.col("char_len") < SHORT), "long": F.col("char_len") > LONG,
        "toc": has & (F.regexp_count(text, F.lit("[.…]")) >= TOC_DOTS), "garbage": has & (garbage_share(text) > GARBAGE),
    }
    classes = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in flags.items()]))
    return blocks_.withColumn("class", F.explode(classes))


def shortlist(rows: DataFrame, by: str, order: list[str], most: int = 10) -> DataFrame:
    """The first `most` rows of each group, with how many there are and how many are left out."""
    w = Window.partitionBy(by).orderBy(*order)
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    kept = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return kept.join(total, by).withColumn("omitted", F.greatest(F.col("total") - most, F.lit(0)))


def uneven_tables(rows: DataFrame, html: str = "table_html") -> DataFrame:
    """rows with columns (the most cells of a row) and uneven (rows differ in cells); only bare `<tr>` count as rows here."""
    cells = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1)), lambda r: F.regexp_count(r, F.lit("<t[hd]")))
    return rows.withColumn("columns", F.coalesce(F.array_max(cells), F.lit(0))).withColumn("uneven", F.size(F.array_distinct(F.coalesce(cells, F.array().cast("array<int>")))) > 1)


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before, after, deleted over the keys of either."""
    count = lambda d, name: d.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(before, "before").join(count(after, "after"), key, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("deleted", F.col("before") - F.col("after"))


def heading_depths(rows: DataFrame, path: str = "heading_path") -> DataFrame:
    """depth, n of heading paths; none is depth 0."""
    depth = F.when(blank(F.col(path)), 0).otherwise(F.size(F.split(path, " > ")))
    return rows.groupBy(depth.alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def page_count(rows: DataFrame, doc: str = "doc_id", page: str = "page_idx") -> DataFrame:
    """doc, pages: pages are numbered from 0; a document without any has 0."""
    return rows.groupBy(doc).agg(F.coalesce(F.max(page) + 1, F.lit(0)).alias("pages"))


def contact_blocks(rows: DataFrame, least: int = 2) -> DataFrame:
    return rows.withColumn("classes", contact_classes(F.col("text"))).where(F.col("classes") >= least)


def length_summary(rows: DataFrame, by: str, length: str) -> DataFrame:
    """by, n, least, median, mean, p90, most; percentiles are exact, whatever the size of a group."""
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("least"), F.round(F.avg(length), 6).alias("mean"), F.max(length).alias("most"))
    return beside(a, percentiles(rows, [by], length, {"median": 0.5, "p90": 0.9}), [by]).select(by, "n", "least", "median", "mean", "p90", "most")


def length_histogram(rows: DataFrame, length: str) -> DataFrame:
    """bucket, n with every bucket present: half-open, the last but one closed at LONG, then what is longer."""
    bucket = F.lit(len(BUCKETS))
    for i, (lo, hi) in reversed(list(enumerate(BUCKETS))):
        bucket = F.when((F.col(length) >= lo) & (F.col(length) < hi), i).otherwise(bucket)
    all_ = rows.sparkSession.range(len(BUCKETS) + 1).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c")), "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).cast("long").alias("n"))
