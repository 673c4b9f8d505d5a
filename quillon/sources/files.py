"""Readers and writers of the corpus files, with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "block_id string, doc_id string, page_idx int, type string, text string, table_html string, img_path string, heading_path string, char_len int"
CHUNK = "chunk_id string, doc_id string, chunk_type string, heading_path string, text string, table_html string, source_block_ids array<string>, char_len int, page_range array<int>"
ITEM = "type string, text string, text_level int, page_idx int, img_path string, table_body string, image_caption array<string>, code_body string"

_FIELDS = ", ".join(x.replace(" ", ":", 1) for x in ITEM.split(", "))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines go."""
    return spark.read.schema(schema).json(path)


def read_content(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, idx and the fields of each item of `*/auto/*_content_list.json`; the first file of a document counts, `_v2` files don't."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_content_list.json").option("recursiveFileLookup", True).text(folder)
    files = files.withColumn("path", F.col("_metadata.file_path")).where(F.col("path").rlike(r"/auto/[^/]*$") & ~F.contains("path", F.lit("_v2")))
    files = files.withColumn("doc_id", F.regexp_extract("path", r"([^/]+)/auto/[^/]*$", 1))
    first = files.groupBy("doc_id").agg(F.min("path").alias("path"))
    return files.join(first, ["doc_id", "path"]).select("doc_id", F.posexplode(F.from_json("value", f"array<struct<{_FIELDS}>>")).alias("idx", "item")).select("doc_id", "idx", "item.*")


def count_types(spark: SparkSession, path: str) -> DataFrame:
    """type, n, pages of one file of items: a list at the top, or lists of blocks below `pdf_info`, one for each page."""
    whole = spark.read.option("wholetext", True).text(path)
    flat = F.from_json("value", "array<struct<type:string,page_idx:int>>")
    paged = F.from_json("value", "struct<pdf_info:array<struct<page_idx:int,para_blocks:array<struct<type:string>>>>>")["pdf_info"]
    inner = F.flatten(F.transform(paged, lambda p: F.transform(p["para_blocks"], lambda b: F.struct(b["type"].alias("type"), p["page_idx"].alias("page_idx")))))
    items = whole.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), flat).otherwise(inner)).alias("i")).select("i.*")
    pages = items.agg(F.coalesce(F.max("page_idx") + 1, F.lit(0)).alias("pages"))
    return items.groupBy("type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(pages))  # one row


FACT = "struct<say:string,any:array<string>,numeric:boolean,src:string,calc:array<string>>"
ITEMS = f"""id string, type string, docs array<string>, expect string, question string, history array<struct<role:string,content:string>>, standalone string, reference string,
facts array<{FACT}>, evidence array<struct<doc:string,quotes:array<string>>>, absent array<string>, tools array<string>"""


def _listed(x: object) -> list[str]:
    return [] if x is None else [str(v) for v in x] if isinstance(x, list) else [str(x)]


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON or YAML file (YAML where its reader is installed): scalars where lists are due count as lists of one, what is missing has its default.

    An item set is written by hand, so that it is read on the driver.
    """
    given = read_config(path)
    rows = []
    for x in given["items"] if isinstance(given, dict) else given:
        facts = [{"say": f.get("say") or _listed(f.get("any"))[0], "any": _listed(f.get("any")), "numeric": bool(f.get("numeric", False)), "src": f.get("src"), "calc": _listed(f.get("calc"))} for f in x.get("facts") or []]
        proof = [{"doc": str(e["doc"]) if e.get("doc") is not None else None, "quotes": _listed(e.get("any_quote") or e.get("quote"))} for e in x.get("evidence") or []]
        rows.append((str(x["id"]), x["type"], _listed(x.get("doc")), x.get("expect", "answer"), x["question"], x.get("history") or [], x.get("standalone"), x.get("reference"), facts, proof, _listed(x.get("absent")), _listed(x.get("tools"))))
    return spark.createDataFrame(rows, ITEMS)


def read_config(path: str) -> dict | list:
    """A JSON file, or a YAML file where its reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: no reader for YAML is installed; give JSON") from e
    return yaml.safe_load(text)


def write_vectors(chunks: DataFrame, folder: str) -> None:
    """Chunks with their vectors, anew, a folder for each kind."""
    chunks.write.mode("overwrite").partitionBy("chunk_type").parquet(folder)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def write_csv(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One CSV file with a byte order mark, for spreadsheets, written row by row from the driver; more than `most` rows are an error. Lists and maps are JSON."""
    import csv

    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write the table with df.write.csv")
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in flat.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def write_metrics(metrics: DataFrame, path: str, meta: dict | None = None) -> dict:
    """{meta, metrics: {group: {metric: {k, n, rate}}}} as JSON; metrics has metric, k, n, rate and the columns of its groups, and is small."""
    groups = [c for c in metrics.columns if c not in ("metric", "k", "n", "rate", "low", "high")]
    out: dict = {}
    for r in metrics.orderBy(*groups, "metric").collect():  # a row for each metric and group
        out.setdefault("/".join(str(r[g]) for g in groups) or "all", {})[r["metric"]] = {"k": r["k"], "n": r["n"], "rate": r["rate"]}
    found = {"meta": meta or {}, "metrics": out}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=2)
    return found


def write_report(title: str, parts: list[tuple[str, DataFrame]], path: str, most: int = 200) -> str:
    """A Markdown report: each part a table of its first `most` rows, with how many there are in all."""
    lines = [f"# {title}", ""]
    for name, df in parts:
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        rows = df.limit(most + 1).collect()
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            lines.append(f"| … {df.count() - most} more |" + " |" * (len(df.columns) - 1))
        lines.append("")
    text = "\n".join(lines)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, not dropped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_labels(spark: SparkSession, path: str, label: str) -> DataFrame:
    """CSV with a header (a byte order mark is skipped); only labelled rows."""
    d = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    return d.where(F.coalesce(F.trim(F.col(label)), F.lit("")) != "")
