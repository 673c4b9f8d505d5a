"""The tools of an answering agent over batches of calls: every call has a result row, errors are data.

A result is (call_id, ok, error, ...). Chunks have chunk_id, doc_id, heading_path, text and a position; the
evidence pool is a table (session, chunk_id, shown, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import SPACE
from quillon.operators import grounding, units
from quillon.operators.patterns import matches

#: How much of a chunk was shown, rising.
SHOWN = {"rows": 1, "head": 2, "full": 3}
#: Arguments of each tool: name, type, whether it may be left out.
ARGUMENTS = {
    "search_manuals": (("query", "string", False), ("manual", "string", True), ("kind", "string", True)),
    "lookup_table": (("keywords", "string", False), ("manual", "string", True)),
    "read_section": (("chunk_id", "string", False), ("before", "integer", True), ("after", "integer", True)),
    "convert_unit": (("value", "number", False), ("from_unit", "string", False), ("to_unit", "string", False), ("is_difference", "boolean", True)),
    "check_value": (("value", "number", False), ("unit", "string", False), ("source_chunk_id", "string", False), ("limit_max", "number", True), ("limit_min", "number", True), ("limit_unit", "string", True)),
}
NEAR = 2  # sections that may be read on either side
_READ = {"string": r"^\".*\"$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "integer": r"^-?[0-9]+$", "boolean": r"^(true|false)$"}


def specification(manuals: list[str]) -> list[dict]:
    """The tools as JSON schemas; a manual is one of those given."""
    out = []
    for name, given in ARGUMENTS.items():
        properties = {a: {"type": kind} | ({"enum": list(manuals)} if a == "manual" else {}) | ({"enum": ["text", "table"]} if a == "kind" else {}) | ({"minimum": 0, "maximum": NEAR} if a in ("before", "after") else {}) for a, kind, _ in given}
        out.append({"name": name, "parameters": {"type": "object", "properties": properties, "required": [a for a, _, left_out in given if not left_out], "additionalProperties": False}})
    return out


def checked_calls(calls: DataFrame, name: str = "name", args: str = "args") -> DataFrame:
    """calls with ok and error (unknown_tool, bad_json, missing:x, unknown:x, type:x): the first that applies; args is a JSON object or null."""
    raw = F.from_json(F.coalesce(F.col(args), F.lit("{}")), "map<string,string>")
    shape = F.when(F.trim(F.coalesce(F.col(args), F.lit("{}"))).rlike(r"(?s)^\{.*\}$"), raw)
    error = F.when(~F.col(name).isin(*ARGUMENTS), "unknown_tool").when(F.col("_m").isNull(), "bad_json")
    for tool, given in ARGUMENTS.items():
        here = F.col(name) == tool
        for a, _, left_out in given:
            if not left_out:
                error = error.when(here & F.try_element_at("_m", F.lit(a)).isNull(), f"missing:{a}")
        others = F.array_except(F.map_keys("_m"), F.array(*[F.lit(a) for a, _, _ in given]))
        error = error.when(here & (F.size(others) > 0), F.concat(F.lit("unknown:"), others[0]))
        for a, kind, _ in given:
            if kind != "string":
                error = error.when(here & ~F.try_element_at("_m", F.lit(a)).rlike(_READ[kind]), f"type:{a}")
    return calls.withColumn("_m", shape).withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("_m")


def aliases(manuals: DataFrame) -> DataFrame:
    """name, doc_id of manuals (doc_id, short, title, aliases array): without white space, lower case."""
    names = F.explode(F.concat(F.array("doc_id", "short", "title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return manuals.select(names.alias("n"), "doc_id").where(F.coalesce("n", F.lit("")) != "").select(_alias(F.col("n")).alias("name"), "doc_id").distinct()


def _alias(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, SPACE, ""))


def resolved(asked: DataFrame, names: DataFrame, column: str = "manual") -> DataFrame:
    """asked (call_id, manual) with doc_id and error: an exact alias, else the one document with an alias that holds the name or is held by it.

    A blank name is no filter: no document and no error. Names asked for go through the catalogue's, and these through them, as patterns.
    """
    q = asked.withColumn("_key", _alias(F.coalesce(F.col(column), F.lit(""))))
    keys, known = q.select("_key").distinct(), names.select("name").distinct()
    held = matches(keys, "_key", "_key", known, "name").unionByName(matches(known, "name", "name", keys, "_key")).distinct()
    near = q.where(F.col("_key") != "").join(held, "_key").join(names, "name")
    found = near.groupBy("call_id").agg(F.max(F.when(F.col("name") == F.col("_key"), F.col("doc_id"))).alias("_exact"), F.countDistinct("doc_id").alias("_n"), F.min("doc_id").alias("_one"))
    out = q.join(found, "call_id", "left")
    doc = F.coalesce(F.col("_exact"), F.when(F.col("_n") == 1, F.col("_one")))
    return out.withColumn("doc_id", doc).withColumn("error", F.when((F.col("_key") != "") & doc.isNull(), "unknown_manual")).drop("_key", "_exact", "_n", "_one")


def pooled(shown: DataFrame) -> DataFrame:
    """The evidence pool of events (session, seq, chunk_id, shown): each chunk once, where it first came, with the most that was shown of it."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), F.col("shown"))
    best = F.max_by("shown", rank)
    return shown.groupBy("session", "chunk_id").agg(best.alias("shown"), F.min("seq").alias("seq"))


def read_section(calls: DataFrame, chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """call_id, ok, error, ids: the chunks around one, `before` and `after` clipped to the document; calls has call_id, session, chunk_id, before, after.

    The chunk must exist and have been shown in the session.
    """
    place = chunks.select("chunk_id", "doc_id", "position")
    seen = pool.select("session", "chunk_id").distinct().withColumn("_seen", F.lit(True))
    side = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(0)), F.lit(NEAR))
    q = calls.join(place.withColumnRenamed("doc_id", "_doc").withColumnRenamed("position", "_at"), "chunk_id", "left").join(seen, ["session", "chunk_id"], "left")
    error = F.when(F.col("_at").isNull(), "unknown_chunk").when(F.col("_seen").isNull(), "not_in_evidence")
    q = q.withColumn("error", error).withColumn("_to", F.explode_outer(F.when(error.isNull(), F.sequence(F.col("_at") - side("before"), F.col("_at") + side("after")))))
    near = place.select(F.col("doc_id").alias("_doc"), F.col("position").alias("_to"), F.col("chunk_id").alias("_id"))
    met = q.join(near, ["_doc", "_to"], "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_to", "_id")))), lambda x: x["_id"])
    return met.groupBy("call_id").agg(F.first("error").alias("error"), ids.alias("ids")).select("call_id", F.col("error").isNull().alias("ok"), "error", "ids")


def _grounded(value: Column, unit: Column, sources: Column) -> Column:
    """ok, unit_mismatch or no_source of a value with its unit; a unit that isn't known counts as ok."""
    identity = grounding.identity_of(unit)
    q = F.struct(units.shown(value).alias("num"), value.alias("value"), unit.alias("unit"), identity.alias("id"))
    return F.when(identity.isNull(), "ok").otherwise(grounding.ground(q, sources))


def _read(sources: Column) -> Column:
    return F.transform(F.coalesce(sources, F.array().cast("array<struct<kind:string,text:string>>")), lambda s: grounding.source(s["kind"], s["text"]))


def convert_unit(calls: DataFrame) -> DataFrame:
    """call_id, ok, error, result, display of calls (call_id, value, from_unit, to_unit, is_difference, question, sources).

    sources (array<struct<kind, text>>) is the evidence so far; the value must stand there in its unit, and be found at all where a question is known.
    """
    done = units.convert(calls, "value", "from_unit", "to_unit", F.coalesce("is_difference", F.lit(False)))
    state = _grounded(F.col("value"), F.col("from_unit"), _read(F.col("sources")))
    wrong = F.when(state == "unit_mismatch", "unit_mismatch").when((state == "no_source") & F.col("question").isNotNull(), "no_source")
    error = F.coalesce(F.col("error"), wrong)
    told = F.concat_ws(" ", units.shown(F.col("value")), "from_unit", F.lit("="), units.shown(F.col("converted")), "to_unit")
    return done.withColumn("error", error).select("call_id", F.col("error").isNull().alias("ok"), "error", F.when(F.col("error").isNull(), F.col("converted")).alias("result"), F.when(F.col("error").isNull(), told).alias("display"))


def check_value(calls: DataFrame, chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """call_id, ok, error, verdict, margin, margin_pct of calls (call_id, session, value, unit, source_chunk_id, limit_min, limit_max, limit_unit, question, sources).

    Errors in this order: the chunk exists; it was shown; every limit is among its numbers; the comparison is possible (limits
    given, rising, units alike); the limits have their unit there; the value is grounded in the sources (and found, where a question is known).
    """
    text = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("text").alias("_text"))
    seen = pool.select("session", F.col("chunk_id").alias("source_chunk_id")).distinct().withColumn("_seen", F.lit(True))
    q = calls.join(text, "source_chunk_id", "left").join(seen, ["session", "source_chunk_id"], "left").withColumn("_unit", F.coalesce("limit_unit", "unit"))
    q = units.convert(q, "value", "unit", "_unit").withColumnRenamed("error", "_convert")
    numbers = grounding.lenient_numbers(F.col("_text"))
    low, high = F.col("limit_min"), F.col("limit_max")
    absent = lambda x: x.isNotNull() & ~F.array_contains(numbers, F.round(x, 6))
    verdict, margin = units.check_limits(F.col("converted"), low, high)
    here = F.array(grounding.source(F.lit("doc"), F.col("_text")))
    misread = lambda x: x.isNotNull() & (_grounded(x, F.col("_unit"), here) == "unit_mismatch")
    state = _grounded(F.col("value"), F.col("unit"), _read(F.col("sources")))
    error = (
        F.when(F.col("_text").isNull(), "unknown_chunk").when(F.col("_seen").isNull(), "not_in_evidence").when(absent(low) | absent(high), "limit_not_in_chunk")
        .when(F.col("_convert").isNotNull(), F.col("_convert")).when(verdict == "error", "bad_limits").when(misread(low) | misread(high), "limit_unit_mismatch")
        .when(state == "unit_mismatch", "unit_mismatch").when((state == "no_source") & F.col("question").isNotNull(), "no_source")
    )
    limit = F.when(verdict == "above_max", high).when(verdict == "below_min", low)
    share = F.when(limit != 0, F.round(100 * margin / F.abs(limit), 6))
    out = q.withColumn("error", error).withColumn("ok", F.col("error").isNull())
    only = lambda c: F.when(F.col("ok"), c)
    return out.select("call_id", "ok", "error", only(verdict).alias("verdict"), only(margin).alias("margin"), only(share).alias("margin_pct"))


def source_lists(events: DataFrame) -> DataFrame:
    """request_id, seq, sources: at each retrieval the list of all chunks so far, in first-seen order, which replaces the one before."""
    once = Window.partitionBy("request_id", "chunk_id").orderBy("seq")
    new = F.when(F.row_number().over(once) == 1, F.struct("seq", "chunk_id"))
    so_far = Window.partitionBy("request_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("_new", new).withColumn("_held", F.collect_list("_new").over(so_far))
    first = F.row_number().over(Window.partitionBy("request_id", "seq").orderBy("chunk_id"))
    return held.withColumn("_nth", first).where("_nth = 1").select("request_id", "seq", F.transform(F.array_sort("_held"), lambda x: x["chunk_id"]).alias("sources"))


def context_text(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """q_id, context: `[id]` and text of each hit in the order of rank, with an empty line between."""
    rows = ranked.join(texts.select("key", "text"), "key")
    parts = F.array_sort(F.collect_list(F.struct("rank", "key", F.concat(F.lit("["), F.col("key").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))))
    return rows.groupBy("q_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def catalogue_text(manuals: DataFrame) -> DataFrame:
    """One row: `- id：title` of each manual, by id."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("doc_id"), F.lit("："), F.coalesce("title", "doc_id"))))
    return manuals.agg(F.array_join(lines, "\n").alias("catalogue"))


def display_names(rows: DataFrame, manuals: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with display (short name, else title, else id) and is_sample."""
    m = manuals.select("doc_id", F.coalesce("short", "title").alias("_name"))
    out = rows.join(m, "doc_id", "left").withColumn("display", F.coalesce("_name", "doc_id")).drop("_name")
    return out.withColumn("is_sample", F.startswith("doc_id", F.lit("sample_")))


def history_query(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, question, search: the last user text, and for searching that of the user before it in front."""
    users = turns.where(F.col(role) == "user")
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    kept = users.select(conv, text, F.lead(text).over(w).alias("_before"), F.row_number().over(w).alias("_n")).where(F.col("_n") == 1)
    return kept.select(conv, F.col(text).alias("question"), F.concat_ws(" ", "_before", text).alias("search"))


RESULT = "call_id string, ok boolean, error string, content string"


def dispatched(calls: DataFrame, handlers: dict) -> DataFrame:
    """call_id, ok, error, content of calls (call_id, name, args): what doesn't fit a tool's arguments is an error at once, the rest goes to the tool's handler.

    A handler takes the calls of its tool, args as a map, and returns rows of that form. A handler that can't be planned makes its
    calls errors, and calls that a handler gives no row for are `no_result`; nothing is raised.
    """
    seen = checked_calls(calls).withColumn("call_id", F.col("call_id").cast("string"))
    none = F.lit(None).cast("string")
    out = seen.where(~F.col("ok")).select("call_id", "ok", "error", none.alias("content"))
    for name in ARGUMENTS:
        own = seen.where(F.col("ok") & (F.col("name") == name))
        failed = "no_handler"
        if name in handlers:
            try:
                given = handlers[name](own.select("call_id", F.from_json(F.coalesce("args", F.lit("{}")), "map<string,string>").alias("args")))
                given = given.select(F.col("call_id").cast("string").alias("call_id"), "ok", "error", F.col("content").cast("string").alias("content"))
                lost = own.join(given.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(False).alias("ok"), F.lit("no_result").alias("error"), none.alias("content"))
                out = out.unionByName(given).unionByName(lost)
                continue
            except Exception as e:  # noqa: BLE001 - an error is data here
                failed = type(e).__name__
        out = out.unionByName(own.select("call_id", F.lit(False).alias("ok"), F.lit(failed).alias("error"), none.alias("content")))
    return out
