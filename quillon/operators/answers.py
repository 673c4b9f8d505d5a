"""Scoring of answers without a model, and the metrics of a set of scored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.evaluate import wilson
from quillon.operators.patterns import matches
from quillon.operators.quantiles import beside, percentiles

SAMPLE = "sample_"
#: Order of the item types in tables: those to be answered, then those to be refused.
ANSWER_TYPES = ("fact", "procedure", "table", "cross_chunk", "colloquial", "multi_turn", "convert", "check", "table_lookup", "multi_step")
REFUSE_TYPES = ("oos_adjacent", "oos_in_domain", "oos_unrelated")
COMPUTING = ("convert_unit", "check_value")


def behaviour(status: Column, answer: Column) -> Column:
    """rejected_gate, error, refused_model or answered: the status first, then an empty answer or a refusal."""
    none = F.coalesce(answer, F.lit("")) == ""
    return F.when(status.isin("rejected_gate", "error"), status).when(none | T.is_refusal(answer), "refused_model").otherwise("answered")


def steps_summary(steps: Column, expected: Column) -> Column:
    """struct<tool_calls, tools_used, tool_errors, computed, tools_expected_ok> of array<struct<name, args, ok, auto, output>>; automatic calls count only as errors."""
    own = F.filter(F.coalesce(steps, F.array().cast("array<struct<name:string,args:string,ok:boolean,auto:boolean,output:string>>")), lambda s: F.lit(True))
    chosen = F.filter(own, lambda s: ~F.coalesce(s["auto"], F.lit(False)))
    done = F.filter(own, lambda s: F.coalesce(s["ok"], F.lit(False)) & s["name"].isin(*COMPUTING) & (F.coalesce(s["output"], F.lit("")) != ""))
    arg = lambda s, name: F.get_json_object(s["args"], f"$.{name}")
    given = lambda s: F.when(s["name"] == COMPUTING[0], F.array(arg(s, "value"))).otherwise(F.array(arg(s, "limit_min"), arg(s, "limit_max")))
    computed = F.transform(done, lambda s: F.struct(s["output"].alias("text"), F.when(s["name"] == COMPUTING[1], arg(s, "source_chunk_id")).alias("source"), F.transform(F.array_compact(given(s)), lambda x: x.cast("double")).alias("inputs")))
    used = F.array_distinct(F.transform(own, lambda s: s["name"]))
    return F.struct(
        F.size(chosen).alias("tool_calls"), F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["name"]))).alias("tools_used"),
        F.size(F.filter(own, lambda s: ~F.coalesce(s["ok"], F.lit(False)))).alias("tool_errors"), computed.alias("computed"),
        (F.size(F.array_except(F.coalesce(expected, F.array().cast("array<string>")), used)) == 0).alias("tools_expected_ok"),
    )


def scored(records: DataFrame) -> DataFrame:
    """records with their scores: behavior, refused, cited, sentence counts, evidence hits, facts, ...

    records has id, status, answer, retrieved (array<string>), expect (answer or refuse), docs (array<string>), groups
    (array<array<string>>: the chunks that can bear each piece of evidence), facts (array<struct<patterns, numeric>>, expanded),
    and chunk_docs (map<chunk, doc> of what is retrieved or cited). Scores of answers that are only due when an
    answer is expected are null elsewhere. A refused item has no facts matched.
    """
    beh = behaviour(F.col("status"), F.col("answer"))
    d = records.withColumn("behavior", beh).withColumn("refused", F.col("behavior").isin("rejected_gate", "refused_model"))
    d = d.withColumn("given", F.when(F.col("behavior") == "answered", F.col("answer")).otherwise(""))
    d = d.withColumn("cited", T.citations(F.col("given"))).withColumn("sentences", T.substantive_sentences(F.col("given")))
    gold = F.array_distinct(F.flatten("groups"))
    hits = F.transform("groups", lambda g: F.arrays_overlap(g, F.col("retrieved")))
    hit = lambda h: F.coalesce(h, F.lit(False))
    docs = F.array_sort(F.array_distinct(F.array_compact(F.transform("cited", lambda c: F.try_element_at("chunk_docs", c)))))
    norm = T.match_text(T.without_citations(F.col("given")))
    d = d.withColumn("norm", norm).withColumn("cited_docs", docs).withColumn("hits", F.transform(hits, hit))
    met = F.transform("facts", lambda f: F.struct(f["numeric"].alias("numeric"), ((F.col("given") != "") & F.exists(f["patterns"], lambda p: F.rlike(F.col("norm"), p))).alias("matched")))
    d = d.withColumn("met", met)
    due = lambda c: F.when(F.col("expect") == "answer", c)
    count = lambda f: F.size(F.filter("met", f))
    out = {
        "n_sentences": F.size("sentences"), "n_uncited": F.size(F.filter("sentences", lambda s: F.size(s["cited"]) == 0)),
        "n_fabricated": F.size(F.array_except("cited", "retrieved")), "n_cited_sample": F.size(F.filter("cited", lambda c: F.startswith(c, F.lit(SAMPLE)))),
        "evidence_groups": due(F.size("groups")), "evidence_hit": due(F.size(F.filter("hits", lambda h: h))), "evidence_all": due((F.size("groups") > 0) & F.forall("hits", lambda h: h)),
        "n_cited_gold": due(F.size(F.array_intersect("cited", gold))), "wrong_manual": due((F.size("cited") > 0) & ~F.coalesce(F.arrays_overlap("cited_docs", "docs"), F.lit(False))),
        "n_facts": due(F.size("met")), "n_facts_matched": due(count(lambda f: f["matched"])), "n_numeric": due(count(lambda f: f["numeric"])),
        "n_numeric_matched": due(count(lambda f: f["numeric"] & f["matched"])), "all_facts": due(F.forall("met", lambda f: f["matched"])),
    }
    return d.withColumns(out).drop("norm", "given", "hits", "met", "sentences")


def expected_cost(behavior: Column, inputs: Column, outputs: Column, price_in: float, price_out: float) -> Column:
    """At most: all input at the full price; nothing for what the gate rejected; null where tokens aren't known."""
    full = (inputs * F.lit(price_in) + F.coalesce(outputs, F.lit(0)) * F.lit(price_out)) / F.lit(1e6)
    return F.when(behavior == "rejected_gate", 0.0).otherwise(F.round(full, 9))


def evidence(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, n, ids: for each piece of evidence of an item (id, n, doc, quotes) the chunks (chunk_id, doc_id, text) of its document (null: of any) that hold any of the quotes, both normalised.

    All quotes go through the texts together; only hits are joined by document.
    """
    q = items.select("id", "n", F.col("doc").alias("_doc"), F.explode("quotes").alias("quote")).withColumn("quote", T.match_text(F.col("quote")))
    held = matches(chunks.select(F.struct("doc_id", "chunk_id").alias("c"), T.match_text(F.col("text")).alias("_t")), "c", "_t", q, "quote")
    found = held.join(q, "quote").where(F.col("_doc").isNull() | (F.col("_doc") == F.col("c.doc_id")))
    ids = found.groupBy("id", "n").agg(F.array_sort(F.collect_set("c.chunk_id")).alias("ids"))
    return items.select("id", "n").join(ids, ["id", "n"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def shared_evidence(groups: DataFrame) -> DataFrame:
    """id, shared: the chunks that alone bear all of an item's several pieces of evidence (id, n, ids)."""
    all_ = groups.groupBy("id").agg(F.collect_list("ids").alias("g")).where(F.size("g") > 1)
    both = F.aggregate(F.slice("g", 2, F.size("g")), F.col("g")[0], lambda t, x: F.array_intersect(t, x))
    return all_.select("id", both.alias("shared")).where(F.size("shared") > 0)


def absent_found(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, term, chunk_id: terms that an item declares absent and that a chunk holds all the same.

    Terms with a document (`absent_in`, where terms has it; null: any) are absent from its chunks alone, for which chunks has doc_id.
    """
    within = "absent_in" in terms.columns
    t = terms.select("id", "term", *(["absent_in"] if within else []), T.match_text(F.col("term")).alias("_q"))
    c = F.struct("chunk_id", "doc_id") if within else F.struct("chunk_id")
    found = matches(chunks.select(c.alias("c"), T.match_text(F.col("text")).alias("_t")), "c", "_t", t, "_q").join(t, "_q")
    if within:
        found = found.where(F.col("absent_in").isNull() | (F.col("absent_in") == F.col("c.doc_id")))
    return found.select("id", "term", F.col("c.chunk_id").alias("chunk_id"))


def judged(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """sentences (id, n, support, quote, by, cited) with quote_ok and cited_ok: the quote stands, loosely compared, in one of the chunks named (else in any of `sources`); a
    cited chunk is among those named. cited_ok is null without citations or where support is na; support none is never ok.
    """
    where = F.when(F.size("by") > 0, F.col("by")).otherwise(F.col("sources"))
    q = sentences.withColumn("_q", T.loose(F.col("quote"))).withColumn("_at", F.explode_outer(where))
    met = q.join(chunks.select(F.col("chunk_id").alias("_at"), T.loose(F.col("text")).alias("_t")), "_at", "left")
    ok = (F.col("_q") != "") & F.contains(F.col("_t"), F.col("_q"))
    found = met.groupBy("id", "n").agg(F.max(F.coalesce(ok, F.lit(False))).alias("quote_ok"))
    due = (F.size("cited") > 0) & (F.col("support") != "na")
    return sentences.join(found, ["id", "n"]).withColumn("cited_ok", F.when(due, (F.col("support") != "none") & F.arrays_overlap("cited", "by")))


def ratio(name: str, k: Column, n: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), F.coalesce(k.cast("long"), F.lit(0)).alias("k"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"))


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, k, n, rate, low, high of scored rows, in one aggregation. Rows in error are in no denominator.

    rate is null where n is 0; low and high are the 95 % interval.
    """
    ok = F.col("behavior") != "error"
    due, not_due, answered = ok & (F.col("expect") == "answer"), ok & (F.col("expect") == "refuse"), ok & (F.col("behavior") == "answered")
    told = due & answered
    count = lambda c: F.count(F.when(c, 1))
    total = lambda c, where: F.sum(F.when(where, F.col(c)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = [
        ratio("errors", count(~ok), F.count(F.lit(1))), ratio("evidence_all", count(due & yes("evidence_all")), count(due)), ratio("false_refusal", count(due & F.col("refused")), count(due)),
        ratio("false_refusal_gate", count(due & (F.col("behavior") == "rejected_gate")), count(due)), ratio("false_refusal_model", count(due & (F.col("behavior") == "refused_model")), count(due)),
        ratio("fact_recall", total("n_facts_matched", due), total("n_facts", due)), ratio("fact_recall_answered", total("n_facts_matched", told), total("n_facts", told)),
        ratio("strict_correct", count(due & yes("all_facts")), count(due)), ratio("numeric", total("n_numeric_matched", due), total("n_numeric", due)),
        ratio("numeric_items", count(due & (F.col("n_numeric") > 0) & (F.col("n_numeric") == F.col("n_numeric_matched"))), count(due & (F.col("n_numeric") > 0))),
        ratio("cited_gold", count(told & (F.col("n_cited_gold") > 0)), count(told)), ratio("wrong_manual", count(told & yes("wrong_manual")), count(told)),
        ratio("strict_grounded", count(due & yes("all_facts") & (F.col("n_cited_gold") > 0)), count(due)), ratio("refusal_recall", count(not_due & F.col("refused")), count(not_due)),
        ratio("refusal_precision", count(not_due & F.col("refused")), count(ok & F.col("refused"))), ratio("uncited", total("n_uncited", answered), total("n_sentences", answered)),
        ratio("fabricated", total("n_fabricated", answered), count(answered)), ratio("cites_sample", count(answered & (F.col("n_cited_sample") > 0)), count(answered)),
    ]
    agg = rows.groupBy(*by).agg(F.array(*pairs).alias("all")) if by else rows.agg(F.array(*pairs).alias("all"))
    m = agg.select(*by, F.inline("all"))
    low, high = wilson(F.col("k"), F.col("n"))
    return m.withColumn("rate", F.round(F.try_divide("k", "n"), 6)).withColumn("low", low).withColumn("high", high)


#: What judged_metrics and measures read beside the columns of metrics.
JUDGED = """judge struct<failed:boolean, declined:boolean, sentences:array<struct<support:string, quote_ok:boolean, cited_ok:boolean>>>, fact_judge struct<failed:boolean, verdicts:array<string>>, matched array<boolean>,
n_numbers long, n_untraced long, overlaps array<double>, finish_reason string, t_total_ms double, t_first_token_ms double, input_tokens long, output_tokens long, cache_read_tokens long, cost_upper double, cost_yuan double,
mode string, llm_calls long, tool_calls long, tool_errors long, forced_final boolean, tools_expected array<string>, tools_expected_ok boolean, numbers_checked long, number_issues long, repair string, repair_fixed boolean"""


def judged_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, k, n, rate of scored rows with a judge's verdicts, calls and tools (JUDGED), in one aggregation; n is null where the metric is a plain count.

    Rows in error are in none. A sentence that can be checked has support full, partial or none; it is strictly faithful if its quote stands
    as well. Verdicts of a failed judgment don't count. Facts are compared, one by one, with the verdicts on them, as far as both go. What
    concerns the agent is of rows of its mode with counted calls.
    """
    ok = F.col("behavior") != "error"
    due, not_due, answered = ok & (F.col("expect") == "answer"), ok & (F.col("expect") == "refuse"), ok & (F.col("behavior") == "answered")
    yes = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.count_if(yes(c))
    total = lambda c, where: F.sum(F.when(where, c))
    failed, declined = yes(F.col("judge.failed")), yes(F.col("judge.declined"))
    judged = answered & F.col("judge").isNotNull()
    said = lambda test: F.size(F.filter("judge.sentences", test))
    sentences = lambda test: total(said(test), judged & ~failed)
    can = sentences(lambda s: s["support"].isin("full", "partial", "none"))
    facts = due & (F.col("behavior") == "answered") & F.col("fact_judge").isNotNull()
    fact_failed = yes(F.col("fact_judge.failed"))
    pairs = F.slice(F.arrays_zip(F.col("matched").alias("m"), F.col("fact_judge.verdicts").alias("v")), F.lit(1), F.least(F.size("matched"), F.size("fact_judge.verdicts")))
    fact = lambda test: total(F.size(F.filter(pairs, test)), facts & ~fact_failed)
    present = lambda x: yes(x["v"] == "present")
    agent = ok & (F.col("mode") == "agent") & F.col("llm_calls").isNotNull()
    checked, expected = agent & F.col("numbers_checked").isNotNull(), agent & (F.col("expect") == "answer") & (F.coalesce(F.size("tools_expected"), F.lit(0)) > 0)
    repaired = yes(F.coalesce(F.col("repair"), F.lit("")) != "")
    none = F.lit(None).cast("long")
    pairs_ = [
        ("answered_but_declined", count(due & answered & declined), none), ("refusal_gate", count(not_due & (F.col("behavior") == "rejected_gate")), none), ("refusal_model", count(not_due & (F.col("behavior") == "refused_model")), none),
        ("refusal_declined_by_judge", count(not_due & answered & declined), none), ("numbers_traced", total(F.col("n_numbers") - F.col("n_untraced"), answered), total(F.col("n_numbers"), answered)),
        ("overlap_low", total(F.size(F.filter("overlaps", lambda x: x < 0.5)), answered), total(F.size(F.filter("overlaps", lambda x: x.isNotNull())), answered)), ("truncated", count(answered & (F.col("finish_reason") == "length")), none),
        ("judge_failed", count(judged & failed), count(judged)), ("faithful_strict", sentences(lambda s: (s["support"] == "full") & s["quote_ok"]), can), ("faithful_full", sentences(lambda s: s["support"] == "full"), can),
        ("partial", sentences(lambda s: s["support"] == "partial"), can), ("unsupported", sentences(lambda s: s["support"] == "none"), can), ("citation_ok", sentences(lambda s: s["cited_ok"]), sentences(lambda s: s["cited_ok"].isNotNull())),
        ("fact_agree", fact(lambda x: x["m"] == present(x)), fact(lambda x: F.lit(True))), ("fact_only_regex", fact(lambda x: x["m"] & ~present(x)), none), ("fact_only_judge", fact(lambda x: ~x["m"] & present(x)), none),
        ("fact_contradicted", fact(lambda x: x["v"] == "contradicted"), none), ("fact_judge_failed", count(facts & fact_failed), none), ("fact_recall_judge", fact(present), fact(lambda x: F.lit(True))),
        ("presearch_only", count(agent & (F.col("llm_calls") == 1)), count(agent)), ("tool_errors", total(F.col("tool_errors"), agent), none), ("tool_errors_items", count(agent & (F.col("tool_errors") > 0)), count(agent)),
        ("forced_final", count(agent & F.col("forced_final")), count(agent)), ("tools_expected_ok", count(expected & F.col("tools_expected_ok")), count(expected)),
        ("cache_read_share", total(F.coalesce("cache_read_tokens", F.lit(0)), agent), total(F.coalesce("input_tokens", F.lit(0)), agent)), ("numbers_checked", total(F.col("numbers_checked"), checked), none),
        ("repairs", count(checked & repaired), count(checked)), ("repairs_fixed", count(checked & F.col("repair_fixed")), none), ("repairs_kept_draft", count(checked & (F.col("repair") == "draft")), none),
        ("issue_answers", count(checked & (F.col("number_issues") > 0)), count(checked)),
    ]
    plain = {name for name, _, n in pairs_ if n is none}
    made = [F.struct(F.lit(name).alias("metric"), F.coalesce(k.cast("long"), F.lit(0)).alias("k"), (none if name in plain else F.coalesce(n.cast("long"), F.lit(0))).alias("n")) for name, k, n in pairs_]
    agg = rows.groupBy(*by).agg(F.array(*made).alias("all")) if by else rows.agg(F.array(*made).alias("all"))
    return agg.select(*by, F.inline("all")).withColumn("rate", F.round(F.try_divide("k", "n"), 6))


def measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, value: means and sums of tokens, cost and calls, and exact percentiles of times and overlaps; null where there is nothing. Rows in error are in none."""
    ok = F.col("behavior") != "error"
    answered, agent = ok & (F.col("behavior") == "answered"), ok & (F.col("mode") == "agent") & F.col("llm_calls").isNotNull()
    mean = lambda c, where: F.round(F.avg(F.when(where, F.col(c))), 6)
    total = lambda c: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0)).cast("double")
    named = {
        "input_mean": mean("input_tokens", answered), "output_mean": mean("output_tokens", answered), "input_sum": total("input_tokens"), "output_sum": total("output_tokens"),
        "cost_upper_mean": mean("cost_upper", ok), "cost_mean": mean("cost_yuan", ok), "llm_calls_mean": mean("llm_calls", agent), "tool_calls_mean": mean("tool_calls", agent),
    }
    a = rows.groupBy(*by).agg(*[v.alias(k) for k, v in named.items()]) if by else rows.agg(*[v.alias(k) for k, v in named.items()])
    told = rows.where(answered).select(*by, F.explode("overlaps").alias("overlap"))
    parts = [
        percentiles(rows, by, "t_total_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, answered), percentiles(rows, by, "t_first_token_ms", {"first_token_p50_ms": 0.5}, answered),
        percentiles(rows, by, "t_total_ms", {"reject_p50_ms": 0.5}, F.col("behavior") == "rejected_gate"), percentiles(told, by, "overlap", {"overlap_median": 0.5, "overlap_p10": 0.1}),
    ]
    for p in parts:
        a = beside(a, p, by)
    values = [c for c in a.columns if c not in by]
    return a.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])))


def by_type(rows: DataFrame, order: tuple[str, ...] = ANSWER_TYPES + REFUSE_TYPES) -> DataFrame:
    """place, type, split and the main ratios, in the fixed order of types; types without items are left out."""
    place = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(order)], "place int, type string")
    m = metrics(rows, ["type", "split"]).where(F.col("metric").isin("evidence_all", "false_refusal", "fact_recall", "strict_correct", "numeric", "refusal_recall"))
    return m.join(F.broadcast(place), "type").select("place", "type", "split", "metric", "k", "n", "rate")


def micro_ratio(rows: DataFrame, k: str, n: str, by: list[str], leave_out: tuple[str, ...] = ("error", "rejected_gate")) -> DataFrame:
    """by, k, n, rate: sums over sums, without rows of the statuses that are left out; null where there is nothing."""
    kept = ~F.col("status").isin(*leave_out)
    s = rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(kept, F.col(k))), F.lit(0)).cast("long").alias("k"), F.coalesce(F.sum(F.when(kept, F.col(n))), F.lit(0)).cast("long").alias("n"))
    return s.withColumn("rate", F.round(F.try_divide("k", "n"), 6))


def separation(rows: DataFrame, tau: float, by: list[str], distance: str = "distance") -> DataFrame:
    """by, n, least, median, most, within: distances by expectation, and how many are at most tau."""
    held = rows.where(F.col(distance).isNotNull())
    a = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(distance).alias("least"), F.max(distance).alias("most"), F.count_if(F.col(distance) <= tau).alias("within"))
    return beside(a, percentiles(held, by, distance, {"median": 0.5}), by).select(*by, "n", "least", "median", "most", "within")


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, counts: a map from each value to its number of rows; lists count for each of their values."""
    one = F.explode(value) if dict(rows.dtypes)[value].startswith("array") else F.col(value)
    c = rows.select(*by, one.cast("string").alias("_v")).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias("counts"))


def numbers_traced(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, n, untraced (numbers as written): numbers of an answer that are neither in the question, nor a retrieved chunk, nor a tool's output.

    answers has id, question, answer, retrieved and outputs (array<string>); decimals may be roundings of outputs' numbers.
    """
    from quillon.operators import grounding

    held = chunks.select("chunk_id", grounding.lenient_numbers(F.col("text")).alias("_n"))
    at = answers.select("id", F.explode("retrieved").alias("chunk_id")).join(held, "chunk_id").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("_n"))).alias("_pool"))
    none = F.array().cast("array<double>")
    computed = grounding.lenient_numbers(F.array_join(F.coalesce("outputs", F.array().cast("array<string>")), "\n"))
    q = answers.join(at, "id", "left").withColumn("_c", computed)
    exact = F.array_union(F.array_union(F.coalesce("_pool", none), grounding.lenient_numbers(F.col("question"))), F.col("_c"))
    free = F.filter(grounding.answer_numbers(F.col("answer")), lambda n: ~F.array_contains(exact, F.round(n.cast("double"), 6)))
    left = F.filter(free, lambda n: ~(F.contains(n, F.lit(".")) & F.exists("_c", lambda p: grounding.rounds_to(n, n.cast("double"), p))))
    return q.select("id", F.size(grounding.answer_numbers(F.col("answer"))).alias("n"), left.alias("untraced"))


def derived_wrong(facts: DataFrame) -> DataFrame:
    """facts (id, numbers, calc) with wrong: numbers that are no correct rounding of any sum's value; null where a sum can't be computed or no number is declared."""
    from quillon.operators import grounding

    one = facts.select("id", "numbers", F.posexplode_outer("calc").alias("_i", "_e")).withColumn("_v", grounding.calculated(F.col("_e")))
    values = one.groupBy("id").agg(F.first("numbers").alias("numbers"), F.collect_list("_v").alias("_v"), F.count("_e").alias("_n"))
    plain = F.filter("numbers", lambda n: ~F.contains(n, F.lit("/")))
    bare = lambda n: F.replace(n, F.lit(","), F.lit(""))
    wrong = F.filter(plain, lambda n: ~F.exists("_v", lambda v: grounding.rounds_to(bare(n), bare(n).cast("double"), v)))
    return values.select("id", F.when((F.size("_v") == F.col("_n")) & (F.col("_n") > 0) & (F.size("numbers") > 0), wrong).alias("wrong"))
