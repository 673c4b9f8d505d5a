"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base matches are the seeds. They and identifier-like tokens outside them are instances; the words
around an instance (lower case, digits as 0, without marks at their ends) and its own shape make lexical
patterns. A graph of patterns and instances is scored in turns (a pattern by the share of its instances' scores,
an instance by its patterns, seeds fixed at 1). Patterns of high confidence that many different
seeds support then give the other instances in their context as further spans, of kind `context`.
Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, salted, stored
from .spans import count_of, found, listed

KINDS = ("email", "ip", "card", "phone")
# A match can begin only at the start of a run of its first characters or where the last match
# ended, and runs are taken whole: the matches are those of the plain patterns, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TOKEN = r"(?:(?<![A-Za-z0-9@._%+#/-])|\G)[A-Za-z@._%+#/-]*+[0-9][A-Za-z0-9@._%+#/-]*+"
#: Characters of a place in a text, by which spans are held against tokens.
NEAR = 1024
#: Characters beside an instance within which the words of its context lie whole; a longer word is no context.
CONTEXT = 60
#: Digits that a token has at least.
DIGITS = 4
ROUNDS, CONFIDENCE, SEEDS = 3, 0.8, 5
#: How much the score of an instance that is no seed counts for a pattern: at 1, a pattern and its instances would raise each other without end.
TRUST = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.length(d).between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0)


def base_spans(text: Column) -> Column:
    """The spans of the four kinds in a text (null: none)."""
    kept = {
        "email": found(text, EMAIL, "email", 0),
        "ip": found(text, IP, "ip", 1, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": found(text, CARD, "card", 2, lambda m: F.when(F.length(m) >= 14, _luhn(m)).otherwise(False)),
        "phone": found(text, PHONE, "phone", 3, lambda m: F.length(_digits(m)).between(10, 15)),
    }
    email = F.when(F.contains(text, F.lit("@")), kept["email"]).otherwise(F.array().cast("array<struct<start:int,nth:int,kind:string,end:int,match:string>>"))
    return F.concat(email, kept["ip"], kept["card"], kept["phone"])


def _shape(m: Column) -> Column:
    """Runs of digits as 0, of other letters as a; marks stay."""
    return F.regexp_replace(F.regexp_replace(m, r"\p{L}+", "a"), "[0-9]+", "0")


def _outside(tokens: Column, base: Column, length: Column) -> Column:
    """Tokens that no base span meets. The spans are dealt by where they lie, so that a token is held against those near it alone."""
    places = F.sequence(F.lit(0), F.floor(length / NEAR).cast("int"))
    near = F.transform(places, lambda i: F.filter(base, lambda b: (b["start"] < (i + 1) * NEAR) & (b["end"] > i * NEAR)))

    def free(lots: Column) -> Column:
        beside = lambda s: F.flatten(F.slice(lots, F.floor(s["start"] / NEAR).cast("int") + 1, F.floor((s["end"] - 1) / NEAR).cast("int") - F.floor(s["start"] / NEAR).cast("int") + 1))
        return F.filter(tokens, lambda s: ~F.exists(beside(s), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))

    return F.element_at(F.transform(F.array(near), free), 1)


def _instances(text: Column, base: Column) -> Column:
    """Base spans, and identifier-like tokens outside them, with the patterns that they stand in."""
    tokens = found(text, TOKEN, "context", len(KINDS), lambda m: F.length(_digits(m)) >= DIGITS)
    tokens = F.when(F.size(base) == 0, tokens).otherwise(_outside(tokens, base, F.length(text)))
    pick = lambda spans, seed: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.lit(seed).alias("seed")))

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
        return F.regexp_replace(F.lower(F.when(bare == "", w).otherwise(bare)), "[0-9]+", "0")

    blank, length = r"[\x20\x09-\x0D]", F.length(text)
    # a substring is sought from its text's beginning: places are cut once, and contexts from them
    begin = lambda i: F.greatest(i * NEAR - CONTEXT - 1, F.lit(0))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(length / NEAR).cast("int")), lambda i: F.substring(text, begin(i) + 1, F.lit(NEAR + 2 * CONTEXT + 2)))

    def one(s: Column, places: Column, length: Column) -> Column:
        at, to = F.floor(s["start"] / NEAR).cast("int"), F.floor(s["end"] / NEAR).cast("int")
        first = F.greatest(s["start"] - CONTEXT - 1, F.lit(0))
        ahead = F.substring(F.get(places, at), first - begin(at) + 1, s["start"] - first)
        ahead = F.when(first > 0, F.regexp_replace(ahead, rf"^{WORD}", "")).otherwise(ahead)  # what the window cuts is no word
        left = F.transform(F.regexp_extract_all(ahead, F.lit(WORD), F.lit(0)), word)
        behind = F.substring(F.get(places, to), s["end"] - begin(to) + 1, F.lit(CONTEXT + 1))
        behind = F.when(s["end"] + CONTEXT >= length, F.concat(behind, F.lit(" "))).otherwise(behind)
        after = F.regexp_substr(F.regexp_substr(behind, F.lit(rf"^{blank}*+{WORD}+{blank}")), F.lit(WORD))
        last, before = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
        patterns = F.array(F.concat(F.lit("before:"), before, F.lit(" "), last), F.concat(F.lit("around:"), last, F.lit(" _ "), word(after)), F.concat(F.lit("shape:"), last, F.lit(" "), _shape(s["match"])))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("token"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"), s["seed"].alias("seed"))

    spans = F.concat(pick(base, True), pick(tokens, False))
    none = F.array().cast("array<struct<start:int,end:int,token:string,patterns:array<string>,seed:boolean>>")
    # element_at keeps what a lambda binds; by [0] it would be written into the lambda, and read again for each token
    bound = lambda all_: F.element_at(F.transform(F.array(F.struct(cuts.alias("cuts"), length.alias("length"))), lambda c: F.transform(all_, lambda s: one(s, c["cuts"], c["length"]))), 1)
    return F.element_at(F.transform(F.array(spans), lambda all_: F.when(F.size(all_) == 0, none).otherwise(bound(all_))), 1)


def extract(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of structs) of every row of docs (doc_id, text).

    Null and empty texts have no spans; very long ones are read whole; repeated rows give repeated results; an empty table gives no
    rows; other columns, of any name, are not read. Spans that begin together are listed by kind. Only spans and instances are stored and shuffled, never texts. A pattern counts if at least
    `seeds` different seeds stand in it and its score reaches `confidence`. Hot patterns and instances are joined in parts.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(F.array(base_spans(F.col("text"))), lambda b: F.struct(b.alias("base"), _instances(F.col("text"), b).alias("instances")))[0].alias("all"))
    d = stored(d.select("doc_id", "text_hash", F.transform("all.base", lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), F.col("all.instances").alias("instances")))
    seen = d.select("doc_id", "text_hash", F.explode("instances").alias("t")).select("doc_id", "text_hash", "t.start", "t.end", "t.token", "t.seed", F.explode("t.patterns").alias("pattern"))
    edges = seen.groupBy("pattern", "token").agg(F.max("seed").alias("seed"))
    shared = edges.groupBy("pattern").agg(F.max("seed").alias("any"), F.count(F.lit(1)).alias("tokens")).where((F.col("tokens") > 1) & (F.col("any") | (F.lit(rounds) > 1))).select("pattern")
    edges = stored(salted(stored(edges), shared, "pattern"))
    tokens = edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("known"))
    patterns = None
    for turn in range(rounds):
        tokens = stored(tokens)
        patterns = salted(edges.select("pattern", "token"), tokens, "token").groupBy("pattern").agg((F.sum(F.when(F.col("known"), 1.0).otherwise(TRUST * F.col("score"))) / (F.count(F.lit(1)) + 1)).alias("rate"), F.sum(F.col("known").cast("int")).alias("seeds"))
        patterns = stored(patterns)
        if turn < rounds - 1:
            weight = F.log1p(-F.least(F.col("rate"), F.lit(0.999)))
            scored = salted(edges.select("pattern", "token"), patterns.where(F.col("rate") > 0), "pattern").groupBy("token").agg((1 - F.exp(F.sum(weight))).alias("found"))
            tokens = tokens.join(scored, "token", "left").select("token", F.when(F.col("known"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"), "known")
    good = patterns.where((F.col("rate") >= confidence) & (F.col("seeds") >= seeds)).select("pattern")
    more = salted(seen.where(~F.col("seed")), good, "pattern")
    span = F.struct("start", F.lit(len(KINDS)).alias("nth"), F.lit("context").alias("kind"), "end")
    more = more.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set(span).alias("more"))
    out = d.select("doc_id", "text_hash", "base").join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "text_hash", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; nulls, empty and long texts, ties and repeated rows as in extract."""
    d = extract(documents(spark, sf_dir))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
