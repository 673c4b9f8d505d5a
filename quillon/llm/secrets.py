"""Secret scans over a trigram inverted index.

From each rule's regular expression follow the trigrams that any match must hold, as a Boolean
query: some alternative, all of its trigrams. The index is a table of the documents of each trigram that any rule so far has asked
for; rules that come later add what it lacks. Intersecting its postings gives each rule's candidates, which the expression then verifies
where a filter of fixed size lets their texts pass. Rules without mandatory trigrams scan every text. DataFrame and SQL functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, shared_folder, stored
from .spans import count_of, found, listed, masked_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: str = ""  # what a match must satisfy besides


BASE = (
    Rule("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^[^:=]*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+"),
)
#: Further rules, each for a key format with a fixed beginning.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    Rule("slack", r"xox[baprs]-[0-9A-Za-z-]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Members of a character class that still count as alternatives.
SMALL = 6


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, all of one of which any match holds; None: no such trigrams."""
    import re._constants as c
    import re._parser as p

    def walk(seq, into: list[list[str]]) -> list[list[str]]:
        for op, arg in seq:
            if op is c.LITERAL:
                into = [[*a[:-1], a[-1] + chr(arg).lower()] for a in into]
            elif op is c.SUBPATTERN:
                into = walk(arg[3], into)
            elif op is c.BRANCH:
                into = [x for branch in arg[1] for x in walk(branch, into)]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
                low, high, inner = arg
                if low == 0:
                    into = into + walk(inner, into) if high == 1 else [[*a, ""] for a in into]
                else:
                    into = [[*a, ""] if high > 1 else a for a in walk(inner, into)]
            elif op is c.IN and len(arg) <= SMALL and all(kind is c.LITERAL for kind, _ in arg):
                into = [[*a[:-1], a[-1] + chr(x).lower()] for a in into for _, x in arg]
            elif op not in (c.ASSERT, c.ASSERT_NOT, c.AT):
                into = [[*a, ""] for a in into]
            if len(into) > most:
                return []
        return into

    found_ = [frozenset(f[i : i + 3] for f in a for i in range(len(f) - 2)) for a in walk(p.parse(pattern), [[""]])]
    least = {a for a in found_ if not any(b < a for b in found_)}  # (A or A and B) is A
    return [a for a in dict.fromkeys(found_) if a in least] if found_ and all(found_) else None


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """doc_id, text_hash, gram: the documents that hold each of the trigrams, case aside. Each text is lowered once and stays where it is."""
    wanted = F.array(*[F.lit(g) for g in grams])
    held = F.transform(F.array(F.lower("text")), lambda t: F.filter(wanted, lambda g: F.contains(t, g)))[0]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(held).alias("gram"))


def gram_index(docs: DataFrame, grams: list[str], folder: str) -> DataFrame:
    """The postings of these trigrams from the index in folder, to which those that it lacks are added, by one pass over docs (the same in each call)."""
    spark = docs.sparkSession
    path, schema = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/grams"), "doc_id long, text_hash long, gram string"
    known = set()
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = {r.gram for r in spark.read.schema("gram string").parquet(f"{folder}/grams").collect()}  # as many as the rules have
    new = sorted(set(grams) - known)
    if new:
        postings(docs, new).write.mode("append").partitionBy("gram").parquet(f"{folder}/postings")
        spark.createDataFrame([(g,) for g in new], "gram string").coalesce(1).write.mode("append").parquet(f"{folder}/grams")
    return spark.read.schema(schema).parquet(f"{folder}/postings").where(F.col("gram").isin(sorted(set(grams))))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], folder: str | None = None) -> DataFrame:
    """doc_id, text_hash, rules: the rules whose trigram queries a document satisfies, by the index in folder (else one for this call)."""
    clauses = [(r.kind, i, g, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or []) for g in alt]
    table = docs.sparkSession.createDataFrame(clauses, "rule string, alternative int, gram string, need int")
    index = gram_index(docs, sorted({g for _, _, g, _ in clauses}), folder or shared_folder(docs.sparkSession))
    hits = index.join(F.broadcast(table), "gram")  # a row for each trigram of the rules
    hits = hits.groupBy("doc_id", "text_hash", "rule", "alternative", "need").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == F.col("need"))
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


#: Bits of the filter through which texts pass to be verified (2 MB, however many candidates).
FILTER_BITS = 1 << 24


def passing(docs: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """docs whose `column` (a long) may be among the keys' (a few others pass as well), so that a join moves only their texts. The filter is one row of fixed size."""
    slot = lambda: F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot() % 64).cast("int"))
    words = keys.groupBy(F.floor(slot() / 64).alias("id")).agg(F.bit_or(bit).alias("_b"))
    every = docs.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left").select("id", F.coalesce("_b", F.lit(0)).alias("_b"))
    table = stored(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_b"))), lambda x: x["_b"]).alias("_bits")))
    word = F.get("_bits", F.floor(slot() / 64).cast("int"))
    hit = F.call_function("shiftright", word, (slot() % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.crossJoin(F.broadcast(table)).where(hit).drop("_bits")  # one row


def _spans(text: Column, rule: Rule, nth: int) -> Column:
    return found(text, rule.pattern, rule.kind, nth, (lambda m: m.rlike(rule.keep)) if rule.keep else None)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """doc_id, text_hash and spans (array of structs) of every row of docs (doc_id, text).

    Null and empty texts have no spans; very long ones are read whole; repeated rows give repeated results; an empty table gives no
    rows; other columns, of any name, are not read. Spans that begin together are listed by the rules' order. Only candidates' texts, and the few that the
    filter lets pass besides, can be moved to be verified; what they have is joined back as spans. With `folder` the index there is used and added to.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nth = {r.kind: i for i, r in enumerate(rules)}
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    full = [_bare(_spans(F.col("text"), r, nth[r.kind])) for r in rules if r not in indexed]
    none = F.array().cast("array<struct<start:int,nth:int,kind:string,end:int>>")
    out = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(none, *full).alias("spans"))
    if not indexed:
        return out
    found_ = stored(candidates(d, indexed, folder))
    wanted = found_.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "rules")
    meets = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    checked = passing(d.withColumn("text_hash", F.xxhash64("text")), found_, "text_hash").join(wanted, meets)
    verified = F.concat(*[F.when(F.array_contains("rules", r.kind), _bare(_spans(F.col("text"), r, nth[r.kind]))).otherwise(none) for r in indexed])
    checked = checked.select("_doc", "_hash", verified.alias("more")).where(F.size("more") > 0)
    checked = stored(checked.groupBy("_doc", "_hash").agg(F.first("more").alias("more")))
    return out.join(checked, meets, "left").select("doc_id", "text_hash", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every run of secret spans in text replaced by mark, n_chars following; all rows stay.

    Null and empty texts stay as they are, very long ones are read whole, repeated rows are each replaced.
    Columns of any names are kept. Only rows with spans are joined back, by id and text.
    """
    own = [fresh(docs, c) for c in ("id_of", "hash_of", "spans_of", "text_of")]
    spans = scan(docs, rules).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    spans = stored(spans).toDF(*own[:3])
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(F.col("text").cast("string")) == F.col(own[1])), "left")
    none = F.col(own[2]).isNull()
    # a column of its own first: within a lambda, `text` would be the new one beside it
    joined = joined.withColumn(own[3], F.when(none, F.col("text")).otherwise(masked_text(F.col("text"), F.col(own[2]), mark)))
    new = {"text": F.col(own[3])}
    if "n_chars" in (c.lower() for c in docs.columns):
        new["n_chars"] = F.when(none, F.col("n_chars")).otherwise(F.length(own[3]).cast("long"))
    return joined.select(*[new[c.lower()].alias(c) if c.lower() in new else F.col(f"`{c}`") for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; nulls, empty and long texts, ties and repeated rows as in scan."""
    d = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["nth"] < len(BASE))
    counts = [count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE]
    return d.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
