import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import answers, evaluate, logs, probes, retrieval, tools
from quillon.sources import files
from quillon.streaming import events


def test_log_with_ratings(spark, tmp_path):
    """Three requests: one right, one refused, one rejected; a rating set, one taken back, one for an unknown id."""
    folder = str(tmp_path / "log")
    rows = [("a", "2024-01-01 10:00:00", "done", False, 1000.0, 0.01, 3, 1, "repaired"), ("b", "2024-01-02 10:00:00", "done", True, 3000.0, 0.02, 0, 0, None), ("c", "2024-01-03 10:00:00", "rejected", None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "id string, t string, status string, refused boolean, elapsed_ms double, cost_yuan double, numbers_checked int, number_issues int, repaired string")
    d = d.withColumn("created_at", F.col("t").cast("timestamp")).withColumn("cited", F.array(F.lit("x_c0001"))).drop("t")
    logs.append(d.where("id <> 'c'"), folder)
    logs.append(d.where("id = 'c'"), folder)
    assert logs.read(spark, folder).where("rating IS NOT NULL").count() == 0
    given = [("a", 1, " good ", 1), ("b", -1, "bad", 1), ("b", None, "no", 2), ("b", -1, "bad again", 3), ("zz", 1, None, 1), ("c", 1, "x", 1), ("c", None, "y", 2)]
    f = spark.createDataFrame(given, "id string, rating int, comment string, n int").withColumn("rated_at", F.timestamp_seconds(F.col("n"))).drop("n")
    logs.rate(f, folder)
    got = {r.id: (r.rating, r.comment, r.cited) for r in logs.read(spark, folder).collect()}
    assert got == {"a": (1, "good", '["x_c0001"]'), "b": (-1, "bad again", '["x_c0001"]'), "c": (None, None, '["x_c0001"]')}
    s = logs.summary(logs.read(spark, folder)).first()
    assert (s.requests, s.done, s.rejected, s.refused, s.p50_ms, s.cost, s.checked, s.with_issues, s.repaired, s.up, s.down) == (3, 2, 1, 1, 2000.0, 0.03, 1, 1, 1, 1, 1)
    assert logs.read(spark, folder, "2024-01-02").count() == 2 and [r.id for r in logs.last_down(logs.read(spark, folder)).collect()] == ["b"]
    assert {r.id: r.matched for r in logs.matched(f.select("id").distinct(), logs.read(spark, folder)).collect()} == {"a": True, "b": True, "c": True, "zz": False}


def test_pool_and_sections(spark):
    shown = spark.createDataFrame([("s", 1, "m_c0001", "rows"), ("s", 2, "m_c0002", "full"), ("s", 3, "m_c0001", "full"), ("s", 4, "m_c0002", "rows")], "session string, seq int, chunk_id string, shown string")
    pool = tools.pooled(shown)
    assert sorted(tuple(r) for r in pool.collect()) == [("s", "m_c0001", "full", 1), ("s", "m_c0002", "full", 2)]
    chunks = spark.createDataFrame([(f"m_c{i:04d}", "m", i) for i in range(4)], "chunk_id string, doc_id string, position int")
    calls = spark.createDataFrame([(1, "s", "m_c0001", 9, 0), (2, "s", "m_c0003", 1, 1), (3, "s", "m_c9999", 1, 1), (4, "t", "m_c0001", 1, 1)], "call_id int, session string, chunk_id string, before int, after int")
    got = {r.call_id: (r.error, r.ids) for r in tools.read_section(calls, chunks, pool).collect()}
    assert got == {1: (None, ["m_c0000", "m_c0001"]), 2: ("not_in_evidence", []), 3: ("unknown_chunk", []), 4: ("not_in_evidence", [])}


def test_tool_specification():
    spec = {t["name"]: t["parameters"] for t in tools.specification(["m1", "m2"])}
    assert set(spec) == set(tools.ARGUMENTS) and spec["search_manuals"]["properties"]["manual"]["enum"] == ["m1", "m2"] and spec["convert_unit"]["required"] == ["value", "from_unit", "to_unit"]
    json.dumps(spec)


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "pump valve pump"), (2, "valve"), (3, "motor shaft seal"), (4, None), (5, "seal ring")], "k long, t string")
    q = spark.createDataFrame([(1, "pump seal"), (2, "nothing here"), (3, None)], "q_id long, q_text string")
    index = retrieval.bm25_index(docs, "k", "t")
    want = sorted(tuple(r) for r in retrieval.bm25_topk(index, q, 3).collect())
    assert sorted(tuple(r) for r in retrieval.bm25_topk(index.write(str(tmp_path / "i")), q, 3).collect()) == want
    assert [(r[1], r[3]) for r in want if r[0] == 2] == [(5, 1), (4, 2), (3, 3)] or sorted((r[3], r[1]) for r in want if r[0] == 2) == [(1, 5), (2, 4), (3, 3)]


def test_negative_scores_leave_room_for_fillers(spark):
    """Where every term is in most documents, weights are negative and documents without any term come first."""
    docs = spark.createDataFrame([(i, "a b") for i in range(20)] + [(-1, "z"), (-2, "")], "k long, t string")
    q = spark.createDataFrame([(1, "a")], "q_id long, q_text string")
    index = retrieval.bm25_index(docs, "k", "t")
    assert index.stats.first().mean < 0
    top = [r.key for r in retrieval.bm25_topk(index, q, 2).orderBy("rank").collect()]
    assert top == [-1, -2]


def test_fingerprint_changes_with_any_text(spark):
    f = lambda rows: evaluate.fingerprint(spark.createDataFrame(rows, "k long, t string").repartition(3), "k", "t").first().fingerprint
    assert f([(1, "a"), (2, "b")]) == f([(2, "b"), (1, "a")]) != f([(1, "b"), (2, "a")]) and len(f([(1, None)])) == 16


def test_json_diff(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "j string")
    got = evaluate.json_diff(one({"a": 1, "b": {"c": [1], "d": 2}, "e": None}), one({"a": 1, "b": {"c": [2]}, "f": "x"}), "j").collect()
    assert {(r.path, r.missing) for r in got} == {("b.c", None), ("b.d", "new"), ("e", "new"), ("f", "old")}


def plain_diff(old, new, path=""):
    if isinstance(old, dict) and isinstance(new, dict):
        return [d for k in sorted({*old, *new}) for d in plain_diff(old.get(k, ...), new.get(k, ...), f"{path}.{k}" if path else k)]
    return [] if old == new else [(path, "old" if old is ... else "new" if new is ... else None)]


def test_json_diff_to_any_depth(spark):
    rng = random.Random(6)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([1, 2.5, None, "x", [], {}, [1, {"a": 2, "b": [3]}], True])
        return {k: some(depth - 1) for k in rng.sample("abcdef", rng.randint(0, 4))}

    pairs = [(i, some(8), some(8)) for i in range(60)]
    changed = lambda x: {k: changed(v) for k, v in reversed(x.items())} if isinstance(x, dict) else x
    pairs += [(100 + i, a, changed(a) | {"z": 0} if isinstance(a, dict) else a) for i, a, _ in pairs]
    frame = lambda n: spark.createDataFrame([(p[0], json.dumps(p[n], indent=n)) for p in pairs], "id long, j string").repartition(3)
    got = evaluate.json_diff(frame(1), frame(2), "j", ["id"]).collect()
    assert sorted((r.id, r.path, str(r.missing)) for r in got) == sorted((i, p, str(m)) for i, a, b in pairs for p, m in plain_diff(a, b))


def test_json_diff_of_odd_rows(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, j string")
    got = evaluate.json_diff(rows((1, "no json"), (2, None), (3, "{}"), (4, "[1, 2]")), rows((1, "no json "), (2, "1"), (4, "[1,2]"), (5, None)), "j", ["id"]).collect()
    assert sorted((r.id, r.path, r.missing) for r in got) == [(1, "", None), (2, "", "old"), (3, "", "new")]


def test_probes(spark):
    d = spark.createDataFrame([("打开阀门到 12.5 mm。[m_c0012]",), ("只有 3 个",)], "a string").select(probes.number_changed(F.col("a"), F.lit(None).cast("array<double>")).alias("n"), probes.antonym_swapped(F.col("a")).alias("w"), probes.sentence_added(F.col("a"), "泵是蓝色的").alias("s")).collect()
    assert d[0].n == "打开阀门到 25.0 mm。[m_c0012]" and d[0].w == "关闭阀门到 12.5 mm。[m_c0012]" and d[0].s.endswith("泵是蓝色的[m_c0012]。") and d[1].n == "只有 6 个"


def test_evidence_shared_by_one_chunk(spark):
    chunks = spark.createDataFrame([("m_c0001", "m", "Open the valve. Stop the pump."), ("m_c0002", "m", "Stop  the PUMP."), ("n_c0001", "n", "Open the valve.")], "chunk_id string, doc_id string, text string")
    items = spark.createDataFrame([("q", 1, "m", ["open the valve"]), ("q", 2, "m", ["none of it", "stop the pump"]), ("r", 1, "m", ["absent words"])], "id string, n int, doc string, quotes array<string>")
    g = answers.evidence(items, chunks)
    assert {(r.id, r.n): r.ids for r in g.collect()} == {("q", 1): ["m_c0001"], ("q", 2): ["m_c0001", "m_c0002"], ("r", 1): []}
    assert [(r.id, r.shared) for r in answers.shared_evidence(g).collect()] == [("q", ["m_c0001"])]


def test_sinks_and_items(spark, tmp_path):
    m = spark.createDataFrame([("dev", "recall", 1, 2, 0.5)], "split string, metric string, k long, n long, rate double")
    assert files.write_metrics(m, str(tmp_path / "m.json"))["metrics"] == {"dev": {"recall": {"k": 1, "n": 2, "rate": 0.5}}}
    assert files.write_csv(m.withColumn("l", F.array("k")), str(tmp_path / "m.csv")) == 1 and (tmp_path / "m.csv").read_bytes().startswith(b"\xef\xbb\xbfsplit,")
    with pytest.raises(ValueError, match="more than 0 rows"):
        files.write_csv(m, str(tmp_path / "m.csv"), 0)
    assert "| dev | recall |" in files.write_report("T", [("P", m)], str(tmp_path / "m.md"))
    (tmp_path / "i.json").write_text(json.dumps([{"id": 1, "type": "fact", "doc": "m", "question": "q", "facts": [{"any": "x"}], "evidence": [{"quote": "y"}]}]))
    r = files.read_items(spark, str(tmp_path / "i.json")).first()
    assert (r.id, r.docs, r.expect, r.facts[0]["say"], r.facts[0]["any"], r.evidence[0]["quotes"], r.absent) == ("1", ["m"], "answer", "x", ["x"], ["y"], [])
    (tmp_path / "p.json").write_text(json.dumps({"pdf_info": [{"page_idx": 0, "para_blocks": [{"type": "text"}, {"type": "table"}]}, {"page_idx": 1, "para_blocks": [{"type": "text"}]}]}))
    assert sorted(tuple(x) for x in files.count_types(spark, str(tmp_path / "p.json")).collect()) == [("table", 1, 2), ("text", 2, 2)]
    v = spark.createDataFrame([("a_c0001", "text", [1.0])], "chunk_id string, chunk_type string, embedding array<float>")
    files.write_vectors(v, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 1


def test_stream_of_requests(spark, tmp_path):
    """A request that ends gives its row at once; one that falls silent is aborted when later events pass its patience."""
    e = [("r1", 1, "token", "a", 0), ("r1", 2, "token", "b", 1), ("r2", 1, "token", "x", 2), ("r1", 3, "done", "{}", 3), ("r3", 1, "done", '{"answer": "z"}', 4)]
    late = [("r4", 1, "token", "y", 4000)]
    later = [("r4", 2, "error", None, 4001), ("r5", 1, "token", "y", 9000)]
    schema = "request_id string, seq long, event string, data string, t long"
    # far from the epoch, which is the first watermark
    for n, rows in enumerate((e, late, later)):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("t") + 10**6)).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    folder = tmp_path / "all"
    folder.mkdir()
    for n in range(3):
        part = next((tmp_path / f"in{n}").glob("*.parquet"))
        part.rename(folder / f"{n}.parquet")
        q = events.folded_stream(spark.readStream.schema(schema).parquet(str(folder))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.request_id: (r.status, r.answer) for r in spark.read.schema(events.FOLDED).parquet(str(tmp_path / "out")).collect()}
    assert got == {"r1": ("done", "ab"), "r2": ("aborted", None), "r3": ("done", "z"), "r4": ("error", None)}


def test_workers_need_no_path(tmp_path):
    """Queries with Python workers run from a folder where the package isn't importable by itself."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from quillon.plans import catalogue
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print([catalogue.QUERIES[n](s, "/root/testdata/sf0.001").count() for n in ("chunk_pack", "table_expand", "html_strip", "derived_numbers")])
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]


def test_entry_without_llm_folders(tmp_path):
    """The entry imports and lists the other queries where the training-data parts are gone."""
    root = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "quillon"):
        (tmp_path / name).symlink_to(root / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op1_') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
