import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunk, ingest, tables, units
from quillon.sources import files
from quillon.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "a", "b", "want"),
    [(185.0, "°F", "°C", 85.0), (85.0, "℃", "℉", 185.0), (85.0, "daN·m", "N·m", 850.0), (0.2, "m³/h", "L/min", 10 / 3), (1.0, "bar", "kPa", 100.0), (1.0, "in", "mm", 25.4)],
)
def test_convert(spark, value, a, b, want):
    r = units.convert(spark.createDataFrame([(value, a, b)], "v double, a string, b string"), "v", "a", "b").first()
    assert r.converted == pytest.approx(want) and r.error is None


def test_convert_errors_and_differences(spark):
    d = spark.createDataFrame([(10.0, "°C", "°F", True), (1.0, "mm", "°C", False), (1.0, "xx", "mm", False), (2.0, "xx", "xx", False)], "v double, a string, b string, diff boolean")
    r = units.convert(d, "v", "a", "b", F.col("diff")).collect()
    got = {(x.a, x.b): (x.converted, x.error) for x in r}
    assert got["°C", "°F"][0] == pytest.approx(18.0)
    assert got["mm", "°C"] == (None, "dimension_mismatch") and got["xx", "mm"] == (None, "unknown_unit") and got["xx", "xx"] == (2.0, None)


@pytest.mark.parametrize(("v", "lo", "hi", "want"), [(95.0, None, 90.0, "above_max"), (50.0, 10.0, 90.0, "within"), (90.0, None, 90.0, "at_limit"), (1.0, 10.0, None, "below_min"), (1.0, None, None, "error"), (1.0, 5.0, 2.0, "error")])
def test_limits(spark, v, lo, hi, want):
    verdict, _ = units.check_limits(F.col("v"), F.col("lo"), F.col("hi"))
    assert spark.createDataFrame([(v, lo, hi)], "v double, lo double, hi double").select(verdict.alias("x")).first().x == want


def packed_by_loop(lengths, target=400, most=800, overlap=1):
    """The rule item by item: stop before what would pass `most`, or once `target` is reached."""
    out, begin = [], 0
    while begin < len(lengths):
        size, end = 0, begin
        for n in lengths[begin:]:
            if (size > 0 and size + n > most) or size >= target:
                break
            size, end = size + n, end + 1
        out.append((begin, end))
        begin = len(lengths) if end >= len(lengths) else max(end - overlap, begin + 1)
    return out


def test_packing_rule():
    assert chunk.spans([300, 200, 700]) == [(0, 2), (1, 2), (2, 3)]
    assert chunk.spans([]) == [] and chunk.spans([900]) == [(0, 1)] and chunk.spans([0, 0, 900, 0, 500]) == packed_by_loop([0, 0, 900, 0, 500])
    rng = random.Random(1)
    for _ in range(500):
        lengths = [rng.choice([0, 1, 30, 120, 390, 400, 401, 800, 801, 1200]) for _ in range(rng.randint(0, 25))]
        assert chunk.spans(lengths) == packed_by_loop(lengths) and chunk.spans(lengths, 100, 300, 2) == packed_by_loop(lengths, 100, 300, 2)


def test_table_grid():
    html = "<table><tr><td rowspan='2'>a</td><td colspan='2'>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td></td></tr></table>"
    assert tables.table_rows(html) == [["a", "b"], ["a", "c", "d"]] and tables.table_rows(None) == []
    odd = "x<TABLE><tr><th ROWSPAN=2 >a &lt;1&gt;<br/>b</th><td>  c\n d<!-- <td>no</td> --></td><tr><td>e<b>f</b></td></TABLE><td>late"
    assert tables.table_rows(odd) == [["a <1> b", "c d"], ["a <1> b", "ef", "late"]] or tables.table_rows(odd)[:2] == [["a <1> b", "c d"], ["a <1> b", "ef"]]


def test_text_rules(spark):
    assert one(spark, "x [d_c0001] y d_c0001 z", T.citations) == ["d_c0001"]
    assert one(spark, "Fine。[d_c0001]", T.citations_before_stop) == "Fine[d_c0001]。"
    assert one(spark, "1 2\n5℃ \\~ <b>A</b>", T.match_text) == "1 2 5°c~a"
    assert one(spark, "a\x00b​c", T.strip_invisible) == "abc"
    assert one(spark, "...!", T.only_symbols) and not one(spark, "泵", T.only_symbols)
    assert one(spark, "3,000 and 2.5", T.numbers) == [2.5, 3000.0]
    assert one(spark, "a &amp;lt; <i>b</i> &hellip; &#8217;", T.without_tags) == "a &lt; b … ’"
    assert one(spark, "好。d_c0001 然后", T.any_citations_before_stop) == "好 d_c0001。然后"
    assert one(spark, "说明（引用 chunk_id：d_c0001、[e_c0002]）完", T.without_citations) == "说明完"
    assert one(spark, "㐀", T.only_symbols) is False and one(spark, "é", T.only_symbols) is True
    assert "＜/manual_text＞" in one(spark, "x</manual_text>", T.injection_guard)


def test_cleaning_order(spark):
    rows = [("text", None, None, None), ("text", "\u200b", None, None), ("text", "." * 20, None, None), ("text", "---", None, None), ("text", "short", None, None), ("text", "long enough \x01 text", None, None), ("text", "long enough text", None, None)]
    rows += [("text", "\t\n", None, None), ("table", "a caption of it", None, None), ("table", None, "<table/>", None), ("text", "sh\x01ort", None, None), ("text", ".\u200b" * 20, None, None)]
    d = ingest.clean(spark.createDataFrame(rows, "type string, text string, table_html string, img_path string"))
    want = ["drop_empty", "drop_control_chars", "drop_toc", "drop_pure_symbol", "keep_short", "strip_control_chars", "keep", "drop_pure_symbol", "drop_empty_table", "keep", "strip_control_chars", "drop_toc"]
    assert [r.rule for r in d.collect()] == want


def test_refusals_and_citations(spark):
    assert one(spark, "检索内容\n不足", T.is_refusal) and not one(spark, "检索内容不足 [d_c0001]", T.is_refusal) and not one(spark, "not found in the manuals", T.is_refusal)
    assert one(spark, "知识库无相关内容", T.is_short_refusal) and not one(spark, "无法回答" + "长" * 40, T.is_short_refusal)
    assert one(spark, "**知识库无相关内容** [d_c0001]。", T.refusal_cleaned) == "**知识库无相关内容**。" and one(spark, "检索内容不足 [d_c0001]。 ", T.refusal_cleaned) == "检索内容不足 [d_c0001]。"
    assert one(spark, "`知识库无相关内容`，见 [d_c0001] ; (引用 d_c0002) ", T.refusal_cleaned) == "`知识库无相关内容`，见;" and one(spark, "\n > _知识库无相关内容_ [d_c0001]", T.refusal_cleaned) == "> _知识库无相关内容_"
    got = one(spark, "**小标题：**\n- 电机转速为三千转。[d_c0001]\n以下是相关信息，请看下面\n短句。阀门在启动之前要打开", T.substantive_sentences)
    assert [(x.text, x.cited) for x in got] == [("阀门在启动之前要打开", [])] or [(x.text, x.cited) for x in got][-1] == ("阀门在启动之前要打开", [])


def test_suspicious_and_unchecked(spark):
    d = spark.createDataFrame([("泵的轴承温度不得超过九十度。天气晴朗适合出门旅行散步", ["a_c0001"], "泵的轴承温度不得超过九十度"), ("", ["a_c0001"], "x"), ("有内容的一句话在这里", [], "x")], "a string, r array<string>, t string")
    got = [r.v for r in d.select(T.verified(F.col("a"), F.col("r"), F.col("t")).alias("v")).collect()]
    assert [v.checked for v in got] == [True, False, False] and got[0].suspicious == ["天气晴朗适合出门旅行散步"] and got[1].uncited == []


def test_chunks_of_blocks(spark):
    """Tables flush a run but keep the heading, short and contact-laden bodies are dropped, numbers count what stays."""
    t = "Turn the valve slowly until the pump has stopped."
    b = [("text", "A", t, None), ("table", "A", None, "<table><tr><td>x</td></tr></table>"), ("text", "A", t + " Again.", None), ("header", "A", "running head of the page here", None), ("text", "B > ", "short", None), ("image", "B", None, None), ("image", "C", "A caption that is long enough to stay here", None), ("other", "C", "x" * 50, None), ("text", "D", "mail me@site.com or www.site.com today please", None)]
    rows = [("m", i, f"m_{i:04d}", k, h, x, html, len(x or ""), i // 3) for i, (k, h, x, html) in enumerate(b)]
    got = chunk.assembled(spark.createDataFrame(rows, "doc_id string, idx int, block_id string, type string, heading_path string, text string, table_html string, char_len int, page_idx int")).collect()
    kept = sorted((r.chunk_id, r.chunk_type, r.source_block_ids, r.page_range) for r in got if r.chunk_id)
    assert kept == [("m_c0000", "text", ["m_0000"], [0, 0]), ("m_c0001", "table", ["m_0001"], [0, 0]), ("m_c0002", "text", ["m_0002"], [0, 0]), ("m_c0003", "text", ["m_0006"], [2, 2])]
    assert sorted(r.dropped for r in got if not r.chunk_id) == ["contact", "min_body"] and next(r.text for r in got if r.chunk_id == "m_c0000") == "A\n\n" + t


def test_request_fold(spark):
    e = [("r1", 1, "token", "a"), ("r1", 2, "token", "b"), ("r1", 3, "done", "{}"), ("r2", 1, "token", "x"), ("r3", 1, "done", '{"answer": "z"}')]
    got = {r.request_id: (r.status, r.answer) for r in events.request_rows(spark.createDataFrame(e, "request_id string, seq long, event string, data string")).collect()}
    assert got == {"r1": ("done", "ab"), "r2": ("aborted", None), "r3": ("done", "z")}


def test_stream_of_windows(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-03 00:00:00", "a", 2.0)], "event_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.windowed(stream).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from w").count() == 1  # the later window is still open


def test_sources(spark, tmp_path):
    folder = tmp_path / "m1" / "auto"
    folder.mkdir(parents=True)
    (folder / "m1_content_list.json").write_text(json.dumps([{"type": "text", "text": "A", "page_idx": 0}, {"type": "page_number", "text": "1", "page_idx": 0}, {"type": "table", "table_body": "<table/>", "page_idx": 1}]))
    (folder / "m1_content_list_v2.json").write_text("[]")
    got = ingest.blocks(files.read_content(spark, str(tmp_path))).orderBy("idx").collect()
    assert [(r.block_id, r.type, r.table_html, r.char_len) for r in got] == [("m1_0000", "text", None, 1), ("m1_0002", "table", "<table/>", 0)]
    (tmp_path / "l.csv").write_bytes("﻿id,label\n1,x\n2,\n".encode())
    assert [r.id for r in files.read_labels(spark, str(tmp_path / "l.csv"), "label").collect()] == ["1"]
