"""The corpus pipeline: each stage's decisions on what the stage before kept, against brute force where there is one."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "ung", "pf"]}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        words = ["".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(60 + i)]
        rows.append((i, " ".join(words), lang, ("s", "t", "u", None)[i % 4 if i % 3 else 0], 0))
    rows += [(200, rows[3][1], "bb", "s", 0), (201, rows[4][1] + " extra", "aa", "t", 0)]
    rows += [(202, rows[7][1] + " password = 'abcdefghijkl12'", "bb", "u", 0), (203, None, None, "s", 0), (204, "", None, None, 0), (205, "12 34 !!", None, "t", 0)]
    rows.append((206, "token: ABCDEFGHIJKL99 " + " ".join("".join(rng.choice(SYLLABLES["aa"], 4)) for _ in range(90)), "aa", "t", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    kept.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        kept.append(docs)
    return [(d.columns, d.collect()) for d in kept]


def test_columns(steps):
    assert all(columns == steps[0][0] for columns, _ in steps[:-1])


def test_language_drops_what_has_no_letters(steps):
    gone = {r.doc_id for r in steps[0][1]} - {r.doc_id for r in steps[1][1]}
    assert {203, 204, 205} <= gone and not gone & set(range(120))


def test_one_document_of_each_group_stays(steps):
    rows = sorted(steps[1][1], key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = WORD.findall(r.text.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    least = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert sorted(r.doc_id for r in steps[2][1]) == [r.doc_id for i, r in enumerate(rows) if least[i] == i]


def test_secrets_go_and_documents_stay(steps):
    before, after = ({r.doc_id: r.text for r in steps[k][1]} for k in (2, 3))
    assert before.keys() == after.keys()
    assert not any("ABCDEFGHIJKL99" in t or "abcdefghijkl12" in t for t in after.values())
    assert all(after[i] == t for i, t in before.items() if i < 120)


def test_mix_keeps_near_its_targets(steps):
    size = {r.doc_id: len(WORD.findall(r.text)) for r in steps[3][1]}
    taken, source = {}, {r.doc_id: r.source for r in steps[3][1]}
    for r in steps[4][1]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    names = sorted({s for s in source.values() if s is not None}) + [None]
    have = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(have.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * have[s]}
        target |= {s: 2 * have[s] for s in full} if full else share
        left -= sum(2 * have[s] for s in full)
        free = free - full if full else set()
    for s in names:
        assert abs(sum(n for i, n in taken.items() if source[i] == s) - target[s]) <= max(size.values())


def test_packing_holds_each_id_once(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, pieces, windows = [], [], {}
    for r in steps[4][1]:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 512 else None))
    for r in steps[5][1]:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.start == 0:
            pieces.append((r.doc_id, r.doc_tokens, r.ids_crc32 if r.length == r.doc_tokens <= 512 else None))
    assert sorted(map(str, pieces)) == sorted(map(str, want)) and sum(r.length for r in steps[5][1]) == sum(w[1] for w in want)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_an_empty_table(spark, steps):
    """Each stage takes a table without rows and returns one with its columns."""
    columns = steps[0][0]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, "")
        assert out.count() == 0 and (out.columns == columns or n == len(corpus_pipeline.STAGES) - 1)
