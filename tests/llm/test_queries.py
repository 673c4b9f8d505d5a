"""The registered queries, as their contracts word them, against plain Python over whole tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from quillon.llm import fingerprints
from quillon.llm.registry import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def luhn(s):
    d = [int(c) for c in reversed(re.sub("[^0-9]", "", s))]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_of(kinds, text):
    found = []
    for n, (kind, (pattern, keep)) in enumerate(kinds.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
    return [sum(f[2] == kind for f in found) for kind in kinds], hashlib.sha256(listed.encode()).hexdigest(), listed


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


@pytest.mark.parametrize(("name", "kinds"), [("op2_pii", PII), ("op9_secrets", SECRETS)])
def test_spans(spark, docs, name, kinds):
    got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        counts, digest, listed = base_of(kinds, text)
        r = got[i]
        assert [r[f"n_{k}"] for k in kinds] == counts and r.base_sha256 == digest
        own = [s for s in r.spans.split(",") if s.split(":")[0] in kinds]
        assert own == [s for s in listed.split(",") if s]
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_fingerprints(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, e, its = (fingerprints.digest(x.encode()) for x in (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, e)
        assert r.near_edited == fingerprints.likeness(own, e) and r.near_next == fingerprints.likeness(own, its) and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.5 > np.mean([r.near_next for r in got.values()])


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4") for i, text in docs}
    before = 0
    want = []
    for i, _ in docs:
        want.append((i, before, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        before += len(ids[i])
    assert sorted(tuple(r) for r in QUERIES["op5_records"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    pieces, held = QUERIES["op10_packing"](spark, SF).collect(), {}
    covered = {i: 0 for i in ids}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: len(x) for i, x in ids.items()}
    for parts in held.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(held)) > 0.95
