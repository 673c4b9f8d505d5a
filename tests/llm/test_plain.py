"""Second, plain versions of the quartile digest and of multiway differencing."""

import heapq
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import fingerprints, jaccard, language, mixing, packing, pii
from quillon.llm.packing import differencing


def plain_digest(data):
    if not data:
        return "0" * 68
    padded = data + b"\0" * max(0, 5 - len(data))
    counts = [0] * 128
    hashes = [((0, 1, 2), 2654435761), ((0, 1, 3), 2246822519), ((0, 2, 3), 3266489917), ((0, 2, 4), 668265263), ((0, 1, 4), 374761393), ((0, 3, 4), 2869860233)]
    for at in range(len(padded) - 4):
        for offsets, multiplier in hashes:
            code = sum(padded[at + o] << (8 * n) for n, o in enumerate(offsets))
            counts[(code * multiplier % 2**32) >> 25] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    head = [min(255, int(math.log(len(data)) / math.log(1.1))), (q1 * 100 // q3 % 16 if q3 else 0) * 16 + (q2 * 100 // q3 % 16 if q3 else 0)]
    quarter = [sum(c > q for q in (q1, q2, q3)) for c in counts]
    return bytes(head + [sum(quarter[4 * k + i] << (2 * i) for i in range(4)) for k in range(32)]).hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if (a == "0" * 68) != (b == "0" * 68):
        return 0.0
    around = lambda p, q: min(12, (p - q) % 16, (q - p) % 16)
    score = min(24, abs(x[0] - y[0])) + around(x[1] // 16, y[1] // 16) + around(x[1] % 16, y[1] % 16)
    for p, q in zip(x[2:], y[2:], strict=True):
        for i in range(4):
            step = abs((p >> 2 * i) % 4 - (q >> 2 * i) % 4)
            score += 6 if step == 3 else step
    return max(0.0, 1 - score / 240)


def test_digest_and_likeness(spark):
    rng = random.Random(3)
    texts = ["", "a", "ab", "abcd", "abcde", "é泵", "x" * 5000] + ["".join(rng.choice("abcdef ghié") for _ in range(n)) for n in (5, 6, 40, 300, 2500, 2500)]
    texts.append(texts[-1].replace("a", "b", 20))
    made = [fingerprints.digest(t.encode()) for t in texts]
    assert made == [plain_digest(t.encode()) for t in texts]
    for a in made:
        for b in made:
            assert abs(fingerprints.likeness(a, b) - plain_likeness(a, b)) < 1e-12
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fingerprint string, n_chars int")).collect()}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].fingerprint == plain_digest(t.encode()) and got[i].edited_fingerprint == plain_digest(edited.encode())


def plain_differencing(lengths, windows):
    """Partial partitions as lists of (sum, members), the two of largest spread merged with opposing order."""
    heap = []
    for i, x in enumerate(lengths):
        parts = [(x, [i])] + [(0, [])] * (windows - 1)
        heapq.heappush(heap, (-x, i, parts))
    n = len(lengths)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda z: -z[0])
        merged = [(x - merged[-1][0], p) for x, p in merged]
        heapq.heappush(heap, (-merged[0][0], n, merged))
        n += 1
    return [p for _, p in heap[0][2]]


def test_differencing_equals_the_plain_version():
    rng = random.Random(5)
    for windows in (2, 3, 7):
        for n in (1, 2, 5, 40, 90):
            lengths = [rng.randint(1, 512) for _ in range(n)]
            got, want = differencing(lengths, windows), plain_differencing(lengths, windows)
            sums = sorted(np.bincount(got, weights=lengths, minlength=windows).astype(int))
            assert sums == sorted(sum(lengths[i] for i in p) for p in want)
    even = np.bincount(differencing([rng.randint(1, 512) for _ in range(300)], 10), minlength=10)
    assert even.min() > 0


def test_clashing_columns(spark):
    """Columns of any name beside doc_id and text are not read."""
    names = ["key", "size", "spans", "base", "rules", "lang_pred", "score", "sequence_id", "offset", "class", "taken", "_doc", "_hash", "text_hash", "component"]
    rows = [(i, f"call the office {i % 7}{i}{i} now, mail a{i}@b.example or the one on the list " * 3, "en" if i % 2 else "de", "s", i) for i in range(40)] + [(50, None, None, None, None), (51, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    plain = lambda d, *cols: sorted(str(tuple(r)) for r in d.select(*cols).collect())
    assert plain(pii.extract(wide), "doc_id", "spans") == plain(pii.extract(df), "doc_id", "spans")
    assert plain(mixing.mix(wide), "doc_id", "size", "target") == plain(mixing.mix(df), "doc_id", "size", "target")
    assert plain(packing.pack(wide), "doc_id", "start", "length") == plain(packing.pack(df), "doc_id", "start", "length")
    assert plain(jaccard.one_of_each(wide).select(*df.columns), *df.columns) == plain(jaccard.one_of_each(df), *df.columns)
    model = language.fit(language.training_rows(df))
    assert plain(language.predict(wide, model), "doc_id", "lang_pred", "score") == plain(language.predict(df, model), "doc_id", "lang_pred", "score")
