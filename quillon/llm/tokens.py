"""Token ids of whole texts, equal to the tokenizers library's, through a word cache where the file allows one.

The word-level BPE drops white space and never merges across it, so a text's ids are
its words' ids in a row. Each Python worker keeps the ids of words it has met; new
plain words go through a vectorised BPE, all others through the library itself. Files whose
normaliser, splitter or model is of another kind are read by the library alone.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice

import numpy as np

#: Words that a worker remembers: those that it meets a second time, as far as a table of MET slots can tell; it starts again when it has let go RENEW times as many.
CACHE_WORDS, RENEW, MET = 250_000, 40, 1 << 22
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([.,;:!?]*)\Z")
_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizers file (loaded once)."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


# The steps before the model under which a text's ids are its lower-case words' ids in a row.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def by_words(spec: dict) -> bool:
    """Whether a tokenizers file is of the kind that the word cache is made for."""
    steps = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")
    model = spec["model"]
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or [])
    return steps == (NORMALIZER, SPLITTER) and plain and bool(model.get("end_of_word_suffix")) and all(model.get(k) == v for k, v in MODEL.items()) and not spec.get("post_processor")


class Encoder:
    """encode(texts) gives each text's ids as little-endian bytes of `dtype`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.by_words = by_words(spec)
        self.signs = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        if not self.by_words:
            return
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.cache: dict[bytes, bytes] = {}
        self.forgotten, self.met = 0, bytearray(MET)
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], dtype=np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        codes = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        self.bits = max(10, int(np.ceil(np.log2(4 * len(codes)))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(codes))
        at = self._slot(codes)
        while len(codes):  # open addressing: the first of each slot settles, the rest move on
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.slots[at[take]], self.ranks[at[take]] = codes[take], rank[take]
            left = np.setdiff1d(np.arange(len(codes)), take)
            codes, rank, at = codes[left], rank[left], (at[left] + 1) & ((1 << self.bits) - 1)

    NONE = 1 << 40

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = np.where((a < 0) | (b < 0), -2, a * self.width + b)
        at = self._slot(codes)
        out = np.full(codes.shape, self.NONE, dtype=np.int64)
        open_ = np.flatnonzero(codes.ravel() >= 0)
        flat, codes, at = out.ravel(), codes.ravel(), at.ravel()
        at = at[open_]
        while len(open_):
            here = self.slots[at]
            hit = here == codes[open_]
            flat[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (here >= 0)
            open_, at = open_[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one piece each, lowest merge first, all words together."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[bytes] = [b""] * len(words)
        for k in range(0, len(order), 4096):
            part = order[k : k + 4096]
            lengths = np.array([len(words[i]) for i in part])
            high = int(lengths.max())
            grid = np.full((len(part), high + 1), -1, dtype=np.int64)
            where = np.arange(high)[None, :] < lengths[:, None]
            letters = np.frombuffer(b"".join(words[i] for i in part), dtype=np.uint8)
            grid[:, :high][where] = self.inner[letters]
            grid[np.arange(len(part)), lengths - 1] = self.last[letters[np.cumsum(lengths) - 1]]
            ranks = self._rank(grid[:, :-1], grid[:, 1:])
            rows = np.arange(len(part))
            cols = np.arange(high + 1)[None, :]
            while True:
                at = ranks[rows].argmin(axis=1)
                best = ranks[rows, at]
                rows, at, best = rows[best < self.NONE], at[best < self.NONE], best[best < self.NONE]
                if not len(rows):
                    break
                own = grid[rows]
                own[np.arange(len(rows)), at] = self.made[best]
                tail = np.concatenate([own[:, 1:], np.full((len(rows), 1), -1)], axis=1)
                own = np.where(cols > at[:, None], tail, own)
                grid[rows] = own
                r = ranks[rows]
                tail = np.concatenate([r[:, 1:], np.full((len(rows), 1), self.NONE)], axis=1)
                r = np.where(cols[:, :-1] > at[:, None], tail, r)
                i = np.arange(len(rows))
                r[i, at] = self._rank(own[i, at], own[i, at + 1])
                before = at > 0
                r[i[before], at[before] - 1] = self._rank(own[i[before], at[before] - 1], own[i[before], at[before]])
                ranks[rows] = r
            size = (grid >= 0).sum(axis=1)
            ids = grid[grid >= 0].astype(self.dtype).tobytes()
            ends = np.cumsum(size) * self.dtype.itemsize
            for i, a, b in zip(part, ends - size * self.dtype.itemsize, ends, strict=True):
                out[i] = ids[a:b]
        return out

    def _by_library(self, words: list[bytes]) -> list[bytes]:
        e = self.library.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(e.ids, dtype=self.dtype), np.array(e.word_ids, dtype=np.int64)
        cut = np.searchsorted(of, np.arange(len(words) + 1)) * self.dtype.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        plain, odd = [], []
        for w in words:
            m = _PLAIN.match(w) if len(w) <= 64 else None
            (plain if m else odd).append((w, m[1], m[2]) if m else w)
        marks = sorted({m for _, _, m in plain if m})
        for k in range(0, len(marks), 1000):
            self.cache.update(zip(marks[k : k + 1000], self._by_library(marks[k : k + 1000]), strict=True))
        for (w, _, mark), ids in zip(plain, self._merge([x[1] for x in plain]), strict=True):
            self.cache[w] = ids + self.cache[mark] if mark else ids
        for k in range(0, len(odd), 1000):
            self.cache.update(zip(odd[k : k + 1000], self._by_library(odd[k : k + 1000]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """None counts as the empty text; text that holds a special token's sign goes to the library whole."""
        if not self.by_words:
            made = self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in made]
        words: list[list[bytes] | None] = []
        for t in texts:
            if t and any(x in t for x in self.signs):
                words.append(None)
                continue
            raw = (t or "").encode()
            # a combining mark may join with the letter before it, by its case
            words.append((raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split())
        every = set(chain.from_iterable(w for w in words if w))
        new = every.difference(self.cache)
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        out = []
        for t, w in zip(texts, words, strict=True):
            if w is None:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes())
            else:
                out.append(b"".join(map(get, w)))
        once = []
        for w in new:
            slot = hash(w) & (MET - 1)
            if not self.met[slot]:
                self.met[slot] = 1
                once.append(w)
        over = len(self.cache) - len(once) - CACHE_WORDS
        if over > 0:
            once += islice(new.difference(once), over)
        for w in once:
            del self.cache[w]
        if once:
            self.forgotten += len(once)
            if self.forgotten > RENEW * CACHE_WORDS:
                self.cache.clear()
                self.met = bytearray(MET)
                self.forgotten = 0
        return out
