"""Byte-pair encoding by speculation and verification, and decoding.

Words are proposed greedily, longest vocabulary entry first. A sequence of
tokens is what exact merging gives if every adjacent pair is; for a pair this
is tested for all words of a batch at once by walking down the merge trees on
both sides of the border: the younger token is split, and the pair fails if its
facing parts would have merged earlier. Words with a failing pair are merged
exactly. Words seen before come from a bounded cache of the Python worker.

The vocabulary is a tokenizers JSON file with byte-level pieces and a word-end
suffix; it is read on the driver (at most MAX_FILE bytes) and broadcast. Special
tokens inside a text become their ids, as in the tokenizers library. Null and
empty texts have no tokens and decode to nothing. Other columns are kept unless
a result column has their name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _stages

MAX_FILE = 64 << 20
CACHE_WORDS = 300_000
END = "\x00"
SUFFIX = "</w>"
NO_MERGE = 1 << 40

# The pre-tokenisation pattern of the vocabulary file, with its white space spelled out.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters first: no other branch starts with one.
PIECES = rf"\p{{L}}+|\p{{N}}|{SHORT}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_PIECES = rf"[a-z]+|[0-9]|{SHORT}|[^\t-\r a-z0-9]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ids = {t[: -len(SUFFIX)] + END if t.endswith(SUFFIX) else t: i for t, i in vocab.items()}
        self.longest = max(map(len, self.ids))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(self.names) + 1
        self.rank, self.part = np.full(size, -1, np.int64), np.zeros((size, 2), np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        codes = np.empty(len(pairs), np.int64)
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            codes[k] = x * size + y
            self.rank[z], self.part[z] = k, (x, y)
            self.merge[x, y] = (k, z)
        self.size, order = size, np.argsort(codes)
        self.codes, self.code_rank = codes[order], order
        self.letters = byte_letters()
        self.pattern = regex.compile(PIECES)
        self.ascii_pattern = re.compile(ASCII_PIECES)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[str, str, int]] = {}

    # --- words ---

    def words(self, text: str) -> list[str]:
        """Pre-tokenised words; special tokens stand as themselves after END."""
        if self.split is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, piece in enumerate(self.split.split(text)):
            if k % 2:
                out.append(END + piece)
            else:
                out += self._plain(piece)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        # letter by letter: a final sigma has no form of its own
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _spelled(self, word: str) -> str:
        if not word.isascii() or not word.isprintable():
            word = "".join([self.letters[b] for b in word.encode()])
        return word + END

    def greedy(self, spelled: str) -> list[int]:
        ids, out, at, n, longest = self.ids, [], 0, len(spelled), self.longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                token = ids.get(spelled[at:end])
                # END is no letter: it belongs to the last one
                if token is not None and end != n - 1:
                    break
            else:
                end = n if at == n - 2 else at + 1
                token = ids[spelled[at:end]]
            out.append(token)
            at = end
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does exact merging of both spellings give this pair?"""
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        l, r, limit = left.copy(), right.copy(), np.full(len(left), NO_MERGE)
        while len(live):
            code = l * self.size + r
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            first = np.where(self.codes[at] == code, self.code_rank[at], NO_MERGE)
            bad = first < limit
            good[live[bad]] = False
            rl, rr = self.rank[l], self.rank[r]
            on = ~bad & (np.maximum(rl, rr) >= 0)
            live, l, r, rl, rr = live[on], l[on], r[on], rl[on], rr[on]
            cut_left = rl > rr
            # of two equal merges the left one comes first
            limit = np.where(cut_left, rl, rr + 1)
            l, r = np.where(cut_left, self.part[l, 1], l), np.where(cut_left, r, self.part[r, 0])
        return good

    def exact(self, spelled: str) -> list[int]:
        """Merging by rank, leftmost first, with a heap."""
        letters = [*spelled[:-2], spelled[-2:]]
        toks = [self.ids[x] for x in letters]
        n = len(toks)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, toks[i], toks[i + 1]) for i in range(n - 1) if (m := self.merge.get((toks[i], toks[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or toks[i] != a or toks[j] != b:
                continue
            toks[i] = self.merge[a, b][1]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((toks[p], toks[q]))):
                    heapq.heappush(heap, (m[0], p, toks[p], toks[q]))
        return [t for t, ok in zip(toks, alive, strict=True) if ok]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words: proposals, one test of all their pairs, exact merging of the rest."""
        out: list[list[int]] = []
        spelled: list[str] = []
        if not words:
            return out
        for w in words:
            if w[0] == END and w[1:] in self.special:
                spelled.append("")
                out.append([self.special[w[1:]]])
            else:
                s = self._spelled(w)
                spelled.append(s)
                out.append(self.greedy(s))
        flat = np.fromiter((t for o in out for t in o), np.int64)
        ends = np.cumsum([len(o) for o in out])
        owner = np.repeat(np.arange(len(out)), np.diff(ends, prepend=0))
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)
            for k in np.unique(owner[inner[~good[back]]]).tolist():
                out[k] = self.exact(spelled[k])
        return out

    def learn(self, words: list[str]) -> list[tuple[str, str, int]]:
        """For distinct words their ids and names, as text with a space after each, and the number of tokens."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        for w, ids in zip(new, self.encode_words(new), strict=True):
            known[w] = " ".join(map(str, ids)) + " ", " ".join([self.names[i] for i in ids]) + " ", len(ids)
        return [known[w] for w in words]

    def decode(self, ids) -> str:
        """Token names joined by one space: the vocabulary file names no decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])


def codec(raw: bytes) -> Codec:
    cache = K.process_cache()
    key = ("bpe", hashlib.sha256(raw).digest())
    if key not in cache:
        cache[key] = Codec(raw)
    return cache[key]


def load(spark, path: str):
    size = os.path.getsize(path)
    if size > MAX_FILE:
        raise ValueError(f"{path}: {size} bytes; the vocabulary is broadcast and may have {MAX_FILE}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _groups(texts: list[str], limit: int = 1 << 20):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _group(c: Codec, texts: list[str], want_ids: bool, want_text: bool, cols: dict[str, list]) -> None:
    """Results of some texts: each distinct word is encoded once, and the texts' strings are gathered by Arrow."""
    flat: list[str] = []
    ends = []
    for t in texts:
        flat += c.words(t)
        ends.append(len(flat))
    coded = pa.array(flat, pa.large_string()).dictionary_encode()
    index = coded.indices
    ids, names, counts = zip(*c.learn(coded.dictionary.to_pylist()), strict=True) if flat else ((), (), ())
    total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[index.to_numpy()])]) if flat else np.zeros(1, np.int64)
    for field, parts in (("ids", ids), ("decoded", names)):
        joined = pa.array(parts, pa.large_string()).take(index)
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, np.int64) if len(flat) else np.zeros(1, np.int64)
        view, lo = memoryview(data or b""), 0
        for hi in ends:
            # the last space is no part of the text
            own = view[offsets[lo] : max(offsets[lo], offsets[hi] - 1)]
            cols[field + "_sha256"].append(hashlib.sha256(own).hexdigest())
            if field == "ids":
                cols["n_tokens"].append(int(total[hi] - total[lo]))
                if want_ids:
                    cols["token_ids"].append(np.fromstring(bytes(own), np.int32, sep=" "))
            elif want_text:
                cols["decoded"].append(bytes(own).decode())
            lo = hi


def _encoder(raw, want_ids: bool, want_text: bool, names: list[str], kinds: list[pa.DataType]):
    def run(batches):
        c = codec(raw.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("__text").to_pylist()]
            cols: dict[str, list] = {n: [] for n in names}
            for lo, hi in _groups(texts):
                _group(c, texts[lo:hi], want_ids, want_text, cols)
            rest = [batch.column(n) for n in batch.schema.names if n != "__text"]
            own = [pa.array(cols[n], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, *own], names=[*(n for n in batch.schema.names if n != "__text"), *names])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, token_ids: bool = True, decoded: bool = False) -> DataFrame:
    """Columns n_tokens, ids_sha256, decoded_sha256, and on demand token_ids and decoded, beside those in `keep`."""
    results = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if token_ids:
        results["token_ids"] = ("array<int>", pa.list_(pa.int32()))
    if decoded:
        results["decoded"] = ("string", pa.string())
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results and c != "__text"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))
    raw = load(docs.sparkSession, path)
    run = _encoder(raw, token_ids, decoded, list(results), [k for _, k in results.values()])
    return _stages.arrow_map(source, run, {n: t for n, (t, _) in results.items()}, ("__text",))


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of token ids; null for null, unknown ids are skipped."""
    raw = load(tokens.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids):
        c = codec(raw.value)
        return ids.map(lambda x: None if x is None else c.decode(x.tolist()))

    return tokens.withColumn(out_col, text(ids_col))


def word_bpe() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, word_bpe(), keep=["doc_id"], token_ids=False)
