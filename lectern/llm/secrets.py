"""Secrets: exact base patterns, and a battery of randomness tests with false-discovery control.

Base kinds are leftmost non-overlapping matches of fixed patterns; matches that
are too short are dropped. The method adds `random`: runs of at least MIN_LEN
encoding characters. For each the encoding is inferred (the smallest of
ALPHABETS that holds it), and three tests ask whether the string is a uniform
draw from it: chi squared over the alphabet and over its character classes; runs
about the median and runs of one class; and serial correlation, the mean weight
of neighbouring pairs, where pairs that ordinary identifiers have weigh more.
Letters are numbered by how usual they are in words, so that words fall into few
bins. The p-values are combined by Fisher's rule. How rarely an ordinary identifier of that length
scores as well is read from generated ones, beyond their range from a normal
curve fitted to the tail of their scores, so that chances far below one in their
number have a value and a short string must look far more random than a long one. These
probabilities of a false discovery are counted over the whole corpus, by length
and level, and Benjamini-Hochberg's rule sets one level for each length class.

Texts are scanned once: spans and levels of candidates go into a table, from
which the levels are counted and the spans are chosen.

Offsets are code points, ends exclusive. Null texts are empty and have no
spans; repeated rows are judged alike. Other columns are kept unless a result
column has their name.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _stages

BASE_KINDS = ("assign", "access", "hex")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
MIN_LEN = 20
LENGTHS = (20, 24, 32, 40, 64, 128)  # lower ends of the length classes
LEVELS = 400  # quarters of a binary order: chances down to 2 ** -100
NULLS = 6000
PAIR_TOKENS = 4000
TAIL = 0.05  # share of the generated scores to which the tail is fitted
FDR = 0.05
SEED = 4

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs are maximal, so a bound inside the pattern drops exactly the short ones.
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LEN)

USUAL = "etaoinshrdlucmwfgypbvkjxqz"  # letters by their frequency in English
BOTH = "".join(c + c.upper() for c in USUAL)
#: Letters by how usual they are, then digits, then signs; smaller alphabets first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": USUAL.upper() + "234567",
    "base32_lower": USUAL + "234567",
    "base36": USUAL.upper() + "0123456789",
    "base36_lower": USUAL + "0123456789",
    "base62": BOTH + "0123456789",
    "base64": BOTH + "0123456789+/",
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _access(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _access(text: str):
    """AKIA[A-Z0-9]+ runs to the end of its letters; only then is its length judged."""
    return [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]


# --- the battery -------------------------------------------------------------

def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value of each character in each alphabet, -1 outside; its class (upper, lower, digit, other); class shares and sizes of the alphabets."""
    value = np.full((len(ALPHABETS), 128), -1, np.int64)
    kind = np.full(128, 3)
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    share = np.zeros((len(ALPHABETS), 4))
    for k, letters in enumerate(ALPHABETS.values()):
        codes = [ord(c) for c in letters]
        value[k, codes] = np.arange(len(letters))
        share[k] = np.bincount(kind[codes], minlength=4) / len(letters)
    value[0, [ord(c) for c in "ABCDEF"]] = np.arange(10, 16)
    value[-1, [ord("-"), ord("_")]] = 62, 63
    return value, kind, share, np.array([len(x) for x in ALPHABETS.values()])


VALUE, CLASS, SHARE, SIZES = _tables()


def _upper_normal(z: np.ndarray) -> np.ndarray:
    """P(Z > z), by Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi) * poly
    return np.clip(np.where(z >= 0, tail, 1 - tail), 1e-300, 1)


def _chi_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of chi squared, by Wilson and Hilferty's cube root."""
    d = np.maximum(dof, 1)
    return _upper_normal(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / np.sqrt(2 / (9 * d)))


def randomness(tokens: list[str]) -> np.ndarray:
    """Fisher-combined p-value of each token being a uniform draw from its inferred encoding."""
    m = len(tokens)
    if not m:
        return np.zeros(0)
    bare = [t.rstrip("=") for t in tokens]
    size = np.fromiter(map(len, bare), np.int64, m)
    codes = np.frombuffer("".join(bare).encode("ascii"), np.uint8).astype(np.int64)
    ends = np.cumsum(size)
    first = ends - size
    row = np.repeat(np.arange(m), size)
    fits = np.stack([np.minimum.reduceat(VALUE[k][codes], first) >= 0 for k in range(len(SIZES))])
    enc = np.argmax(fits, axis=0)  # the smallest alphabet that holds all characters
    kinds = np.stack([np.bincount(row, CLASS[codes] == k, m) for k in range(4)], axis=1)
    # one case only in hexadecimal; both cases are another encoding
    both = (enc == 0) & (np.bincount(row, (codes >= 65) & (codes <= 70), m) > 0) & (np.bincount(row, (codes >= 97) & (codes <= 102), m) > 0)
    enc = np.where(both, len(SIZES) - 2, enc)
    v = VALUE[enc[row], codes]
    alphabet = SIZES[enc]
    n = size.astype(float)
    # letters in eight equal bins of the alphabet, or four for short tokens
    bins = np.where(size >= 40, 8, 4)
    counts = np.bincount(row * 8 + v * bins[row] // alphabet[row], minlength=8 * m).reshape(m, 8)
    expected = n / bins
    live = np.arange(8) < bins[:, None]
    chi = (np.where(live, (counts - expected[:, None]) ** 2, 0) / expected[:, None]).sum(axis=1)
    p_letters = _chi_tail(chi, bins - 1)
    share = SHARE[enc]
    own = kinds.copy().astype(float)
    own[:, 1] = np.where(enc == 0, kinds[:, 0] + kinds[:, 1], own[:, 1])
    own[:, 0] = np.where(enc == 0, 0, own[:, 0])
    gap = np.where(share > 0, (own - n[:, None] * share) ** 2 / np.maximum(n[:, None] * share, 1e-9), 0)
    p_classes = _chi_tail(gap.sum(axis=1), (share > 0).sum(axis=1) - 1)
    high = v * 2 >= alphabet[row]
    inner = np.ones(len(codes), bool)
    inner[first] = False
    before = np.r_[0, np.arange(len(codes) - 1)]
    changes = np.bincount(row, inner & (high != high[before]), m)
    z = (changes - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    p_runs = 2 * _upper_normal(np.abs(z))
    # words and numbers keep to one class: fewer changes than by chance
    turns = np.bincount(row, inner & (CLASS[codes] != CLASS[codes[before]]), m)
    q, both_q = 1 - (share**2).sum(axis=1), (share * (1 - share) ** 2).sum(axis=1)
    spread = (n - 1) * q * (1 - q) + 2 * (n - 2) * (both_q - q * q)
    p_turns = _upper_normal(((n - 1) * q - turns - 0.5) / np.sqrt(np.maximum(spread, 1e-9)))
    weight, mean, var, cov = pair_weights()
    pairs = np.bincount(row, np.where(inner, weight[FOLD[codes[before]], FOLD[codes]], 0), m)
    p_serial = _upper_normal((pairs - (n - 1) * mean[enc]) / np.sqrt((n - 1) * var[enc] + 2 * (n - 2) * cov[enc]))
    stat = -2 * sum(np.log(np.clip(p, 1e-300, 1)) for p in (p_letters, p_classes, p_runs, p_turns, p_serial))
    return _chi_tail(stat, np.full(m, 10))


#: Letters without case, all digits as one, all signs as one.
FOLD = np.full(128, 27)
FOLD[65:91], FOLD[97:123], FOLD[48:58] = np.arange(26), np.arange(26), 26


def pair_weights() -> tuple[np.ndarray, ...]:
    """Weights of neighbouring characters from ordinary tokens; their mean, variance and lag covariance in each alphabet."""
    cache = K.process_cache()
    if "secret_pairs" not in cache:
        rng = random.Random(SEED + 1)
        seen = np.ones((28, 28))
        for _ in range(PAIR_TOKENS):
            codes = FOLD[np.frombuffer(ordinary_token(rng, 32).encode("ascii"), np.uint8)]
            np.add.at(seen, (codes[:-1], codes[1:]), 1)
        weight = np.log(seen / seen.sum())
        moments = []
        for letters in ALPHABETS.values():
            p = np.bincount(FOLD[[ord(c) for c in letters]], minlength=28) / len(letters)
            mean = p @ weight @ p
            moments.append((mean, p @ weight**2 @ p - mean**2, ((p @ weight) * p) @ (weight @ p) - mean**2))
        cache["secret_pairs"] = (weight, *np.array(moments).T)
    return cache["secret_pairs"]


def length_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, size, side="right") - 1


WORDS = (
    "the of and to in is that for it was with as his on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people too little state good very make world still see own men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
    + "user name data file path index value config server request version default handler service account module public static string object update delete insert buffer thread message number total header content image button widget window project release branch commit build test debug error warning package library function return license copyright privacy strasse gesellschaft entwicklung verwaltung maison developpement gouvernement ciudad informacion desarrollo".split()
)


def ordinary_token(rng: random.Random, size: int) -> str:
    """An identifier, path, number series or word row such as texts and code hold."""
    style, out = rng.randrange(8), ""
    while len(out) < size:
        word = rng.choice(WORDS)
        if style == 0:
            out += word.capitalize()
        elif style == 1:
            out += word + rng.choice("_-/")
        elif style == 2:
            out += word
        elif style == 3:
            out += word.upper() + rng.choice(["_", "", "-"])
        elif style == 4:
            out += rng.choice(["2024-", "10/", "000", "2023_", "-12-", "1000"]) + str(rng.randrange(100))
        elif style == 5:
            out += word + rng.choice([str(rng.randrange(100)), "v2", "/", "_", ""])
        elif style == 6:
            out += word.capitalize() + rng.choice([str(rng.randrange(10000)), "", "V2", "Id"])
        else:
            out += rng.choice([word, word.upper()]) + str(rng.randrange(10 ** rng.randint(1, 6)))
    return out[:size]


class Ordinary:
    """How rarely ordinary tokens of one length class score as high.

    The root of a score's negative logarithm is close to normal for ordinary
    tokens. Up to the quantile TAIL the generated scores count themselves;
    beyond it a normal curve through the quantiles TAIL and TAIL / 10 does.
    """

    def __init__(self, scores: np.ndarray):
        self.roots = np.sort(self.root(scores))
        self.knee, far = np.quantile(self.roots, [TAIL, TAIL / 10])
        z = [_normal_quantile(TAIL), _normal_quantile(TAIL / 10)]
        self.spread = max((self.knee - far) / (z[0] - z[1]), 1e-9)
        self.centre = self.knee - z[0] * self.spread

    @staticmethod
    def root(scores: np.ndarray) -> np.ndarray:
        return np.sqrt(-np.log(np.clip(scores, 1e-300, 1)))

    def chance(self, scores: np.ndarray) -> np.ndarray:
        roots = self.root(scores)
        counted = (1 + np.searchsorted(self.roots, roots, side="right")) / (1 + len(self.roots))
        return np.where(roots < self.knee, _upper_normal((self.centre - roots) / self.spread), counted)


def _normal_quantile(p: float) -> float:
    return statistics.NormalDist().inv_cdf(p)


def ordinary_scores() -> list[Ordinary]:
    """One for each length class."""
    rng = random.Random(SEED)
    out = []
    for k, lo in enumerate(LENGTHS):
        hi = LENGTHS[k + 1] if k + 1 < len(LENGTHS) else 2 * lo
        out.append(Ordinary(randomness([ordinary_token(rng, rng.randrange(lo, hi)) for _ in range(NULLS)])))
    return out


def levels(tokens: list[str], ordinary: list[Ordinary]) -> tuple[np.ndarray, np.ndarray]:
    """Length class, and level: a quarter of the binary logarithm's unit of the chance of a false discovery."""
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = randomness(tokens)
    cls = length_class(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    p = np.empty(len(tokens))
    for k in np.unique(cls):
        p[cls == k] = ordinary[k].chance(score[cls == k])
    # a string that its own encoding rejects is no secret, however ordinary tokens score
    p[score < 0.001] = 1
    return cls, np.minimum(np.floor(-np.log2(p) * 4), LEVELS - 1).astype(np.int64)


def added_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Long runs of encoding characters that touch no base span."""
    taken: list[list[int]] = []  # union of the base spans
    for _, lo, hi in base:
        if taken and lo <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], hi)
        else:
            taken.append([lo, hi])
    out, k = [], 0
    for m in LONG.finditer(text):
        lo, hi = m.span()
        while k < len(taken) and taken[k][1] <= lo:
            k += 1
        if k == len(taken) or taken[k][0] >= hi:
            out.append((lo, hi))
    return out


def thresholds(counts: list[tuple[int, int, int]], fdr: float) -> list[int]:
    """Benjamini-Hochberg by length class: the least level at which the expected share of false discoveries holds."""
    out = []
    for k in range(len(LENGTHS)):
        by_level = np.zeros(LEVELS)
        for cls, level, n in counts:
            if cls == k:
                by_level[level] += n
        above = np.cumsum(by_level[::-1])[::-1]
        chance = 2.0 ** (-np.arange(LEVELS) / 4)
        ok = np.flatnonzero((above > 0) & (chance * by_level.sum() <= fdr * above))
        out.append(int(ok[0]) if len(ok) else LEVELS)
    return out


_COUNTS = [f"n_{k}" for k in BASE_KINDS]
_RESULT = [*_COUNTS, "base_sha256", "spans", "n_random"]
_SPAN = "struct<lo:long,rank:int,hi:long,kind:string>"
_FOUND = {**dict.fromkeys(_COUNTS, "long"), "base_sha256": "string", "__base": f"array<{_SPAN}>", "__more": "array<struct<lo:long,hi:long,cls:int,level:int>>"}
_SPAN_ARROW = pa.list_(pa.struct([("lo", pa.int64()), ("rank", pa.int32()), ("hi", pa.int64()), ("kind", pa.string())]))
_MORE_ARROW = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("cls", pa.int32()), ("level", pa.int32())]))


def _scanner(ordinary: list[Ordinary]):
    """Base spans, and the candidates with their length classes and levels."""

    def run(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("__text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = [added_candidates(t, b) for t, b in zip(texts, base, strict=True)]
            cls, level = levels([t[lo:hi] for t, m in zip(texts, more, strict=True) for lo, hi in m], ordinary)
            judged = iter(zip(cls.tolist(), level.tolist(), strict=True))
            columns = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS]
            columns.append(pa.array([hashlib.sha256(",".join(f"{k}:{lo}:{hi}" for k, lo, hi in b).encode()).hexdigest() for b in base], pa.string()))
            columns.append(pa.array([[{"lo": lo, "rank": ORDER[k], "hi": hi, "kind": k} for k, lo, hi in b] for b in base], _SPAN_ARROW))
            columns.append(pa.array([[dict(zip(("lo", "hi", "cls", "level"), (lo, hi, *next(judged)), strict=True)) for lo, hi in m] for m in more], _MORE_ARROW))
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *columns], names=[*rest, *_FOUND])

    return run


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """Counts and spans beside the columns in `keep`; texts are scanned once."""
    cache = K.process_cache()
    if "secret_ordinary" not in cache:
        cache["secret_ordinary"] = ordinary_scores()
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _RESULT and c not in ("__text", "__base", "__more")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    stages = _stages.Stages(docs.sparkSession, "secrets")
    plain = [f"__k{i}" for i in range(len(kept))]
    scanned = _stages.arrow_map(source, _scanner(cache["secret_ordinary"]), _FOUND, ("__text",)).toDF(*plain, *_FOUND)
    found = stages.save(scanned, "found")
    seen = found.select(F.explode("__more").alias("m")).groupBy("m.cls", "m.level").agg(F.count("*").alias("n"))
    limits = thresholds([tuple(r) for r in seen.collect()], fdr)  # at most len(LENGTHS) * LEVELS rows
    bar = F.array(*[F.lit(x) for x in limits])
    chosen = F.filter("__more", lambda c: c["level"] >= F.get(bar, c["cls"]))
    added = F.transform(chosen, lambda c: F.struct(c["lo"].alias("lo"), F.lit(ORDER["random"]).alias("rank"), c["hi"].alias("hi"), F.lit("random").alias("kind")))
    both = F.array_sort(F.concat("__base", added))
    spans = F.array_join(F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return found.select(*plain, *_COUNTS, "base_sha256", spans.alias("spans"), F.size(chosen).cast("long").alias("n_random")).toDF(*kept, *_RESULT)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, keep=["doc_id"])
