"""Personal data: generated candidates, boosted trees, calibrated thresholds.

Four base kinds are exact: leftmost non-overlapping matches of fixed patterns
with a check; failing matches are dropped. Further generators with high recall
propose spans that may overlap, also of several kinds at one place: spelled-out
addresses, phone numbers without country code, national, tax and passport
numbers of several countries, bank accounts, IPv6, birth dates, street
addresses. Trees trained here on generated contexts score format, check digits
and context: cues of the own kind in four languages, cues of other kinds, and
words that tell of something else, such as versions, orders or measures. For
each kind the scores are calibrated on a fifth of the cases, and the least
threshold, at least a half, that keeps the precision asked for is taken on
another fifth. Of overlapping added spans the likeliest stays, and none touches
a base span. Offsets are code points, ends exclusive.

Null texts are empty and have no spans; repeated rows are judged alike. Other
columns are kept unless a result column has their name.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _kernels as K
from lectern.llm import _stages
from lectern.llm._boost import BoostedTrees, least_threshold, platt

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "phone_local", "national_id", "iban", "ipv6", "tax_number", "passport", "birth_date", "street_address")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
PRECISION = 0.95
LEAST_LIMIT = 0.5
TRAIN_CASES = 14_400
SEED = 77
BEFORE, AFTER = 48, 24  # characters of context

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive where the next character can't be matched again: long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        done = 0
        for m in AT.finditer(text):
            lo = at = m.start()
            while lo > done and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at:
                out.append(("email", lo, m.end()))
                done = m.end()
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- candidates --------------------------------------------------------------

_AT = r"(?:\[at\]|\(at\)|\{at\}|\bat\b|\barroba\b)"
_DOT = r"(?:\[dot\]|\(dot\)|\{dot\}|\bdot\b|\bpunto\b|\bpunkt\b|\bpoint\b)"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic|mai|juin|juil|okt|dez)[a-zéûä]{0,8}"
_STREET = r"(?:street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|way|place|pl|square)"
#: Each finds whatever may be of its kind; the trees decide. Runs are bounded, so a long text is read in linear time.
GENERATORS = {
    "email_spelled": [re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]{{0,63}} ?{_AT} ?[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?: ?{_DOT} ?[A-Za-z0-9-]{{2,30}}){{1,4}}", re.IGNORECASE)],
    "phone_local": [re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![\w-])"), re.compile(r"(?<![\w+.-])0[0-9]{8,10}(?![\w-])")],
    "national_id": [
        re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
        re.compile(r"(?<![\w-])[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D](?![\w-])"),
        re.compile(r"(?<![\w-])[0-9XYZ][0-9]{7}-?[A-Z](?![\w-])"),
        re.compile(r"(?<![\w-])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3}(?: ?[0-9]{2})?(?![\w-])"),
    ],
    "iban": [re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")],
    "ipv6": [re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")],
    "tax_number": [
        re.compile(r"(?<![\w-])[0-9]{2}-[0-9]{7}(?![\w-])"),
        re.compile(r"(?<![\w-])[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![\w-])"),
        re.compile(r"(?<![\w-])(?:[A-Z]{2} ?[0-9]{8,11}|[A-HJ-W]-?[0-9]{7}[0-9A-J])(?![\w-])"),
    ],
    "passport": [re.compile(r"(?<![\w-])(?=[A-Z0-9]{0,8}[0-9])[A-Z][A-Z0-9]{7,8}(?![\w-])"), re.compile(r"(?<![\w-])[0-9]{9}(?![\w-])")],
    "birth_date": [
        re.compile(r"(?<![\w./-])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}(?![\w/-])"),
        re.compile(rf"(?<![\w.])[0-9]{{1,2}}\.? (?:de )?{_MONTH}\.?,? (?:de )?[0-9]{{4}}(?!\w)", re.IGNORECASE),
        re.compile(rf"(?<!\w){_MONTH}\.? [0-9]{{1,2}},? [0-9]{{4}}(?!\w)", re.IGNORECASE),
    ],
    "street_address": [
        re.compile(rf"(?<!\w)[0-9]{{1,5}} (?:[A-Z][A-Za-z]{{1,20}} ){{1,3}}{_STREET}(?!\w)", re.IGNORECASE),
        re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]{2,25}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?(?!\w)"),
        re.compile(r"(?<!\w)(?:[Cc]alle|[Rr]ue|[Aa]venida|[Aa]venue|[Pp]laza|[Pp]lace) (?:de |del |la |des |du )?[A-ZÁÉÍÓÚ][\w]{2,20}(?: [A-Z][\w]{2,20})?,? [0-9]{1,4}(?!\w)"),
        re.compile(r"(?<!\w)[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:de |des |du |la )?[A-ZÉÈ][\w]{2,20}(?: [A-Z][\w]{2,20})?(?!\w)"),
    ],
}

CUES = {
    "email_spelled": ("mail", "contact", "write", "reach", "correo", "schreib", "courriel"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "cell", "móvil", "ruf", "appel"),
    "national_id": ("ssn", "social sec", "national id", "insurance n", "dni", "nif", "nino", "sécurité sociale", "identity"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte"),
    "ipv6": ("ip", "host", "address", "server", "client", "ipv6"),
    "tax_number": ("tax", "ein", "tin", "vat", "steuer", "cif", "fiscal", "tva", "ust"),
    "passport": ("passport", "pasaporte", "reisepass", "passeport", "travel doc"),
    "birth_date": ("born", "birth", "dob", "nacid", "nacimiento", "geboren", "geb.", "né ", "née", "naissance"),
    "street_address": ("address", "lives", "resid", "home", "deliver", "domicilio", "wohn", "anschrift", "adresse", "ship to"),
}
ELSE = ("version", "order", "page", "section", "isbn", "published", "updated", "invoice", "build", "issue", "part n", "serial", "model", "figure", "table", "line", "code", "released", "copyright", "since", "$", "€", "approx", "about")


def candidates(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    kinds = ["email_spelled"] * any(w in text.lower() for w in ("dot", "punto", "punkt", "point"))
    if DIGIT.search(text):
        kinds += [k for k in ADDED_KINDS if k != "email_spelled" and (k != "ipv6" or ":" in text)]
    for kind in kinds:
        own = {m.span() for p in GENERATORS[kind] for m in p.finditer(text)}
        out += [(kind, lo, hi) for lo, hi in sorted(own)]
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _dni(s: str) -> bool:
    s = s.replace("-", "")
    return len(s) == 9 and s[1:8].isdigit() and s[0] in "0123456789XYZ" and s[8] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8].translate(str.maketrans("XYZ", "012"))) % 23]


def _nearness(before: str, cues) -> float:
    """1 where a cue ends right before the span, falling with the distance; 0 without one."""
    at = max((before.rfind(c) + len(c) for c in cues if c in before), default=-1)
    return 0.0 if at < 0 else 1 / (1 + 0.1 * (len(before) - at))


def features(text: str, kind: str, lo: int, hi: int) -> list[float]:
    """Format of the span and its surroundings."""
    s, before, after = text[lo:hi], text[max(0, lo - BEFORE) : lo].lower(), text[hi : hi + AFTER].lower()
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    years = [int(g) for g in groups if len(g) == 4]
    own, other = _nearness(before, CUES[kind]), max(_nearness(before, CUES[k]) for k in ADDED_KINDS if k != kind)
    small = [int(g) for g in groups if len(g) <= 2]
    return [
        ORDER[kind], len(s), len(d), len(d) / len(s), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(set(d)), sum(c.isupper() for c in s) / len(s), sum(c in " ./-" for c in s), len({c for c in s if c in "./- "}), any(c in s for c in "([{"),
        luhn(d) if d else 0, kind == "iban" and _mod97(s), kind == "national_id" and _dni(s), own, other, own - other, _nearness(before, ELSE),
        any(c in after for c in CUES[kind]), ":" in before[-3:], before[-1:].isalnum() or before[-1:] in "$€£#v.", after[:1].isalnum() or after[:1] in "%€$",
        s[:1] == "0", min(years, default=0), max(small, default=0) <= 31, s[:1].isupper(), len(s.split()),
    ]


# --- generated cases ---------------------------------------------------------

SYLLABLES = "an ber ca de el fi go ha in jo ka la mo ne or pa ri sa to un ver wo".split()
STREETS = "Oak Maple Park Church Mill Station Hill Lincoln Victoria Spring River Garden".split()


class Planter:
    """Makes spans of a kind, and spans that look like it but are something else, each with the words before them."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 3)))

    def num(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def caps(self, n: int) -> str:
        return "".join(self.rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))

    def date(self, first: int, last: int) -> str:
        y, m, d = self.rng.randint(first, last), self.rng.randint(1, 12), self.rng.randint(1, 28)
        month = self.rng.choice("January March April May July October December".split())
        return self.rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{m}/{d}/{y}", f"{d} {month} {y}", f"{month} {d}, {y}", f"{d} de enero de {y}"])

    def iban(self) -> str:
        country, letters, size = self.rng.choice([("DE", "1314", 18), ("ES", "1428", 20), ("FR", "1527", 23), ("GB", "1611", 18), ("NL", "2321", 14), ("IT", "1829", 23)])
        body = self.num(size)
        s = f"{country}{98 - int(body + letters + '00') % 97:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.rng.random() < 0.5 else s

    def true(self, kind: str) -> str:
        pick, num, word = self.rng.choice, self.num, self.word
        if kind == "email_spelled":
            at, dot = pick([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" arroba ", " punto ")])
            s = word() + at + word() + dot + pick(["com", "org", "net", "de", "es", "fr", "co"])
            return s.upper() if self.rng.random() < 0.2 else s
        if kind == "phone_local":
            return pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(4)}/{num(3)} {num(3)}", f"0{num(9)}"])
        if kind == "national_id":
            digits = num(8)
            return pick([f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}", f"{self.caps(2)}{num(6)}{pick('ABCD')}", f"{self.caps(2)} {num(2)} {num(2)} {num(2)} {pick('ABCD')}", digits + "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23], f"{pick('12')} {num(2)} {num(2)} {num(2)} {num(3)} {num(3)} {num(2)}"])
        if kind == "iban":
            return self.iban()
        if kind == "ipv6":
            parts = [f"{self.rng.randrange(65536):x}" for _ in range(8)]
            return ":".join(parts) if self.rng.random() < 0.6 else ":".join(parts[:3]) + "::" + ":".join(parts[5:7])
        if kind == "tax_number":
            return pick([f"{num(2)}-{num(7)}", f"{num(2)} {num(3)} {num(3)} {num(3)}", f"{pick(['DE', 'FR', 'ES', 'IT'])}{num(pick([9, 11]))}", f"{pick('ABGQ')}{num(8)}"])
        if kind == "passport":
            return pick([f"{self.caps(1)}{num(8)}", f"{self.caps(2)}{num(7)}", f"C{num(2)}{self.caps(2)}{num(4)}", num(9)])
        if kind == "birth_date":
            return self.date(1925, 2015)
        return pick([f"{self.rng.randint(1, 9999)} {pick(STREETS)} {pick(['Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive'])}", f"{pick(['Linden', 'Haupt', 'Bahnhof', 'Garten'])}{pick(['straße', 'weg', 'allee', 'platz'])} {self.rng.randint(1, 200)}", f"{pick(['calle', 'Calle', 'avenida'])} {word().title()}n {self.rng.randint(1, 200)}", f"{self.rng.randint(1, 200)} {pick(['rue', 'avenue'])} {pick(['de ', 'du ', ''])}{word().title()}n"])

    def false(self, kind: str) -> str:
        """Often of the very same form: then only the context tells."""
        pick, num, word = self.rng.choice, self.num, self.word
        if self.rng.random() < 0.4 and kind not in ("email_spelled", "ipv6", "iban"):
            return self.true(kind)
        if kind == "email_spelled":
            return pick([f"{word()} at {word()} dot {word()}ing", f"look at the dot {word()}", f"{word()} at that point {word()}", f"{word()} at a point on"])
        if kind == "phone_local":
            return pick([f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}.{num(2)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(2)}-{num(3)}-{num(2)}", f"{num(2)}.{num(3)}.{num(3)}"])
        if kind == "national_id":
            return pick([f"{num(3)} {num(2)} {num(4)}", f"{self.caps(2)}{num(6)}{pick('ABCD')}", f"{num(8)}{self.caps(1)}", f"1 {num(2)} {num(2)} {num(2)} {num(3)} {num(3)}"])
        if kind == "iban":
            return self.caps(2) + num(2) + "".join(pick("ABCDEFGH0123456789") for _ in range(self.rng.randint(12, 24)))
        if kind == "ipv6":
            return ":".join(num(2) for _ in range(self.rng.randint(3, 5)))
        if kind == "birth_date":
            return pick([self.date(1990, 2026), f"{num(1)}.{num(1)}.{num(2)}", f"{num(2)}.{num(2)}.{num(3)}"])
        if kind == "street_address":
            return pick([f"{self.rng.randint(2, 99)} {word()} {word()} way", f"{self.rng.randint(2, 99)} large {word()} place", f"{self.rng.randint(2, 40)} {pick(STREETS)} Drive"])
        return pick([num(9), f"{self.caps(2)}{num(8)}", f"{num(2)}-{num(7)}", f"{num(11)}"])

    def lead(self, kind: str, positive: bool) -> str:
        """The words before: mostly a cue of the kind where it is true; else of another thing, of another kind or none."""
        pick, roll = self.rng.choice, self.rng.random()
        gap = pick([": ", " ", " is ", " no. ", ", ", " " + self.word() + " "])
        if positive:
            return (pick(CUES[kind]).strip() + gap) if roll < 0.85 else self.word() + " "
        if roll < 0.55:
            return pick(ELSE) + gap
        if roll < 0.7:
            return pick(CUES[pick([k for k in ADDED_KINDS if k != kind])]).strip() + gap
        if roll < 0.73:
            return pick(CUES[kind]).strip() + gap
        return self.word() + " "

    def filler(self, most: int) -> str:
        """Words with a stray cue now and then."""
        words = [self.word() for _ in range(self.rng.randint(0, most))]
        if words and self.rng.random() < 0.15:
            words[self.rng.randrange(len(words))] = self.rng.choice(self.rng.choice([*CUES.values(), ELSE]))
        return " ".join(words)

    def case(self, kind: str, positive: bool, head: str | None = None, tail: str | None = None) -> tuple[str, int, int]:
        """Text and the place of the span; `head` and `tail` may come from documents."""
        head = (self.filler(8) if head is None else head) + " " + self.lead(kind, positive)
        span = self.true(kind) if positive else self.false(kind)
        tail = self.rng.choice([" ", ", ", ". ", "\n", "; "]) + (self.filler(4) if tail is None else tail)
        return head + span + tail, len(head), len(head) + len(span)


def planted(planter: Planter, kind: str, positive: bool, head: str | None = None, tail: str | None = None) -> tuple[str, str, int, int] | None:
    """A case as the generators see it: the first candidate of the kind that meets the span; none where they propose nothing."""
    text, lo, hi = planter.case(kind, positive, head, tail)
    return next(((text, *c) for c in candidates(text) if c[0] == kind and c[1] < hi and c[2] > lo), None)


def training_cases(count: int = TRAIN_CASES, seed: int = SEED) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """Generated contexts with true and false spans of each added kind."""
    planter, cases, y = Planter(seed), [], []
    for k in range(count):
        positive = planter.rng.random() < 0.5
        found = planted(planter, ADDED_KINDS[k % len(ADDED_KINDS)], positive)
        if found:
            cases.append(found)
            y.append(positive)
    return cases, np.array(y, float)


def train(precision: float = PRECISION) -> dict:
    """Trees on three fifths of the cases; calibration and thresholds of each kind on a fifth each."""
    cases, y = training_cases()
    x = np.array([features(*c) for c in cases], float)
    fold = np.random.default_rng(SEED).integers(0, 5, len(y))
    trees = BoostedTrees().fit(x[fold < 3], y[fold < 3])
    score = trees.score(x)
    curve, limit = {}, {}
    for kind in ADDED_KINDS:
        own = x[:, 0] == ORDER[kind]
        curve[kind] = platt(score[own & (fold == 3)], y[own & (fold == 3)])
        slope, shift = curve[kind]
        last = own & (fold == 4)
        limit[kind] = max(LEAST_LIMIT, least_threshold(1 / (1 + np.exp(-(slope * score[last] + shift))), y[last], precision))
    return {"trees": trees, "curve": curve, "limit": limit}


def judge(model: dict, found: list[tuple[str, str, int, int]]) -> np.ndarray:
    if not found:
        return np.zeros(0)
    x = np.array([features(*f) for f in found], float)
    slope, shift = np.array([model["curve"][f[1]] for f in found]).T
    return 1 / (1 + np.exp(-(slope * model["trees"].score(x) + shift)))


def select(base: list[tuple[str, int, int]], added: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the likeliest added ones that overlap none before them, by start, then kind."""
    taken = list(base)
    used: list[tuple[int, int]] = []  # disjoint, in order
    for _, lo, hi in ordered(base):
        if used and lo < used[-1][1]:
            used[-1] = used[-1][0], max(hi, used[-1][1])
        else:
            used.append((lo, hi))
    for _, kind, lo, hi in sorted(added, key=lambda a: (-a[0], a[2], ORDER[a[1]])):
        k = bisect.bisect_left(used, (lo, lo))
        if (k == 0 or used[k - 1][1] <= lo) and (k == len(used) or used[k][0] >= hi):
            taken.append((kind, lo, hi))
            used.insert(k, (lo, hi))
    return ordered(taken)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


_RESULT = {
    **{f"n_{k}": ("long", pa.int64()) for k in BASE_KINDS},
    "base_sha256": ("string", pa.string()),
    "spans": ("string", pa.string()),
    "redacted": ("string", pa.string()),
}


def _finder(model: dict, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("__text").to_pylist()]
            base = [base_spans(t) for t in texts]
            proposed = [candidates(t) for t in texts]
            prob = iter(judge(model, [(t, *c) for t, cs in zip(texts, proposed, strict=True) for c in cs]).tolist())
            cols: dict[str, list] = {n: [] for n in names}
            for t, b, cs in zip(texts, base, proposed, strict=True):
                scored = [(next(prob), *c) for c in cs]
                spans = select(b, [s for s in scored if s[0] >= model["limit"][s[1]]])
                for k in BASE_KINDS:
                    cols[f"n_{k}"].append(sum(s[0] == k for s in b))
                cols["base_sha256"].append(hashlib.sha256(joined(ordered(b)).encode()).hexdigest())
                cols["spans"].append(joined(spans))
                if "redacted" in cols:
                    cols["redacted"].append(redact(t, spans))
            rest = [batch.column(n) for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(cols[n], _RESULT[n][1]) for n in names)], names=[*(n for n in batch.schema.names if n != "__text"), *names])

    return run


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans become <kind>; where base spans overlap, the first one names the union."""
    out, at = [], 0
    for kind, lo, hi in spans:
        if lo >= at:
            out += [text[at:lo], f"<{kind}>"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redacted: bool = True, precision: float = PRECISION) -> DataFrame:
    """Counts and spans beside the columns in `keep`; `redacted` adds the text with spans replaced."""
    names = [n for n in _RESULT if redacted or n != "redacted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names and c != "__text"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))
    cache = K.process_cache()
    if ("pii", precision) not in cache:
        cache["pii", precision] = train(precision)
    return _stages.arrow_map(source, _finder(cache["pii", precision], names), {n: _RESULT[n][0] for n in names}, ("__text",))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, keep=["doc_id"], redacted=False)
