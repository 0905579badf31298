"""Who says what: assertions in sentences with their speakers.

Quotations are intervals of a sentence, and speech frames (a name beside a verb
of saying) are intervals outside of them: every quotation goes to the nearest
frame. Sentences without a quotation are read as reported or attributed speech,
or as the text's own voice.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import spread
from lectern.operators.segment import CLAIM, sentence_array

# Verbs of saying, roles and words that open a sentence, in English and Spanish.
VERBS = """
said stated told argued warned claimed asserted noted added explained insisted declared announced
dijo afirmo afirmó senalo señaló sostuvo aseguro aseguró declaro declaró indico indicó advirtio advirtió explico explicó agrego agregó
""".split()
ROLES = """
spokesperson spokesman spokeswoman minister secretary president director economist analyst senator deputy mayor governor chair chairman chairwoman
researcher professor official representative leader adviser advisor
vocero vocera portavoz ministro ministra secretario secretaria presidente presidenta directora economista analista senador senadora diputado diputada
alcalde alcaldesa gobernador gobernadora investigador investigadora dirigente asesor asesora titular
""".split()
STARTERS = """
the a an this that these those it there he she they we his her their but and in on at for however meanwhile
el la los las un una esto esta este ese esa sus su pero sin con por para en de del no si
""".split()
# The same for French and German.
MORE_VERBS = ["a déclaré", "a dit", "a affirmé", "a expliqué", "a ajouté", "a averti", "sagte", "erklärte", "betonte", "warnte", "behauptete", "fügte hinzu"]
MORE_ROLES = "ministre président présidente directeur directrice économiste maire chercheur chercheuse porte-parole ministerin minister präsident präsidentin sprecher sprecherin bürgermeister bürgermeisterin forscher forscherin leiter leiterin".split()
MORE_STARTERS = "le les une mais dans der die das ein eine aber und im am".split()
HONORIFICS = "mr mrs ms miss dr dra prof sr sra don doña m mme herr frau sir".split()
LINKS = "de del la las los van von da di dos du el"
ACCORDING = ("according to", "según", "segun", "selon", "d'après", "laut")
THAT = ("that", "que", "qu'", "dass")

FORMS = {"direct_quotation": 0.9, "indirect_quotation": 0.8, "attributed_statement": 0.75, "assertion": 0.55}
UNATTRIBUTED = 0.75
QUOTE_WORDS, BODY_WORDS, OWN_WORDS = 3, 3, 5
#: How far a frame may stand from its quotation, and a role behind or before its name.
REACH, ROLE_AFTER, ROLE_BEFORE, ROLE_LENGTH = 120, 90, 70, 70


def _either(words, flags: str = "(?i:") -> str:
    return flags + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


UPPER = "A-ZÀ-ÖØ-ÞŁŚŽČ"
CAPITAL = rf"[{UPPER}](?:[\w'’-]*\w|\.)"
NAME = rf"{CAPITAL}(?:(?:\s+(?:{'|'.join(LINKS.split())}))*\s+{CAPITAL}){{0,4}}"
SAYS = _either(VERBS + MORE_VERBS)
QUOTATION = re.compile(r"[\"“«„]\s*([^\"“”«»„]{8,600}?)\s*[\"”»“]")
NAME_VERB = re.compile(rf"(?<!\w)(?P<name>{NAME})(?:\s*,[^,\"“«„]{{3,90}},)?\s+(?P<verb>{SAYS})(?!\w)")
VERB_NAME = re.compile(rf"(?<!\w)(?P<verb>{SAYS})\s+(?:(?:el|la|le|der|die|the)\s+)?(?:{_either(ROLES + MORE_ROLES)}\s+)?(?P<name>{NAME})")
INDIRECT = re.compile(rf"(?<!\w)(?P<name>{NAME})(?:\s*,[^,]{{3,90}},)?\s+(?P<verb>{SAYS})\s*,?\s+{_either(THAT)}\s*")
LEADING = re.compile(rf"(?<!\w){_either(ACCORDING)}\s+(?:(?:el|la|le|der|die|dem|the)\s+)?(?P<name>{NAME})(?P<more>\s*,[^,]{{3,90}}(?=,\s))?\s*,\s*")
TRAILING = re.compile(rf",\s*{_either(ACCORDING)}\s+(?P<name>{NAME})")
ROLE = re.compile(rf"(?<!\w){_either(ROLES + MORE_ROLES)}(?!\w)")


def clean_speaker(raw: str) -> str | None:
    """The name in a capture, without honorifics, roles and words that open a sentence before it; None if nothing like a name is left."""
    words = raw.strip(" ,;:").split()
    lead = {*HONORIFICS, *STARTERS, *MORE_STARTERS, *ROLES, *MORE_ROLES}
    while words and words[0].lower().strip(".") in lead:
        words = words[1:]
    return " ".join(words) if any(w[0].isupper() for w in words) else None


def role_of(sentence: str, name: str, start: int, capture: str) -> str | None:
    """The role that stands in the capture, in apposition behind the name, or before it."""
    own = ROLE.search(capture)
    if own:
        return own[0]
    at = sentence.find(name, start)
    after = sentence[at + len(name) : at + len(name) + ROLE_AFTER]
    after = re.split(r"[\"“«„.;]", after)[0]
    found = ROLE.search(after)
    if found and after.lstrip().startswith(","):
        return after[found.start() :].split(",")[0].strip()[:ROLE_LENGTH]
    found = ROLE.search(re.split(r"[\"”».;]", sentence[max(0, at - ROLE_BEFORE) : at])[-1])
    return found[0] if found else None


def frames(sentence: str) -> list[tuple[int, int, str, str | None, str]]:
    """(start, end, speaker, role, verb) of the speech frames outside quotations."""
    bare = QUOTATION.sub(lambda m: m[0][0] + "\x00" * (len(m[0]) - 2) + m[0][-1], sentence)
    out = []
    for pattern in (NAME_VERB, VERB_NAME):
        for m in pattern.finditer(bare):
            name = clean_speaker(m["name"])
            if name and not any(m.start() < e and s < m.end() for s, e, *_ in out):
                out.append((m.start(), m.end(), name, role_of(bare, name, m.start("name"), m[0]), m["verb"]))
    return out


def sentence_claims(sentence: str) -> list[tuple]:
    """(form, text, speaker, role, verb, start, end, confidence) of each assertion; start and end in the sentence."""
    out, said = [], None
    for m in QUOTATION.finditer(sentence):
        if len(m[1].split()) < QUOTE_WORDS:
            continue
        said = frames(sentence) if said is None else said
        near = [(max(f[0] - m.end(), m.start() - f[1], 0), f[0] < m.start(), f) for f in said]
        near = min((x for x in near if x[0] <= REACH), default=None)
        speaker, role, verb = near[2][2:] if near else (None, None, None)
        out.append(("direct_quotation", m[1], speaker, role, verb, m.start(1), m.end(1), FORMS["direct_quotation"] if speaker else UNATTRIBUTED))
    if out:
        return out
    for form, pattern in (("indirect_quotation", INDIRECT), ("attributed_statement", LEADING), ("attributed_statement", TRAILING)):
        m = pattern.search(sentence)
        if m:
            lo, hi = (0, m.start()) if pattern is TRAILING else (m.end(), len(sentence))
            body = sentence[lo:hi].strip(" .,")
            if len(body.split()) >= BODY_WORDS:
                name = clean_speaker(m["name"])
                role = role_of(sentence, name, m.start("name"), m["name"]) if name else None
                lo = sentence.find(body, lo)
                return [(form, body, name, role, m.groupdict().get("verb"), lo, lo + len(body), FORMS[form])]
    if len(sentence.split()) >= OWN_WORDS:
        return [("assertion", sentence, None, None, None, 0, len(sentence), FORMS["assertion"])]
    return []


_FIELDS = {"form": pa.string(), "text": pa.string(), "speaker": pa.string(), "role": pa.string(), "verb": pa.string(), "start": pa.int64(), "end": pa.int64(), "confidence": pa.float64()}


def candidate_claims(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, form, text, speaker, role, verb, start, end, confidence): the assertions of all sentences; start and end in the sentence."""
    parts = F.transform(sentence_array(F.coalesce(F.col(text_col), F.lit("")), CLAIM), lambda s, i: F.struct(i.cast("long").alias("no"), s.alias("s")))
    rows = spread(docs, [F.col(id_col).alias("id")], parts, "p").select("id", "p.no", F.col("p.s").alias("s"))

    def run(batches):
        for batch in batches:
            at, found = [], []
            for k, s in enumerate(batch.column("s").to_pylist()):
                own = sentence_claims(s)
                at += [k] * len(own)
                found += own
            take = pa.array(at, pa.int64())
            columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate(_FIELDS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("no").take(take), *columns], names=["id", "no", *_FIELDS])

    kinds = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double"}
    schema = f"id {rows.dtypes[0][1]}, no long, " + ", ".join(f"{n} {kinds[k]}" for n, k in _FIELDS.items())
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
