"""Sentences and cues are searched at their signs only, with the results of searching everywhere."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import propositions as P
from lectern.operators.segment import LEGAL, NEWS, sentence_array

W = T.WORD_CHARACTER


def _before(text, abbreviations):
    """The sentences as they were cut before."""
    words = "|".join(sorted(abbreviations, key=len, reverse=True))
    held = F.regexp_replace(text, rf"(?i)(?<!{W})({words})\.", "$1\x02")
    held = F.regexp_replace(held, rf"(?<!{W})(\p{{Lu}})\.(?=\s\p{{Lu}})", "$1\x02")
    cut = F.regexp_replace(held, r"([.!?…]+[\"'»”’)]*)\s+(?=[\"'«“¿¡(\[]*[\p{Lu}0-9])", "$1\x01")
    return F.filter(F.transform(F.split(cut, "\x01"), lambda s: F.trim(F.replace(s, F.lit("\x02"), F.lit(".")))), lambda s: F.length(s) > 0)


@pytest.mark.parametrize("abbreviations", [NEWS, LEGAL])
def test_stops_are_held_as_before(spark, abbreviations):
    rng = random.Random(9)
    parts = ["art", "Arts", "ART", "no", "xno", "_no", "éno", "A", "É", "aB", "U", "S", ".", ".", ".", "..", "!", " ", " ", "\n", "2", '"', "”", "Dr", "st", "…", "𝐀"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randrange(40))),) for _ in range(800)] + [("",), ("J. R. R. Tolkien. Art. 5. End.",)]
    for r in spark.createDataFrame(rows, "t string").select("t", sentence_array(F.col("t"), abbreviations).alias("a"), _before(F.col("t"), abbreviations).alias("b")).collect():
        assert r.a == r.b, r.t


def test_each_pattern_looks_at_a_sign_first():
    """What stands before a place is looked at behind a stop or before a cue's first letter, not everywhere."""
    for cues in P.CUES.values():
        for phrases in cues.values():
            assert re.match(r"\(\?=\[[^\]]+\]\)\(\?<!", P._any(phrases)), phrases
            assert all(w.strip()[0] in P._any(phrases).split("]")[0] for w in phrases.split(","))


def test_cues_are_found_as_before(spark, monkeypatch):
    rng = random.Random(4)
    words = [w.strip() for cues in P.CUES.values() for p in cues.values() for w in p.split(",")]
    words += [w.upper() for w in words] + ["x", "xif", "3", "2020-01-02", "1999", "1,200", ",", ";", ".", "5 days", "año"]
    rows = [(rng.choice(["en", "es", "fr"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "", "\n"]) for _ in range(rng.randrange(9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "l string, t string")

    def found():
        return df.select("t", *[c.alias(n) for n, c in P.scope(F.col("t"), F.col("l")).items()]).collect()

    now, guarded = found(), P._any
    monkeypatch.setattr(P, "_any", lambda phrases: guarded(phrases).split(")", 1)[1])
    assert now == found()
    strongest = {(r.t, l): r.modality for r, (l, _) in zip(now, rows, strict=True)}
    for (t, lang), got in strongest.items():
        low = lambda m: re.search(rf"(?<!\w)(?:{'|'.join(sorted((w.strip() for w in P.CUES[lang][m].split(',')), key=lambda w: -len(w)))})(?!\w)".replace(" ", r"\s+"), t, re.I) if lang in P.CUES else None
        assert got == next((m for m in P.MODALITIES if low(m)), "asserted") or not t.isascii(), t


def test_charged_sentences_are_written_once_and_folded(spark, monkeypatch):
    from lectern.operators import framing as N

    written = []
    monkeypatch.setattr(N, "cut_lineage", lambda df: written.append(df.columns) or df)
    df = spark.createDataFrame([(1, "A brutal raid\nNo more.\nShe said “a brutal raid” and left.")], "id long, text string")
    r = N.loaded_language(df, "id", "text").first()
    assert (r.id, r.words, r.n_terms) == (1, 12, 2)
    assert written == [["id", "no", "weight", "quoted", "folded"]]


def test_every_evaluative_word_counts(spark):
    from lectern.operators import framing as N

    words = N.EVALUATIVE.split("(?:")[1].split(")")[0].split("|")
    rows = [(w, f"It is {w.upper()}, they think") for w in words] + [("none", "un-terribly dull")]
    got = {r.group: r.evaluative for r in N.opinion_as_fact(spark.createDataFrame(rows, "group string, sentence string"), F.lit("news")).collect()}
    assert got == {w: 1 for w in words} | {"none": 0}
