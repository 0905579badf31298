"""Propositions and their scope against a plain reading of the cues."""

import re

from pyspark.sql import functions as F

from lectern.operators import propositions as P

TEXT = (
    'If the levy of 1,200 is due, the agency shall publish it within 30 days, except for firms in zone 4. '
    'No member may vote unless present; assuming growth holds, income may rise to about 900 by 2030-06-01. '
    '"Small firm" means a firm with up to 9 staff when it was founded. Short one; The council must report no later than 12 months after entry, subject to law where it applies.'
)
SPANISH = "Si procede, la oficina deberá informar dentro de 20 días, salvo las pymes. No podrán votar los socios."


def cues(phrases):
    words = sorted((w.strip() for w in phrases.split(",")), key=lambda w: (-len(w), w))
    return re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)".replace(" ", r"\s+"), re.I)


def plain(unit, lang):
    """The cues one by one; a clause runs from a cue to the next mark."""
    own = P.CUES[lang]

    def clauses(name, ends):
        out = []
        for start in range(len(unit)):
            m = cues(own[name]).match(unit, start)
            if m:
                clause = " ".join(re.match(rf"[^{ends}]*", unit[start:])[0].split())
                if len(clause) > 3 and clause not in out:
                    out.append(clause)
        return out

    date = re.search(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)", unit)
    timed = [c for c in clauses("period", ",;.") if re.search(r"(?<!\d)(?:1[89]\d\d|2[01]\d\d)(?!\d)", c) or cues(own["unit"]).search(c)]
    return {
        "negated": bool(cues(own["negation"]).search(unit)),
        "modality": next((m for m in P.MODALITIES if cues(own[m]).search(unit)), "asserted"),
        "conditions": clauses("condition", ",;."),
        "exceptions": clauses("exception", ";."),
        "period": date[0] if date else (timed or [None])[0],
        "hedges": list(dict.fromkeys(" ".join(h.lower().split()) for h in cues(own["hedge"]).findall(unit))),
    }


def test_scope_is_that_of_a_plain_reading(spark):
    docs = spark.createDataFrame([(1, TEXT, "en"), (2, SPANISH, "es"), (3, "Wenn es regnet, bleibt alles trocken.", "de"), (4, None, "en"), (5, "", "es")], "id long, text string, lang string")
    rows = P.propositions(docs.withColumn("no", F.lit("x")).drop("no"), "id", "text", "lang").collect()
    units = {(r.id, r.no): r for r in rows if r.branch == "clause"}
    assert len([k for k in units if k[0] == 1]) == 5 and len([k for k in units if k[0] == 2]) == 2
    for (i, _), r in units.items():
        want = plain(r.text, {1: "en", 2: "es"}[i]) if i < 3 else {"negated": False, "modality": "asserted", "conditions": [], "exceptions": [], "period": None, "hedges": []}
        assert {k: r[k] for k in want} == want, r.text
    assert not any(r.id > 3 for r in rows)


def test_five_branches(spark):
    rows = P.propositions(spark.createDataFrame([(1, TEXT)], "id long, text string"), "id", "text").collect()
    got = {b: [r.text for r in sorted(rows, key=lambda r: (r.no, r.at)) if r.branch == b] for b in P.BRANCHES}
    assert got["value"][0] == "If the levy of: 1,200" and "900" in got["value"][3]
    assert got["definition"] == ["'Small firm' means a firm with up to 9 staff when it was founded"]
    assert got["assumption"] == ["assuming growth holds"]
    assert got["deadline"] == ["within 30 days", "by 2030-06-01", "no later than 12 months"]
    scoped = next(r for r in rows if r.branch == "deadline")
    assert (scoped.conditions, scoped.modality, scoped.period) == (["If the levy of 1", ], "obligation", "within 30 days")
    stipulated = next(r for r in rows if r.branch == "definition")
    assert not stipulated.negated and stipulated.modality == "asserted"


def test_long_documents_are_read_whole(spark):
    text = "\n\n".join(f"Provision {i} requires the agency to publish record number {i}." for i in range(1, 301))
    rows = P.propositions(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").where("branch = 'clause'").collect()
    assert len(rows) == 300 and max(rows, key=lambda r: r.no).text.startswith("Provision 300")
