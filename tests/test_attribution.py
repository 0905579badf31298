"""Speakers and roles on hand-made sentences in four languages."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import attribution as A

CASES = [
    ('"We will cut the levy next year," said Ana Ruiz, minister of finance, on Monday.', "direct_quotation", "We will cut the levy next year,", "Ana Ruiz", "minister of finance"),
    ('Dr. John Smith warned: "The fund runs dry by spring."', "direct_quotation", "The fund runs dry by spring.", "John Smith", None),
    ("“The bill costs too much for towns”, Mayor Ellen Park added.", "direct_quotation", "The bill costs too much for towns", "Ellen Park", "Mayor"),
    ("Ana Ruiz, president of the union, said that wages fell by a tenth.", "indirect_quotation", "wages fell by a tenth", "Ana Ruiz", "president of the union"),
    ("According to John Smith, the fund lost half its value.", "attributed_statement", "the fund lost half its value", "John Smith", None),
    ("The fund lost half its value, according to Ellen Park.", "attributed_statement", "The fund lost half its value", "Ellen Park", None),
    ("«La reforma baja los sueldos de todos», señaló Pedro de la Vega, vocero del gremio.", "direct_quotation", "La reforma baja los sueldos de todos", "Pedro de la Vega", "vocero del gremio"),
    ("El ministro Luis Soto dijo que la deuda baja cada mes.", "indirect_quotation", "la deuda baja cada mes", "Luis Soto", "ministro"),
    ("Según Marta Díaz, la tasa sube otra vez.", "attributed_statement", "la tasa sube otra vez", "Marta Díaz", None),
    ("« Le budget ne suffira pas cette année », a déclaré Claire Martin, économiste de la banque.", "direct_quotation", "Le budget ne suffira pas cette année", "Claire Martin", "économiste de la banque"),
    ("Selon Paul Durand, la dette baisse encore.", "attributed_statement", "la dette baisse encore", "Paul Durand", None),
    ("„Die Steuer sinkt im nächsten Jahr“, sagte Karl Weber, Sprecher der Stadt.", "direct_quotation", "Die Steuer sinkt im nächsten Jahr", "Karl Weber", "Sprecher der Stadt"),
    ("Laut Petra Klein, die Kosten steigen weiter.", "attributed_statement", "die Kosten steigen weiter", "Petra Klein", None),
    ("The committee will meet again in the spring.", "assertion", "The committee will meet again in the spring.", None, None),
    ('"Nobody knows the final price of it all."', "direct_quotation", "Nobody knows the final price of it all.", None, None),
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    sentence, form, text, speaker, role = case
    got = A.sentence_claims(sentence)
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(form, text, speaker, role)]
    assert sentence[got[0][5] : got[0][6]] == text


def test_each_quotation_goes_to_the_nearest_frame():
    s = '"The levy is far too high," said Ana Ruiz, while Luis Soto argued: "It must rise once more."'
    assert [(c[1], c[2]) for c in A.sentence_claims(s)] == [("The levy is far too high,", "Ana Ruiz"), ("It must rise once more.", "Luis Soto")]
    assert A.sentence_claims("Too short here.") == [] == A.sentence_claims("")
    inside = '"He heard that Eva Soto said nothing at all"'
    assert A.sentence_claims(inside)[0][2] is None


def test_claims_of_documents(spark):
    docs = spark.createDataFrame([(1, " ".join(c[0] for c in CASES[3:6])), (2, None), (3, ""), (4, "x" * 100_000 + " and four more words here.")], "doc_id long, text string").withColumn("no", F.lit(1)).drop("no")
    rows = A.candidate_claims(docs, "doc_id", "text").collect()
    assert [(r.no, r.form, r.speaker) for r in sorted(rows, key=lambda r: (r.doc_id, r.no)) if r.doc_id == 1] == [(0, "indirect_quotation", "Ana Ruiz"), (1, "attributed_statement", "John Smith"), (2, "attributed_statement", "Ellen Park")]
    assert {r.doc_id for r in rows} == {1, 4}
