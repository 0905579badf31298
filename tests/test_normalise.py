"""Normalisation with its way back, vocabulary, profiles and types on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import normalise as M
from lectern.operators import vocabulary as V

TEXTS = ["An infor-\nmation  of\tﬁve\n\n\nwords", "  \n a \n", "", "x", "well-\nKnown", "a­b c", "one\ntwo\n\nthree   four"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_character_leads_back(text):
    done, places = M.rewrite(text)
    assert len(done) == len(places) and places == sorted(places)
    for c, p in zip(done, places, strict=True):
        assert c in T.LIGATURES.get(text[p], text[p]) or (c in " \n" and text[p] in " \t\n")
    spans = M.segments(places)
    assert sum(s["length"] for s in spans) == len(done)


def test_order_of_steps():
    assert [M.rewrite(t)[0] for t in TEXTS] == ["An information of five\n\nwords", "a", "", "x", "well- Known", "ab c", "one two\n\nthree four"]


def test_running_lines_go_and_offsets_lead_back(spark):
    body = ["first line\na\nb\nc\nd\ne", "second line\nf\ng\nh\ni\nj", "third line\nk\nl\nm\nn\no"]
    text = "\f".join(f"Report 20{k}\n{b}\npage {k}" for k, b in enumerate(body))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, t string")
    n = M.normalise_documents(docs, "id", "t").withColumn("at", F.expr("locate('second', text)") - 1)
    got = {r.id: r for r in n.select("*", M.source_offset(F.col("segments"), F.col("at")).alias("src"), M.source_offset(F.col("segments"), F.lit(10_000)).alias("past")).collect()}
    assert got[1].text == " ".join(b.replace("\n", " ") for b in body) and got[1].n_running == 2
    assert text[got[1].src :].startswith("second line") and got[1].past is None
    assert (got[2].text, got[2].segments, got[3].text) == ("", [], "short")


@pytest.mark.parametrize(("declared", "text", "want"), [("es-CL", "the the", "es"), ("tlh", "the cat of the house and the dog in the garden is on the way to the sea with that man", "en"), (None, "too short", "generic"), ("tlh", "xa xb xc xd xe xf xg xh xi xj xk xl xm xn xo xp xq xr xs xt xu", "generic"), (None, None, "generic")])
def test_profiles(spark, declared, text, want):
    df = spark.createDataFrame([(declared, text)], "d string, t string")
    assert df.select(V.profile(F.col("t"), F.col("d")).alias("p")).first().p == want


def test_types_short_forms_and_gaps(spark):
    df = spark.createDataFrame([("A levy means a charge.",), ("If it rains, wages rise by 5 percent.",), ("Wages rise by 5 percent.",), ("Members must wait until spring.",), ("Nothing else.",)], "s string")
    assert [(r.type, r.statement_type) for r in V.typed(df, "s").collect()] == [("definitional", "interpretation"), ("conditional", "fact"), ("quantitative", "fact"), ("temporal", "normative"), ("assertion_of_content", "fact")]
    r = spark.range(1).select(V.short_forms(F.lit("Housing Act: a bill for the renewal of old towns")).alias("f"), V.mechanical_synonyms(F.lit("Well-Being Act (WBA)")).alias("s")).first()
    assert r.f == ["Housing Act", "a bill for the renewal of old towns", "Housing Act: a bill"] and r.s == ["Well Being Act (WBA)", "Well-Being Act"]
    terms = spark.createDataFrame([("d", "synonyms", "Big Act"), ("d", "official_names", "big act"), ("d", "actor_terms", "Office")], "document string, set_name string, term string")
    assert {(x.set_name, x.n) for x in V.merge_terms(terms, ["document"]).collect()} == {("official_names", 2), ("actor_terms", 1)}
    assert V.gaps(terms).first().gaps == [s for s in V.SETS if s not in ("official_names", "actor_terms")]
