import re

from cases import corpus
from pyspark.sql import functions as F

from lectern.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    gone = [False] * len(w)
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            gone[i : i + 8] = [True] * 8
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(w), sum(gone)
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = n < 20 or 100 * repeat > 30 * n
    chars = sum(map(len, w))
    kept = not (failed or 100 * symbols > 30 * n or 100 * text.count("!") > 50 * n or chars < 2 * n or chars > 15 * n or 100 * dup > 40 * len(text.split("\n")))
    return n, chars, symbols, dup, repeat, failed, kept


def test_same_as_brute_force(spark):
    rows = corpus(2) + [(900, "a b c d e f g h " * 40), (901, "x# " * 30), (902, "WORD!! " * 12 + " ".join(map(str, range(12)))), (903, "a b c d e f g h i j k l\n" * 3), (904, "one two three four five six seven eight nine\n" * 2 + " ".join(map(str, range(99))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as `odd.name`")
    for r in Q.judged(docs).collect():
        own = [brute(t) for d, t in rows if d == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) in own


def test_cascade_order_is_rejection_per_cost():
    measure = lambda w: Q.Measure(None, (), w)
    known = {"x": measure(1.0), "y": measure(4.0), "z": Q.Measure(None, (), 1.0, ("y",))}
    rules = [Q.Rule("a", None, ("y",)), Q.Rule("b", None, ("x",)), Q.Rule("c", None, ("z",)), Q.Rule("d", None, ("x",))]
    # a and d reject the same text; b is the cheapest that rejects, and then d costs nothing more
    says = lambda **k: (10, {"a": False, "b": False, "c": False, "d": False} | k)
    verdicts = [says(a=True, d=True), says(b=True), says(), says(c=True)]
    assert [r.name for r in Q.ordered(rules, verdicts, measures=known)] == ["b", "d", "c", "a"]
    assert [r.name for r in Q.ordered(rules, verdicts, {"y"}, known)][0] == "a"


def test_later_rules_are_not_evaluated(spark):
    """A measure that fails on a rejected text is never taken of it, in the column form and in the filter."""
    boom = Q.Measure(lambda df, t: df.withColumn("boom", F.when(F.contains(t, F.lit("no")), F.raise_error(F.lit("evaluated")).cast("long")).when(F.col(t).isNotNull(), 0)), ("boom",), 5.0)
    size = Q.Measure(lambda df, t: df.withColumn("size", F.when(F.contains(t, F.lit("no")), 0).otherwise(1)), ("size",), 1.0)
    rules = [Q.Rule("late", F.col("boom") > 0, ("boom",)), Q.Rule("early", F.col("size") == 0, ("size",))]
    docs = spark.createDataFrame([(1, "no"), (2, "yes"), (3, "no no")], "doc_id long, text string")
    args = {"cascade": rules, "measures": {"boom": boom, "size": size}, "sample_rows": 0}
    assert {r.doc_id: r.rule for r in Q.judged(docs, keep=["doc_id"], always=(), **args).collect()} == {1: "early", 2: None, 3: "early"}
    assert [r.doc_id for r in Q.filtered(docs, **args).collect()] == [2]
    assert Q.judged(docs, always=("size",), **args).columns == ["doc_id", "text", "size", "kept", "rule"]


def test_very_long_text(spark):
    text = " ".join(str(i % 100_003) for i in range(300_000))
    r = Q.judged(spark.createDataFrame([(1, text), (2, "w" * 2_000_000)], "doc_id long, text string"), keep=["doc_id"]).collect()
    assert {x.doc_id: (x.n_words, x.n_repeat_words, x.kept) for x in r} == {1: (300_000, 300_000, False), 2: (1, 0, False)}


def test_filter_agrees_with_verdict(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string").selectExpr("*", "1 as kept", "2 as `n_words`", "3 as `odd.name`")
    kept = sorted(str(r.doc_id) + str(r.text) for r in Q.filtered(docs).collect())
    assert kept == sorted(str(d) + str(t) for d, t in corpus(2) if brute(t)[-1])
    assert Q.filtered(docs).columns == docs.columns


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    out = Q.judged(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    count = {(r.quality, r.kept): r["count"] for r in out.where("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert count[1, True] / (count[1, True] + count.get((1, False), 0)) > 0.99
    assert count[0, False] / (count[0, False] + count.get((0, True), 0)) > 0.9


def test_empty_table(spark):
    assert Q.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0
