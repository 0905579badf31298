"""Values that an expression uses several times are computed once a row: findings of round 3."""

from pyspark.sql import functions as F

from lectern.operators import census, claims, normalise, segment, similarity


def _times(spark, value, name):
    """How often the plan of a column over t computes something."""
    df = spark.createDataFrame([("a b",)], "t string").select(value(F.col("t")).alias("x"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_words_of_a_language_are_cut_once(spark):
    assert _times(spark, claims.detect_language, "regexp_extract_all(") == 1
    rows = spark.createDataFrame([("the cat and the dog",), ("",), ("la casa de los perros",)], "t string")
    assert [r.x for r in rows.select(claims.detect_language(F.col("t")).alias("x")).collect()] == ["en", "xx", "es"]


def test_tokens_of_a_simhash_are_cut_once(spark):
    assert _times(spark, lambda t: similarity.token_runs(F.split(t, " ")), "split(") == 1


def test_words_of_a_quote_window_are_matched_once(spark):
    wanted = F.array(F.lit("the"))
    assert _times(spark, lambda t: census.quote_window(t, wanted), "split(") == 1
    text = "a " * 30 + "the The, the " + "b " * 30
    r = spark.createDataFrame([(text,), ("",), ("the end",)], "t string").select(census.quote_window(F.col("t"), wanted).alias("x")).collect()
    assert [(x.x.start, x.x.hits) for x in r] == [(22, 3), (1, 0), (1, 1)] and r[2].x.quote == "the end"


def test_lines_at_the_edges_of_a_page_are_cut_once(spark):
    pages = spark.createDataFrame([(1, k, f"Head\n{'body\n' * 9}same\npage {k}") for k in range(4)], "id long, page_no long, text string")
    lines = segment.running_lines(pages, "id", "page_no")
    assert {(r.place, r.sig) for r in lines.collect()} >= {("top1", "head"), ("end0", "page #"), ("end1", "same")}
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_segments_are_runs_of_neighbours():
    assert normalise.segments([]) == []
    assert normalise.segments([3, 4, 5, 9, 9, 10]) == [{"start": 0, "length": 3, "source": 3}, {"start": 3, "length": 1, "source": 9}, {"start": 4, "length": 2, "source": 9}]
