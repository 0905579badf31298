"""Queries of normalisation, vocabulary, profiles and proposition types."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.operators import normalise as M
from lectern.operators import propositions as P
from lectern.operators import vocabulary as V
from lectern.operators.claims import MARKERS, cue
from lectern.operators.numbers import NUM, QUANTITY
from lectern.plans._query import query, table
from lectern.plans.claim_queries import q
from lectern.plans.views import sql_view, view

# A document becomes the first of three pages, all with a header and a footer; each has lines of its own
# enough that the top and the end of a page don't meet.
_BODIES = ("nu\nxi\nomicron\npi\nrho\nsigma", "middle part\nalpha\nbeta\ngamma\ndelta\nepsilon", "last part\neta\ntheta\niota\nkappa\nlambda")
_REST = "\n".join(_BODIES)


def _paged(spark, d):
    head = F.concat(F.lit("Annual Report "), F.col("doc_id").cast("string"), F.lit("\n"))
    page = lambda k, body: F.concat(head, body, F.lit(f"\npage {k}"))
    t = F.concat_ws("\f", page(1, F.concat("text", F.lit("\n" + _BODIES[0]))), page(2, F.lit(_BODIES[1])), page(3, F.lit(_BODIES[2])))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


_joined = "regexp_replace(text, '(\\p{L})-[ \\t]*\\n[ \\t]*(\\p{Ll})', '\\1\\2', 'g')"
_plain = "regexp_replace(regexp_replace(regexp_replace(x, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{2,}', chr(1), 'g'), '[ \\t\\n]+', ' ', 'g')"


@query(f"""WITH s AS (SELECT doc_id, text || chr(10) || replace('{_REST.replace(chr(10), '|')}', '|', chr(10)) AS text FROM documents), j AS (SELECT doc_id, {_joined} AS x FROM s)
SELECT doc_id, sha256(trim(replace({_plain}, chr(1), chr(10) || chr(10)))) AS sha, 2::BIGINT AS n_running FROM j WHERE NOT regexp_matches(x, '[\\x{{00AD}}\\x{{00A0}}\\x{{FB00}}-\\x{{FB02}}\\x{{2010}}-\\x{{2012}}\\f]')""")
def t09_normalise_documents(spark, d):
    """Headers and footers go, the rest is normalised in fixed order."""
    n = M.normalise_documents(_paged(spark, d), "doc_id", "text")
    return n.select("doc_id", F.sha2("text", 256).alias("sha"), "n_running")


@query("SELECT doc_id, true AS maps_back FROM documents")
def t08_offset_map(spark, d):
    """The first characters of the second part, found in the normalised text, led back to the source."""
    paged = _paged(spark, d)
    n = M.normalise_documents(paged, "doc_id", "text").withColumn("at", F.expr("locate('middle part', text)") - 1)
    back = n.select("doc_id", M.source_offset(F.col("segments"), F.col("at")).alias("source"))
    return back.join(paged, "doc_id").select("doc_id", (F.substring(F.col("text"), (F.col("source") + 1).cast("int"), F.lit(11)) == "middle part").alias("maps_back"))


@query("SELECT doc_id, 2::BIGINT AS running, 3::BIGINT AS pages FROM documents")
def a12_running_line_counts(spark, d):
    from lectern.operators.segment import pages

    return M.running_line_counts(pages(_paged(spark, d), "doc_id", "text", "\f").withColumnRenamed("page_text", "text"), "doc_id", "page_no")


_t = "f"
_type = f"CASE WHEN regexp_matches(f, {q(V.DEFINITION)}) THEN 'definitional' WHEN regexp_matches(f, {q(V.CONDITION)}) THEN 'conditional' WHEN len(list_filter(regexp_extract_all(f, {q(QUANTITY)}), lambda m: NOT regexp_matches(m, '(?i)^[a-z]') AND NOT regexp_matches(m, '[0-9][-/][0-9]'))) > 0 THEN 'quantitative' WHEN regexp_matches(f, {q(V.TEMPORAL)}) THEN 'temporal' WHEN regexp_matches(f, {q(V.PROCEDURAL)}) THEN 'procedural' ELSE 'assertion_of_content' END"
_mode = "CASE " + " ".join(f"WHEN regexp_matches(f, {q(cue(P.CUES['en'][n]))}) THEN '{n}'" for n in P.MODALITIES) + " ELSE 'asserted' END"
_LEADS = ["It means ", "If it rains, ", "Some 12 of ", "After that, ", "The procedure says ", "Members must ", "It should ", ""]


@query(f"""WITH s AS (SELECT conv_id, turn, {_LEADS}[length(text) % 8 + 1] || text AS s FROM conversations), f AS (SELECT *, {T.sql_fold('s')} AS f FROM s), k AS (SELECT conv_id, turn, {_type} AS type, {_mode} AS modality FROM f)
SELECT *, CASE WHEN type = 'definitional' THEN 'interpretation' WHEN modality IN ('obligation', 'prohibition', 'permission') THEN 'normative' WHEN modality = 'proposal' THEN 'forecast' ELSE 'fact' END AS statement_type FROM k""")
def p04_proposition_types(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (F.length("text") % 8 + 1).cast("int"))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("s"))
    return V.typed(c, "s").select("conv_id", "turn", "type", "modality", "statement_type")


_wl = "regexp_extract_all(lower(text), '\\p{L}+')"
_vote = {k: f"len(list_filter({_wl}, lambda w: list_contains({G.sql_list(m)}, w)))" for k, m in sorted(MARKERS.items())}
_best = "greatest(" + ", ".join(_vote.values()) + ")"


@query(f"""WITH t AS (SELECT doc_id, text, CASE WHEN length(source) % 2 = 0 THEN lang || '-XX' ELSE 'tlh' END AS declared FROM documents)
SELECT doc_id, CASE WHEN split_part(declared, '-', 1) IN ('en', 'es', 'fr', 'de') THEN split_part(declared, '-', 1) WHEN len({_wl}) >= 20 AND {_best} >= 0.12 * len({_wl}) THEN CASE {" ".join(f"WHEN {v} = {_best} THEN '{k}'" for k, v in _vote.items())} END ELSE 'generic' END AS profile FROM t""")
def p07_profile_selection(spark, d):
    """Half of the sources declare their language, the others one without a profile."""
    declared = F.when(F.length("source") % 2 == 0, F.concat("lang", F.lit("-XX"))).otherwise("tlh")
    return table(spark, d, "documents").select("doc_id", V.profile(F.col("text"), declared).alias("profile"))


_key = lambda x: f"trim(regexp_replace(regexp_replace({T.sql_normalise(x)}, '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_col = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_line = "split_part(text, chr(10), 1)"
_stop = "|".join(sorted(set(G.TOPIC_STOPWORDS), key=lambda w: (-len(w), w)))
_head = f"regexp_replace(array_to_string((string_split(c, ' '))[1:5], ' '), '(?i)(?: (?:{_stop}))+$', '')"
_forms = f"list_distinct(list_concat(list_filter(list_transform(string_split_regex(c, ' ?[:,–—] ?| - '), lambda p: trim(p)), lambda p: length(p) >= 8 AND length(p) < length(c)), CASE WHEN len(string_split(c, ' ')) > 5 AND length({_head}) >= 8 THEN [{_head}] ELSE [] END))"
_bare = _col("regexp_replace(c, '\\([^)]*\\)', ' ', 'g')")
_syn = f"list_distinct(list_filter([CASE WHEN contains(c, '-') THEN replace(c, '-', ' ') END, CASE WHEN {_bare} <> c AND {_bare} <> '' THEN {_bare} END], lambda v: v IS NOT NULL))"
TERMS = f"""l AS (SELECT source, text, regexp_replace(text, '[À-ɏ]', 'x', 'g') AS a, {_col(_line)} AS c FROM documents), u AS (SELECT source AS document, 1 AS place, c AS term FROM l UNION ALL SELECT source, 2, unnest({_forms}) FROM l UNION ALL SELECT source, 3, unnest(regexp_extract_all(a, {q(V.IDENTIFIER)})) FROM l
UNION ALL SELECT source, 4, unnest(regexp_extract_all(a, {q(V.ABBREVIATION)})) FROM l UNION ALL SELECT source, 8, unnest({_syn}) FROM l UNION ALL SELECT source, 10, source FROM l),
g AS (SELECT document, {_key('term')} AS key, min(place) AS place, min(term) AS term, count(*) AS n FROM u WHERE length(term) BETWEEN 2 AND 120 GROUP BY ALL), m AS (SELECT document, key, {list(V.SETS)}[place] AS set_name, term, n FROM g WHERE key <> '')"""
_w = f"round(least(1, greatest(0, CASE set_name {' '.join(f'WHEN {k!r} THEN {v}' for k, v in V.WEIGHTS.items())} ELSE {V.BASE_WEIGHT} END + 0.05 * len(string_split(term, ' ')) + least(0.08, 0.02 * (n - 1)) - CASE WHEN length(term) < 6 THEN 0.15 ELSE 0 END)), 3)"


@query(f"WITH {TERMS}, w AS (SELECT *, {_w} AS weight FROM m) SELECT document, set_name, key, term, n, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY document, set_name ORDER BY weight DESC, key) AS rank FROM w) WHERE rank <= 5")
def p09_vocabulary(spark, d):
    """A source is a document here: its texts' first lines, identifiers, abbreviations and name."""
    return V.build(V.collect(table(spark, d, "documents"), "source", "text", "source")).select("document", "set_name", "key", "term", "n", "weight", "rank")


@query(f"WITH {TERMS} SELECT document, array_to_string(list_filter({list(V.SETS)}, lambda s: NOT list_contains(list(DISTINCT set_name), s)), '|') AS gaps FROM m GROUP BY document")
def p09_vocabulary_gaps(spark, d):
    g = V.gaps(V.collect(table(spark, d, "documents"), "source", "text", "source"))
    return g.select("document", F.array_join("gaps", "|").alias("gaps"))


@query(f"""WITH l AS (SELECT item_id, {_col(_line)} AS c FROM benchmark) SELECT item_id, 'short' AS kind, unnest({_forms}) AS form FROM l UNION ALL SELECT item_id, 'synonym', unnest({_syn}) FROM l""")
def p10_short_forms(spark, d):
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    b = table(spark, d, "benchmark").select("item_id", T.collapse(title).alias("c"))
    a = b.select("item_id", F.lit("short").alias("kind"), F.explode(V.short_forms(F.col("c"))).alias("form"))
    return a.unionByName(b.select("item_id", F.lit("synonym").alias("kind"), F.explode(V.mechanical_synonyms(F.col("c"))).alias("form")))


@query("""SELECT doc_id, round(least(1.0, len(list_filter(['license', 'version', 'mit'], lambda t: contains(lower(text), t))) / 3.0 + CASE WHEN contains(lower(string_split(text, chr(10))[1]), 'the') THEN 0.2 ELSE 0 END), 3) AS relevance FROM documents""")
def r15_r16_feed_relevance(spark, d):
    return table(spark, d, "documents").select("doc_id", V.text_relevance(F.col("text"), ["license", "version", "mit"], "the").alias("relevance"))


@query(f"SELECT p_partkey, {_w} AS weight FROM (SELECT p_partkey, {list(V.SETS)}[p_size % 10 + 1] AS set_name, p_name AS term, p_size AS n FROM part)")
def r17_term_weight(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in V.SETS]), (F.col("p_size") % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", V.term_weight(s, F.col("p_name"), F.col("p_size")).alias("weight"))


@query(f"""WITH t AS (SELECT p_type AS term, 1 AS place FROM part UNION ALL SELECT p_brand, 3 FROM part UNION ALL SELECT p_type, 8 FROM part)
SELECT key, {list(V.SETS)}[place] AS set_name, term, n FROM (SELECT {_key('term')} AS key, min(place) AS place, min(term) AS term, count(*) AS n FROM t GROUP BY ALL) WHERE key <> ''""")
def d09_d10_vocabulary(spark, d):
    p = table(spark, d, "part")
    part = lambda c, s: p.select(F.lit(s).alias("set_name"), F.col(c).alias("term"))
    return V.merge_terms(part("p_type", "official_names").unionByName(part("p_brand", "identifiers")).unionByName(part("p_type", "synonyms")), [])


@query("""SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY source, lang) WHERE k <= 2""")
def k07_top_per_group(spark, d):
    return V.top_per_group(table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), "source", "lang", "n", 2)


@query(f"WITH p AS (SELECT * FROM (VALUES ('press', 1), ('press', 2), ('official', 3), ('research', 4), ('research', 0)) AS v(audience, kind)) SELECT audience, array_to_string(list_sort(list(id)), ',') AS sources FROM p JOIN {sql_view('registry')} r ON p.kind = r.kind WHERE enabled GROUP BY audience")
def j14_query_routing(spark, d):
    plan = spark.createDataFrame([("press", 1), ("press", 2), ("official", 3), ("research", 4), ("research", 0)], "audience string, kind int")
    return V.route_queries(plan, view(spark, d, "registry"))


@query("SELECT o_custkey AS document, o_orderkey AS provision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w09_numbering(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("provision"), "o_orderdate")
    return V.number_in_order(o, "document", ["o_orderdate", "provision"]).drop("o_orderdate")
