"""Queries of the actor census: part names stand for persons, with misspelt and short forms among the mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import census as A
from lectern.plans._query import query, table
from lectern.plans.claim_queries import q

# Mentions: every third name has its last letter doubled, every seventh keeps its last word only.
MENTION = "CASE WHEN p_partkey % 7 = 0 THEN regexp_extract(p_name, '([^ ]+)$', 1) WHEN p_partkey % 3 = 0 THEN p_name || right(p_name, 1) ELSE p_name END"


def _mentions(spark, d):
    name, k = F.col("p_name"), F.col("p_partkey")
    m = F.when(k % 7 == 0, F.regexp_extract(name, "([^ ]+)$", 1)).when(k % 3 == 0, F.concat(name, F.right(name, F.lit(1)))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", m.alias("mention"))


_CANON = f"""m AS (SELECT DISTINCT {MENTION} AS name FROM part), k AS (SELECT DISTINCT p_name AS canonical FROM part),
eq AS (SELECT name, min(canonical) AS c FROM m JOIN k ON name = canonical GROUP BY name), en AS (SELECT name, min(canonical) AS c FROM m JOIN k ON ends_with(canonical, ' ' || name) GROUP BY name HAVING count(*) = 1),
nr AS (SELECT name, min(canonical) AS c FROM m JOIN k ON split_part(name, ' ', 1) = split_part(canonical, ' ', 1) AND len(string_split(name, ' ')) = len(string_split(canonical, ' ')) AND len(string_split(name, ' ')) >= 2 AND levenshtein(name, canonical) = abs(length(name) - length(canonical))
  AND 2.0 * least(length(name), length(canonical)) / (length(name) + length(canonical)) >= 0.92 GROUP BY name HAVING count(*) = 1),
cn AS (SELECT m.name, coalesce(eq.c, en.c, nr.c, m.name) AS canonical FROM m LEFT JOIN eq ON m.name = eq.name LEFT JOIN en ON m.name = en.name LEFT JOIN nr ON m.name = nr.name)"""


@query(f"WITH {_CANON} SELECT canonical, count(*) AS n, array_to_string(list_sort(list_distinct(list(mention))), '|') AS spellings FROM (SELECT {MENTION} AS mention FROM part) JOIN cn ON mention = name GROUP BY canonical")
def j15_j16_alias_merge(spark, d):
    """Short and misspelt names map to the one known name that fits, and mentions are counted under it."""
    mentions = _mentions(spark, d)
    names = A.canonical_names(mentions, "mention", table(spark, d, "part"), "p_name")
    return A.merge_aliases(mentions, "mention", names).withColumn("spellings", F.array_join("spellings", "|"))


@query("WITH a AS (SELECT n_nationkey, lower(n_name) AS alias FROM nation WHERE length(n_name) >= 5) SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, lower(c_name || ' of ' || (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey)) AS t FROM customer) JOIN a ON contains(t, alias)")
def j13_alias_containment(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home")), "c_nationkey").select("c_custkey", F.concat("c_name", F.lit(" of "), "home").alias("t"))
    return A.alias_containment(c, "c_custkey", "t", n, "n_nationkey", "n_name")


@query("""SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN 'not_applicable' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'verified' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'reported' ELSE 'not_documented' END AS affiliation
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j17_affiliations(spark, d):
    """Customers of one region have none; a filled order verifies, any order reports."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    actors = table(spark, d, "customer").join(n, "c_nationkey", "left")
    return A.affiliations(actors, "c_custkey", o.where("o_orderstatus = 'F'"), o, ~F.coalesce(F.col("n_regionkey") == 0, F.lit(False)))


@query("""SELECT doc_id, kw, CAST(instr(lower(text), kw) AS BIGINT) AS at, substr(text, CAST(greatest(1, instr(lower(text), kw) - 55) AS BIGINT), 225) AS excerpt FROM (
SELECT doc_id, text, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'version') THEN 'version' END AS kw FROM documents) WHERE kw IS NOT NULL""")
def q02_q03_page_anchor(spark, d):
    return A.page_anchors(table(spark, d, "documents"), "doc_id", "text", ["license", "version"])


_wd = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_wd} AS w FROM conversations), h AS (SELECT conv_id, turn, w, list_transform(w, lambda x: list_contains(['the', 'and', 'une', 'der', 'die', 'los'], regexp_replace({T.sql_fold('x')}, '[^a-z0-9]', '', 'g'))::INT) AS h FROM w),
r AS (SELECT conv_id, turn, w, h, unnest(range(1, greatest(1, len(w) - 11) + 1)) AS i FROM h), s AS (SELECT conv_id, turn, w, i, coalesce(list_sum(h[i:i + 11]), 0) AS hits FROM r)
SELECT conv_id, turn, start, hits, array_to_string(w[start:start + 11], ' ') AS quote FROM (SELECT conv_id, turn, any_value(w) AS w, CAST(max(hits) AS INT) AS hits, CAST(arg_max(i, (hits, -i)) AS INT) AS start FROM s GROUP BY conv_id, turn)""")
def q02_quote_window(spark, d):
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "une", "der", "die", "los")])
    c = table(spark, d, "conversations").select("conv_id", "turn", A.quote_window(F.col("text"), wanted).alias("b"))
    return c.select("conv_id", "turn", "b.start", "b.hits", "b.quote")


@query("""SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'es') AS es, count(DISTINCT lang) AS n_kinds FROM documents GROUP BY source""")
def a22_a23_feed_cards(spark, d):
    return A.feed_cards(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de", "es"])


_N = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT CAST(sum(CASE WHEN role = 'user' THEN {_N} ELSE 0 END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role <> 'user' THEN {_N} ELSE 0 END) AS BIGINT) AS completion, CAST(sum({_N}) AS BIGINT) AS total, count(DISTINCT conv_id) AS batches FROM conversations")
def a24_usage(spark, d):
    """A conversation is a batch: words sent by users, words received from assistants."""
    return A.usage(table(spark, d, "conversations"), "conv_id", "role", "text")[1]


_SIGNALS = {"licensees": r"\blicen[sc]e", "workers": r"\b(?:work|trabajo|arbeit|travail)", "families": r"\b(?:famil|kinder|hijos|enfants)"}
_SIG = ", ".join(f"CASE WHEN regexp_matches({T.sql_fold('text')}, {q(p)}) THEN '{g}' END" for g, p in _SIGNALS.items())


@query(f"WITH g AS (SELECT doc_id, unnest(list_distinct(list_filter(['speakers_' || lang, {_SIG}], lambda x: x IS NOT NULL))) AS grp FROM documents) SELECT grp, count(DISTINCT doc_id) AS n_provisions, count(*) AS n FROM g GROUP BY grp")
def a25_affected_groups(spark, d):
    return A.affected_groups(table(spark, d, "documents"), "doc_id", "text", _SIGNALS, F.concat(F.lit("speakers_"), "lang"))
