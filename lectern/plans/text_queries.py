"""Queries of the normalisation and tokenisation operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.functions.arrays import spread
from lectern.operators import segment
from lectern.plans._query import query, table

NORM = T.sql_normalise("text")
TOKENS = f"regexp_extract_all({NORM}, '{G.WORD}')"


@query(f"SELECT doc_id, {NORM} AS norm, {T.sql_fold('text')} AS folded FROM documents")
def t01_t02_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"), T.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, length({T.sql_fold('text')}) = length(text) AS same_length, md5({T.sql_fold('text')}) AS folded_md5 FROM documents")
def t03_length_preserving_fold(spark, d):
    folded = T.fold(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (F.length(folded) == F.length("text")).alias("same_length"), F.md5(folded).alias("folded_md5"))


@query("""
SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, 'e', 'ﬁ'), 'a', chr(173)), 'ﬁ', 'fi'), chr(173), ''),
  '(\\p{L})-[ \\t]*\\n[ \\t]*(\\p{Ll})', '\\1\\2', 'g') AS plain
FROM documents
""".replace("\\\\", "\\"))
def t04_t05_substitute_rejoin(spark, d):
    marked = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("ﬁ")), F.lit("a"), F.lit("\xad"))
    return table(spark, d, "documents").select("doc_id", T.rejoin_hyphens(T.substitute(marked)).alias("plain"))


@query(r"""
SELECT doc_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', chr(10) || chr(10) || ' '), '[ \t]*\n[ \t]*', chr(10), 'g'),
  '\n{2,}', chr(1), 'g'), '[ \t\n]+', ' ', 'g'), chr(1), chr(10) || chr(10))) AS tidy
FROM documents
""")
def t06_collapse_whitespace(spark, d):
    broken = F.replace(F.col("text"), F.lit(". "), F.lit("\n\n "))
    return table(spark, d, "documents").select("doc_id", T.collapse_keeping_paragraphs(broken).alias("tidy"))


@query(r"""
WITH lines AS (
  SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos,
         len(string_split(text, chr(10))) AS n
  FROM documents
), edge AS (
  SELECT source, page, CASE WHEN pos <= 3 THEN 'top' || pos ELSE 'end' || (n - pos) END AS place,
         regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[0-9]+', '#', 'g') AS sig
  FROM lines WHERE (pos <= 3 OR pos > n - 3) AND length(line) BETWEEN 1 AND 160
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT e.source, place, sig, count(DISTINCT page) AS n_pages FROM edge e JOIN pages p ON e.source = p.source
WHERE pages >= 3 GROUP BY e.source, place, sig, pages HAVING count(DISTINCT page) >= greatest(2, ceil(0.02 * pages))
""")
def t07_running_lines(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return segment.running_lines(docs, "source", "page", share=0.02)


@query(f"""
WITH s AS (SELECT source, lang, {T.sql_fold("source || ' ' || lang || ' (Ltd.) — Études'")} AS f FROM (SELECT DISTINCT source, lang FROM documents))
SELECT source, lang, regexp_replace(regexp_replace(f, '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug,
       substr(sha256(source || chr(31) || lang), 1, 16) AS hash, 'src:' || substr(sha256(source || chr(31) || lang), 1, 16) AS id, true AS valid
FROM s
""")
def t10_t11_t12_ids(spark, d):
    s = table(spark, d, "documents").select("source", "lang").distinct()
    label = F.concat("source", F.lit(" "), "lang", F.lit(" (Ltd.) — Études"))
    id_ = T.make_id("src", F.col("source"), F.col("lang"))
    return s.select("source", "lang", T.slug(label).alias("slug"), T.stable_hash(F.col("source"), F.col("lang")).alias("hash"), id_.alias("id"), T.valid_id(id_).alias("valid"))


@query(r"""
SELECT page_id,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(?i)https?://', ''), '^(?i)www\.', ''), '#.*$', ''),
    '[?&](utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)=[^&]*', '', 'g'), '[?&/]+$', '')) AS canonical,
  regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host
FROM pages
""")
def t13_t14_urls_markup(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.strip_markup(F.col("html")).alias("plain"), T.host(F.col("url")).alias("host"))


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
b AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS base FROM h)
SELECT page_id, base, host = base OR ends_with(host, '.' || base) AS same FROM h, b
""".replace("\\\\", "\\"))
def t15_same_host(spark, d):
    h = table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"))
    bases = h.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("base")).distinct()
    return h.crossJoin(F.broadcast(bases)).select("page_id", "base", T.same_host(F.col("host"), F.col("base")).alias("same"))


@query("""
WITH w AS (
  SELECT DISTINCT p_name AS expansion, p_brand, string_split(p_name, ' ') AS ws FROM part
), i AS (
  SELECT expansion, p_brand, array_to_string(list_transform(list_filter(list_filter(string_split_regex(lower(expansion), '[^a-z0-9]+'), lambda x: length(x) >= 3), lambda x: x <> ''), lambda x: x[1]), '') AS ini
  FROM w
)
SELECT expansion, p_brand, ini AS initials, upper(ini) AS acronym, length(ini) >= 2 AS fits FROM i
""")
def t16_acronyms(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("expansion"), "p_brand").distinct()
    ini = T.initials(F.col("expansion"))
    return p.select("expansion", "p_brand", ini.alias("initials"), F.upper(ini).alias("acronym"), T.acronym_fits(F.upper(ini), F.col("expansion")).alias("fits"))


@query("""
WITH l AS (SELECT c_custkey, 'The ' || c_name || ' (' || c_mktsegment || ') Inc.' AS label FROM customer),
k AS (SELECT c_custkey, label, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(label), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM l)
SELECT c_custkey, label, array_to_string(list_filter(ws[2:], lambda x: NOT list_contains(['inc','ltd','ltda','llc','sa','corp','co','plc','gmbh'], x)), ' ') AS key FROM k
""".replace("\\\\", "\\"))
def t17_entity_key(spark, d):
    label = F.concat(F.lit("The "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(") Inc."))
    return table(spark, d, "customer").select("c_custkey", label.alias("label"), T.entity_key(label).alias("key"))


@query("""
WITH v AS (SELECT p_partkey, p_brand || '-' || p_size || '/' || p_partkey || '.x' AS id FROM part)
SELECT p_partkey, id, array_to_string(list_sort(list_distinct([id, replace(id, '.', ''), replace(id, '-', ' '), replace(id, '/', '-'), replace(id, '-', '/'), split_part(id, '/', 1)])), '|') AS variants FROM v
""")
def t18_variants(spark, d):
    id_ = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".x"))
    return table(spark, d, "part").select("p_partkey", id_.alias("id"), F.array_join(T.spelling_variants(id_), "|").alias("variants"))


@query(f"SELECT item_id, trim(regexp_replace(regexp_replace({NORM}, '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM benchmark")
def t19_term_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.term_key(F.col("text")).alias("key"))


@query("""
SELECT source, count(*) AS n_pages, avg(CASE WHEN n_chars > 20 THEN 1.0 ELSE 0.0 END) AS covered, CAST(sum(n_chars) AS BIGINT) AS chars,
  CASE WHEN avg(CASE WHEN n_chars > 20 THEN 1.0 ELSE 0.0 END) >= 0.95 AND avg(n_chars) >= 200 THEN 'good'
       WHEN avg(CASE WHEN n_chars > 20 THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'degraded' ELSE 'poor' END AS state
FROM documents GROUP BY source
""")
def t20_extraction_quality(spark, d):
    return segment.extraction_quality(table(spark, d, "documents"), "source", "n_chars")


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, unnest(range(len(string_split(text, chr(10))))) AS page_no FROM documents)
SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, page AS page_text,
  CAST(coalesce(sum(length(page) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM p
""")
def s05_plain_text_pages(spark, d):
    return segment.pages(table(spark, d, "documents"), "doc_id", "text", "\n")


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def g01_comparison_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", G.comparison_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_filter(regexp_extract_all({T.sql_fold('text')}, '[a-z0-9]+'), lambda w: length(w) >= 4)), lambda w: NOT list_contains({G.sql_list(G.TOPIC_STOPWORDS)}, w))), ' ') AS topic,
  array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({T.sql_fold('text')}, '\\p{{L}}{{3,}}')), lambda w: NOT list_contains({G.sql_list(G.CLAIM_STOPWORDS)}, w))), ' ') AS claim
FROM documents
""")
def g02_g03_terms(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(G.topic_terms(F.col("text"))), " ").alias("topic"), F.array_join(F.array_sort(G.claim_words(F.col("text"))), " ").alias("claim"))


@query(f"""
WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:[.,][0-9]+)?')) AS w FROM conversations)
SELECT conv_id, turn, lower(w) AS term, count(*) AS n FROM t WHERE NOT list_contains({G.sql_list(G.EXPLANATION_STOPWORDS)}, lower(w)) GROUP BY ALL
""")
def g04_explanation_bag(spark, d):
    c = spread(table(spark, d, "conversations"), ["conv_id", "turn"], G.explanation_tokens(F.col("text")), "term")
    return c.groupBy("conv_id", "turn", "term").agg(F.count("*").alias("n"))


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, list_min(s) AS least, list_max(s) AS greatest FROM (
  SELECT doc_id, CASE WHEN len(t) >= 5 THEN list_distinct([array_to_string(t[i:i+4], ' ') for i in range(1, len(t) - 3)])
    WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM t)
""")
def g05_shingles(spark, d):
    docs = table(spark, d, "documents").select("doc_id", G.comparison_tokens(F.col("text")).alias("t"))
    s = docs.select("doc_id", G.shingles(F.col("t")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.array_min("s").alias("least"), F.array_max("s").alias("greatest"))


@query(f"""
WITH t AS (SELECT doc_id, list_filter({TOKENS}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]{{1,2}}$')) AS w FROM documents)
SELECT doc_id, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n_features,
  md5(array_to_string(list_concat(w, [w[i] || '_' || w[i + 1] for i in range(1, len(w))]), ' ')) AS digest FROM t
""")
def g06_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", G.comparison_tokens(F.col("text")).alias("t"))
    f = docs.select("doc_id", G.features(F.col("t")).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n_features"), F.md5(F.array_join("f", " ")).alias("digest"))


@query(f"SELECT doc_id, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, {segment.sql_sentences('text', segment.NEWS)} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def g07_sentences(spark, d):
    return segment.sentences(table(spark, d, "documents"), "doc_id", "text", segment.NEWS)


@query(f"SELECT doc_id, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, {segment.sql_sentences('text', segment.LEGAL)} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)")
def g08_legal_sentences(spark, d):
    return segment.sentences(table(spark, d, "documents"), "doc_id", "text", segment.LEGAL)


@query(f"SELECT claim_id, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT conv_id * 1000 + turn AS claim_id, {segment.sql_sentences('text', segment.CLAIM)} AS s FROM conversations), unnest(range(1, len(s) + 1)) AS u(i)")
def g09_claim_sentences(spark, d):
    return segment.sentences(table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS claim_id", "text"), "claim_id", "text", segment.CLAIM)


@query()
def g10_clauses(spark, d):
    return segment.clauses(table(spark, d, "documents"), "doc_id", "text")


@query(r"""
WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n')) AS block, unnest(range(len(string_split_regex(text, '\n')))) AS ord FROM documents),
c AS (SELECT doc_id, ord, trim(regexp_replace(block, '\s+', ' ', 'g')) AS para FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS para_no, para FROM c WHERE length(para) >= 20
""")
def g11_paragraphs(spark, d):
    return segment.paragraphs(table(spark, d, "documents"), "doc_id", "text", r"\n")


@query("""
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 80) / 1120.0) AS BIGINT)))) AS k FROM documents)
SELECT doc_id, k AS chunk_no, 1120 * k AS char_start, substr(text, 1120 * k + 1, 1200) AS chunk FROM s
""")
def g12_chunks(spark, d):
    return segment.chunks(table(spark, d, "documents"), "doc_id", "text", size=1200, overlap=80)


@query(r"""
WITH q AS (SELECT doc_id, replace(replace(text, '. ', '" "'), ' | ', ' "') AS t FROM documents),
m AS (SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(t, '“([^“”]{8,600})”', 1), regexp_extract_all(t, '«([^«»]{8,600})»', 1)),
  list_concat(regexp_extract_all(t, '„([^„“”]{8,600})[“”]', 1), regexp_extract_all(t, '"([^"]{8,600})"', 1)))) AS quote FROM q)
SELECT doc_id, trim(quote) AS quote FROM m WHERE len(list_filter(string_split_regex(trim(quote), '\s+'), lambda w: w <> '')) >= 6 GROUP BY ALL
""")
def g13_quotations(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.replace(F.replace("text", F.lit(". "), F.lit('" "')), F.lit(" | "), F.lit(' "')))
    return segment.quotations(docs, "doc_id", "text")


@query(f"""
WITH w AS (SELECT lang, list_filter(string_split(trim(regexp_replace({NORM}, '[^a-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS w FROM documents),
g AS (SELECT lang, unnest(list_concat(list_concat([array_to_string(w[i:i+1], ' ') for i in range(1, len(w))], [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]),
  [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)])) AS phrase FROM w),
c AS (SELECT lang, phrase, count(*) AS n FROM g WHERE NOT list_contains({G.sql_list(G.TOPIC_STOPWORDS)}, split_part(phrase, ' ', 1)) AND NOT list_contains({G.sql_list(G.TOPIC_STOPWORDS)}, split_part(phrase, ' ', -1)) GROUP BY ALL HAVING count(*) >= 2)
SELECT lang, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, phrase) AS rank FROM c) WHERE rank <= 30
""")
def g14_phrases(spark, d):
    return segment.phrases(table(spark, d, "documents").select("lang", F.lower("text").alias("w")), "lang", "w", top=30)


@query("""
WITH t AS (SELECT p_type, 'of ' || p_name || ' (' || upper(array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1]), '')) || ') and' AS t FROM part),
m AS (SELECT regexp_extract(t, 'of (.*) \\(([A-Z]+)\\)', 1) AS expansion, regexp_extract(t, 'of (.*) \\(([A-Z]+)\\)', 2) AS acronym FROM t)
SELECT acronym, min(expansion) AS expansion, count(*) AS n FROM m WHERE length(acronym) >= 2
  AND list_aggregate(list_transform(string_split(lower(expansion), ' '), lambda x: length(x)), 'min') >= 3 GROUP BY acronym
""".replace("\\\\", "\\"))
def g15_abbreviations(spark, d):
    name = F.col("p_name")
    acr = F.upper(F.array_join(F.transform(F.split(name, " "), lambda x: F.substring(x, 1, 1)), ""))
    texts = table(spark, d, "part").select(F.concat(F.lit("of "), name, F.lit(" ("), acr, F.lit(") and")).alias("t"))
    return segment.abbreviations(texts, "t")


@query("""
WITH z AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, 'headline' AS zone, 1.5::DOUBLE AS weight, CAST(length(l[1]) AS BIGINT) AS chars FROM z
UNION ALL SELECT doc_id, 'dek', 1.2, length(l[2]) FROM z WHERE len(l) >= 2
UNION ALL SELECT doc_id, 'body', 1.0, length(array_to_string(l[3:], chr(10))) FROM z WHERE len(l) >= 3
""")
def g16_zones(spark, d):
    return segment.zones(table(spark, d, "documents"), "doc_id", "text")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
c AS (SELECT doc_id, ord, line, string_agg(line, ' / ') OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM s)
SELECT doc_id, ord AS line_no, context FROM c WHERE contains(line, 'License')
""")
def g17_context_window(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-1, 1)
    c = lines.withColumn("context", F.array_join(F.collect_list("line").over(w), " / "))
    return c.where(F.contains("line", F.lit("License"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "context")


@query(r"""
WITH n AS (SELECT 'Released under the MIT License.' AS needle UNION ALL SELECT 'Licensed under the Apache  License, Version 2.0.'),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, needle, CAST(instr(t, regexp_replace(needle, '\s+', ' ', 'g')) AS BIGINT) AS at FROM d, n WHERE contains(t, regexp_replace(needle, '\s+', ' ', 'g'))
""")
def g18_locate(spark, d):
    needles = spark.createDataFrame([("Released under the MIT License.",), ("Licensed under the Apache  License, Version 2.0.",)], "needle string")
    return segment.locate(table(spark, d, "documents"), "doc_id", "text", needles)
