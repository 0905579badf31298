"""Queries of the extraction operators.

The stored texts hold few figures, so a figure, money or date phrase made from
the row's key is put before each text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import extract as X
from lectern.plans._query import query, table


def _with(spark, d, phrase):
    return table(spark, d, "documents").select("doc_id", F.concat(phrase, F.lit(" "), "text").alias("text"), "n_chars")


def _id():
    return F.col("doc_id").cast("string")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^0-9.,])', ' \1 ', 'g'), '(?:^|[^0-9.,])([0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)(?:$|[^0-9.,])', 1) AS f
  FROM (SELECT doc_id, '1.' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ',5 and ' || (doc_id % 90) || '.25 or ' || (doc_id % 7) || ',5' AS text FROM documents)),
v AS (SELECT doc_id, f, list_sum(list_transform(f, lambda s: CASE WHEN regexp_matches(s, '^\d{1,3}(,\d{3})+\.\d+$') THEN 3 WHEN regexp_matches(s, '^\d+\.(\d{1,2}|\d{4,})$') THEN 2 ELSE 0 END)) AS p,
  list_sum(list_transform(f, lambda s: CASE WHEN regexp_matches(s, '^\d{1,3}(\.\d{3})+,\d+$') THEN 3 WHEN regexp_matches(s, '^\d+,(\d{1,2}|\d{4,})$') THEN 2 ELSE 0 END)) AS c FROM t)
SELECT doc_id, array_to_string(f, ' ') AS figures, CASE WHEN p > c THEN 'point' WHEN c > p THEN 'comma' ELSE 'unknown' END AS convention FROM v
""")
def x01_decimal_convention(spark, d):
    n = F.col("doc_id")
    phrase = F.concat(F.lit("1."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(",5 and "), (n % 90).cast("string"), F.lit(".25 or "), (n % 7).cast("string"), F.lit(",5"))
    t = table(spark, d, "documents").select("doc_id", phrase.alias("text"))
    return t.select("doc_id", F.array_join(X.figures(F.col("text")), " ").alias("figures"), X.decimal_convention(F.col("text")).alias("convention"))


@query(r"""
WITH f AS (SELECT p_partkey, c AS convention, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN p_size || '.234,5' WHEN 2 THEN p_size || ',5' ELSE p_size || ',234.5' END AS raw
  FROM part, (VALUES ('point'), ('comma'), ('unknown')) AS v(c)),
g AS (SELECT *, regexp_matches(raw, '^\d{1,3}[.,]\d{3}$') AS three, length(raw) - length(replace(replace(raw, '.', ''), ',', '')) AS seps, regexp_extract(raw, '([.,])', 1) AS sep, regexp_extract(raw, '([.,])\d+$', 1) AS last FROM f),
h AS (SELECT *, CASE WHEN seps = 2 THEN last WHEN three AND convention = 'unknown' THEN NULL WHEN three AND sep = CASE WHEN convention = 'point' THEN ',' ELSE '.' END THEN NULL WHEN seps = 1 THEN sep END AS dec FROM g)
SELECT p_partkey, convention, raw,
  CAST(CASE WHEN dec IS NULL THEN replace(replace(raw, '.', ''), ',', '') ELSE replace(replace(raw, CASE WHEN dec = '.' THEN ',' ELSE '.' END, ''), dec, '.') END AS DOUBLE) AS value,
  (seps = 1 AND three AND convention = 'unknown') OR (seps = 1 AND NOT three AND convention <> 'unknown' AND sep <> CASE WHEN convention = 'point' THEN '.' ELSE ',' END) AS ambiguous
FROM h
""")
def x02_parse_figures(spark, d):
    n = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    raw = F.when(n % 4 == 0, F.concat(size, F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 4 == 1, F.concat(size, F.lit(".234,5"))).when(n % 4 == 2, F.concat(size, F.lit(",5"))).otherwise(F.concat(size, F.lit(",234.5")))
    f = table(spark, d, "part").select(n, raw.alias("raw"), F.explode(F.array(F.lit("point"), F.lit("comma"), F.lit("unknown"))).alias("convention"))
    return f.select("p_partkey", "convention", "raw", X.parse_figure(F.col("raw"), F.col("convention")).alias("v")).select("p_partkey", "convention", "raw", "v.value", "v.ambiguous")


@query("""
SELECT doc_id, 0::BIGINT AS ord, CASE WHEN doc_id % 2 = 0 THEN 'US$ ' || doc_id || ' million' ELSE doc_id || ' thousand EUR' END AS raw_trim,
  CAST(doc_id * CASE WHEN doc_id % 2 = 0 THEN 1000000 ELSE 1000 END AS DOUBLE) AS amount, CASE WHEN doc_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE doc_id % 3 WHEN 0 THEN 'penalty' WHEN 1 THEN 'cap' ELSE 'unspecified' END AS role
FROM documents
""")
def x03_x04_x13_money(spark, d):
    n = F.col("doc_id")
    cue = F.when(n % 3 == 0, "the revenue and penalty, ").when(n % 3 == 1, "penalty with a cap of ").otherwise("some ")
    phrase = F.concat(cue, F.when(n % 2 == 0, F.concat(F.lit("US$ "), _id(), F.lit(" million"))).otherwise(F.concat(_id(), F.lit(" thousand EUR"))), F.lit("."))
    m = X.money(table(spark, d, "documents").select("doc_id", phrase.alias("text")), "doc_id", "text")
    return m.select("doc_id", "ord", F.trim("raw").alias("raw_trim"), "amount", "currency", "role")


@query("""
SELECT doc_id, 'percent' AS kind, doc_id % 100 + 0.5::DOUBLE AS value FROM documents
UNION ALL SELECT doc_id, 'points', CAST(doc_id % 9 AS DOUBLE) FROM documents
UNION ALL SELECT doc_id, 'points', round(CAST(doc_id % 50 AS DOUBLE) * 0.01, 9) FROM documents
""")
def x05_percents(spark, d):
    n = F.col("doc_id")
    phrase = F.concat((n % 100).cast("string"), F.lit(",5 % and "), (n % 9).cast("string"), F.lit(" percentage points but "), (n % 50).cast("string"), F.lit(" basis points"))
    t = table(spark, d, "documents").select("doc_id", phrase.alias("text"))
    return t.select("doc_id", F.explode(X.percents(F.col("text"))).alias("p")).select("doc_id", "p.kind", F.round("p.value", 9).alias("value"))


@query("""WITH y AS (SELECT doc_id, 1800 + n_chars % 400 AS y, regexp_extract_all(regexp_replace(text, '([^0-9]+)', ' ', 'g'), '[0-9]+') AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([2024, y], list_transform(list_filter(t, lambda x: length(x) = 4 AND x BETWEEN '1800' AND '2199'), lambda x: x::INT)))), '|') AS years FROM y""")
def x07_years(spark, d):
    phrase = F.concat(F.lit("in 2024, not 12024 or 20245, since "), (F.lit(1800) + F.col("n_chars") % 400).cast("string"), F.lit(". "), "text")
    t = table(spark, d, "documents").select("doc_id", phrase.alias("text"))
    return t.select("doc_id", F.array_join(F.transform(X.years(F.col("text")), lambda y: y.cast("string")), "|").alias("years"))


@query("""
SELECT doc_id, '2023-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS raw, make_date(2023, doc_id % 9 + 1, 10 + doc_id % 10) AS date, false AS ambiguous FROM documents
UNION ALL SELECT doc_id, (doc_id % 28 + 1) || '/' || (doc_id % 12 + 1) || '/2021', make_date(2021, doc_id % 12 + 1, doc_id % 28 + 1), doc_id % 28 + 1 <= 12 AND doc_id % 28 <> doc_id % 12 FROM documents
UNION ALL SELECT doc_id, (doc_id % 28 + 1) || ' march 1999', make_date(1999, 3, doc_id % 28 + 1), false FROM documents
""")
def x08_dates(spark, d):
    n = F.col("doc_id")
    phrase = F.concat(F.lit("on 2023-0"), (n % 9 + 1).cast("string"), F.lit("-1"), (n % 10).cast("string"), F.lit(", "), (n % 28 + 1).cast("string"), F.lit("/"), (n % 12 + 1).cast("string"), F.lit("/2021 and "), (n % 28 + 1).cast("string"), F.lit(" March 1999 or 99/99/2020"))
    return X.dates(table(spark, d, "documents").select("doc_id", phrase.alias("text")), "doc_id", "text")


@query("""
SELECT doc_id, (doc_id % 60) || ' working days' AS raw, CAST(doc_id % 60 AS INT) AS value, 'working_day' AS unit FROM documents
UNION ALL SELECT doc_id, 'three months', 3, 'month' FROM documents
""")
def x09_durations(spark, d):
    phrase = F.concat((F.col("doc_id") % 60).cast("string"), F.lit(" working days or Three months"))
    return X.durations(table(spark, d, "documents").select("doc_id", phrase.alias("text")), "doc_id", "text")


@query("""
SELECT doc_id, 'within' AS cue, (doc_id % 90) || ' days' AS object, 'duration' AS kind FROM documents
UNION ALL SELECT doc_id, 'no later than', '2025-01-1' || (doc_id % 10), 'date' FROM documents
""")
def x10_deadlines(spark, d):
    n = F.col("doc_id")
    phrase = F.concat(F.lit("Within a period of "), (n % 90).cast("string"), F.lit(" days and no later than 2025-01-1"), (n % 10).cast("string"), F.lit(". Until something else"))
    return X.deadlines(table(spark, d, "documents").select("doc_id", phrase.alias("text")), "doc_id", "text")


@query("""
SELECT o_custkey AS cust, 'money' AS kind, 0::BIGINT AS "start", 5::BIGINT AS "end" FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'percent', 5, 9 FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'count', 9 + o_custkey % 3, 14 FROM orders GROUP BY o_custkey
""")
def x06_x11_claim_ranges(spark, d):
    cust = table(spark, d, "orders").select(F.col("o_custkey").alias("cust")).distinct()
    spans = [("money", 0, 5), ("percent", 3, 8), ("percent", 5, 9), ("date", 8, 12), ("duration", 4, 6)]
    a = cust.select("cust", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("start"), F.lit(e).alias("end")) for k, s, e in spans])).alias("s")).select("cust", "s.kind", "s.start", "s.end")
    b = cust.select("cust", F.lit("count").alias("kind"), (9 + F.col("cust") % 3).cast("int").alias("start"), F.lit(14).alias("end"))
    return X.claim_ranges(a.unionByName(b), "cust").select("cust", "kind", "start", "end")


@query(r"""
SELECT l_orderkey, l_linenumber, raw, CASE WHEN contains(raw, '.') AND contains(raw, ',') THEN replace(replace(raw, '.', ''), ',', '.') WHEN regexp_matches(raw, '^\d{1,3}([.,]\d{3})+$') THEN replace(replace(raw, '.', ''), ',', '') ELSE replace(raw, ',', '.') END AS canonical
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN (l_orderkey % 900) || '.123,5' WHEN 1 THEN (l_orderkey % 900) || '.123' ELSE (l_orderkey % 900) || ',5' END AS raw FROM lineitem)
""")
def x14_canonical_numeral(spark, d):
    n = (F.col("l_orderkey") % 900).cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(n, F.lit(".123,5"))).when(F.col("l_linenumber") % 3 == 1, F.concat(n, F.lit(".123"))).otherwise(F.concat(n, F.lit(",5")))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return t.withColumn("canonical", X.canonical_numeral(F.col("raw")))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Agence ' || source WHEN 1 THEN source WHEN 2 THEN source END AS agency FROM documents
""")
def x16_wire_attribution(spark, d):
    s = F.col("source")
    n = F.col("doc_id") % 4
    lead = F.when(n == 0, F.concat(F.lit("Santiago, 12 may. (Agence "), s, F.lit(") one "))).when(n == 1, F.concat(F.lit("("), s, F.lit(") - one "))).when(n == 2, F.concat(F.lit("One. Reported by "), s)).otherwise("Nothing here")
    t = table(spark, d, "documents").select("doc_id", F.concat(lead, F.lit("\nnext")).alias("t"))
    return t.select("doc_id", X.wire_agency(F.split_part("t", F.lit("\n"), F.lit(1))).alias("agency"))


@query("SELECT p_partkey, 'is ' || p_name AS label FROM part WHERE len(string_split(p_name, ' ')) = 2")
def x17_short_label(spark, d):
    t = table(spark, d, "part").where("size(split(p_name, ' ')) = 2").select("p_partkey", F.concat(F.lit("it is "), "p_name", F.lit(" 42.5 of 42.5")).alias("t"))
    return t.select("p_partkey", X.short_label(F.col("t"), F.lit("42.5"), 3).alias("label"))
