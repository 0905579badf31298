"""Domain tables derived from the stored ones, in SQL that both engines read.

`{name}` stands for a stored table. All derived columns are integer arithmetic
on keys, so they mean the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # published_min: minutes since the start of the year, null for some; kind and independence as small codes
    "articles": """SELECT doc_id AS id, source AS publisher, lang, text, n_chars,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7919) % 43200 END AS published_min,
        CAST(doc_id % 6 AS INT) AS kind, CAST(doc_id % 5 AS INT) AS independence,
        CASE WHEN doc_id % 13 = 5 THEN doc_id - 5 END AS derived_from FROM {documents}""",
    # texts with a lead that credits, quotes, cites or errs where the key says so; two days of news
    "dispatches": """SELECT doc_id AS id, source AS publisher, lang, n_chars, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7919) % 2880 END AS published_min,
        CAST(doc_id % 6 AS INT) AS kind, CASE WHEN doc_id % 13 = 5 THEN doc_id - 5 END AS derived_from, concat(CASE doc_id % 16
        WHEN 1 THEN concat('(Harbour Wire ', doc_id % 3, ') - ')
        WHEN 2 THEN concat('With reporting by Coastal Desk ', doc_id % 3, '. \n')
        WHEN 3 THEN concat('They said "the council of district ', doc_id % 5, ' will publish every figure next spring" and "nobody in district ', doc_id % 5, ' expected the second reading so early". ')
        WHEN 4 THEN concat('He repeats «the council of district ', doc_id % 5, ' will publish every figure next spring», as before. ')
        WHEN 5 THEN concat('Figures at https://www.example.org/data/', doc_id % 4, '?utm_source=feed (table). ')
        WHEN 6 THEN 'The levy raised 4512 per mille of the budget. '
        ELSE '' END, text) AS text FROM {documents}""",
    # texts with a charged headline, dek, quotation or sentence where the key says so
    "charged": """SELECT doc_id AS id, source, concat(CASE doc_id % 7
        WHEN 0 THEN 'A historic cash grab, a grab without shame|Critics fear a spiral. They call it brutal.|'
        WHEN 1 THEN 'Budget day|The house votes.|"This is a scandalous raid on every household." So said one. The raid, the raid, the raid and the raid went on. '
        WHEN 2 THEN 'Una amenaza con fecha|La amenaza crece.|«Es un desastre. Un saqueo sin precedentes para todos.» Nada mas. '
        ELSE '' END, text) AS text FROM {documents}""",
    "claims": """SELECT conv_id * 100 + turn AS claim_id, conv_id, turn, role AS speaker, text FROM {conversations}""",
    "evidence": """SELECT d.doc_id AS ev, d.doc_id % 40 AS claim_id, CAST(d.doc_id % 9 AS INT) AS tier, d.source, d.lang,
        CASE WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' END AS strength,
        coalesce(l.toxic, 0) = 1 AS contradicts, d.doc_id % 4 = 0 AS derived, d.doc_id % 7 = 3 AS restating, d.text,
        (d.doc_id * 31) % 2000 AS age_days, CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE (d.doc_id * 31) % 2000 END AS known_age
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "nodes": """SELECT concat('r:', r_regionkey) AS id, 'region' AS kind, r_name AS label FROM {region}
        UNION ALL SELECT concat('n:', n_nationkey), 'nation', n_name FROM {nation}
        UNION ALL SELECT concat('s:', s_suppkey), 'supplier', s_name FROM {supplier}""",
    "edges": """SELECT concat('e1:', n_nationkey) AS edge, concat('n:', n_nationkey) AS src, concat('r:', n_regionkey) AS dst, 'lies_in' AS kind, true AS supported FROM {nation}
        UNION ALL SELECT concat('e2:', s_suppkey), concat('s:', s_suppkey), concat('n:', s_nationkey), 'based_in', s_suppkey % 3 <> 0 FROM {supplier}
        UNION ALL SELECT concat('e3:', s_suppkey), concat('s:', s_suppkey), concat('s:', (s_suppkey * 7) % 50 + 1), 'cites', s_suppkey % 2 = 0 FROM {supplier}""",
    "runs": """SELECT l_orderkey * 10 + l_linenumber AS run, l_orderkey % 50 AS claim_id, CAST(l_linenumber % 6 AS INT) AS family, l_quantity > 5 AS applied,
        l_discount > 0.08 AS flipped, l_tax - l_discount AS confidence_delta,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 100 END AS framing_delta, l_discount * 2 AS explanation_delta FROM {lineitem}""",
    "registry": """SELECT s.s_suppkey AS id, s.s_name AS name, n.n_name AS jurisdiction, CAST(s.s_suppkey % 5 AS INT) AS kind, CAST(s.s_suppkey % 9 AS INT) AS tier,
        s.s_suppkey % 4 <> 0 AS enabled, s.s_suppkey % 6 <> 0 AS has_url, CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE s.s_suppkey % 3 <> 0 END AS crawl_allowed,
        CASE s.s_suppkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB' WHEN 2 THEN 'fr' ELSE 'fr-CA' END AS language, s.s_acctbal > 0 AS verified
        FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    "snapshots": """SELECT o_orderkey AS run, o_custkey AS document, o_orderdate AS created, o_orderpriority AS state, o_orderkey % 97 AS sha FROM {orders}""",
    "money": """SELECT l_orderkey AS provision, l_linenumber AS ord, l_extendedprice AS amount, concat(l_returnflag, l_linestatus) AS role FROM {lineitem}""",
    "provisions": """SELECT o_orderkey AS provision, o_custkey % 20 AS document, o_orderpriority AS mechanism, o_orderstatus AS kind, o_totalprice AS amount FROM {orders}""",
    "observations": """SELECT event_id, user_id AS url, ts, event_type, value FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {w.split("}")[0] for w in sql.split("{")[1:]}
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql_view(name: str) -> str:
    """The view as a parenthesised DuckDB subquery."""
    return "(" + VIEWS[name].replace("{", "").replace("}", "") + ")"
