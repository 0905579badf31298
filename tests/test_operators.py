"""Literal cases: documented behaviour of the core operators on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as G
from lectern.operators import cluster, extract, graph, independence, propositions, scoring, segment, setlinks, similarity, store
from lectern.sources import readers
from lectern.streaming import observations


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_set_measures(spark):
    r = one(spark, j=G.jaccard(lit(1, 2, 3), lit(2, 3, 4)), c=G.containment(lit(1, 2, 3), lit(2, 3, 4)), e=G.jaccard(F.array().cast("array<int>"), lit(1)))
    assert (r.j, round(r.c, 6), r.e) == (0.5, round(2 / 3, 6), 0.0)


def test_empty_bags_and_decays(spark):
    none = F.array().cast("array<string>")
    r = one(spark, j=similarity.bag_jaccard(none, none), t=similarity.temporal(F.lit(72.0)), u=similarity.temporal(F.lit(None).cast("double")), s=similarity.saturation(F.lit(3.0), 3.0), h=similarity.hamming(F.lit(5), F.lit(3)))
    assert (r.j, round(r.t, 9), r.u, r.s, r.h) == (1.0, 0.5, 0.5, 0.5, 2)


@pytest.mark.parametrize(("raw", "convention", "value", "ambiguous"), [("1.234", "unknown", 1234.0, True), ("1.234,5", "unknown", 1234.5, False), ("12,5", "unknown", 12.5, False), ("1.234", "point", 1.234, False), ("1,234", "point", 1234.0, False)])
def test_figures(spark, raw, convention, value, ambiguous):
    r = one(spark, v=extract.parse_figure(F.lit(raw), F.lit(convention))).v
    assert (r.value, r.ambiguous) == (value, ambiguous)


def test_canonical_numerals_and_convention(spark):
    r = one(spark, a=F.transform(lit("1.234,5", "1,234.5", "1234.5", "12.345"), extract.canonical_numeral), c=extract.decimal_convention(F.lit("paid 1.234,56 in all")))
    assert (r.a, r.c) == (["1234.5", "1234.5", "1234.5", "12345"], "comma")


def test_urls(spark):
    r = one(spark, u=T.canonical_url(F.lit("https://www.x.org/a/?utm_source=z#p")), s=T.same_host(F.lit("m.x.org"), F.lit("x.org")), o=T.same_host(F.lit("mx.org"), F.lit("x.org")))
    assert (r.u, r.s, r.o) == ("x.org/a", True, False)


def test_sentences_keep_abbreviations(spark):
    r = one(spark, s=segment.sentence_array(F.lit("Art. 5 applies. J. Smith agrees! «Why?» asked Dr. No. end"), segment.NEWS))
    assert r.s == ["Art. 5 applies.", "J. Smith agrees!", "«Why?» asked Dr. No. end"]


def test_rank_sums_to_one_and_prefers_the_cited(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    r = {x.id: x.rank for x in graph.pagerank(nodes, edges, iterations=12).collect()}
    assert abs(sum(r.values()) - 1) < 1e-5 and r["c"] > r["b"] > r["a"]


def test_average_linkage_is_not_components(spark):
    items = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, weight long")
    sims = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5)], "l long, r long, cosine double")
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5), (3, "b", 1.0)], "id long, term string, w double")
    assert {x.id: x.cluster for x in cluster.average_linkage(items, sims, vectors, 0.34).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.id: x.comp for x in graph.components(sims.where("cosine > 0").select(F.col("l").alias("a"), F.col("r").alias("b"))).collect()} == {1: 1, 2: 1, 3: 1}


def test_copies_far_apart_do_not_merge(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "p", words, 0, None), (2, "q", words, 200, None), (3, "r", words, 100, None), (4, "s", "short", None, 9)]
    a = spark.createDataFrame(rows, "id long, publisher string, text string, published_min long, derived_from long")
    got = {x.id: x.origin for x in independence.origin_groups(a).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}  # 1 and 2 meet through 3 only
    got = {x.id: x.origin for x in independence.origin_groups(a.where("id <> 3")).collect()}
    assert got == {1: 1, 2: 2, 4: 4}


def test_more_copies_than_any_cap(spark):
    base = [f"word{i}" for i in range(60)]
    near = lambda i: " ".join([*base[:30], f"new{i}", *base[31:]])
    times = lambda i: None if i == 7 else (i * 37) % 400
    rows = [(i, f"p{i % 3}", " ".join(base) if i < 410 else near(i), times(i), None) for i in range(830)]
    a = spark.createDataFrame(rows, "id long, publisher string, text string, published_min long, derived_from long")
    assert {x.origin for x in independence.origin_groups(a).collect()} == {0}
    p = independence.near_pairs(independence.fingerprints(a.where("id < 405 or id >= 822"))).collect()
    assert {(x.l, x.r): (x.n_l, x.n_r) for x in p} == {(i, j): (405 if i == 0 else 1, 1) for j in range(822, 830) for i in [0, *range(822, j)]}


@pytest.mark.parametrize("n", [500, 2000])
def test_near_copies_cost_in_proportion(spark, monkeypatch, n):
    base = [f"word{i}" for i in range(80)]
    rows = [(i, f"p{i % 3}", " ".join([*base[: i % 70], f"new{i}", *base[i % 70 + 1 :]]), (i * 37) % 900, None) for i in range(n)]
    a = spark.createDataFrame(rows, "id long, publisher string, text string, published_min long, derived_from long")
    pairs, checkpoint = [], setlinks.cut_lineage

    def counted(df):
        out = checkpoint(df)
        pairs.extend([out.count()] if out.columns == ["a", "b", "linked"] else [])
        return out

    monkeypatch.setattr(setlinks, "cut_lineage", counted)
    assert {x.origin for x in independence.origin_groups(a).collect()} == {0}
    assert 0 < sum(pairs) < 40 * n


def test_groups_by_every_pair(spark):
    rng = random.Random(3)
    texts = [[f"t{k}w{i}" for i in range(45)] for k in range(4)]
    rows = []
    for i in range(120):
        words = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(45)] = f"x{rng.randrange(5)}"
        words += rng.choice([[], [], [f"own{i}_{j}" for j in range(60)]])
        when = None if rng.random() < 0.02 else rng.randrange(4000)
        rows.append((i, "p", " ".join(words), when, None))
    sets = [{tuple(r[2].split()[k : k + 5]) for k in range(len(r[2].split()) - 4)} for r in rows]
    want, root = set(), list(range(120))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(120):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / len(sets[i] | sets[j]) >= 0.55 or both / min(len(sets[i]), len(sets[j])) >= 0.75:
                if sets[i] != sets[j] and sets[i] not in sets[:i] and sets[j] not in sets[:j]:
                    want.add((j, i))
                if rows[i][3] is None or rows[j][3] is None or abs(rows[i][3] - rows[j][3]) <= 180:
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    a = spark.createDataFrame(rows, "id long, publisher string, text string, published_min long, derived_from long")
    assert {(x.l, x.r) for x in independence.near_pairs(independence.fingerprints(a)).collect()} == want
    assert {x.id: x.origin for x in independence.origin_groups(a).collect()} == {i: find(i) for i in range(120)}


def test_components_in_any_order(spark):
    shuffled = random.Random(1).sample(range(300), 300)
    for order in (list(range(200, 0, -1)), [*range(2, 130), 1], shuffled):
        links = spark.createDataFrame([*zip(order, order[1:]), (900, 901), (950, 950)], "a long, b long")
        assert {x.id: x.comp for x in graph.components(links).collect()} == {**dict.fromkeys(order, min(order)), 900: 900, 901: 900, 950: 950}


def test_roots_with_a_cycle(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7)], "id long, parent long")
    assert {x.id: x.root for x in graph.roots(p).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_apportion_leaves_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0)], "g int, k string, w double")
    assert sorted(x.s for x in scoring.apportion(df, ["g"], "w", F.lit(10.0), "k", "s").collect()) == [3.333, 3.333, 3.334]


def test_health_and_gate(spark):
    zero, one_ = F.lit(0.0), F.lit(1.0)
    r = one(spark, h=scoring.health(one_, zero, zero, zero), g=scoring.publish_reasons(zero, zero, F.lit(11), F.lit(2), F.lit(0)))
    assert (r.h, r.g) == (0.0, ["runs", "claims"])


def test_every_verdict(spark):
    na = {c: F.lit("na") for c in scoring.CHECKS}
    ok = {c: F.lit("pass") for c in scoring.CHECKS}
    fail = lambda *cs: ok | {c: F.lit("fail") for c in cs}
    v = lambda kind, o, n=3: scoring.verdict(F.lit(kind), o, F.lit(n))
    r = one(
        spark, a=v("opinion", ok), b=v("forecast", ok), c=v("fact", fail("contradiction")), d=v("fact", ok, 0), e=v("fact", na), f=v("fact", fail("direct_textual_evidence") | {"independent_corroboration": F.lit("na")}),
        g=v("fact", fail("quantity_recheck")), h=v("fact", fail("logical_validity")), i=v("fact", fail("causal_support")), j=v("fact", ok),
    )
    assert list(r) == ["not_a_factual_claim", "forecast_conditional", "contradicted", "unverifiable", "unverifiable", "unverifiable", "unsupported", "partially_supported", "partially_supported", "supported"]


def test_unknown_robots_and_dates(spark):
    r = one(spark, a=store.retrievable(F.lit(True), F.lit(True), F.lit(None).cast("boolean")), b=store.within_bounds(F.lit(None).cast("int"), 1, 2))
    assert (r.a, r.b) == (False, True)


def test_redaction_and_grounding(spark):
    r = one(spark, x=propositions.redact(F.lit("Dr. Ann Lee's plan, said Ann Lee; Annex"), ["Ann Lee", "Ann"]))
    assert r.x == "[ACTOR] plan, said [ACTOR]; Annex"


def test_feeds_refuse_entities(spark):
    feeds = spark.createDataFrame([("f", "<rss><channel><item><title/><link>http://a/1</link></item><item><title>T</title><link>http://a/2</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0000</pubDate></item></channel></rss>"), ("g", "<!DOCTYPE x><rss><channel><item><link>u</link></item></channel></rss>"), ("h", "not xml"), ("i", None)], "url string, xml string")
    got = sorted((x.url, x.title) for x in readers.parse_feed(feeds, "url", "xml").collect())
    assert got == [("http://a/1", "http://a/1"), ("http://a/2", "T")]


def test_visible_text():
    assert readers.visible_text("<nav>menu</nav><p>short</p><script>x()</script>") == "short"
    body = "word " * 12
    assert readers.visible_text(f"<p>other</p><article><h1>A</h1>{body}</article>") == ("A " + body).strip()


def test_files_and_evidence(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    f = readers.read_files(spark, str(tmp_path)).first()
    assert f.size == 5 and f.sha256.startswith("2cf24dba")
    (tmp_path / "e.json").write_text('{"a": 1}\nbroken\n')
    good, bad = readers.read_evidence(spark, str(tmp_path / "e.json"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1


def test_writes_only_what_changed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "out")
    assert readers.write_changed(rows, path, "id") == 2
    assert readers.write_changed(rows.union(spark.createDataFrame([(3, "c")], "id int, v string")), path, "id") == 1
    assert spark.read.parquet(path).count() == 3


def test_registry_rejects(spark):
    good, bad = readers.load_registry(spark, [{"id": "a", "tier": 1}, {"id": "a"}, {"kind": "x"}, {"id": "b", "trust": 3}])
    assert [r.id for r in good.collect()] == ["a"] and [r.reason for r in bad.collect()] == ["repeated id", "no id", "reputation field"]


def test_replayed_batches_append_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", "2")], "url string, sha string")
    path = str(tmp_path / "seen")
    for _ in range(2):
        observations.append_new(rows, path, ["url", "sha"])
    assert spark.read.parquet(path).count() == 2


def test_repartitioning_changes_nothing(spark):
    from lectern.plans import registry

    d = "/root/testdata/sf0.001"
    for name in ("g05_shingles", "a16_edge_merge", "r04_r07_w01_rank_evidence"):
        a = sorted(map(str, registry.QUERIES[name](spark, d).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(map(str, registry.QUERIES[name](spark, d).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert a == b


def test_insert_policies(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, sha string")
    incoming = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c"), (2, "d"), (1, "a"), (6, "e"), (6, "f")], "id long, sha string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    clashes = [(2, "d", "collision"), (6, "e", "collision"), (6, "f", "collision")]
    for policy, new, refused in (("skip", [(4, "c")], clashes), ("reject", [(4, "c")], sorted([*clashes, (1, "a", "duplicate"), (3, "a", "duplicate")])), ("merge", [(1, "a"), (1, "a"), (4, "c")], clashes)):
        got, no = store.insert(stored, incoming, "id", "sha", policy)
        assert (rows(got), rows(no)) == (new, refused)
    with pytest.raises(ValueError):
        store.insert(stored, incoming, "id", "sha", "drop")


def test_kinds_of_chains(spark):
    yes, no = F.lit(True), F.lit(False)
    kind = independence.chain_kind
    r = one(spark, w=kind(F.lit(1), yes, yes, yes), v=kind(F.lit(1), no, no, no, yes), a=kind(F.lit(0), no, no, no, yes), u=kind(F.lit(0), no, no, no))
    assert (r.w, r.v, r.a, r.u) == ("wire", "verbatim", "aggregation", "unknown")
