import os
import random
from collections import Counter, defaultdict, deque
from statistics import fmean, pstdev

import pytest

from plainweave.functions.namespaces import ROOT
from plainweave.operators import graphs, kb, mentions, ontology
from plainweave.operators.kb import RDF_TYPE

D, S = "http://dbpedia.org/ontology/", "http://schema.org/"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ancestors_end_on_cycles_and_diamonds(spark):
    tax = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "cls string, parent string")
    found = ontology.ancestors(spark.createDataFrame([("a",), ("x",), ("q",)], "cls string"), tax)
    assert rows(found) == sorted([("a", "a", "b"), ("a", "a", "c"), ("a", "b", "d"), ("a", "c", "d"), ("a", "d", ROOT), ("x", "x", "y"), ("x", "y", "x"), ("q", "q", ROOT)])
    assert rows(ontology.parents(spark.createDataFrame([("a",), ("q",)], "cls string"), tax)) == [("a", "b"), ("a", "c"), ("q", ROOT)]


def test_concept_info(spark):
    t = spark.createDataFrame([("a", kb.RDF_TYPE, "T", "iri"), ("a", kb.RDF_TYPE, "T", "iri"), ("b", "p", "a", "iri"), ("a", "p", "text", "literal")], "s string, p string, o string, o_kind string")
    info = kb.concept_info(spark.createDataFrame([("a",), ("z",), ("a",)], "uri string"), t)
    assert rows(info) == [("a", ["T"], 1, 3), ("z", [], 0, 0)]
    assert kb.number_of_types(info).first()[0] == 1
    assert kb.concept_info(spark.createDataFrame([], "uri string"), t).count() == 0


def test_mention_counts_take_the_last(spark):
    m = spark.createDataFrame([("d", 0, "u", ["A"], 5), ("d", 2, "u", ["B"], 9), ("d", 1, "u", ["C"], 7)], "filename string, ord int, uri string, types array<string>, offset int")
    assert rows(mentions.mention_counts(m)) == [("d", "u", 3, 9, ["B"])]


def test_text_concepts_offsets(spark):
    long = lambda w: w + " " + "x" * 160
    docs = spark.createDataFrame([("d", long("one") + "\n\nshort\n\n" + long("one two")), ("e", None)], "filename string, text string")
    annotate = mentions.gazetteer({"one": ("u1", ["Schema:Thing"]), "two": ("u2", [])})
    out = {r["filename"]: r for r in mentions.text_concepts(docs, annotate).collect()}
    assert [(c["uri"], c["scores"]["offset"]) for c in out["d"]["concepts"]] == [("u1", 0), ("u1", 164), ("u2", 168)]
    assert out["d"]["nbWords"] == 5
    assert (out["e"]["concepts"], out["e"]["nbWords"]) == ([], 0)
    names = spark.createDataFrame([("one", "u1", ["Schema:Thing"]), ("two", "u2", [])], "word string, uri string, types array<string>")
    same = {r["filename"]: r for r in mentions.text_concepts(docs, mentions.gazetteer_table(names)).collect()}
    assert same == out


def test_parse_response(spark):
    from pyspark.sql import functions as F

    body = '{"Resources": [{"@URI": "u", "@types": "a,b", "@offset": "3", "@similarityScore": "0.5"}, {"@types": "x"}, {"@URI": "v", "@types": "", "@support": "zz"}]}'
    df = spark.createDataFrame([(body,), (None,), ("{}",)], "b string").select(mentions.parse_response(F.col("b")).alias("r"))
    first, none, empty = [r["r"] for r in df.collect()]
    assert [(x["uri"], x["types"], x["scores"]["offset"], x["scores"]["support"]) for x in first] == [("u", ["a", "b"], 3, None), ("v", [], None, None)]
    assert none == empty == []


def brute(nodes, pairs, offsets, words):
    """Radius, diameter and text density, from the definitions."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    dist = {}
    for s in nodes:
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near[x] - seen.keys():
                seen[y] = seen[x] + 1
                queue.append(y)
        dist[s] = seen
    far = [max(d.values()) for d in dist.values()]
    own = sorted(offsets)
    values = [((offsets[b] - offsets[a]) / words) ** 2 * (dist[a][b] / max(far)) ** 0.5 for i, a in enumerate(own) for b in own[i + 1 :]]
    return min(far), max(far), fmean(values) if values else None, pstdev(values) if values else None


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(7)
    tax = spark.createDataFrame([(f"{D}{k}", f"{S if k % 2 else D}{k // 2}") for k in range(2, 30)], "cls string, parent string")
    counts = [(f"d{d}", f"r{k}", 1 + k % 3, rng.randrange(500), [f"DBPedia:{rng.randrange(2, 30)}" for _ in range(k % 3)] + ["unknown:x"]) for d in range(12) for k in rng.sample(range(40), d)]
    found = graphs.resources(spark.createDataFrame(counts, "filename string, uri string, count long, offset long, types array<string>"), None)
    links = graphs.edges(found, tax).cache()
    nodes = graphs.vertices(found, links).cache()
    lengths = spark.createDataFrame([(f"d{d}", 100 + d) for d in range(12)], "filename string, nbWord long")
    return nodes, links, lengths


def test_paths_both_ways_and_by_brute_force(spark, built):
    nodes, links, lengths = built
    paths = graphs.distances(links).cache()
    native = graphs.radius_diameter(paths).join(graphs.text_density(paths, nodes, lengths), "filename", "left")
    a, b = ({r["filename"]: r for r in x.collect()} for x in (native, graphs.path_features(nodes, links, lengths)))
    ns, es = defaultdict(list), defaultdict(list)
    for r in nodes.collect():
        ns[r["filename"]].append(r)
    for r in links.collect():
        es[r["filename"]].append((r["src"], r["dst"]))
    assert a.keys() == b.keys() == ns.keys()
    for d in ns:
        want = brute([r["id"] for r in ns[d]], es[d], {r["id"]: r["offset"] for r in ns[d] if r["resource"]}, 100 + int(d[1:]))
        for got in (a[d], b[d]):
            assert (got["radius"], got["diameter"]) == want[:2]
            assert got["textDensityMean"] == pytest.approx(want[2])
            assert got["textDensityStd"] == pytest.approx(want[3], abs=1e-9)


def test_vectors(spark, built):
    nodes, links, lengths = built
    out = {r["filename"]: r for r in graphs.semantic_vectors(nodes, links, lengths).collect()}
    native = {r["filename"]: r for r in graphs.semantic_vectors(nodes, links, lengths, native=True).collect()}
    assert out.keys() == {f"d{d}" for d in range(12)}
    assert list(out["d3"].asDict()) == ["filename", *graphs.feature_names()]
    empty = out["d0"]
    assert (empty["nbNodes"], empty["density"], empty["radius"], empty["textDensityMean"], empty["nbWord"]) == (0, 1, 0, 0, 100)
    for d, r in out.items():
        assert r["nbUniqueConcepts"] <= r["nbConcepts"] and 0 <= r["density"] <= 1 and r["radius"] <= r["diameter"] <= 2 * r["radius"]
        for name in ("radius", "diameter", "textDensityMean", "assortativity", "density_DBPedia"):
            assert r[name] == pytest.approx(native[d][name])


def test_single_untyped_resource(spark):
    found = spark.createDataFrame([("d", "r", 1, 0, [], None, None, None)], "filename string, uri string, count long, offset long, types array<string>, nbTypes long, nbLinksIn long, nbLinksOut long")
    links = graphs.edges(found, spark.createDataFrame([], "cls string, parent string"))
    nodes = graphs.vertices(found, links)
    r = graphs.semantic_vectors(nodes, links, spark.createDataFrame([("d", None)], "filename string, nbWord long")).first()
    assert (r["nbNodes"], r["radius"], r["diameter"], r["density"], r["assortativity"], r["textDensityMean"], r["nbWord"], r["conceptsWordsRatio"]) == (2, 1, 1, 1, None, None, -1, -1)


def test_one_namespace(spark):
    triples = spark.createDataFrame([(f"{S}A", ontology.SUBCLASS_OF, f"{S}B", "iri"), (f"{S}A", ontology.SUBCLASS_OF, f"{D}C", "iri")], "s string, p string, o string, o_kind string")
    found = spark.createDataFrame([("d", "r", 1, 0, ["Schema:A", "DBPedia:C"])], "filename string, uri string, count long, offset long, types array<string>")
    assert rows(graphs.in_one_namespace(found, triples, "Schema")) == sorted([("d", f"{S}A", "r"), ("d", f"{S}A", f"{S}B"), ("d", ROOT, f"{S}B")])
    with pytest.raises(ValueError, match="no namespace"):
        graphs.in_one_namespace(found, triples, "none")


def test_features_are_the_same_for_any_order_of_rows(spark, built):
    """Equal to the last bit over six ways to deal the rows out."""
    nodes, links, _ = built
    made = []
    for k in range(1, 7):
        n, e = nodes.repartition(k, "id").sortWithinPartitions("id", ascending=k % 2 == 0), links.repartition(k).sortWithinPartitions("src", ascending=k % 2 == 1)
        made.append((rows(graphs.assortativity(e)), rows(graphs.counts(n, e))))
    assert all(x == made[0] for x in made)


def test_assortativity_of_known_graphs(spark):
    star = [("star", "a", x) for x in "bcd"]
    path = [("path", "a", "b"), ("path", "b", "c"), ("path", "c", "d")]
    ring = [("ring", "a", "b"), ("ring", "b", "c"), ("ring", "a", "c")]
    out = dict(rows(graphs.assortativity(spark.createDataFrame(star + path + ring, "filename string, src string, dst string"))))
    assert (out["star"], out["path"], out["ring"]) == (-1.0, -0.5, None)


def test_disconnected_graphs_have_no_nan(spark):
    """Pairs without a path are left out, both ways."""
    links = spark.createDataFrame([("d", "a", "b"), ("d", "c", "e"), ("d", "b", "f")], "filename string, src string, dst string")
    nodes = spark.createDataFrame([("d", x, x != "f", k * 3 if x != "f" else None) for k, x in enumerate("abcef")], "filename string, id string, resource boolean, offset long")
    lengths = spark.createDataFrame([("d", 20)], "filename string, nbWord long")
    mine = graphs.path_features(nodes, links, lengths).first()
    paths = graphs.distances(links)
    native = graphs.radius_diameter(paths).join(graphs.text_density(paths, nodes, lengths), "filename").first()
    assert tuple(mine)[:3] == tuple(native)[:3] == ("d", 1, 2)
    for name in ("textDensityMean", "textDensityStd"):
        assert mine[name] == pytest.approx(native[name]) and mine[name] == mine[name]
    assert mine["textDensityMean"] == pytest.approx((3 / 20) ** 2 / 2**0.5)


def test_deep_taxonomy_is_complete(spark):
    depth = 40
    tax = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(depth)], "cls string, parent string")
    assert ontology.ancestors(spark.createDataFrame([("c0",)], "cls string"), tax).count() == depth + 1


def test_distances_store_nothing(spark):
    """Pairs of nodes are neither stored nor shuffled, and their numbers by length are those of the pairs."""
    rows = [(k, f"n{a}", f"n{b}") for k in ("a", "b") for a, b in ((1, 2), (2, 3), (3, 4), (2, 5), (7, 8))] + [("c", f"m{i:03}", "z") for i in range(300)]
    links = spark.createDataFrame(rows, "filename string, src string, dst string").repartition(3)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    pairs = Counter((r["filename"], r["d"]) for r in graphs.distances(links).collect())
    assert set(os.listdir(folder)) == before
    assert pairs == {(k, d): n for k in ("a", "b") for d, n in ((0, 7), (1, 10), (2, 8), (3, 4))} | {("c", 0): 301, ("c", 1): 600, ("c", 2): 300 * 299}
    assert {(r["filename"], r["d"]): r["pairs"] for r in graphs.distance_counts(links).collect()} == pairs


def test_link_counts_pass_over_other_ends(spark):
    """Ends that begin like no wanted URI don't reach the shuffle; with too many beginnings all do, with the same counts."""
    rows = [("http://a/x", "p", "http://b/1", "iri"), ("http://b/1", "p", "http://a/x", "iri"), ("http://b/1", "p", "http://a/x", "literal"), ("http://b/1", RDF_TYPE, "http://a/x", "iri"), ("x", "p", "x", "iri")]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    few = spark.createDataFrame([("http://a/x",), ("http://a/y",), ("x",), (None,)], "uri string")
    many = few.unionByName(spark.range(200).selectExpr("concat('http://c', id, '/') AS uri"))
    got = kb.concept_info(few.filter("uri LIKE 'http%'"), triples)
    assert "startswith" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {"http://a/x": ([], 2, 1), "http://a/y": ([], 0, 0), "x": ([], 1, 1), None: ([], 0, 0)}
    for uris in (few, many):
        out = {r["uri"]: tuple(r)[1:] for r in kb.concept_info(uris, triples).collect()}
        assert {k: out[k] for k in want} == want


def _some_resources(spark):
    cls = lambda k: f"{D}C{k}"
    tax = spark.createDataFrame([(cls(1), cls(2)), (cls(1), f"{S}é"), (cls(2), cls(3)), (cls(3), cls(2)), (cls(4), cls(4)), (f"{S}é", "http://other/X")], "cls string, parent string")
    rng = random.Random(3)
    refs = [cls(1), cls(2), cls(4), "DBPedia:C1", "Schema:é", "Schema:alone", "Unknown:Thing", None]
    made = []
    for doc in [*range(40), None]:
        for uri in rng.sample([*[f"u{i}" for i in range(9)], "ü", "\U0001f600", "￮", cls(1), cls(3), ROOT, None], rng.randint(1, 9)):
            made.append((doc, uri, rng.randint(1, 5), rng.choice([None, 7]), rng.choice([None, [], rng.sample(refs, 3), [cls(2), cls(2)]]), rng.choice([None, 2]), 0, 1 << 40))
    found = spark.createDataFrame(made, "doc_id long, uri string, count long, offset int, types array<string>, nbTypes long, nbLinksIn long, nbLinksOut long")
    return found, tax


def test_graphs_built_in_one_task_are_those_of_the_joins(spark):
    found, tax = _some_resources(spark)
    for namespaces in (graphs.NAMESPACES, ()):
        links = graphs.edges(found, tax, namespaces, "doc_id")
        nodes = graphs.vertices(found, links, "doc_id")
        for most in (1 << 18, 0):
            v, e = graphs.built(found, tax, namespaces, "doc_id", most)
            assert (v.dtypes, e.dtypes) == (nodes.dtypes, links.dtypes)
            assert Counter(map(tuple, e.collect())) == Counter(map(tuple, links.collect()))
            assert Counter(map(tuple, v.collect())) == Counter(map(tuple, nodes.collect()))
        found_named = found.filter("uri IS NOT NULL AND doc_id IS NOT NULL")
        links = graphs.edges(found_named, tax, namespaces, "doc_id")
        nodes = graphs.vertices(found_named, links, "doc_id")
        v, e = graphs.built(found_named, tax, namespaces, "doc_id")
        for f in (lambda n, m: graphs.counts(n, m, namespaces, "doc_id"), lambda n, m: graphs.assortativity(m, "doc_id"), lambda n, m: graphs.path_features(n, m, None, "doc_id")):
            assert Counter(map(str, f(v, e).collect())) == Counter(map(str, f(nodes, links).collect()))


def test_built_graphs_are_measured_without_a_shuffle_of_nodes_or_edges(spark):
    found, tax = _some_resources(spark)
    v, e = graphs.built(found, tax, key="doc_id")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(graphs.assortativity(e, "doc_id")) and "Exchange" not in plan(v) + plan(e)
    assert "collect_list" not in plan(graphs.counts(v, e, key="doc_id"))


def test_mentions_of_odd_texts(spark, tmp_path):
    import hashlib
    import re

    from plainweave.plans import standins as st

    texts = [None, "", " ", "  Éxtraordinarily  EXTRA-ordinarily é extraordinary\nabcdefghij abcdefghij ", "international 国際化国際化国際化 internationally!", *[f"é {w} wonderful{w}ness, word{w}wordword" for w in "abcdefghijklmnopqrstuvwxyz"]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in enumerate(texts):
        offset = 0
        for place, token in enumerate((text or "").split(" ")):
            word = re.sub("[^A-Za-z]", "", token).lower()
            h = hashlib.md5(word.encode()).digest()
            if len(word) >= st.LETTERS and h[0] < st.SHARE:
                want.append((doc, place, offset, f"http://dbpedia.org/resource/{word}", h[1] * 256 + h[2]))
            offset += len(token) + 1
    st_rows = st.mentions(spark, str(tmp_path)).select("doc_id", "ord", "offset", "uri", "rk")
    assert len(want) > 2 and rows(st_rows) == want


def test_files_of_built_graphs(spark, tmp_path):
    from plainweave.sources import files

    found, tax = _some_resources(spark)
    found = found.filter("uri IS NOT NULL AND doc_id IS NOT NULL")
    lengths = spark.createDataFrame([(i, i * 10) for i in range(45)], "doc_id long, nbWord long")
    v, e = graphs.built(found, tax, key="doc_id")
    links = graphs.edges(found, tax, key="doc_id")
    nodes = graphs.vertices(found, links, "doc_id")
    made, want = files.graph_rows(v, e, lengths, "doc_id"), files.graph_rows(nodes, links, lengths, "doc_id")
    assert made.dtypes == want.dtypes and sorted(made.collect()) == sorted(want.collect()) and want.count() == 45
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(want) and "Aggregate" not in plan(made)
    files.write_graphs(v, e, lengths, str(tmp_path), key="doc_id")
    n, m, size = files.read_graphs(spark, str(tmp_path))
    assert "Aggregate" not in plan(m) and Counter(map(tuple, m.collect())) == Counter((str(r[0]), *r[1:]) for r in e.collect())
    assert n.count() == v.count() and size.count() == 45
    # A graph written twice, and an edge both ways in it: each edge still comes once.
    (tmp_path / "part-more.json").write_text('{"filename": "1", "graph": {}, "nodes": [], "links": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]}\n' * 2)
    again = [r for r in files.read_graphs(spark, str(tmp_path))[1].collect() if r["src"] == "a"]
    assert [tuple(r) for r in again] == [("1", "a", "b")]
