import json

from plainweave.cli import main
from plainweave.functions.namespaces import NAMESPACES
from plainweave.operators.kb import RDF_TYPE, SUBCLASS_OF
from plainweave.sources import files, rdf
from plainweave.streaming import count_stream, stream_texts


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ntriples_and_turtle(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a:s> <a:p> <a:o> .\n_:b <a:p> "x \\" y"@en .\n# no\n<a:s> <a:q> "5"^^<a:int> .\nbroken\n')
    assert rows(rdf.read_triples(spark, str(tmp_path / "a.nt"))) == [("_:b", "a:p", 'x \\" y', "literal"), ("a:s", "a:p", "a:o", "iri"), ("a:s", "a:q", "5", "literal")]
    (tmp_path / "b.ttl").write_text('@prefix e: <http://e/> .\n@prefix r: <http://www.w3.org/2000/01/rdf-schema#> .\ne:A r:subClassOf e:B , e:C ; a e:K .\n<http://e/x> e:p "t"@en ; e:q 5 .\n')
    want = [("http://e/A", SUBCLASS_OF, "http://e/B", "iri"), ("http://e/A", SUBCLASS_OF, "http://e/C", "iri"), ("http://e/A", RDF_TYPE, "http://e/K", "iri"), ("http://e/x", "http://e/p", "t", "literal"), ("http://e/x", "http://e/q", "5", "literal")]
    assert rows(rdf.read_triples(spark, str(tmp_path / "b.ttl"), "n3")) == sorted(want)


def test_word_lists(spark, tmp_path):
    (tmp_path / "bnc").write_text("good Adj 5\ngood NoC 2\n\nTotal words 9 9\nrun Verb 7 x\n")
    (tmp_path / "anc").write_text("Goods good JJ 5\nruns run VBZ 3\nrun run NN 1\n")
    assert rows(files.read_bnc(spark, str(tmp_path / "bnc"))) == [("good", 7, True, False, True), ("run", 7, False, True, False)]
    assert rows(files.read_anc(spark, str(tmp_path / "anc"))) == [("good", 5, True, False, False), ("run", 4, False, True, True)]


def test_commands_from_texts_to_vectors(spark, tmp_path):
    texts = tmp_path / "texts"
    texts.mkdir()
    for name, words in (("one", "alpha beta alpha"), ("two", "beta gamma"), ("none", "nothing")):
        (texts / f"{name}.txt").write_text(words + " filler" * 30)
    gazetteer = tmp_path / "gazetteer.json"
    gazetteer.write_text("".join(json.dumps({"word": w, "uri": f"http://r/{w}", "types": t}) + "\n" for w, t in (("alpha", ["Schema:A"]), ("beta", ["DBPedia:B"]), ("gamma", []))))
    ontology = tmp_path / "o.nt"
    ontology.write_text(f"<{NAMESPACES[1][1]}A> <{SUBCLASS_OF}> <{NAMESPACES[1][1]}Top> .\n<http://r/alpha> <{RDF_TYPE}> <{NAMESPACES[0][1]}B> .\n")
    at = lambda x: str(tmp_path / x)
    assert main(["texts2vectors", str(texts), at("v1"), "--gazetteer", str(gazetteer), "--triples", str(ontology), "--save-info", at("i1"), "--save-graphs", at("g1")], spark) == 0
    assert main(["texts2concepts", str(texts), at("c"), "--gazetteer", str(gazetteer)], spark) == 0
    assert main(["concepts2info", at("c"), at("i2"), "--triples", str(ontology)], spark) == 0
    assert main(["concepts2graphs", at("c"), at("g2"), "-t", at("i2"), "--triples", str(ontology)], spark) == 0
    assert main(["graphs2vectors", at("g2"), at("v2")], spark) == 0
    v1, v2 = (spark.read.option("header", True).csv(at(x)) for x in ("v1", "v2"))
    assert v1.columns[0] == "filename" and len(v1.columns) == 25
    assert rows(v1) == rows(v2) and v1.count() == 3
    assert rows(files.read_info(spark, at("i1"))) == rows(files.read_info(spark, at("i2")))
    by = {r["filename"]: r for r in v1.collect()}
    assert (by["one"]["nbConcepts"], by["one"]["nbUniqueConcepts"], by["none"]["nbNodes"]) == ("3.0", "2.0", "0.0")
    # What is there already isn't made again.
    (texts / "three.txt").write_text("gamma" + " filler" * 30)
    assert main(["texts2concepts", str(texts), at("c"), "--gazetteer", str(gazetteer)], spark) == 0
    assert files.read_concepts(spark, at("c")).count() == 4
    assert main(["printGraph", at("g2")], spark) == 0


def test_plain_files_of_one_document_each(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"concepts": [{"uri": "u", "types": [], "scores": {"offset": 1, "surfaceForm": "x"}}], "nbWords": 4}, indent=1))
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"directed": False, "multigraph": False, "graph": {"nb_words": 4}, "nodes": [{"id": "u", "resource": True, "count": 1, "offset": 1, "nbLinksIn": "7"}, {"id": "z"}], "links": [{"source": "z", "target": "u"}]}, indent=1))
    assert [(r["filename"], r["nbWords"], len(r["concepts"])) for r in files.read_concepts(spark, str(tmp_path / "c")).collect()] == [("a", 4, 1)]
    assert rows(files.concept_uris(spark, str(tmp_path / "c"))) == [("u",)]
    nodes, links, lengths = files.read_graphs(spark, str(tmp_path / "g"))
    assert sorted((r["id"], r["resource"], r["nbLinksIn"]) for r in nodes.collect()) == [("u", True, 7), ("z", False, None)]
    assert (rows(links), rows(lengths)) == ([("a", "u", "z")], [("a", 4)])


def test_synlex_command(spark, tmp_path):
    for folder, text in (("trees", "(ROOT (S (NP (PRP He)) (VP (VBZ runs))))"), ("tagged", "He_PRP runs_VBZ fast_RB ._.")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.txt").write_text(text)
    (tmp_path / "list").write_text("fast Adj 5\nrun Verb 2\n")
    at = lambda x: str(tmp_path / x)
    assert main(["texts2synLexVectors", at("trees"), at("tagged"), at("v"), "--word-list", at("list")], spark) == 0
    out = spark.read.option("header", True).csv(at("v"))
    assert len(out.columns) == 58
    r = out.first()
    assert (r["W"], r["wordtokens"], r["lextokens"]) == ("2.0", "3.0", "2.0")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("word " * 40 + "\n\nshort")
    q = count_stream(stream_texts(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert rows(spark.table("counts")) == [("a", 1, 40)]


def test_command_filters_and_checks(spark, tmp_path, capsys):
    """-co and the other filters take effect; missing inputs and outputs that can't be written stop a command before it works; a graph is printed whole."""
    import pytest

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("alpha beta gamma" + " filler" * 30)
    names = [{"word": "alpha", "uri": "u:a", "types": ["Schema:A"], "similarity": 0.9, "support": 5}, {"word": "beta", "uri": "u:b", "types": [], "similarity": 0.4, "support": 50}, {"word": "gamma", "uri": "u:c", "types": ["X:Y"]}]
    (tmp_path / "g.json").write_text("".join(json.dumps(x) + "\n" for x in names))
    at = lambda x: str(tmp_path / x)
    found = {}
    for k, more in enumerate(([], ["-co", "0.95"], ["-co", "0.1"], ["-co", "0.1", "--support", "5"], ["--types", "Schema:A"], ["--types", "Schema:A", "--policy", "blacklist"])):
        assert main(["texts2concepts", at("t"), at(f"c{k}"), "--gazetteer", at("g.json"), *more], spark) == 0
        found[k] = sorted(c["uri"] for c in files.read_concepts(spark, at(f"c{k}")).first()["concepts"])
    assert found == {0: ["u:a", "u:c"], 1: ["u:c"], 2: ["u:a", "u:b", "u:c"], 3: ["u:a", "u:b"], 4: ["u:a"], 5: ["u:c"]}
    with pytest.raises(FileNotFoundError):
        main(["texts2concepts", at("none"), at("c9"), "--gazetteer", at("g.json")], spark)
    (tmp_path / "file").write_text("")
    with pytest.raises(PermissionError):
        main(["concepts2info", at("c0"), at("file/under")], spark)
    assert main(["concepts2graphs", at("c2"), at("gr")], spark) == 0
    capsys.readouterr()
    assert main(["printGraph", at("gr")], spark) == 0
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert {tuple(x[1:]) for x in lines if x[1] == "node"} == {("node", "ROOT", "black"), ("node", "Schema:A", "blue"), ("node", "u:a", "green"), ("node", "u:b", "green"), ("node", "u:c", "green")}
    assert sum(x[1] == "edge" for x in lines) == 4


def test_a_document_whose_text_names_a_filename(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"concepts": [{"uri": "u", "types": [], "scores": {"offset": 1, "surfaceForm": '"filename"'}}], "nbWords": 4}))
    assert [(r["filename"], r["nbWords"]) for r in files.read_concepts(spark, str(tmp_path / "c")).collect()] == [("a", 4)]


def test_ntriples_with_odd_terms(spark, tmp_path):
    """An IRI is kept whole whatever characters it has, and a literal ends at its last quote."""
    (tmp_path / "a.nt").write_text('<a b> <p> "x"y"@en .\n<a> <p> "" .\n<a> <p> "1"^^<t> .\n_:b <p> <> .\n', encoding="utf-8")
    got = sorted(map(tuple, rdf.read_ntriples(spark, str(tmp_path / "a.nt")).collect()))
    assert got == sorted([("a b", "p", 'x"y', "literal"), ("a", "p", "", "literal"), ("a", "p", "1", "literal"), ("_:b", "p", "", "iri")])
