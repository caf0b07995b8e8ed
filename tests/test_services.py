"""Services and programs against a server and scripts of the test's own."""

import json
import re
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from plainweave.cli import main
from plainweave.functions.namespaces import NAMESPACES
from plainweave.operators import kb, mentions
from plainweave.operators.kb import RDF_TYPE, SUBCLASS_OF
from plainweave.plans.vectors import SemanticTransformer, default_semantic_transformer
from plainweave.sources import files, processes, rdf, remote

NAMES = {"alpha": ("http://r/alpha", ["Schema:A"]), "beta": ("http://r/beta", [])}
TRIPLES = [("http://r/alpha", RDF_TYPE, NAMESPACES[0][1] + "B", "iri"), ("http://r/alpha", RDF_TYPE, NAMESPACES[1][1] + "A", "iri"), ("http://r/beta", "http://p", "http://r/alpha", "iri"), ("http://r/beta", "http://p", "5", "literal")]


class Service(BaseHTTPRequestHandler):
    """Answers as an annotator and as a SPARQL endpoint over ``TRIPLES``, two rows a page."""

    def do_POST(self):
        self.answer(parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()))

    def do_GET(self):
        self.answer(parse_qs(urlsplit(self.path).query))

    def answer(self, params):
        seen, headers = self.server.seen, {}
        seen.append((self.command, {k: v[0] for k, v in params.items()}))
        if self.path.startswith("/flaky") and len(seen) == 1:
            return self.send(503, {}, headers)
        if "query" not in params:
            text = params["text"][0]
            if "broken" in text:
                return self.send(400, {}, headers)
            hits = [{"@URI": NAMES[m[0]][0], "@types": ",".join(NAMES[m[0]][1]), "@offset": str(m.start()), "@surfaceForm": m[0], "@support": "1", "@similarityScore": "1.0", "@percentageOfSecondRank": "0.0"} for m in re.finditer("alpha|beta", text)]
            return self.send(200, {"Resources": hits} if hits else {}, headers)
        query = params["query"][0]
        asked, offset = set(re.findall("<([^>]*)>", query)), int(query.rsplit(" ", 1)[1])
        if "?type" in query:
            rows = [{"subject": s, "type": o} for s, p, o, k in sorted(TRIPLES) if p == RDF_TYPE and k == "iri" and s in asked]
        else:
            ends = Counter((s if "?subject ?p ?other" in query else o) for s, _, o, _ in TRIPLES)
            rows = [{"subject": u, "n": str(n)} for u, n in ends.items() if u in asked]
        if len(rows) > offset + 1:
            headers["X-SPARQL-MaxRows"] = "1"
        page = rows[offset : offset + 1]
        self.send(200, {"results": {"bindings": [{k: {"type": "uri", "value": v} for k, v in r.items()} for r in page]}}, headers)

    def send(self, code, body, headers):
        data = json.dumps(body).encode()
        self.send_response(code)
        for k, v in {**headers, "Content-Length": str(len(data))}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rest_annotator(spark, service):
    server, at = service
    docs = spark.createDataFrame([("a", "alpha beta" + " filler" * 30), ("b", "broken alpha" + " filler" * 30 + "\n\nbeta" + " filler" * 30), ("c", "beta" + " filler" * 2000)], "filename string, text string")
    got = {r["filename"]: [(c["uri"], c["types"], c["scores"]["offset"]) for c in r["concepts"]] for r in mentions.text_concepts(docs, remote.rest_annotator(at, 0.4, support=3, policy=None, attempts=1)).collect()}
    # The broken paragraph shifts no offset; a long one is asked for by POST.
    assert got == {"a": [("http://r/alpha", ["Schema:A"], 0), ("http://r/beta", [], 6)], "b": [("http://r/beta", [], 0)], "c": [("http://r/beta", [], 0)]}
    assert {m for m, _ in server.seen} == {"GET", "POST"}
    assert all(p["confidence"] == "0.4" and p["support"] == "3" and "policy" not in p for _, p in server.seen)


def test_a_request_is_tried_again_but_not_a_refused_one(service):
    server, at = service
    assert json.loads(remote.ask(at + "/flaky", {"text": "alpha"})[0])["Resources"][0]["@URI"] == "http://r/alpha"
    assert len(server.seen) == 2
    with pytest.raises(OSError):
        remote.ask(at, {"text": "broken"})
    assert len(server.seen) == 3


@pytest.mark.parametrize("most", [1, 2, 100])
def test_sparql_info_is_that_of_the_triples(spark, service, most):
    server, at = service
    uris = spark.createDataFrame([("http://r/alpha",), ("http://r/beta",), ("http://r/alpha",), ("no iri> }",), ("http://r/none",), (None,)], "uri string")
    triples = spark.createDataFrame(TRIPLES, rdf.TRIPLES)
    got = remote.sparql_info(at, most, nice=False, connections=1)(uris)
    assert rows(got) == rows(kb.concept_info(uris.filter("uri IS NOT NULL"), triples))
    assert max(len(re.findall("<", p["query"])) for _, p in server.seen) <= most
    assert not any("no iri" in p["query"] for _, p in server.seen)


def test_default_transformer_and_commands(spark, service, tmp_path):
    _, at = service
    place = lambda x: str(tmp_path / x)
    (tmp_path / "texts").mkdir()
    for name, words in (("one", "alpha beta alpha"), ("two", "beta"), ("none", "nothing")):
        (tmp_path / "texts" / f"{name}.txt").write_text(words + " filler" * 30)
    (tmp_path / "o.nt").write_text(f"<{NAMESPACES[1][1]}A> <{SUBCLASS_OF}> <{NAMESPACES[1][1]}Top> .\n")
    taxonomy = rdf.read_triples(spark, place("o.nt"))
    docs = files.read_texts(spark, place("texts"))
    names = spark.createDataFrame([(w, *x) for w, x in NAMES.items()], "word string, uri string, types array<string>")
    local = SemanticTransformer(mentions.gazetteer_table(names), taxonomy.unionByName(spark.createDataFrame(TRIPLES, rdf.TRIPLES)))
    want = rows(local.transform(docs))
    assert rows(default_semantic_transformer(at, 0.5, at, taxonomy).transform(docs)) == want
    assert main(["texts2vectors", place("texts"), place("v"), "--annotator-ep", at, "--sparql-ep", at, "--max-concepts", "1", "--no-nice-server", "-nc", "2", "--triples", place("o.nt"), "--save-graphs", place("g1"), "--each"], spark) == 0
    assert sorted(x.name for x in (tmp_path / "g1").glob("*.json")) == ["none.json", "one.json", "two.json"]
    assert main(["texts2concepts", place("texts"), place("c"), "--annotator-ep", at, "--each"], spark) == 0
    assert main(["concepts2info", place("c"), place("i"), "--sparql-ep", at, "--no-nice-server"], spark) == 0
    assert main(["concepts2graphs", place("c"), place("g2"), "-t", place("i"), "--triples", place("o.nt"), "--each"], spark) == 0
    assert main(["graphs2vectors", place("g1"), place("v1")], spark) == 0
    assert main(["graphs2vectors", place("g2"), place("v2")], spark) == 0
    v, v1, v2 = (rows(spark.read.option("header", True).csv(place(x))) for x in ("v", "v1", "v2"))
    assert v == v1 == v2 and [r[0] for r in v] == [r[0] for r in want]
    # Files that are there stay unless they are to be made again.
    (tmp_path / "c/one.json").write_text('{"concepts": [], "nbWords": 1}')
    assert main(["texts2concepts", place("texts"), place("c"), "--annotator-ep", at, "--each"], spark) == 0
    assert json.loads((tmp_path / "c/one.json").read_text())["nbWords"] == 1
    assert main(["texts2concepts", place("texts"), place("c"), "--annotator-ep", at, "--each", "-f"], spark) == 0
    assert json.loads((tmp_path / "c/one.json").read_text())["nbWords"] == 33


def test_write_each(spark, tmp_path):
    docs = spark.createDataFrame([("a", "é\n"), ("b", None)], "filename string, text string")
    assert files.write_each(docs, str(tmp_path / "new/out"), ".x") == 2
    assert {p.name: p.read_text() for p in (tmp_path / "new/out").iterdir()} == {"a.x": "é\n", "b.x": ""}
    assert files.write_each(docs.filter("false"), str(tmp_path / "none"), ".x") == 0
    with pytest.raises(Exception, match="no name of a file"):
        files.write_each(spark.createDataFrame([("../a", "x")], "filename string, text string"), str(tmp_path / "bad"), ".x")


def test_programs(spark, tmp_path):
    upper = [sys.executable, "-c", "import sys; sys.stdout.write(' '.join(w + '_NN' for w in sys.stdin.read().split()))"]
    docs = spark.createDataFrame([("a", "one é"), ("b", ""), ("c", None)], "filename string, text string")
    assert rows(processes.piped(docs, upper)) == [("a", "one_NN é_NN"), ("b", ""), ("c", None)]
    assert rows(processes.tag_texts(docs, upper)) == [("a", 0, "one", "nn"), ("a", 1, "é", "nn")]
    with pytest.raises(Exception, match="non-zero exit status 3"):
        processes.piped(docs, [sys.executable, "-c", "raise SystemExit(3)"]).collect()
    (tmp_path / "models").mkdir()
    (tmp_path / "models/small.tagger").write_text("")
    assert processes.tagger_models(str(tmp_path)) == ["small"]
    assert processes.tagger_command(str(tmp_path), "small")[:2] == ["java", "-mx300m"]
    for wrong in (lambda: processes.tagger_command(str(tmp_path), "large"), lambda: processes.parser_command("x", 0), lambda: processes.parser_command("x", 1.5)):
        with pytest.raises(ValueError):
            wrong()


def test_vectors_from_texts_by_programs(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("Dogs bark" + " loudly" * 40)
    (tmp_path / "list").write_text("dog NoC 5\nbark Verb 3\n")
    (tmp_path / "parse.py").write_text("import sys; sys.stdin.read(); print('(ROOT (S (NP (NNS Dogs)) (VP (VBP bark))))')")
    (tmp_path / "tag.py").write_text("import sys; print(' '.join(w + '_NN' for w in sys.stdin.read().split()))")
    texts, out = str(tmp_path / "texts"), str(tmp_path / "v")
    assert main(["texts2synLexVectors", texts, texts, out, "--word-list", str(tmp_path / "list"), "--parser", f"{sys.executable} {tmp_path}/parse.py", "--tagger", f"{sys.executable} {tmp_path}/tag.py"], spark) == 0
    got = spark.read.option("header", True).csv(out).collect()
    assert len(got) == 1 and got[0]["filename"] == "a" and len(got[0]) == 58


def test_turtle_nests_and_iris_are_decoded(spark, tmp_path):
    text = r"""@prefix e: <http://e/> . @base <http://b/> .
e:s e:p [ e:q "x;]" , 'y'@en ; e:r [ e:t <rel> ] ] ; e:l ( e:a "b"^^e:int ( ) ) .
[ e:p e:o ] e:z e:z2. <http://e/\u00e9> e:a\,b '''long
' one''' ."""
    got = list(rdf.turtle_triples(text))
    e = "http://e/"
    assert [(s, p.removeprefix(e), o.removeprefix(e), k) for s, p, o, k in got[:6]] == [
        ("_:made1", "q", "x;]", "literal"), ("_:made1", "q", "y", "literal"), ("_:made2", "t", "http://b/rel", "iri"), ("_:made1", "r", "_:made2", "bnode"), (e + "s", "p", "_:made1", "bnode"),
        ("_:made3", rdf.FIRST, "a", "iri"),
    ]
    assert [(s, p, o) for s, p, o, _ in got[6:12]] == [("_:made3", rdf.REST, "_:made4"), ("_:made4", rdf.FIRST, "b"), ("_:made4", rdf.REST, "_:made5"), ("_:made5", rdf.FIRST, rdf.NIL), ("_:made5", rdf.REST, rdf.NIL), (e + "s", e + "l", "_:made3")]
    assert got[12:] == [("_:made6", e + "p", e + "o", "iri"), ("_:made6", e + "z", e + "z2", "iri"), (e + "é", e + "a,b", "long\n' one", "literal")]
    (tmp_path / "a.nt").write_text("<a:\\u00e9x\\u0041> <a:\\U0001F600\\u00e9p> <a:\\\\user> .\n")
    assert rows(rdf.read_ntriples(spark, str(tmp_path / "a.nt"))) == [("a:éxA", "a:😀ép", "a:\\\\user", "iri")]
