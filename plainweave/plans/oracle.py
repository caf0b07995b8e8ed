"""DuckDB SQL for the registered queries."""

from __future__ import annotations

#: Written out here rather than taken from the engine, so that an error there shows. Fixed values.
ROOT = "#AbstractConcept#"
NAMESPACES = (("DBPedia", "http://dbpedia.org/ontology/"), ("Schema", "http://schema.org/"), ("yago", "http://dbpedia.org/class/yago/"))
COLOURS = {"DBPedia": "red", "Schema": "blue", "yago": "purple", "ROOT": "black"}
DEFAULT_COLOUR = "green"
PARAGRAPH_THRESHOLD = 150
SIZES = {1: 4, 2: 12, 3: 40}
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
LEXICAL = [
    "sentences", "wordtypes", "swordtypes", "lextypes", "slextypes", "wordtokens", "swordtokens", "lextokens", "slextokens", "ld", "ls1", "ls2", "vs1", "vs2", "cvs1",
    "ndw", "ndwz", "ndwerz", "ndwesz", "ttr", "msttr", "cttr", "rttr", "logttr", "uber", "lv", "vv1", "svv1", "cvv1", "vv2", "nv", "adjv", "advv", "modv",
]
#: The published substitutions one by one.
TREEBANK = [
    (r'^"', "``"), (r"(``)", " $1 "), (r"([ \(\[{<])(\"|'{2})", "$1 `` "), (r"([:,])([^\d])", " $1 $2"), (r"([:,])$", " $1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", " $1 "),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", "$1 $2$3 "), (r"([?!])", " $1 "), (r"([^'])' ", "$1 ' "), (r"([\]\[\(\)\{\}\<\>])", " $1 "), (r"--", " -- "), (r"^", " "), (r"$", " "), (r'"', " '' "),
    (r"(\S)('')", "$1 $2 "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "), (r"(?i)\b(can)(not)\b", " $1 $2 "), (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "), (r"(?i)\b(gon)(na)\b", " $1 $2 "), (r"(?i)\b(got)(ta)\b", " $1 $2 "), (r"(?i)\b(lem)(me)\b", " $1 $2 "), (r"(?i)\b(mor)('n)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na)\s", " $1 $2 "), (r"(?i) ('t)(is)\b", " $1 $2 "), (r"(?i) ('t)(was)\b", " $1 $2 "),
]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _treebank(text: str) -> str:
    out = text
    for pattern, put in TREEBANK:
        if pattern == "^":
            out = f"(' ' || {out})"
        elif pattern == "$":
            out = f"({out} || ' ')"
        else:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(put.replace('$', chr(92)))}, 'g')"
    return out


def _parts(text: str) -> str:
    cleaned = rf"regexp_replace({text}, '[\x00-\x09\x0b-\x1f\x{{80}}-\x{{9e}}]', ' ', 'g')"
    return f"list_filter(string_split({cleaned}, chr(10) || chr(10)), lambda p: length(p) > {PARAGRAPH_THRESHOLD})"


DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"
PARTS = f"parts AS (SELECT doc_id, {_parts(DOUBLED)} AS p FROM documents)"
COUNT = f"len(list_filter(regexp_split_to_array({_treebank('p')}, '\\s+'), lambda x: x <> ''))"

WORDS = r"""
split AS (SELECT doc_id, string_split(text, ' ') AS x FROM documents),
tokens AS (SELECT doc_id, unnest(x) AS token, unnest(range(len(x))) AS ord FROM split),
words AS (
  SELECT doc_id, ord, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    lower(regexp_replace(token, '[^A-Za-z]', '', 'g')) AS w FROM tokens)"""
MENTIONS = f"""{WORDS},
names AS (
  SELECT DISTINCT w, ('0x' || substr(md5(w), 3, 4))::BIGINT AS rk
  FROM words WHERE length(w) >= 8 AND ('0x' || substr(md5(w), 1, 2))::BIGINT < 24),
mentions AS (SELECT doc_id, ord, "offset", 'http://dbpedia.org/resource/' || w AS uri, rk FROM words JOIN names USING (w))"""


def _class(level: int, k: str) -> str:
    return f"([{', '.join(_quoted(u) for _, u in NAMESPACES)}][({k}) % 3 + 1] || 'C{level}_' || ({k})::VARCHAR)"


def _taxonomy() -> str:
    parts = []
    for level in (2, 3):
        up = SIZES[level - 1]
        for p, where in ((f"k % {up}", "true"), (f"(k + 1) % {up}", "k % 5 = 0")):
            parts.append(f"SELECT {_class(level, 'k')} AS cls, {_class(level - 1, p)} AS parent FROM range({SIZES[level]}) t(k) WHERE {where}")
    return "taxonomy AS (" + " UNION ".join(parts) + ")"


TYPES = f"""{_taxonomy()},
types AS (
  SELECT DISTINCT 'http://dbpedia.org/resource/' || w AS uri, type FROM (
    SELECT w, {_class(3, "rk % 40")} AS type FROM names WHERE rk % 11 <> 0
    UNION ALL SELECT w, {_class(3, "rk * 7 % 40")} FROM names WHERE rk % 11 <> 0
    UNION ALL SELECT w, 'http://example.org/Thing' FROM names WHERE rk % 13 = 0))"""
E = "'http://example.org/"
RDF = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
TRIPLES = f"""{MENTIONS}, {TYPES},
triples AS (
  SELECT {E}customer/' || c_custkey AS s, {E}in' AS p, {E}nation/' || c_nationkey AS o, 'iri' AS o_kind FROM customer
  UNION ALL SELECT {E}customer/' || c_custkey, {E}name', c_name, 'literal' FROM customer
  UNION ALL SELECT {E}nation/' || n_nationkey, {E}in', {E}region/' || n_regionkey, 'iri' FROM nation
  UNION ALL SELECT {E}nation/' || n_nationkey, {E}name', n_name, 'literal' FROM nation
  UNION ALL SELECT {E}supplier/' || s_suppkey, {E}in', {E}nation/' || s_nationkey, 'iri' FROM supplier
  UNION ALL SELECT {E}order/' || o_orderkey, {E}by', {E}customer/' || o_custkey, 'iri' FROM orders
  UNION ALL SELECT {E}order/' || l_orderkey, {E}part', {E}part/' || l_partkey, 'iri' FROM lineitem
  UNION ALL SELECT {E}order/' || l_orderkey, {E}from', {E}supplier/' || l_suppkey, 'iri' FROM lineitem
  UNION ALL SELECT 'http://dbpedia.org/resource/' || w, {E}near', {E}nation/' || (rk % 25), 'iri' FROM names
  UNION ALL SELECT {E}nation/' || (rk % 25), {E}knows', 'http://dbpedia.org/resource/' || w, 'iri' FROM names
  UNION ALL SELECT uri, {RDF}, type, 'iri' FROM types
  UNION ALL SELECT cls, 'http://www.w3.org/2000/01/rdf-schema#subClassOf', parent, 'iri' FROM taxonomy)"""
INFO = f"""{TRIPLES},
t AS (SELECT s AS uri, string_agg(DISTINCT o, '|' ORDER BY o) AS types, count(DISTINCT o) AS n FROM triples WHERE p = {RDF} AND o_kind = 'iri' GROUP BY s),
i AS (SELECT o AS uri, count(*) AS n FROM triples WHERE o_kind <> 'literal' GROUP BY o),
q AS (SELECT s AS uri, count(*) AS n FROM triples GROUP BY s),
info AS (
  SELECT u.uri, coalesce(t.types, '') AS types, coalesce(t.n, 0) AS n_types, coalesce(i.n, 0) AS nb_links_in, coalesce(q.n, 0) AS nb_links_out
  FROM (SELECT DISTINCT uri FROM mentions) u LEFT JOIN t USING (uri) LEFT JOIN i USING (uri) LEFT JOIN q USING (uri))"""


def _managed(ref: str) -> str:
    """The shortest suffix first, then the order of registration, as a list to sort."""
    items = []
    for k, (key, uri) in enumerate(NAMESPACES):
        for start in (key + ":", uri):
            items.append(f"CASE WHEN starts_with({ref}, '{start}') THEN {{'n': length({ref}) - {len(start)}, 'k': {k}, 'uri': '{uri}' || substr({ref}, {len(start) + 1})}} END")
    return f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))[1].uri"


CLOSURE = f"""reach AS (SELECT DISTINCT cls, cls AS node FROM taxonomy UNION SELECT r.cls, t.parent FROM reach r JOIN taxonomy t ON t.cls = r.node),
closure AS (SELECT r.cls, r.node AS child, coalesce(t.parent, '{ROOT}') AS parent FROM reach r LEFT JOIN taxonomy t ON t.cls = r.node)"""
GRAPH = f"""{INFO}, {CLOSURE},
resources AS (
  SELECT doc_id, uri, count(*) AS count, max_by("offset", ord) AS "offset", any_value(n_types) AS nbTypes, any_value(nb_links_in) AS nbLinksIn, any_value(nb_links_out) AS nbLinksOut
  FROM mentions JOIN info USING (uri) GROUP BY doc_id, uri),
said AS (
  SELECT uri, type FROM types
  UNION SELECT 'http://dbpedia.org/resource/' || w, 'Schema:C3_' || (rk % 40) FROM names WHERE rk % 4 = 0
  UNION SELECT 'http://dbpedia.org/resource/' || w, 'Unknown:Thing' FROM names WHERE rk % 4 = 0),
typed AS (SELECT DISTINCT r.doc_id, r.uri, {_managed("t.type")} AS type FROM resources r JOIN said t USING (uri) WHERE {_managed("t.type")} IS NOT NULL),
pairs AS (
  SELECT doc_id, uri AS a, type AS b FROM typed
  UNION SELECT d.doc_id, c.child, c.parent FROM (SELECT DISTINCT doc_id, type FROM typed) d JOIN closure c ON c.cls = d.type
  UNION SELECT doc_id, type, '{ROOT}' FROM typed d WHERE NOT EXISTS (FROM taxonomy t WHERE t.cls = d.type)
  UNION SELECT r.doc_id, r.uri, '{ROOT}' FROM resources r WHERE NOT EXISTS (FROM typed t WHERE t.doc_id = r.doc_id AND t.uri = r.uri)),
edges AS (SELECT DISTINCT doc_id, least(a, b) AS src, greatest(a, b) AS dst FROM pairs WHERE a <> b),
vertices AS (
  SELECT e.doc_id, e.id, r.uri IS NOT NULL AS resource, r.count, r."offset", r.nbTypes, r.nbLinksIn, r.nbLinksOut
  FROM (SELECT doc_id, src AS id FROM edges UNION SELECT doc_id, dst FROM edges) e LEFT JOIN resources r ON r.doc_id = e.doc_id AND r.uri = e.id)"""
DENSITY = "CASE WHEN {n} <= 1 THEN 1.0::DOUBLE ELSE (2 * {m})::DOUBLE / ({n} * ({n} - 1)) END"


def _in(uri: str, column: str = "id", resource: str = "resource") -> str:
    return f"({resource} OR {column} = '{ROOT}' OR starts_with({column}, '{uri}'))"


NS_NODES = ", ".join(f"count(*) FILTER ({_in(u)}) AS nbNodes_{k}" for k, u in NAMESPACES)
NS_EDGES = ", ".join(f"count(*) FILTER ({_in(u, 'src', 'a.resource')} AND {_in(u, 'dst', 'b.resource')}) AS m_{k}" for k, u in NAMESPACES)
NS_OUT = ", ".join(f"nbNodes_{k}, round({DENSITY.format(n=f'nbNodes_{k}', m=f'm_{k}')}, 6) AS density_{k}" for k, _ in NAMESPACES)
COUNTS = f"""{GRAPH},
node_counts AS (
  SELECT doc_id, (sum(count) FILTER (resource))::BIGINT AS nbConcepts, count(*) FILTER (resource) AS nbUniqueConcepts, count(*) AS nbNodes,
    avg(nbTypes) FILTER (resource) AS nbTypesMean, stddev_pop(nbTypes) FILTER (resource) AS nbTypesStd, avg(nbLinksIn) FILTER (resource) AS nbLinkInMean,
    stddev_pop(nbLinksIn) FILTER (resource) AS nbLinkInStd, avg(nbLinksOut) FILTER (resource) AS nbLinkOutMean, stddev_pop(nbLinksOut) FILTER (resource) AS nbLinkOutStd, {NS_NODES}
  FROM vertices GROUP BY doc_id),
edge_counts AS (
  SELECT e.doc_id, count(*) AS nbEdges, {NS_EDGES}
  FROM edges e JOIN vertices a ON a.doc_id = e.doc_id AND a.id = e.src JOIN vertices b ON b.doc_id = e.doc_id AND b.id = e.dst GROUP BY e.doc_id)"""
SIX = ", ".join(f"round({x}{y}, 6) AS {x}{y}" for x in ("nbTypes", "nbLinkIn", "nbLinkOut") for y in ("Mean", "Std"))
STEPS = "steps AS (SELECT doc_id, src, dst FROM edges UNION SELECT doc_id, dst, src FROM edges)"
ASSORT = f"""{STEPS},
degrees AS (SELECT doc_id, src, count(*) AS degree FROM steps GROUP BY doc_id, src),
pairs_of_degrees AS (
  SELECT s.doc_id, count(*)::HUGEINT AS n, sum(a.degree)::HUGEINT AS x, sum(a.degree * a.degree)::HUGEINT AS xx, sum(a.degree * b.degree)::HUGEINT AS xy
  FROM steps s JOIN degrees a ON a.doc_id = s.doc_id AND a.src = s.src JOIN degrees b ON b.doc_id = s.doc_id AND b.src = s.dst GROUP BY s.doc_id),
assort AS (SELECT doc_id, CASE WHEN n * xx > x * x THEN (n * xy - x * x)::DOUBLE / (n * xx - x * x)::DOUBLE END AS assortativity FROM pairs_of_degrees)"""
#: A node may be reached again later on, never more than 16 steps away in these graphs; the least number counts.
PATHS = """walk AS (
  SELECT doc_id, src, src AS dst, 0 AS d FROM (SELECT DISTINCT doc_id, src FROM steps)
  UNION SELECT w.doc_id, w.src, s.dst, w.d + 1 FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.src = w.dst WHERE w.d < 10),
paths AS (SELECT doc_id, src, dst, min(d) AS d FROM walk GROUP BY doc_id, src, dst)"""
LENGTHS = f"""lengths AS (
  SELECT doc_id, coalesce(list_sum(list_transform({_parts("text")}, lambda p: {COUNT})), 0)::BIGINT AS nbWord
  FROM documents)"""
DENSE = """far AS (SELECT doc_id, src, max(d) AS far FROM paths GROUP BY doc_id, src),
wide AS (SELECT doc_id, min(far)::BIGINT AS radius, max(far)::BIGINT AS diameter FROM far GROUP BY doc_id),
gaps AS (
  SELECT p.doc_id, power(abs(a."offset" - b."offset")::DOUBLE / l.nbWord, 2) * sqrt(p.d::DOUBLE / w.diameter) AS value
  FROM paths p JOIN resources a ON a.doc_id = p.doc_id AND a.uri = p.src JOIN resources b ON b.doc_id = p.doc_id AND b.uri = p.dst
    JOIN wide w ON w.doc_id = p.doc_id JOIN lengths l ON l.doc_id = p.doc_id WHERE p.src < p.dst),
dense AS (SELECT doc_id, avg(value) AS textDensityMean, stddev_pop(value) AS textDensityStd FROM gaps GROUP BY doc_id)"""

_refs = " UNION ".join(
    f"SELECT {x} AS ref FROM range(40) t(k)"
    for x in ("'Schema:C' || k", "'DBPedia:C' || k", "'DBpedia:C' || k", "'http://dbpedia.org/class/yago/C' || k", "'http://dbpedia.org/ontology/C' || k", "'http://example.org/C' || k", "'http://schema.org/'")
)
_qname = "CASE " + " ".join(f"WHEN ref = '{u}' THEN '{k}' WHEN starts_with(ref, '{u}') THEN '{k}:' || substr(ref, {len(u) + 1})" for k, u in (*NAMESPACES, ("ROOT", ROOT))) + " ELSE string_split(ref, '/')[-1] END"
_color = "CASE string_split(qname, ':')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items()) + f" ELSE '{DEFAULT_COLOUR}' END"

TAGGED = rf"""{WORDS},
t0 AS (SELECT doc_id, ord AS idx, lower(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')) AS word FROM words),
lines AS (
  SELECT *, CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 'cd' WHEN regexp_matches(word, 'us$') THEN ',' WHEN regexp_matches(word, 'is$') THEN 'sent' WHEN regexp_matches(word, 'ar$') THEN 'sym' WHEN regexp_matches(word, '(ly)$') THEN 'rb' WHEN regexp_matches(word, '(ing|ed)$') THEN 'vb'
    WHEN regexp_matches(word, '(tion|er|st)$') THEN 'nn' WHEN length(word) <= 3 THEN 'dt' WHEN regexp_matches(word, '(le|ent)$') THEN 'jj' ELSE 'nn' END AS pos
  FROM t0 WHERE word <> ''),
lists AS (SELECT word AS lemma, count(*) AS freq, bool_or(pos = 'jj' OR length(word) % 4 = 0) AS is_adj FROM lines GROUP BY word),
tagged AS (SELECT * FROM lines WHERE NOT contains('{PUNCTUATION}', pos) AND pos NOT IN ('sent', 'sym')),
ranks AS (SELECT lemma, row_number() OVER (ORDER BY freq DESC, lemma DESC) AS rnk FROM lists QUALIFY rnk <= 2000)"""
FLAGS = f"""{TAGGED},
flagged AS (
  SELECT t.doc_id, t.word, r.lemma IS NULL AS rare, t.pos, left(t.pos, 1) = 'n' AS noun, left(t.pos, 1) = 'j' AS adj,
    left(t.pos, 1) = 'r' AND (coalesce(l.is_adj, false) OR coalesce(right(t.word, 2) = 'ly' AND s.is_adj, false)) AS adv, left(t.pos, 1) = 'v' AND t.word NOT IN ('be', 'have') AS verb,
    row_number() OVER (PARTITION BY t.doc_id ORDER BY t.idx) AS rn, count(*) OVER (PARTITION BY t.doc_id) AS n
  FROM tagged t LEFT JOIN ranks r ON r.lemma = t.word LEFT JOIN lists l ON l.lemma = t.word LEFT JOIN lists s ON s.lemma = left(t.word, length(t.word) - 2)),
f AS (SELECT *, noun OR adj OR adv OR verb AS lex FROM flagged)"""
_WHEN = {"word": "true", "sword": "rare AND pos <> 'cd'", "lex": "lex", "slex": "lex AND rare", "verb": "verb", "sverb": "verb AND rare", "adj": "adj", "adv": "adv", "noun": "noun"}
LCOUNTS = f"""{FLAGS},
by_doc AS (
  SELECT doc_id, {", ".join(f"count(DISTINCT word) FILTER ({w}) AS {c}types" for c, w in _WHEN.items())}, {", ".join(f"count(*) FILTER ({w}) AS {c}tokens" for c, w in _WHEN.items())}
  FROM f GROUP BY doc_id),
counts AS (
  SELECT doc_id, sentences, {", ".join(f"coalesce({c}{x}, 0) AS {c}{x}" for c in _WHEN for x in ("types", "tokens"))}
  FROM (SELECT doc_id, count(*) AS sentences FROM lines GROUP BY doc_id) LEFT JOIN by_doc USING (doc_id))"""
#: Straight from the definitions: every run of 50 tokens and every whole segment is counted for itself.
SAMPLES = """per_word AS (SELECT doc_id, word, count(*) AS freq, any_value(n) AS n FROM f GROUP BY doc_id, word),
drawn AS (
  SELECT doc_id, sum(1 - list_product(list_transform(range(50), lambda i: greatest(0.0::DOUBLE, (n - freq - i)::DOUBLE / (n - i))))) AS ndwerz FROM per_word WHERE n >= 50 GROUP BY doc_id),
listed AS (SELECT doc_id, list(word ORDER BY rn) AS ws, any_value(n) AS n FROM f GROUP BY doc_id),
starts AS (SELECT doc_id, ws, unnest(range(n - 49)) AS s FROM listed WHERE n >= 50),
runs AS (SELECT doc_id, s, len(list_distinct(ws[s + 1:s + 50])) AS k FROM starts),
run_means AS (SELECT doc_id, avg(k) AS ndwesz, avg(k / 50.0::DOUBLE) FILTER (s % 50 = 0) AS msttr, max(k) FILTER (s = 0) AS ndwz FROM runs GROUP BY doc_id),
samples AS (
  SELECT l.doc_id, l.n, len(list_distinct(l.ws)) AS ndw, coalesce(r.ndwz, len(list_distinct(l.ws)))::DOUBLE AS ndwz, coalesce(d.ndwerz, len(list_distinct(l.ws)))::DOUBLE AS ndwerz,
    coalesce(r.ndwesz, len(list_distinct(l.ws)))::DOUBLE AS ndwesz, coalesce(r.msttr, len(list_distinct(l.ws))::DOUBLE / l.n) AS msttr
  FROM listed l LEFT JOIN run_means r USING (doc_id) LEFT JOIN drawn d USING (doc_id))"""
_RATIO = {
    "ld": "lextokens / nullif(wordtokens, 0)", "ls1": "slextokens / nullif(lextokens, 0)", "ls2": "swordtypes / nullif(wordtypes, 0)", "vs1": "sverbtypes / nullif(verbtokens, 0)",
    "vs2": "sverbtypes * sverbtypes / nullif(verbtokens, 0)", "cvs1": "sverbtypes / nullif(sqrt(2 * verbtokens), 0)", "ttr": "wordtypes / nullif(wordtokens, 0)", "cttr": "wordtypes / nullif(sqrt(2 * wordtokens), 0)",
    "rttr": "wordtypes / nullif(sqrt(wordtokens), 0)", "logttr": "ln(nullif(wordtypes, 0)) / nullif(ln(nullif(wordtokens, 0)), 0)", "uber": "power(log10(nullif(wordtokens, 0)), 2) / nullif(log10(nullif(wordtokens, 0)::DOUBLE / nullif(wordtypes, 0)), 0)",
    "lv": "lextypes / nullif(lextokens, 0)", "vv1": "verbtypes / nullif(verbtokens, 0)", "svv1": "verbtypes * verbtypes / nullif(verbtokens, 0)", "cvv1": "verbtypes / nullif(sqrt(2 * verbtokens), 0)",
    "vv2": "verbtypes / nullif(lextokens, 0)", "nv": "nountypes / nullif(nountokens, 0)", "adjv": "adjtypes / nullif(lextokens, 0)", "advv": "advtypes / nullif(lextokens, 0)", "modv": "(advtypes + adjtypes) / nullif(lextokens, 0)",
}
_PLAIN = {"ndw": "wordtypes", "ndwz": "coalesce(ndwz, 0)", "ndwerz": "coalesce(ndwerz, 0)", "ndwesz": "coalesce(ndwesz, 0)", "msttr": "msttr"}
LVECTOR = ", ".join(f"round(({(_RATIO | _PLAIN)[x]})::DOUBLE, 6) AS {x}" if x in _RATIO | _PLAIN else f"{x}::DOUBLE AS {x}" for x in LEXICAL)

SEMANTIC = f"""
SELECT l.doc_id, l.nbWord::DOUBLE AS nbWord, coalesce(nbConcepts, 0)::DOUBLE AS nbConcepts, coalesce(nbUniqueConcepts, 0)::DOUBLE AS nbUniqueConcepts,
  round(coalesce(nbConcepts, 0)::DOUBLE / nullif(l.nbWord, 0), 6) AS conceptsWordsRatio, round(coalesce(nbUniqueConcepts, 0)::DOUBLE / nullif(l.nbWord, 0), 6) AS uniqueConceptsWordsRatio,
  coalesce(nbNodes, 0)::DOUBLE AS nbNodes, coalesce(radius, 0)::DOUBLE AS radius, coalesce(diameter, 0)::DOUBLE AS diameter,
  round(CASE WHEN nbNodes IS NULL THEN 0 ELSE assortativity END, 6) + 0.0::DOUBLE AS assortativity, round(CASE WHEN nbNodes IS NULL THEN 1 ELSE {DENSITY.format(n="nbNodes", m="nbEdges")} END, 6) AS density,
  round(CASE WHEN nbNodes IS NULL THEN 0 ELSE textDensityMean END, 6) AS textDensityMean, round(CASE WHEN nbNodes IS NULL THEN 0 ELSE textDensityStd END, 6) AS textDensityStd, {SIX},
  {", ".join(f"coalesce(nbNodes_{k}, 0)::DOUBLE AS nbNodes_{k}, round(CASE WHEN nbNodes IS NULL THEN 1 ELSE {DENSITY.format(n=f'nbNodes_{k}', m=f'm_{k}')} END, 6) AS density_{k}" for k, _ in NAMESPACES)}
FROM lengths l LEFT JOIN node_counts USING (doc_id) LEFT JOIN edge_counts USING (doc_id) LEFT JOIN wide USING (doc_id) LEFT JOIN dense USING (doc_id) LEFT JOIN assort USING (doc_id)"""


#: The small trees again. Fixed values.
TREES = [
    "(ROOT (S (NP (PRP He)) (VP (VBZ runs)) (. .)))",
    "(ROOT (S (VP (VB Go) (ADVP (RB home)))))",
    "(ROOT (S (S (NP (PRP I)) (VP (VBD came))) (CC and) (S (NP (PRP I)) (VP (VBD saw)))))",
    "(ROOT (S (NP (PRP He)) (VP (VBZ says) (SBAR (IN that) (S (NP (PRP she)) (VP (VBZ sleeps)))))))",
    "(ROOT (S (SBAR (IN For) (S (NP (PRP him)) (VP (TO to) (VP (VB leave))))) (VP (VBD was) (ADJP (JJ hard)))))",
    "(ROOT (S (SBAR (WHNP (WP What)) (S (NP (PRP he)) (VP (VBD said)))) (VP (VBZ is) (ADJP (JJ true)))))",
    "(ROOT (S (S (VP (VBG Swimming))) (VP (VBZ is) (NP (NN fun)))))",
    "(ROOT (S (S (VP (TO To) (VP (VB err)))) (VP (VBZ is) (ADJP (JJ human)))))",
    "(ROOT (FRAG (NP (NP (DT A) (JJ red) (NN house)) (PP (IN on) (NP (DT the) (NN hill))))))",
    "(ROOT (FRAG (SBAR (IN because) (S (NP (PRP he)) (VP (VBD left))))))",
    "(ROOT (SQ (VBZ Is) (NP (DT this)) (ADJP (JJ right))))",
    "(ROOT (SQ (MD Can) (NP (PRP you)) (VP (VB come))))",
    "(ROOT (SBARQ (WHNP (WP Who)) (SQ (VP (VBD called)))))",
    "(ROOT (S (NP (NP (NNP Ann)) (CC and) (NP (NNP Bob))) (VP (VP (VBP sing)) (CC and) (VP (VBP dance)))))",
    "(ROOT (S (NP (NP (NNP Ann) (POS 's)) (NN dog)) (VP (MD will) (VP (VB bark)))))",
    "(ROOT (SINV (ADVP (RB Here)) (VP (VBZ comes)) (NP (NP (DT the) (NN sun)) (, ,) (NP (DT the) (NN star)))))",
    "(ROOT (NP (NN Nothing)))",
    "(ROOT (S (NP (PRP We)) (VP (VBP know) (SBAR (IN if) (S (NP (PRP they)) (VP (VB go)))))))",
]


def _trees() -> str:
    """(doc_id, tree) as in the stand-ins."""
    k = len(TREES)
    rows = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(TREES))
    return f"trees AS (SELECT d AS doc_id, string_agg(t, chr(10) ORDER BY i) AS tree FROM range(40) r(d), (VALUES {rows}) v(i, t) WHERE (i + d * 3) % {k} < d % {k} + 1 GROUP BY d)"


#: Parents, ends and sisters by range joins over all brackets of a document.
TREE_NODES = rf"""{_trees()},
x0 AS (SELECT doc_id, regexp_extract_all(tree, '\([^\s()]*|\)|[^\s()]+') AS xs FROM trees),
x1 AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM x0),
x2 AS (
  SELECT *, starts_with(x, '(') AS opened, x = ')' AS closed, sum(CASE WHEN starts_with(x, '(') THEN 1 WHEN x = ')' THEN -1 ELSE 0 END) OVER w AS depth,
    sum(CASE WHEN x = ')' THEN 0 ELSE 1 END) OVER w AS pre FROM x1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (
  SELECT a.doc_id, a.i, a.pre, a.x, a.depth, min(b.i) AS ends FROM x2 a JOIN x2 b ON b.doc_id = a.doc_id AND b.closed AND b.i > a.i AND b.depth = a.depth - 1 WHERE a.opened GROUP BY ALL),
n0 AS (
  SELECT doc_id, i, pre, substr(x, 2) AS label, false AS leaf, ends FROM o
  UNION ALL SELECT doc_id, i, pre, x, true, i FROM x2 WHERE NOT opened AND NOT closed),
n1 AS (
  SELECT n.*, (SELECT max(p.pre) FROM o p WHERE p.doc_id = n.doc_id AND p.i < n.i AND p.ends > n.ends) AS parent,
    (SELECT max(q.pre) FROM n0 q WHERE q.doc_id = n.doc_id AND q.i >= n.i AND q.i <= n.ends) AS last FROM n0 n),
nodes AS (SELECT doc_id, pre::BIGINT AS pre, last::BIGINT AS last, coalesce(parent, 0)::BIGINT AS parent, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre) - 1 AS sib, label, leaf FROM n1)"""


_HEADS = {
    "VP": "TO VBD VBN MD VBZ VB VBG VBP VP ADJP NN NNS NP", "S": "TO IN VP S SBAR ADJP UCP NP", "SINV": "VBZ VBD VBP VB MD VP S SINV ADJP NP",
    "SQ": "VBZ VBD VBP VB MD VP SQ", "SBAR": "WHNP WHPP WHADVP WHADJP IN DT S SQ SINV SBAR FRAG",
}
_RULES = ", ".join(f"('{phrase}', '{x}', {i})" for phrase, order in _HEADS.items() for i, x in enumerate(order.split()))
_FIN, _CLAUSE, _UNIT = "('MD', 'VBZ', 'VBP', 'VBD')", "('S', 'SINV', 'SQ')", "('S', 'SBARQ', 'SINV', 'SQ')"


def _child(where: str, of: str = "n", source: str = "x") -> str:
    return f"EXISTS (FROM {source} c WHERE c.doc_id = {of}.doc_id AND c.parent = {of}.pre AND {where})"


def _below(where: str, source: str = "x") -> str:
    return f"EXISTS (FROM {source} c WHERE c.doc_id = n.doc_id AND c.pre > n.pre AND c.pre <= n.last AND {where})"


#: Each pattern from its definition, by subqueries over the nodes; every node counts once.
PATTERNS = rf"""{TREE_NODES},
rules(phrase, label, prio) AS (VALUES {_RULES}),
head AS (
  SELECT c.doc_id, c.parent, arg_min(c.pre, coalesce(r.prio, 1000) * 10000 + c.sib) AS pre
  FROM nodes c JOIN nodes p ON p.doc_id = c.doc_id AND p.pre = c.parent LEFT JOIN rules r ON r.phrase = p.label AND r.label = c.label AND NOT c.leaf GROUP BY c.doc_id, c.parent),
x AS (
  SELECT n.*, p.label AS up, CASE WHEN NOT h.leaf THEN h.label END AS head, h.pre AS head_pre, s.label AS next_label
  FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.pre = n.parent
    LEFT JOIN head hd ON hd.doc_id = n.doc_id AND hd.parent = n.pre LEFT JOIN nodes h ON h.doc_id = n.doc_id AND h.pre = hd.pre
    LEFT JOIN nodes s ON s.doc_id = n.doc_id AND s.parent = n.parent AND n.parent > 0 AND s.sib = n.sib + 1 AND NOT s.leaf),
fvp AS (
  SELECT * FROM x n WHERE label = 'VP' AND NOT leaf AND (head IN {_FIN} OR ({_child("c.label = 'CC' AND NOT c.leaf")} AND {_child(f"c.label = 'VP' AND NOT c.leaf AND c.head IN {_FIN}")}))),
clause AS (
  SELECT * FROM x n WHERE label IN {_CLAUSE} AND NOT leaf AND ((up = 'ROOT' AND {_child("c.sib = 0 AND c.label = 'VP' AND NOT c.leaf AND c.head = 'VB'")}) OR head IN {_FIN} OR {_child("true", "n", "fvp")})),
unit AS (
  SELECT * FROM x n WHERE label IN {_UNIT} AND NOT leaf AND (up = 'ROOT' OR (
    EXISTS (FROM x c WHERE c.doc_id = n.doc_id AND c.parent = n.parent AND n.parent > 0 AND c.sib < n.sib AND c.label IN {_UNIT} AND NOT c.leaf)
    AND NOT EXISTS (FROM x c WHERE c.doc_id = n.doc_id AND c.pre < n.pre AND n.pre <= c.last AND c.label IN ('SBAR', 'VP') AND NOT c.leaf)))),
dependent AS (SELECT * FROM x n WHERE label = 'SBAR' AND NOT leaf AND {_child("true", "n", "clause")}),
hits AS (
  SELECT doc_id, 'S' AS k FROM x WHERE label = 'ROOT' AND NOT leaf
  UNION ALL SELECT doc_id, 'VP' FROM x WHERE label = 'VP' AND NOT leaf AND up IN {_CLAUSE}
  UNION ALL SELECT doc_id, 'C' FROM clause
  UNION ALL SELECT doc_id, 'T' FROM unit
  UNION ALL SELECT doc_id, 'DC' FROM dependent
  UNION ALL SELECT doc_id, 'CT' FROM unit n WHERE {_below("true", "dependent")}
  UNION ALL SELECT doc_id, 'CP' FROM x n WHERE label IN ('ADJP', 'ADVP', 'NP', 'VP') AND NOT leaf AND {_child("c.label = 'CC' AND NOT c.leaf")}
  UNION ALL SELECT doc_id, 'CN' FROM x n WHERE label = 'NP' AND NOT leaf AND coalesce(up, '') <> 'NP' AND ({_below("NOT c.leaf AND c.label IN ('JJ', 'POS', 'PP', 'S', 'VBG')")}
    OR {_below("NOT c.leaf AND c.label = 'NP' AND c.parent > 0 AND coalesce(c.next_label, '') <> 'CC' AND EXISTS (FROM x d WHERE d.doc_id = c.doc_id AND d.parent = c.parent AND d.sib > c.sib AND d.label = 'NP' AND NOT d.leaf)")})
  UNION ALL SELECT doc_id, 'CN' FROM x n WHERE label = 'SBAR' AND NOT leaf AND (next_label = 'VP' OR up = 'VP') AND (head = 'WHNP'
    OR {_child("c.pre = n.head_pre AND c.label = 'IN' AND NOT c.leaf AND EXISTS (FROM x d WHERE d.doc_id = c.doc_id AND d.parent = c.pre AND d.leaf AND d.label IN ('That', 'that', 'For', 'for'))")}
    OR {_child("c.sib = 0 AND c.label = 'S' AND NOT c.leaf")})
  UNION ALL SELECT doc_id, 'CN' FROM x n WHERE label = 'S' AND NOT leaf AND next_label = 'VP' AND {_child("c.label = 'VP' AND NOT c.leaf AND c.head IN ('VBG', 'TO')")}
  UNION ALL SELECT doc_id, 'C' FROM x n WHERE label = 'FRAG' AND NOT leaf AND up = 'ROOT' AND NOT {_below("true", "clause")}
  UNION ALL SELECT doc_id, 'T' FROM x n WHERE label = 'FRAG' AND NOT leaf AND up = 'ROOT' AND NOT {_below("true", "unit")}
  UNION ALL SELECT n.doc_id, 'VP' FROM x n JOIN x p ON p.doc_id = n.doc_id AND p.pre = n.parent AND p.label = 'SQ' WHERE n.label IN {_FIN} AND NOT n.leaf AND NOT {_child("c.label = 'VP' AND NOT c.leaf", "p")}),
sums AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = '{k}') AS {k}" for k in ("S", "VP", "C", "T", "DC", "CT", "CP", "CN"))} FROM hits GROUP BY doc_id),
patterns AS (
  SELECT t.doc_id, len(regexp_extract_all(t.tree, '\([A-Z]+\$? [^)(]+\)'))::BIGINT AS W, {", ".join(f"coalesce({k}, 0)::BIGINT AS {k}" for k in ("S", "VP", "C", "T", "DC", "CT", "CP", "CN"))}
  FROM trees t LEFT JOIN sums USING (doc_id))"""
_DIVIDED = {
    "MLS": "W S", "MLT": "W T", "MLC": "W C", "C/S": "C S", "VP/T": "VP T", "C/T": "C T", "DC/C": "DC C", "DC/T": "DC T", "T/S": "T S", "CT/T": "CT T", "CP/T": "CP T", "CP/C": "CP C", "CN/T": "CN T", "CN/C": "CN C",
}
YVECTOR = ", ".join([f"{k}::DOUBLE AS {k}" for k in ("W", "S", "VP", "C", "T", "DC", "CT", "CP", "CN")] + [f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE ELSE round({a}::DOUBLE / {b}, 6) END AS \"{name}\"" for name, (a, b) in ((n, x.split()) for n, x in _DIVIDED.items())])


def _q(name: str) -> str:
    return f'"{name}"'


ORACLE: dict[str, str] = {
    "pf_clean_paragraphs": f"WITH {PARTS} SELECT doc_id, len(p)::BIGINT AS n_paragraphs, md5(array_to_string(p, chr(10))) AS digest FROM parts",
    "pf_word_count": f"WITH {PARTS} SELECT doc_id, len(p)::BIGINT AS n_paragraphs, coalesce(list_sum(list_transform(p, lambda p: {COUNT})), 0)::BIGINT AS nb_words FROM parts",
    "w_paragraph_offsets": f"""WITH {PARTS}, r AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS par_idx FROM parts)
SELECT doc_id, par_idx, length(t)::BIGINT AS n_chars, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY par_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_offset FROM r""",
    "a_distinct_uris": f"WITH {MENTIONS} SELECT DISTINCT uri FROM mentions",
    "a_mention_counts": f'WITH {MENTIONS} SELECT doc_id, uri, count(*) AS count, max_by("offset", ord) AS "offset" FROM mentions GROUP BY doc_id, uri',
    "a_entity_types": f"WITH {TRIPLES} SELECT s AS uri, string_agg(DISTINCT o, '|' ORDER BY o) AS types FROM triples WHERE p = {RDF} AND o_kind = 'iri' GROUP BY s",
    "a_links_in": f"WITH {TRIPLES} SELECT o AS uri, count(*) AS nb_links_in FROM triples WHERE o_kind <> 'literal' GROUP BY o",
    "a_links_out": f"WITH {TRIPLES} SELECT s AS uri, count(*) AS nb_links_out FROM triples GROUP BY s",
    "a_number_of_types": f"WITH {TRIPLES} SELECT count(DISTINCT (s, o))::BIGINT AS nb_types FROM triples WHERE p = {RDF} AND o_kind = 'iri'",
    "j_concept_info": f"WITH {INFO} SELECT uri, types, nb_links_in, nb_links_out FROM info",
    "pf_managed_uri": f"WITH r AS ({_refs}) SELECT ref, {_managed('ref')} AS uri, {_managed('ref')} IS NOT NULL AS managed FROM r",
    "pf_qname_color": f"WITH r AS ({_refs} UNION SELECT '{ROOT}'), q AS (SELECT ref, {_qname} AS qname FROM r) SELECT ref, qname, {_color} AS color FROM q",
    "j_parents_default_root": f"WITH {_taxonomy()} SELECT c.cls, coalesce(t.parent, '{ROOT}') AS parent FROM (SELECT cls FROM taxonomy UNION SELECT parent FROM taxonomy) c LEFT JOIN taxonomy t USING (cls)",
    "j_ancestor_closure": f"WITH RECURSIVE {_taxonomy()}, {CLOSURE} SELECT cls, child, parent FROM closure",
    "g_vertices": f"WITH RECURSIVE {GRAPH} SELECT doc_id, id, resource, {', '.join(f'coalesce({_q(c)}, -1) AS {_q(c)}' for c in ('count', 'offset', 'nbTypes', 'nbLinksIn', 'nbLinksOut'))} FROM vertices",
    "g_edges": f"WITH RECURSIVE {GRAPH} SELECT * FROM edges",
    "a_graph_counts": f"WITH RECURSIVE {COUNTS} SELECT doc_id, nbConcepts, nbUniqueConcepts, nbNodes, nbEdges, round({DENSITY.format(n='nbNodes', m='nbEdges')}, 6) AS density, {SIX} FROM node_counts JOIN edge_counts USING (doc_id)",
    "a_ns_density": f"WITH RECURSIVE {COUNTS} SELECT doc_id, {NS_OUT} FROM node_counts JOIN edge_counts USING (doc_id)",
    "g_assortativity": f"WITH RECURSIVE {GRAPH}, {ASSORT} SELECT doc_id, round(assortativity, 6) + 0.0::DOUBLE AS assortativity FROM assort",
    "g_distances": f"WITH RECURSIVE {GRAPH}, {STEPS}, {PATHS} SELECT doc_id, d::BIGINT AS d, count(*) AS pairs FROM paths GROUP BY doc_id, d",
    "g_radius_diameter": f"WITH RECURSIVE {GRAPH}, {STEPS}, {PATHS}, {LENGTHS}, {DENSE} SELECT doc_id, radius, diameter FROM wide",
    "g_text_density": f"WITH RECURSIVE {GRAPH}, {STEPS}, {PATHS}, {LENGTHS}, {DENSE} SELECT doc_id, round(textDensityMean, 6) AS textDensityMean, round(textDensityStd, 6) AS textDensityStd FROM wide LEFT JOIN dense USING (doc_id)",
    "g_semantic_vector": f"WITH RECURSIVE {COUNTS}, {ASSORT}, {PATHS}, {LENGTHS}, {DENSE} {SEMANTIC}",
    "sc_word_list_rank": f"WITH {TAGGED} SELECT lemma, rnk FROM ranks",
    "l_counts": f"WITH {LCOUNTS} SELECT doc_id, sentences, {', '.join(f'{c}types, {c}tokens' for c in _WHEN)} FROM counts",
    "l_diversity": f"WITH {FLAGS}, {SAMPLES} SELECT doc_id, n, ndw, {', '.join(f'round({x}, 6) AS {x}' for x in ('ndwz', 'ndwerz', 'ndwesz', 'msttr'))} FROM samples",
    "l_lexical_vector": f"WITH {LCOUNTS}, {SAMPLES} SELECT doc_id, {LVECTOR} FROM counts LEFT JOIN samples USING (doc_id)",
    "t_pattern_counts": f"WITH {PATTERNS} SELECT * FROM patterns",
    "y_syntactic_vector": f"WITH {PATTERNS} SELECT doc_id, {YVECTOR} FROM patterns",
    "t_tree_nodes": f"WITH {TREE_NODES} SELECT * FROM nodes",
    "sc_concepts_files": f"""WITH {MENTIONS} SELECT doc_id, uri, count(*) AS count, max_by("offset", ord) AS "offset",
  any_value(CASE WHEN rk % 4 = 0 THEN 'Schema:C3_' || (rk % 40) || '|Unknown:Thing' ELSE '' END) AS types FROM mentions GROUP BY doc_id, uri""",
    "sc_info_map": f"WITH {INFO} SELECT uri, types, nb_links_in, nb_links_out FROM info",
    "sc_graph_files": f"""WITH RECURSIVE {COUNTS}, {LENGTHS},
  d AS (SELECT doc_id, md5(string_agg(src || ' ' || dst, '|' ORDER BY src || ' ' || dst)) AS digest FROM edges GROUP BY doc_id),
  v AS (SELECT doc_id, sum(count)::BIGINT AS mentions, sum(nbLinksIn)::BIGINT AS links_in FROM vertices GROUP BY doc_id)
SELECT l.doc_id, l.nbWord, n.nbNodes AS nodes, n.nbUniqueConcepts AS resources, v.mentions, v.links_in, e.nbEdges AS edges, d.digest
FROM lengths l LEFT JOIN node_counts n USING (doc_id) LEFT JOIN edge_counts e USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN v USING (doc_id)""",
    "sc_ntriples": f"WITH {TRIPLES} SELECT p, o_kind, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, min(s) AS first, max(o) AS last FROM triples GROUP BY p, o_kind",
    "u_ontologies": f"WITH {_taxonomy()} SELECT cls, parent FROM taxonomy",
    "sc_word_lists": f"""WITH {TAGGED}
SELECT word AS lemma, count(*) AS freq, bool_or(pos = 'jj') AS is_adj, bool_or(pos = 'vb') AS is_verb, bool_or(pos = 'nn') AS is_noun, k AS list
FROM lines, (VALUES ('bnc'), ('anc')) v(k) GROUP BY word, k""",
    "sk_vectors_csv": f"WITH RECURSIVE {COUNTS} SELECT doc_id, nbConcepts, nbUniqueConcepts, nbNodes, nbEdges FROM node_counts JOIN edge_counts USING (doc_id)",
    "pf_annotation_items": """WITH x AS (
  SELECT doc_id, 'u' || doc_id AS uri, CASE WHEN doc_id % 2 = 0 THEN 'DBpedia:A|Schema:B' ELSE '' END AS types, n_chars::BIGINT AS "offset", n_chars::BIGINT AS support FROM documents
  UNION ALL SELECT doc_id, 'v' || doc_id, '', n_chars, try_cast(source AS INT) FROM documents)
SELECT doc_id, uri, types, "offset", support, (doc_id % 10) / 10.0::DOUBLE AS similarity, doc_id % 10 >= 5 AS confident, coalesce(support >= 500, true) AS supported,
  contains(types, 'Schema:B') AS listed, NOT contains(types, 'Schema:B') AS unlisted FROM x WHERE doc_id % 7 > 0""",
    "pf_tagged_text": f"""WITH {TAGGED}, r AS (SELECT doc_id, word, pos, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k FROM lines)
SELECT doc_id, pos, count(*) AS n, count(*) AS lines, count(*) FILTER (pos NOT IN (',', 'sent', 'sym')) AS words, min(word) AS first, sum(k)::BIGINT AS places FROM r GROUP BY doc_id, pos""",
    "j_namespace_parents": f"""WITH {_taxonomy()}
SELECT c.cls, coalesce(t.parent, '{ROOT}') AS parent FROM (SELECT DISTINCT cls FROM taxonomy) c LEFT JOIN (FROM taxonomy WHERE starts_with(parent, 'http://schema.org/')) t USING (cls)""",
    "g_one_namespace": f"""WITH RECURSIVE {GRAPH},
one AS (
  SELECT DISTINCT r.doc_id, r.uri, 'http://schema.org/' || CASE WHEN starts_with(t.type, 'Schema:') THEN substr(t.type, 8) ELSE substr(t.type, 19) END AS type
  FROM resources r JOIN said t USING (uri) WHERE starts_with(t.type, 'Schema:') OR starts_with(t.type, 'http://schema.org/')),
up AS (FROM taxonomy WHERE starts_with(parent, 'http://schema.org/')),
climb AS (SELECT DISTINCT type AS cls, type AS node FROM one UNION SELECT c.cls, u.parent FROM climb c JOIN up u ON u.cls = c.node),
p1 AS (
  SELECT doc_id, uri AS a, type AS b FROM one
  UNION SELECT d.doc_id, c.node, coalesce(u.parent, '{ROOT}') FROM (SELECT DISTINCT doc_id, type FROM one) d JOIN climb c ON c.cls = d.type LEFT JOIN up u ON u.cls = c.node
  UNION SELECT r.doc_id, r.uri, '{ROOT}' FROM resources r WHERE NOT EXISTS (FROM one t WHERE t.doc_id = r.doc_id AND t.uri = r.uri))
SELECT DISTINCT doc_id, least(a, b) AS src, greatest(a, b) AS dst FROM p1 WHERE a <> b""",
    "a_text_length_fallback": f"""WITH RECURSIVE {GRAPH}, {STEPS}, {PATHS}, lengths AS (SELECT doc_id, nullif(max("offset"), 0) AS nbWord FROM resources GROUP BY doc_id), {DENSE}
SELECT doc_id, round(textDensityMean, 6) AS textDensityMean, round(textDensityStd, 6) AS textDensityStd FROM wide LEFT JOIN dense USING (doc_id)""",
    "o_page": f"WITH {TRIPLES} SELECT DISTINCT s AS uri, o AS type FROM triples WHERE p = {RDF} AND o_kind = 'iri' ORDER BY uri, type LIMIT 100 OFFSET 200",
    "sk_skip_existing": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)",
}
