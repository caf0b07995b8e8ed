"""Concept graphs: vertices and edges by document, and their features.

A graph is undirected and simple. Its nodes are the document's resources, their types, and the types' ancestors up to the
root; an untyped resource hangs from the root itself. Everything is a table keyed by document, so that all
graphs are built and measured together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plainweave.functions.namespaces import NAMESPACES, ROOT, Namespaces, in_namespace, managed_uri
from plainweave.operators.mentions import mention_counts
from plainweave.operators.ontology import ancestors
from plainweave.tables import stored

#: Names of the features, in the order of the output. Fixed values.
FEATURES = [
    "nbWord", "nbConcepts", "nbUniqueConcepts", "conceptsWordsRatio", "uniqueConceptsWordsRatio", "nbNodes", "radius", "diameter", "assortativity", "density",
    "textDensityMean", "textDensityStd", "nbTypesMean", "nbTypesStd", "nbLinkInMean", "nbLinkInStd", "nbLinkOutMean", "nbLinkOutStd",
]


def feature_names(namespaces: Namespaces = NAMESPACES) -> list[str]:
    return FEATURES + [f"{x}_{k}" for k, _ in namespaces for x in ("nbNodes", "density")]


def resources(counts: DataFrame, info: DataFrame | None, key: str = "filename") -> DataFrame:
    """(key, uri, count, offset, types, nbTypes, nbLinksIn, nbLinksOut): the resources with what is known of them.

    ``types`` joins the annotator's types with the known ones (U1); nbTypes counts the known ones only, null if nothing is known.
    """
    none = F.lit(None).cast("long")
    if info is None:
        return counts.withColumns({"nbTypes": none, "nbLinksIn": none, "nbLinksOut": none})
    known = info.select("uri", F.col("types").alias("more"), F.size("types").cast("long").alias("nbTypes"), F.col("nb_links_in").alias("nbLinksIn"), F.col("nb_links_out").alias("nbLinksOut"))
    empty = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("types", empty), F.coalesce("more", empty))
    return counts.join(known, "uri", "left").withColumn("types", both).drop("more").select(key, "uri", "count", "offset", "types", "nbTypes", "nbLinksIn", "nbLinksOut")


def by_document(found: DataFrame, key: str = "filename") -> DataFrame:
    """(key, resources): a document's resources in one row. Rows that lie by document already are not shuffled."""
    return found.groupBy(key).agg(F.collect_list(F.struct("uri", "count", "offset", "nbTypes", "nbLinksIn", "nbLinksOut", "types")).alias("resources"))


def stored_resources(mentions: DataFrame, info: DataFrame, key: str = "filename", most: int = 1 << 18) -> DataFrame:
    """``resources`` of the mentions counted by document and URI, from one stored table with a row per document, its ``grouped``.

    The mentions are shuffled once, to their document's task, and counted, joined and put together there: what is known of the URIs goes to all tasks if
    they are ``most`` at most; of more, it is joined by a shuffle of the counts, and another one puts the documents together.
    """
    known = stored(info, "info")
    counts = mention_counts(mentions.repartition(key), key)
    found = resources(counts, F.broadcast(known) if known.count() <= most else known, key)
    grouped = stored(by_document(found, key), "resources")
    out = grouped.select(key, F.inline("resources"))
    out.grouped = grouped
    return out


def resource_types(found: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename") -> DataFrame:
    """(key, uri, type): each resource's managed types, as URIs."""
    rows = found.select(key, "uri", F.explode("types").alias("ref"))
    return rows.select(key, "uri", managed_uri(F.col("ref"), namespaces).alias("type")).filter(F.col("type").isNotNull()).distinct()


def edges(found: DataFrame, taxonomy: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename") -> DataFrame:
    """(key, src, dst) with src < dst: resource to type, class to parent, untyped resource to root; each once.

    Self-loops, which only a faulty taxonomy has, are left out. ``found`` has a resource of a document once, so its types are told within its row;
    all edges of a document meet by one shuffle.
    """
    managed = F.array_distinct(F.filter(F.transform("types", lambda x: managed_uri(x, namespaces)), lambda x: x.isNotNull()))
    empty = F.array().cast("array<string>")
    typed = stored(found.select(key, "uri", (F.coalesce(managed, empty) if namespaces else empty).alias("classes")), "types")
    own = typed.select(key, F.col("uri").alias("a"), F.explode(F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array(F.lit(ROOT)))).alias("b"))
    classes = stored(typed.select(key, F.explode("classes").alias("cls")).distinct(), "classes")
    closure = stored(ancestors(classes, taxonomy), "closure")
    up = classes.join(closure, "cls").select(key, F.col("child").alias("a"), F.col("parent").alias("b"))
    pairs = own.unionByName(up).filter("a <> b").select(key, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return pairs.repartition(key).distinct()


def vertices(found: DataFrame, links: DataFrame, key: str = "filename") -> DataFrame:
    """(key, id, resource, count, offset, nbTypes, nbLinksIn, nbLinksOut): resources with their attributes, and all other nodes."""
    attributes = ["count", "offset", "nbTypes", "nbLinksIn", "nbLinksOut"]
    own = found.select(key, F.col("uri").alias("id"), F.lit(True).alias("resource"), *attributes)
    ends = links.select(key, F.explode(F.array("src", "dst")).alias("id")).withColumn("resource", F.lit(False))
    both = own.unionByName(ends, allowMissingColumns=True)
    return both.groupBy(key, "id").agg(F.bool_or("resource").alias("resource"), *[F.max(a).alias(a) for a in attributes])


def built(found: DataFrame, taxonomy: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename", most: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) as ``vertices`` and ``edges`` make them, from one stored table with a row per graph, its edges and nodes sorted by name, which both are read from.

    Only the resources are shuffled, once, to their document's task. What the distinct types say, the class and the edges above it, goes to all tasks; if these edges
    are more than ``most``, the graphs are built by joins. What takes both tables later on (features, files) finds the rows of graphs by the tables' ``graphs`` and shuffles no node or edge.
    """
    refs = stored(found.select(F.explode("types").alias("ref")).distinct(), "refs")
    named = stored(refs.withColumn("cls", managed_uri(F.col("ref"), namespaces)).filter("cls IS NOT NULL"), "named")
    closure = stored(ancestors(named.select("cls"), taxonomy), "closure")
    if max(named.count(), closure.count()) > most:
        links = stored(edges(found, taxonomy, namespaces, key), "edges")
        return stored(vertices(found, links, key), "vertices"), links
    attributes = ["count", "offset", "nbTypes", "nbLinksIn", "nbLinksOut"]
    rows = getattr(found, "grouped", None)
    if rows is None:
        rows = by_document(found, key)
    kinds = {x: found.schema[x].dataType.simpleString() for x in (key, *attributes)}
    node = ", ".join(f"{x}: {kinds[x]}" for x in attributes)
    builder = _Builder({r["ref"]: r["cls"] for r in named.collect()}, closure.select("cls", "child", "parent").toArrow(), key, attributes)
    sent = found.sparkSession.sparkContext.broadcast(builder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                yield sent.value.graphs(batch.slice(lo, 1000))

    schema = f"{key} {kinds[key]}, edges array<struct<src: string, dst: string>>, nodes array<struct<id: string, resource: boolean, {node}>>"
    made = stored(rows.mapInArrow(run, schema), "graphs")
    nodes, links = (made.select(key, F.inline(c)) for c in ("nodes", "edges"))
    nodes.graphs = links.graphs = made
    return nodes, links


class _Builder:
    """Makes the graphs of a batch from its documents' resources. ``named``: classes by reference; ``closure``: (cls, child, parent)."""

    def __init__(self, named: dict[str, str], closure: pa.Table, key: str, attributes: list[str]):
        self.key, self.attributes = key, attributes
        names = sorted({ROOT, *named.values(), *(x for c in ("cls", "child", "parent") for x in closure[c].to_pylist())})
        at = {x: i for i, x in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.cls = {ref: at[c] for ref, c in named.items()}
        self.root = at[ROOT]
        cls, child, parent = (np.array([at[x] for x in closure[c].to_pylist()], np.int64) for c in ("cls", "child", "parent"))
        order = np.argsort(cls, kind="stable")
        self.child, self.parent = child[order], parent[order]
        self.first = np.searchsorted(cls[order], np.arange(len(names) + 1))

    def graphs(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(1).flatten()
        row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
        uri, types = own.field("uri"), own.field("types")
        of = np.repeat(np.arange(len(own)), pc.fill_null(pc.list_value_length(types), 0).to_numpy())
        refs = types.flatten().dictionary_encode()
        known = np.array([self.cls.get(x, -1) for x in refs.dictionary.to_pylist()], np.int64)
        cls = known[pc.fill_null(refs.indices, 0).to_numpy()] if len(known) else np.full(len(refs), -1)
        cls[pc.is_null(refs).to_numpy(zero_copy_only=False)] = -1
        of, cls = of[cls >= 0], cls[cls >= 0]
        # All names of the batch: the classes' first, so that they keep their numbers.
        coded = pa.concat_arrays([self.names, uri]).dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy()[len(self.names) :].astype(np.int64)
        k = len(coded.dictionary)
        untyped = np.setdiff1d(np.arange(len(own)), of)
        a, b, at = code[np.append(of, untyped)], np.append(cls, np.full(len(untyped), self.root)), row[np.append(of, untyped)]
        some = pc.is_valid(uri).to_numpy(zero_copy_only=False)[np.append(of, untyped)]
        a, b, at = a[some], b[some], at[some]
        # The edges above each document's classes.
        classes = np.unique(row[of] * k + cls)
        low, many = self.first[classes % k], np.diff(self.first)[classes % k]
        above = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        a, b, at = np.append(a, self.child[above]), np.append(b, self.parent[above]), np.append(at, np.repeat(classes // k, many))
        a, b, at = a[a != b], b[a != b], at[a != b]
        # src is the lesser of both names, as Spark compares them.
        rank = np.empty(k, np.int64)
        rank[pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(k)
        turned = rank[a] > rank[b]
        src, dst = np.where(turned, b, a), np.where(turned, a, b)
        back = np.argsort(rank)
        pairs, place = np.unique(rank[src] * k + rank[dst], return_inverse=True)
        once = np.unique(at * max(len(pairs), 1) + place)
        at, pairs = once // max(len(pairs), 1), pairs[once % max(len(pairs), 1)]
        src, dst = back[pairs // k], back[pairs % k]
        edges = _lists(at, batch.num_rows, [coded.dictionary.take(pa.array(src)), coded.dictionary.take(pa.array(dst))], ["src", "dst"])
        # Nodes: the resources, and the ends that are none.
        ends = np.setdiff1d(np.concatenate([at * k + src, at * k + dst]), row * k + code)
        at, ids = np.append(row, ends // k), np.append(code, ends % k)
        order = np.lexsort((rank[ids], at))
        from_own = pa.array(np.where(order < len(own), order, 0), mask=order >= len(own))
        columns = [coded.dictionary.take(pa.array(ids[order])), pa.array(order < len(own)), *[own.field(x).take(from_own) for x in self.attributes]]
        return pa.RecordBatch.from_arrays([batch.column(0), edges, _lists(at[order], batch.num_rows, columns, ["id", "resource", *self.attributes])], names=[self.key, "edges", "nodes"])


def _lists(at: np.ndarray, rows: int, columns: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Lists of structs of the columns, each value in the list of its row ``at``, which ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(rows + 1)), pa.int32()), pa.StructArray.from_arrays(columns, names=names))


def in_one_namespace(found: DataFrame, triples: DataFrame, namespace_key: str, namespaces: Namespaces = NAMESPACES, key: str = "filename") -> DataFrame:
    """The edges with types and parents of one namespace only. An unknown key is an error."""
    from plainweave.operators.ontology import subclass

    uri = dict(namespaces).get(namespace_key)
    if uri is None:
        raise ValueError(f"no namespace has the key {namespace_key}")
    return edges(found, subclass(triples, uri), ((namespace_key, uri),), key)


def density(n: Column, m: Column) -> Column:
    """A10: 2 m / (n (n - 1)); 1 for a graph of one node or none."""
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.try_divide((2 * m).cast("double"), (n * (n - 1)).cast("double")))


def counts(nodes: DataFrame, links: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename") -> DataFrame:
    """nbConcepts, nbUniqueConcepts, nbNodes, density, means and deviations, and nbNodes and density by namespace.

    A namespace's part has its classes, the root and all resources. Whether an edge lies in it is told by its two ends'
    URIs and whether they are resources; a graph's edges are counted in its task.
    """
    resource = F.col("resource")
    member = {k: resource | (F.col("id") == ROOT) | in_namespace(F.col("id"), uri) for k, uri in namespaces}
    if_resource = lambda c: F.when(resource, F.col(c))
    stats = []
    for column, name in (("nbTypes", "nbTypes"), ("nbLinksIn", "nbLinkIn"), ("nbLinksOut", "nbLinkOut")):
        mean, deviation = exact_mean_and_deviation(if_resource(column))
        stats += [mean.alias(f"{name}Mean"), deviation.alias(f"{name}Std")]
    by_node = nodes.groupBy(key).agg(
        F.coalesce(F.sum(if_resource("count")), F.lit(0)).cast("long").alias("nbConcepts"), F.count_if(resource).alias("nbUniqueConcepts"), F.count("*").alias("nbNodes"),
        F.max(if_resource("offset")).alias("maxOffset"), *stats, *[F.count_if(c).alias(f"nbNodes_{k}") for k, c in member.items()],
    )
    by_edge = _edge_sums(nodes, links, namespaces, key).drop("x", "xx", "xy")
    out = by_node.join(by_edge, key, "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("density", density(F.col("nbNodes"), F.coalesce("nbEdges", zero)))
    return out.withColumns({f"density_{k}": density(F.col(f"nbNodes_{k}"), F.coalesce(f"nbEdges_{k}", zero)) for k in member})


def exact_mean_and_deviation(x: Column) -> tuple[Column, Column]:
    """Mean and population deviation of whole numbers from whole sums, so that they don't depend on the order of the rows."""
    wide = x.cast("decimal(19,0)")
    n, total, squares = F.count(x), F.sum(wide), F.sum((wide * wide).cast("decimal(38,0)"))
    under = n.cast("double")
    spread = (n.cast("decimal(19,0)") * squares - total * total).cast("double")
    return F.try_divide(total.cast("double"), under), F.try_divide(F.sqrt(spread), under)


def assortativity(links: DataFrame, key: str = "filename") -> DataFrame:
    """(key, assortativity): Pearson's correlation of the degrees at both ends of all edges; null if all degrees are equal.

    Both ends have the same degrees in all, so that three whole sums give it, whatever the order of the rows.
    """
    return _assortativity(_edge_sums(None, links, (), key), key)


def _assortativity(sums: DataFrame, key: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    n, x = 2 * whole("nbEdges"), whole("x")
    over, under = n * whole("xy") - x * x, n * whole("xx") - x * x
    return sums.select(key, F.when(under > 0, over.cast("double") / under.cast("double")).alias("assortativity"))


def distances(links: DataFrame, key: str = "filename") -> DataFrame:
    """(key, src, dst, d): the length of a shortest path between all nodes of a graph that have one, both ways, and 0 to itself.

    Searched within the graph's task, 256 sources at a time, each emitted before the next, so no pair is stored or shuffled. ``distance_counts`` and
    ``path_features`` emit no pairs at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in _numbered(batch):
                names = g.names()
                for rows, dist in _blocks(g.n, g.src, g.dst):
                    dst, src = np.nonzero(dist >= 0)
                    keys = batch.column(0).take(pa.array(np.full(len(src), g.row)))
                    yield pa.RecordBatch.from_arrays([keys, names.take(pa.array(rows[src])), names.take(pa.array(dst)), pa.array(dist[dst, src], pa.int32())], names=[key, "src", "dst", "d"])

    return _by_graph(None, links, key).mapInArrow(run, f"{key} {_kind(links, key)}, src string, dst string, d int")


def distance_counts(links: DataFrame, key: str = "filename") -> DataFrame:
    """(key, d, pairs): how many pairs of ``distances`` each length has, both ways and with those of a node and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, pairs = [], [], []
            for g in _numbered(batch):
                n = np.zeros(0, np.int64)
                for _, dist in _blocks(g.n, g.src, g.dst):
                    more = np.bincount(dist[dist >= 0])
                    n, more = (n, more) if len(n) >= len(more) else (more, n)
                    n[: len(more)] += more
                at.append(np.full(len(n), g.row))
                lengths.append(np.arange(len(n)))
                pairs.append(n)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(lengths), pa.int64()), pa.array(np.concatenate(pairs), pa.int64())], names=[key, "d", "pairs"])

    return _by_graph(None, links, key).mapInArrow(run, f"{key} {_kind(links, key)}, d long, pairs long")


def radius_diameter(paths: DataFrame, key: str = "filename") -> DataFrame:
    """(key, radius, diameter) from ``distances``; nodes without a path between them don't count."""
    far = paths.groupBy(key, "src").agg(F.max("d").alias("far"))
    return far.groupBy(key).agg(F.min("far").cast("long").alias("radius"), F.max("far").cast("long").alias("diameter"))


def text_density(paths: DataFrame, nodes: DataFrame, lengths: DataFrame, key: str = "filename") -> DataFrame:
    """(key, textDensityMean, textDensityStd) over all pairs of resources.

    A pair's density is (gap of offsets / length)^2 * sqrt(distance / diameter); the length is the number of words
    (``lengths``: key, nbWord), or the largest offset if that is null. Pairs without a path between them are left out; without any pair it is null.
    """
    ends = nodes.filter("resource").select(key, "id", "offset")
    longest = ends.groupBy(key).agg(F.max("offset").alias("maxOffset"))
    size = longest.join(lengths.select(key, "nbWord"), key, "left").select(key, F.coalesce("nbWord", "maxOffset").cast("double").alias("size"))
    widest = paths.groupBy(key).agg(F.max("d").alias("diameter"))
    pairs = paths.filter("src < dst").join(ends.withColumnsRenamed({"id": "src", "offset": "o1"}), [key, "src"]).join(ends.withColumnsRenamed({"id": "dst", "offset": "o2"}), [key, "dst"])
    pairs = pairs.join(widest, key).join(size, key)
    gap = F.try_divide(F.abs(F.col("o1") - F.col("o2")).cast("double"), F.col("size"))
    value = gap * gap * F.sqrt(F.try_divide(F.col("d").cast("double"), F.col("diameter").cast("double")))
    return pairs.groupBy(key).agg(F.avg(value).alias("textDensityMean"), F.stddev_pop(value).alias("textDensityStd"))


def _kind(rows: DataFrame, key: str) -> str:
    return rows.schema[key].dataType.simpleString()


def rows_of(nodes: DataFrame, links: DataFrame) -> DataFrame | None:
    """The table of ``built`` that both are read from, if they are."""
    made = getattr(links, "graphs", None)
    return made if made is not None and getattr(nodes, "graphs", None) is made else None


def _by_graph(nodes: DataFrame | None, links: DataFrame, key: str) -> DataFrame:
    """(key, edges, nodes): a row per graph; without ``nodes`` those of the edges only. Tables of ``built`` have these rows already."""
    if (made := rows_of(links if nodes is None else nodes, links)) is not None:
        return made.filter(F.size("edges") > 0).select(key, "edges") if nodes is None else made.select(key, "edges", F.transform("nodes", lambda x: F.struct(x["id"].alias("id"), x["resource"].alias("resource"), x["offset"].alias("offset"))).alias("nodes"))
    paired = links.groupBy(key).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    if nodes is None:
        return paired
    return nodes.groupBy(key).agg(F.collect_list(F.struct("id", "resource", "offset")).alias("nodes")).join(paired, key, "left").select(key, "edges", "nodes")


@dataclass
class _Graph:
    """The graph of a batch's ``row``: n nodes, numbered in the order of their names, and its edges by these numbers."""

    row: int
    n: int
    src: np.ndarray
    dst: np.ndarray
    resource: np.ndarray | None
    offset: np.ndarray | None
    codes: np.ndarray
    words: pa.Array

    def names(self) -> pa.Array:
        return self.words.take(pa.array(self.codes))


@dataclass
class _Batch:
    """All graphs of a batch at once: where each one's nodes and edges begin, edges by nodes' places in the batch, nodes by document and name."""

    words: pa.Array
    codes: np.ndarray
    first: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    cut: np.ndarray
    resource: np.ndarray | None
    offset: np.ndarray | None


def _read(batch: pa.RecordBatch) -> _Batch:
    rows = batch.num_rows

    def flat(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
        return column.flatten(), np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))

    edges, at_edge = flat(batch.column(1))
    parts = [pc.struct_field(edges, "src"), pc.struct_field(edges, "dst")]
    own = None
    if batch.num_columns > 2:
        own, at_node = flat(batch.column(2))
        parts.append(pc.struct_field(own, "id"))
    coded = pa.concat_arrays([x.cast(pa.string()) for x in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    k, e = max(len(order), 1), len(at_edge)
    src, dst = at_edge * k + code[:e], at_edge * k + code[e : 2 * e]
    resource = offset = None
    if own is None:
        places = np.unique(np.concatenate([src, dst]))
    else:
        places = at_node * k + code[2 * e :]
        sort = np.argsort(places, kind="stable")
        places = places[sort]
        resource = pc.struct_field(own, "resource").to_numpy(zero_copy_only=False).astype(bool)[sort]
        offset = pc.struct_field(own, "offset").cast(pa.float64()).to_numpy(zero_copy_only=False)[sort]
    first = np.searchsorted(places, np.arange(rows + 1) * k)
    return _Batch(coded.dictionary.take(pa.array(order)), places % k, first, np.searchsorted(places, src), np.searchsorted(places, dst), np.searchsorted(at_edge, np.arange(rows + 1)), resource, offset)


def _numbered(batch: pa.RecordBatch) -> Iterator[_Graph]:
    b = _read(batch)
    for row in range(batch.num_rows):
        lo, hi = b.first[row], b.first[row + 1]
        e = slice(b.cut[row], b.cut[row + 1])
        yield _Graph(row, int(hi - lo), b.src[e] - lo, b.dst[e] - lo, None if b.resource is None else b.resource[lo:hi], None if b.offset is None else b.offset[lo:hi], b.codes[lo:hi], b.words)


def _edge_sums(nodes: DataFrame | None, links: DataFrame, namespaces: Namespaces, key: str) -> DataFrame:
    """(key, nbEdges, x, xx, xy, nbEdges_<namespace>): edges, those with both ends in a namespace's part, and of the degrees at the ends, edges taken both ways,
    the sum, that of squares and that of products. Whole numbers; a batch of graphs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _read(batch)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[b.cut])  # noqa: B023, E731
            degree = np.bincount(np.concatenate([b.src, b.dst]), minlength=b.first[-1])
            s, d = degree[b.src], degree[b.dst]
            out = [np.diff(b.cut), total(s + d), total(s * s + d * d), total(2 * s * d)]
            for _, uri in namespaces:
                listed = pc.or_(pc.starts_with(b.words, uri), pc.equal(b.words, ROOT)).to_numpy(zero_copy_only=False)
                member = b.resource | listed[b.codes]
                out.append(total((member[b.src] & member[b.dst]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out]], names=[key, *names])

    names = ["nbEdges", "x", "xx", "xy", *[f"nbEdges_{k}" for k, _ in namespaces]]
    out = _by_graph(nodes, links, key).mapInArrow(run, f"{key} {_kind(links, key)}, " + ", ".join(f"`{n}` long" for n in names))
    return out.filter("nbEdges > 0")


def _blocks(n: int, src: np.ndarray, dst: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search from 256 nodes at a time: these, and the distances of all nodes (rows) from them (columns), -1 without a path."""
    to = np.concatenate([dst, src])
    order = np.argsort(np.concatenate([src, dst]), kind="stable")
    to = to[order]
    degree = np.bincount(np.concatenate([src, dst]), minlength=n)
    begin = np.cumsum(degree) - degree
    some = np.flatnonzero(degree)
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        dist = np.full((n, len(rows)), -1, np.int32)
        dist[rows, np.arange(len(rows))] = 0
        front = dist == 0
        d = 0
        while len(some) and front.any():
            d += 1
            entered = np.zeros_like(front)
            entered[some] = np.logical_or.reduceat(front[to], begin[some], axis=0)
            front = entered & (dist < 0)
            dist[front] = d
        yield rows, dist


def _paths_of(n: int, src: np.ndarray, dst: np.ndarray, at: np.ndarray, offsets: np.ndarray, size: float) -> tuple[int, int, float | None, float | None]:
    """Radius, diameter, and mean and deviation of the pair densities of one graph, by breadth-first search from blocks of nodes.

    Pairs are summed as their block is searched, so a graph needs 256 distances a node. Nodes and pairs without a path between them don't count.
    """
    reach = np.zeros(n, np.int64)
    known = bool(size) and not np.isnan(size)
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    mean = squares = 0.0
    pairs = 0
    for rows, dist in _blocks(n, src, dst):
        reach[rows] = dist.max(axis=0)
        columns = np.flatnonzero(place[rows] >= 0)
        if not known or not len(columns):
            continue
        i = place[rows[columns]]
        further = dist[np.ix_(at, columns)]
        value = ((offsets[:, None] - offsets[i]) / size) ** 2 * np.sqrt(np.maximum(further, 0))
        value = value[(np.arange(len(at))[:, None] > i) & (further >= 0) & ~np.isnan(value)]
        if k := len(value):
            # Mean and squared deviations of both parts together.
            apart = value.mean() - mean
            squares += ((value - value.mean()) ** 2).sum() + apart * apart * pairs * k / (pairs + k)
            mean += apart * k / (pairs + k)
            pairs += k
    radius, diameter = int(reach.min()), int(reach.max())
    if not pairs:
        return radius, diameter, None, None
    return radius, diameter, float(mean / np.sqrt(max(diameter, 1))), float(np.sqrt(squares / pairs / max(diameter, 1)))


def path_features(nodes: DataFrame, links: DataFrame, lengths: DataFrame | None, key: str = "filename") -> DataFrame:
    """(key, radius, diameter, textDensityMean, textDensityStd), a graph at a time; without ``lengths`` by the largest offset.

    Each graph is one row of arrays, its nodes numbered in it; no pair of nodes leaves the task. Graphs are as large as a document's
    concepts, which is what bounds a row.
    """
    graphs = _by_graph(nodes, links, key)
    if lengths is None:
        graphs = graphs.withColumn("size", F.lit(None).cast("double"))
    else:
        graphs = graphs.join(lengths.select(key, F.col("nbWord").cast("double").alias("size")), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, size in zip(_numbered(batch), batch.column(3).to_pylist(), strict=True):
                at = np.flatnonzero(g.resource)
                offsets = g.offset[at]
                if size is None or np.isnan(size):
                    size = np.nanmax(offsets) if len(offsets) and not np.isnan(offsets).all() else float("nan")
                rows.append(_paths_of(g.n, g.src, g.dst, at, offsets, size))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], names=[key, "radius", "diameter", "textDensityMean", "textDensityStd"])

    return graphs.mapInArrow(run, f"{key} {_kind(nodes, key)}, radius long, diameter long, textDensityMean double, textDensityStd double")


def semantic_vectors(nodes: DataFrame, links: DataFrame, lengths: DataFrame, namespaces: Namespaces = NAMESPACES, key: str = "filename", native: bool = False) -> DataFrame:
    """One row per document of ``lengths`` (key, nbWord): FEATURES and two features a namespace.

    A document without a concept has 0 concepts and nodes, radius, diameter, text density and assortativity 0, and density 1.
    ``native`` takes path features from the rows of ``distances``. An unknown number of words is -1, also in the ratios.
    """
    if native:
        paths = distances(links, key)
        path = radius_diameter(paths, key).join(text_density(paths, nodes, lengths, key), key, "left")
    else:
        path = path_features(nodes, links, lengths, key)
    out = lengths.select(key, "nbWord").join(counts(nodes, links, namespaces, key), key, "left").join(path, key, "left").join(assortativity(links, key), key, "left")
    empty = F.col("nbNodes").isNull()
    words = F.coalesce("nbWord", F.lit(-1)).cast("double")
    zero = lambda c: F.when(empty, F.lit(0.0)).otherwise(F.col(c).cast("double"))
    made = {
        "nbWord": words, "nbConcepts": zero("nbConcepts"), "nbUniqueConcepts": zero("nbUniqueConcepts"),
        "conceptsWordsRatio": F.try_divide(zero("nbConcepts"), words), "uniqueConceptsWordsRatio": F.try_divide(zero("nbUniqueConcepts"), words),
        "nbNodes": zero("nbNodes"), "radius": zero("radius"), "diameter": zero("diameter"), "assortativity": zero("assortativity"),
        "density": F.when(empty, F.lit(1.0)).otherwise(F.col("density")), "textDensityMean": zero("textDensityMean"), "textDensityStd": zero("textDensityStd"),
    }
    made |= {x: F.col(x).cast("double") for x in FEATURES[len(made) :]}
    for k, _ in namespaces:
        made |= {f"nbNodes_{k}": zero(f"nbNodes_{k}"), f"density_{k}": F.when(empty, F.lit(1.0)).otherwise(F.col(f"density_{k}"))}
    return out.select(key, *[made[x].alias(x) for x in feature_names(namespaces)])
