"""Questions to a dependency graph. Each answers for all ids at once; those that follow dependencies take a root to start from.

Rows are findings: root is the application (or capability, data object) asked about, id what is found, depth the number of
dependencies between them (null where none counts), path the relationships that prove it, in reading order, explanation a
sentence. `named` adds name, kind and attributes, `shown` writes paths as text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import Graph

VERBS = {"SUPPORTS": "supports", "OWNS": "owns", "CONSUMES": "consumes", "DEPENDS_ON": "depends on", "RUNS_ON": "runs on"}
NONE = "no relationship path"
FINDING = ["root", "id", "depth", "path", "explanation"]
REACHED = "root string, id string, longer boolean, depth int, nodes array<string>"


def edge() -> Column:
    return F.struct(F.col("src").alias("from"), F.col("type"), F.col("dst").alias("to"))


def text_of(path: str) -> Column:
    return F.array_join(F.transform(path, lambda e: F.concat(e["from"], F.lit(" -"), e["type"], F.lit("-> "), e["to"])), " ; ")


def shown(rows: DataFrame) -> DataFrame:
    """rows with paths as text, empty where there is none."""
    return rows.withColumn("path", text_of("path"))


def named(g: Graph, rows: DataFrame) -> DataFrame:
    """rows with name, kind and attributes of what is found."""
    return rows.join(g.elements.select("id", "name", "kind", "attributes"), "id", "left")


def rendered(rows: DataFrame) -> DataFrame:
    """(root, id, line): a named finding as text, with its sentence and its path."""
    path = F.when(F.size("path") == 0, NONE).otherwise(text_of("path"))
    return rows.select("root", "id", F.format_string("%s (%s): %s [%s]", "id", F.coalesce("name", "id"), "explanation", path).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """(root, id, json): a named finding as a JSON object; no depth where it is null, edges as from, type, to."""
    fields = [c for c in ("id", "name", "kind", "explanation", "path", "depth") if c in rows.columns]
    return rows.select("root", "id", F.to_json(F.struct(*fields)).alias("json"))


def degree(g: Graph) -> DataFrame:
    """(id, kind, degree): relationships in and out; a self-loop counts twice."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    return g.elements.join(ends, "id", "left").select("id", "kind", F.coalesce("count", F.lit(0)).cast("long").alias("degree"))


def isolated(g: Graph) -> DataFrame:
    return degree(g).where("degree = 0").select("id", "kind")


def edges_by_type(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


def find(g: Graph, query: str, kind: str | None = None) -> DataFrame:
    """Elements whose name contains query or whose id is it, letter case and outer space aside; kind None or empty: all."""
    q = query.strip().lower()
    rows = g.of_kind(kind) if kind else g.elements
    return rows.where(F.lower("name").contains(q) | (F.lower("id") == q)).select("id", "kind", "name", "attributes", "kind_ord")


def hop(g: Graph, kind: str, root: str, other: str) -> DataFrame:
    depth = F.lit(1 if kind == "DEPENDS_ON" else None).cast("int")
    sentence = F.concat_ws(" ", "src", F.lit(VERBS[kind]), "dst")
    return g.of_type(kind).select(F.col(root).alias("root"), F.col(other).alias("id"), depth.alias("depth"), F.array(edge()).alias("path"), sentence.alias("explanation"))


def inbound(g: Graph, kind: str) -> DataFrame:
    """Sources of a relationship, by target."""
    return hop(g, kind, "dst", "src")


def outbound(g: Graph, kind: str) -> DataFrame:
    """Targets of a relationship, by source."""
    return hop(g, kind, "src", "dst")


def consumers_without_ownership(g: Graph) -> DataFrame:
    """By data object: who consumes it and does not own it; with its owners."""
    owns = g.of_type("OWNS").select("src", "dst")
    owners = owns.groupBy("dst").agg(F.array_join(F.sort_array(F.collect_set("src")), ", ").alias("owners"))
    rest = g.of_type("CONSUMES").join(owns, ["src", "dst"], "left_anti").join(owners, "dst", "left")
    rest = rest.withColumn("owners", F.coalesce("owners", F.lit("none recorded")))
    sentence = F.format_string("%s consumes %s without owning it (owners: %s)", "src", "dst", "owners")
    return rest.select(F.col("dst").alias("root"), F.col("src").alias("id"), F.lit(None).cast("int").alias("depth"), F.array(edge()).alias("path"), sentence.alias("explanation"), "owners")


def steps(g: Graph) -> DataFrame:
    return g.of_type("DEPENDS_ON").where("src <> dst").select("src", "dst", "ord")


@dataclass
class Upward:
    """Dependencies as arrays that go to the tasks: node i depends on targets[starts[i]:starts[i + 1]], by the order of relationships."""

    ids: pa.Array
    starts: np.ndarray
    targets: np.ndarray
    ords: pa.Array
    ranks: np.ndarray  # by the order of relationships, over all nodes


def upward(edges: DataFrame, most_edges: int) -> Upward | None:
    """None if there are more than most_edges."""
    few = edges.limit(most_edges + 1).toArrow()
    if few.num_rows > most_edges:
        return None
    few = few.sort_by([("ord", "ascending"), ("src", "ascending")]).combine_chunks()
    ends = [few.column(c).cast(pa.string()) for c in ("src", "dst")]
    ids = pc.unique(pa.chunked_array([c for end in ends for c in end.chunks], pa.string()))
    src, dst = (pc.index_in(end, ids).to_numpy().astype(np.int32) for end in ends)
    order = np.argsort(src, kind="stable")
    ords = few.column("ord").take(pa.array(order)).combine_chunks()
    return Upward(ids, np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))]), dst[order], ords, order)


def walks(up: Upward, first: np.ndarray, most_cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Simple paths that start at the nodes `first`: [path, node], the root last, and [path, edge].

    Paths of one length come together, depth first in slices of at most most_cells nodes, so memory is bounded, however many there are.
    """
    stack = [(first[:, None], np.empty((len(first), 0), np.int64), 0)] if len(first) else []
    while stack:
        nodes, taken, at = stack.pop()
        low, n = up.starts[nodes[:, -1]], up.starts[nodes[:, -1] + 1] - up.starts[nodes[:, -1]]
        ends = np.cumsum(n)
        to = min(at + max(1, most_cells // (nodes.shape[1] + 1)), int(ends[-1]))
        if to < ends[-1]:
            stack.append((nodes, taken, to))
        nth = np.arange(at, to)
        parent = np.searchsorted(ends, nth, side="right")
        edge = low[parent] + nth - (ends - n)[parent]
        node = up.targets[edge]
        fresh = np.flatnonzero((nodes[parent] != node[:, None]).all(1))
        if len(fresh):
            nodes = np.column_stack([nodes[parent[fresh]], node[fresh]])
            taken = np.column_stack([taken[parent[fresh]], edge[fresh]])
            yield nodes, taken
            stack.append((nodes, taken, 0))


def dependency_paths(g: Graph, root: str | None = None, most_edges: int = 1_000_000, text: bool = False) -> DataFrame:
    """(root, id, depth, ords, nodes): every simple path of dependencies to root (None: to any), nodes from the root outward; cycles end.
    text: nodes as one text, joined by commas, and no ords.

    There can be exponentially many in a dense graph: for those who want them all. Shortest paths come from `reached`.
    Up to most_edges dependencies go to the tasks, each of which walks from some dependents and returns paths as it finds them:
    none is kept or shuffled. For one root, and beyond that many, all are searched by joins, which Spark keeps on disk.
    """
    edges = steps(g)
    up = upward(edges, most_edges) if root is None else None
    if up is None:
        found = joined_paths(edges, edges if root is None else edges.where(F.col("dst") == root))
        return found.select("root", "id", "depth", F.array_join("nodes", ",").alias("nodes")) if text else found
    session, n = g.edges.sparkSession, len(up.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), values.take(pa.array(rows.ravel())))
        for batch in batches:
            for nodes, taken in walks(up, batch.column(0).to_numpy().astype(np.int32)):
                depth = taken.shape[1]
                columns = {"root": up.ids.take(pa.array(nodes[:, -1])), "id": up.ids.take(pa.array(nodes[:, 0])), "depth": pa.array(np.full(len(nodes), depth, np.int32))}
                if text:
                    columns["nodes"] = pc.binary_join_element_wise(*(up.ids.take(pa.array(nodes[:, i])) for i in range(depth - 1, -1, -1)), ",")
                else:
                    columns |= {"ords": lists(taken[:, ::-1], up.ords), "nodes": lists(nodes[:, -2::-1], up.ids)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    # few starts a task: what they return differs much
    starts = session.range(0, n, 1, max(1, min(n, max(4 * session.sparkContext.defaultParallelism, n // 128))))
    return starts.mapInArrow(run, "root string, id string, depth int, " + ("nodes string" if text else "ords array<long>, nodes array<string>"))


def joined_paths(edges: DataFrame, first: DataFrame) -> DataFrame:
    """`dependency_paths` from the dependencies `first`, by recursion."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE found(root, id, depth, ords, nodes) MAX RECURSION LEVEL 2147483647 AS (
            SELECT dst, src, 1, array(ord), array(src) FROM {first}
            UNION ALL
            SELECT f.root, s.src, f.depth + 1, f.ords || array(s.ord), f.nodes || array(s.src)
            FROM found f JOIN {edges} s ON s.dst = f.id WHERE s.src <> f.root AND NOT array_contains(f.nodes, s.src)
        ) SELECT * FROM found LIMIT ALL""",
        first=first, edges=edges,
    )


def searched(dependents: dict[str, list[str]], root: str, without: str | None = None) -> dict[str, str | None]:
    """Each dependent's next node towards root, breadth first; without: its direct dependency is left out, and reaching it ends the search."""
    towards: dict[str, str | None] = {root: None}
    queue = [root]
    for node in queue:
        for src in dependents.get(node, ()):
            if src not in towards and not (node == root and src == without):
                towards[src] = node
                if src == without:
                    return towards
                queue.append(src)
    return towards


def reached(g: Graph, root: str | None = None, most_edges: int = 1_000_000) -> DataFrame:
    """(root, id, longer, depth, nodes): each dependent's shortest path, and with longer its shortest of two steps at least.

    Paths tie by the order of relationships, the one nearest the root first. nodes run from the root, left out, to the
    dependent. A longer path of a direct dependent is the shortest without its direct dependency; it is simple, as any
    shortest path is. So no paths are enumerated, however dense the graph.

    Up to most_edges dependencies go to the tasks, which search breadth first, each for some roots; beyond that all
    roots are searched at once, a level at a time, by joins.
    """
    edges = steps(g)
    roots = edges.select(F.col("dst").alias("root")).distinct()
    roots = roots if root is None else roots.where(F.col("root") == root)
    few = edges.limit(most_edges + 1).toArrow()
    if few.num_rows > most_edges:
        return by_levels(edges, roots)
    dependents: dict[str, list[str]] = {}
    for src, dst, _ in sorted(zip(*(c.to_pylist() for c in few.columns), strict=True), key=lambda e: (e[2], e[0])):
        dependents.setdefault(dst, []).append(src)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def path(towards: dict, node: str) -> list[str]:
            nodes = []
            while towards[node] is not None:
                nodes.append(node)
                node = towards[node]
            return nodes[::-1]

        for batch in batches:
            for root in batch.column(0).to_pylist():
                rows, towards = [], searched(dependents, root)
                for node in towards:
                    if node != root:
                        nodes = path(towards, node)
                        rows.append((root, node, False, len(nodes), nodes))
                        other = towards if len(nodes) > 1 else searched(dependents, root, node)
                        if node in other:
                            nodes = path(other, node)
                            rows.append((root, node, True, len(nodes), nodes))
                types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["root", "id", "longer", "depth", "nodes"])

    return roots.mapInArrow(run, REACHED)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir; lineage ends here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="ripplegraph-"))
    return df.checkpoint()


def by_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """`reached` by joins, one round for each level. A search is a root, or a root and the direct dependent it does without."""
    direct = edges.join(roots, edges["dst"] == roots["root"], "left_semi").select(F.col("dst").alias("root"), F.col("src").alias("without"))
    now = roots.withColumn("without", F.lit("")).union(direct).selectExpr("root", "without", "root as id", "cast(array() as array<bigint>) as ords", "cast(array() as array<string>) as nodes")
    seen = now = settled(now)
    while not now.isEmpty():
        near = now.join(edges, now["id"] == edges["dst"]).where("src <> root and not (id = root and src = without)")
        best = near.groupBy("root", "without", F.col("src").alias("id")).agg(F.min(F.struct(F.expr("ords || array(ord)").alias("ords"), F.expr("nodes || array(src)").alias("nodes"))).alias("b"))
        now = settled(best.select("root", "without", "id", "b.*").join(seen, ["root", "without", "id"], "left_anti"))
        seen = seen.union(now)
    found = seen.where("id <> root").withColumn("depth", F.size("nodes"))
    first = found.where("without = ''")
    longer = first.where("depth > 1").union(found.where("id = without"))
    return first.withColumn("longer", F.lit(False)).union(longer.withColumn("longer", F.lit(True))).select("root", "id", "longer", "depth", "nodes")


def dependents(paths: DataFrame, longer: bool) -> DataFrame:
    """Findings from rows of `reached`, with via, what lies between."""
    rows = paths.where(F.col("longer") if longer else ~F.col("longer")).withColumn("chain", F.concat(F.reverse("nodes"), F.array("root")))
    path = F.expr("transform(sequence(1, depth), i -> named_struct('from', chain[i - 1], 'type', 'DEPENDS_ON', 'to', chain[i]))")
    via = F.expr("array_join(slice(chain, 2, depth - 1), ' -> ')")
    sentence = F.concat_ws(" ", "id", F.lit("depends on"), "root", F.concat(F.lit("through "), F.col("via"))) if longer else F.concat_ws(" ", "id", F.lit("depends on"), "root", hops("depth"))
    return rows.withColumns({"path": path, "via": via}).select("root", "id", "depth", "path", sentence.alias("explanation"), "via")


def hops(depth: str) -> Column:
    return F.concat(F.lit("in "), F.col(depth), F.when(F.col(depth) == 1, " hop").otherwise(" hops"))


def transitive_dependents(g: Graph, root: str | None = None) -> DataFrame:
    return dependents(reached(g, root), False).select(FINDING)


def indirect_dependents(g: Graph, root: str | None = None) -> DataFrame:
    """Dependents through another application; some are direct dependents as well."""
    return dependents(reached(g, root), True)


def dependent_lines(g: Graph, root: str | None = None) -> DataFrame:
    """(root, id, label, routes): one row for each direct or indirect dependent, its direct route first."""
    direct = inbound(g, "DEPENDS_ON").select("root", "id", F.lit(0).alias("nth"), F.lit("direct").alias("label"), text_of("path").alias("route"))
    direct = direct if root is None else direct.where(F.col("root") == root)
    longer = indirect_dependents(g, root).select("root", "id", F.lit(1).alias("nth"), F.lit("indirect").alias("label"), text_of("path").alias("route"))
    both = direct.union(longer).groupBy("root", "id").agg(F.sort_array(F.collect_list(F.struct("nth", "label", "route"))).alias("r"))
    return both.select("root", "id", F.array_join("r.label", " and ").alias("label"), F.array_join("r.route", " | ").alias("routes"))


def only_source(g: Graph, kind: str) -> DataFrame:
    """Targets that only root relates to by this type, so that they are lost without it."""
    edges = g.of_type(kind)
    alone = edges.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("src"), F.first("type").alias("type")).where("n = 1")
    sentence = F.concat_ws(" ", F.lit("only"), "src", F.lit(VERBS[kind]), "dst")
    if kind == "RUNS_ON":
        sentence = F.concat_ws(" ", F.lit("nothing but"), "src", F.lit("runs on"), "dst")
    return alone.select(F.col("src").alias("root"), F.col("dst").alias("id"), F.lit(None).cast("int").alias("depth"), F.array(edge()).alias("path"), sentence.alias("explanation"))


def affected(g: Graph, paths: DataFrame, root: str | None = None) -> DataFrame:
    """(root, id, depth, path): each application itself (depth 0, empty path) and its dependents, from rows of `reached`."""
    found = dependents(paths, False).select("root", "id", "depth", "path")
    own = g.of_kind("application").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array().cast(found.schema["path"].dataType).alias("path"))
    return (own if root is None else own.where(F.col("id") == root)).union(found)


def climbed(starts: list[int], targets: list[int], ranks: list[int], via: int) -> dict[int, int | None]:
    """All that a node depends on, breadth first, each with the node before it on the path that `reached` takes from there."""
    before: dict[int, int | None] = {via: None}
    level = [via]
    while level:
        best: dict[int, tuple[int, int]] = {}
        for node in level:
            for edge in range(starts[node], starts[node + 1]) if node + 1 < len(starts) else ():
                root = targets[edge]
                if root not in before and (root not in best or ranks[edge] < best[root][0]):
                    best[root] = ranks[edge], node
        before |= {root: node for root, (_, node) in best.items()}
        level = list(best)
    return before


def touched_first(up: Upward, supporters: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """(root, capability, via, depth, chain) of capabilities that an affected application supports, the first of these by its id, and that
    are not lost; chain from via to root. supporters: capability, vias (id, application) by id, n, the number of relationships.

    Each capability's supporters climb to all that they depend on, so its roots are found in one place and no pair is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, targets, ranks, names = up.starts.tolist(), up.targets.tolist(), up.ranks.tolist(), up.ids.to_pylist()
        code = {name: i for i, name in enumerate(names)}
        known: dict[int, tuple[np.ndarray, np.ndarray, pa.ListArray]] = {}
        held = n = 0
        pieces: list[tuple[str, int, np.ndarray, np.ndarray, pa.ListArray]] = []

        def climb(via: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
            nonlocal held
            if via not in known:
                chains: dict[int, list[int]] = {}
                for root, node in climbed(starts, targets, ranks, via).items():
                    chains[root] = [*(chains[node] if node is not None else ()), root]
                if held > most_rows:
                    known.clear()
                    held = 0
                held += len(chains)
                known[via] = np.fromiter(chains, np.int32), np.array([len(c) - 1 for c in chains.values()], np.int32), pa.array(chains.values(), pa.list_(pa.int32()))
            return known[via]

        def flushed() -> pa.RecordBatch:
            ids, size = pa.array(names, pa.string()), [len(p[2]) for p in pieces]
            chain = pa.concat_arrays([p[4] for p in pieces])
            columns = {
                "root": ids.take(pa.array(np.concatenate([p[2] for p in pieces]))),
                "capability": pa.array([p[0] for p in pieces], pa.string()).take(pa.array(np.repeat(np.arange(len(pieces)), size))),
                "via": ids.take(pa.array(np.repeat([p[1] for p in pieces], size))),
                "depth": pa.array(np.concatenate([p[3] for p in pieces])),
                "chain": pa.ListArray.from_arrays(chain.offsets, ids.take(chain.values)),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            for capability, vias, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: set[int] = set()
                for each in vias:
                    if each["id"] not in code:
                        code[each["id"]] = len(names)
                        names.append(each["id"])
                    via = code[each["id"]]
                    roots, depth, chain = climb(via)
                    if not each["application"] or edges == 1:  # itself stands first: no application, or it loses the capability
                        roots, depth, chain = roots[1:], depth[1:], chain[1:]
                    if seen:
                        some = np.flatnonzero([r not in seen for r in roots.tolist()])
                        roots, depth, chain = roots[some], depth[some], chain.take(pa.array(some))
                    if len(vias) > 1:
                        seen.update(roots.tolist())
                    if len(roots):
                        pieces.append((capability, via, roots, depth, chain))
                        n += len(roots)
                    if n >= 20_000:
                        yield flushed()
                        pieces, n = [], 0
        if pieces:
            yield flushed()

    return supporters.select("capability", "vias", "n").mapInArrow(run, "root string, capability string, via string, depth int, chain array<string>")


def degraded(g: Graph, root: str | None = None, paths: DataFrame | None = None, most_edges: int = 1_000_000) -> DataFrame:
    """Capabilities that an affected application (via) supports and that are not lost; the first by its id.

    For all roots at once, up to most_edges dependencies go to the tasks; else affected applications are joined with what they support.
    """
    supports = g.of_type("SUPPORTS")
    up = upward(steps(g), most_edges) if root is None and paths is None else None
    if up is None:
        kept = joined_degraded(g, root, reached(g, root) if paths is None else paths)
    else:
        context = g.edges.sparkSession.sparkContext
        applications = g.of_kind("application").select(F.col("id").alias("src"), F.lit(True).alias("application")).distinct()
        via = F.struct(F.col("src").alias("id"), F.coalesce("application", F.lit(False)).alias("application"))
        each = supports.join(applications, "src", "left").groupBy(F.col("dst").alias("capability")).agg(F.sort_array(F.collect_set(via)).alias("vias"), F.count("*").alias("n"))
        # those of one application lie together, in four parts, so that what it depends on is seldom found twice
        first, part = F.expr("vias[0].id"), F.expr("pmod(xxhash64(capability), 4)")
        each = each.repartition(max(4 * context.defaultParallelism, len(up.ids) // 256), first, part).sortWithinPartitions(first)
        path = F.expr("if(depth = 0, array(), transform(sequence(1, depth), i -> named_struct('from', chain[i - 1], 'type', 'DEPENDS_ON', 'to', chain[i])))")
        last = F.struct(F.col("via").alias("from"), F.lit("SUPPORTS").alias("type"), F.col("capability").alias("to"))
        kept = touched_first(up, each).select("root", "capability", "via", "depth", path.alias("path"), last.alias("last"))
    sentence = F.when(F.col("depth") == 0, F.concat_ws(" ", "capability", F.lit("keeps other support than that of"), "root")).otherwise(
        F.concat_ws(" ", "capability", F.lit("is supported by"), "via", F.lit("which depends on"), "root", hops("depth"))
    )
    return kept.select("root", F.col("capability").alias("id"), "depth", F.concat("path", F.array("last")).alias("path"), sentence.alias("explanation"), "via")


def joined_degraded(g: Graph, root: str | None, paths: DataFrame) -> DataFrame:
    """(root, capability, via, depth, path, last) of `degraded`, from rows of `reached`."""
    supports = g.of_type("SUPPORTS").select(F.col("src").alias("via"), F.col("dst").alias("capability"), edge().alias("last"))
    touched = affected(g, paths, root).withColumnRenamed("id", "via").join(supports, "via")
    lost = only_source(g, "SUPPORTS").select("root", F.col("id").alias("capability"))
    first = touched.groupBy("root", "capability").agg(F.min(F.struct("via", "depth", "path", "last")).alias("f")).select("root", "capability", "f.*")
    return first.join(lost, ["root", "capability"], "left_anti")


def unaffected(g: Graph, root: str, paths: DataFrame | None = None) -> DataFrame:
    """For one application: capabilities that no affected application supports, with their supporters."""
    touched = affected(g, reached(g, root) if paths is None else paths, root).select(F.col("id").alias("src"))
    supports = g.of_type("SUPPORTS")
    hit = supports.join(touched, "src", "left_semi").select(F.col("dst").alias("id"))
    each = supports.withColumn("edge", edge()).groupBy(F.col("dst").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set("src")), ", ").alias("supporters"),
        F.expr("transform(array_sort(collect_list(struct(ord, src, edge))), e -> e.edge)").alias("path"),
    )
    rest = g.of_kind("capability").select("id").join(hit, "id", "left_anti").join(each, "id", "left")
    rest = rest.withColumns({"supporters": F.coalesce("supporters", F.lit("no application")), "path": F.coalesce("path", F.array().cast(each.schema["path"].dataType))})
    sentence = F.concat_ws(" ", "id", F.lit("is supported by"), F.concat("supporters", F.lit(", not affected")))
    return rest.select(F.lit(root).alias("root"), "id", F.lit(None).cast("int").alias("depth"), "path", sentence.alias("explanation"), "supporters")


SECTIONS = ["direct dependents", "indirect dependents", "transitive dependents", "orphaned data", "consumed data", "capabilities lost", "capabilities degraded", "capabilities unaffected", "orphaned technologies"]


def impact(g: Graph, root: str) -> DataFrame:
    """The nine sections of retiring one application as one long table of named findings, with section and section_ord.

    Dependencies are searched once.
    """
    paths = reached(g, root).persist(StorageLevel.MEMORY_AND_DISK)
    unharmed = F.concat_ws(" ", "root", F.lit("consumes"), F.concat("id", F.lit(", which stays")))
    rows = [
        inbound(g, "DEPENDS_ON"), dependents(paths, True), dependents(paths, False), only_source(g, "OWNS"), outbound(g, "CONSUMES").withColumn("explanation", unharmed),
        only_source(g, "SUPPORTS"), degraded(g, root, paths), unaffected(g, root, paths), only_source(g, "RUNS_ON"),
    ]
    every = None
    for i, (name, found) in enumerate(zip(SECTIONS, rows, strict=True)):
        found = found.where(F.col("root") == root).select(F.lit(name).alias("section"), F.lit(i).alias("section_ord"), *FINDING)
        every = found if every is None else every.union(found)
    return named(g, every)


def impact_summary(g: Graph) -> DataFrame:
    """One row for each application: how many of everything retiring it does. Dependencies are searched once, edges read from a cache."""
    edges = g.edges.persist(StorageLevel.MEMORY_AND_DISK)
    g = Graph(g.elements, edges)
    paths = reached(g).persist(StorageLevel.MEMORY_AND_DISK)
    alone = edges.where("type in ('OWNS', 'SUPPORTS', 'RUNS_ON')").groupBy("type", "dst").agg(F.count("*").alias("n"), F.first("src").alias("root")).where("n = 1")
    own = edges.where("type = 'SUPPORTS'").select(F.col("src").alias("id"), "dst")
    touched = paths.where("not longer").select("root", "id").join(own, "id").select("root", "dst").union(own).distinct()
    names = ["n_direct", "n_indirect", "n_transitive", "n_orphaned_data", "n_consumed_data", "n_lost", "n_touched", "n_orphaned_technologies"]
    counted = [
        edges.where("type = 'CONSUMES' or type = 'DEPENDS_ON' and src <> dst").selectExpr("if(type = 'CONSUMES', src, dst) as root", "if(type = 'CONSUMES', 'n_consumed_data', 'n_direct') as what"),
        paths.selectExpr("root", "if(longer, 'n_indirect', 'n_transitive') as what"),
        alone.selectExpr("root", "case type when 'OWNS' then 'n_orphaned_data' when 'SUPPORTS' then 'n_lost' else 'n_orphaned_technologies' end as what"),
        touched.selectExpr("root", "'n_touched' as what"),
    ]
    each = None
    for rows in counted:
        each = rows if each is None else each.union(rows)
    counts = each.groupBy("root").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
    capabilities = g.of_kind("capability").agg(F.count("*").alias("n_capabilities"))
    rows = g.of_kind("application").select(F.col("id").alias("root")).join(counts, "root", "left").fillna(0, names).join(F.broadcast(capabilities))  # one row
    return rows.withColumns({"n_degraded": F.expr("n_touched - n_lost"), "n_unaffected": F.expr("n_capabilities - n_touched")}).drop("n_touched", "n_capabilities")
