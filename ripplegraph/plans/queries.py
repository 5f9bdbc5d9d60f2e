"""Registered queries of the graph and search operators over the order tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, chunks, described, tokens
from ..operators import graph as ops
from ..operators import search
from ..evaluation import ranked_sources
from ..sources.model import EDGE_TYPES, Graph, conflicts, violations
from ..sources.star_schema import graph

Query = Callable[[SparkSession, str], DataFrame]
ROOT = "A3"  # the argument of the questions that take one application
SEARCH = "thesened heention inenan heonha the thesened"

#: A document as markdown, in the SQL of both sides.
MARKDOWN = """'# Document ' || doc_id || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'intro' || chr(10) ELSE '' END || '## ' || coalesce(lang, 'none') || ' ##' || chr(10) || coalesce(text, '')
    || chr(10) || '<!-- hidden' || chr(10) || '# no -->' || chr(10) || '~~~' || chr(10) || '# fenced' || chr(10) || '~~~' || chr(10) || '### Inner C#' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'deep' || chr(10) ELSE '' END || '## Empty' || chr(10)"""

EDGES = """
    SELECT DISTINCT 'A' || l_suppkey AS src, 'SUPPORTS' AS type, 'C' || l_partkey AS dst, l_suppkey AS ord FROM lineitem WHERE l_quantity = 50
    UNION ALL SELECT DISTINCT 'A' || l_suppkey, 'OWNS', 'D' || o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50
    UNION ALL SELECT DISTINCT 'A' || l_suppkey, 'CONSUMES', 'D' || o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 1
    UNION ALL SELECT 'A' || s_suppkey, 'RUNS_ON', 'T' || s_nationkey, s_suppkey FROM supplier
    UNION ALL SELECT 'A' || s_suppkey, 'DEPENDS_ON', 'A' || (s_suppkey // 2), 2 * s_suppkey FROM supplier WHERE s_suppkey >= 1
    UNION ALL SELECT 'A' || s_suppkey, 'DEPENDS_ON', 'A' || (s_suppkey // 3), 2 * s_suppkey + 1 FROM supplier WHERE s_suppkey >= 1 AND s_suppkey // 3 <> s_suppkey // 2"""
CYCLE = "\n    UNION ALL SELECT 'A0', 'DEPENDS_ON', 'A1', 0"
TEXT = "src || ' -' || type || '-> ' || dst"


def sql(select: str, cyclic: bool = False) -> str:
    return f"""WITH RECURSIVE edges AS ({EDGES}{CYCLE if cyclic else ''}),
elements AS (SELECT 'C' || p_partkey AS id, 'capability' AS kind, p_name AS name FROM part UNION ALL SELECT 'A' || s_suppkey, 'application', s_name FROM supplier
    UNION ALL SELECT 'D' || c_custkey, 'data_object', c_name FROM customer UNION ALL SELECT 'T' || n_nationkey, 'technology', n_name FROM nation),
steps AS (SELECT src, dst, ord FROM edges WHERE type = 'DEPENDS_ON' AND src <> dst),
paths(root, id, depth, ords, nodes) AS (SELECT dst, src, 1, [ord], [src] FROM steps UNION ALL
    SELECT p.root, s.src, p.depth + 1, list_append(p.ords, s.ord), list_append(p.nodes, s.src) FROM paths p JOIN steps s ON s.dst = p.id
    WHERE s.src <> p.root AND NOT list_contains(p.nodes, s.src)),
shortest AS (SELECT *, list_append(list_reverse(nodes), root) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY root, id ORDER BY depth, ords) AS r FROM paths) WHERE r = 1),
longer AS (SELECT *, list_append(list_reverse(nodes), root) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY root, id ORDER BY depth, ords) AS r FROM paths WHERE depth >= 2) WHERE r = 1),
routes AS (SELECT root, id, depth, array_to_string(list_transform(range(1, depth + 1), lambda i: chain[i] || ' -DEPENDS_ON-> ' || chain[i + 1]), ' ; ') AS path FROM shortest),
sole AS (SELECT e.src AS root, e.dst AS id, e.type, {TEXT.replace('src', 'e.src').replace('type', 'e.type').replace('dst', 'e.dst')} AS path FROM edges e
    WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.type = e.type AND o.dst = e.dst AND o.src <> e.src)),
detours AS (SELECT root, id, depth, array_to_string(list_transform(range(1, depth + 1), lambda i: chain[i] || ' -DEPENDS_ON-> ' || chain[i + 1]), ' ; ') AS path, array_to_string(chain[2:depth], ' -> ') AS via FROM longer),
affected AS (SELECT id AS root, id, 0 AS depth, '' AS path FROM elements WHERE kind = 'application' UNION ALL SELECT root, id, depth, path FROM routes),
degraded AS (SELECT root, capability AS id, via, depth, path FROM (
    SELECT a.root, e.dst AS capability, a.id AS via, a.depth, a.path || CASE WHEN a.path = '' THEN '' ELSE ' ; ' END || {TEXT} AS path,
        row_number() OVER (PARTITION BY a.root, e.dst ORDER BY a.id) AS r FROM affected a JOIN edges e ON e.src = a.id AND e.type = 'SUPPORTS') x
    WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM sole s WHERE s.type = 'SUPPORTS' AND s.root = x.root AND s.id = x.capability))
{select}"""


STOP = ", ".join(f"'{w}'" for w in STOPWORDS.split())
TERMS = f"""terms AS (SELECT chunk_id, t.term FROM (SELECT 'doc/' || doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) t WHERE t.term NOT IN ({STOP}))"""


def bm25_sql(asked: str, k: int, select: str = "") -> str:
    return f"""WITH {TERMS}, lengths AS (SELECT 'doc/' || d.doc_id AS chunk_id, coalesce(n, 0) AS length FROM documents d LEFT JOIN (SELECT chunk_id, count(*) AS n FROM terms GROUP BY 1) c ON c.chunk_id = 'doc/' || d.doc_id),
words AS ({asked}), asked AS (SELECT query_id, term, count(*) AS times FROM words WHERE term NOT IN ({STOP}) GROUP BY 1, 2),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(length) AS a FROM lengths),
scores AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 12) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (chunk_id), n GROUP BY 1, 2),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM scores WHERE score > 0)
{select or f"SELECT * FROM ranked WHERE rank <= {k}"}"""


SECTIONS = f"""WITH raw AS (SELECT 'doc/' || doc_id AS source, regexp_replace({MARKDOWN}, '(?s)<!--.*?-->', '', 'g') AS text FROM documents),
split AS (SELECT source, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM raw),
lines AS (SELECT source, i - 1 AS pos, l[i] AS line FROM (SELECT source, l, unnest(range(1, len(l) + 1)) AS i FROM split) WHERE i < len(l) OR l[i] <> ''),
fences AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS is_fence FROM lines),
inside AS (SELECT *, sum(is_fence::INT) OVER (PARTITION BY source ORDER BY pos) % 2 = 1 AS fenced FROM fences),
headed AS (SELECT *, NOT fenced AND NOT is_fence AND regexp_matches(line, '^#{{1,6}}\\s') AS is_heading FROM inside),
numbered AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY source ORDER BY pos) AS section FROM headed),
grouped AS (SELECT source, section, max(CASE WHEN is_heading THEN length(regexp_extract(line, '^#+')) END) AS level, max(CASE WHEN is_heading THEN regexp_extract(line, '^#+\\s+(.*?)\\s*#*\\s*$', 1) END) AS heading,
    regexp_replace(coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') AS body, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end FROM numbered GROUP BY 1, 2),
parts AS (SELECT * FROM grouped WHERE level IS NOT NULL OR body <> ''),
trails AS (SELECT p.source, p.section, list(q.heading ORDER BY q.section) AS path FROM parts p JOIN parts q ON q.source = p.source AND q.section <= p.section AND q.level IS NOT NULL AND p.level IS NOT NULL
    WHERE NOT EXISTS (SELECT 1 FROM parts r WHERE r.source = p.source AND r.section > q.section AND r.section <= p.section AND r.level <= q.level) GROUP BY 1, 2),
found AS (SELECT p.*, p.source || '#' || line_start AS chunk_id, coalesce(t.path, []) AS path,
    coalesce((SELECT arg_min(q.heading, q.section) FROM parts q WHERE q.source = p.source AND q.section <= p.section AND q.level = 1), '') AS document_title FROM parts p LEFT JOIN trails t USING (source, section))
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("chunk_id"), "text")


def of_graph(build: Callable, *args, cyclic: bool = False) -> Query:
    return lambda spark, sf_dir: build(graph(spark, sf_dir, cyclic), *args)


def listed_paths(g) -> DataFrame:
    return ops.dependency_paths(g, text=True)


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).withColumn("terms", tokens("text"))
    return found.select("chunk_id", F.size("terms").cast("long").alias("n_tokens"), F.md5(F.array_join("terms", " ")).alias("tokens_md5")).where("n_tokens > 0")


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(SEARCH).alias("query"))
    return search.search(texts(spark, sf_dir), query, 10)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(texts(spark, sf_dir), asked(spark, sf_dir), 3)


def plain(build: Callable, *args, columns: str = "root id path") -> Query:
    """A question's findings with their paths as text."""
    return of_graph(lambda g: ops.shown(build(g, *args)).select(*columns.split()))


def single(kind: str, inbound: bool) -> Query:
    return plain(ops.inbound if inbound else ops.outbound, kind)


def broken(g: Graph) -> DataFrame:
    """Violations of the graph with some bad rows added: every rule is broken."""
    spark = g.edges.sparkSession
    bad = spark.sql("select * from values ('A1', 'USES', 'A2', -1L), ('X', 'OWNS', 'Y', -2L), ('A1', 'RUNS_ON', 'D1', -3L), ('D1', 'SUPPORTS', 'C1', -4L), ('A2', 'DEPENDS_ON', 'A2', -5L), ('A1', 'RUNS_ON', 'T1', -6L), ('A1', 'RUNS_ON', 'T1', -7L) as t(src, type, dst, ord)")
    again = g.elements.where("id = 'A1'").withColumn("kind", F.lit("technology")).withColumn("kind_ord", F.lit(3))
    edges = g.edges.where("not (src = 'A1' and type = 'RUNS_ON' and dst = 'T1')").union(bad)
    return violations(g.elements.union(again), edges).select("rule", "src", "dst")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, text): documents written as markdown, with a title, nested headings, a comment, a fence and empty sections."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc/"), "doc_id").alias("source"), F.expr(MARKDOWN).alias("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(chunks(markdown(spark, sf_dir)))
    return found.select("chunk_id", "document_title", "breadcrumb", "citation", "is_empty", "is_document_title", F.md5("body").alias("body_md5"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unwritten(chunks(markdown(spark, sf_dir)))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items in an index that is kept, and whether document 0 is among the first three."""
    hits = search.index(texts(spark, sf_dir)).search(asked(spark, sf_dir), 3).withColumnRenamed("chunk_id", "source")
    best = hits.where("rank = 1").select("query_id", "source")
    return ranked_sources(hits, best.unionByName(best.withColumn("source", F.lit("doc/0"))).distinct())


def queries() -> dict[str, Query]:
    edges = lambda rows: rows.select("src", "type", "dst", "ord")
    return {
        "edges_by_type": of_graph(ops.edges_by_type),
        "all_edges": of_graph(lambda g: edges(g.edges)),
        "degree": of_graph(ops.degree),
        "isolated_elements": of_graph(ops.isolated),
        "violations": lambda s, d: (lambda g: violations(g.elements, g.edges).select("rule", "src", "dst"))(graph(s, d)),
        "violations_of_broken_rows": of_graph(broken),
        "owns_consumes_conflicts": of_graph(lambda g: conflicts(g.edges)),
        "find_elements": of_graph(lambda g: ops.find(g, " RED ").select("id", "kind", "name")),
        "list_elements": of_graph(lambda g: g.of_kind("application").select("id", "name")),
        "ids_of_kind": of_graph(lambda g: g.ids_of_kind("capability")),
        "element": of_graph(lambda g: g.elements.where(F.col("id") == ROOT).select("id", "kind", "name")),
        "outgoing": of_graph(lambda g: edges(g.outgoing(ROOT))),
        "incoming": of_graph(lambda g: edges(g.incoming(ROOT))),
        "targets": of_graph(lambda g: g.targets(ROOT, "SUPPORTS")),
        "sources": of_graph(lambda g: g.sources(ROOT, "DEPENDS_ON")),
        "apps_for_capability": single("SUPPORTS", True),
        "owned_data": single("OWNS", False),
        "consumed_data": single("CONSUMES", False),
        "consumers_without_ownership": plain(ops.consumers_without_ownership, columns="root id path owners"),
        "direct_dependents": single("DEPENDS_ON", True),
        "dependency_paths": of_graph(listed_paths),
        "dependency_paths_cyclic": of_graph(listed_paths, cyclic=True),
        "transitive_dependents": plain(ops.transitive_dependents, columns="root id depth path"),
        "transitive_dependents_cyclic": of_graph(lambda g: ops.transitive_dependents(g).select("root", "id", "depth"), cyclic=True),
        "indirect_dependents": of_graph(lambda g: ops.indirect_dependents(g).select("root", "id", "depth", "via")),
        "indirect_dependents_cyclic": of_graph(lambda g: ops.indirect_dependents(g).select("root", "id", "depth", "via"), cyclic=True),
        "affected": of_graph(lambda g: ops.shown(ops.affected(g, ops.reached(g)))),
        "dependent_lines": of_graph(ops.dependent_lines),
        "orphaned_data": plain(ops.only_source, "OWNS"),
        "orphaned_technologies": plain(ops.only_source, "RUNS_ON"),
        "capabilities_lost": plain(ops.only_source, "SUPPORTS"),
        "capabilities_degraded": plain(ops.degraded, columns="root id via depth path"),
        "capabilities_unaffected": plain(ops.unaffected, ROOT, columns="root id supporters path"),
        "named_findings": of_graph(lambda g: ops.named(g, ops.inbound(g, "DEPENDS_ON")).select("root", "id", "name", "kind", "explanation")),
        "rendered_findings": of_graph(lambda g: ops.rendered(ops.named(g, ops.inbound(g, "DEPENDS_ON")))),
        "json_findings": of_graph(lambda g: ops.as_json(ops.named(g, ops.only_source(g, "OWNS")))),
        "impact_report": of_graph(lambda g: ops.shown(ops.impact(g, ROOT)).select("section", "section_ord", "id", "name", "kind", "depth", "path", "explanation")),
        "impact_summary": of_graph(ops.impact_summary),
        "tokenize": tokenized,
        "sections": sections,
        "unwritten_sections": unwritten,
        "term_stats": lambda s, d: search.term_stats(texts(s, d)),
        "bm25_search": bm25,
        "bm25_batch": bm25_batch,
        "ranked_sources": indexed_search,
    }


def oracle_sql() -> dict[str, str]:
    hop = lambda kind, root, other: sql(f"SELECT {root} AS root, {other} AS id, {TEXT} AS path FROM edges WHERE type = '{kind}'")
    sole = lambda kind: sql(f"SELECT root, id, path FROM sole WHERE type = '{kind}'")
    count = lambda table, name, where="true": f"(SELECT count(*) FROM {table} t WHERE t.root = a.id AND {where}) AS {name}"
    degrees = "d AS (SELECT el.id, el.kind, count(x.id) AS degree FROM elements el LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x ON x.id = el.id GROUP BY 1, 2)"
    owned = "SELECT src, dst FROM edges WHERE type = 'OWNS' INTERSECT SELECT src, dst FROM edges WHERE type = 'CONSUMES'"
    hits = f"SELECT dst FROM edges WHERE type = 'SUPPORTS' AND src IN (SELECT id FROM affected WHERE root = '{ROOT}')"
    untouched = f"""SELECT '{ROOT}' AS root, id, coalesce((SELECT string_agg(DISTINCT src, ', ' ORDER BY src) FROM edges WHERE type = 'SUPPORTS' AND dst = c.id), 'no application') AS supporters,
            coalesce((SELECT string_agg({TEXT}, ' ; ' ORDER BY ord, src) FROM edges WHERE type = 'SUPPORTS' AND dst = c.id), '') AS path FROM elements c WHERE kind = 'capability' AND id NOT IN ({hits})"""
    way = "' in ' || depth || CASE WHEN depth = 1 THEN ' hop' ELSE ' hops' END"
    lost = lambda kind, sentence: f"SELECT id, NULL AS depth, path, {sentence} AS explanation FROM sole WHERE type = '{kind}' AND root = '{ROOT}'"
    report = [
        f"SELECT src AS id, 1 AS depth, {TEXT} AS path, src || ' depends on ' || dst AS explanation FROM edges WHERE type = 'DEPENDS_ON' AND dst = '{ROOT}'",
        f"SELECT id, depth, path, id || ' depends on ' || root || ' through ' || via FROM detours WHERE root = '{ROOT}'",
        f"SELECT id, depth, path, id || ' depends on ' || root || {way} FROM routes WHERE root = '{ROOT}'",
        lost("OWNS", "'only ' || root || ' owns ' || id"),
        f"SELECT dst, NULL, {TEXT}, src || ' consumes ' || dst || ', which stays' FROM edges WHERE type = 'CONSUMES' AND src = '{ROOT}'",
        lost("SUPPORTS", "'only ' || root || ' supports ' || id"),
        f"SELECT id, depth, path, CASE WHEN depth = 0 THEN id || ' keeps other support than that of ' || root ELSE id || ' is supported by ' || via || ' which depends on ' || root || {way} END FROM degraded WHERE root = '{ROOT}'",
        f"SELECT id, NULL, path, id || ' is supported by ' || supporters || ', not affected' FROM ({untouched})",
        lost("RUNS_ON", "'nothing but ' || root || ' runs on ' || id"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{name}' AS section, {i} AS section_ord, x.* FROM ({part}) x(id, depth, path, explanation)" for i, (name, part) in enumerate(zip(ops.SECTIONS, report, strict=True)))
    kinds = ", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in EDGE_TYPES.items())
    bad = f"""e2 AS (SELECT * FROM edges WHERE NOT (src = 'A1' AND type = 'RUNS_ON' AND dst = 'T1') UNION ALL SELECT * FROM (VALUES ('A1', 'USES', 'A2', -1), ('X', 'OWNS', 'Y', -2), ('A1', 'RUNS_ON', 'D1', -3), ('D1', 'SUPPORTS', 'C1', -4), ('A2', 'DEPENDS_ON', 'A2', -5), ('A1', 'RUNS_ON', 'T1', -6), ('A1', 'RUNS_ON', 'T1', -7))),
        types(type, sk, dk) AS (VALUES {kinds}), judged AS (SELECT e.*, sk, dk, a.kind AS ak, b.kind AS bk FROM e2 e LEFT JOIN types USING (type) LEFT JOIN elements a ON a.id = src LEFT JOIN elements b ON b.id = dst),
        fine AS (SELECT * FROM judged WHERE ak = sk AND bk = dk AND NOT (type = 'DEPENDS_ON' AND src = dst))
        SELECT 'repeated id' AS rule, 'A1' AS src, NULL AS dst UNION ALL SELECT 'unknown type', src, dst FROM judged WHERE sk IS NULL
        UNION ALL SELECT 'missing source', src, dst FROM judged WHERE sk IS NOT NULL AND ak IS NULL UNION ALL SELECT 'missing target', src, dst FROM judged WHERE sk IS NOT NULL AND bk IS NULL
        UNION ALL SELECT 'wrong source kind', src, dst FROM judged WHERE ak <> sk UNION ALL SELECT 'wrong target kind', src, dst FROM judged WHERE bk <> dk
        UNION ALL SELECT 'depends on itself', src, dst FROM judged WHERE type = 'DEPENDS_ON' AND src = dst
        UNION ALL SELECT 'repeated relationship', src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, type, dst ORDER BY ord) AS n FROM fine) WHERE n > 1
        UNION ALL SELECT 'owns and consumes', src, dst FROM (SELECT src, dst FROM fine WHERE type = 'OWNS' INTERSECT SELECT src, dst FROM fine WHERE type = 'CONSUMES')"""
    directly = f"SELECT dst AS root, src AS id, 0 AS nth, 'direct' AS label, {TEXT} AS route FROM edges WHERE type = 'DEPENDS_ON'"
    joined = f"SELECT dst AS root, src AS id, name, kind, src || ' depends on ' || dst AS explanation, {TEXT} AS path FROM edges JOIN elements ON id = src WHERE type = 'DEPENDS_ON'"
    own = f"FROM edges WHERE src = '{ROOT}'"
    items = "SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark"
    return {
        "all_edges": sql("SELECT src, type, dst, ord FROM edges"),
        "violations_of_broken_rows": sql("").rstrip() + f", {bad}",
        "list_elements": sql("SELECT id, name FROM elements WHERE kind = 'application'"),
        "ids_of_kind": sql("SELECT id FROM elements WHERE kind = 'capability'"),
        "element": sql(f"SELECT id, kind, name FROM elements WHERE id = '{ROOT}'"),
        "outgoing": sql(f"SELECT src, type, dst, ord {own}"),
        "incoming": sql(f"SELECT src, type, dst, ord FROM edges WHERE dst = '{ROOT}'"),
        "targets": sql(f"SELECT DISTINCT dst AS id {own} AND type = 'SUPPORTS'"),
        "sources": sql(f"SELECT DISTINCT src AS id FROM edges WHERE dst = '{ROOT}' AND type = 'DEPENDS_ON'"),
        "transitive_dependents_cyclic": sql("SELECT root, id, depth FROM routes", cyclic=True),
        "indirect_dependents_cyclic": sql("SELECT root, id, depth, via FROM detours", cyclic=True),
        "affected": sql("SELECT root, id, depth, path FROM affected"),
        "dependent_lines": sql(f"SELECT root, id, string_agg(label, ' and ' ORDER BY nth) AS label, string_agg(route, ' | ' ORDER BY nth) AS routes FROM ({directly} UNION ALL SELECT root, id, 1, 'indirect', path FROM detours) GROUP BY 1, 2"),
        "named_findings": sql(f"SELECT root, id, name, kind, explanation FROM ({joined})"),
        "rendered_findings": sql(f"SELECT root, id, id || ' (' || name || '): ' || explanation || ' [' || path || ']' AS line FROM ({joined})"),
        "json_findings": sql("""SELECT root, s.id, '{"id":"' || s.id || '","name":"' || name || '","kind":"data_object","explanation":"only ' || root || ' owns ' || s.id || '","path":[{"from":"' || root || '","type":"OWNS","to":"' || s.id || '"}]}' AS json FROM sole s JOIN elements e ON e.id = s.id WHERE type = 'OWNS'"""),
        "impact_report": sql(f"SELECT section, section_ord, id, name, kind, depth, path, explanation FROM ({rows}) JOIN elements USING (id)"),
        "sections": SECTIONS + "SELECT chunk_id, document_title, CASE WHEN len(path) = 0 THEN source ELSE array_to_string(path, ' > ') END AS breadcrumb, source || ', lines ' || line_start || '-' || line_end AS citation, body = '' AS is_empty, len(path) <= 1 AS is_document_title, md5(body) AS body_md5, line_start, line_end FROM found",
        "unwritten_sections": SECTIONS + "SELECT chunk_id, source, coalesce(heading, '') AS heading FROM found f WHERE body = '' AND NOT (len(path) <= 1 AND EXISTS (SELECT 1 FROM found w WHERE w.source = f.source AND w.body <> ''))",
        "ranked_sources": bm25_sql(items, 3, """, best AS (SELECT query_id, chunk_id FROM ranked WHERE rank = 1), expected AS (SELECT * FROM best UNION SELECT query_id, 'doc/0' FROM best)
            SELECT e.query_id, bool_and(t.rank IS NOT NULL) AS passed, min(t.rank) AS best_rank FROM expected e LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) t USING (query_id, chunk_id) GROUP BY 1"""),
        "edges_by_type": sql("SELECT type, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM edges GROUP BY 1"),
        "degree": sql("").rstrip() + f", {degrees} SELECT * FROM d",
        "isolated_elements": sql("").rstrip() + f", {degrees} SELECT id, kind FROM d WHERE degree = 0",
        "violations": sql(f"SELECT 'owns and consumes' AS rule, src, dst FROM ({owned}) UNION ALL SELECT 'depends on itself', src, dst FROM edges WHERE type = 'DEPENDS_ON' AND src = dst"),
        "owns_consumes_conflicts": sql(owned),
        "find_elements": sql("SELECT id, kind, name FROM elements WHERE contains(lower(name), 'red') OR lower(id) = 'red'"),
        "apps_for_capability": hop("SUPPORTS", "dst", "src"),
        "owned_data": hop("OWNS", "src", "dst"),
        "consumed_data": hop("CONSUMES", "src", "dst"),
        "consumers_without_ownership": sql(f"""SELECT dst AS root, src AS id, {TEXT} AS path, coalesce((SELECT string_agg(DISTINCT o.src, ', ' ORDER BY o.src) FROM edges o WHERE o.type = 'OWNS' AND o.dst = e.dst), 'none recorded') AS owners
            FROM edges e WHERE type = 'CONSUMES' AND NOT EXISTS (SELECT 1 FROM edges o WHERE o.type = 'OWNS' AND o.src = e.src AND o.dst = e.dst)"""),
        "direct_dependents": hop("DEPENDS_ON", "dst", "src"),
        "dependency_paths": sql("SELECT root, id, depth, array_to_string(nodes, ',') AS nodes FROM paths"),
        "dependency_paths_cyclic": sql("SELECT root, id, depth, array_to_string(nodes, ',') AS nodes FROM paths", cyclic=True),
        "transitive_dependents": sql("SELECT root, id, depth, path FROM routes"),
        "indirect_dependents": sql("SELECT root, id, depth, array_to_string(chain[2:depth], ' -> ') AS via FROM longer"),
        "orphaned_data": sole("OWNS"),
        "orphaned_technologies": sole("RUNS_ON"),
        "capabilities_lost": sole("SUPPORTS"),
        "capabilities_degraded": sql("SELECT root, id, via, depth, path FROM degraded"),
        "capabilities_unaffected": sql(untouched),
        "impact_summary": sql(f"""SELECT *, (SELECT count(*) FROM part) - n_lost - n_degraded AS n_unaffected FROM (SELECT a.id AS root, (SELECT count(*) FROM steps s WHERE s.dst = a.id) AS n_direct, {count('longer', 'n_indirect')}, {count('routes', 'n_transitive')},
            {count('sole', 'n_orphaned_data', "type = 'OWNS'")}, (SELECT count(*) FROM edges e WHERE e.src = a.id AND type = 'CONSUMES') AS n_consumed_data, {count('sole', 'n_lost', "type = 'SUPPORTS'")}, {count('degraded', 'n_degraded')},
            {count('sole', 'n_orphaned_technologies', "type = 'RUNS_ON'")} FROM elements a WHERE kind = 'application')"""),
        "tokenize": f"WITH {TERMS}, o AS (SELECT 'doc/' || doc_id AS chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({STOP})) AS l FROM documents) SELECT chunk_id, len(l) AS n_tokens, md5(array_to_string(l, ' ')) AS tokens_md5 FROM o WHERE len(l) > 0",
        "term_stats": f"WITH {TERMS} SELECT term, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_total FROM terms GROUP BY 1",
        "bm25_search": bm25_sql(f"SELECT 'q' AS query_id, unnest(regexp_extract_all(lower('{SEARCH}'), '[a-z0-9]+')) AS term", 10),
        "bm25_batch": bm25_sql(items, 3),
    }
