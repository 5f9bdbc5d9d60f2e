"""Typed dependency graphs: a model document (JSON) as two tables, and every rule it breaks as rows of a third.

elements(id, kind, name, attributes, kind_ord, ord) and edges(src, type, dst, ord); ord is the place in the document.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds in the order of a model document, and each relationship type's source and target kind.
KINDS = {"capabilities": "capability", "applications": "application", "data_objects": "data_object", "technologies": "technology"}
EDGE_TYPES = {
    "SUPPORTS": ("application", "capability"),
    "OWNS": ("application", "data_object"),
    "CONSUMES": ("application", "data_object"),
    "DEPENDS_ON": ("application", "application"),
    "RUNS_ON": ("application", "technology"),
}
ELEMENT = pa.schema([("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("kind_ord", pa.int32()), ("ord", pa.int64())])
EDGE = pa.schema([("src", pa.string()), ("type", pa.string()), ("dst", pa.string()), ("ord", pa.int64())])


#: Values of a document that stand for text; numbers are read as their digits.
PLAIN = (str, int, float)


class ModelError(ValueError):
    """All that is wrong with a model document."""

    def __init__(self, errors: list[str]):
        self.errors = errors
        super().__init__(f"model has {len(errors)} problem(s):" + "".join(f"\n- {e}" for e in errors))


class UnknownElement(KeyError):
    """No element has this id, or it is of another kind than asked for."""


@dataclass
class Graph:
    elements: DataFrame
    edges: DataFrame
    warnings: list[str] = field(default_factory=list)

    def of_type(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("type") == kind)

    def of_kind(self, kind: str) -> DataFrame:
        if kind not in KINDS.values():
            raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS.values())}")
        return self.elements.where(F.col("kind") == kind)

    def has(self, element_id: str) -> bool:
        return not self.elements.where(F.col("id") == element_id).isEmpty()

    def name(self, element_id: str) -> str:
        return self.require(element_id)["name"]

    def ids_of_kind(self, kind: str) -> DataFrame:
        return self.of_kind(kind).select("id").orderBy("id")

    def side(self, element_id: str, end: str, kind: str | None) -> DataFrame:
        self.require(element_id)
        rows = self.edges if kind is None else self.of_type(kind)
        return rows.where(F.col(end) == element_id)

    def outgoing(self, element_id: str, kind: str | None = None) -> DataFrame:
        """Relationships from an element, of one type or all, in the order of the document."""
        return self.side(element_id, "src", kind).orderBy("ord", "type", "dst")

    def incoming(self, element_id: str, kind: str | None = None) -> DataFrame:
        return self.side(element_id, "dst", kind).orderBy("ord", "type", "src")

    def targets(self, element_id: str, kind: str) -> DataFrame:
        """(id): what an element relates to by this type, each once, sorted."""
        return self.side(element_id, "src", kind).select(F.col("dst").alias("id")).distinct().orderBy("id")

    def sources(self, element_id: str, kind: str) -> DataFrame:
        return self.side(element_id, "dst", kind).select(F.col("src").alias("id")).distinct().orderBy("id")

    def counts(self) -> dict[str, int]:
        """Elements of each kind, and relationships."""
        found = {r["kind"]: r["count"] for r in self.elements.groupBy("kind").count().collect()}
        return {k: found.get(k, 0) for k in KINDS.values()} | {"relationships": self.edges.count()}

    def require(self, element_id: str, kind: str | None = None) -> dict:
        """The element, checked before a query takes its id."""
        found = self.elements.where(F.col("id") == element_id).first()
        if found is None:
            raise UnknownElement(f"no element {element_id}")
        if kind and found["kind"] != kind:
            raise UnknownElement(f"{element_id} is of kind {found['kind']}, not {kind}")
        return found.asDict()


def local_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A document's rows as a relation of the plan itself: no task reads them through Python."""
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema))


def edge_types(spark: SparkSession) -> DataFrame:
    rows = [(t, *kinds, i) for i, (t, kinds) in enumerate(EDGE_TYPES.items())]
    return local_table(spark, rows, pa.schema([("type", pa.string()), ("src_kind", pa.string()), ("dst_kind", pa.string()), ("type_ord", pa.int32())]))


def violations(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, ord, src, type, dst) of every rule that elements and edges break, OWNS and CONSUMES of one pair included."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("kind_ord", "ord"))
    ranked = elements.withColumn("nth", first)
    null = F.lit(None).cast("string")
    again = ranked.where("nth > 1").select(F.lit("repeated id").alias("rule"), "ord", F.col("id").alias("src"), null.alias("type"), null.alias("dst"))
    kinds = ranked.where("nth = 1").select("id", "kind")
    types = F.broadcast(edge_types(edges.sparkSession))  # five rows
    known = edges.join(types, "type", "left")
    sources = kinds.select(F.col("id").alias("src"), F.col("kind").alias("src_is"))
    targets = kinds.select(F.col("id").alias("dst"), F.col("kind").alias("dst_is"))
    looked = known.join(sources, "src", "left").join(targets, "dst", "left")
    rules = F.expr("""filter(array(
        if(src_kind is null, 'unknown type', null),
        if(src_kind is not null and src_is is null, 'missing source', null),
        if(src_kind is not null and dst_is is null, 'missing target', null),
        if(src_is <> src_kind, 'wrong source kind', null),
        if(dst_is <> dst_kind, 'wrong target kind', null),
        if(type = 'DEPENDS_ON' and src = dst and src_is = src_kind, 'depends on itself', null)), r -> r is not null)""")
    judged = looked.withColumn("rules", rules)
    broken = judged.select(F.explode("rules").alias("rule"), "ord", "src", "type", "dst")
    fine = judged.where(F.size("rules") == 0).select("src", "type", "dst", "ord")
    nth = F.row_number().over(Window.partitionBy("src", "type", "dst").orderBy("ord"))
    twice = fine.withColumn("nth", nth).where("nth > 1").select(F.lit("repeated relationship").alias("rule"), "ord", "src", "type", "dst")
    both = conflicts(fine).select(F.lit("owns and consumes").alias("rule"), F.lit(None).cast("long").alias("ord"), "src", null.alias("type"), "dst")
    return again.union(broken).union(twice).union(both)


def conflicts(edges: DataFrame) -> DataFrame:
    """Pairs that are both OWNS and CONSUMES."""
    owns, consumes = (edges.where(F.col("type") == t).select("src", "dst").distinct() for t in ("OWNS", "CONSUMES"))
    return owns.join(consumes, ["src", "dst"], "left_semi")


def from_document(spark: SparkSession, document: dict, strict: bool = True) -> Graph:
    """A graph from a parsed document; ModelError names every problem. Not strict: OWNS with CONSUMES only warns."""
    errors, elements, edges = [], [], []
    for kind_ord, (name, kind) in enumerate(KINDS.items()):
        rows = document.get(name, [])
        if not isinstance(rows, list):
            errors.append(f"{name} is not a list")
            continue
        for i, row in enumerate(rows):
            if not isinstance(row, dict) or not {"id", "name"} <= row.keys():
                errors.append(f"{name}[{i}] needs an id and a name")
                continue
            if not all(isinstance(row[k], PLAIN) for k in ("id", "name")):
                errors.append(f"{name}[{i}]: id and name must be text")
                continue
            rest = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in row.items() if k not in ("id", "name")]
            elements.append((str(row["id"]), kind, str(row["name"]), rest, kind_ord, i))
    rows = document.get("relationships", [])
    if not isinstance(rows, list):
        errors.append("relationships is not a list")
        rows = []
    for i, row in enumerate(rows):
        if not isinstance(row, dict) or not {"from", "type", "to"} <= row.keys():
            errors.append(f"relationships[{i}] needs from, type and to")
            continue
        if not all(isinstance(row[k], PLAIN) for k in ("from", "type", "to")):
            errors.append(f"relationships[{i}]: from, type and to must be text")
            continue
        edges.append((str(row["from"]), str(row["type"]), str(row["to"]), i))
    graph = Graph(local_table(spark, elements, ELEMENT), local_table(spark, edges, EDGE))
    found = violations(graph.elements, graph.edges).orderBy(F.expr("rule <> 'repeated id'"), F.col("ord").asc_nulls_last(), "src", "dst").collect()
    kinds = {}
    for element in elements:
        kinds.setdefault(element[0], element[1])
    for v in found:
        if v.rule == "owns and consumes":
            (errors if strict else graph.warnings).append(f"{v.src} both owns and consumes {v.dst}")
        elif v.rule == "repeated id":
            others = [e[1] for e in elements if e[0] == v.src]
            errors.append(f"id {v.src} is used more than once ({', '.join(others)})")
        else:
            errors.append(f"relationships[{v.ord}] {v.src} {v.type} {v.dst}: {v.rule}")
    if errors:
        raise ModelError(errors)
    return graph


def load(spark: SparkSession, path: str, strict: bool = True) -> Graph:
    """ModelError too if the file can't be read or isn't JSON."""
    try:
        text = spark.read.text(path, wholetext=True).first()
        document = json.loads(text[0]) if text else {}
    except (PySparkException, ValueError) as error:
        raise ModelError([f"{path} can't be read: {str(error).splitlines()[0]}"]) from error
    if not isinstance(document, dict):
        raise ModelError([f"{path} holds no object"])
    return from_document(spark, document, strict)
