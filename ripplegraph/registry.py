"""Named tools over a graph and a prose index: each takes JSON-like arguments and returns rows, errors as text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as ops
from .operators import search
from .sources.model import KINDS, Graph


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    schema: dict
    build: Callable[..., DataFrame]

    def definition(self) -> dict:
        return {"name": self.name, "description": self.description, "input_schema": self.schema}


def schema(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


def tools(g: Graph, prose: DataFrame | search.Retriever | None = None) -> dict[str, Tool]:
    """prose: source, text of markdown documents, or what searches them; without it there is no search_documents."""
    apps = "application"
    narrow = {
        "applications_for_capability": ("capability", "Applications that support a capability", lambda root: ops.inbound(g, "SUPPORTS")),
        "owned_data": (apps, "Data objects an application is the authoritative source for", lambda root: ops.outbound(g, "OWNS")),
        "consumed_data": (apps, "Data objects an application reads without being their source", lambda root: ops.outbound(g, "CONSUMES")),
        "consumers_without_ownership": ("data_object", "Applications that read a data object and do not own it", lambda root: ops.consumers_without_ownership(g)),
        "direct_dependents": (apps, "Applications that depend on an application directly", lambda root: ops.inbound(g, "DEPENDS_ON")),
        "transitive_dependents": (apps, "Applications that depend on an application, directly or through others", lambda root: ops.transitive_dependents(g, root)),
        "indirect_dependents": (apps, "Applications with a route of two steps or more to an application, whether they depend on it directly as well or not", lambda root: ops.indirect_dependents(g, root)),
        "orphaned_data_if_retired": (apps, "Data objects left without any authoritative source", lambda root: ops.only_source(g, "OWNS")),
        "orphaned_technologies_if_retired": (apps, "Technologies on which nothing would run any more", lambda root: ops.only_source(g, "RUNS_ON")),
        "capabilities_losing_all_support": (apps, "Capabilities that only this application supports", lambda root: ops.only_source(g, "SUPPORTS")),
        "capabilities_degraded_by_retiring": (apps, "Capabilities that lose a supporter, or whose supporter depends on the application", lambda root: ops.degraded(g, root)),
        "capabilities_unaffected_by_retiring": (apps, "Capabilities that no affected application supports", lambda root: ops.unaffected(g, root)),
    }
    found: dict[str, Tool] = {}

    def add(name: str, description: str, shape: dict, build: Callable[..., DataFrame]) -> None:
        found[name] = Tool(name, description + ".", shape, build)

    def one(kind: str, build: Callable[[str], DataFrame]) -> Callable[[str], DataFrame]:
        def run(id: str) -> DataFrame:
            g.require(id, kind)
            return ops.named(g, build(id).where(F.col("root") == id).select(*ops.FINDING)).select("id", "name", "kind", "attributes", "explanation", "path", "depth").orderBy("id")

        return run

    text, kind = {"type": "string"}, {"type": "string", "enum": list(KINDS.values())}
    for name, (of, description, build) in narrow.items():
        add(name, description, schema(["id"], id=text | {"description": f"id of the {of}"}), one(of, build))

    def impact(id: str) -> DataFrame:
        g.require(id, apps)
        return ops.impact(g, id).select("section", "id", "name", "kind", "explanation", "path", "depth").orderBy("section_ord", "id")

    add("impact_of_retiring", "All nine sections of an application's retirement, each row with its proof", schema(["id"], id=text), impact)
    add("find_elements", "Elements whose name contains a text, or whose id it is", schema(["query"], query=text, kind=kind), lambda query, kind=None: ops.find(g, query, kind).orderBy("kind_ord", "id"))
    add("list_elements", "All elements of a kind", schema(["kind"], kind=kind), lambda kind: g.of_kind(kind).select("id", "name", "attributes").orderBy("id"))
    if prose is not None:
        retriever = search.KeywordRetriever(prose) if isinstance(prose, DataFrame) else prose
        add("search_documents", "The sections of prose that match a question best", schema(["query"], query=text, k={"type": "integer", "minimum": 0}), lambda query, k=3: retriever.search(query, k))
    return found


def execute(known: dict[str, Tool], name: str, arguments: dict) -> tuple[list[dict] | None, str | None]:
    """(rows, None) or (None, what is wrong)."""
    if name not in known:
        return None, f"no tool {name}"
    try:
        return [r.asDict(recursive=True) for r in known[name].build(**arguments).collect()], None
    except (KeyError, TypeError, ValueError, PySparkException) as error:
        return None, str(error.args[0] if isinstance(error, KeyError) else error)
