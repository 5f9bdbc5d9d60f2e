"""python -m ripplegraph.cli --model FILE (QUESTION | --list | --show ID | --impact ID | --search TEXT --prose FOLDER) [--json] [--no-evidence] [--warn]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .agent import Analyst, Client, ConfigurationError
from .operators import graph as ops
from .operators.search import KeywordRetriever, rendered
from .registry import execute, tools
from .sources.model import EDGE_TYPES, Graph, ModelError, edge_types, load


def counted(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def with_names(g: Graph):
    """Relationships with the names of both ends."""
    of = lambda end: g.elements.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return g.edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")


def line(r) -> str:
    return f"  {r.src} {r.src_name} -{r.type}-> {r.dst} {r.dst_name}"


def listed(g: Graph) -> list[str]:
    """Kinds with their numbers, every element with its number of relationships, then every relationship by type."""
    rows = ops.degree(g).join(g.elements.select("id", "name", "kind_ord", "attributes"), "id").orderBy("kind_ord", "id").collect()
    lines = []
    for kind in dict.fromkeys(r.kind for r in rows):
        own = [r for r in rows if r.kind == kind]
        lines.append(f"{kind} ({len(own)})")
        for r in own:
            lifecycle = (r.attributes or {}).get("lifecycle")
            lines.append(f"  {r.id} {r.name}{f' [{lifecycle}]' if lifecycle else ''}: {counted(r.degree, 'relationship') if r.degree else 'isolated'}")
    edges = with_names(g).join(edge_types(g.edges.sparkSession).select("type", "type_ord"), "type").orderBy("type_ord", "src", "dst").collect()
    for kind in EDGE_TYPES:
        own = [r for r in edges if r.type == kind]
        lines += [f"{kind} ({len(own)})", *map(line, own)] if own else []
    return lines


def shown(g: Graph, element_id: str) -> list[str]:
    element = g.require(element_id)
    lines = [f"{element['id']} {element['name']} ({element['kind']})", *[f"{k}: {v}" for k, v in sorted((element["attributes"] or {}).items())]]
    for title, side, other in (("outgoing", "src", "dst"), ("incoming", "dst", "src")):
        lines += [title, *map(line, with_names(g).where(F.col(side) == element_id).orderBy("type", other).collect())]
    return lines


def dumped(g: Graph) -> dict:
    """The model as plain values: attributes beside id, kind and name; relationships as from, type, to."""
    elements = g.elements.orderBy("kind_ord", "ord").collect()
    edges = g.edges.orderBy("ord").collect()
    return {"elements": [{"id": r.id, "kind": r.kind, "name": r.name} | (r.attributes or {}) for r in elements], "relationships": [{"from": r.src, "type": r.type, "to": r.dst} for r in edges]}


def report(g: Graph, root: str) -> list[str]:
    """The nine sections as text; direct and indirect dependents share one line each, with their routes below."""
    rows = ops.impact(g, root).orderBy("section_ord", "id").collect()
    names = {r.id: r.name for r in rows}
    text = lambda path: " ; ".join(f"{e['from']} -{e['type']}-> {e['to']}" for e in path) or ops.NONE
    lines = [f"retiring {root} {g.name(root)}", "direct and indirect dependents"]
    found = ops.dependent_lines(g, root).orderBy("id").collect()
    for r in found:
        lines += [f"  {r.id} {names[r.id]}: {r.label}", *[f"    {route}" for route in r.routes.split(" | ")]]
    lines += [] if found else ["  (none)"]
    for section in ops.SECTIONS[2:]:
        own = [r for r in rows if r.section == section]
        lines += [section, *[f"  {r.id} {r.name}: {r.explanation} [{text(r.path)}]" for r in own]] if own else [section, "  (none)"]
    return lines


def dropped_nulls(rows: list[dict]) -> list[dict]:
    return [{k: v for k, v in r.items() if not (k == "depth" and v is None)} for r in rows]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client: Client | None = None) -> int:
    """0: answered; 1: invalid model or unknown id; 2: nothing asked, or no language model for a question."""
    parser = argparse.ArgumentParser(prog="ripplegraph")
    parser.add_argument("question", nargs="?", help="for a language model, whose client the caller of main() gives")
    parser.add_argument("--model", required=True)
    parser.add_argument("--prose", help="folder of markdown files to search")
    for name in ("--show", "--impact", "--search"):
        parser.add_argument(name)
    for name in ("--list", "--json", "--warn", "--no-evidence"):
        parser.add_argument(name, action="store_true")
    args = parser.parse_args(argv)
    if not (args.list or args.show or args.impact or args.search or args.question):
        parser.print_usage(sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("ripplegraph").getOrCreate()
    try:
        g = load(spark, args.model, strict=not args.warn)
        for warning in g.warnings:
            print(f"warning: {warning}", file=sys.stderr)
        prose = KeywordRetriever.from_corpus(spark, args.prose) if args.prose and not (args.list or args.show or args.impact) else None
        if args.list:
            out = dumped(g) if args.json else listed(g)
        elif args.show:
            out = shown(g, args.show)
        elif args.impact:
            g.require(args.impact, "application")
            out = dropped_nulls(execute(tools(g), "impact_of_retiring", {"id": args.impact})[0]) if args.json else report(g, args.impact)
        elif args.search:
            if prose is None:
                print("--search needs --prose", file=sys.stderr)
                return 2
            hits = prose.search(args.search)
            out = [r.asDict() for r in hits.collect()] if args.json else [r.line for r in rendered(hits).orderBy("rank").collect()]
        else:
            answer = Analyst(tools(g, prose), client).ask(args.question)
            out = {"answer": answer.text, "stop_reason": answer.stop_reason, "calls": [vars(c) for c in answer.calls], "sources": answer.sources} if args.json else [answer.render(not args.no_evidence)]
    except ConfigurationError as error:
        print(error, file=sys.stderr)
        return 2
    except (ModelError, KeyError) as error:
        print(error.args[0] if isinstance(error, KeyError) else error, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str) if args.json else "\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
