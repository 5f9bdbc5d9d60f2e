"""Scores of answers to fixed questions: exact sets of ids, sources among the first hits, words of an answer.

Questions are rows: id, kind (graph, retrieval or refusal), question, expected (ids or sources). A plan says which tool
answers a graph question. A score's passed is null where the question was not run.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agent import Answer
from .registry import Tool, execute

ID = re.compile(r"\b[ACDT]0[1-9]\b")
# Words that show a refusal, a verdict, and that something missing was named; in lower case.
DECLINES = ("cannot", "can't", "unable", "not able", "decline", "no information", "does not contain", "do not have", "not in the")
VERDICTS = ("is safe to", "it is safe", "is not safe", "will cost", "costs approximately", "the cost is")
MISSING = ("missing", "would need", "is needed", "not recorded", "no data on", "does not contain", "not in the model")


@dataclass(frozen=True)
class Score:
    question_id: str
    kind: str
    passed: bool | None
    detail: str


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, question, expected) from a JSON file with a list `questions` of objects with id, type, question and one of expected, expected_answer, expected_sources."""
    shape = "array<struct<id:string,type:string,question:string,expected:array<string>,expected_answer:array<string>,expected_sources:array<string>>>"
    rows = spark.read.schema(f"questions {shape}").option("multiLine", True).json(path).selectExpr("inline(questions)")
    return rows.select("id", F.col("type").alias("kind"), "question", F.coalesce("expected", "expected_answer", "expected_sources", F.array().cast("array<string>")).alias("expected"))


def score_graph(question_id: str, expected: list[str], tools: dict[str, Tool], plan: dict[str, tuple[str, dict]]) -> Score:
    """Passed if the tool's ids are exactly the expected ones."""
    if question_id not in plan:
        return Score(question_id, "graph", None, "not run: no tool is planned for it")
    rows, error = execute(tools, *plan[question_id])
    found = sorted({r["id"] for r in rows or []})
    return Score(question_id, "graph", error is None and found == sorted(set(expected)), error or f"expected {' '.join(sorted(expected)) or 'nothing'}, found {' '.join(found) or 'nothing'}")


def ranked_sources(hits: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, passed, best_rank): whether every expected source (query_id, source) is among a query's first k hits (query_id, rank, source)."""
    first = hits.where(F.col("rank") <= k).groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    joined = expected.join(first, ["query_id", "source"], "left")
    return joined.groupBy("query_id").agg(F.bool_and(F.col("rank").isNotNull()).alias("passed"), F.min("rank").alias("best_rank"))


def probe(retriever, asked: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """`ranked_sources` of (query_id, query), all searched at once in a keyword retriever."""
    hits = retriever.index.search(asked, k).join(retriever.sections.select("chunk_id", "source"), "chunk_id")
    return ranked_sources(hits, expected, k)


def score_answer(question_id: str, kind: str, expected: list[str], answer: Answer | None) -> Score:
    """By words: a graph answer mentions every expected id, a retrieval one names every source, a refusal declines without a verdict and says what is missing."""
    if answer is None:
        return Score(question_id, kind, None, "not run: needs a language model")
    text = answer.text.lower()
    if kind == "refusal":
        declines, verdict, missing = (any(w in text for w in words) for words in (DECLINES, VERDICTS, MISSING))
        return Score(question_id, kind, declines and not verdict and missing, f"declines: {declines}, verdict: {verdict}, names what is missing: {missing}")
    found = set(answer.sources) if kind == "retrieval" else set(ID.findall(answer.text))
    lacking = sorted(set(expected) - found)
    return Score(question_id, kind, not lacking, f"lacking {' '.join(lacking)}" if lacking else "all there")


def table(scores: list[Score]) -> str:
    mark = {True: "pass", False: "fail", None: "not run"}
    lines = [f"{s.question_id:<8}{s.kind:<12}{mark[s.passed]:<9}{s.detail}" for s in scores]
    run = [s for s in scores if s.passed is not None]
    return "\n".join([*lines, f"{sum(s.passed for s in run)} of {len(run)} passed, {len(scores) - len(run)} not run"])


def as_json(scores: list[Score]) -> str:
    return json.dumps([vars(s) for s in scores], ensure_ascii=False)


def tally(scores: DataFrame) -> DataFrame:
    """(kind, n, n_passed, n_not_run) of scores as rows (kind, passed)."""
    return scores.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if(F.col("passed").isNull()).alias("n_not_run"))


