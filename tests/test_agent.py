import json
import os

import pytest

from ripplegraph import agent, evaluation, registry
from ripplegraph.agent import Analyst, Answer, Call, ConfigurationError, Reply, ToolCall
from ripplegraph.sources.model import from_document

from .test_graph import document


class Scripted:
    """A client that gives written replies and keeps what it was sent."""

    def __init__(self, *replies):
        self.replies, self.sent = list(replies), []

    def reply(self, system, messages, tools):
        self.sent.append((system, [dict(m) for m in messages], tools))
        return self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]


@pytest.fixture(scope="module")
def known(spark):
    prose = spark.createDataFrame([("rules/one.md", "# One\n## Sources\nEvery data object has one owner.")], "source string, text string")
    return registry.tools(from_document(spark, document()), prose)


def call(name, **arguments):
    return Call("1", name, arguments)


def test_tools_run_and_their_rows_go_back(known):
    client = Scripted(Reply(calls=(call("direct_dependents", id="A05"), call("search_documents", query="owner")), tokens_in=5, tokens_out=1), Reply("Three depend on it.", tokens_in=7, tokens_out=2))
    answer = Analyst(known, client).ask("What depends on A05?")
    assert (answer.text, answer.stop_reason, answer.tokens_in, answer.tokens_out) == ("Three depend on it.", "answered", 12, 3)
    assert [r["id"] for r in answer.calls[0].result] == ["A01", "A06", "A07"] and answer.sources == ["rules/one.md"]
    results = client.sent[1][1][-1]["results"]
    assert len(results) == 2 and not results[0]["is_error"] and json.loads(results[0]["content"])[0]["name"] == "A number 1"
    assert len(client.sent[0][2]) == 16 and "Three depend" in answer.render() and "rules/one.md" in answer.render() and answer.render(False) == "Three depend on it."


def test_errors_are_answers(known):
    client = Scripted(Reply(calls=(call("direct_dependents", id="A99"), call("nothing"), call("list_elements", kind="x"))), Reply("No such thing."))
    answer = Analyst(known, client).ask("?")
    assert all(c.error and c.result is None for c in answer.calls) and "A99" in answer.calls[0].error
    assert all(r["is_error"] for r in client.sent[1][1][-1]["results"])


def test_the_loop_is_bounded(known):
    answer = Analyst(known, Scripted(Reply(calls=(call("nothing"),)))).ask("?")
    assert len(answer.calls) == 12 and answer.stop_reason == "turns" and answer.text.startswith("Stopped after 12")


def test_an_answer_without_tools_says_so(known):
    assert "nothing backs this" in agent.ask("?", known, Scripted(Reply("Yes."))).render()
    with pytest.raises(ConfigurationError):
        Analyst(known).ask("?")


def test_environment_files(tmp_path, monkeypatch):
    path = tmp_path / "settings"
    path.write_text("# note\n\nRIPPLE_ONE='1'\nRIPPLE_TWO = two\nno value\nRIPPLE_SET=new\n")
    for name in ("RIPPLE_ONE", "RIPPLE_TWO"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("RIPPLE_SET", "old")
    agent.load_env(str(path))
    agent.load_env(str(tmp_path / "none"))
    names = ["RIPPLE_ONE", "RIPPLE_TWO", "RIPPLE_SET"]
    assert [os.environ.get(n, os.environ.get(f"{n} ")) for n in names] == ["1", "two", "old"]
    with pytest.raises(ConfigurationError):
        agent.setting("RIPPLE_NONE")


# FIXTURES.md, section 1.2.
PLAN = {
    "Q01": ("applications_for_capability", "C01", "A01 A04"), "Q02": ("direct_dependents", "A05", "A01 A06 A07"), "Q03": ("orphaned_data_if_retired", "A05", "D05"), "Q04": ("capabilities_losing_all_support", "A05", "C04"),
    "Q05": ("indirect_dependents", "A05", "A07"), "Q06": ("orphaned_technologies_if_retired", "A05", "T03"), "Q07": ("consumers_without_ownership", "D01", "A01 A05"), "Q08": ("capabilities_unaffected_by_retiring", "A05", "C02"),
}


def test_all_graph_questions_pass(known):
    plan = {q: (tool, {"id": of}) for q, (tool, of, _) in PLAN.items()}
    scores = [evaluation.score_graph(q, want.split(), known, plan) for q, (_, _, want) in PLAN.items()]
    assert all(s.passed for s in scores), evaluation.table(scores)
    scores.append(evaluation.score_graph("Q99", [], known, plan))
    assert evaluation.table(scores).endswith("8 of 8 passed, 1 not run") and json.loads(evaluation.as_json(scores))[8]["passed"] is None
    assert not evaluation.score_graph("Q02", ["A01"], known, plan).passed
    assert "Question: Who?" in agent.dry_run([("Who?", "direct_dependents", {"id": "A05"})], known)


def test_answers_are_scored_by_words():
    refused = Answer("?", "I cannot say; costs are missing from what I have.")
    assert evaluation.score_answer("Q11", "refusal", [], refused).passed
    assert not evaluation.score_answer("Q11", "refusal", [], Answer("?", "I cannot say, but it is safe to go on; costs are missing.")).passed
    assert not evaluation.score_answer("Q11", "refusal", [], Answer("?", "I cannot say.")).passed
    assert evaluation.score_answer("Q12", "refusal", [], None).passed is None
    assert evaluation.score_answer("Q01", "graph", ["A01"], Answer("?", "A01 does.")).passed
    named = Answer("?", calls=[ToolCall("search_documents", {}, [{"source": "a.md"}], None)])
    assert evaluation.score_answer("Q09", "retrieval", ["a.md"], named).passed and not evaluation.score_answer("Q09", "retrieval", ["b.md"], named).passed


def test_sources_among_the_first_hits(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "c"), ("r", 1, "c")], "query_id string, rank int, source string")
    expected = spark.createDataFrame([("q", "b"), ("q", "a"), ("r", "a"), ("s", "a")], "query_id string, source string")
    found = evaluation.ranked_sources(hits, expected)
    assert {r.query_id: (r.passed, r.best_rank) for r in found.collect()} == {"q": (True, 1), "r": (False, None), "s": (False, None)}
    scores = spark.createDataFrame([("graph", True), ("graph", None), ("refusal", False)], "kind string, passed boolean")
    assert {r.kind: (r.n, r.n_passed, r.n_not_run) for r in evaluation.tally(scores).collect()} == {"graph": (2, 1, 1), "refusal": (1, 0, 0)}


def test_questions_are_read(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps({"about": "x", "questions": [{"id": "Q1", "type": "graph", "question": "?", "expected": ["A01"]}, {"id": "Q2", "type": "retrieval", "question": "?", "expected_sources": ["a.md"]}, {"id": "Q3", "type": "refusal", "question": "?"}]}))
    assert [tuple(r) for r in evaluation.questions(spark, str(path)).collect()] == [("Q1", "graph", "?", ["A01"]), ("Q2", "retrieval", "?", ["a.md"]), ("Q3", "refusal", "?", [])]
