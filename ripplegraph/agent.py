"""A bounded loop in which a language model picks tools and words the answer; the facts come from the tools.

The model is behind a client that the caller gives: any object with
    reply(system, messages, tools) -> Reply
There is none in this package, and nothing here opens a connection.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from .registry import Tool, execute

MOST_TURNS = 12
SYSTEM = """You answer questions about a model of applications, capabilities, data objects and technologies, and about the prose kept beside it.
State only what a tool returned in this conversation, and name the relationships or sections that show it.
Retiring an application takes with it the data objects that no other application owns. Data that it merely consumes stays as it is.
A capability is lost when its only supporter goes, and degraded when another affected application still supports it.
The model holds no costs, dates, people, risk or safety verdicts. Asked for such a thing, decline, and say which information is missing."""


class ConfigurationError(RuntimeError):
    """A setting that the language model needs is missing; the message names it."""


def load_env(path: str) -> None:
    """Reads NAME=value lines into the environment, where names that are set stay as they are. A missing file is none."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, separator, value = line.strip().partition("=")
            if separator and name.strip() and not name.startswith("#"):
                os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def setting(name: str) -> str:
    value = os.environ.get(name, "").strip()
    if not value:
        raise ConfigurationError(f"{name} is not set")
    return value


@dataclass(frozen=True)
class Call:
    id: str
    name: str
    arguments: dict


@dataclass(frozen=True)
class Reply:
    text: str = ""
    calls: tuple[Call, ...] = ()
    tokens_in: int = 0
    tokens_out: int = 0


class Client(Protocol):
    def reply(self, system: str, messages: list[dict], tools: list[dict]) -> Reply: ...


@dataclass(frozen=True)
class ToolCall:
    name: str
    arguments: dict
    result: list[dict] | None
    error: str | None

    def render(self) -> str:
        given = json.dumps(self.arguments, ensure_ascii=False, sort_keys=True)
        return f"{self.name}({given}): " + (f"error, {self.error}" if self.error else f"{len(self.result or [])} row(s)")


@dataclass
class Answer:
    question: str
    text: str = ""
    calls: list[ToolCall] = field(default_factory=list)
    stop_reason: str = ""
    tokens_in: int = 0
    tokens_out: int = 0

    @property
    def sources(self) -> list[str]:
        """Documents that a tool's rows name, in the order of their first mention."""
        return list(dict.fromkeys(r["source"] for c in self.calls for r in c.result or [] if r.get("source")))

    def render(self, evidence: bool = True) -> str:
        if not evidence:
            return self.text
        shown = [f"  {c.render()}" for c in self.calls] or ["  none: no tool was called, so nothing backs this answer"]
        named = [f"  {s}" for s in self.sources]
        return "\n".join([self.text, "", "Evidence:", *shown, *(["Sources:", *named] if named else [])])


class Analyst:
    def __init__(self, tools: dict[str, Tool], client: Client | None = None, most_turns: int = MOST_TURNS):
        self.tools, self.client, self.most_turns = tools, client, most_turns

    def ask(self, question: str) -> Answer:
        """Turns until the model calls no tool, most_turns at most; all calls of a turn are answered in one message."""
        if self.client is None:
            raise ConfigurationError("no client for a language model was given")
        answer, messages = Answer(question), [{"role": "user", "content": question}]
        for _ in range(self.most_turns):
            reply = self.client.reply(SYSTEM, messages, [t.definition() for t in self.tools.values()])
            answer.tokens_in += reply.tokens_in
            answer.tokens_out += reply.tokens_out
            answer.text = reply.text or answer.text
            if not reply.calls:
                answer.stop_reason = "answered"
                return answer
            messages.append({"role": "assistant", "content": reply.text, "calls": [vars(c) for c in reply.calls]})
            results = []
            for call in reply.calls:
                rows, error = execute(self.tools, call.name, call.arguments)
                answer.calls.append(ToolCall(call.name, call.arguments, rows, error))
                results.append({"id": call.id, "is_error": error is not None, "content": error if error else json.dumps(rows, ensure_ascii=False, default=str)})
            messages.append({"role": "user", "results": results})
        answer.stop_reason = "turns"
        answer.text = answer.text or f"Stopped after {self.most_turns} turns without an answer."
        return answer


def ask(question: str, tools: dict[str, Tool], client: Client) -> Answer:
    return Analyst(tools, client).ask(question)


def dry_run(questions: Iterable[tuple[str, str, dict]], tools: dict[str, Tool]) -> str:
    """What a model would see for each (question, tool, arguments), without one."""
    parts = [SYSTEM]
    for question, name, arguments in questions:
        rows, error = execute(tools, name, arguments)
        parts += [f"Question: {question}", ToolCall(name, arguments, rows, error).render(), json.dumps(rows, ensure_ascii=False, default=str) if rows is not None else str(error)]
    return "\n\n".join(parts)
