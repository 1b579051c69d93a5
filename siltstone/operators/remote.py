"""Extractors that ask a model over HTTP, one forced tool call a question.

The transport is a function (url, headers, body) -> answer, all JSON-like, and may be replaced; the
default one is a plain POST. An answer without a usable call gives the empty result of its task,
and a transport that fails raises, which the extraction operators keep in the row.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from siltstone.operators import prompts
from siltstone.operators.extraction import system_prompt
from siltstone.operators.tagging import STUDY_STAGES, SUPPLY_CHAIN_LEVELS
from siltstone.sources.config import Settings, tool_choice


def post(url: str, headers: dict, body: dict, timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def called(answer: dict, tool: str) -> dict | None:
    """Arguments of the call of a tool, else of the first call; None without one or if broken."""
    try:
        calls = [c["function"] for c in answer["choices"][0]["message"].get("tool_calls") or ()]
        pick = next((c for c in calls if c["name"] == tool), calls[0] if calls else None)
        found = json.loads(pick["arguments"]) if pick else None
    except (KeyError, IndexError, TypeError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def listing(items: Iterable[str]) -> str:
    return "\n".join(f"- {x}" for x in items)


@dataclass(frozen=True)
class Remote:
    """All extraction methods over one model."""

    settings: Settings
    transport: Callable[[str, dict, dict], dict] = post

    def send(self, task: prompts.Task, question: str, instructions: str | None = None) -> dict:
        """The whole answer."""
        messages = [{"role": "system", "content": instructions or task.instructions}, {"role": "user", "content": question}]
        body = {"model": self.settings.model_name, "messages": messages, "tools": [task.request()], "tool_choice": tool_choice(self.settings, task.tool)}
        return self.transport(self.settings.model_url, {"Authorization": f"Bearer {self.settings.model_key}"}, body)

    def calls(self, task: prompts.Task, question: str, instructions: str | None = None) -> str:
        """The answer's tool calls (name, arguments) as JSON, for :func:`extraction.tool_payload`."""
        message = self.send(task, question, instructions)["choices"][0]["message"]
        return json.dumps([{k: c["function"].get(k) for k in ("name", "arguments")} for c in message.get("tool_calls") or ()])

    def ask(self, task: prompts.Task, question: str, instructions: str | None = None):
        """The task's result, or None."""
        found = called(self.send(task, question, instructions), task.tool)
        return None if found is None else found.get(task.result)

    def _records(self, task: prompts.Task, question: str) -> list[dict]:
        return [r for r in self.ask(task, question) or () if isinstance(r, dict)]

    def concepts(self, text: str, top_n: int) -> list[dict]:
        return self._records(prompts.DISCOVER, f"At most {top_n} concepts.\n\n{text}")

    def values(self, text: str, concepts: list[str]) -> list[dict]:
        return self._records(prompts.POPULATE, f"{text}\n\nConcepts:\n{listing(concepts)}")

    def normalize(self, labels: list[str]) -> list[str]:
        """A vocabulary of the labels; empty if the model gives none."""
        found = self.ask(prompts.NORMALIZE, f"{len(labels)} labels:\n{listing(labels)}") or ()
        return [x.strip().lower() for x in found if isinstance(x, str) and x.strip()]

    def tags(self, concepts: list[str]) -> list[dict]:
        return self._records(prompts.tag_task(STUDY_STAGES, SUPPLY_CHAIN_LEVELS), listing(concepts))

    def record(self, context: str, concepts: list[str]) -> dict:
        found = self.ask(prompts.record_task(concepts), context, system_prompt(concepts))
        return found if isinstance(found, dict) else {}
