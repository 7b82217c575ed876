"""Agents, routing profiles, tool policy, tool calls and traces.

Registries are small and checked on the driver; policy, routing and profile lists
are Column expressions for batches of decisions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options

SLUG = re.compile(r"^[a-z0-9]+(?:[._-][a-z0-9]+)*$")


class AgentError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise AgentError(what)


@dataclass(frozen=True)
class ToolPolicy:
    mode: str
    tools: tuple[str, ...]

    def __post_init__(self) -> None:
        _need(self.mode in ("allow", "deny"), 'tool policy mode must be "allow" or "deny"')
        _need(all(isinstance(t, str) and t.strip() for t in self.tools), "tools must be names")
        _need(len(set(self.tools)) == len(self.tools), "tools must be unique")

    def allows(self, tool: str) -> bool:
        return (tool in self.tools) == (self.mode == "allow")


@dataclass(frozen=True)
class Agent:
    id: str
    version: int = 1
    system_prompt: tuple[str, ...] | dict = ()
    namespace: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)
    tools: ToolPolicy | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        _need(isinstance(self.id, str) and bool(SLUG.match(self.id)), f"agent id must be a slug: {self.id!r}")
        _need(self.version == 1, "agent version must be 1")
        if isinstance(self.system_prompt, dict):
            _need(isinstance(self.system_prompt.get("template"), str), "a prompt template must be text")
        else:
            _need(bool(self.system_prompt) and all(isinstance(x, str) for x in self.system_prompt), "a system prompt needs lines")
        _need(bool(self.namespace) and all(isinstance(x, str) and x.strip() for x in self.namespace), "an agent needs a namespace")

    def prompt(self, **values: str) -> str:
        """Lines joined, or the template with its ``{{key}}`` places filled."""
        if not isinstance(self.system_prompt, dict):
            return "\n".join(self.system_prompt)

        def fill(m: re.Match) -> str:
            _need(m[1] in values, f"prompt value missing: {m[1]}")
            return str(values[m[1]])

        return re.sub(r"\{\{\s*([\w.-]+)\s*\}\}", fill, self.system_prompt["template"])

    def resolve(self, **overrides: Any) -> Options:
        """Caller's options over the agent's defaults; the namespace is the agent's, whatever the caller says."""
        overrides.pop("namespace", None)
        return Options().merged(**{**self.defaults, **overrides, "namespace": self.namespace})

    def allows(self, tool: str) -> bool:
        return self.tools is None or self.tools.allows(tool)

    def require(self, tool: str) -> None:
        _need(self.allows(tool), f"agent {self.id} may not use {tool}")


class Registry:
    def __init__(self, agents: list[Agent]):
        ids = [a.id for a in agents]
        _need(len(set(ids)) == len(ids), f"duplicate agent ids: {sorted({i for i in ids if ids.count(i) > 1})}")
        self.agents = {a.id: a for a in sorted(agents, key=lambda a: a.id)}

    def list(self) -> list[str]:
        return list(self.agents)

    def get(self, agent_id: str) -> Agent | None:
        return self.agents.get(agent_id)


def profile(agent: Agent) -> dict:
    """What a router sees of an agent."""
    lists = {k: plain_list(agent.metadata.get(k, "")) for k in ("tags", "examples", "capabilities")}
    heading = agent.metadata.get("heading") or agent.metadata.get("title") or agent.id
    return {"agent_id": agent.id, "namespace": list(agent.namespace), "heading": heading, "description": agent.metadata.get("description", ""), **lists}


def plain_list(value: str | list) -> list[str]:
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                value = json.loads(text)
            except ValueError:
                value = []
        else:
            value = text.split("\n" if "\n" in text else ",")
    out = [v.strip() for v in value if isinstance(v, str) and v.strip()]
    return list(dict.fromkeys(out))[:20]


def tool_allowed(mode: Column, tools: Column, tool: Column) -> Column:
    """Batch form of ``ToolPolicy.allows``; no policy allows everything."""
    return F.when(mode.isNull(), True).otherwise(F.array_contains(tools, tool) == (mode == "allow"))


def selected(decisions: DataFrame, registry: DataFrame, fallback: str | None = None) -> DataFrame:
    """(decision_id, agent_id) for ``decisions(decision_id, selected, candidates array<struct<agent_id,score>>)``.

    The selected agent if registered, else the best registered candidate (score,
    then id), else the fallback if registered, else the first id, else ''.
    """
    ids = registry.select("agent_id").distinct()
    each = decisions.select("decision_id", F.explode("candidates").alias("c")).select("decision_id", F.col("c.agent_id").alias("agent_id"), F.col("c.score").alias("score"))
    best = each.join(ids, "agent_id", "left_semi").groupBy("decision_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "agent_id"))["agent_id"].alias("best"))
    chosen = decisions.select("decision_id", "selected").join(ids.select(F.col("agent_id").alias("selected"), F.lit(True).alias("known")), "selected", "left")
    last = ids.agg(F.min("agent_id").alias("first"), F.max(F.when(F.col("agent_id") == F.lit(fallback), F.col("agent_id"))).alias("fallback"))
    out = chosen.join(best, "decision_id", "left").crossJoin(last)
    return out.select("decision_id", F.coalesce(F.when(F.col("known"), F.col("selected")), "best", "fallback", "first", F.lit("")).alias("agent_id"))


def repeated_candidates(decisions: DataFrame) -> DataFrame:
    """(decision_id, agent_id) of candidates that a decision names more than once."""
    each = decisions.select("decision_id", F.explode("candidates.agent_id").alias("agent_id"))
    return each.groupBy("decision_id", "agent_id").count().where("count > 1").select("decision_id", "agent_id")


def profile_lists(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, T.listed(F.col(column)))


def is_tool_call(x: Any) -> bool:
    return isinstance(x, dict) and x.get("type") == "tool_call" and all(isinstance(x.get(k), str) and x[k] for k in ("callId", "tool")) and isinstance(x.get("args"), dict)


def is_tool_result(x: Any) -> bool:
    if not (isinstance(x, dict) and x.get("type") == "tool_result" and isinstance(x.get("ok"), bool) and all(isinstance(x.get(k), str) and x[k] for k in ("callId", "tool"))):
        return False
    return "output" in x if x["ok"] else isinstance(x.get("error"), dict)


def is_route_decision(x: Any) -> bool:
    return (
        isinstance(x, dict)
        and x.get("type") == "route_decision"
        and isinstance(x.get("candidates"), list)
        and all(isinstance(c, dict) and isinstance(c.get("agentId"), str) and isinstance(c.get("score"), (int, float)) for c in x["candidates"])
    )


def parse_tool_call(text: str) -> dict | None:
    """A tool call in a model's answer: the whole text, a fenced block, a ``TOOL_CALL:`` line or the first balanced object."""

    def load(s: str) -> dict | None:
        try:
            x = json.loads(s)
        except ValueError:
            return None
        return x if is_tool_call(x) else None

    tries = [text.strip(), *re.findall(r"```(?:json)?\s*\n?(.*?)```", text, re.S), *re.findall(r"^\s*TOOL_CALL:\s*(\{.*\})\s*$", text, re.M)]
    decoder = json.JSONDecoder()
    for s in tries:
        if found := load(s.strip()):
            return found
    at = text.find("{")
    while at >= 0:
        try:
            x, end = decoder.raw_decode(text, at)
            return x if is_tool_call(x) else None
        except ValueError:
            at = text.find("{", at + 1)
    return None


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class Trace:
    KINDS = ("route.requested", "route.decided", "agent.selected", "prompt.resolved", "tool.requested", "tool.executed", "run.completed")

    def __init__(self, clock=now_iso):
        self.clock, self.events = clock, []

    def add(self, kind: str, **values: Any) -> None:
        _need(kind in self.KINDS, f"unknown trace event: {kind}")
        self.events.append({"type": kind, "ts": self.clock(), **values})

    def frame(self, spark) -> DataFrame:
        rows = [(i, e["type"], e["ts"], json.dumps({k: v for k, v in e.items() if k not in ("type", "ts")}, sort_keys=True)) for i, e in enumerate(self.events)]
        return spark.createDataFrame(rows, "n long, type string, ts string, payload string")
