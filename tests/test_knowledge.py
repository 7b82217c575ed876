import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import agents as A
from lorewell.operators import graph as G
from lorewell.operators import live as L
from lorewell.operators import memory as M
from lorewell.operators import retrieve as R
from lorewell.operators import semantic as S
from lorewell.options import Expansion, Graph, Options

ALPHA = "# Overlay\nOverlay is a deterministic knowledge graph layer.\nSee [Spec](https://example.com/spec).\n[[Delta Log]]"
BETA = "Delta Log is append only.\n# Determinism\nDeterminism is reproducible behavior."


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame([(0, "doc-alpha", "", ALPHA), (1, "doc-beta", "", BETA)], "doc_ord long, doc_id string, heading string, text string")
    nodes, edges = G.build(docs)
    return nodes.persist(), edges.persist()


def named(graph):
    label = {r["id"]: r["label"] for r in graph[0].collect()}
    return {(label[r["src"]], r["p"], label[r["dst"]]) for r in graph[1].collect()}


def test_triples(graph):
    found = named(graph)
    assert ("spec", "ref", "https example com spec") in {(a, p, T.plain_normalize(b)) for a, p, b in found}
    assert ("doc-alpha", "mentions", "delta log") in found
    assert ("delta log", "is", "append only") in found
    assert ("overlay", "defined_as", "overlay is a deterministic knowledge graph layer") in found
    assert ("determinism", "defined_as", "determinism is reproducible behavior") in found
    assert all(a not in ("it", "this") for a, _, _ in found)


def test_ids(graph):
    for r in graph[1].collect():
        assert r["id"].startswith("e_") and len(r["id"]) == 10
    out, into = G.adjacency(graph[1])
    assert sum(len(r["edges"]) for r in out.collect()) == sum(len(r["edges"]) for r in into.collect()) == graph[1].count()


def log(spark, ops):
    names = [c.split()[0] for c in G.OPS.split(", ")]
    return spark.createDataFrame([tuple(o.get(n) for n in names) for o in ops], G.OPS)


def add(ts, actor="a", src="x", dst="y", evidence=None):
    return {"op": "add_edge", "src": src, "p": "is", "dst": dst, "evidence": evidence or [], "ts": ts, "actor": actor}


def test_replay_is_free_of_order(spark):
    e = G.edge_id(F.lit("x"), F.lit("is"), F.lit("y"), F.array().cast("array<bigint>"))
    edge = spark.range(1).select(e.alias("e")).first()["e"]
    tomb = lambda ts, actor="a": {"op": "tombstone_edge", "edge_id": edge, "ts": ts, "actor": actor}
    up = lambda ts, label: {"op": "upsert_node", "id": "x", "label": label, "ts": ts, "actor": "a"}
    for ops, alive in (([add(1), tomb(2)], False), ([add(2), tomb(1)], True), ([add(1), tomb(1)], True), ([add(1), tomb(1, "b")], False), ([add(1), tomb(2), add(3)], True)):
        for order in itertools.permutations(ops + [up(1, "Old"), up(5, "Shared Memory")]):
            if order[0] is not ops[0] and order[-1] is not ops[0]:
                continue
            nodes, edges = G.replay(log(spark, order))
            assert (edges.count() == 1) is alive
            assert {r["id"]: r["label"] for r in nodes.collect()}["x"] == "shared memory"
            break
    nodes, edges = G.replay(log(spark, [add(1)]))
    assert {r["label"] for r in nodes.collect()} == {"x", "y"}


def test_replay_over_a_base(spark, graph):
    one = graph[1].first()
    nodes, edges = G.replay(log(spark, [{"op": "tombstone_edge", "edge_id": one["id"], "ts": 1, "actor": "a"}]), *graph)
    assert edges.count() == graph[1].count() - 1 and edges.where(F.col("id") == one["id"]).count() == 0
    assert nodes.count() == graph[0].count()
    assert G.merge_logs(log(spark, [add(1)]), log(spark, [add(1)])).count() == 2


def expanded(graph, query, limit, predicates):
    """The rule, one query at a time."""
    nodes = {r["id"]: r["label"] for r in graph[0].collect()}
    edges = sorted((r["src"], r["id"], r["p"], r["dst"]) for r in graph[1].collect())
    tokens = T.plain_normalize(query).split()
    labels = sorted((v, k) for k, v in nodes.items())
    found = {i for v, i in labels if v in tokens}
    for t in sorted(tokens):
        for v, i in labels:
            if len(found) < limit * 4 and v.startswith(t):
                found.add(i)
    extra = []
    for src, _, p, dst in edges:
        if src in found and p in predicates:
            extra += [w for w in T.plain_normalize(nodes[dst]).split() if w not in tokens and w not in extra]
    return " ".join([query, *sorted(extra[:limit])])


def test_expansion(spark, graph):
    for limit in (3, 12):
        for q in ("overlay", "det delta", "spec", "none"):
            o = Graph(expand=True, max_extra_terms=limit)
            got = G.expand_queries(graph, spark.createDataFrame([(0, q)], "query_id long, q string"), o).first()["q"]
            assert got == expanded(graph, q, limit, o.predicates)


BASE = [("b", "alpha same"), ("shared", "alpha same"), ("base-update", "base note"), ("remove-me", "obsolete unique")]


def overlay(spark, ops, base=BASE):
    b = spark.createDataFrame([(i, t, None, "base") for i, t in base], "doc_id string, text string, heading string, namespace string")
    rows = [(n, op, i, t, None, ns) for n, (op, i, t, ns) in enumerate(ops)]
    return b, spark.createDataFrame(rows, L.OPS)


def state(base, ops):
    return {r["doc_id"]: (r["text"], r["namespace"]) for r in L.merged(base, ops).collect()}


def test_overlay(spark):
    ops = [("add", "a", "newterm", "live"), ("add", "shared", "alpha other", "live"), ("update", "base-update", None, "moved"), ("remove", "remove-me", None, None), ("remove", "b", None, None), ("add", "b", "back again", None), ("update", "a", "newer", None)]
    got = state(*overlay(spark, ops))
    assert got == {"a": ("newer", "live"), "shared": ("alpha other", "live"), "base-update": ("base note", "moved"), "b": ("back again", None)}
    ix = L.live_index(*overlay(spark, ops))
    hits = R.retrieve(ix, spark.createDataFrame([(0, "alpha newer")], "query_id long, q string"), Options(expansion=Expansion(enabled=False)))
    assert {r["source"] for r in hits.collect()} == {"a", "shared"}


def test_overlay_errors(spark):
    base, ops = overlay(spark, [("update", "nope", "x", None), ("remove", "b", None, None), ("remove", "b", None, None)])
    assert {(r["seq"], r["doc_id"]) for r in L.unknown(base, ops).collect()} == {(0, "nope"), (2, "b")}
    assert L.duplicates(overlay(spark, [], BASE + [("b", "again")])[0]).collect()[0]["doc_id"] == "b"


def test_overlay_against_a_plain_map(spark):
    rng = random.Random(3)
    for _ in range(3):
        now = dict((i, (t, "base")) for i, t in BASE)
        ops = []
        for n in range(25):
            i = rng.choice(["a", "b", "c", "shared"])
            if i in now and rng.random() < 0.6:
                if rng.random() < 0.5:
                    ops.append(("remove", i, None, None))
                    del now[i]
                else:
                    t, ns = rng.choice([(f"t{n}", None), (None, f"n{n}")])
                    ops.append(("update", i, t, ns))
                    now[i] = (t or now[i][0], ns or now[i][1])
            else:
                ops.append(("add", i, f"t{n}", None))
                now[i] = (f"t{n}", None)
        assert state(*overlay(spark, ops)) == now


MEMORY = [c.split()[0].strip("`") for c in M.OPS.split(", ")]


def memory(spark, ops):
    return M.replay(spark.createDataFrame([tuple(o.get(n) for n in MEMORY) for o in ops], M.OPS))


def said(i, ts, text="text", labels=(), **k):
    return {"op": "remember", "ts": ts, "actor": "a", "id": i, "kind": "note", "text": text, "labels": [*labels], **k}


def test_memory_replay(spark):
    label = lambda i, ts, *ls: {"op": "label", "ts": ts, "actor": "a", "id": i, "labels": [*ls]}
    link = lambda i, ts, to: {"op": "link", "ts": ts, "actor": "a", "id": i, "to": to, "relation": "follows"}
    forget = lambda i, ts: {"op": "forget", "ts": ts, "actor": "a", "id": i}
    ops = [said("m1", 5, labels=["x"]), label("m1", 6, "y"), label("m1", 2, "early"), link("m1", 7, "m2"), said("m2", 3), forget("m3", 1), said("m3", 9), said("m4", 1, "old", ["gone"]), label("m4", 2, "gone.too"), said("m4", 8, "new", ["kept"])]
    for order in (ops, ops[::-1]):
        got = {r["id"]: r for r in memory(spark, order).collect()}
        assert set(got) == {"m1", "m2", "m4"}
        assert got["m1"]["labels"] == ["early", "x", "y"] and [x["to"] for x in got["m1"]["links"]] == ["m2"]
        assert got["m4"]["text"] == "new" and got["m4"]["labels"] == ["kept"]


def test_recall(spark):
    ops = [said("a", 1, "alpha plan", ["project.alpha"], importance=0.2, namespace="team.x"), said("b", 2, "alpha beta", ["project.beta"], importance=0.9), said("c", 3, "gamma", ["misc"], importance=None)]
    m = memory(spark, ops).persist()
    ids = lambda *a, **k: [r["id"] for r in M.recall(m, *a, **k).collect()]
    assert ids("alpha plan")[0] == "a" and set(ids("alpha")) == {"a", "b"}
    assert ids("") == [] and ids("", labels=["project"]) == ["b", "a"]
    assert ids("alpha", min_importance=0.5) == ["b"] and ids("", min_importance=0.5) == ["c", "b"]
    assert ids("", namespaces=["team"]) == ["a"] and ids("", since=2, until=2) == ["b"] and ids("", since=1, top_k=0) == ["c", "b", "a"]
    doc = M.consolidate(m, now=10, labels=["project.alpha"]).first()
    assert (doc["heading"], doc["namespace"], doc["text"]) == ("note: project.alpha", "memory.note", "alpha plan")


def test_memory_to_graph(spark):
    ops = [said("m1", 1, labels=["x.y"]), {"op": "link", "ts": 2, "actor": "a", "id": "m1", "to": "m2", "relation": "cites"}]
    out = M.claim_ops(memory(spark, ops)).collect()
    assert sum(r["op"] == "upsert_node" for r in out) == 3 and {r["p"] for r in out if r["op"] == "add_edge"} == {"mentions", "cites"}


def test_agents():
    policy = A.ToolPolicy("allow", ("search",))
    agent = A.Agent("support.bot", system_prompt={"template": "Hello {{name}}"}, namespace=("mobile",), defaults={"top_k": 3}, tools=policy, metadata={"tags": "a, b,a"})
    assert agent.prompt(name="X") == "Hello X" and agent.resolve(top_k=7, namespace=("other",)).namespace == ("mobile",)
    assert agent.resolve().top_k == 3 and agent.resolve(top_k=7).top_k == 7
    assert agent.allows("search") and not agent.allows("delete") and A.profile(agent)["tags"] == ["a", "b"]
    for bad in (lambda: A.Agent("Bad Id", system_prompt=("x",), namespace=("n",)), lambda: A.Agent("a", system_prompt=("x",)), lambda: A.ToolPolicy("x", ()), lambda: A.ToolPolicy("deny", ("a", "a")), lambda: agent.prompt(), lambda: agent.require("delete"), lambda: A.Registry([agent, agent])):
        with pytest.raises(A.AgentError):
            bad()
    assert A.Registry([agent]).list() == ["support.bot"] and A.Registry([]).get("x") is None


CALL = {"type": "tool_call", "callId": "1", "tool": "search", "args": {"q": "x"}}


@pytest.mark.parametrize("text", [json.dumps(CALL), f"Sure:\n```json\n{json.dumps(CALL)}\n```", f"TOOL_CALL: {json.dumps(CALL)}", f"so {json.dumps(CALL)} done"])
def test_tool_calls(text):
    assert A.parse_tool_call(text) == CALL


def test_tool_shapes():
    assert A.parse_tool_call("nothing {here}") is None and A.parse_tool_call('{"type": "tool_call"}') is None
    assert A.is_tool_result({"type": "tool_result", "callId": "1", "tool": "t", "ok": True, "output": 1}) and not A.is_tool_result({"type": "tool_result", "ok": True})
    assert A.is_route_decision({"type": "route_decision", "candidates": [{"agentId": "a", "score": 1}]}) and not A.is_route_decision({"candidates": []})


def test_routing_and_trace(spark):
    d = spark.createDataFrame([(1, "a", [("b", 0.9)]), (2, "zz", [("b", 0.5), ("c", 0.5)]), (3, None, []), (4, "q", [("q", 1.0)])], "decision_id int, selected string, candidates array<struct<agent_id:string,score:double>>")
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "agent_id string")
    got = {x[0]: x[1] for x in A.selected(d, r, "c").collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: "c"}
    assert {x[0]: x[1] for x in A.selected(d, r).collect()}[4] == "a"
    trace = A.Trace(lambda: "2026-01-01T00:00:00.000Z")
    trace.add("tool.requested", tool="search")
    assert trace.frame(spark).first()["payload"] == '{"tool": "search"}'
    with pytest.raises(A.AgentError):
        trace.add("other")


def test_sidecar(spark, tmp_path):
    blocks = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "block_id long, doc_id string, text string")
    mark = S.fingerprint(blocks).first()["fingerprint"]
    assert mark == S.fingerprint(blocks.repartition(3)).first()["fingerprint"]
    assert mark != S.fingerprint(blocks.withColumn("text", F.lit("z"))).first()["fingerprint"]
    raw = S.sidecar_json(mark, "m", 2, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "2026-01-01T00:00:00Z")
    (tmp_path / "s.json").write_text(raw)
    import base64

    for form in (raw, str(tmp_path / "s.json"), "data:application/json;base64," + base64.b64encode(raw.encode()).decode()):
        S.check_sidecar(S.parse_sidecar(form), mark, 2, "m")
    for bad in ((mark + "x", 2, "m"), (mark, 3, "m"), (mark, 2, "other")):
        with pytest.raises(S.SemanticError):
            S.check_sidecar(json.loads(raw), *bad)
    with pytest.raises(S.SemanticError):
        S.parse_sidecar('{"version": 2}')


class Lengths:
    model_id = "lengths"

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_provider(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    assert [r["embedding"] for r in S.embed(df, Lengths(), 1).orderBy("text").collect()] == [[2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(Exception, match="another dimension"):
        S.checked(S.embed(df, Lengths()), 3).collect()
