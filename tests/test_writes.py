"""What writes: the live overlay, the memory log, packs, the service, embedding jobs, watching."""

import json
import math
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException

from lorewell import service
from lorewell.operators import graph as G
from lorewell.operators import index as I
from lorewell.operators import live as L
from lorewell.operators import memory as M
from lorewell.operators import retrieve as R
from lorewell.operators import semantic as S
from lorewell.options import Expansion, Graph, Options, Ranking, Semantic
from lorewell.sources import files, logs, pack
from lorewell.streaming import watch as W

PLAIN = Expansion(enabled=False)
BASE = [("b", "alpha same", None, "base"), ("shared", "alpha same", None, "base"), ("base-update", "base note", None, "base"), ("remove-me", "obsolete unique", None, "base"), (None, "nameless alpha", None, None)]


def base(spark, rows=BASE):
    return spark.createDataFrame(rows, "doc_id string, text string, heading string, namespace string")


def ids(live, q, **options):
    queries = live.base.sparkSession.createDataFrame([(1, q)], "query_id long, q string")
    return [r["source"] for r in live.query(queries, Options(**{"top_k": 5, "diversify": False, **options})).orderBy("rank").collect()]


def test_live_overlay(spark):
    live = L.Live.over(base(spark), [{"id": "a", "text": "newterm aaabbc"}, {"id": "shared", "text": "alpha same", "namespace": "live"}])
    assert ids(live, "newterm") == ["a"]
    later = live.update({"id": "base-update", "text": "fresh words"}).remove("remove-me")
    assert ids(later, "fresh") == ["base-update"] and ids(later, "obsolete") == []
    assert ids(live, "obsolete") == ["remove-me"]  # the overlay before is as it was
    back = later.add({"id": "remove-me", "text": "back again", "heading": "Title"})
    assert ids(back, "again") == ["remove-me"]
    docs = {r["doc_id"]: r for r in back.docs().collect()}
    assert docs["shared"]["namespace"] == "live" and docs["base-update"]["namespace"] == "base" and docs["remove-me"]["heading"] == "Title"
    placed = [r["doc_id"] for r in back.index().blocks.orderBy("block_id").collect()]
    assert placed == sorted(x for x in placed if x) + [None]


def test_live_refusals(spark):
    live = L.Live.over(base(spark))
    for change in (lambda: live.update({"id": "nobody", "text": "x"}), lambda: live.remove("nobody"), lambda: live.remove("b").update({"id": "b", "text": "x"}), lambda: live.add({"id": " ", "text": "x"}), lambda: live.add({"id": "x", "text": " "}), lambda: live.add({"id": "x", "text": "y", "heading": 3}), lambda: live.add("x")):
        with pytest.raises(L.LiveError):
            change()
    with pytest.raises(L.LiveError):
        L.Live.over(base(spark, BASE + [BASE[0]]))
    with pytest.raises(L.LiveError):
        ids(live, "alpha", semantic=Semantic(enabled=True))
    with pytest.raises(L.LiveError):
        ids(live, "alpha", semantic=Semantic(top_n=7))


def test_live_graph_and_snapshot(spark, tmp_path):
    rows = [("one", "# Engine\nEngine is a thing.\nSee [manual](http://x.y/z).\n[[parts list]]", None, None)]
    assert not L.Live.over(base(spark, rows)).graph and L.Live.over(base(spark, rows), base_graph=True).graph and L.Live.over(base(spark, rows), max_edges=3).graph and not L.Live.over(base(spark, rows), graph=False, base_graph=True).graph
    live = L.Live.over(base(spark, rows), [{"id": "two", "text": "A thing for the parts list."}], graph=True)
    assert ids(live, "engine", expansion=PLAIN) == ["one"]
    assert set(ids(live, "engine", expansion=PLAIN, graph=Graph(expand=True))) == {"one", "two"}  # by way of "a thing"
    live.snapshot(f"{tmp_path}/snap")
    index = I.load(spark, f"{tmp_path}/snap")
    assert index.n == 2 and spark.read.parquet(f"{tmp_path}/snap/graph/edges").count() == live.claims(live.index())[1].count() > 0
    assert G.problems(live.claims(live.index())).count() == 0


def test_graph_problems(spark):
    nodes = spark.createDataFrame([("n1", "a", None), ("n1", "a", None), ("n2", "", None)], "id string, label string, props map<string,string>")
    edges = spark.createDataFrame([("e1", "n1", "is", "n9", [2, 1]), ("e2", "n1", "", "n2", [])], "id string, src string, p string, dst string, evidence array<bigint>")
    assert {(r["kind"], r["id"]) for r in G.problems((nodes, edges)).collect()} == {("repeated node", "n1"), ("unnamed node", "n2"), ("unnamed edge", "e2"), ("loose end", "e1"), ("evidence", "e1")}


def ticking():
    n = [999]

    def now():
        n[0] += 1
        return n[0]

    return now


def test_memory_input(spark):
    rows = spark.createDataFrame([(" Note! ", "  Some text ", ["Alpha", "alpha", "Beta / Gamma", ""], " Project / X ", "A  Source", 1.5, -1.0)], "kind string, text string, labels array<string>, namespace string, source string, importance double, confidence double")
    m = M.normalized(rows, actor=" some  one ", ts=7).first()
    assert (m["kind"], m["text"], m["labels"], m["namespace"], m["source"], m["importance"], m["confidence"], m["ts"], m["actor"]) == ("note", "Some text", ["alpha", "beta.gamma"], "project.x", "a source", 1.0, 0.0, 7, "some one")
    from lorewell.functions.text import fnv64

    assert m["id"] == "mem_" + fnv64("note\x01some text\x017\x01some one")
    assert M.normalized(rows.select("kind", "text")).first()["namespace"] is None
    for bad in ("'' as kind, 'x' as text", "'k' as kind, ' ' as text", "'k' as kind, 'x' as text, double('nan') as importance"):
        with pytest.raises(PySparkException):
            M.normalized(spark.sql(f"select {bad}")).collect()


def test_cortex(spark):
    c = M.Cortex.create(spark, actor=" me ", now=ticking())
    c, written = c.remember(spark.createDataFrame([("note", "first thing", ["a"]), ("task", "second thing", ["b"])], "kind string, text string, labels array<string>"))
    assert c.actor == "me"
    first, second = (r["id"] for r in c.memories().orderBy("kind").collect())
    c, before = c.label(first, ["New / Label"])
    assert before.first()["labels"] == ["a"]
    c = c.link(first, second, "Depends On", confidence=0.5).link(first, second, "Depends On", confidence=0.5)
    now = {r["id"]: r for r in c.memories().collect()}
    assert now[first]["labels"] == ["a", "new.label"]
    assert [(x["relation"], x["to"]) for x in now[first]["links"]] == [("depends on", second)] * 2  # two times, two links
    assert [x["ts"] for x in now[first]["links"]] == sorted(x["ts"] for x in now[first]["links"])
    gone = c.forget(first)
    assert [r["id"] for r in gone.memories().collect()] == [second] and c.memories().count() == 2
    with pytest.raises(M.InvalidMemory):
        c.forget(first, ts=float("nan"))
    docs = M.consolidate(c.memories(), now=2000, prefix="My Memory").collect()
    assert [d["doc_id"] for d in docs] == [d["doc_id"] for d in sorted(docs, key=lambda d: (d["ts"], d["doc_id"]))] and docs[0]["namespace"].startswith("my.memory.")


def test_logs(spark, tmp_path):
    c = M.Cortex.create(spark, now=ticking())
    c, m = c.remember(spark.createDataFrame([("note", "line\nwith \"marks\" ☃", ["a"])], "kind string, text string, labels array<string>"))
    one = c.memories().first()["id"]
    c = c.label(one, ["x"])[0].link(one, "mem_other", "rel", confidence=2.0).forget("mem_none")
    text = logs.document(c.log, "memory")
    assert json.loads(text)["ops"][0]["memory"]["text"] == 'line\nwith "marks" ☃'
    again = logs.from_document(spark, text, "memory")
    assert logs.document(again, "memory") == text
    logs.write(c.log, f"{tmp_path}/log", "memory")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/log").collect()} == {json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in json.loads(text)["ops"]}
    back = M.replay(logs.read(spark, f"{tmp_path}/log", "memory")).first()
    assert back["labels"] == ["a", "x"] and back["links"][0]["confidence"] == 1.0
    g = spark.createDataFrame([("add_edge", None, None, None, "n1", "is", "n2", [2, 1], None, 2, "a"), ("upsert_node", "n1", "Label", {"k": "v"}, None, None, None, None, None, 1, "b"), ("tombstone_edge", None, None, None, None, None, None, None, "e_x", 3, "a")], G.OPS)
    text = logs.document(g, "graph")
    assert [o["ts"] for o in json.loads(text)["ops"]] == [1, 2, 3] and logs.document(logs.from_document(spark, text, "graph"), "graph") == text
    for bad in ("{}", '{"version":2,"ops":[]}', "nothing"):
        with pytest.raises(logs.LogError):
            logs.from_document(spark, bad, "memory")
    with pytest.raises(PySparkException):
        logs.from_document(spark, '{"version":1,"ops":[{"op":"dance","ts":1,"actor":"a"}]}', "memory").collect()


DOCS = [(0, "alpha beta gamma", "Heading", "one", "ns"), (1, "beta delta", None, "two", None), (2, "gamma gamma epsilon", None, None, "ns")]


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, "block_id long, text string, heading string, doc_id string, namespace string")


def test_pack_with_vectors_and_shards(spark, tmp_path):
    index = I.build(documents(spark))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1.0, -1.0])], "block_id long, embedding array<float>")
    for name, raw in (("with", pack.from_index(index, vectors=vectors, model_id="m")), ("without", pack.from_index(index))):
        (tmp_path / f"{name}.pack").write_bytes(raw)
    assert pack.has_vectors(spark, f"{tmp_path}/with.pack") and not pack.has_vectors(spark, f"{tmp_path}/without.pack")
    rows = {r["block_id"]: (r["q"], r["scale"]) for r in pack.read(spark, f"{tmp_path}/with.pack", "vectors").collect()}
    assert rows == {r["block_id"]: (r["q"], r["scale"]) for r in S.quantized(vectors).collect()}
    for bad in (vectors.limit(2), vectors.where("block_id < 2").unionByName(spark.createDataFrame([(2, [1.0])], vectors.schema))):
        with pytest.raises(pack.InvalidPack):
            pack.from_index(index, vectors=bad)
    pack.write_shards(pack.shards(documents(spark), 2), f"file://{tmp_path}/shards")
    whole, parts = service.mount(spark, f"{tmp_path}/without.pack"), service.mount(spark, f"{tmp_path}/shards")
    for a, b in ((whole, parts), (parts, index)):
        assert a.n == b.n == 3 and a.avg_len == pytest.approx(b.avg_len)
        assert sorted((r["term"], r["block_id"], r["tf"], r["positions"]) for r in a.postings.collect()) == sorted((r["term"], r["block_id"], r["tf"], r["positions"]) for r in b.postings.collect())
    pack.register(spark)
    assert spark.read.format("pack").option("table", "blocks").load(f"{tmp_path}/shards").count() == 3


def test_service(spark, tmp_path):
    I.save(I.build(documents(spark)), f"{tmp_path}/index")
    s = service.Service.restored(spark, f"{tmp_path}/state.json")
    q = spark.createDataFrame([(1, "gamma"), (2, " "), (3, None)], "query_id long, q string")
    assert not s.health()["ok"] and not s.info()["loaded"] and s.search(q, 5).count() == 0
    assert not s.set_pack(f"{tmp_path}/nothing")["ok"] and s.index is None
    assert s.set_pack(f"{tmp_path}/index", " docs ")["ok"] and s.health() == {"ok": True, "message": "ready: docs"}
    assert s.info() == {"loaded": True, "label": "docs", "version": 3, "docs": 3, "blocks": 3, "terms": 5}
    assert [r["block_id"] for r in s.search(q, 1000).orderBy("rank").collect()] == [2, 0] and s.search(q, 1).count() == 1 and s.search(q, 0).count() == 0
    assert not s.set_pack(f"{tmp_path}/nothing")["ok"] and s.health()["ok"]  # what was there stays
    again = service.Service.restored(spark, f"{tmp_path}/state.json")
    assert again.info() == s.info()
    assert s.clear_pack()["ok"] and not service.Service.restored(spark, f"{tmp_path}/state.json").health()["ok"]
    r = service.Retriever(spark, f"{tmp_path}/index", top_k=2)
    hits = r.relevant_documents("gamma")
    assert [h["metadata"]["id"] for h in hits] == [2, 0] and hits[1]["metadata"]["source"] == "one" and r.mounted is r.mounted
    with pytest.raises(ValueError):
        service.Retriever(spark).relevant_documents("x")


def test_printed_hits(spark):
    index = I.build(documents(spark))
    q = spark.createDataFrame([(1, "gamma"), (2, "zzz")], "query_id long, q string")
    hits = R.retrieve(index, q, Options(top_k=3, expansion=PLAIN))
    out = {r["query_id"]: json.loads(r["json"]) for r in R.hit_json(hits, q, 3).collect()}
    assert [h["source"] for h in out[1]["hits"]] == ["unknown", "one"] and out[1]["topK"] == 3 and len(out[1]["contextPatch"]["snippets"]) == 2
    assert out[2]["question"] == "zzz" and "hits" not in out[2]


def test_ranking_options(spark):
    index = I.build(documents(spark))
    q = spark.createDataFrame([(1, "alpha gamma")], "query_id long, q string")

    def score(**ranking):
        hits = R.lexical(index, q, Options(top_k=3, expansion=PLAIN, ranking=Ranking(**ranking)))
        return {r["block_id"]: r["score"] for r in hits.collect()}

    plain, flat = score(), score(proximity_weight=0.0)
    assert plain[0] == pytest.approx(flat[0] * (1 + 0.15 / 3))
    assert score(proximity=lambda span: 1.0 + 0.1 * (span < 3).cast("double"))[0] == pytest.approx(flat[0] * 1.1)
    assert score(k1=0.0, b=0.0, proximity_weight=0.0)[2] == pytest.approx(math.log(1 + (3 - 2 + 0.5) / 2.5))
    with pytest.raises(ValueError):
        Ranking(b=2.0)


class Embedder:
    model_id = "m"

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding_job(spark, tmp_path):
    index = I.build(documents(spark))
    head = S.embed_blocks(index.blocks, Embedder(), f"{tmp_path}/v", "fp", "2026-01-01T00:00:00.000Z")
    assert head["dimension"] == 2 and S.inspect(spark, f"{tmp_path}/v") == head and head["blocks"] == 3
    S.compatible(Embedder(), head)
    for changed in ({"modelId": "other"}, {"dimension": 3}):
        with pytest.raises(S.SemanticError):
            S.compatible(Embedder(), head | changed)
    (tmp_path / "side.json").write_text(S.sidecar_json("fp", "m", 2, [(0, [1.0, 0.0])], "now"))
    assert S.inspect(spark, f"{tmp_path}/side.json")["blocks"] == 1
    assert S.pack_fingerprint(3, [("a", "x"), (None, "\U00010400")]).startswith("fnv1a-")
    h = 2166136261
    for unit in [ord(c) for c in "3ax"] + [0xD801, 0xDC00]:
        h = (h ^ unit) * 16777619 % 2**32
    assert S.pack_fingerprint(3, [("a", "x"), (None, "\U00010400")]) == f"fnv1a-{h:08x}"


def test_http_provider():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
            self.send_response(500 if asked["prompt"] == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [] if asked["prompt"] == "none" else [1.0, float(len(asked["prompt"]))]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = S.HttpProvider("m", f"http://127.0.0.1:{server.server_port}", timeout=5)
    assert provider.embed(["a", "bcd"]) == [[1.0, 1.0], [1.0, 3.0]]
    for bad in ("bad", "none"):
        with pytest.raises(S.SemanticError):
            provider.embed([bad])
    server.shutdown()
    with pytest.raises(S.SemanticError):
        S.HttpProvider("m", "http://127.0.0.1:9", timeout=1).embed(["a"])


def test_project_build(spark, tmp_path):
    for name, text in (("docs/b.md", "# Bee\nbeta *words*"), ("docs/a.txt", "alpha words"), ("docs/x.png", "no"), ("more/c.md", "gamma"), ("docs/node_modules/z.md", "skipped")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "c.json").write_text(json.dumps({"sources": [{"name": "one", "path": "docs"}, {"name": "two", "path": "more"}], "output": {"path": "out/index"}}))
    out = files.build_project(spark, f"{tmp_path}/c.json")
    index = I.load(spark, out["path"])
    assert out["blocks"] == 3 and [(r["doc_id"], r["namespace"]) for r in index.blocks.orderBy("block_id").collect()] == [("a.txt", "one"), ("b.md", "one"), ("c.md", "two")]
    (tmp_path / "docs/blank.md").write_text("  ")
    with pytest.raises(PySparkException):
        files.build_project(spark, f"{tmp_path}/c.json")
    with pytest.raises(I.InvalidCorpus):
        I.build(spark.createDataFrame([(1, 2)], "block_id long, text long"))
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "block_id long, embedding array<float>")
    assert files.checked_embeddings(v, 2) is v
    for bad, n in ((v, 3), (v.unionByName(spark.createDataFrame([(2, [1.0, 2.0])], v.schema)), 3), (spark.createDataFrame([(0, [float("nan")])], v.schema), 1)):
        with pytest.raises(files.SourceError):
            files.checked_embeddings(bad, n)


def test_watching(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b.md").write_text("two")
    before = spark.createDataFrame(W.listing(spark, str(tmp_path)).collect())
    (tmp_path / "a.md").write_text("longer")
    (tmp_path / "b.md").unlink()
    (tmp_path / "c.md").write_text("new")
    found = {(r["path"].rsplit("/", 1)[-1], r["change"]) for r in W.changes(before, W.listing(spark, str(tmp_path))).collect()}
    assert found == {("a.md", "changed"), ("b.md", "removed"), ("c.md", "added")}
    states = iter([frozenset({1}), frozenset({1}), frozenset({2}), frozenset({3})] + [frozenset({3})] * 20)
    assert W.watch(lambda: next(states), lambda: None, rounds=12, pause=0.02, quiet=0.1) == 1  # a burst, one build


def test_mutations_in_order():
    m = W.Mutations(0)
    done = [m.submit(lambda s, i=i: (time.sleep(0.01), s * 10 + i)[1] if i != 2 else 1 / 0) for i in range(1, 5)]
    with pytest.raises(ZeroDivisionError):
        done[1].result(5)
    assert done[3].result(5) == 134 == m.state
    m.close()
