import json
import struct

import pytest
from pyspark.sql import functions as F

from lorewell.operators import graph as G
from lorewell.operators import index as I
from lorewell.operators import memory as M
from lorewell.sources import files, pack
from lorewell.streaming import ingest, replay


def raw(version=3, blocks=None, tail=b""):
    def section(x):
        b = json.dumps(x).encode()
        return struct.pack("<I", len(b)) + b

    numbers = [1, 1, 1, 0, 0, 2, 1, 2, 0, 2, 1, 0, 0, 3, 1, 3, 0, 0, 4, 2, 2, 0, 0]
    meta = {"version": version, "stats": {"docs": 2, "blocks": 2, "terms": 4, "avgBlockLen": 2.5}}
    blocks = blocks or [{"text": "alpha beta gamma", "namespace": "docs", "len": 3}, {"text": "beta delta", "namespace": "guides", "docId": "g", "len": 2}]
    return section(meta) + section([["alpha", 1], ["beta", 2], ["gamma", 3], ["delta", 4]]) + struct.pack("<I", len(numbers)) + struct.pack(f"<{len(numbers)}I", *numbers) + section(blocks) + tail


def test_decode():
    t = pack.decode(raw())
    assert t["meta"] == [(3, 2, 2, 4, 2.5)]
    assert {(term, block): pos for term, _, block, _, pos in t["postings"]} == {("alpha", 0): [0], ("beta", 0): [1], ("beta", 1): [0], ("gamma", 0): [2], ("delta", 1): [1]}
    assert [b[4] for b in t["blocks"]] == ["docs", "guides"]


def test_legacy_blocks_and_tails():
    assert pack.decode(raw(1, ["legacy text"]))["blocks"] == [(0, "legacy text", None, None, None, None)]
    assert len(pack.decode(raw(tail=bytes([1, 2, 3, 4, 5, 6])))["blocks"]) == 2


@pytest.mark.parametrize("data", [b"xx", b"\x05\x00\x00\x00notjs", raw()[:40], struct.pack("<I", 2) + b"{}" + raw()[100:]])
def test_invalid(data):
    with pytest.raises(pack.InvalidPack):
        pack.decode(data, "strict")


def test_round_trip_through_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "alpha beta [Link](http://x)", "a", "ns"), (1, "Beta is a letter. Gamma", "b", None)], "block_id long, text string, doc_id string, namespace string")
    ix = I.build(docs, persist=True)
    graph = G.build(docs.select(F.col("block_id").alias("doc_ord"), "doc_id", F.lit("").alias("heading"), "text"))
    (tmp_path / "x.pack").write_bytes(pack.from_index(ix, graph))
    pack.register(spark)
    for read in (lambda t: pack.read(spark, str(tmp_path / "x.pack"), t, "strict"), lambda t: spark.read.format("pack").option("table", t).load(str(tmp_path / "x.pack"))):
        assert {(r["term"], r["block_id"], tuple(r["positions"])) for r in read("postings").collect()} == {(r["term"], r["block_id"], tuple(r["positions"])) for r in ix.postings.collect()}
        assert [r["text"] for r in read("blocks").orderBy("block_id").collect()] == [r["text"] for r in ix.blocks.orderBy("block_id").collect()]
        assert read("nodes").count() == graph[0].count() and read("edges").count() == graph[1].count()
        assert read("meta").first()["blocks"] == 2


def test_vectors_in_packs():
    data = pack.encode({"version": 3, "stats": {}}, [], [], ["x", "y"], ("m", [([127, 0], 1 / 127), ([-127, -127], 0.0055)]))
    rows = pack.decode(data)["vectors"]
    assert [r[1] for r in rows] == [[127, 0], [-127, -127]] and rows[0][2] == pytest.approx(1 / 127, rel=1e-3)


def test_walk(spark, tmp_path):
    for name, text in {"b.md": "# Bee\nbody", "sub/a.txt": "plain", "c.py": "code", "node_modules/x.md": "skip", "sub/d.json": "[]"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    rows = {r["doc_id"]: r for r in files.collected(spark, [{"name": "one", "path": str(tmp_path)}]).collect()}
    assert set(rows) == {"b.md", "sub/a.txt", "sub/d.json"} and rows["sub/a.txt"]["heading"] == "a.txt" and rows["b.md"]["namespace"] == "one"
    md = files.parsed_markdown(files.walk(spark, str(tmp_path / "b.md"))).first()
    assert (md["heading"], md["text"]) == ("Bee", "body")
    with pytest.raises(files.SourceError):
        files.walk(spark, str(tmp_path / "c.py"))


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "text": "x"}, {"text": "y", "namespace": "n"}]))
    assert {(r["doc_id"], r["text"], r["namespace"]) for r in files.json_documents(spark, str(tmp_path / "d.json")).collect()} == {("a", "x", None), (None, "y", "n")}
    for body in ([[1, 2], [3, 4]], {"embeddings": [[1, 2], [3, 4]]}):
        (tmp_path / "e.json").write_text(json.dumps(body))
        assert [r["embedding"] for r in files.json_embeddings(spark, str(tmp_path / "e.json")).orderBy("block_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_config_and_agents(tmp_path):
    (tmp_path / "c.json").write_text('{"sources": [{"name": "a", "path": "x"}, {"name": "a", "path": "y"}]}')
    with pytest.raises(files.SourceError):
        files.config(str(tmp_path / "c.json"))
    (tmp_path / "agent.yaml").write_text("# note\nid: bot\nversion: 1\nsystemPrompt: |\n  Line one\n  Line two\nretrieval:\n  namespace: [mobile, \"web\"]\n  topK: 5\ntools:\n  - name: search\n    safe: true\n  - name: open\nratio: 0.5\n")
    found = files.simple_yaml((tmp_path / "agent.yaml").read_text())
    assert found["systemPrompt"] == "Line one\nLine two\n" and found["retrieval"] == {"namespace": ["mobile", "web"], "topK": 5}
    assert found["tools"] == [{"name": "search", "safe": True}, {"name": "open"}] and found["ratio"] == 0.5


def test_stream_replay_equals_batch(spark, data, tmp_path):
    from lorewell.plans import knowledge

    ops = knowledge.memory_ops(spark, data)
    extra = ops.where("op = 'remember' and ts = 0").withColumn("ts", F.lit(50).cast("long")).withColumn("text", F.lit("changed"))
    ops = ops.unionByName(extra).orderBy(F.xxhash64("id", "op", "ts"))
    ops.repartition(8).write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ops")
    replay.run_once(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    got = {(r["id"], r["text"], tuple(r["labels"]), r["ts"]) for r in replay.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {(r["id"], r["text"], tuple(r["labels"]), r["ts"]) for r in M.replay(spark.read.parquet(f"{tmp_path}/ops")).collect()}
    assert got == want and any(x[1] == "changed" for x in got)


def test_stream_ingest_restarts(spark, data, tmp_path):
    d = I.documents(spark, data)
    halves = d.where("block_id % 2 = 0"), d.where("block_id % 2 = 1")
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/docs")
        ingest.ingest(spark, stream, f"{tmp_path}/index", f"{tmp_path}/check").awaitTermination()
    got = ingest.load(spark, f"{tmp_path}/index")
    want = I.build(d)
    assert got.n == want.n == 200 and got.avg_len == pytest.approx(want.avg_len)
    assert {tuple(r) for r in got.lexicon.collect()} == {tuple(r) for r in want.lexicon.collect()}
