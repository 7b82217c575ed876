"""The binary pack format: decode to tables, encode from an index, and a data source named ``pack``.

Little-endian sections, each a length and its content: meta JSON, lexicon JSON,
postings as 32-bit numbers, blocks JSON, then optionally vectors (JSON and a blob
of int8 vectors and half-precision scales) and a claim graph JSON. Unknown tails
are passed over, unless ``mode`` is ``strict``, which also refuses versions it
doesn't know.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "meta": "version int, docs long, blocks long, terms long, avg_block_len double",
    "lexicon": "term string, term_id long",
    "postings": "term string, term_id long, block_id long, tf long, positions array<int>",
    "blocks": "block_id long, text string, heading string, doc_id string, namespace string, len long",
    "vectors": "block_id long, q array<int>, scale double",
    "nodes": "id string, label string, props map<string,string>",
    "edges": "id string, src string, p string, dst string, evidence array<bigint>, actor string, ts bigint",
}
VERSIONS = (1, 2, 3)


class InvalidPack(ValueError):
    pass


def _u32(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise InvalidPack("pack ends inside a section")
    return struct.unpack_from("<I", data, at)[0]


def _section(data: bytes, at: int) -> tuple[Any, int]:
    n = _u32(data, at)
    end = at + 4 + n
    if end > len(data):
        raise InvalidPack("pack ends inside a section")
    try:
        return json.loads(data[at + 4 : end].decode("utf-8")), end
    except ValueError as e:
        raise InvalidPack(f"section isn't JSON: {e}") from None


def _is_vectors(x: Any) -> bool:
    return isinstance(x, dict) and x.get("encoding") == "int8_l2norm" and isinstance(x.get("dims"), int) and "blocks" in x


def _is_graph(x: Any) -> bool:
    return isinstance(x, dict) and x.get("version") == 1 and isinstance(x.get("nodes"), list) and isinstance(x.get("edges"), list)


def decode(data: bytes, mode: str = "lenient") -> dict[str, list[tuple]]:
    """Rows of each table of a pack."""
    meta, at = _section(data, 0)
    if not isinstance(meta, dict) or (mode == "strict" and ("stats" not in meta or meta.get("version") not in VERSIONS)):
        raise InvalidPack("meta section is malformed")
    lexicon, at = _section(data, at)
    count = _u32(data, at)
    if at + 4 + 4 * count > len(data):
        raise InvalidPack("pack ends inside the postings")
    numbers = np.frombuffer(data, "<u4", count, at + 4)
    blocks, at = _section(data, at + 4 + 4 * count)
    version = meta.get("version", 1)
    stats = meta.get("stats", {})
    out: dict[str, list[tuple]] = {t: [] for t in SCHEMAS}
    out["meta"] = [(version, stats.get("docs"), stats.get("blocks", len(blocks)), stats.get("terms", len(lexicon)), stats.get("avgBlockLen"))]
    out["lexicon"] = [(t, int(i)) for t, i in lexicon]
    out["postings"] = list(_postings(numbers.tolist(), {int(i): t for t, i in lexicon}, version >= 3))
    for n, b in enumerate(blocks):
        if isinstance(b, dict):
            out["blocks"].append((n, str(b.get("text", "")), b.get("heading"), b.get("docId"), b.get("namespace"), b.get("len", 0) if isinstance(b.get("len", 0), int) else 0))
        else:
            out["blocks"].append((n, str(b), None, None, None, None))
    while at < len(data):
        try:
            extra, end = _section(data, at)
            if _is_vectors(extra) and not out["vectors"]:
                n = _u32(data, end)
                if end + 4 + n > len(data):
                    raise InvalidPack("pack ends inside the vectors")
                out["vectors"] = _vectors(extra, data[end + 4 : end + 4 + n])
                at = end + 4 + n
                continue
        except InvalidPack:
            break
        if not _is_graph(extra) or out["nodes"]:
            break
        out["nodes"] = [(n["id"], n["label"], n.get("props")) for n in extra["nodes"]]
        out["edges"] = [(e["id"], e["from"], e["p"], e["to"], e.get("evidence", []), e.get("actor"), e.get("ts")) for e in extra["edges"]]
        at = end
    return out


def _postings(numbers: list[int], terms: dict[int, str], offset: bool) -> Iterator[tuple]:
    at, n = 0, len(numbers)
    while at < n:
        term = numbers[at]
        at += 1
        if term == 0:
            continue
        while at < n and numbers[at]:
            block = numbers[at] - offset
            end = at + 1
            while end < n and numbers[end]:
                end += 1
            yield terms.get(term), term, block, end - at - 1, [p - 1 for p in numbers[at + 1 : end]]
            at = end + 1
        at += 1


def _vectors(section: dict, blob: bytes) -> list[tuple]:
    dims = section["dims"]
    places = section["blocks"]
    vectors = places["vectors"]
    q = np.frombuffer(blob, np.int8, vectors["length"], vectors.get("byteOffset", 0)).reshape(-1, dims)
    scales = places.get("scales")
    if scales:
        scale = np.frombuffer(blob, "<f2", scales["length"], scales.get("byteOffset", vectors["length"])).astype(np.float64)
    else:
        scale = np.full(len(q), 1 / 127)
    return [(i, [int(x) for x in v], float(s)) for i, (v, s) in enumerate(zip(q, scale))]


def encode(meta: dict, lexicon: list[tuple[str, int]], postings: list[tuple[int, int, list[int]]], blocks: list[dict], vectors: tuple[str, list[tuple[list[int], float]]] | None = None, graph: dict | None = None) -> bytes:
    """Bytes of a pack. ``postings`` are (term id, block, positions), sorted; ``vectors`` are (model, rows)."""

    def section(x: Any) -> bytes:
        raw = json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()
        return struct.pack("<I", len(raw)) + raw

    numbers: list[int] = []
    last = None
    for term, block, positions in postings:
        if term != last:
            if last is not None:
                numbers.append(0)
            numbers.append(term)
            last = term
        numbers += [block + 1, *(p + 1 for p in positions), 0]
    if last is not None:
        numbers.append(0)
    out = section(meta) + section([list(x) for x in lexicon]) + struct.pack("<I", len(numbers)) + np.array(numbers, "<u4").tobytes() + section(blocks)
    if vectors:
        model, rows = vectors
        q = np.array([r[0] for r in rows], np.int8)
        scale = np.array([r[1] for r in rows], "<f2")
        head = {"version": 1, "modelId": model, "dims": int(q.shape[1]), "encoding": "int8_l2norm", "perVectorScale": True, "blocks": {"vectors": {"byteOffset": 0, "length": int(q.size)}, "scales": {"byteOffset": int(q.size), "length": len(rows), "encoding": "float16"}}}
        blob = q.tobytes() + scale.tobytes()
        out += section(head) + struct.pack("<I", len(blob)) + blob
    return out + (section(graph) if graph else b"")


def has_vectors(spark: SparkSession, path: str) -> bool:
    """Whether any pack at ``path`` holds vectors."""
    return bool(read(spark, path, "vectors").limit(1).collect())


def from_index(index, graph: tuple[DataFrame, DataFrame] | None = None, vectors: DataFrame | None = None, model_id: str = "") -> bytes:
    """A pack of an index. Packs are one file held in memory by design, so rows are streamed to the driver; ``shards`` has no such bound.

    ``vectors(block_id, embedding)`` must be one of each block, all of one width.
    """
    from ..operators.index import term_ids

    ids = term_ids(index.blocks)
    lexicon = [(r["term"], r["term_id"]) for r in ids.orderBy("term_id").toLocalIterator()]
    rows = index.postings.join(ids, "term").select("term_id", "block_id", "positions").orderBy("term_id", "block_id")
    postings = [(r["term_id"], r["block_id"], r["positions"]) for r in rows.toLocalIterator()]
    blocks = [{"text": r["text"], "heading": r["heading"], "docId": r["doc_id"], "namespace": r["namespace"], "len": r["len"]} for r in index.blocks.orderBy("block_id").toLocalIterator()]
    meta = {"version": 3, "stats": {"docs": len(blocks), "blocks": len(blocks), "terms": len(lexicon), "avgBlockLen": index.avg_len}}
    body = None
    if graph:
        nodes = [{"id": r["id"], "label": r["label"]} for r in graph[0].orderBy("id", "label").toLocalIterator()]
        edges = [{"id": r["id"], "from": r["src"], "p": r["p"], "to": r["dst"], "evidence": r["evidence"]} for r in graph[1].orderBy("id").toLocalIterator()]
        body = {"version": 1, "nodes": nodes, "edges": edges}
        meta["claimGraph"] = {"version": 1, "nodes": len(nodes), "edges": len(edges)}
    held = None
    if vectors is not None:
        from ..operators.semantic import quantized

        rows = [(r["block_id"], r["q"], r["scale"]) for r in quantized(vectors).orderBy("block_id").toLocalIterator()]
        places = [r["block_id"] for r in index.blocks.select("block_id").orderBy("block_id").toLocalIterator()]
        if [b for b, _, _ in rows] != places or not rows or len({len(q or ()) for _, q, _ in rows}) != 1 or not rows[0][1]:
            raise InvalidPack(f"vectors must be one of each of {len(places)} blocks, of one width")
        held = model_id, [(q, s) for _, q, s in rows]
    return encode(meta, lexicon, postings, blocks, held, body)


def shards(docs: DataFrame, per_shard: int = 100_000) -> DataFrame:
    """(shard, content): packs of ``per_shard`` blocks of ``docs(block_id, text, ...)`` in a row of ids, each made whole by one task.

    A shard has a lexicon and postings of its own, numbered from its first block; no
    task or driver holds more than one.
    """
    from ..operators.index import blocks
    from ..shared import numbered

    rows = numbered(blocks(docs), [F.col("block_id").asc()], "n")
    rows = rows.select((F.col("n") / per_shard).cast("long").alias("shard"), "n", "text", "heading", "doc_id", "namespace", "tokens")

    def made(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        ids: dict[str, int] = {}
        places: dict[int, dict[int, list[int]]] = {}
        for at, tokens in enumerate(pdf["tokens"]):
            for pos, t in enumerate(tokens):
                places.setdefault(ids.setdefault(t, len(ids) + 1), {}).setdefault(at, []).append(pos)
        postings = [(term, at, found) for term, by in places.items() for at, found in by.items()]
        clean = lambda x: x if isinstance(x, str) else None
        held = [{"text": t or "", "heading": clean(h), "docId": clean(d), "namespace": clean(s), "len": len(k)} for t, h, d, s, k in zip(pdf["text"], pdf["heading"], pdf["doc_id"], pdf["namespace"], pdf["tokens"])]
        meta = {"version": 3, "stats": {"docs": len(held), "blocks": len(held), "terms": len(ids), "avgBlockLen": sum(b["len"] for b in held) / len(held)}}
        return pd.DataFrame({"shard": [key[0]], "content": [encode(meta, list(ids.items()), postings, held)]})

    return rows.groupBy("shard").applyInPandas(made, "shard long, content binary")


def write_shards(packs: DataFrame, path: str) -> None:
    """Each shard as ``part-<shard>.pack`` below ``path``, on any file system that Arrow knows (local, HDFS, S3)."""

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        for pdf in parts:
            system.create_dir(folder, recursive=True)
            for n, raw in zip(pdf["shard"], pdf["content"]):
                with system.open_output_stream(f"{folder}/part-{n:06d}.pack") as f:
                    f.write(raw)
            yield pdf[["shard"]]

    packs.mapInPandas(store, "shard long").write.format("noop").mode("overwrite").save()


def tables(packs: DataFrame, table: str, mode: str = "lenient") -> DataFrame:
    """A table of packs held in rows ``(shard, content)``."""
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for n, raw in zip(pdf["shard"], pdf["content"]):
                found = pd.DataFrame(decode(bytes(raw), mode)[table], columns=names).astype(object)
                found.insert(0, "shard", n)
                yield found

    return packs.mapInPandas(rows, "shard long, " + SCHEMAS[table])


def to_index(spark: SparkSession, path: str, mode: str = "lenient"):
    """An index over all packs at ``path``; blocks are numbered over the packs, in the order of their files."""
    from ..functions import text as T
    from ..operators.index import Index, lexicon

    files = spark.read.format("binaryFile").load(path)
    names = {r["path"]: n for n, r in enumerate(files.select("path").orderBy("path").collect())}  # a row a pack
    where = F.broadcast(spark.createDataFrame(list(names.items()) or [("", 0)], "path string, shard long"))
    files = files.join(where, "path").select("shard", "content")
    sizes = tables(files, "blocks", mode).groupBy("shard").agg(F.max("block_id").alias("last")).orderBy("shard").collect()  # a row a pack
    at, rows = 0, []
    for r in sizes:
        rows.append((r["shard"], at))
        at += r["last"] + 1
    where = F.broadcast(spark.createDataFrame(rows or [(0, 0)], "shard long, first long"))
    moved = lambda df: df.join(where, "shard").withColumn("block_id", F.col("block_id") + F.col("first")).drop("first", "shard")
    blocks = moved(tables(files, "blocks", mode)).withColumn("tokens", T.tokenize(F.coalesce("text", F.lit(""))))
    blocks = blocks.select("block_id", "text", F.col("text").alias("raw"), "heading", "doc_id", "namespace", F.lit(None).cast("string").alias("source"), "tokens", F.coalesce("len", F.size("tokens").cast("long")).alias("len"))
    postings = moved(tables(files, "postings", mode)).join(blocks.select("block_id", "len"), "block_id").select("term", "block_id", "len", "tf", "positions")
    stats = blocks.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    return Index(blocks, postings, lexicon(postings), stats["n"], stats["avg"] or 1.0)


def read(spark: SparkSession, path: str, table: str, mode: str = "lenient") -> DataFrame:
    """A table of all packs at ``path``, any file system that Spark reads; files decode in parallel."""
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for raw in pdf["content"]:
                yield pd.DataFrame(decode(bytes(raw), mode)[table], columns=names).astype(object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, SCHEMAS[table])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.mode = options["path"], options.get("table", "blocks"), options.get("mode", "lenient")

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        if "*" in at:
            import fnmatch

            found = system.get_file_info(fs.FileSelector(at.rsplit("/", 1)[0]))
            return [_File(i.path) for i in sorted(found, key=lambda i: i.path) if fnmatch.fnmatch(i.path, at)]
        if system.get_file_info(at).type == fs.FileType.Directory:
            return [_File(i.path) for i in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda i: i.path) if i.is_file]
        return [_File(at)]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        with system.open_input_stream(partition.path) as f:
            yield from decode(f.read(), self.mode)[self.table]


class PackSource(DataSource):
    """``spark.read.format("pack").option("table", "postings").load(path)`` for packs on any file system that Arrow knows."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "blocks")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)
