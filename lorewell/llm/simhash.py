"""Operator 4: near-duplicate documents by SimHash, searched with BK-trees.

Signature: 128 bits over the distinct words of the lower-cased text (pairs of
characters where a script has no spaces), each weighing 1 + ln(count). Two documents are near-duplicates if at most ``RADIUS``
= 17 bits differ; groups are the connected components of that relation, and the
document with the smallest id of each group stays.

Search is by shards. A shard key is ``bits`` of the 128 bits, chosen by a fixed
permutation for each of ``tables`` keys; signatures with an equal key form a
shard. ``bits`` follows the count of signatures so that shards stay small, and
``tables`` follows ``bits`` so that a pair at the radius, the worst case, meets in
some shard with probability ``RECALL`` = 0.999 (nearer pairs more surely). The
signatures of a shard form a BK-tree (children keyed by the integer Hamming
distance to their parent), and each signature of the shard follows only edges
within the radius of its distance.

A tree is never broadcast to the whole cluster: all trees together grow with
the corpus. Instead a shard's tree and its queries are sent to one task. The
trees of a task grow and are searched side by side, level by level, as NumPy
arrays. Queries go in rounds of doubling size; between rounds components are
merged, and a subtree that lies wholly in a query's own component is left out:
it can't connect anything new. A group of thousands of copies therefore costs
time in proportion to its size, and a task emits one edge a node, not one a pair.

Cases: null, empty or wordless text has no signature and is a group of its own;
exact copies share one signature; rows that repeat a ``doc_id`` are one
document, of which the row with the smallest signature counts, and stay or go
together; rows with a null ``doc_id`` are in no group and stay; an empty table
gives an empty result; extra columns are ignored by ``groups`` and carried by
``keep_first``; whole texts of any length are read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, free, pick, table, texts
from ._components import components

RADIUS = 17
BITS = 128
RECALL = 0.999
SHARD = 32  # signatures in a shard, on average at most
#: Runs of letters and digits; of scripts without spaces every two neighbours.
PLAIN = re.compile(r"[^\W_]+")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
FRONTIER = 1 << 21
PART_BYTES = 8 << 20
ENTRY = np.dtype([("key", np.uint32), ("id", np.int64), ("hi", np.uint64), ("lo", np.uint64)])


def words(text: str) -> list[str]:
    """The words of a lower-case text. Where a script has no spaces, pairs of neighbouring characters stand for words."""
    found = PLAIN.findall(text)
    if text.isascii() or not UNSPACED.search(text):
        return found
    out = []
    for w in found:
        out += [p for p in UNSPACED.split(w) if p]
        for m in UNSPACED.findall(w):
            out += [m[i : i + 2] for i in range(max(1, len(m) - 1))]
    return out


class _Planes(dict):
    """word -> its 128 signs, for the words of one batch."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def signatures(batch: list[str]) -> list[tuple[int, int] | None]:
    """The two signed 64-bit halves of each text; None without words."""
    planes = _Planes()
    counted = []
    for text in batch:
        count = Counter(words(text.lower()))
        counted.append((np.fromiter((planes[w] for w in count), np.int64, len(count)), np.fromiter(count.values(), np.float32, len(count))))
    digests = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "replace")) for w in planes)
    signs = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).astype(np.float32)
    out: list[tuple[int, int] | None] = []
    for ids, count in counted:
        if not len(ids):
            out.append(None)
            continue
        weight = np.round(16 * (1 + np.log(count)))
        lean = np.zeros(BITS)
        for at in range(0, len(ids), 4096):  # so that sums are exact and long texts stay small
            lean += weight[at : at + 4096] @ signs[ids[at : at + 4096]]
        packed = np.packbits(2 * lean > weight.sum(dtype=np.float64)).view(">i8")
        out.append((int(packed[0]), int(packed[1])))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) of every row with an id and at least a word."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = signatures(texts(part.column(1)))
                keep = [i for i, s in enumerate(found) if s]
                ids = part.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([found[i][half] for i in keep], pa.int64()) for half in (0, 1))], names=["doc_id", "hi", "lo"])

    return pick(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, hi long, lo long")


def layout(n: int, shard: int = SHARD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` signatures."""
    bits = min(31, max(1, ceil(log2(max(n, 2) / shard)))) if n > shard else 0
    meet = comb(BITS - RADIUS, bits) / comb(BITS, bits)  # that a key takes none of the bits in which a pair at the radius differs
    return bits, ceil(log(1 - recall) / log(1 - meet)) if bits else 1


def masks(bits: int, tables: int) -> np.ndarray:
    """(tables, 2) halves of the bits that each key takes; consecutive keys share none as far as possible."""
    order = np.concatenate([np.random.default_rng(seed).permutation(BITS)[: BITS - BITS % max(bits, 1)] for seed in range(bits * tables // (BITS // 2) + 1)])
    out = np.zeros((tables, BITS), dtype=np.uint8)
    for table_, chosen in enumerate(order[: bits * tables].reshape(tables, bits)):
        out[table_, chosen] = 1
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shard_keys(hi: np.ndarray, lo: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(tables, rows) 32-bit keys. Two shards that get the same key by chance are searched as one."""
    keys = [mixed(mixed(hi & m[0]) + (lo & m[1]) + np.uint64(t + 1)) >> np.uint64(32) for t, m in enumerate(masks(bits, tables))]
    return np.array(keys, dtype=np.uint32).reshape(tables, len(hi))


def apart(hi: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of items a and b."""
    return np.bitwise_count(hi[a] ^ hi[b]).astype(np.int16) + np.bitwise_count(lo[a] ^ lo[b])


class Forest:
    """BK-trees of many shards at once. ``tree`` numbers the shard of each item, in order; items are inserted in order."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, tree: np.ndarray):
        n = len(hi)
        self.hi, self.lo = hi, lo
        start = np.concatenate(([True], tree[1:] != tree[:-1]))
        first = np.flatnonzero(start)
        self.root = first[np.cumsum(start) - 1]
        self.parent = np.full(n, -1, dtype=np.int64)
        self.edge = np.zeros(n, dtype=np.int16)
        self.levels = [first]
        left = np.flatnonzero(~start)
        node = self.root[left]
        while len(left):
            d = apart(hi, lo, left, node)
            slot = node * (BITS + 1) + d
            order = np.argsort(slot, kind="stable")  # items of a slot stay in order
            left, node, d, slot = left[order], node[order], d[order], slot[order]
            head = np.concatenate(([True], slot[1:] != slot[:-1]))
            child = left[head]
            self.parent[child], self.edge[child] = node[head], d[head]
            self.levels.append(child)
            node = child[np.cumsum(head) - 1][~head]
            left = left[~head]
        self.children = np.argsort(self.parent, kind="stable")
        count = np.bincount(self.parent + 1, minlength=n + 1)
        self.begin = np.cumsum(count)[:-1]
        self.count = count[1:]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """The one component that holds the whole subtree of each node, or -1."""
        low, high = label.copy(), label.copy()
        for level in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return np.where(low == high, low, -1)

    def search(self, query: np.ndarray, radius: int, whole: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, found) pairs within ``radius``, found being the item inserted earlier.

        With ``whole`` (see ``uniform``) and ``label``, subtrees that lie in the query's own component are left out.
        """
        node = self.root[query]
        got: list[tuple[np.ndarray, np.ndarray]] = []
        on = node < query
        query, node = query[on], node[on]
        while len(query):
            if whole is not None:
                on = whole[node] != label[query]
                query, node = query[on], node[on]
            d = apart(self.hi, self.lo, query, node)
            hit = d <= radius
            got.append((query[hit], node[hit]))
            n = self.count[node]
            on = n > 0
            query, node, d, n = query[on], node[on], d[on], n[on]
            total = np.cumsum(n)
            at = np.repeat(np.arange(len(n)), n)
            child = self.children[np.arange(len(at)) + (self.begin[node] - total + n)[at]]
            # What lies below a later item was inserted later still.
            on = (np.abs(self.edge[child] - d[at]) <= radius) & (child < query[at])
            query, node = query[at[on]], child[on]
        return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each component) after joining a with b."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return label
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def linked(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The component label of each item, joining what is within the radius in a shard."""
    label = np.arange(len(hi))
    if not len(hi):
        return label
    forest = Forest(hi, lo, tree)
    start = np.concatenate(([True], tree[1:] != tree[:-1]))
    rank = label - forest.root
    size = np.bincount(np.cumsum(start) - 1)[np.cumsum(start) - 1]
    below, above = 1, 64
    while below <= rank.max():
        todo = np.flatnonzero((rank >= below) & (rank < above))
        todo = todo[np.argsort(-size[todo], kind="stable")]
        at = 0
        whole = forest.uniform(label) if below > 1 else None
        while at < len(todo):
            n = max(1, FRONTIER // int(min(above, size[todo[at]])))
            a, b = forest.search(todo[at : at + n], RADIUS, whole, label)
            label = merged(label, a, b)
            if whole is not None and len(a):
                whole = forest.uniform(label)
            at += n
        below, above = above, 2 * above
    return label


def edges(sigs: DataFrame, n: int, shard: int = SHARD) -> DataFrame:
    """(a, b) edges between ids of distinct signatures; they connect what lies within the radius and meets in a shard.

    A signature goes to as many shards as there are keys. Those of a batch that
    go to the same task travel as one packed row, so the exchange moves 28 bytes
    an entry and few rows.
    """
    bits, tables = layout(n, shard)
    parts = max(1, -(-n * tables * ENTRY.itemsize // PART_BYTES))

    def spread(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, hi, lo = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                rows = np.empty((tables, len(ids)), dtype=ENTRY)
                rows["id"], rows["hi"], rows["lo"] = ids, hi.view(np.uint64), lo.view(np.uint64)
                rows["key"] = shard_keys(hi.view(np.uint64), lo.view(np.uint64), bits, tables)
                rows = rows.ravel()
                to = rows["key"] % np.uint32(parts)
                rows = rows[np.argsort(to, kind="stable")]
                begin = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=parts))))
                some = np.flatnonzero(np.diff(begin))
                packed = [b"".join(rows[f][begin[i] : begin[i + 1]].tobytes() for f in ENTRY.names) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["to", "rows"])

    def search(batches):
        held = []
        for b in batches:
            for packed in b.column(1).to_pylist():
                size = len(packed) // ENTRY.itemsize
                rows, at = np.empty(size, dtype=ENTRY), 0
                for f in ENTRY.names:
                    rows[f] = np.frombuffer(packed, ENTRY[f], size, at)
                    at += size * ENTRY[f].itemsize
                held.append(rows)
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows["id"], rows["key"]))]
        label = linked(rows["key"], np.ascontiguousarray(rows["hi"]), np.ascontiguousarray(rows["lo"]))
        on = np.flatnonzero(label != np.arange(len(label)))
        pairs = np.stack([rows["id"][on], rows["id"][label[on]]], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    spread_out = sigs.select("id", "hi", "lo").mapInArrow(spread, "to int, rows binary")
    return spread_out.repartitionById(parts, F.col("to")).mapInArrow(search, "a long, b long")


def decisions(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, group_id, kept) of every document with a signature."""
    held = signed(docs).groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("s"))
    held = checkpointed(held.select("doc_id", F.col("s.hi").alias("hi"), F.col("s.lo").alias("lo")))
    sigs = checkpointed(held.groupBy("hi", "lo").agg(F.min("doc_id").alias("id")))
    links = edges(sigs, sigs.count(), shard)
    roots = components(links)
    own = held.join(sigs, ["hi", "lo"]).select("doc_id", "id")
    root = F.coalesce("root", "id")
    return own.join(roots, own["id"] == roots["node"], "left").select("doc_id", root.alias("group_id"), (F.col("doc_id") == root).alias("kept"))


def groups(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, group_id, kept): one row per document; those without words are groups of their own."""
    found = decisions(docs, shard)
    ids = pick(docs, "doc_id").where("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` without those that a group's first document stands for, with all their columns."""
    (own,) = free(docs, "gone")
    gone = decisions(docs, shard).where("not kept").select(F.col("doc_id").alias(own))
    return docs.join(gone.hint("shuffle_hash"), F.col("`doc_id`") == F.col(own), "left_anti")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES: dict[str, str] = {}
