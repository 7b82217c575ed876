"""Documents from files, JSON and configuration; agent definitions."""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt", "json")
SKIPPED = ("node_modules", "dist", ".git", ".dfx", ".cargo-target")
DOCUMENT = "id string, heading string, namespace string, text string"


class SourceError(ValueError):
    pass


def walk(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(doc_id, heading, namespace, text) of the text files below ``path``: path below it, file name, ``name``."""
    if "." in path.rsplit("/", 1)[-1] and path.rsplit(".", 1)[-1] not in EXTENSIONS:
        raise SourceError(f"unsupported file type: {path}")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.col("_metadata.file_path"))
    root = path.removeprefix("file://").rstrip("/")
    plain = F.regexp_replace("file", r"^file:/+", "/")
    relative = F.when(plain.startswith(root + "/"), F.substring(plain, len(root) + 2, 1_000_000)).otherwise(F.element_at(F.split(plain, "/"), -1))
    rows = files.select(relative.alias("doc_id"), F.element_at(F.split(plain, "/"), -1).alias("heading"), F.lit(name).cast("string").alias("namespace"), F.col("value").alias("text"))
    parts = F.split("doc_id", "/")
    return rows.where(F.regexp_extract("heading", r"\.([^.]+)$", 1).isin(*EXTENSIONS) & ~F.exists(parts, lambda p: p.isin(*SKIPPED)))


def collected(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Several named sources of a configuration, one namespace each."""
    if not sources:
        raise SourceError("no sources")
    return reduce(DataFrame.unionByName, [walk(spark, s["path"], s["name"]) for s in sources])


def init_project(folder: str, name: str = "docs") -> str:
    """A new project: its configuration, one source folder and a first document. Nothing that exists is overwritten."""
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    for path, text in ((f"{folder}/knowledge.json", json.dumps({"sources": [{"name": name, "path": name}], "output": {"path": "dist/knowledge"}}, indent=2) + "\n"), (f"{folder}/{name}/welcome.md", "# Welcome\nPut documents here.\n")):
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
    return f"{folder}/knowledge.json"


def add_source(config_path: str, name: str, path: str) -> None:
    """Another source of a project; its name must be new."""
    found = config(config_path)
    found["sources"].append({"name": name, "path": path})
    text = json.dumps(found, indent=2) + "\n"
    if len({s["name"] for s in found["sources"]}) != len(found["sources"]):
        raise SourceError(f"there is a source named {name} already")
    with open(config_path, "w", encoding="utf-8") as f:
        f.write(text)


def default_label(path: str) -> str:
    """The file's name without its extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0] or "knowledge"


def build_project(spark: SparkSession, config_path: str, strict: bool = True) -> dict:
    """Builds what a configuration names: its sources as one stored index at ``output.path``, blocks in the order of the files' paths.

    Fails on a blank document with ``strict``. Returns the place and the number of blocks.
    """
    from ..operators import index as I
    from ..shared import numbered

    found = config(config_path)
    root = os.path.dirname(os.path.abspath(config_path))
    place = lambda p: p if "://" in p or p.startswith("/") else f"{root}/{p}"
    out = place((found.get("output") or {}).get("path") or "dist/knowledge")
    docs = collected(spark, [{**s, "path": place(s["path"])} for s in found["sources"]])
    docs = numbered(docs, [F.col("doc_id").asc(), F.col("namespace").asc()], "block_id")
    index = I.build(docs, markdown=True, strict=strict)
    if not index.n:
        raise SourceError("no supported files found")
    I.save(index, out)
    return {"path": out, "blocks": index.n}


def checked_embeddings(vectors: DataFrame, blocks: int) -> DataFrame:
    """``vectors`` if there is one of each block and all are numbers of one width; fails otherwise."""
    bad = F.col("embedding").isNull() | (F.size("embedding") < 1) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = vectors.agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("widths"), F.count_if(bad).alias("bad")).first()
    if row["n"] != blocks:
        raise SourceError(f"{row['n']} embeddings for {blocks} blocks")
    if row["bad"] or row["widths"] > 1:
        raise SourceError("embeddings must be finite numbers of one width")
    return vectors


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """An array of documents, or one per line."""
    rows = spark.read.json(path, schema=DOCUMENT, multiLine=True)
    return rows.withColumnRenamed("id", "doc_id")


def json_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, embedding) of ``[[...]]`` or ``{"embeddings": [[...]]}``."""
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json("value", "struct<embeddings:array<array<float>>>")["embeddings"], F.from_json("value", "array<array<float>>"))
    return raw.select(F.posexplode(both).alias("block_id", "embedding")).select(F.col("block_id").cast("long").alias("block_id"), "embedding")


def parsed_markdown(files: DataFrame) -> DataFrame:
    """First line ``# heading``, the rest text."""
    return files.select("doc_id", F.regexp_extract("text", r"^# (.*)\n", 1).alias("heading"), "namespace", F.trim(F.regexp_replace("text", r"^# .*\n", "")).alias("text"))


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        try:
            found = json.load(f)
        except ValueError as e:
            raise SourceError(f"configuration isn't JSON: {e}") from None
    sources = found.get("sources")
    if not isinstance(sources, list) or not all(isinstance(s, dict) and isinstance(s.get("name"), str) and isinstance(s.get("path"), str) for s in sources):
        raise SourceError("configuration needs sources with name and path")
    if len({s["name"] for s in sources}) != len(sources):
        raise SourceError("source names must be unique")
    return found


def scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~", ""):
        return None
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return text


def simple_yaml(text: str):
    """Mappings, lists, scalars and block scalars by indentation; nothing else of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines()]

    def skip(at: int) -> int:
        while at < len(lines) and (not lines[at][1] or lines[at][1].startswith("#")):
            at += 1
        return at

    def block(at: int, indent: int) -> tuple[str, int]:
        out = []
        while at < len(lines) and (not lines[at][1] or lines[at][0] > indent):
            out.append(lines[at])
            at += 1
        least = min((i for i, x in out if x), default=0)
        return "\n".join(" " * max(0, i - least) + x for i, x in out).rstrip("\n") + "\n", at

    def value(raw: str, at: int, indent: int):
        if raw in ("|", ">"):
            body, at = block(at, indent)
            return (body if raw == "|" else " ".join(body.split())), at
        if raw:
            return scalar(raw), at
        at = skip(at)
        if at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
            return node(at)
        return None, at

    def node(at: int):
        at = skip(at)
        indent = lines[at][0]
        if lines[at][1].startswith("-"):
            items = []
            while (at := skip(at)) < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                if re.match(r"^[\w.-]+:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    item, at = node(at)
                else:
                    item, at = value(rest, at + 1, indent)
                items.append(item)
            return items, at
        found = {}
        while (at := skip(at)) < len(lines) and lines[at][0] == indent:
            m = re.match(r"^([\w.-]+):\s*(.*)$", lines[at][1])
            if not m:
                raise SourceError(f"line isn't understood: {lines[at][1]}")
            found[m[1]], at = value(m[2], at + 1, indent)
        return found, at

    return node(0)[0] if skip(0) < len(lines) else {}


def agents(folder: str) -> list[dict]:
    """Agent definitions of a folder, by id; an id may occur once."""
    found = {}
    for name in sorted(os.listdir(folder)):
        if name.rsplit(".", 1)[-1] not in ("json", "yaml", "yml"):
            continue
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        agent = json.loads(text) if name.endswith("json") else simple_yaml(text)
        if agent["id"] in found:
            raise SourceError(f"duplicate agent id: {agent['id']}")
        found[agent["id"]] = agent
    return [found[i] for i in sorted(found)]
