"""Queries of the claim graph, the overlay, the memory log and routing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agents as A
from ..operators import graph as G
from ..operators import index as I
from ..operators import live as L
from ..operators import memory as M
from ..operators import retrieve as R
from ..options import Graph as GraphOptions
from ..options import Options
from ..shared import shared_dir
from ..sources import logs
from . import retrieval, sql

LIVE = [(1, "fresh note again"), (2, "src3 new the"), (3, "der und src7")]
NOTE = "# Note on {lang}\nThe {source} corpus is a set of {lang} texts.\nSee [guide {source}](http://example.org/{lang}) and [[{lang} log]].\nThis is it.\n"


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a short marked-up note before their text, as input of the graph."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    note = F.lit(NOTE)
    for name in ("lang", "source"):
        note = F.replace(note, F.lit("{" + name + "}"), F.col(name))
    return d.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("heading"), F.concat(note, F.col("text")).alias("text"))


def graph_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triples(noted(spark, sf_dir)).groupBy("doc_ord", "subject", "p", "object").agg(F.count("*").alias("n"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build(noted(spark, sf_dir))[1].select("id", "src", "p", "dst", F.col("evidence")[0].alias("evidence"))


def graph_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = G.build(noted(spark, sf_dir), max_edges=2)
    return edges.agg(F.countDistinct("id").alias("edges")).crossJoin(nodes.agg(F.countDistinct("id").alias("nodes")))


def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = G.build(noted(spark, sf_dir))
    q = spark.createDataFrame([(1, "src3 note"), (2, "guide src1"), (3, "nothing here")], "query_id long, q string")
    return G.expand_queries(graph, q, GraphOptions(expand=True, max_extra_terms=6)).select("query_id", "q")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    src, dst = F.concat(F.lit("n"), (F.col("user_id") % 50).cast("string")), F.concat(F.lit("n"), (F.col("event_id") % 40).cast("string"))
    evidence = F.array((F.col("event_id") % 3).cast("long"))
    kind = F.when(F.col("event_type").isin("click", "view"), "add_edge").when(F.col("event_type") == "error", "tombstone_edge").otherwise("upsert_node")
    return e.select(
        kind.alias("op"), src.alias("id"), F.concat(F.lit("Label "), F.col("event_type"), F.lit(" "), (F.col("event_id") % 7).cast("string")).alias("label"),
        F.lit(None).cast("map<string,string>").alias("props"), src.alias("src"), F.lit("is").alias("p"), dst.alias("dst"), evidence.alias("evidence"),
        G.edge_id(src, F.lit("is"), dst, evidence).alias("edge_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("actor"),
    )


def graph_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.replay(event_log(spark, sf_dir))[1].select("id", "src", "p", "dst", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"), "ts", "actor")


def graph_log_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.replay(event_log(spark, sf_dir))[0].select("id", "label")


def overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base: all documents. Operations: removals, partial updates, additions and additions after removal."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(None).cast("string").alias("heading"), F.col("lang").alias("namespace"))
    null = F.lit(None).cast("string")
    n = F.col("doc_id")
    key = n.cast("string").alias("doc_id")
    gone = d.where(n % 5 == 0).select(n.alias("seq"), F.lit("remove").alias("op"), key, null.alias("text"), null.alias("heading"), null.alias("namespace"))
    moved = d.where(n % 5 == 1).select(n.alias("seq"), F.lit("update").alias("op"), key, null.alias("text"), F.concat(F.lit("New "), "source").alias("heading"), null.alias("namespace"))
    back = d.where(n % 10 == 0).select((n + 10**12).alias("seq"), F.lit("add").alias("op"), key, F.concat(F.lit("again "), "text").alias("text"), null.alias("heading"), F.lit("live").alias("namespace"))
    new = d.where(n % 5 == 2).select((n + 10**12).alias("seq"), F.lit("add").alias("op"), F.concat(F.lit("new-"), n.cast("string")).alias("doc_id"), F.concat("source", F.lit(" fresh note")).alias("text"), null.alias("heading"), F.lit("live").alias("namespace"))
    return base, gone.unionByName(moved).unionByName(back).unionByName(new)


def live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merged(*overlay(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"), "heading", "namespace")


def live_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of document frequencies over the merged corpus."""
    ix = L.live_index(*overlay(spark, sf_dir))
    q = R.parsed(spark.createDataFrame([(1, "fresh note again")], "query_id long, q string"), Options())
    rows = R.sums(ix, q).withColumn("score", F.round("score", 6))
    return rows.join(ix.blocks.select("block_id", "doc_id"), "block_id").select("doc_id", "score")


def memory_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    null = lambda t: F.lit(None).cast(t)
    who = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("actor")
    ts = F.col("turn").cast("long").alias("ts")

    def rows(df: DataFrame, op: str, **values) -> DataFrame:
        kinds = {"kind": "string", "text": "string", "labels": "array<string>", "namespace": "string", "source": "string", "importance": "double", "confidence": "double", "to": "string", "relation": "string"}
        return df.select(F.lit(op).alias("op"), ts, who, own.alias("id"), *(values.get(k, null(t)).alias(k) for k, t in kinds.items()))

    said = rows(c, "remember", kind=F.col("role"), text=M.field("text"), labels=F.array("role", F.concat(F.lit("turn."), F.col("turn").cast("string"))), namespace=F.concat(F.lit("chat."), "role"), source=F.concat(F.lit("conv "), (F.col("conv_id") % 10).cast("string")), importance=(F.col("turn") % 5).cast("double") / 4.0)
    gone = rows(c.where("conv_id % 7 = 0 and turn = 1"), "forget")
    label = rows(c.where("conv_id % 3 = 0"), "label", labels=T.normalized_labels(F.array(F.concat(F.lit("Extra / "), "role"))))
    link = rows(c.where("turn > 0"), "link", to=F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")), relation=F.lit("follows"))
    return said.unionByName(gone).unionByName(label).unionByName(link)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.replay(memory_ops(spark, sf_dir))


def memory_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    return m.select("id", "kind", "text", F.array_join("labels", "|").alias("labels"), "namespace", "source", "importance", "ts", "actor", F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["relation"], x["to"])), "|").alias("links"))


def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = M.recall(memories(spark, sf_dir), "user the of", top_k=20, min_importance=0.25)
    return hits.select("id", F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical_score"), F.round("metadata_score", 6).alias("metadata_score"))


def memory_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = M.recall(memories(spark, sf_dir), "", top_k=15, labels=["extra"], namespaces=["chat"], kinds=["user"], since=1)
    return hits.select("id", "ts", F.round("score", 6).alias("score"))


def memory_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consolidate(memories(spark, sf_dir), now=10, min_age=8, labels=["turn"])


def memory_claim_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.claim_ops(memories(spark, sf_dir)).select("op", "id", "label", "src", "p", "dst", "ts", "actor")


def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.memory_label("text").alias("label"))


def label_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws(".", "source", "lang").alias("label"))
    return d.where(T.prefix_match(F.col("label"), ["src1", "src2.en"]))


def route_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made of suppliers per nation; the registry holds some of them."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = F.concat(F.lit("agent-"), F.col("s_suppkey").cast("string"))
    d = s.groupBy(F.col("s_nationkey").cast("long").alias("decision_id")).agg(
        F.collect_list(F.struct(name.alias("agent_id"), F.round("s_acctbal", 0).cast("double").alias("score"))).alias("candidates"), F.max(F.struct("s_suppkey", name.alias("n")))["n"].alias("selected")
    )
    registry = s.where("s_suppkey % 3 = 0").select(name.alias("agent_id"))
    return A.selected(d, registry, "agent-3")


def tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    mode = F.when(F.col("user_id") % 3 == 0, "allow").when(F.col("user_id") % 3 == 1, "deny")
    return e.select("event_id", A.tool_allowed(mode, F.array(F.lit("click"), F.lit("view")), F.col("event_type")).alias("allowed"))


def routing_profile_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["'), "lang", F.lit('", " '), "source", F.lit('", "'), "lang", F.lit('"]'))).when(F.col("doc_id") % 3 == 1, F.concat_ws("\n", "lang", "source", F.lit(" "))).otherwise(F.concat("lang", F.lit(", ,"), "source", F.lit(" ,"), "lang"))
    return A.profile_lists(d.select("doc_id", raw.alias("tags")), "tags").select("doc_id", F.array_join("tags", "|").alias("tags"))


def graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's node with the edges that leave and reach it."""
    labels, out, in_ = G.index(G.build(noted(spark, sf_dir)))
    side = lambda df, name: df.select("id", F.md5(F.array_join("edges", ",")).alias(name))
    return labels.join(side(out, "leave"), "id", "left").join(side(in_, "reach"), "id", "left").select("label", "id", "leave", "reach")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the links of web pages: each anchor rewritten as a marked-up link."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace("html", r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    found = G.triples(p.select(F.col("page_id").alias("doc_ord"), F.col("url").alias("doc_id"), F.lit("").alias("heading"), text.alias("text")))
    return found.where("p = 'ref'").groupBy("doc_ord", "subject", "object").agg(F.count("*").alias("n"))


def graph_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as lines and read again, replayed."""
    folder = f"{shared_dir(spark)}/graph-log-{uuid.uuid4().hex}"
    logs.write(event_log(spark, sf_dir), folder, "graph")
    return G.replay(logs.read(spark, folder, "graph"))[1].select("id", "src", "p", "dst", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"), "ts", "actor")


def live(spark: SparkSession, sf_dir: str) -> L.Live:
    base, ops = overlay(spark, sf_dir)
    return L.Live.over(base).applied(ops)


def live_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline, expansion and headings included, over the merged corpus."""
    q = spark.createDataFrame(LIVE, "query_id long, q string")
    hits = live(spark, sf_dir).query(q, Options(top_k=10, diversify=False))
    return hits.select("query_id", "rank", F.col("source").alias("doc_id"), F.round("score", 6).alias("score"))


def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged corpus stored as an index and loaded again."""
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    live(spark, sf_dir).snapshot(folder)
    index = I.load(spark, folder)
    return index.lexicon.select("term", "df").withColumn("blocks", F.lit(index.n).cast("long"))


def memory_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as normalized memories, with the ids that their content gives them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = c.select(
        F.concat(F.lit(" "), F.upper("role")).alias("kind"), F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"), F.array(F.concat(F.lit("Turn / "), F.col("turn").cast("string")), F.lit("CHAT"), F.lit("")).alias("labels"),
        F.lit("Chat / Log").alias("namespace"), F.concat(F.lit("Conv: "), (F.col("conv_id") % 10).cast("string")).alias("source"), ((F.col("turn") - 1) / 2.0).alias("importance"),
        F.col("turn").cast("long").alias("ts"), F.concat(F.lit(" c  "), F.col("conv_id").cast("string")).alias("actor"),
    )
    return M.normalized(rows).select("id", "kind", F.md5("text").alias("text"), F.array_join("labels", "|").alias("labels"), "namespace", "source", "importance", "confidence", "ts", "actor")


def memory_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory log written as lines and read again, replayed."""
    folder = f"{shared_dir(spark)}/memory-log-{uuid.uuid4().hex}"
    logs.write(memory_ops(spark, sf_dir), folder, "memory")
    m = M.replay(logs.read(spark, folder, "memory"))
    return m.select("id", "kind", "text", F.array_join("labels", "|").alias("labels"), "namespace", "source", "importance", "ts", "actor", F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["relation"], x["to"])), "|").alias("links"))


QUERIES = {
    f.__name__: f
    for f in (graph_triples, graph_edges, graph_cap, graph_one_hop, graph_log_replay, graph_log_nodes, live_merge, live_bm25, memory_replay, memory_recall, memory_browse, memory_consolidate, memory_claim_ops, graph_index, page_links, graph_log_lines, live_query, live_snapshot, memory_input, memory_log_lines, label_normalize, label_prefix_match, route_select, tool_policy, routing_profile_lists)
}


def _fnv(x: str) -> str:
    return sql.fnv(x)


def _label(x: str) -> str:
    return rf"substr(trim(regexp_replace({sql.normal(x)}, '\s+', ' ', 'g')), 1, 200)"


_NOTE = "'# Note on ' || lang || chr(10) || 'The ' || source || ' corpus is a set of ' || lang || ' texts.' || chr(10) || 'See [guide ' || source || '](http://example.org/' || lang || ') and [[' || lang || ' log]].' || chr(10) || 'This is it.' || chr(10) || text"
_TRIPLES = rf"""n AS (SELECT doc_id, {_NOTE} AS t FROM documents),
  s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS s FROM n),
  raw AS (
    SELECT doc_id, unnest(regexp_extract_all(t, '\[([^\]]{{1,200}})\]\(([^)\s]{{1,200}})\)', 1)) AS a, 'ref' AS p, unnest(regexp_extract_all(t, '\[([^\]]{{1,200}})\]\(([^)\s]{{1,200}})\)', 2)) AS b FROM n
    UNION ALL SELECT doc_id, doc_id::VARCHAR, 'mentions', unnest(regexp_extract_all(t, '\[\[([^\]]{{1,200}})\]\]', 1)) FROM n
    UNION ALL SELECT doc_id, 'Note on ' || lang, 'defined_as', 'The ' || source || ' corpus is a set of ' || lang || ' texts.' FROM documents
    UNION ALL SELECT doc_id, regexp_extract(s, '^([A-Za-z0-9 _-]{{2,80}})\s+(is|are)\s+(.{{2,120}})[.?!]', 1), 'is', regexp_extract(s, '^([A-Za-z0-9 _-]{{2,80}})\s+(is|are)\s+(.{{2,120}})[.?!]', 3) FROM s
      WHERE regexp_matches(s, '^([A-Za-z0-9 _-]{{2,80}})\s+(is|are)\s+(.{{2,120}})[.?!]')),
  tr AS (SELECT * FROM (SELECT doc_id, {_label('a')} AS subject, p, {_label('b')} AS object FROM raw) WHERE subject <> '' AND object <> '' AND NOT (p = 'is' AND len(list_filter(string_split(subject, ' '), lambda w: w NOT IN ('a', 'an', 'and', 'or', 'the', 'it', 'they', 'this', 'that', 'these', 'those'))) = 0))"""
_EDGES = f"""e0 AS (SELECT DISTINCT doc_id, subject, p, object, 'n_' || {_fnv('subject')} AS src, 'n_' || {_fnv('object')} AS dst FROM tr),
  e AS (SELECT *, 'e_' || {_fnv("(src || chr(10) || p || chr(10) || dst || chr(10) || doc_id::VARCHAR)")} AS id FROM e0)"""
_LOG = f"""lg AS (SELECT *, 'e_' || {_fnv("(src || chr(10) || 'is' || chr(10) || dst || chr(10) || ev::VARCHAR)")} AS edge FROM (
    SELECT event_id, event_type, 'n' || (user_id % 50) AS src, 'n' || (event_id % 40) AS dst, event_id % 3 AS ev, epoch(date_trunc('second', ts))::BIGINT AS ts, 'a' || (event_id % 5) AS actor FROM events)),
  ad AS (SELECT edge, min(src) AS src, min(dst) AS dst, min(ev) AS ev, max({{'ts': ts, 'actor': actor}}) AS st FROM lg WHERE event_type IN ('click', 'view') GROUP BY edge),
  tb AS (SELECT edge, max({{'ts': ts, 'actor': actor}}) AS st FROM lg WHERE event_type = 'error' GROUP BY edge),
  live AS (SELECT ad.* FROM ad LEFT JOIN tb USING (edge) WHERE tb.st IS NULL OR tb.st <= ad.st)"""
_LIVE = """merged AS (
    SELECT doc_id::VARCHAR AS doc_id, text, CASE WHEN doc_id % 5 = 1 THEN 'New ' || source END AS heading, lang AS namespace FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id::VARCHAR, 'again ' || text, NULL, 'live' FROM documents WHERE doc_id % 10 = 0
    UNION ALL SELECT 'new-' || doc_id, source || ' fresh note', NULL, 'live' FROM documents WHERE doc_id % 5 = 2)"""
_MEM = rf"""m AS (SELECT conv_id || ':' || turn AS id, role AS kind, trim(regexp_replace({sql.normal('text')}, '\s+', ' ', 'g')) AS text,
    list_sort(CASE WHEN conv_id % 3 = 0 THEN [role, 'turn.' || turn, 'extra.' || role] ELSE [role, 'turn.' || turn] END) AS labels, 'chat.' || role AS namespace, 'conv ' || (conv_id % 10) AS source,
    (turn % 5)::DOUBLE / 4 AS importance, turn::BIGINT AS ts, 'c' || conv_id AS actor, CASE WHEN turn > 0 THEN 'follows>' || conv_id || ':' || (turn - 1) END AS links, conv_id, turn
  FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1))"""
_OVER = "CASE WHEN len({0}) = 0 THEN 0 ELSE len(list_intersect(['user', 'the', 'of'], {0}))::DOUBLE / 3 END"

ORACLES = {
    "graph_triples": f"WITH {_TRIPLES} SELECT doc_id AS doc_ord, subject, p, object, count(*) AS n FROM tr GROUP BY ALL",
    "graph_edges": f"WITH {_TRIPLES}, {_EDGES} SELECT id, src, p, dst, doc_id AS evidence FROM e",
    "graph_cap": f"WITH {_TRIPLES}, {_EDGES.replace('DISTINCT', '')} SELECT (SELECT count(DISTINCT id) FROM (SELECT id FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id) <= 2)) AS edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes",
    "graph_log_replay": f"WITH {_LOG} SELECT edge AS id, src, 'is' AS p, dst, ev::VARCHAR AS evidence, st.ts AS ts, st.actor AS actor FROM live",
    "graph_log_nodes": rf"""WITH {_LOG}, up AS (SELECT src AS id, arg_max(label, {{'ts': ts, 'actor': actor, 'l': label}}) AS label FROM (
        SELECT src, ts, actor, 'label ' || event_type || ' ' || (event_id % 7) AS label FROM lg WHERE event_type NOT IN ('click', 'view', 'error')) GROUP BY src)
        SELECT id, label FROM up UNION ALL SELECT id, id FROM (SELECT src AS id FROM live UNION SELECT dst FROM live) WHERE id NOT IN (SELECT id FROM up)""",
    "live_merge": f"WITH {_LIVE} SELECT doc_id, md5(text) AS text, heading, namespace FROM merged",
    "live_bm25": f"""WITH {_LIVE}, tok AS MATERIALIZED (SELECT doc_id AS block_id, {sql.tokens('text')} AS tokens FROM merged), {sql.POST}, {sql.LEX}, {sql.STATS}
        SELECT block_id AS doc_id, round(sum({sql.part()}), 6) AS score FROM (VALUES ('fresh'), ('note'), ('again')) q(term) JOIN post USING (term) JOIN lex USING (term) JOIN tok USING (block_id), st GROUP BY block_id""",
    "memory_replay": f"WITH {_MEM} SELECT id, kind, text, array_to_string(labels, '|') AS labels, namespace, source, importance, ts, actor, links FROM m",
    "memory_recall": f"""WITH {_MEM}, x AS (SELECT id, ts, {_OVER.format("string_split(text, ' ')")} AS lex, {_OVER.format('[kind]')} * 0.2::DOUBLE + {_OVER.format("string_split(replace(array_to_string(labels, ' '), '.', ' '), ' ')")} * 0.1::DOUBLE
          + {_OVER.format("string_split(replace(namespace, '.', ' '), ' ')")} * 0.15::DOUBLE + {_OVER.format("string_split(source, ' ')")} * 0.1::DOUBLE AS meta FROM m WHERE importance >= 0.25)
        SELECT id, round(lex * 0.45::DOUBLE + meta, 6) AS score, round(lex, 6) AS lexical_score, round(meta, 6) AS metadata_score FROM x WHERE lex + meta > 0 ORDER BY round(lex * 0.45::DOUBLE + meta, 9) DESC, ts DESC, id LIMIT 20""",
    "memory_browse": f"WITH {_MEM} SELECT id, ts, 0.45::DOUBLE AS score FROM m WHERE kind = 'user' AND conv_id % 3 = 0 AND ts >= 1 ORDER BY ts DESC, id LIMIT 15",
    "memory_consolidate": f"WITH {_MEM} SELECT ts, id AS doc_id, kind || ': ' || array_to_string(labels, '/') AS heading, 'memory.' || kind AS namespace, text FROM m WHERE 10 - ts >= 8",
    "memory_claim_ops": f"""WITH {_MEM}, t AS (
        SELECT {_label("'memory ' || id")} AS own, p, other, ts, actor FROM (
          SELECT id, 'mentions' AS p, {_label('l')} AS other, ts, actor FROM (SELECT *, unnest(labels) AS l FROM m)
          UNION ALL SELECT id, 'follows', {_label("'memory ' || conv_id || ':' || (turn - 1)")}, ts, actor FROM m WHERE links IS NOT NULL)),
      n AS (SELECT {_label("'memory ' || id")} AS own, {_label("'memory ' || id")} AS label, ts, actor FROM m UNION ALL SELECT own, other, ts, actor FROM t),
      u AS (SELECT label, min({{'t': ts, 'a': actor}}) AS s FROM n GROUP BY own, label), e AS (SELECT own, p, other, min({{'t': ts, 'a': actor}}) AS s FROM t GROUP BY own, p, other)
      SELECT 'upsert_node' AS op, 'n_' || {_fnv('label')} AS id, label, NULL::VARCHAR AS src, NULL::VARCHAR AS p, NULL::VARCHAR AS dst, s.t AS ts, s.a AS actor FROM u
      UNION ALL SELECT 'add_edge', NULL, NULL, 'n_' || {_fnv('own')}, p, 'n_' || {_fnv('other')}, s.t, s.a FROM e""",
    "label_normalize": r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_-]+', '.', 'g'), '.') AS label FROM documents",
    "label_prefix_match": "SELECT doc_id, source || '.' || lang AS label FROM documents WHERE source = 'src1' OR (source = 'src2' AND lang = 'en')",
    "route_select": """WITH s AS (SELECT s_nationkey::BIGINT AS d, 'agent-' || s_suppkey AS a, s_suppkey, round(s_acctbal, 0) AS score FROM supplier),
        pick AS (SELECT d, arg_max(s_suppkey, s_suppkey) AS top, arg_min(a, {'s': -score, 'a': a}) FILTER (s_suppkey % 3 = 0) AS best FROM s GROUP BY d)
        SELECT d AS decision_id, CASE WHEN top % 3 = 0 THEN 'agent-' || top ELSE coalesce(best, 'agent-3') END AS agent_id FROM pick""",
    "tool_policy": "SELECT event_id, CASE user_id % 3 WHEN 0 THEN event_type IN ('click', 'view') WHEN 1 THEN event_type NOT IN ('click', 'view') ELSE true END AS allowed FROM events",
    "routing_profile_lists": "SELECT doc_id, lang || '|' || source AS tags FROM documents",
}
ORACLES["memory_log_lines"] = ORACLES["memory_replay"]
ORACLES["graph_log_lines"] = ORACLES["graph_log_replay"]
ORACLES["graph_index"] = f"""WITH {_TRIPLES}, {_EDGES}, l AS (SELECT subject AS label, src AS id FROM e UNION SELECT object, dst FROM e), o AS (SELECT src AS id, md5(string_agg(id, ',' ORDER BY id)) AS leave FROM e GROUP BY src), r AS (SELECT dst AS id, md5(string_agg(id, ',' ORDER BY id)) AS reach FROM e GROUP BY dst)
    SELECT label, id, leave, reach FROM l LEFT JOIN o USING (id) LEFT JOIN r USING (id)"""
ORACLES["graph_one_hop"] = f"""WITH {_TRIPLES}, {_EDGES}, nodes AS (SELECT subject AS label, src AS id FROM e UNION SELECT object, dst FROM e),
    qs AS (SELECT query_id, q, {sql.tokens('q')} AS own FROM (VALUES (1, 'src3 note'), (2, 'guide src1'), (3, 'nothing here')) v(query_id, q)), each AS (SELECT query_id, unnest(list_distinct(own)) AS t FROM qs),
    near AS (SELECT query_id, id, min({{'k': k, 't': t, 'l': label}}) AS spot FROM (SELECT query_id, id, 0 AS k, '' AS t, label FROM each JOIN nodes ON t = label UNION ALL SELECT query_id, id, 1, t, label FROM each JOIN nodes ON starts_with(label, t)) GROUP BY query_id, id),
    seen AS (SELECT query_id, id FROM near QUALIFY spot.k = 0 OR row_number() OVER (PARTITION BY query_id ORDER BY spot) <= 24),
    words AS (SELECT query_id, src, e.id AS edge, {sql.tokens('n.label')} AS w FROM seen JOIN e ON e.src = seen.id AND p IN ('defined_as', 'is', 'mentions', 'ref') JOIN nodes n ON n.id = e.dst),
    fresh AS (SELECT query_id, term, min({{'s': src, 'e': edge, 'p': pos}}) AS spot FROM (SELECT query_id, src, edge, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words) f WHERE NOT EXISTS (SELECT 1 FROM each WHERE each.query_id = f.query_id AND each.t = f.term) GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY spot) <= 6)
    SELECT query_id::BIGINT AS query_id, trim(q || ' ' || coalesce((SELECT string_agg(term, ' ' ORDER BY term) FROM fresh WHERE fresh.query_id = qs.query_id), '')) AS q FROM qs"""
ORACLES["page_links"] = rf"""WITH m AS (SELECT page_id, regexp_replace(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', '[\2](\1)', 'g') AS t FROM pages),
    raw AS (SELECT page_id, unnest(regexp_extract_all(t, '\[([^\]]{{1,200}})\]\(([^)\s]{{1,200}})\)', 1)) AS a, unnest(regexp_extract_all(t, '\[([^\]]{{1,200}})\]\(([^)\s]{{1,200}})\)', 2)) AS b FROM m)
    SELECT page_id AS doc_ord, subject, object, count(*) AS n FROM (SELECT page_id, {_label('a')} AS subject, {_label('b')} AS object FROM raw) WHERE subject <> '' AND object <> '' GROUP BY ALL"""
_LIVE_INDEX = f"{_LIVE}, tok AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS block_id, doc_id, heading, namespace, text, {sql.tokens('text')} AS tokens FROM merged), {sql.POST}, {sql.LEX}, {sql.STATS}"
ORACLES["live_query"] = retrieval._lexical_sql(LIVE, prf=True, heading="coalesce(heading, '')", index_sql=_LIVE_INDEX, final=f", {retrieval.POOLED} SELECT query_id, n AS rank, doc_id, round(ks, 6) AS score FROM boosted JOIN (SELECT block_id, doc_id FROM tok) USING (block_id) WHERE n <= 10")
ORACLES["live_snapshot"] = f"WITH {_LIVE_INDEX} SELECT term, df, (SELECT count(*) FROM tok) AS blocks FROM lex"
_HASH64 = "lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::UHUGEINT)), lambda h, c: xor(h, c) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)).lower(), 16, '0')"
ORACLES["memory_input"] = rf"""WITH c AS (SELECT role AS kind, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, trim(regexp_replace({sql.normal('text')}, '\s+', ' ', 'g')) AS plain, turn, conv_id, 'c ' || conv_id AS actor FROM conversations)
    SELECT 'mem_' || {_HASH64.format("(kind || chr(1) || plain || chr(1) || turn || chr(1) || actor)")} AS id, kind, md5(t) AS text, 'chat|turn.' || turn AS labels, 'chat.log' AS namespace, 'conv ' || (conv_id % 10) AS source,
      greatest(0, least(1, (turn - 1) / 2.0::DOUBLE))::DOUBLE AS importance, NULL::DOUBLE AS confidence, turn::BIGINT AS ts, actor FROM c"""
