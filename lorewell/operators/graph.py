"""Claim graph: extraction, operation log, replay and one-hop query expansion.

``edges`` id, src, p, dst, evidence; ``nodes`` id, label, props.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Graph as GraphOptions
from ..shared import checkpointed

STOPWORDS = ("a", "an", "and", "or", "the", "it", "they", "this", "that", "these", "those")
DEFINITION = r"^([A-Za-z0-9 _-]{2,80})\s+(is|are)\s+(.{2,120})[.?!]"
LINK = r"\[([^\]]{1,200})\]\(([^)\s]{1,200})\)"
WIKI = r"\[\[([^\]]{1,200})\]\]"
HEADING = r"(?m)^(#{1,3})\s+(.+)$"
OPS = "op string, id string, label string, props map<string,string>, src string, p string, dst string, evidence array<bigint>, edge_id string, ts bigint, actor string"


def node_id(label: Column) -> Column:
    return F.concat(F.lit("n_"), T.fnv32(label))


def canonical(evidence: Column) -> Column:
    """Distinct, sorted, without negative numbers; an absent list is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(evidence, F.array().cast("array<bigint>")), lambda x: x >= 0)))


def edge_id(src: Column, p: Column, dst: Column, evidence: Column) -> Column:
    return F.concat(F.lit("e_"), T.fnv32(F.concat_ws("\n", src, p, dst, F.array_join(evidence.cast("array<string>"), ","))))


def triples(docs: DataFrame) -> DataFrame:
    """(doc_ord, subject, p, object) normalized labels, with repeats, from ``docs(doc_ord, doc_id, heading, text)``.

    ``text`` is the raw one: markup is what links and headings are read from.
    """
    name = F.coalesce(F.when(F.col("doc_id") != "", F.col("doc_id")), F.when(F.col("heading") != "", F.col("heading")), F.concat(F.lit("doc_"), F.col("doc_ord").cast("string")))
    base = docs.select("doc_ord", "text", name.alias("name"))

    def pairs(pattern: str, first: int, second: int) -> Column:
        return F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), first).alias("a"), F.regexp_extract_all("text", F.lit(pattern), second).alias("b"))

    links = base.select("doc_ord", F.explode(pairs(LINK, 1, 2)).alias("m")).select("doc_ord", F.col("m.a").alias("a"), F.lit("ref").alias("p"), F.col("m.b").alias("b"))
    wiki = base.select("doc_ord", F.col("name").alias("a"), F.lit("mentions").alias("p"), F.explode(F.regexp_extract_all("text", F.lit(WIKI), 1)).alias("b"))
    # What follows a heading starts behind its own line, wherever in the text the same heading stood before.
    cut = F.split(F.regexp_replace("text", HEADING, "\u0001$2\u0002"), "\u0001")
    rest = F.array_join(F.slice("cut", F.col("n") + 2, F.size("cut")), "\n# ")
    heads = base.select("doc_ord", cut.alias("cut")).select("doc_ord", "cut", F.posexplode("cut").alias("n", "x")).where("n > 0").select("doc_ord", F.split("x", "\u0002").alias("h"), rest.alias("rest"))
    after = F.concat(F.coalesce(F.get("h", F.lit(1)), F.lit("")), F.when(F.col("rest") != "", F.concat(F.lit("\n# "), F.col("rest"))).otherwise(""))
    tail = T.opening(F.regexp_replace(F.regexp_replace(after, r"^[^\n]*\n+", ""), r"^\s+", ""))
    defined = heads.select("doc_ord", F.col("h")[0].alias("a"), F.lit("defined_as").alias("p"), F.substring(F.coalesce(tail, F.lit("")), 1, 240).alias("b"))
    said = base.select("doc_ord", F.explode(T.sentences("text")).alias("s")).where(F.col("s").rlike(DEFINITION))
    said = said.select("doc_ord", F.regexp_extract("s", DEFINITION, 1).alias("a"), F.lit("is").alias("p"), F.regexp_extract("s", DEFINITION, 3).alias("b"))

    out = links.unionByName(wiki).unionByName(defined).unionByName(said)
    out = out.select("doc_ord", T.claim_label("a").alias("subject"), "p", T.claim_label("b").alias("object"))
    stop = F.forall(F.split("subject", r"\s+"), lambda w: w.isin(*STOPWORDS))
    return out.where((F.col("subject") != "") & (F.col("object") != "") & ~((F.col("p") == "is") & stop))


def build(docs: DataFrame, max_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). The cap counts each document's edges by id; nodes of edges beyond it stay.

    Ids have 32 bits, so in a large corpus some are met twice: every label keeps a node
    and every claim an edge, whether or not another one has its id.
    """
    found = triples(docs).withColumn("src", node_id(F.col("subject"))).withColumn("dst", node_id(F.col("object")))
    found = found.withColumn("evidence", F.array(F.col("doc_ord").cast("long"))).withColumn("id", edge_id(F.col("src"), F.col("p"), F.col("dst"), F.col("evidence")))
    found = checkpointed(found)  # nodes and edges are both of it, and texts are taken apart once
    ends = F.array(*(F.struct(F.col(i).alias("id"), F.col(n).alias("label")) for i, n in (("src", "subject"), ("dst", "object"))))
    nodes = found.select(F.inline(ends)).distinct()
    by_id, claim = Window.partitionBy("doc_ord").orderBy("id", "subject", "p", "object"), F.struct("subject", "p", "object")
    numbered = found.withColumn("n", F.row_number().over(by_id)).withColumn("again", F.coalesce(F.lag(claim).over(by_id) == claim, F.lit(False)))
    edges = numbered.where((F.col("n") <= max(1, max_edges)) & ~F.col("again")).select("id", "src", "p", "dst", "evidence")
    return nodes, edges


def index(graph: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(label, id) with the greatest id of a label, and the adjacency by source and by target."""
    nodes, edges = graph
    return (nodes.groupBy("label").agg(F.max("id").alias("id")), *adjacency(edges))


def problems(graph: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, id) of what is wrong with a graph: repeated ids, nodes or edges without a name, ends that are no nodes, evidence that isn't sorted and distinct."""
    nodes, edges = graph
    repeated = lambda df, kind: df.groupBy("id").count().where("count > 1").select(F.lit(kind).alias("kind"), "id")
    blank = nodes.where("id is null or id = '' or label is null or label = ''").select(F.lit("unnamed node").alias("kind"), "id")
    nameless = edges.where("id is null or id = '' or p is null or p = '' or src is null or dst is null").select(F.lit("unnamed edge").alias("kind"), "id")
    ends = edges.select("id", F.explode(F.array("src", "dst")).alias("end"))
    loose = ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti").select(F.lit("loose end").alias("kind"), "id").distinct()
    untidy = edges.where(canonical(F.col("evidence")) != F.coalesce("evidence", F.array().cast("array<bigint>"))).select(F.lit("evidence").alias("kind"), "id")
    return repeated(nodes, "repeated node").unionByName(repeated(edges, "repeated edge")).unionByName(blank).unionByName(nameless).unionByName(loose).unionByName(untidy)


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sorted edge ids by source and by target."""
    side = lambda c: edges.groupBy(F.col(c).alias("id")).agg(F.array_sort(F.collect_list("id")).alias("edges"))
    return side("src"), side("dst")


def stamp(ts: Column | str = "ts", actor: Column | str = "actor") -> Column:
    return F.struct(F.col(ts).alias("ts") if isinstance(ts, str) else ts.alias("ts"), F.col(actor).alias("actor") if isinstance(actor, str) else actor.alias("actor"))


def merge_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def replay(log: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all operations, whatever their order of arrival.

    Latest stamp (ts, actor) wins for nodes; an edge goes if a tombstone is
    strictly later than its last addition; base edges are older than any stamp;
    missing ends of edges become nodes named by their id.
    """
    spark = log.sparkSession
    empty = spark.createDataFrame([], "id string, label string, props map<string,string>")
    base_nodes = empty if nodes is None else nodes.select("id", "label", F.col("props") if "props" in nodes.columns else F.lit(None).cast("map<string,string>").alias("props"))
    up = log.where("op = 'upsert_node'").withColumn("label", T.claim_label("label"))
    up = up.withColumn("id", F.coalesce(F.when(F.col("id") != "", F.col("id")), node_id(F.col("label"))))
    order = F.struct("ts", "actor", F.concat_ws("|", "id", "label", F.to_json("props")))
    latest = up.groupBy("id").agg(F.max_by(F.struct("label", "props"), order).alias("v")).select("id", "v.label", "v.props")
    all_nodes = base_nodes.join(latest.select("id"), "id", "left_anti").unionByName(latest)

    adds = log.where("op = 'add_edge'").withColumn("evidence", canonical(F.col("evidence")))
    adds = adds.withColumn("edge", edge_id(F.col("src"), F.col("p"), F.col("dst"), F.col("evidence")))
    adds = adds.select(F.col("edge").alias("id"), "src", "p", "dst", "evidence", stamp().alias("added"))
    if edges is not None:
        adds = adds.unionByName(edges.select("id", "src", "p", "dst", canonical(F.col("evidence")).alias("evidence"), F.lit(None).cast("struct<ts:bigint,actor:string>").alias("added")))
    merged = adds.groupBy("id").agg(F.min("src").alias("src"), F.min("p").alias("p"), F.min("dst").alias("dst"), canonical(F.flatten(F.collect_list("evidence"))).alias("evidence"), F.max("added").alias("added"))
    tombs = log.where("op = 'tombstone_edge'").groupBy(F.col("edge_id").alias("id")).agg(F.max(stamp()).alias("tomb"))
    live = merged.join(tombs, "id", "left").where(F.col("tomb").isNull() | (F.col("added").isNotNull() & (F.col("tomb") <= F.col("added"))))
    live = live.select("id", "src", "p", "dst", "evidence", F.col("added.ts").alias("ts"), F.col("added.actor").alias("actor"))
    ends = live.select(F.col("src").alias("id")).union(live.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(all_nodes.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"), F.lit(None).cast("map<string,string>").alias("props"))
    return all_nodes.unionByName(missing), live


def expansion(graph: tuple[DataFrame, DataFrame], queries: DataFrame, options: GraphOptions = GraphOptions()) -> DataFrame:
    """(query_id, term): words of nodes one hop from those that the query names, at most ``max_extra_terms``."""
    nodes, edges = graph
    per = Window.partitionBy("query_id")
    tokens = queries.select("query_id", F.array_distinct(T.tokenize("q")).alias("own"))
    each = tokens.select("query_id", F.explode("own").alias("token"))
    labels = nodes.groupBy("label").agg(F.max("id").alias("id"))
    # Whole labels first, then labels by token and label. Labels are cut to the lengths that tokens have, which makes the prefix join an equi-join.
    exact = each.join(labels, F.col("token") == F.col("label")).select("query_id", F.lit(0).alias("k"), F.lit("").alias("token"), "label", "id")
    sizes = [r["n"] for r in each.select(F.length("token").alias("n")).where("n <= 200").distinct().collect()]  # a label has at most 200 characters
    cut = F.filter(F.array(*(F.when(F.length("label") >= n, F.substring("label", 1, n)) for n in sorted(sizes)), F.lit(None).cast("string")), lambda x: x.isNotNull())
    near = each.join(labels.select("label", "id", F.explode(cut).alias("token")), "token").select("query_id", F.lit(1).alias("k"), "token", "label", "id")
    seen = exact.unionByName(near).groupBy("query_id", "id").agg(F.min(F.struct("k", "token", "label")).alias("at"))
    # Whole labels always count; prefixes fill up to the cap.
    seen = seen.withColumn("n", F.row_number().over(per.orderBy("at"))).where((F.col("at.k") == 0) | (F.col("n") <= options.max_extra_terms * 4))
    predicates = [p for p in options.predicates]
    hop = seen.select("query_id", F.col("id").alias("src")).join(edges.where(F.lower("p").isin(*[p.lower() for p in predicates])).select(F.col("id").alias("edge"), "src", "dst"), "src")
    target = hop.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("target")), "dst").withColumn("words", T.tokenize("target"))
    words = target.select("query_id", "src", "edge", F.posexplode("words").alias("pos", "term")).join(tokens, "query_id")
    fresh = words.where(~F.array_contains("own", F.col("term"))).groupBy("query_id", "term").agg(F.min(F.struct("src", "edge", "pos")).alias("at"))
    return fresh.withColumn("n", F.row_number().over(per.orderBy("at"))).where(F.col("n") <= options.max_extra_terms).select("query_id", "term")


def expand_queries(graph: tuple[DataFrame, DataFrame], queries: DataFrame, options: GraphOptions = GraphOptions()) -> DataFrame:
    """``queries`` with the extra words, sorted, behind each q."""
    extra = expansion(graph, queries, options).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("extra"))
    return queries.join(extra, "query_id", "left").withColumn("q", F.trim(F.concat_ws(" ", "q", "extra"))).drop("extra")
