"""Property graph of entities and relations over DataFrames.

``nodes(entity_name, entity_type, description, source_ids)`` and
``edges(src, tgt, weight, description, source_ids, ord)`` with ``src <= tgt``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions.ids import edge_ends
from kinolake.functions.text import COMPLETE, FIELD_SEP, RECORD_END, TUPLE_END, clean_text, parse_weight, record_body, split_by_markers
from kinolake.functions.tokens import first_tokens, token_count
from kinolake.session import cut_lineage

UNKNOWN = '"UNKNOWN"'


# ---------------------------------------------------------------- extraction records


def parse_records(answers: DataFrame, chunk: str = "chunk_id", text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions in extraction answers.

    Entities: ``entity_name, entity_type, description, source_id, seq``; relations:
    ``src_id, tgt_id, weight, description, source_id, seq``. Names and types are in upper
    case before character references are replaced; records without brackets, with too
    few fields, of another kind, or with a blank name are left out. ``seq`` is the place
    in the answer.
    """
    records = answers.select(F.col(chunk).alias("source_id"), F.posexplode(split_by_markers(text, [RECORD_END, COMPLETE])).alias("seq", "_r"))
    fields = records.select("source_id", "seq", split_by_markers(record_body("_r"), [TUPLE_END]).alias("f")).filter(F.col("f").isNotNull())
    at = lambda i: F.get("f", F.lit(i))
    named = lambda i: clean_text(F.upper(at(i)))
    entities = fields.filter((F.size("f") >= 4) & (at(0) == '"entity"')).select(named(1).alias("entity_name"), named(2).alias("entity_type"), clean_text(at(3)).alias("description"), "source_id", "seq")
    relations = fields.filter((F.size("f") >= 5) & (at(0) == '"relationship"')).select(named(1).alias("src_id"), named(2).alias("tgt_id"), parse_weight(F.element_at("f", -1)).alias("weight"), clean_text(at(3)).alias("description"), "source_id", "seq")
    return entities.filter(F.trim("entity_name") != ""), relations


# ---------------------------------------------------------------- merging


def _texts(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), FIELD_SEP)


def merge_nodes(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One node a name: the most frequent type (ties: first seen, new before existing), distinct descriptions and sources, sorted.

    ``mentions`` has entity_name, entity_type, description, source_id, seq. Null names
    are left out. Counts are combined per (name, type) before the final grouping, and
    sets per partition, so a very frequent name moves few rows.
    """
    rows = mentions.filter(F.col("entity_name").isNotNull()).select("entity_name", "entity_type", "description", F.array("source_id").alias("source_ids"), F.struct(F.lit(0).alias("old"), F.col("seq").cast("bigint").alias("seq")).alias("_o"))
    if existing is not None:
        rows = rows.unionByName(existing.select("entity_name", "entity_type", "description", "source_ids", F.struct(F.lit(1).alias("old"), F.lit(0).cast("bigint").alias("seq")).alias("_o")))
    typed = rows.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.min("_o").alias("first"))
    order = F.struct(F.col("n").alias("n"), (-F.col("first.old")).alias("o"), (-F.col("first.seq")).alias("s"))
    types = typed.groupBy("entity_name").agg(F.max_by("entity_type", order).alias("entity_type"))
    described = rows.groupBy("entity_name").agg(_texts("description").alias("description"))
    sources = rows.select("entity_name", F.explode("source_ids").alias("_s")).groupBy("entity_name").agg(F.array_sort(F.collect_set("_s")).alias("source_ids"))
    return types.join(described, "entity_name").join(sources, "entity_name", "left").select("entity_name", "entity_type", "description", F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"))


def merge_edges(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One edge for each unordered pair: weights summed (the existing edge included), least order, distinct descriptions and sources.

    ``mentions`` has src_id, tgt_id, weight, description, source_id and optionally ord
    (default 1). Pairs with a null end are left out; self-loops stay.
    """
    src, tgt = edge_ends("src_id", "tgt_id")
    order = F.coalesce(F.col("ord"), F.lit(1)) if "ord" in mentions.columns else F.lit(1)
    usable = mentions.filter(F.col("src_id").isNotNull() & F.col("tgt_id").isNotNull())
    rows = usable.select(src.alias("src"), tgt.alias("tgt"), F.col("weight").cast("double").alias("weight"), "description", "source_id", order.cast("int").alias("ord"))
    sources = F.collect_set("source_id")
    if existing is not None:
        old = existing.select("src", "tgt", "weight", "description", "source_ids", F.coalesce("ord", F.lit(1)).alias("ord"))
        rows = rows.select("src", "tgt", "weight", "description", F.array("source_id").alias("source_ids"), "ord").unionByName(old)
        sources = F.array_distinct(F.flatten(F.collect_set("source_ids")))
    sums = rows.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"), _texts("description").alias("description"), F.array_sort(sources).alias("source_ids"))
    return sums.select("src", "tgt", "weight", "description", "source_ids", "ord")


def long_descriptions(rows: DataFrame, summarise, least: int = 500, most: int = 32_000, name: str = "entity_name") -> DataFrame:
    """Rows whose description has ``least`` tokens or more get the provider's summary of its parts (of the first ``most`` tokens)."""

    @F.pandas_udf("string")
    def short(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else summarise(n, t.split(FIELD_SEP)) for n, t in zip(names, texts)], dtype=object)

    tall = F.col("_n") >= least
    cut = F.when(tall, first_tokens("description", "_n", most))
    counted = rows.withColumn("_n", token_count("description")).withColumn("_s", short(F.col(name), cut))
    return counted.withColumn("description", F.when(tall, F.col("_s")).otherwise(F.col("description"))).select(*rows.columns)


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of type UNKNOWN for edge ends that no node has, with what their first edge (by ends) says."""
    ends = edges.select(F.col("src").alias("entity_name"), "src", "tgt", "description", "source_ids").unionByName(edges.select(F.col("tgt").alias("entity_name"), "src", "tgt", "description", "source_ids"))
    lost = ends.join(nodes.select("entity_name"), "entity_name", "left_anti")
    first = lost.groupBy("entity_name").agg(F.min_by(F.struct("description", "source_ids"), F.struct("src", "tgt")).alias("_f"))
    return first.select("entity_name", F.lit(UNKNOWN).alias("entity_type"), F.col("_f.description").alias("description"), F.col("_f.source_ids").alias("source_ids"))


# ---------------------------------------------------------------- lookups


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends: ``node, other, ...``; a self-loop appears twice."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    return edges.select(F.col("src").alias("node"), F.col("tgt").alias("other"), *rest).unionByName(edges.select(F.col("tgt").alias("node"), F.col("src").alias("other"), *rest))


def has_nodes(wanted: DataFrame, nodes: DataFrame, name: str = "entity_name") -> DataFrame:
    """The wanted names with ``found``."""
    known = nodes.select(F.col("entity_name").alias(name)).distinct().withColumn("_k", F.lit(True))
    return wanted.join(known, name, "left").withColumn("found", F.coalesce("_k", F.lit(False))).drop("_k")


def has_edges(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs, in either direction, with ``found``."""
    src, tgt = edge_ends(a, b)
    keyed = pairs.withColumn("src", src).withColumn("tgt", tgt)
    known = edges.select("src", "tgt").distinct().withColumn("_k", F.lit(True))
    return keyed.join(known, ["src", "tgt"], "left").withColumn("found", F.coalesce("_k", F.lit(False))).drop("_k", "src", "tgt")


def get_node(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("entity_name") == name)


def get_edge(edges: DataFrame, a: str, b: str) -> DataFrame:
    lo, hi = sorted((a, b))
    return edges.filter((F.col("src") == lo) & (F.col("tgt") == hi))


def node_edges(names: DataFrame, edges: DataFrame, name: str = "entity_name") -> DataFrame:
    """``entity_name, other`` of the edges at the given nodes, from either end."""
    around = both_ways(edges.select("src", "tgt"))
    return names.select(F.col(name).alias("node")).distinct().join(around, "node").select(F.col("node").alias("entity_name"), "other").distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    """``entity_name, degree``; a self-loop counts twice. Nodes without edges are not listed."""
    return both_ways(edges.select("src", "tgt")).groupBy(F.col("node").alias("entity_name")).agg(F.count("*").alias("degree"))


def edge_degree(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """``src, tgt, degree``: the sum of both ends' degrees, 0 for unknown ends."""
    degrees = node_degree(edges) if degrees is None else degrees
    one = degrees.select(F.col("entity_name").alias("src"), F.col("degree").alias("_a"))
    two = degrees.select(F.col("entity_name").alias("tgt"), F.col("degree").alias("_b"))
    return edges.select("src", "tgt").join(one, "src", "left").join(two, "tgt", "left").select("src", "tgt", (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("degree"))


def stable_order(edges: DataFrame) -> DataFrame:
    """Edges with their place in the order of ``src -> tgt``."""
    return edges.withColumn("label", F.concat_ws(" -> ", "src", "tgt")).orderBy("label")


# ---------------------------------------------------------------- analytics


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``entity_name, component`` (the smallest name in it).

    Alternates hooking every node to the smallest root around it with pointer jumping, so
    the rounds grow with the logarithm of the diameter. Pairs are deduplicated before
    each shuffle; lineage is cut by a checkpoint in the shared folder.
    """
    pairs = cut_lineage(both_ways(edges.select("src", "tgt")).filter(F.col("node").isNotNull() & F.col("other").isNotNull()).distinct())
    labels = cut_lineage(pairs.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("root")))
    for _ in range(max_rounds):
        around = pairs.join(labels.select(F.col("node").alias("other"), F.col("root").alias("_r")), "other").groupBy("node").agg(F.min("_r").alias("_r"))
        hooked = labels.join(around, "node").select("node", "root", F.least("root", "_r").alias("_best"))
        roots = hooked.groupBy(F.col("root").alias("_root")).agg(F.min("_best").alias("_to"))
        moved = hooked.join(roots, hooked["root"] == roots["_root"]).select("node", F.col("root").alias("_old"), F.least("_best", "_to").alias("_new"))
        jump = moved.select(F.col("node").alias("_at"), F.col("_new").alias("_far"))
        jumped = moved.join(jump, moved["_new"] == jump["_at"], "left").select("node", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("root"))
        jumped = cut_lineage(jumped)
        changed = jumped.filter(F.col("_old") != F.col("root")).limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels.select(F.col("node").alias("entity_name"), F.col("root").alias("component"))
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names in the component with most nodes (ties: the smallest name), in upper case, stripped, references replaced, ordered."""
    found = components(edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1)
    named = found.join(F.broadcast(best), "component").select("entity_name")
    return named.join(nodes.select("entity_name"), "entity_name", "left_semi").select(clean_text(F.upper("entity_name")).alias("entity_name")).distinct().orderBy("entity_name")


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """``entity_name, cluster``: weighted label propagation (an extension in place of hierarchical clustering).

    Every node takes the label with the greatest weight around it, its own included;
    ties: the smaller label. Nodes alternate by a hash, which keeps pairs from swapping.
    """
    around = cut_lineage(both_ways(edges.select("src", "tgt", "weight")).filter(F.col("node") != F.col("other")).groupBy("node", "other").agg(F.sum("weight").alias("w")))
    labels = cut_lineage(around.select("node").distinct().withColumn("label", F.col("node")))
    for k in range(rounds):
        seen = around.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = seen.groupBy("node").agg(F.min_by("label", F.struct((-F.round("w", 9)).alias("w"), F.col("label").alias("l"))).alias("_b"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        labels = cut_lineage(labels.join(best, "node", "left").select("node", F.when(turn & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("label")).alias("label")))
    return labels.select(F.col("node").alias("entity_name"), F.col("label").alias("cluster"))


def hierarchical_communities(edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """``entity_name, level, cluster``: communities of communities, level 0 the coarsest.

    Label propagation on the graph, then on the graph of its clusters with summed weights,
    until nothing merges any more or ``levels`` are reached. A cluster lies wholly in one
    of the level above. An extension in place of a modularity optimiser.
    """
    found, current, of = [], edges.select("src", "tgt", "weight"), None
    for _ in range(levels):
        labels = cut_lineage(communities(current, rounds))
        moved = labels.filter(F.col("entity_name") != F.col("cluster")).limit(1).count()
        if of is not None and not moved:
            break
        of = labels if of is None else cut_lineage(of.join(labels.select(F.col("entity_name").alias("cluster"), F.col("cluster").alias("_c")), "cluster", "left").select("entity_name", F.coalesce("_c", "cluster").alias("cluster")))
        found.append(of)
        a, b = labels.select(F.col("entity_name").alias("src"), F.col("cluster").alias("_a")), labels.select(F.col("entity_name").alias("tgt"), F.col("cluster").alias("_b"))
        src, tgt = edge_ends("_a", "_b")
        joined = current.join(a, "src").join(b, "tgt").filter(F.col("_a") != F.col("_b"))
        current = cut_lineage(joined.select(src.alias("src"), tgt.alias("tgt"), "weight").groupBy("src", "tgt").agg(F.sum("weight").alias("weight")))
        if current.isEmpty():
            break
    out = None
    for level, one in enumerate(reversed(found)):
        part = one.select("entity_name", F.lit(level).alias("level"), "cluster")
        out = part if out is None else out.unionByName(part)
    return out


ALGORITHMS = {
    "hierarchical": hierarchical_communities,
    "flat": lambda edges, **kw: communities(edges, **kw).select("entity_name", F.lit(0).alias("level"), "cluster"),
    "components": lambda edges, **kw: components(edges, **kw).select("entity_name", F.lit(0).alias("level"), F.col("component").alias("cluster")),
}


def cluster(edges: DataFrame, algorithm: str = "hierarchical", **options) -> DataFrame:
    """``entity_name, level, cluster`` by a named algorithm; an unknown name is an error."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"clustering algorithm {algorithm!r} is not one of {sorted(ALGORITHMS)}")
    return ALGORITHMS[algorithm](edges, **options)


def level_counts(members: DataFrame) -> DataFrame:
    """``level, n_clusters, n_nodes``."""
    return members.groupBy("level").agg(F.countDistinct("cluster").alias("n_clusters"), F.countDistinct("entity_name").alias("n_nodes"))


def community_report(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``level, cluster, n_nodes, n_edges, n_chunks, occurrence`` of clusters (``entity_name, level, cluster``).

    Edges are those with at least one end in the cluster; ``occurrence`` is the number of
    chunks over the greatest number of chunks of any cluster.
    """
    inside = members.join(nodes.select("entity_name", "source_ids"), "entity_name")
    sizes = inside.groupBy("level", "cluster").agg(F.count("*").alias("n_nodes"))
    chunks = inside.select("level", "cluster", F.explode("source_ids").alias("_s")).distinct().groupBy("level", "cluster").agg(F.count("*").alias("n_chunks"))
    touching = members.join(both_ways(edges.select("src", "tgt")).withColumnRenamed("node", "entity_name"), "entity_name")
    lo, hi = edge_ends("entity_name", "other")
    n_edges = touching.select("level", "cluster", lo.alias("a"), hi.alias("b")).distinct().groupBy("level", "cluster").agg(F.count("*").alias("n_edges"))
    out = sizes.join(chunks, ["level", "cluster"], "left").join(n_edges, ["level", "cluster"], "left").na.fill(0, ["n_chunks", "n_edges"])
    most = F.max("n_chunks").over(Window.partitionBy(F.lit(1)))
    return out.select("level", "cluster", "n_nodes", "n_edges", "n_chunks", F.when(most > 0, F.col("n_chunks") / most).otherwise(0.0).alias("occurrence"))


def sub_communities(members: DataFrame) -> DataFrame:
    """``parent, child``: clusters of the next level whose nodes all lie in the parent.

    A containment join by counts: shared nodes of both are counted and compared with the
    child's size; sets are never gathered.
    """
    sizes = members.groupBy(F.col("level").alias("_l"), F.col("cluster").alias("child")).agg(F.count("*").alias("n"))
    up = members.select("entity_name", F.col("level").alias("_p"), F.col("cluster").alias("parent"))
    down = members.select("entity_name", F.col("level").alias("_l"), F.col("cluster").alias("child"))
    shared = up.join(down, "entity_name").filter(F.col("_l") == F.col("_p") + 1).groupBy("_l", "parent", "child").agg(F.count("*").alias("s"))
    return shared.join(sizes, ["_l", "child"]).filter(F.col("s") == F.col("n")).select(F.col("_l").alias("level"), "parent", "child")


def attach_clusters(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with their clusters by level; an empty array for nodes without."""
    grouped = members.groupBy("entity_name").agg(F.array_sort(F.collect_list(F.struct("level", "cluster"))).alias("clusters"))
    return nodes.join(grouped, "entity_name", "left").withColumn("clusters", F.coalesce("clusters", F.array().cast("array<struct<level:int,cluster:string>>")))


def node_vectors(edges: DataFrame, dim: int = 16, rounds: int = 2) -> DataFrame:
    """``entity_name, embedding``: random projections of the neighbourhood (an extension in place of random walks).

    Each node starts from a vector made of its name's hash and repeatedly averages its
    neighbours' by weight; results are of length 1.
    """

    @F.pandas_udf("array<double>")
    def start(names: pd.Series) -> pd.Series:
        return names.map(lambda n: np.random.default_rng(int.from_bytes(n.encode()[:8].ljust(8, b"\0"), "little") ^ hash_of(n)).normal(size=dim))

    around = both_ways(edges.select("src", "tgt", "weight")).groupBy("node", "other").agg(F.sum("weight").alias("w"))
    around = cut_lineage(around)
    current = cut_lineage(around.select("node").distinct().withColumn("v", start("node")))
    for _ in range(rounds):
        moved = around.join(current.withColumnRenamed("node", "other"), "other")
        sums = [F.sum(F.col("w") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)]
        mixed = moved.groupBy("node").agg(*sums).select("node", F.array(*[f"s{i}" for i in range(dim)]).alias("_n"))
        norm = F.sqrt(F.aggregate("_n", F.lit(0.0), lambda s, x: s + x * x))
        both = mixed.withColumn("_n", F.transform("_n", lambda x: x / F.greatest(norm, F.lit(1e-12)))).join(current, "node")
        current = cut_lineage(both.select("node", F.zip_with("v", "_n", lambda a, b: a * 0.3 + b).alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return current.select(F.col("node").alias("entity_name"), F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("embedding"))


def hash_of(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


# ---------------------------------------------------------------- expansion


def node_sources(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``entity_name, source_id``: the sources of every name, each once.

    The relational form of ``source_ids``: for names that occur in a large part of all
    chunks use this table and leave the array to display.
    """
    rows = mentions.filter(F.col("entity_name").isNotNull()).select("entity_name", "source_id")
    if existing is not None:
        rows = rows.unionByName(existing.select("entity_name", F.explode("source_ids").alias("source_id")))
    return rows.distinct()


def related_chunks(seeds: DataFrame, sources: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """``chunk_id, seed_rank, relation_count``: the seeds' chunks that share most one-hop relations.

    ``seeds`` has entity_name and rank (few rows, one question); ``sources`` has
    entity_name and source_id, in which rows may repeat, as edges may. For each chunk of a seed the edges are counted whose other end also
    has that chunk; a chunk belongs to the first seed that has it. Order: count
    descending, seed rank, chunk id.
    """
    chunks = seeds.join(sources, "entity_name").select("entity_name", "rank", F.col("source_id").alias("chunk_id"))
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("rank", "entity_name")).alias("_f")).select("chunk_id", F.col("_f.rank").alias("seed_rank"), F.col("_f.entity_name").alias("entity_name"))
    shared = node_edges(seeds, edges).join(sources.select(F.col("entity_name").alias("other"), F.col("source_id").alias("chunk_id")), "other").select("entity_name", "chunk_id", "other").distinct()
    counts = first.join(shared, ["entity_name", "chunk_id"], "left").groupBy("chunk_id", "seed_rank").agg(F.count("other").alias("relation_count"))
    return counts.orderBy(F.desc("relation_count"), "seed_rank", "chunk_id").limit(k)


def chunk_segments(chunks: DataFrame, table: DataFrame, chunk: str = "chunk_id", segments: str = "video_segment_id") -> DataFrame:
    """Distinct segment ids of the chunks; missing chunks and null lists give none."""
    return chunks.select(chunk).join(table.select(chunk, segments), chunk).select(F.explode(segments).alias("segment_id")).distinct()
