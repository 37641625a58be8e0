"""Queries on the property graph; mentions and relations are derived from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.operators import graph, providers, resolve
from kinolake.plans.base import table
from kinolake.session import cut_lineage


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as entities, their types as entity types, orders as sources."""
    lines, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    joined = lines.select("l_partkey", "l_orderkey", "l_linenumber").join(parts.select("p_partkey", "p_brand", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.upper("p_brand").alias("entity_name"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and parts as ends, quantities as weights."""
    lines = table(spark, folder, "lineitem")
    return lines.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("src_id"), F.concat(F.lit("P"), F.col("l_partkey")).alias("tgt_id"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").alias("ord"))


def brand_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merge_nodes(mentions(spark, folder))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merge_edges(relations(spark, folder))


def nation_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that trade: customers' and suppliers' nations of the same order line, weighted by lines."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customers, suppliers = table(spark, folder, "customer"), table(spark, folder, "supplier")
    one = lines.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = one.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return one.select(F.concat(F.lit("N"), "c_nationkey").alias("src_id"), F.concat(F.lit("N"), "s_nationkey").alias("tgt_id"), F.lit(1.0).alias("weight"), F.lit("trade").alias("description"), F.col("l_orderkey").cast("string").alias("source_id"))


def merge_nodes(spark, folder):
    return brand_nodes(spark, folder).select("entity_name", "entity_type", "description", F.array_join("source_ids", ",").alias("source_ids"))


def merge_edges(spark, folder):
    return edges(spark, folder).select("src", "tgt", "weight", "description", F.array_join("source_ids", ",").alias("source_ids"), "ord")


def missing_endpoints(spark, folder):
    known = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"))
    lost = graph.missing_endpoints(edges(spark, folder), known)
    return lost.select("entity_name", "entity_type", "description", F.array_join("source_ids", ",").alias("source_ids"))


def node_degree(spark, folder):
    return graph.node_degree(edges(spark, folder))


def edge_degree(spark, folder):
    return graph.edge_degree(edges(spark, folder))


def node_edges(spark, folder):
    """The edges at all suppliers."""
    suppliers = table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"))
    return graph.node_edges(suppliers, edges(spark, folder))


def edge_lookup(spark, folder):
    """Pairs in both directions, some of which exist."""
    asked = table(spark, folder, "part").select(F.concat(F.lit("P"), "p_partkey").alias("a"), F.concat(F.lit("S"), F.col("p_partkey") % 100 + 1).alias("b"))
    return graph.has_edges(asked, edges(spark, folder))


def largest_component(spark, folder):
    """Suppliers and parts linked by order lines."""
    links = relations(spark, folder).select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt")).distinct()
    names = links.select(F.col("src").alias("entity_name")).union(links.select("tgt")).distinct()
    return graph.largest_component(names, links)


def components(spark, folder):
    """Chains of orders of one customer, linked one to the next."""
    orders = table(spark, folder, "orders")
    links = orders.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("tgt"))
    return graph.components(links)


def communities(spark, folder):
    return graph.communities(graph.merge_edges(nation_edges(spark, folder)))


def node_vectors(spark, folder):
    out = graph.node_vectors(graph.merge_edges(nation_edges(spark, folder)), dim=8)
    return out.select("entity_name", F.array_join(F.transform("embedding", lambda v: F.round(v, 6).cast("string")), ",").alias("embedding"))


def _members(spark, folder) -> DataFrame:
    """Two levels of clusters of suppliers: regions, and nations within them."""
    suppliers, nations = table(spark, folder, "supplier"), table(spark, folder, "nation")
    one = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("S"), F.col("s_suppkey"))
    return one.select(name.alias("entity_name"), F.lit(0).alias("level"), F.concat(F.lit("R"), "n_regionkey").alias("cluster")).union(one.select(name, F.lit(1), F.concat(F.lit("N"), "n_nationkey")))


def community_stats(spark, folder):
    nodes = relations(spark, folder).groupBy(F.col("src_id").alias("entity_name")).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return graph.community_report(_members(spark, folder), nodes, edges(spark, folder))


def sub_communities(spark, folder):
    return graph.sub_communities(_members(spark, folder))


def related_segments(spark, folder):
    """Five seed suppliers; orders stand for chunks."""
    rel = relations(spark, folder)
    sources = rel.select(F.col("src_id").alias("entity_name"), "source_id").union(rel.select("tgt_id", "source_id"))
    seeds = table(spark, folder, "supplier").filter("s_suppkey BETWEEN 1 AND 5").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"), F.col("s_suppkey").cast("int").alias("rank"))
    links = rel.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"))  # only the pairs matter, so nothing is merged
    return graph.related_chunks(seeds, sources, links, 8)


def entity_mentions(spark, folder):
    """Entities parsed from extraction records that the stand-in makes of the documents, merged."""
    names = F.pandas_udf(lambda s: s.map(providers.name_extractor), "string")
    answers = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), names("text").alias("answer"))
    found, _ = graph.parse_records(answers)
    merged = graph.merge_nodes(cut_lineage(found))  # texts are extracted from once
    return merged.select("entity_name", "entity_type", F.size("source_ids").alias("n_sources"))


def entity_resolution(spark, folder):
    """Names of parts, the market segments' runs standing for graphs."""
    parts = table(spark, folder, "part")
    rows = parts.select((F.col("p_size") % 5).cast("string").alias("run"), F.col("p_partkey").alias("chunk_order"), F.lit(0).alias("seq"), F.col("p_name").alias("entity_name"), F.col("p_type").alias("description"))
    return resolve.resolve(rows, "run", providers.hash_embedder(32))


QUERIES = (
    merge_nodes, merge_edges, missing_endpoints, node_degree, edge_degree, node_edges, edge_lookup, largest_component, components, communities,
    node_vectors, community_stats, sub_communities, related_segments, entity_mentions, entity_resolution,
)

_REL = """rel AS (SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b, l_quantity AS w, l_returnflag AS d, CAST(l_orderkey AS VARCHAR) AS s, l_linenumber AS o FROM lineitem),
    edges AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, sum(w) AS weight, string_agg(DISTINCT d, '<SEP>' ORDER BY d) AS description,
              string_agg(DISTINCT s, ',' ORDER BY s) AS source_ids, CAST(min(o) AS INTEGER) AS ord FROM rel GROUP BY 1, 2),
    ways AS (SELECT src AS node, tgt AS other, description, source_ids, src, tgt FROM edges UNION ALL SELECT tgt, src, description, source_ids, src, tgt FROM edges),
    deg AS (SELECT node AS entity_name, count(*) AS degree FROM ways GROUP BY 1)"""

SQL = {
    "merge_nodes": """
        WITH m AS (SELECT upper(p_brand) AS entity_name, p_type AS entity_type, p_name AS description, CAST(l_orderkey AS VARCHAR) AS source_id, l_orderkey * 10 + l_linenumber AS seq
                   FROM lineitem JOIN part ON l_partkey = p_partkey),
        t AS (SELECT entity_name, entity_type, count(*) AS n, min(seq) AS s FROM m GROUP BY 1, 2),
        k AS (SELECT entity_name, entity_type FROM t QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, s) = 1)
        SELECT k.entity_name, k.entity_type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids
        FROM k JOIN m ON m.entity_name = k.entity_name GROUP BY 1, 2""",
    "merge_edges": f"WITH {_REL} SELECT src, tgt, weight, description, source_ids, ord FROM edges",
    "missing_endpoints": f"""
        WITH {_REL}, known AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0)
        SELECT node AS entity_name, '"UNKNOWN"' AS entity_type, description, source_ids FROM ways WHERE node NOT IN (SELECT node FROM known)
        QUALIFY row_number() OVER (PARTITION BY node ORDER BY src, tgt) = 1""",
    "node_degree": f"WITH {_REL} SELECT entity_name, degree FROM deg",
    "edge_degree": f"WITH {_REL} SELECT src, tgt, coalesce(x.degree, 0) + coalesce(y.degree, 0) AS degree FROM edges LEFT JOIN deg x ON x.entity_name = src LEFT JOIN deg y ON y.entity_name = tgt",
    "node_edges": f"WITH {_REL} SELECT DISTINCT node AS entity_name, other FROM ways WHERE node IN (SELECT 'S' || s_suppkey FROM supplier)",
    "edge_lookup": f"""
        WITH {_REL}, asked AS (SELECT 'P' || p_partkey AS a, 'S' || (p_partkey % 100 + 1) AS b FROM part)
        SELECT a, b, EXISTS (SELECT 1 FROM edges WHERE src = least(asked.a, asked.b) AND tgt = greatest(asked.a, asked.b)) AS found FROM asked""",
    "largest_component": f"""
        WITH RECURSIVE {_REL}, links AS (SELECT DISTINCT node, other FROM ways), seen AS (SELECT DISTINCT a AS start, a AS node FROM rel UNION SELECT seen.start, links.other FROM seen JOIN links ON links.node = seen.node),
        best AS (SELECT start FROM seen GROUP BY 1 ORDER BY count(*) DESC, min(node) LIMIT 1)
        SELECT DISTINCT upper(node) AS entity_name FROM seen WHERE start = (SELECT start FROM best)""",
    "components": """
        SELECT 'C' || o_custkey AS entity_name, 'C' || o_custkey AS component FROM orders GROUP BY ALL
        UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders""",
    "community_stats": f"""
        WITH {_REL}, mem AS (SELECT 'S' || s_suppkey AS entity_name, 0 AS level, 'R' || n_regionkey AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey
                     UNION ALL SELECT 'S' || s_suppkey, 1, 'N' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        inn AS (SELECT DISTINCT mem.* FROM mem JOIN rel ON rel.a = mem.entity_name),
        s AS (SELECT level, cluster, count(*) AS n_nodes FROM inn GROUP BY 1, 2),
        c AS (SELECT level, cluster, count(DISTINCT s) AS n_chunks FROM inn JOIN rel ON rel.a = inn.entity_name GROUP BY 1, 2),
        e AS (SELECT level, cluster, count(DISTINCT (src, tgt)) AS n_edges FROM mem JOIN ways ON ways.node = mem.entity_name GROUP BY 1, 2)
        SELECT s.level, s.cluster, n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_chunks, 0) / CAST(max(n_chunks) OVER () AS DOUBLE) AS occurrence
        FROM s LEFT JOIN c USING (level, cluster) LEFT JOIN e USING (level, cluster)""",
    "sub_communities": """
        SELECT DISTINCT 1 AS level, 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "related_segments": f"""
        WITH {_REL}, n AS (SELECT a AS node, s FROM rel UNION SELECT b, s FROM rel),
        f AS (SELECT n.s AS chunk_id, min(CAST(substr(node, 2) AS INTEGER)) AS seed_rank FROM n WHERE node IN ('S1', 'S2', 'S3', 'S4', 'S5') GROUP BY 1),
        c AS (SELECT f.chunk_id, f.seed_rank, count(DISTINCT w.other) AS relation_count
              FROM f LEFT JOIN (SELECT ways.node, ways.other, n.s FROM ways JOIN n ON n.node = ways.other) w ON w.node = 'S' || f.seed_rank AND w.s = f.chunk_id GROUP BY 1, 2)
        SELECT chunk_id, seed_rank, relation_count FROM c ORDER BY relation_count DESC, seed_rank, chunk_id LIMIT 8""",
}
