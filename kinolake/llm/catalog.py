"""Queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.functions.tokens import token_count
from kinolake.llm import leakage, mixing, moderation, neighbours, packing, ranking, split
from kinolake.session import cut_lineage

CHUNK_LIMIT, CHUNK_OVERLAP, CONTAINER = 1024, 128, 1200
#: Vectors a list where also unrelated neighbours are wanted; with the default of 200 recall falls under 0.9 on larger tables.
NEAREST_LIST = 800
#: At most so many labelled documents train the classifier.
MAX_LABELS = 20_000


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 2: neighbours


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.most_similar(_table(spark, folder, "vectors"), min_similarity=0.9)
    return neighbours.similar_pairs(near).select("id_a", "id_b")


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar ids of every vector, with their similarity, by posting lists (recall in the README)."""
    return neighbours.most_similar(_table(spark, folder, "vectors"), list_size=NEAREST_LIST)


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar ids of every hundredth vector (by crc32 of the id), against all."""
    vectors = _table(spark, folder, "vectors")
    return neighbours.search(vectors.filter(F.crc32("id") % 100 == 0), vectors)


# 3: ranking


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.votes_to_outcomes(_table(spark, folder, "votes"))


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    counts = ranking.aggregate_counts(_outcomes(spark, folder), "metric", "first", "second", "outcome")
    methods = _table(spark, folder, "methods").select("method").distinct()
    for side in ("first", "second"):
        counts = counts.join(methods.withColumnRenamed("method", side), side, "left_semi")
    return ranking.rank_items(counts, methods, "method").withColumnRenamed("item", "method")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_items(p3_ranking(spark, folder), 6).select("metric", "method")


# 4: splitting


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = split.distinct_rows(_table(spark, folder, "chunks"))
    return split.split_items(chunks, "content", CHUNK_LIMIT, CHUNK_OVERLAP)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split.split_items(_table(spark, folder, "chunks").select("chunk_id", "content", "chunk_order_index"), "content", CHUNK_LIMIT, CHUNK_OVERLAP)
    return pieces.filter(F.col("n_pieces") > 1).select("chunk_id").distinct()


# 5: packing


def p5_containers(spark: SparkSession, folder: str) -> DataFrame:
    segments = _table(spark, folder, "segments").select("segment_id", "video_name", token_count("content").alias("tokens"))
    packed = packing.pack_items(segments, "segment_id", "video_name", "tokens", CONTAINER)
    return packed.withColumnsRenamed({"grp": "video_name", "item": "segment_id", "len": "tokens"})


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    packed = p5_containers(spark, folder).withColumnsRenamed({"video_name": "grp", "segment_id": "item", "tokens": "len"})
    return packing.container_fill(packed, CONTAINER).withColumnRenamed("grp", "video_name")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_containers(spark, folder).filter(F.col("piece") > 0).select("segment_id").distinct()


# 6: leakage


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).filter(F.col("kind") == "leaked").select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks_by_item(p6_leaks(spark, folder), _table(spark, folder, "eval_items"))


# 7: mixing


def _allocation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = _table(spark, folder, "source_targets")
    sizes = cut_lineage(mixing.sized(_table(spark, folder, "documents")))  # texts are read once
    return sizes, targets, cut_lineage(mixing.budgets(sizes, targets))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sizes, targets, plan = _allocation(spark, folder)
    return sizes, targets, plan, mixing.select_mix(sizes, plan)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[3]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose first offers the allocation had to cut."""
    return mixing.short_sources(_allocation(spark, folder)[2]).filter("short").select("source")


# 8: moderation


def _moderated(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = moderation.fit_model(moderation.labelled_sample(documents, _table(spark, folder, "labels"), MAX_LABELS))
    return moderation.flags(moderation.score_documents(documents, model), model)


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _moderated(spark, folder).drop("flagged")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return moderation.rates(_moderated(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _moderated(spark, folder).filter("flagged").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p2_found, p2_nearest, p2_neighbours, p3_found, p3_ranking, p4_found, p4_pieces, p5_found, p5_containers, p5_fill, p6_found, p6_leaks, p6_items, p7_found, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    count = r"len(regexp_extract_all({0}, '[^ \t\n\r]+'))"
    norm = r"lower(regexp_replace(source, '^\s+|\s+$', '', 'g'))"
    return {
        "p2_found": """
            WITH u AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM vectors
                       WHERE id IS NOT NULL AND len(embedding) = 128
                         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS sim, list_cosine_similarity(a.e, b.e) AS exact
                  FROM u a JOIN u b ON a.id <> b.id),
            r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS k FROM s)
            SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE k <= 5 AND exact >= 0.9""",
        "p4_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE {count.format('content')} > 1024",
        "p5_found": f"SELECT DISTINCT segment_id FROM segments WHERE {count.format('content')} > 1200",
        "p7_found": f"""
            WITH d AS (SELECT DISTINCT doc_id, {norm} AS source, coalesce({count.format('text')}, 0) AS n, text FROM documents),
            t AS (SELECT {norm} AS source, target_share, max_repeats FROM source_targets),
            s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n), 0) AS n FROM t LEFT JOIN d ON d.source = t.source GROUP BY ALL)
            SELECT source FROM s WHERE n * max_repeats < target_share * (SELECT sum(n) FROM s)""",
    }
