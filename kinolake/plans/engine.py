"""The engine: ingest of segments, retrieval for a question, each a staged plan over stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolake.functions import ids, text
from kinolake.functions.tokens import token_count
from kinolake.operators import chunking, evidence, graph, providers, resolve, segments, tables, vectors
from kinolake.operators.tables import Store
from kinolake.session import cut_lineage
from kinolake.sources.files import keep_dead_letters

FAILED = "Sorry, nothing was found that answers the question."
MARKER = "-----New Chunk-----\n"
MODES = ("context", "evidence")


@dataclass
class Models:
    """What stands behind the boundaries; every default is a deterministic stand-in."""

    embed: Callable = field(default_factory=providers.hash_embedder)
    extract: Callable[[str], str] = providers.name_extractor
    glean: Callable[[list[dict]], str] | None = None
    more: Callable[[list[dict]], str] | None = None
    summarise: Callable[[str, list[str]], str] = providers.keep_first
    decide: Callable[[str, str, list[str]], str | None] | None = None
    rewrite_for_entities: Callable[[str], str] = providers.identity_rewrite
    rewrite_for_segments: Callable[[str], str] = providers.identity_rewrite
    keep: Callable[[str], Callable[[str], str]] = providers.keyword_filter
    recaption: Callable | None = None
    transcribe: Callable[[str, int, int], str] = providers.no_speech
    caption: Callable[[str, list[float], str], str] = providers.no_caption
    chunk: Callable[[DataFrame, int], DataFrame] = chunking.packed_chunks


@dataclass
class Params:
    """Sizes of ingest and retrieval."""

    top_k: int = 20
    related_chunks: int = 8
    segment_k: int = 8
    threshold: float = 0.2
    token_budget: int = 12_000
    evidence_k: int = 8
    max_rounds: int = 3
    chunk_limit: int = 1200
    gleaning: int = 1
    summary_from: int = 500
    candidates: int = 3
    #: Calls to models that may run at the same time; as many as there are tasks if None.
    parallel_calls: int | None = None


class Engine:
    """Tables in a folder. ``suffix`` isolates a second graph (``_tm``); segments and their vectors are shared.

    ``memory`` makes ingest resolve names with the short-term memory (see ``resolve``).
    """

    def __init__(self, spark: SparkSession, folder: str, models: Models | None = None, params: Params | None = None, suffix: str = "", memory: bool = False, store: Store | None = None):
        self.spark, self.store, self.models, self.params, self.suffix, self.memory = spark, store or Store(spark, folder), models or Models(), params or Params(), suffix, memory

    def _read(self, name: str) -> DataFrame | None:
        return self.store.read(name + self.suffix)

    # ---- ingest

    def ingest_videos(self, videos: DataFrame) -> DataFrame:
        """Ingests the videos (``video_name, path, duration_s``) that aren't stored yet; returns the new chunks.

        Segments are planned from the duration and get a transcript and a caption from
        the providers. A segment for which a provider fails becomes a dead letter and
        stops the ingest; nothing of its batch is stored then.
        """
        done = self.store.read("segments")
        fresh = videos.dropDuplicates(["video_name"])
        fresh = fresh if done is None else fresh.join(done.select("video_name").distinct(), "video_name", "left_anti")
        plan = segments.frame_times(segments.plan_segments(fresh)).join(fresh.select("video_name", "path"), "video_name")
        transcribe, caption = self.models.transcribe, self.models.caption

        @F.pandas_udf("struct<transcript: string, caption: string, error: string>")
        def describe(paths: pd.Series, starts: pd.Series, ends: pd.Series, times: pd.Series) -> pd.DataFrame:
            rows = []
            for path, start, end, at in zip(paths, starts, ends, times):
                try:
                    heard = transcribe(path, int(start), int(end))
                    rows.append((heard, caption(path, [float(t) for t in at], heard), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, None, f"{type(error).__name__}: {error}"))
            return pd.DataFrame(rows, columns=["transcript", "caption", "error"])

        told = cut_lineage(self._calls(plan).withColumn("d", describe.asNondeterministic()("path", "start_s", "end_s", "frame_times")).select("video_name", "segment_index", "start_s", "end_s", "frame_times", "d.*"))
        self._stop_on_errors(told, "a provider failed on a segment")
        rows = told.select(ids.segment_id("video_name", "segment_index").alias("segment_id"), "video_name", "segment_index", "start_s", "end_s", "frame_times", "transcript", "caption", segments.content_of().alias("content"))
        return self.ingest(rows)

    def _calls(self, rows: DataFrame) -> DataFrame:
        """Rows spread so that at most ``parallel_calls`` of them are with a model at a time."""
        return rows if self.params.parallel_calls is None else rows.repartition(self.params.parallel_calls)

    def _stop_on_errors(self, rows: DataFrame, reason: str) -> None:
        failed = rows.filter(F.col("error").isNotNull())
        if not failed.isEmpty():
            keep_dead_letters(self.store, failed, reason)
            raise RuntimeError(f"{reason}: {failed.select('error').first()[0]}; see the table dead_letter")

    def ingest(self, rows: DataFrame) -> DataFrame:
        """Stores segments, their chunks, the graph and the vectors; returns the chunks that were new.

        Only what changed is worked on: segments that are new or whose content differs
        are embedded, videos with such segments are chunked again, and only unseen chunks
        are extracted and embedded, so that edge weights aren't added twice. New segments,
        chunks and their vectors are appended; nodes, edges and the vectors of the entities
        named in the new chunks are merged into their tables. Stops with an error when new
        chunks give no entity at all; chunks that fail are kept as dead letters.
        """
        old = self.store.read("segments")
        rows = rows.distinct()
        if old is not None:
            known = old.select("segment_id", F.md5(F.coalesce("content", F.lit(""))).alias("_m"))
            rows = rows.withColumn("_m", F.md5(F.coalesce("content", F.lit("")))).join(known, ["segment_id", "_m"], "left_anti").drop("_m")
        rows = cut_lineage(rows)
        stored = rows if old is None else tables.upsert(old, rows, "segment_id")
        known = self._read("chunks")
        again = stored if known is None else stored.join(rows.select("video_name").distinct(), "video_name", "left_semi")
        made = chunking.dedup_chunks(self.models.chunk(again, self.params.chunk_limit), ["video_name", "chunk_order_index"]).drop("video_name")
        fresh = cut_lineage(made if known is None else chunking.new_chunks(made, known))
        if not fresh.isEmpty():
            self._add_entities(fresh)
            embedded = vectors.embed(self._calls(fresh.select(F.col("chunk_id").alias("id"), "content")), "content", self.models.embed).select("id", "embedding")
            self.store.append("chunk_vectors" + self.suffix, embedded)
            self.store.append("chunks" + self.suffix, fresh)
        if not rows.isEmpty():  # last: an ingest that stopped is done again from its segments
            embedded = vectors.embed(self._calls(rows.select(F.col("segment_id").alias("id"), "content")), "content", self.models.embed).select("id", "embedding").filter("embedding IS NOT NULL")
            self.store.upsert("segment_vectors", embedded, "id")
            self.store.upsert("segments", rows, "segment_id")
        return fresh

    def reindex_entities(self) -> int:
        """Makes graph and entity vectors anew from all stored chunks; how many entities there are."""
        stored = self._read("chunks")
        if stored is None:
            raise ValueError("no chunks are stored")
        chunks = cut_lineage(stored)
        for name in ("nodes", "edges", "node_sources", "entity_vectors"):
            self.store.reset(name + self.suffix)
        self._add_entities(chunks)
        return self._read("nodes").count()

    def _extracted(self, fresh: DataFrame) -> DataFrame:
        """``chunk_id, chunk_order_index, answer`` of the chunks; failures stop the ingest."""
        extract, glean, more, rounds = self.models.extract, self.models.glean, self.models.more, self.params.gleaning

        @F.pandas_udf("struct<answer: string, error: string>")
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for text in texts:
                try:
                    rows.append((providers.extract_and_glean(text or "", extract, glean, more, rounds), None))
                except Exception as error:  # noqa: BLE001
                    rows.append((None, f"{type(error).__name__}: {error}"))
            return pd.DataFrame(rows, columns=["answer", "error"])

        answers = cut_lineage(self._calls(fresh.select("chunk_id", "chunk_order_index", "content")).withColumn("d", run.asNondeterministic()(text.clean_for_json("content"))).select("chunk_id", "chunk_order_index", "content", "d.*"))
        self._stop_on_errors(answers, "extraction failed for a chunk")
        return answers.select("chunk_id", "chunk_order_index", "answer")

    def _add_entities(self, fresh: DataFrame) -> None:
        answers = self._extracted(fresh)
        mentions, relations = graph.parse_records(answers)
        mentions, relations = cut_lineage(mentions), cut_lineage(relations)
        if mentions.isEmpty():
            raise RuntimeError("no entity was extracted from the new chunks; nothing was stored")
        if self.memory:
            mentions, relations = self._resolved(answers, mentions, relations)
        nodes, edges = self._read("nodes"), self._read("edges")
        summary = lambda df, name: graph.long_descriptions(df, self.models.summarise, self.params.summary_from, name=name)
        src, tgt = ids.edge_ends("src_id", "tgt_id")
        pairs = relations.select(src.alias("src"), tgt.alias("tgt")).distinct()
        touched = edges.join(pairs, ["src", "tgt"], "left_semi") if edges is not None else None
        new_edges = cut_lineage(summary(graph.merge_edges(relations, touched), "src"))
        names = mentions.select("entity_name").distinct()
        known = nodes.join(names, "entity_name", "left_semi") if nodes is not None else None
        new_nodes = summary(graph.merge_nodes(mentions, known), "entity_name")
        every = new_nodes.select("entity_name") if nodes is None else new_nodes.select("entity_name").unionByName(nodes.select("entity_name"))
        new_nodes = cut_lineage(new_nodes.unionByName(graph.missing_endpoints(new_edges, every)))
        sources = mentions.select("entity_name", "source_id").unionByName(new_nodes.join(names, "entity_name", "left_anti").select("entity_name", F.explode("source_ids").alias("source_id"))).distinct()
        self.store.append("node_sources" + self.suffix, sources)
        self.store.upsert("nodes" + self.suffix, new_nodes, "entity_name")
        rest = None if edges is None else edges.join(new_edges.select("src", "tgt"), ["src", "tgt"], "left_anti")
        self.store.commit("edges" + self.suffix, new_edges if rest is None else rest.unionByName(new_edges))
        named = new_nodes.select(ids.entity_id("entity_name").alias("id"), "entity_name", F.concat("entity_name", F.coalesce("description", F.lit(""))).alias("content"))
        embedded = vectors.embed(self._calls(named), "content", self.models.embed).select("id", "entity_name", "embedding")
        self.store.upsert("entity_vectors" + self.suffix, embedded, "id")

    def _resolved(self, answers: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mentions and relations under the names that the short-term memory gives them, batches of chunks in order.

        Beside the memory's names those most similar among the stored entities are candidates.
        """
        order = tables.global_rank(answers.select("chunk_id", "chunk_order_index"), ["chunk_order_index", "chunk_id"], "chunk_order")
        place = cut_lineage(order.select(F.col("chunk_id").alias("source_id"), "chunk_order", F.lit("all").alias("run"), F.floor(F.col("chunk_order") / resolve.BATCH).cast("int").alias("batch")))
        rows = mentions.join(place, "source_id")
        stored = self._read("entity_vectors")
        if stored is not None and self._read("nodes") is not None:
            first = rows.groupBy("entity_name").agg(F.min_by("description", F.struct("chunk_order", "seq")).alias("description"))
            asked = vectors.embed(first.select("entity_name", F.concat_ws(": ", "entity_name", "description").alias("q")), "q", self.models.embed)
            hits = vectors.top_k(asked.select(F.col("entity_name").alias("query_id"), "embedding"), stored, self.params.candidates).join(stored.select("id", "entity_name"), "id")
            hits = hits.join(self._read("nodes").select("entity_name", "description"), "entity_name")
            known = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("entity_name").alias("name"), "description"))), lambda h: F.struct(h["name"].alias("name"), h["description"].alias("description"))).alias("known"))
            rows = rows.join(known.withColumnRenamed("query_id", "entity_name"), "entity_name", "left")
        found = cut_lineage(resolve.resolve(rows, "run", self.models.embed, self.models.decide))
        columns = ["entity_name", "entity_type", "description", "source_id", "seq"]
        named = resolve.apply_to_mentions(mentions.join(place.drop("chunk_order"), "source_id"), found).select(*columns)
        turned = resolve.apply_to_edges(relations.join(place.drop("chunk_order"), "source_id"), found)
        return cut_lineage(named), cut_lineage(turned.select("src_id", "tgt_id", "weight", "description", "source_id", "seq"))

    # ---- retrieval

    def _near(self, table: str, question: str, k: int, threshold: float | None) -> DataFrame:
        vector = [float(v) for v in self.models.embed([question])[0]]
        asked = self.spark.createDataFrame([(0, vector)], "query_id int, embedding array<double>")
        found = self.store.read(table) if table == "segment_vectors" else self._read(table)
        if found is None:
            return self.spark.createDataFrame([], "id string, similarity double, rank int")
        return vectors.top_k(asked, found, k, threshold).select("id", "similarity", "rank")

    def _entities(self, question: str, k: int) -> DataFrame:
        hits = self._near("entity_vectors", self.models.rewrite_for_entities(question), k, self.params.threshold)
        named = self._read("entity_vectors")
        if named is None:
            return self.spark.createDataFrame([], "entity_name string, similarity double, rank int, degree bigint")
        found = hits.join(named.select("id", "entity_name"), "id").select("entity_name", "similarity", "rank")
        return found.join(graph.node_degree(self._read("edges")), "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))

    def _related(self, seeds: DataFrame, k: int) -> DataFrame:
        if self._read("nodes") is None:
            return self.spark.createDataFrame([], "segment_id string")
        chunks = graph.related_chunks(seeds, self._read("node_sources"), self._read("edges"), k)
        return graph.chunk_segments(chunks, self._read("chunks"))

    def retrieve(self, question: str, mode: str = "context") -> DataFrame:
        """``context``: the rows an answer is written from; ``evidence``: the pool of the refinement loop."""
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is not one of {MODES}")
        return self.context(question) if mode == "context" else self.evidence(question)

    def context(self, question: str) -> DataFrame:
        """``kind, place, id, video_name, start, end, content``: chunks within the token budget, then segments in order of video and time.

        Segments come from entities' related chunks and from similarity; those the filter
        keeps stay, or all if it keeps none. Empty without any chunk hit.
        """
        p = self.params
        hits = self._near("chunk_vectors", question, p.top_k, p.threshold)
        stored = self._read("chunks")
        if stored is None:
            return self.spark.createDataFrame([], "kind string, place int, id string, video_name string, start string, end string, content string")
        chunks = hits.join(stored.select(F.col("chunk_id").alias("id"), "content"), "id").withColumn("n", token_count("content")).withColumn("q", F.lit(0))
        chunks = chunking.budget_prefix(chunks, ["q"], ["rank"], "n", p.token_budget)
        seeds = self._entities(question, p.top_k).select("entity_name", "rank")
        visual = self._near("segment_vectors", self.models.rewrite_for_segments(question), p.segment_k, None).select(F.col("id").alias("segment_id"))
        wanted = self._related(seeds, p.related_chunks).union(visual).distinct()
        rows = self.store.read("segments").join(wanted, "segment_id", "left_semi")
        keep = _text_udf(self.models.keep(question))
        judged = rows.withColumn("_keep", F.contains(F.lower(keep("content")), F.lit("yes"))).withColumn("_q", F.lit(0))
        kept = evidence.relevant_or_all(judged, ["_q"], "_keep")
        content = _text_udf(self.models.recaption)("content") if self.models.recaption else F.col("content")
        place = F.row_number().over(Window.orderBy("video_name", "segment_index", "segment_id"))
        one = chunks.select(F.lit("chunk").alias("kind"), F.col("rank").cast("int").alias("place"), "id", F.lit(None).cast("string").alias("video_name"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), "content")
        two = kept.select(F.lit("segment").alias("kind"), place.cast("int").alias("place"), F.col("segment_id").alias("id"), "video_name", text.clock("start_s").alias("start"), text.clock("end_s").alias("end"), content.alias("content"))
        return one.unionByName(two)

    def prompt(self, question: str, template: str = "Videos:\n{videos}\n\nTexts:\n{chunks}\n") -> str:
        """The context as one text, or the fixed failure text where no chunk was found."""
        rows = self.context(question).collect()
        chunks = [r.content or "" for r in sorted((r for r in rows if r.kind == "chunk"), key=lambda r: r.place)]
        if not chunks:
            return FAILED
        table = [("video_name", "start_time", "end_time", "content")] + [(r.video_name, r.start, r.end, r.content) for r in sorted((r for r in rows if r.kind == "segment"), key=lambda r: r.place)]
        quoted = "\n".join(",\t".join('"' + str(v if v is not None else "").strip().strip("'").strip('"') + '"' for v in row) for row in table)
        return template.replace("{videos}", quoted).replace("{chunks}", MARKER.join(chunks))

    def text_evidence(self, question: str, k: int | None = None) -> DataFrame:
        """Chunks near the question (the rewritten one), entities, and the entities' related segments with score 0.5."""
        k = k or self.params.evidence_k
        hits = self._near("chunk_vectors", self.models.rewrite_for_entities(question), k, self.params.threshold)
        dense = evidence.text_evidence(hits.join(self._read("chunks").select(F.col("chunk_id").alias("id"), "content"), "id").select("id", F.col("similarity").alias("score"), "content", F.col("rank").cast("bigint").alias("ord")))
        entities, related = self._entity_evidence(question, k, self.params.related_chunks, 0.5)
        return evidence.union_in_order([dense, entities, related])

    def graph_evidence(self, question: str, k: int | None = None) -> DataFrame:
        """Entities near the question and their related segments with score 0.75."""
        k = k or self.params.evidence_k
        return evidence.union_in_order(list(self._entity_evidence(question, k, k, 0.75)))

    def _entity_evidence(self, question: str, k: int, chunks: int, score: float) -> tuple[DataFrame, DataFrame]:
        seeds = self._entities(question, k)
        nodes = self._read("nodes").select("entity_name", "description")
        found = evidence.entity_evidence(seeds.join(nodes, "entity_name").select("entity_name", F.col("similarity").alias("score"), "description", F.col("rank").cast("bigint").alias("ord")))
        segments = self._related(seeds.select("entity_name", "rank"), chunks)
        return found, self._segment_rows(segments, F.lit(score))

    def _segment_rows(self, wanted: DataFrame, score) -> DataFrame:
        rows = wanted.join(self.store.read("segments").select("segment_id", "video_name", "segment_index", "start_s", "end_s", "content"), "segment_id", "left")
        order = F.row_number().over(Window.orderBy("video_name", "segment_index", "segment_id")).cast("bigint")
        return evidence.segment_evidence(rows.select(F.col("segment_id").alias("id"), score.alias("score"), "video_name", "segment_index", "start_s", "end_s", "content", order.alias("ord")))

    def visual_evidence(self, question: str, k: int | None = None) -> DataFrame:
        hits = self._near("segment_vectors", self.models.rewrite_for_segments(question), k or self.params.evidence_k, None)
        rows = hits.select(F.col("id").alias("segment_id"), "similarity", "rank").join(self.store.read("segments").select("segment_id", "video_name", "segment_index", "start_s", "end_s", "content"), "segment_id", "left")
        return evidence.union_in_order([evidence.segment_evidence(rows.select(F.col("segment_id").alias("id"), F.col("similarity").alias("score"), "video_name", "segment_index", "start_s", "end_s", "content", F.col("rank").cast("bigint").alias("ord")))])

    def evidence(self, question: str) -> DataFrame:
        """Text, graph and visual evidence, first of each id, the first 24 rows."""
        parts = [self.text_evidence(question), self.graph_evidence(question), self.visual_evidence(question)]
        flat = None
        for k, part in enumerate(parts):
            one = part.withColumn("branch", F.col("branch") + 10 * k)
            flat = one if flat is None else flat.unionByName(one)
        return evidence.cap(evidence.dedup(flat))


def _text_udf(function: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t or ""))

    return run.asNondeterministic()  # a model's call is made once
