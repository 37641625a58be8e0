"""Timed segments of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import ids

NO_CAPTION = "Caption:\nNone"


def plan_segments(videos: DataFrame, duration: str = "duration_s", length: int = 30, least: int = 5, video: str = "video_name") -> DataFrame:
    """``video_name, segment_index, start_s, end_s``.

    Starts lie every ``length`` seconds; a last one with under ``least`` seconds is
    dropped if there are others; the last segment ends with the video. Durations that
    are null or under a second give no segment.
    """
    whole = F.floor(F.col(duration)).cast("bigint")
    one = videos.select(F.col(video).alias("video_name"), whole.alias("_d")).filter(F.col("_d") > 0)
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_d") - 1, F.lit(length).cast("bigint"))
    drop = (F.size(starts) > 1) & (F.col("_d") - F.element_at(starts, -1) < least)
    starts = F.when(drop, F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)
    one = one.select("video_name", "_d", starts.alias("_s")).select("video_name", "_d", F.size("_s").alias("_n"), F.posexplode("_s").alias("segment_index", "start_s"))
    end = F.when(F.col("segment_index") == F.col("_n") - 1, F.col("_d")).otherwise(F.col("start_s") + length)
    return one.select("video_name", F.col("segment_index").cast("int").alias("segment_index"), "start_s", end.alias("end_s"))


def frame_times(segments: DataFrame, frames: int = 5, start: str = "start_s", end: str = "end_s", out: str = "frame_times") -> DataFrame:
    """Evenly spaced times in each segment, its end excluded; null where start or end is null."""
    step = (F.col(end) - F.col(start)).cast("double") / frames
    times = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.col(start).cast("double") + i * step)
    return segments.withColumn(out, F.when(step.isNotNull(), times))


def content_of(caption: str = "caption", transcript: str = "transcript"):
    """The template that joins caption and transcript; null parts count as empty."""
    return F.concat(F.lit("Caption:\n"), F.coalesce(F.col(caption), F.lit("")), F.lit("\nTranscript:\n"), F.coalesce(F.col(transcript), F.lit("")), F.lit("\n\n"))


def merge_information(times: DataFrame, transcripts: DataFrame, captions: DataFrame, key: tuple[str, ...] = ("video_name", "segment_index")) -> DataFrame:
    """Three inputs with one row a segment joined by key (inner); null keys match nothing."""
    joined = times.join(transcripts.select(*key, "transcript"), list(key)).join(captions.select(*key, "caption"), list(key))
    return joined.withColumn("content", content_of())


def caption_of(content: str = "content"):
    """The caption inside the template; null where the template isn't there."""
    inside = F.split(F.col(content), "\\QCaption:\n\\E", 2)
    return F.substring_index(F.get(inside, F.lit(1)), "\nTranscript:", 1)


def completeness(segments: DataFrame) -> DataFrame:
    """``video_name, n_segments, complete, has_transcripts, has_captions``: a property of all segments of a video."""
    filled = lambda c: F.coalesce(F.bool_and(F.col(c).isNotNull() & (F.col(c) != "")), F.lit(False))
    usable = F.col("content").isNotNull() & ~F.coalesce(F.contains("content", F.lit(NO_CAPTION)), F.lit(False))
    return segments.groupBy("video_name").agg(F.count("*").alias("n_segments"), F.bool_and(usable).alias("complete"), filled("transcript").alias("has_transcripts"), filled("caption").alias("has_captions"))


def with_features(videos: DataFrame, features: DataFrame, feature_id: str = "id") -> DataFrame:
    """Videos whose first segment has a feature row."""
    keyed = videos.withColumn("_first", ids.segment_id(F.col("video_name"), F.lit(0)))
    return keyed.join(features.select(F.col(feature_id).alias("_first")).distinct(), "_first", "left_semi").drop("_first")


def in_order(segments: DataFrame) -> DataFrame:
    """Segments with their place by (video, numeric index)."""
    return segments.withColumn("place", F.row_number().over(Window.partitionBy("video_name").orderBy("segment_index", "segment_id")))
