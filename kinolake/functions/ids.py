"""Keys: content hashes, segment ids, edge keys, request ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_id(content: Column | str, prefix: str) -> Column:
    """Prefix and md5 of the text."""
    return F.concat(F.lit(prefix), F.md5(_col(content)))


def chunk_id(content: Column | str) -> Column:
    return content_id(content, "chunk-")


def entity_id(name: Column | str) -> Column:
    return content_id(name, "ent-")


def segment_id(video: Column | str, index: Column | str) -> Column:
    return F.concat_ws("_", _col(video), _col(index).cast("string"))


def segment_video(segment: Column | str) -> Column:
    """The name before the last underscore."""
    return F.regexp_replace(_col(segment), "_[^_]*$", "")


def segment_index(segment: Column | str) -> Column:
    """The whole number after the last underscore, null if it is none."""
    return F.substring_index(_col(segment), "_", -1).try_cast("int")


def video_name(path: Column | str) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.substring_index(_col(path), "/", -1), ".", 1)


def edge_ends(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both ends of an undirected edge in order."""
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def cache_key(model: Column, messages: Column, options: Column | None = None) -> Column:
    """Key of a model call over everything that shapes the answer, sampling options included."""
    parts = [model.alias("model"), messages.alias("messages")] + ([options.alias("options")] if options is not None else [])
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def request_id(collection: Column, description: Column, query: Column, first: Column, second: Column, orientation: Column) -> Column:
    """``{collection}-{description}++query{id}++{first}++{second}++{ori|rev}``."""
    return F.concat_ws("++", F.concat_ws("-", collection, description), F.concat(F.lit("query"), query.cast("string")), first, second, orientation)


def request_parts(custom_id: Column | str) -> Column:
    """``struct<collection, description, query, first, second, orientation>``; null parts where the id has another form."""
    parts = F.split(_col(custom_id), "\\+\\+")
    at = lambda i: F.get(parts, F.lit(i))
    return F.struct(
        F.substring_index(at(0), "-", 1).alias("collection"), F.regexp_replace(at(0), "^[^-]*-", "").alias("description"),
        F.regexp_replace(at(1), "^query", "").try_cast("int").alias("query"), at(2).alias("first"), at(3).alias("second"), at(4).alias("orientation"),
    )
