"""Entity resolution with a short-term memory, over batches of chunks in order.

Per run: chunks come in batches of 10; each new name of a batch is matched to the memory
as it was before the batch (first by normalised name, then by similarity: over 0.85 merge,
under 0.5 new, between the provider decides); then the memory is updated and, beyond 50
names, loses those seen longest ago (ties: the oldest entry). Edges follow the names of
their batch and lose self-loops. The rule is sequential, so a run is one task; what a run
keeps is bounded by the memory, and its mentions stream through in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.functions.text import NAME_LEAD, NAME_TAIL
from kinolake.session import spread

MEMORY, BATCH, MERGE, NEW = 50, 10, 0.85, 0.5
RESOLVED = "run string, batch int, raw_name string, resolved_name string, how string"
_LEAD, _TAIL = re.compile(NAME_LEAD), re.compile(NAME_TAIL)


def normalise(name: str) -> str:
    return _TAIL.sub("", _LEAD.sub("", name.lower().strip()))


class Memory:
    """Names seen lately with description, time and vector."""

    def __init__(self, size: int = MEMORY):
        self.size, self.rows = size, {}

    def match(self, name: str) -> str | None:
        wanted = normalise(name)
        return next((n for n in self.rows if normalise(n) == wanted), None)

    def ranked(self, vector: np.ndarray) -> list[tuple[str, float]]:
        out = []
        for name, row in self.rows.items():
            v = row["vector"]
            norm = np.sqrt((v @ v) * (vector @ vector)) if v is not None else 0.0
            out.append((name, float(v @ vector / norm) if norm else 0.0))
        return sorted(out, key=lambda x: -x[1])

    def see(self, name: str, description: str, vector: np.ndarray | None, now: int) -> None:
        if name in self.rows:
            self.rows[name]["last_seen"] = now
        else:
            self.rows[name] = {"description": description, "last_seen": now, "vector": vector}

    def evict(self) -> None:
        for name in sorted(self.rows, key=lambda n: self.rows[n]["last_seen"])[: max(0, len(self.rows) - self.size)]:
            del self.rows[name]


def memory_text(memory: Memory, length: int = 150) -> str:
    """The memory as an extraction prompt shows it: a line a name, descriptions cut."""
    if not memory.rows:
        return "Memory is empty."
    return "\n".join(f"- {name}: {row['description'][:length]}{'...' if len(row['description']) > length else ''}" for name, row in memory.rows.items())


def resolve_run(mentions: pd.DataFrame, embed: Callable, decide: Callable[[str, str, list[str]], str | None] | None = None, memory_size: int = MEMORY, batch_size: int = BATCH) -> pd.DataFrame:
    """Mentions of one run (``chunk_order, entity_name, description`` in order) to resolved names per batch.

    A column ``known`` (array of name and description) may hold further candidates for a
    name, from a stored table: they have no vector here, so they rank after the memory's
    and can only be decided on.
    """
    memory, rows = Memory(memory_size), []
    order = {c: k for k, c in enumerate(sorted(mentions["chunk_order"].unique()))}
    batches = mentions["chunk_order"].map(order) // batch_size
    for now, (number, part) in enumerate(mentions.groupby(batches, sort=True), start=1):
        first = part.drop_duplicates("entity_name")
        decided = []
        stored = first["known"] if "known" in first.columns else [None] * len(first)
        for name, text, more in zip(first["entity_name"], first["description"].fillna(""), stored):
            known = memory.match(name)
            if known is not None:
                decided.append((name, text, known, "name"))
                continue
            ranked = memory.ranked(np.asarray(embed([f"{name}: {text}"])[0])) if memory.rows else []
            ranked += [(c["name"], 0.0) for c in (more if more is not None else ()) if c["name"] not in memory.rows and c["name"] != name]
            target, how = name, "new"
            if ranked and ranked[0][1] > MERGE:
                target, how = ranked[0][0], "similar"
            elif ranked and ranked[0][1] >= NEW and decide is not None:
                answer = decide(name, text, [n for n, _ in ranked[:5]])
                if answer in {n for n, _ in ranked[:5]}:
                    target, how = answer, "decided"
            decided.append((name, text, target, how))
        for name, text, target, how in decided:
            fresh = target not in memory.rows
            memory.see(target, text, np.asarray(embed([f"{target}: {text}"])[0]) if fresh else None, now)
            rows.append((int(number), name, target, how))
        memory.evict()
    return pd.DataFrame(rows, columns=["batch", "raw_name", "resolved_name", "how"])


def resolve(mentions: DataFrame, run: str, embed: Callable, decide=None, memory_size: int = MEMORY, batch_size: int = BATCH) -> DataFrame:
    """``run, batch, raw_name, resolved_name, how``; needs run, chunk_order, seq, entity_name, description. Null names are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = resolve_run(pdf.sort_values(["chunk_order", "seq", "entity_name"]), embed, decide, memory_size, batch_size)
        out.insert(0, "run", pdf["run"].iloc[0])
        return out.astype({"batch": "int32"})

    more = ["known"] if "known" in mentions.columns else []
    rows = mentions.filter(F.col("entity_name").isNotNull()).select(F.col(run).cast("string").alias("run"), "chunk_order", "seq", "entity_name", "description", *more)
    return spread(rows, "run").groupBy("run").applyInPandas(one, RESOLVED)


def apply_to_mentions(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions (``run, batch, entity_name, ...``) under resolved names; a name that wasn't resolved stays."""
    names = resolved.select("run", "batch", F.col("raw_name").alias("entity_name"), F.col("resolved_name").alias("_n"))
    return mentions.join(names, ["run", "batch", "entity_name"], "left").withColumn("entity_name", F.coalesce("_n", "entity_name")).drop("_n")


def apply_to_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edge mentions (``run, batch, src_id, tgt_id, ...``) under resolved names, without self-loops."""
    rest = [c for c in edges.columns if c not in ("src_id", "tgt_id")]
    a = resolved.select("run", "batch", F.col("raw_name").alias("src_id"), F.col("resolved_name").alias("_a"))
    b = resolved.select("run", "batch", F.col("raw_name").alias("tgt_id"), F.col("resolved_name").alias("_b"))
    out = edges.join(a, ["run", "batch", "src_id"], "left").join(b, ["run", "batch", "tgt_id"], "left")
    out = out.select(*rest, F.coalesce("_a", "src_id").alias("src_id"), F.coalesce("_b", "tgt_id").alias("tgt_id"))
    return out.filter(F.col("src_id") != F.col("tgt_id"))
