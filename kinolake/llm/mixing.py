"""Mixing sources to target weights: hierarchical budgeting.

Weights run down a tree domain - language - source and give every leaf its first offer.
What a node cannot take of its budget, because its tokens times its repeats are fewer,
goes to its siblings and only then, when a whole subtree is short, to the siblings of the
ancestors. Each leaf then takes whole epochs and a token-prefix of one more, in a seeded
order; what the prefix leaves over is passed on within the source, to documents that
still fit, until none does.

A source falls short where the first offers of its leaves were cut to their capacities.
The tables name no domain, so a stand-in is used by default: what follows the last
underscore of a source's name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions.tokens import token_count
from kinolake.session import cut_lineage

_BUDGETS = "domain string, lang string, source string, leaf_tokens bigint, target_share double, max_repeats int, offer double, cut double, budget bigint, epochs bigint, rest bigint"
_BINS = 12  # bits of the seeded order that are counted before the exact prefix


def normal_source(source: Column) -> Column:
    """Lower case without outer spaces."""
    return F.lower(F.regexp_replace(source, "^\\s+|\\s+$", ""))


def normal_lang(lang: Column) -> Column:
    """Lower case without outer spaces; ``und`` for null or blank."""
    text = F.lower(F.regexp_replace(lang, "^\\s+|\\s+$", ""))
    return F.coalesce(F.when(text != "", text), F.lit("und"))


def domain_of(source: Column) -> Column:
    """Default domain: what follows the last underscore (asr, captions, notes, ...)."""
    return F.substring_index(source, "_", -1)


def fill(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its capacity; the rest goes to the others by weight."""
    out, open_ = [0.0] * len(weights), [i for i in range(len(weights)) if capacities[i] > 0 and weights[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / total * left >= capacities[i] - out[i]]
        if not full:
            for i in open_:
                out[i] += weights[i] / total * left
            return out
        for i in full:
            left -= capacities[i] - out[i]
            out[i] = capacities[i]
        open_ = [i for i in open_ if i not in full]
    return out


def offers(leaves: pd.DataFrame, budget: float, levels: list[str]) -> pd.Series:
    """First offer of every leaf: the budget run down the tree by weight alone, nothing redistributed."""
    whole = leaves["weight"].sum()
    if not levels:
        return budget * leaves["weight"] / whole if whole > 0 else leaves["weight"] * 0.0
    parts = [part for _, part in leaves.groupby(levels[0], sort=True)]
    return pd.concat([offers(p, budget * p["weight"].sum() / whole if whole > 0 else 0.0, levels[1:]) for p in parts])


def allocate(leaves: pd.DataFrame, budget: float, levels: list[str]) -> pd.Series:
    """Budget of every leaf (columns ``levels``, ``weight``, ``capacity``)."""
    if not levels:
        return pd.Series(fill(budget, leaves["weight"].tolist(), leaves["capacity"].tolist()), index=leaves.index)
    parts = [part for _, part in leaves.groupby(levels[0], sort=True)]
    shares = fill(budget, [p["weight"].sum() for p in parts], [p["capacity"].sum() for p in parts])
    return pd.concat([allocate(p, s, levels[1:]) for p, s in zip(parts, shares)])


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokens``: only sizes leave the scan; copied rows once; null texts have 0 tokens."""
    return docs.select(F.col(doc_id).alias("doc_id"), normal_source(F.col(source)).alias("source"), normal_lang(F.col(lang)).alias("lang"), token_count(text).cast("bigint").alias("tokens")).distinct()


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None, max_leaves: int = 100_000) -> DataFrame:
    """The budget of each leaf (domain, lang, source) in tokens.

    ``targets`` has source, target_share, max_repeats and optionally domain; names are
    compared in lower case without outer spaces, the first row of a name counts, rows
    with a null or negative share or repeats count as 0. ``total`` is the size of the
    mix; by default all tokens of the listed sources. A source without any document has
    one empty leaf. More than ``max_leaves`` leaves is an error, not a truncation.

    A leaf's weight is its source's target share split by the source's languages as they
    occur. ``offer`` is what the weights alone give it (shares as they stand, also where
    they don't sum to 1), ``cut`` what it can't take of that, ``budget`` its part after
    redistribution. Only one row a leaf is gathered in one task.
    """
    name = normal_source(F.col("source"))
    domain = F.coalesce(F.col("domain").cast("string"), domain_of(name)) if "domain" in targets.columns else domain_of(name)
    share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
    repeats = F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0))
    listed = targets.filter(F.col("source").isNotNull()).select(name.alias("source"), F.struct(share.alias("target_share"), repeats.alias("max_repeats"), domain.alias("domain")).alias("_t"))
    listed = listed.groupBy("source").agg(F.max("_t").alias("_t")).select("source", "_t.*")
    by_leaf = sizes.groupBy("source", "lang").agg(F.sum("tokens").alias("leaf_tokens"))
    leaves = listed.join(by_leaf, "source", "left").select("domain", F.coalesce("lang", F.lit("und")).alias("lang"), "source", F.coalesce("leaf_tokens", F.lit(0)).cast("bigint").alias("leaf_tokens"), "target_share", "max_repeats")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_leaves:
            raise ValueError(f"{len(pdf)} leaves are more than max_leaves={max_leaves}")
        pdf = pdf.sort_values(["domain", "lang", "source"]).reset_index(drop=True)
        of_source = pdf.groupby("source")["leaf_tokens"].transform("sum")
        count = pdf.groupby("source")["leaf_tokens"].transform("size")
        part = (pdf["leaf_tokens"] / of_source.where(of_source > 0)).fillna(1.0 / count)
        pdf["weight"], pdf["capacity"] = pdf["target_share"] * part, (pdf["leaf_tokens"] * pdf["max_repeats"]).astype(float)
        size = float(pdf["leaf_tokens"].sum() if total is None else total)
        pdf["offer"] = offers(pdf, size * pdf["weight"].sum(), ["domain", "lang"]).sort_index()
        over = pdf["offer"] - pdf["capacity"]
        pdf["cut"] = over.where(over > 1e-9 * pdf["offer"], 0.0)
        pdf["budget"] = (allocate(pdf, size, ["domain", "lang"]).sort_index() + 1e-6).astype("int64").clip(upper=pdf["capacity"].astype("int64"))
        some = pdf["leaf_tokens"].clip(lower=1)
        pdf["epochs"], pdf["rest"] = pdf["budget"] // some, pdf["budget"] % some
        return pdf[["domain", "lang", "source", "leaf_tokens", "target_share", "max_repeats", "offer", "cut", "budget", "epochs", "rest"]].astype({"max_repeats": "int32"})

    return leaves.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: plan(pdf), _BUDGETS)


def select_mix(sizes: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, repeats`` of every document in the mix (repeats > 0).

    A document of a leaf is used ``epochs`` times, and once more if it lies in the
    prefix: the longest run in seeded order whose tokens fit into the rest of the
    budget. What all leaves of a source leave over goes to its documents that are not in
    a prefix and may be repeated once more: as many as fit, longest first, so that in the
    end no such document fits. Documents without tokens are not used. Ties in the order:
    smaller doc_id.

    The prefix of a leaf is found by counts over 4096 ranges of the order, and document
    by document only inside each range; the leftover is spent on the histogram of
    lengths. So no leaf or source is ever one task.
    """
    doc = sizes.filter(F.col("tokens") > 0).join(F.broadcast(plan.filter(F.col("budget") > 0)), ["source", "lang"])  # a row a leaf; budgets() bounds their number
    place = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id")).bitwiseAND(F.lit((1 << 63) - 1))
    doc = doc.withColumn("_place", place).withColumn("_bin", F.shiftright("_place", 63 - _BINS))
    inside = Window.partitionBy("source", "lang", "_bin").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("source", "lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = doc.groupBy("source", "lang", "_bin").agg(F.sum("tokens").alias("_n"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    run = doc.withColumn("_run", F.sum("tokens").over(inside)).join(bins, ["source", "lang", "_bin"])
    repeats = F.col("epochs") + (F.col("_before") + F.col("_run") <= F.col("rest")).cast("bigint")
    first = cut_lineage(run.select("doc_id", "domain", "lang", "source", "tokens", "max_repeats", "_place", F.col("epochs").alias("_epochs"), repeats.cast("int").alias("repeats")))
    more = _leftovers(first, plan)
    added = first.join(more.select("source", "tokens", "_take"), ["source", "tokens"], "left")
    open_ = F.col("_take").isNotNull() & (F.col("repeats") == F.col("_epochs")) & (F.col("repeats") < F.col("max_repeats"))
    fits = added.filter(open_).withColumn("_r", F.row_number().over(Window.partitionBy("source", "tokens").orderBy("_place", "doc_id")))
    extra = fits.filter(F.col("_r") <= F.col("_take")).select("doc_id", "lang", "source", "tokens", F.lit(1).alias("_more"))
    out = first.join(extra, ["doc_id", "lang", "source", "tokens"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("_more", F.lit(0)))
    return out.select("doc_id", "domain", "lang", "source", "tokens", "repeats").filter(F.col("repeats") > 0)


def spend(lengths: list[int], counts: list[int], left: int) -> dict[int, int]:
    """How many documents of each length are taken for ``left`` tokens, longest first; afterwards none that remains fits."""
    out = {}
    for length, count in sorted(zip(lengths, counts), reverse=True):
        n = min(count, left // length)
        if n:
            out[length] = n
            left -= n * length
    return out


def _leftovers(first: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, tokens, _take``: how many more documents of each length a source takes for what its prefixes left."""
    used = first.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("_used"))
    left = plan.groupBy("source").agg(F.sum("budget").alias("_budget")).join(used, "source").select("source", (F.col("_budget") - F.col("_used")).alias("_left"))
    spare = first.filter((F.col("repeats") == F.col("_epochs")) & (F.col("repeats") < F.col("max_repeats")))
    lengths = spare.groupBy("source", "tokens").agg(F.count("*").alias("_n")).join(F.broadcast(left), "source").filter(F.col("tokens") <= F.col("_left"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        got = spend(pdf["tokens"].tolist(), pdf["_n"].tolist(), int(pdf["_left"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"].iloc[0], "tokens": list(got.keys()), "_take": list(got.values())})

    return lengths.groupBy("source").applyInPandas(take, "source string, tokens bigint, _take bigint")


def short_sources(plan: DataFrame) -> DataFrame:
    """``source, short``: were the first offers of the source's leaves cut to what the source has."""
    return plan.groupBy("source").agg((F.sum("cut") > 0).alias("short"))


def shares(sizes: DataFrame, targets: DataFrame, plan: DataFrame, mix: DataFrame) -> DataFrame:
    """Per listed source: tokens there are, target and actual share, short or not.

    ``short`` comes from the allocation (see ``short_sources``): the source's tokens times
    its repeats are fewer than its share of the tokens of all documents of listed sources.
    """
    by_source = plan.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"), F.sum("leaf_tokens").alias("source_tokens"), F.sum("budget").alias("budget"), (F.sum("cut") > 0).alias("short"))
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    all_ = Window.partitionBy(F.lit(1))
    out = by_source.join(used, "source", "left").na.fill(0, ["mix_tokens", "most_repeats"]).withColumn("_mix", F.sum("mix_tokens").over(all_))
    share = F.when(F.col("_mix") > 0, F.col("mix_tokens") / F.col("_mix")).otherwise(0.0)
    return out.select("source", "target_share", "max_repeats", "source_tokens", "budget", "mix_tokens", "most_repeats", share.alias("actual_share"), "short")
