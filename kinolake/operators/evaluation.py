"""Evaluation: pairing answers, validating and aggregating judgements, task control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolake.functions.ids import request_id, request_parts
from kinolake.functions.judging import WINNER_METRICS
from kinolake.functions.text import json_object
from kinolake.operators.tables import for_each

PRICE_PER_MILLION = 0.075


def explode_questions(collections: DataFrame) -> DataFrame:
    """``collection_id, description, type, query, question`` with a row a question; copies of a collection once."""
    one = collections.select("collection_id", "description", "type", F.explode("questions").alias("q"))
    return one.select("collection_id", "description", "type", F.col("q.id").alias("query"), F.col("q.question").alias("question")).distinct()


def pair_answers(questions: DataFrame, answers: DataFrame, baseline: str, keep_missing: bool = False) -> DataFrame:
    """Questions with the baseline's and another method's answer (``collection_id, query, method, answer``).

    Without ``keep_missing`` both must exist; with it, every (question, method) is there
    and missing answers are null, to be counted.
    """
    key = ["collection_id", "query"]
    base = answers.filter(F.col("method") == baseline).select(*key, F.col("answer").alias("baseline_answer"))
    others = answers.filter(F.col("method") != baseline).select(*key, "method", "answer")
    if not keep_missing:
        return questions.join(base, key).join(others, key)
    grid = for_each(questions, others.select("method"))
    return grid.join(base, key, "left").join(others, [*key, "method"], "left")


def both_orders(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Each pair as ``ori`` and ``rev`` with its request id; needs collection_id, description, query."""
    one = pairs.withColumn("orientation", F.explode(F.array(F.lit("ori"), F.lit("rev"))))
    a = F.when(F.col("orientation") == "ori", F.col(first)).otherwise(F.col(second))
    b = F.when(F.col("orientation") == "ori", F.col(second)).otherwise(F.col(first))
    one = one.withColumn("answer_1", a).withColumn("answer_2", b)
    return one.withColumn("custom_id", request_id(F.col("collection_id"), F.col("description"), F.col("query"), F.col("answer_1"), F.col("answer_2"), F.col("orientation")))


def known_results(results: DataFrame, requests: DataFrame, key: str = "custom_id") -> DataFrame:
    """Results of requests that were made; unknown ids are left out."""
    return results.join(requests.select(key).distinct(), key, "left_semi")


def win_rates(votes: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain, metric, side, wins, total, percentage`` per domain and over all (domain null), for methods against each other.

    ``votes`` has custom_id, metric, winner (exactly ``Answer 1`` or ``Answer 2`` count),
    collection_id. A side is a method; a pair of methods is ``a < b`` by name, so both
    orders of a pair vote for the same sides. Grouping sets over rows that were summed
    per collection before.
    """
    parts = request_parts("custom_id")
    one = votes.filter(F.col("winner").isin("Answer 1", "Answer 2")).select("collection_id", "metric", "winner", parts.alias("p"))
    first, second = F.col("p.first"), F.col("p.second")
    won = F.when(F.col("winner") == "Answer 1", first).otherwise(second)
    one = one.select("collection_id", "metric", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), won.alias("w")).filter(F.col("a") != F.col("b"))
    small = one.groupBy("collection_id", "metric", "a", "b").agg(F.sum((F.col("w") == F.col("a")).cast("bigint")).alias("wins_a"), F.count("*").alias("total"))
    typed = small.join(domains.select("collection_id", F.col("type").alias("domain")).distinct(), "collection_id")
    out = typed.groupingSets([[F.col("domain"), F.col("metric"), F.col("a"), F.col("b")], [F.col("metric"), F.col("a"), F.col("b")]], F.col("domain"), F.col("metric"), F.col("a"), F.col("b")).agg(F.sum("wins_a").alias("wins_a"), F.sum("total").alias("total"))
    return out.withColumn("percentage_a", F.col("wins_a") * 100.0 / F.col("total"))


def score_means(scores: DataFrame, domain: str, method: str, metric: str, score: str) -> DataFrame:
    """Mean score by (domain, method, metric) and by (method, metric) with domain null; text that is no number and nulls are skipped."""
    value = F.col(score).cast("string").try_cast("double")
    one = scores.select(F.col(domain).alias("domain"), F.col(method).alias("method"), F.col(metric).alias("metric"), value.alias("v"))
    return one.groupingSets([[F.col("domain"), F.col("method"), F.col("metric")], [F.col("method"), F.col("metric")]], F.col("domain"), F.col("method"), F.col("metric")).agg(F.avg("v").alias("mean"), F.count("v").alias("n"), F.grouping(F.col("domain")).cast("int").alias("overall"))


def imputed_means(scores: DataFrame, group: list[str], candidates: list[Column], default: float = 3.0) -> DataFrame:
    """Mean where the first candidate that is there counts; missing or no number counts as ``default``."""
    value = F.coalesce(F.coalesce(*[c.cast("string") for c in candidates]).try_cast("double"), F.lit(default))
    return scores.groupBy(*group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def difference(means: DataFrame, key: list[str], method: str, a: str, b: str) -> DataFrame:
    """Means of two methods side by side with the difference ``b - a``; a missing mean is 0."""
    one = means.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col(method) == a, F.col("mean"))), F.lit(0.0)).alias("mean_a"), F.coalesce(F.max(F.when(F.col(method) == b, F.col("mean"))), F.lit(0.0)).alias("mean_b"))
    return one.withColumn("difference", F.col("mean_b") - F.col("mean_a"))


def coverage(expected: DataFrame, present: DataFrame, key: str = "custom_id") -> DataFrame:
    """``n_expected, n_present, n_missing`` of distinct ids."""
    want, have = expected.select(key).distinct(), present.select(key).distinct().withColumn("_h", F.lit(1))
    return want.join(have, key, "left").agg(F.count("*").alias("n_expected"), F.count("_h").alias("n_present"), (F.count("*") - F.count("_h")).alias("n_missing"))


def missing_ids(expected: DataFrame, present: DataFrame, key: str = "custom_id") -> DataFrame:
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def counts_by_collection(results: DataFrame) -> DataFrame:
    """Judged rows by collection and metric; ids of another form are ``unknown``."""
    name = F.regexp_extract("custom_id", "^([0-9]+)-", 1)
    return results.groupBy(F.when(name != "", name).otherwise("unknown").alias("collection"), "metric").agg(F.count("*").alias("n"), F.sum((~F.coalesce(F.col("winner").isin("Answer 1", "Answer 2"), F.lit(False))).cast("bigint")).alias("n_invalid"))


def token_price(requests: DataFrame, tokens: str, runs: int = 5, price: float = PRICE_PER_MILLION) -> DataFrame:
    """``n_requests, tokens, price`` of all requests."""
    return requests.agg(F.count("*").alias("n_requests"), F.coalesce(F.sum(F.col(tokens).cast("bigint")), F.lit(0)).alias("tokens")).withColumn("price", F.col("tokens") / 1e6 * price * runs)


def parse_results(answers: DataFrame, requests: DataFrame, valid: Column, shape: str, max_tries: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged rows, rows to ask again, and rows given up, from ``custom_id, answer, tries``.

    An answer is good if the JSON object in it satisfies ``valid`` (a condition on the
    column ``judged``). Ids that were never asked are left out; of several good answers to
    an id one is kept. Bad ones are asked again until ``max_tries`` are made.
    """
    known = known_results(answers, requests).withColumn("judged", json_object("answer", shape)).withColumn("_ok", F.coalesce(valid, F.lit(False)))
    good = known.filter("_ok").dropDuplicates(["custom_id"]).select("custom_id", "judged")
    bad = known.filter(~F.col("_ok")).join(good.select("custom_id"), "custom_id", "left_anti").groupBy("custom_id").agg(F.max(F.coalesce("tries", F.lit(1))).alias("tries"), F.max("answer").alias("answer"))
    return good, bad.filter(F.col("tries") < max_tries), bad.filter(F.col("tries") >= max_tries)


def query_count(results: DataFrame, custom_id: str = "custom_id") -> DataFrame:
    """``n_queries``: distinct (collection, query) among request ids."""
    parts = request_parts(custom_id)
    return results.select(parts["collection"].alias("c"), parts["query"].alias("q")).distinct().agg(F.count("*").alias("n_queries"))


# ---------------------------------------------------------------- task control

DONE = ("completed", "failed", "expired", "cancelled")


def build_tasks(parts: DataFrame, runs: int) -> DataFrame:
    """Every part in every run, with the key ``run:part`` and the fields of a fresh task."""
    one = parts.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return one.withColumn("key", F.concat_ws(":", F.col("run").cast("string"), F.col("part").cast("string"))).withColumn("status", F.lit("pending")).withColumn("submit_attempts", F.lit(0))


def select_tasks(tasks: DataFrame, run: int | None = None, part: int | None = None) -> DataFrame:
    out = tasks if run is None else tasks.filter(F.col("run") == run)
    return out if part is None else out.filter(F.col("part") == part)


def is_done(status: str = "status") -> Column:
    return F.coalesce(F.col(status).isin(*DONE), F.lit(False))


def status_counts(rows: DataFrame, bucket: Column, tokens: str | None = None) -> DataFrame:
    """Rows (and tokens) by bucket."""
    more = [F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")] if tokens else []
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *more)


def may_submit(tasks: DataFrame, max_active: int, max_tokens: int, max_attempts: int) -> DataFrame:
    """Pending tasks with ``may_submit``: within the limits of active tasks, of tokens in flight, and of attempts.

    Tasks are considered in the order of run and part; each takes its place and tokens.
    The list of tasks is short (one row a request file).
    """
    from pyspark.sql import Window

    active = tasks.filter(F.col("status") == "active").agg(F.count("*").alias("_n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_t"))
    before = Window.partitionBy(F.lit(1)).orderBy("run", "part").rowsBetween(Window.unboundedPreceding, 0)
    pending = tasks.filter((F.col("status") == "pending") & (F.col("submit_attempts") < max_attempts))
    queued = pending.withColumn("_k", F.count("*").over(before)).withColumn("_run", F.sum("tokens").over(before))
    joined = queued.join(F.broadcast(active.withColumn("_j", F.lit(1))), F.lit(1) == F.col("_j"))
    ok = (F.col("_n") + F.col("_k") <= max_active) & (F.col("_t") + F.col("_run") <= max_tokens)
    return joined.withColumn("may_submit", ok).drop("_k", "_run", "_n", "_t", "_j")


def unnested(judged: DataFrame, metrics: tuple[str, ...] = WINNER_METRICS) -> DataFrame:
    """A row for each criterion of a map column ``judged``."""
    return judged.select("custom_id", F.explode("judged").alias("metric", "v")).select("custom_id", "metric", F.col("v.Winner").alias("winner"), F.col("v.Explanation").alias("explanation"))
