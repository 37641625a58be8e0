"""Queries on loading records with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.plans.base import table
from kinolake.sources import rejects


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(rejects.load_records(table(spark, folder, "raw_results"))).select("line_id", "reason").distinct()


def p1_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the valid lines with the six verdicts."""
    rows = rejects.accepted(rejects.load_records(table(spark, folder, "raw_results")))
    verdict = lambda c: F.col(f"verdicts.`{c}`.Winner").alias(c.lower().replace(" ", "_"))
    return rows.select("line_id", "file_name", "custom_id", F.col("run").cast("bigint").alias("run"), "model", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"), "finished_at", *[verdict(c) for c in rejects.CRITERIA])


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.reject_counts(rejects.load_records(table(spark, folder, "raw_results")))


QUERIES = (p1_found, p1_typed, p1_counts)

# Fields by pattern: quoting first, then the fields' texts; JSON trailing commas, which the JSON functions accept, by pattern outside strings.
_LOADED = r"""l AS (SELECT DISTINCT line_id, file_name, regexp_replace(coalesce(line_text, ''), '\r$', '') AS t FROM raw_results),
    q AS (SELECT *, regexp_full_match(t, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's') AS quoted FROM l),
    f AS (SELECT *, CASE WHEN quoted THEN regexp_extract_all(',' || t, ',(?:"(?:[^"]|"")*"|[^",]*)', 0, 's') END AS raw FROM q),
    v AS (SELECT *, list_transform(raw, lambda x: CASE WHEN substr(x, 2, 1) = '"' THEN replace(substr(x, 3, length(x) - 3), '""', '"') ELSE substr(x, 2) END) AS v FROM f),
    j AS (SELECT *, CASE WHEN len(v) = 6 THEN v[6] END AS c FROM v),
    k AS (SELECT *, coalesce(json_valid(c) AND NOT regexp_matches(regexp_replace(c, '"(?:[^"\\]|\\.)*"', '0', 'gs'), ',\s*[}\]]|NaN|Infinity'), false) AS js FROM j),
    o AS (SELECT *, CASE WHEN js AND json_type(c) = 'OBJECT' THEN list_sort(json_keys(c)) = ['Comprehensiveness', 'Density', 'Depth', 'Empowerment', 'Overall Winner', 'Trustworthiness'] ELSE false END AS keyed FROM k),
    r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> 6 THEN 'column_count'
        WHEN NOT regexp_full_match(v[1], '[0-9]+-[^+]+\+\+query[0-9]+\+\+[^+]+\+\+[^+]+\+\+(ori|rev)', 's') OR NOT regexp_full_match(v[2], '[1-9][0-9]*') OR NOT regexp_full_match(v[4], '[0-9]*')
          OR NOT regexp_full_match(v[5], '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') OR substr(v[5], 12, 2) > '23' OR TRY_CAST(v[5] AS TIMESTAMP) IS NULL OR NOT keyed
          OR len(list_filter(['Comprehensiveness', 'Density', 'Depth', 'Empowerment', 'Overall Winner', 'Trustworthiness'],
             lambda m: NOT coalesce(json_type(c, '$."' || m || '"') = 'OBJECT' AND json_type(c, '$."' || m || '".Winner') = 'VARCHAR' AND json_extract_string(c, '$."' || m || '".Winner') IN ('Answer 1', 'Answer 2')
                AND json_type(c, '$."' || m || '".Explanation') = 'VARCHAR', false))) > 0 THEN 'invalid_value' END AS reason FROM o)"""

SQL = {
    "p1_found": f"WITH {_LOADED} SELECT DISTINCT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_counts": f"WITH {_LOADED} SELECT file_name, coalesce(reason, 'ok') AS reason, count(*) AS n_lines FROM r GROUP BY 1, 2",
    "p1_typed": f"""WITH {_LOADED} SELECT line_id, file_name, v[1] AS custom_id, CAST(v[2] AS BIGINT) AS run, v[3] AS model, TRY_CAST(nullif(v[4], '') AS BIGINT) AS prompt_tokens, CAST(v[5] AS TIMESTAMP) AS finished_at,
        json_extract_string(c, '$.Comprehensiveness.Winner') AS comprehensiveness, json_extract_string(c, '$.Empowerment.Winner') AS empowerment, json_extract_string(c, '$.Trustworthiness.Winner') AS trustworthiness,
        json_extract_string(c, '$.Depth.Winner') AS depth, json_extract_string(c, '$.Density.Winner') AS density, json_extract_string(c, '$."Overall Winner".Winner') AS overall_winner FROM r WHERE reason IS NULL""",
}
