"""Runs over questions: scenarios of the refinement loop, a plain baseline, resumed where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.operators.evaluation import explode_questions
from kinolake.operators.tables import Store
from kinolake.plans.engine import Engine
from kinolake.plans.refine import Model, Settings, rows_of, run
from kinolake.sources.files import append_answers
from kinolake.streaming.ingest import unanswered

#: The scenarios that are compared, by name.
SCENARIOS = {
    "full_framework": {"memory": True},
    "baseline_with_debate": {"memory": False},
    "no_debate": {"memory": True, "max_rounds": 0},
    "critique_with_evidence": {"memory": True, "critique_sees_evidence": True},
    "defender_no_tools": {"memory": True, "use_tools": False},
}
ANSWERS = "collection_id string, query int, scenario string, answer string"
KEY = ["collection_id", "query", "scenario"]


def settings_of(scenario: str) -> Settings:
    """The loop's settings of a scenario; an unknown name is an error."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario {scenario!r} is not one of {sorted(SCENARIOS)}")
    return Settings(**{k: v for k, v in SCENARIOS[scenario].items() if k != "memory"})


def open_work(questions: DataFrame, scenarios: list[str], answers: DataFrame) -> DataFrame:
    """``collection_id, query, question, scenario`` that has no answer yet."""
    asked = explode_questions(questions).withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    return unanswered(asked, answers, KEY).select("collection_id", "query", "question", "scenario")


def run_all(store: Store, questions: DataFrame, scenarios: list[str], answer: Callable[[str, str, str], str], name: str = "answers") -> int:
    """Answers every (question, scenario) that is open, one after the other; how many were.

    Each answer is stored as it comes, so a run that stops at an error goes on where it
    stopped. The list of questions is short (one row a question and scenario).
    """
    todo = open_work(questions, scenarios, store.read(name, ANSWERS)).orderBy("collection_id", "scenario", "query").collect()
    for n, row in enumerate(todo):
        try:
            text = answer(row.collection_id, row.scenario, row.question)
        except Exception as error:
            raise RuntimeError(f"stopped after {n} answers at collection {row.collection_id}, scenario {row.scenario}, question {row.query}: {error}") from error
        append_answers(store, name, store.spark.createDataFrame([(row.collection_id, row.query, row.scenario, text)], ANSWERS), KEY)
    return len(todo)


def debate(engines: dict[bool, Engine], model: Model) -> Callable[[str, str, str], str]:
    """Answers by the refinement loop; ``engines`` holds the one with and the one without memory."""

    def answer(collection: str, scenario: str, question: str) -> str:
        engine = engines[SCENARIOS[scenario]["memory"]]
        tools = {"search_text": lambda q: rows_of(engine.text_evidence(q, 1)), "search_graph": lambda q: rows_of(engine.graph_evidence(q, 1)), "search_segments": lambda q: rows_of(engine.visual_evidence(q, 1))}
        return str(run(model, question, rows_of(engine.evidence(question)), tools, settings_of(scenario))[0]["answer"])

    return answer


def plain(engine: Engine, chat: Callable[[str], str]) -> Callable[[str, str, str], str]:
    """Answers from the context alone."""
    return lambda collection, scenario, question: chat(engine.prompt(question))


def compare(answers: DataFrame, a: str, b: str) -> DataFrame:
    """``collection_id, query, answer_a, answer_b`` of two scenarios, questions that both have answered."""
    side = lambda s, c: answers.filter(F.col("scenario") == s).select("collection_id", "query", F.col("answer").alias(c))
    return side(a, "answer_a").join(side(b, "answer_b"), ["collection_id", "query"])
