"""Boundaries to models: protocols and deterministic stand-ins.

The stand-ins are no models: they make pipelines and tests repeatable without a network.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import partial
from typing import Protocol

import numpy as np

from kinolake.functions.text import COMPLETE, FIELD_SEP, RECORD_END, TUPLE_END


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]")


class Chat(Protocol):
    def __call__(self, messages: list[dict[str, str]], temperature: float = 0.0) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from word hashes: texts with the same words are near each other."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
            norm = np.sqrt(out[i] @ out[i])
            out[i] = out[i] / norm if norm else out[i]
        return out

    return run


def name_extractor(text: str, most: int | None = None) -> str:
    """Extraction records from capitalised words: neighbours in the text are related. All of them, unless ``most`` names are asked for."""
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", text or "")))[:most]
    records = [f'("entity"{TUPLE_END}{n}{TUPLE_END}NAME{TUPLE_END}{n} is mentioned)' for n in names]
    records += [f'("relationship"{TUPLE_END}{a}{TUPLE_END}{b}{TUPLE_END}{a} is near {b}{TUPLE_END}1)' for a, b in zip(names, names[1:])]
    return RECORD_END.join(records) + COMPLETE


def keyword_filter(question: str) -> Callable[[str], str]:
    """Answers yes where a text shares a longer word with the question."""
    wanted = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 4}
    return lambda text: "Yes" if wanted & set(re.findall(r"\w+", (text or "").lower())) else "No"


def identity_rewrite(question: str) -> str:
    return question


def keywords(question: str, least: int = 4) -> list[str]:
    """Distinct longer words in order."""
    return list(dict.fromkeys(w for w in re.findall(r"\w+", question.lower()) if len(w) > least))


def echo_chat(messages: list[dict[str, str]], temperature: float = 0.0) -> str:
    """Answers with the last message, so that loops can be tested."""
    return "Updated Draft: " + (messages[-1]["content"] if messages else "")


def with_retries(call: Callable, attempts: int = 3, error: type[Exception] = Exception) -> Callable:
    """At most ``attempts`` tries; the last error is raised."""

    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except error:
                if k + 1 == attempts:
                    raise
        return None

    return run


def says_yes(answer: str) -> bool:
    """Does a yes/no answer say yes, apart from case, space and quotes."""
    return answer.strip().strip('"').strip("'").lower() == "yes"


def extract_and_glean(text: str, extract: Callable[[str], str], glean: Callable[[list[dict]], str] | None = None, more: Callable[[list[dict]], str] | None = None, rounds: int = 1) -> str:
    """The extraction of a text and what up to ``rounds`` further calls add; between two calls the model is asked whether to go on."""
    answer = extract(text)
    if glean is None or rounds <= 0:
        return answer
    history = [{"role": "user", "content": text}, {"role": "assistant", "content": answer}]
    for k in range(rounds):
        found = glean(history)
        answer += found
        history += [{"role": "user", "content": "continue"}, {"role": "assistant", "content": found}]
        if k + 1 == rounds or more is None or not says_yes(more(history)):
            break
    return answer


def keep_first(name: str, descriptions: list[str], tokens: int = 500) -> str:
    """Stand-in for a summary: whole descriptions, in order, while they stay under ``tokens``; at least the first."""
    out, size = descriptions[:1], len(descriptions[0].split()) if descriptions else 0
    for text in descriptions[1:]:
        size += len(text.split())
        if size >= tokens:
            break
        out.append(text)
    return FIELD_SEP.join(out)


def no_speech(path: str, start_s: int, end_s: int) -> str:
    """Stand-in for speech recognition: missing audio has an empty transcript."""
    return ""


def no_caption(path: str, times: list[float], transcript: str) -> str:
    """Stand-in for a caption."""
    return "None"


class CachedChat:
    """A chat whose answers are kept by a key over model, messages and options, in memory and in a stored table."""

    def __init__(self, chat: Callable, store=None, model: str = "stand-in", name: str = "answers_cache"):
        self.chat, self.store, self.model, self.name = chat, store, model, name
        self.hits, self.fresh = 0, {}
        known = store.read(name) if store is not None else None
        self.known = {r.key: r.answer for r in known.select("key", "answer").collect()} if known is not None else {}

    def key(self, messages: list[dict], **options) -> str:
        return hashlib.sha256(json.dumps({"model": self.model, "messages": messages, "options": options}, sort_keys=True).encode()).hexdigest()

    def __call__(self, messages: list[dict], **options) -> str:
        key = self.key(messages, **options)
        if key in self.known:
            self.hits += 1
            return self.known[key]
        answer = self.chat(messages, **options)
        self.known[key] = self.fresh[key] = answer
        return answer

    def flush(self) -> int:
        """Appends the new answers to the stored table; how many there were."""
        n, rows = len(self.fresh), [(k, self.model, a) for k, a in self.fresh.items()]
        if n and self.store is not None:
            self.store.append(self.name, self.store.spark.createDataFrame(rows, "key string, model string, answer string"))
        self.fresh = {}
        return n


class ModelConfig:
    """One chat client under the names of a best and a cheap model, with bounded tries and an optional stored cache, and an embedder."""

    def __init__(self, chat: Callable, embed: Callable, best: str = "best", cheap: str = "cheap", tries: int = 3, store=None):
        self.embed = embed
        bound = lambda model: CachedChat(with_retries(partial(chat, model=model), tries), store, model)
        self.best, self.cheap = bound(best), bound(cheap)

    def flush(self) -> int:
        return self.best.flush() + self.cheap.flush()


def clean_value(value):
    """A value of any depth with every string free of control characters other than tab and line ends, of lone surrogates, and composed."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", _CONTROL.sub("", value))
    if isinstance(value, dict):
        return {k: clean_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(clean_value(v) for v in value)
    return value
