"""Text functions as column expressions; Arrow UDFs only where the JVM has no builtin."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters, with and without tab and line ends kept.
CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"
CONTROL_BUT_LINES = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
#: Delimiters of extracted records.
TUPLE_END, RECORD_END, COMPLETE = "<|>", "##", "<|COMPLETE|>"
FIELD_SEP = "<SEP>"
#: What is taken from the front and the end of an entity's name.
NAME_LEAD, NAME_TAIL = "^(the|a|an|mr\\.|dr\\.)\\s+", "\\s+(inc\\.|llc\\.|corp\\.?)$"
_EDGE = "^[\\s\\x1c-\\x1f\\u0085\\u00a0]+|[\\s\\x1c-\\x1f\\u0085\\u00a0]+$"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Character references replaced; null stays null."""
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def strip(text: Column | str) -> Column:
    """Without white space at both ends (all kinds, not only spaces)."""
    return F.regexp_replace(text, _EDGE, "")


def clean_for_json(text: Column | str) -> Column:
    """Without control characters other than tab and line ends, in NFC."""
    return nfc(F.regexp_replace(text, CONTROL_BUT_LINES, ""))


def clean_nested(value: Column, kind: T.DataType) -> Column:
    """``clean_for_json`` for every string in arrays, maps and structs of any depth; keys and other types stay."""
    if isinstance(kind, T.StringType):
        return clean_for_json(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _strip_nested(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _strip_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[clean_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def _strip_nested(value: Column, kind: T.DataType) -> Column:
    """Inside arrays and maps no UDF can run, so there control characters go but forms are not composed."""
    if isinstance(kind, T.StringType):
        return F.regexp_replace(value, CONTROL_BUT_LINES, "")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _strip_nested(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _strip_nested(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_strip_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def clean_text(text: Column | str) -> Column:
    """Stripped, character references replaced, then without any control character."""
    return F.regexp_replace(html_unescape(strip(text)), CONTROL, "")


def quote_pattern(literal: str) -> str:
    """A literal as a pattern."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_by_markers(text: Column | str, markers: list[str]) -> Column:
    """Parts between any of the markers, stripped, without empty ones; without markers the text itself."""
    text = F.col(text) if isinstance(text, str) else text
    if not markers:
        return F.array(text)
    parts = F.split(text, "|".join(quote_pattern(m) for m in markers))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def record_body(record: Column | str) -> Column:
    """What stands between the first ``(`` and the last ``)`` after it on one line; null if there is none."""
    found = F.regexp_extract(record, "\\(([^\\n]*)\\)", 1)
    return F.when(F.col(record).rlike("\\([^\\n]*\\)") if isinstance(record, str) else record.rlike("\\([^\\n]*\\)"), found)


def is_float(text: Column | str) -> Column:
    """Digits with an optional sign and point (a fixed pattern); ``5.`` and ``1e3`` are none."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike("^[-+]?[0-9]*\\.?[0-9]+$")


def parse_weight(text: Column | str) -> Column:
    """The number, or 1.0 where the text is none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(is_float(text), text.try_cast("double")).otherwise(F.lit(1.0))


def enclose(value: Column | str) -> Column:
    """Numbers bare; text in double quotes without outer quotes and white space; nothing inside is escaped."""
    value = F.col(value) if isinstance(value, str) else value
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, _EDGE, ""), "^'+|'+$", ""), '^"+|"+$', "")
    return F.concat(F.lit('"'), text, F.lit('"'))


def csv_row(numbers_and_texts: list[tuple[Column, bool]]) -> Column:
    """One row of a context table: ``(value, is number)`` joined by a comma and a tab; nulls are empty text."""
    parts = [F.coalesce(v.cast("string"), F.lit("")) if number else enclose(F.coalesce(v.cast("string"), F.lit(""))) for v, number in numbers_and_texts]
    return F.concat_ws(",\t", *parts)


def csv_text(rows: Column | str) -> Column:
    """Rows of an array, one a line."""
    return F.array_join(rows, "\n")


def json_object_span(text: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    span = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(span != "", span)


def json_array_span(text: Column | str) -> Column:
    """From the first ``[`` to the last ``]``; null if there is none."""
    span = F.regexp_extract(text, "(?s)\\[.*\\]", 0)
    return F.when(span != "", span)


def json_object(text: Column | str, schema: str, strict: bool = False) -> Column:
    """The object in a model's answer; null where it doesn't parse, or an error if ``strict``."""
    return F.from_json(json_object_span(text), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def clock(seconds: Column | str) -> Column:
    """Seconds as ``h:m:s`` without padding."""
    s = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("bigint")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), F.floor((s % 3600) / 60).cast("string"), (s % 60).cast("string"))


def choice_options(query: Column | str) -> Column:
    """``array<struct<label, text>>`` of the options ``A)`` to ``D)`` or ``A.`` to ``D.`` in a question."""
    # a fixed value: what an option looks like
    pattern = "(?:\\(?([A-D])[\\)\\.])\\s*([^\\(\\n]+)"
    labels, texts = (F.regexp_extract_all(query, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(labels.alias("label"), texts.alias("text")), lambda o: F.struct(o["label"].alias("label"), strip(o["text"]).alias("text")))


def normal_entity_name(name: Column | str) -> Column:
    """Lower case, stripped, without a leading article or title and without a trailing company form."""
    text = F.lower(strip(name))
    return F.regexp_replace(F.regexp_replace(text, NAME_LEAD, ""), NAME_TAIL, "")


def ellipsis(text: Column | str, length: int = 150) -> Column:
    """The first characters and ``...`` where the text is longer."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def updated_draft(answer: Column | str, markers: tuple[str, ...] = ("Updated Draft", "Updated MCQ Analysis"), least: int = 50) -> Column:
    """The text after the last marker if it has more than ``least`` characters; else null."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    out = F.lit(None).cast("string")
    for marker in reversed(markers):
        tail = F.regexp_replace(F.substring_index(answer, marker, -1), "^[: \\n]+|[: \\n]+$", "")
        out = F.when(F.contains(answer, F.lit(marker)), F.when(F.length(tail) > least, tail)).otherwise(out)
    return out


def yes(answer: Column | str) -> Column:
    """Does the answer of a yes/no loop say yes, apart from case and quotes."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(answer), '^"+|"+$', ""), "^'+|'+$", "")) == "yes"


def chat_messages(turns: Column | str) -> Column:
    """Alternating user and assistant messages."""
    return F.transform(turns, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))


def fill_template(template: str, **values: Column) -> Column:
    """``{name}`` in the template replaced by columns, all at once; null counts as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest) if any("{" + n + "}" in rest for n in values) else None
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), F.coalesce(values[at[1]].cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def path_safe(name: Column | str) -> Column:
    """Dots, slashes, dashes, colons and similar signs as underscores."""
    return F.translate(name, "./\\- :", "______")
