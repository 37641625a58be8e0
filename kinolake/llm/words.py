"""Words of a text, free of writing that leaves the words the same.

Case, accents, punctuation, spacing, line layout, markup, invisible characters, broken
encoding, time marks, speaker labels and spoken fillers are taken away.
"""

from __future__ import annotations

import html
import re
import unicodedata

#: Spoken fillers in English, French, German and Spanish (each a run of words).
FILLERS = (
    "um", "uh", "uhm", "umm", "er", "erm", "hmm", "hm", "mm", "mhm", "you know", "i mean", "well", "like", "okay", "ok", "right", "so",
    "euh", "heu", "ben", "bah", "hein", "tu vois", "vous voyez", "enfin", "bon", "donc",
    "aeh", "ah", "aehm", "ehm", "na ja", "naja", "halt", "genau", "ja", "also",
    "eh", "este", "pues", "o sea", "vale", "bueno",
)

#: Cyrillic and Greek letters written for Latin ones of the same shape.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "ӏ": "l", "ɩ": "i",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_LOOKALIKE = str.maketrans(LOOKALIKES)
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f]")

_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{1,3}")
_BLOCK = re.compile(r"</?(?:div|p|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|blockquote|pre|hr)\b[^<>]*+>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]*+>")
_TIME = r"(?:\d+(?:\.\d+)?\s*s|\d{1,4}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)"
_ARROW_MARK = re.compile(rf"(?=[\[(\d])(?:[\[(]\s*)?{_TIME}\s*-{{1,2}}>\s*{_TIME}\s*[\])]?")
_BRACKET_MARK = re.compile(rf"[\[(<]\s*{_TIME}\s*[\])>]")
_LINE_MARK = re.compile(rf"(?m)^[ \t]*{_TIME}(?=[ \t]+\S)")
_SPEAKER = re.compile(r"(?m)^[ \t>*-]*(?:[A-Z]{2,12}|Speaker|Sprecher|Locuteur|Hablante)(?:[ \t]?\d{1,3})?[ \t]*:[ \t]")
_HYPHEN_BREAK = re.compile(r"[-\u2010\u2011]\s*[\n\r]\s*(?=\w)")
#: Combining marks, invisible and control characters (tab and line ends stay).
_DROP = re.compile("[\u0300-\u036f\u0483-\u0489\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u00ad\u034f\u061c\u180e\ufff9-\ufffb\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]+")


def _repair(match: re.Match) -> str:
    run = match[0]
    try:
        data = b"".join(c.encode("cp1252") if c > "\u00ff" or not "\x80" <= c <= "\x9f" else c.encode("latin-1") for c in run)
        return data.decode("utf-8")
    except UnicodeError:
        return run


def repair_encoding(text: str) -> str:
    """UTF-8 that was read as a one-byte code page, put right."""
    return _MOJIBAKE.sub(_repair, text)


#: For ASCII: letters in lower case, digits, and a space for everything else but what is dropped.
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_ASCII_DROP = bytes([*range(9), *range(14, 28), 127])
_MARKUP = re.compile("[^\\w\x00-\x7f]+")


def plain(text: str) -> str:
    """Lower-case letters and digits of any script, parted by spaces.

    Accents, punctuation, markup, invisible characters and time marks are gone.
    """
    ascii_ = text.isascii()
    if not ascii_ and ("\u00c3" in text or "\u00c2" in text or "\u00e2" in text or "\u00c5" in text):
        text = repair_encoding(text)
    if "&" in text:
        text = html.unescape(text)
        ascii_ = text.isascii()
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub(" ", text))
    if not ascii_:
        text = _DROP.sub("", unicodedata.normalize("NFKD", text))
    if "->" in text:
        text = _ARROW_MARK.sub(" ", text)
    if "[" in text or "(" in text or "<" in text:
        text = _BRACKET_MARK.sub(" ", text)
    if ":" in text:
        text = _SPEAKER.sub("", _LINE_MARK.sub(" ", text))
    if "\n" in text or "\r" in text:
        text = _HYPHEN_BREAK.sub("", text)
    if not ascii_:
        text = _MARKUP.sub(" ", text).casefold()
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKE)
        if not text.isascii():
            return text.translate(_ASCII_PUNCTUATION)
    return text.encode("ascii").translate(_ASCII, _ASCII_DROP).decode("ascii")


_ASCII_PUNCTUATION = {c: (None if c in _ASCII_DROP else " ") for c in range(128) if not chr(c).isalnum()}


def words(text: str | None) -> list[str]:
    """Words in order; hyphens and apostrophes part words (``l'art`` is ``l``, ``art``)."""
    return plain(text).split() if text else []


def filler_index(fillers: tuple[str, ...] = FILLERS) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    """Fillers of one word and of two."""
    return frozenset(f for f in fillers if " " not in f), frozenset(tuple(f.split(" ")) for f in fillers if f.count(" ") == 1)


def filler_mask(found: list[str], index=filler_index()) -> list[bool]:
    """Which of the words are spoken fillers."""
    single, double = index
    first = {a for a, _ in double}
    out, i, n = [False] * len(found), 0, len(found)
    while i < n:
        w = found[i]
        if w in single:
            out[i] = True
        elif w in first and i + 1 < n and (w, found[i + 1]) in double:
            out[i] = out[i + 1] = True
            i += 1
        i += 1
    return out
