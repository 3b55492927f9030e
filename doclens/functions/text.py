"""Tokenising as built-in string expressions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the word tokeniser. White space is a plain blank by then.
NUMBER_RUN = r"(?:\p{Nd}+[.,]?)+"
SENTENCE_END = r"[.?!]"
OTHER_MARK = r"[^\p{L}\p{N}_ <>]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
# Up to here few characters fold to another than their small letter; most texts have none beyond.
PLAIN_END = "\u0148"


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[dict[str, str], dict[str, str]]:
    """Code points that still change when folded after lower-casing: one-to-one, one-to-many."""
    single, multiple = {}, {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        folded = char.casefold()
        if folded != char and char.lower() == char:
            (single if len(folded) == 1 else multiple)[char] = folded
    return single, multiple


def _class(chars: list[str], gap: int = 1) -> str:
    """A character class of ``chars``; ranges less than ``gap`` apart are one, with what lies between."""
    codes = sorted(map(ord, chars))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code <= ranges[-1][1] + gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges) + "]"


@lru_cache(maxsize=1)
def _lowered_from() -> dict[str, list[str]]:
    """The characters above ``PLAIN_END`` that give a character when lower-cased, itself included. Capital sigma gives the
    final one at the end of a word."""
    sources: dict[str, list[str]] = {"ς": ["Σ"]}
    for char in map(chr, range(ord(PLAIN_END) + 1, sys.maxunicode + 1)):
        for lowered in {char, *char.lower()}:
            sources.setdefault(lowered, []).append(char)
    return sources


@lru_cache(maxsize=1)
def _blanks() -> dict[str, str]:
    """Every white-space character to a plain blank."""
    spaces = filter(str.isspace, map(chr, range(sys.maxunicode + 1)))
    return {char: " " for char in spaces if char != " "}


def fold_case(text: Column, also: dict[str, str] | None = None) -> Column:
    """Full Unicode case folding; ``also`` adds further one-to-one rewrites to the same pass.

    ``lower`` and, for a text that may need more, ``translate`` do nearly all of it. The roughly hundred letters
    that fold to several (ligatures, accented Greek) are rewritten one by one. Both cost far more a character
    than the rest, so only texts that hold such a character take that way; the others need a few plain
    replacements. What decides is a wider class of the given text, so the text is not folded to decide.
    """
    single, multiple = _fold_rules()
    multiple = dict(multiple)
    sharp_s = multiple.pop("ß")
    single = single | (also or {})
    lowered = F.lower(text)
    plain = reduce(_replaced, _by_target(c for c in single.items() if c[0] <= PLAIN_END), lowered)
    full = F.replace(F.translate(lowered, "".join(single), "".join(single.values())), F.lit("ß"), F.lit(sharp_s))
    rare = F.create_map(*[F.lit(part) for pair in multiple.items() for part in pair])
    rewritten = F.array_join(
        F.transform(F.split(full, ""), lambda char: F.coalesce(F.element_at(rare, char), char)), ""
    )
    beyond = text.rlike(rf"[\x{{{ord(PLAIN_END) + 1:x}}}-\x{{{sys.maxunicode:x}}}]")
    return (
        F.when(beyond & text.rlike(_sources(multiple)), rewritten)
        .when(beyond & text.rlike(_sources(single)), full)
        .otherwise(F.replace(plain, F.lit("ß"), F.lit(sharp_s)))
    )


def _by_target(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(all characters that are rewritten to it, target)."""
    chars: dict[str, str] = {}
    for char, target in rules:
        chars[target] = chars.get(target, "") + char
    return [(sources, target) for target, sources in chars.items()]


def _replaced(text: Column, rule: tuple[str, str]) -> Column:
    """One character is replaced, of several any. A class of listed characters, not ranges, is a bit set up to U+00FF."""
    chars, target = rule
    if len(chars) == 1:
        return F.replace(text, F.lit(chars), F.lit(target))
    return F.regexp_replace(text, "[" + "".join(rf"\x{{{ord(c):x}}}" for c in chars) + "]", target)


def _sources(chars: Iterable[str]) -> str:
    """A class of at least the characters beyond ``PLAIN_END`` that are, or give when lower-cased, one of ``chars``."""
    sources = _lowered_from()
    return _class([source for char in chars for source in sources.get(char, [])], gap=16)


def tokenise_words(text: Column) -> Column:
    """Words in order, with numbers, sentence ends and other marks as symbols.

    A number takes the ``.`` or ``,`` right after it along, so ``In 1987. The``
    has no sentence end.
    """
    text = fold_case(F.coalesce(text, F.lit("")), _blanks())
    text = F.regexp_replace(text, NUMBER_RUN, " <NUMBER> ")
    text = F.regexp_replace(text, SENTENCE_END, " <STOP> ")
    text = F.regexp_replace(text, OTHER_MARK, " <PUNCT> ")
    return F.array_remove(F.split(text, " "), "")


def has_words(text: Column, least: int) -> Column:
    """True only for a text whose word tokens are ``least`` or more, told without making them; null for a null text.

    Counted are the characters that begin a run of others than white space after a plain blank. ``tokenise_words`` makes
    a token or more of each run: folding neither removes nor blanks a character, and no pattern reaches over a
    blank. Runs after other white space are not counted. The text is read up to the run that decides.
    """
    blanks = sorted(map(ord, [" ", *_blanks()]))
    gaps = [(low + 1, high - 1) for low, high in zip(blanks, [*blanks[1:], sys.maxunicode + 1]) if low + 1 < high]
    begins = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in gaps)  # ASCII first, most texts need no more
    return text.rlike(rf"^(?:[^ ]* [^{begins}]*+[{begins}]){{{least}}}+")


def tokenise_chars(text: Column) -> Column:
    """One symbol per code point."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ""), "")


def word_terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters: the terms of library-style tf-idf.

    Replace and split: collecting regular-expression matches copies the text for every match.
    """
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "), " ")
    return F.filter(words, lambda word: F.length(word) > 1)


# A level is a name or any Column -> Column function.
TOKENISERS: dict[str, Callable[[Column], Column]] = {
    "word": tokenise_words,
    "char": tokenise_chars,
    "term": word_terms,
}


def tokeniser(level: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The tokeniser of a level; any name other than ``word`` or ``term`` means characters."""
    if callable(level):
        return level
    return TOKENISERS.get(level, tokenise_chars)


def joined(tokens: Column) -> Column:
    """Tokens as one text, one blank between them."""
    return F.array_join(tokens, " ")
