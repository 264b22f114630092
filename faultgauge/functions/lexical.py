"""Lexical source-code measures as Column expressions over one text column.

All character classes are spelled out, so results do not depend on how a regex dialect reads
``\\w``, ``\\s``, ``\\b`` or ``.``: a word character is any letter, number or underscore.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from faultgauge import constants as C

# Spelled out one by one, these are a single test for the matcher; ranges are one test each.
_LETTERS = string.ascii_letters + "_"
WORD = rf"[{_LETTERS}{string.digits}\p{{L}}\p{{N}}]"
BEFORE_WORD = rf"(?<!{WORD})"
AFTER_WORD = rf"(?!{WORD})"
IDENTIFIER = rf"[{_LETTERS}][{_LETTERS}{string.digits}]*"

# Line separators and white space, as in Unicode-aware string methods.
_SEPARATORS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
_BREAKS = [chr(c) for c in (10, 13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029)]
_BLANKS = r"\t\x1f \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{_SEPARATORS}{_BLANKS}]"
# Of a carriage return and a line feed, the latter is the break.
LINE_BREAK = rf"[{_SEPARATORS}](?<!\r(?=\n))"
BLANK = f"[{_BLANKS}]"


def one_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def starts_with(words: list[str]) -> str:
    """Look ahead at one character, so that a position where no word can start costs one test."""
    return f"(?=[{''.join(sorted({re.escape(w[0]) for w in words}))}])"


def word_start(words: list[str]) -> str:
    return f"{starts_with(words)}{BEFORE_WORD}(?:{one_of(words)})"


def whole_word(words: list[str]) -> str:
    return word_start(words) + AFTER_WORD


def symbol(words: list[str]) -> str:
    """The first of the words that matches, by what may follow each first character."""
    follow = {w[0]: [v[1:] for v in words if v[0] == w[0]] for w in words}
    branches = [f"{re.escape(first)}(?:{one_of(rest)})" for first, rest in follow.items()]
    return f"{starts_with(words)}(?:{'|'.join(branches)})"


SYMBOL = symbol(C.OPERATOR_SYMBOLS)
# Group 1: an ASCII identifier or a decimal number, each between word boundaries. Other runs of word characters are taken
# whole and leave the group empty, so that every match starts where a word may. One may after a character of two code
# units, of which BEFORE_WORD sees the last alone.
_ONE_UNIT = rf"[{_LETTERS}{string.digits}[\p{{L}}\p{{N}}&&[\x{{80}}-\x{{ffff}}]]]"
_TWO_UNITS = r"[\p{L}\p{N}&&[^\x{0}-\x{ffff}]]"
TOKEN = rf"({IDENTIFIER}+{AFTER_WORD}|\p{{Nd}}++(?:\.\p{{Nd}}++)?{AFTER_WORD})|{_ONE_UNIT}++{_TWO_UNITS}?+|{_TWO_UNITS}"


def named(words: list[str]) -> str:
    """One of the words before a name. A name that is itself one of them names nothing more."""
    return rf"(?:{one_of(words)}){SPACE}++(?:(?:{one_of(words)})(?={SPACE})|(?=[{_LETTERS}]))"


# Definitions, members that are called or declared, and classes. Names are looked at only: they may be words of another kind.
DEFINITION = (
    rf"{starts_with([*C.DEFINITION_WORDS, *C.MEMBER_WORDS, 'class'])}{BEFORE_WORD}(?:{named(C.DEFINITION_WORDS)}|{named(['class'])}"
    rf"|(?:{one_of(C.MEMBER_WORDS)}){SPACE}++(?={IDENTIFIER}+{SPACE}*+\())"
)
# An identifier and a bracket, read backwards: brackets are fewer than words.
CALL = rf"\({SPACE}*+[a-zA-Z0-9_]*+(?<=[a-zA-Z_]){AFTER_WORD}"

# Possessive repeats: a literal of any length is matched without recursion.
_QUOTES = ['"', "'", "`"]
_LITERALS = [rf"{q}(?:\\[^\n]|[^{q}\\]++)*+{q}" for q in _QUOTES]
STRING_LITERAL = f"{starts_with(_QUOTES)}(?:{'|'.join(_LITERALS)})"

DECISIONS = {
    lang: f"{starts_with(words + C.DECISION_SYMBOLS[lang])}(?:{whole_word(words)}|{symbol(C.DECISION_SYMBOLS[lang])})"
    for lang, words in C.DECISION_WORDS.items()
}


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names more than once, without a projection that would copy the value."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(text.rlike(f"[^{SPACE[1:-1]}]"), F.lit(False))


def line_counts(text: Column) -> Column:
    """``total``, ``blank`` and ``comment`` lines: white space only, and those that start with a comment mark of any language.

    One scan for all three takes what comes first in each line after its blanks. The text is led by one break, so that
    every line follows one.
    """
    first = rf"{LINE_BREAK}{BLANK}*+(?=([\s\S]{{0,{max(map(len, C.COMMENT_LINE_MARKERS))}}}))"
    starts = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(first), F.lit(1))
    ended = reduce(Column.__or__, [text.endswith(b) for b in _BREAKS], text == "")

    def counted(starts: Column) -> Column:
        unended = (F.element_at(starts, -1) == "") & ~ended
        marked = lambda s: reduce(Column.__or__, [s.startswith(m) for m in C.COMMENT_LINE_MARKERS])
        return F.struct(
            (F.size(starts) - ended.cast("int")).alias("total"),
            (F.size(F.filter(starts, lambda s: F.left(s, F.lit(1)).isin(_BREAKS))) + unended.cast("int")).alias("blank"),
            F.size(F.filter(starts, marked)).alias("comment"),
        )

    return F.when(text.isNotNull(), computed_once(starts, counted))


def _remove(text: Column, *patterns: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_comments(text: Column, lang: Column) -> Column:
    """Line comments go first, block comments second, both before string literals are masked."""
    return (
        F.when(lang == "python", _remove(text, r"#[^\n]*", r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"))
        .when(lang == "ruby", _remove(text, r"#[^\n]*", r"=begin[\s\S]*?=end"))
        .otherwise(_remove(text, r"//[^\n]*", r"/\*[\s\S]*?\*/"))
    )


def mask_strings(text: Column) -> Column:
    return F.regexp_replace(text, STRING_LITERAL, " STRING_LITERAL ")


def symbols(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(SYMBOL), F.lit(0))


def words(clean: Column) -> Column:
    """All identifiers and numbers, keywords among them."""
    return F.array_remove(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(1)), "")


def keywords(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(C.OPERATOR_KEYWORDS))


def operators(clean: Column) -> Column:
    return F.concat(symbols(clean), keywords(words(clean)))


def operands(clean: Column) -> Column:
    return F.filter(words(clean), lambda w: ~w.isin(C.OPERATOR_KEYWORDS))


def decision_count(clean: Column, lang: Column) -> Column:
    special = [name for name in DECISIONS if name != "generic"]
    chain = F
    for name in special:
        chain = chain.when(lang == name, F.regexp_count(clean, F.lit(DECISIONS[name])))
    return chain.otherwise(F.regexp_count(clean, F.lit(DECISIONS["generic"])))


def definition_count(clean: Column) -> Column:
    return F.regexp_count(clean, F.lit(DEFINITION))


def call_count(clean: Column) -> Column:
    return F.regexp_count(F.reverse(clean), F.lit(CALL))
