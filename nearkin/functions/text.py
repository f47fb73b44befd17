"""Text cleaning and tokenizing as JVM-side column expressions.

Every pattern keeps to the syntax that Java's regex engine and RE2 share, but for possessive repeats, which RE2 does
without; so the same pattern can be checked on another engine. None repeats a group by backtracking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearkin.functions.wordlists import ENGLISH_STOP_WORDS

FENCED_CODE = r"(?s)```.*?(?:```|\z)"
INLINE_CODE = r"`([^`\n]*)`"
EMBEDDED_LINK = r"!?\[([^\[\]]*)\]\([^()\n]*\)"
# An address starts a word; the character before it is kept. It takes a full stop that would be left standing alone.
# A host is one run of its characters and can only begin where such a run does, so each run is searched once.
BARE_URL = (
    r"(?i)((?:^|[^a-z0-9.-])\.*)(?:(?:https?|ftp)://[^\s<>\"')]+|www\.[^\s<>\"')]+"
    r"|[a-z0-9-][a-z0-9.-]*\.[a-z]{2,}/[^\s<>\"')]*)(?:[ \t]+\.)?"
)
# Paired marks around a phrase. Underscores count only outside a word: snake_case stays.
EMPHASIS = [
    (r"\*\*([^*\n]+)\*\*", 1),
    (r"\*([^*\n]+)\*", 1),
    (r"~~([^~\n]+)~~", 1),
    (r"~([^~\n]+)~", 1),
]
UNDERSCORES = r"(^|[^\p{L}\p{N}_])_{1,2}([^_\n]+)_{1,2}([^\p{L}\p{N}_]|\z)"
HEADING = r"^\s{0,3}#{1,6}\s"

ALPHA_TOKEN = r"[a-zA-Z]{3,}"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
CONTRACTED_NOT = r"(\p{L})n't"
CONTRACTED_VERB = r"'(s|m|d|ll|re|ve)([^\p{L}]|\z)"
# Java repeats a group by recursion unless the repeat is possessive, and long chains would exhaust the stack.
PUNCT_TOKEN = r"\.\.\.|n't|'(?:ll|re|ve|s|m|d)|[\p{L}\p{N}_]+(?:[-./'][\p{L}\p{N}_]+)*+"


def strip_code(text: Column) -> Column:
    """Remove fenced blocks (an unclosed one to the end of the text); unwrap inline code."""
    return F.regexp_replace(F.regexp_replace(text, FENCED_CODE, " "), INLINE_CODE, "$1")


def strip_urls(text: Column) -> Column:
    """Replace ``[words](address)`` by its words, then remove bare addresses, with or without scheme."""
    return F.regexp_replace(F.regexp_replace(text, EMBEDDED_LINK, "$1"), BARE_URL, "$1")


def strip_markdown(text: Column) -> Column:
    """Remove paired emphasis marks and keep what they enclose. Heading lines stay."""
    for pattern, group in EMPHASIS:
        text = F.regexp_replace(text, pattern, f"${group}")
    # Twice: neighbouring phrases share the character between them.
    for _ in range(2):
        text = F.regexp_replace(text, UNDERSCORES, "$1$2$3")
    return text


def title_body(title: Column, body: Column) -> Column:
    """Title and body as one text; a missing part is left out."""
    return F.concat_ws("\n\n", title, body)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def _cased(text: Column, lower: bool) -> Column:
    return F.lower(text) if lower else text


def tokens_alpha(text: Column, lower: bool = True) -> Column:
    """Runs of at least three ASCII letters."""
    return F.regexp_extract_all(_cased(text, lower), F.lit(ALPHA_TOKEN), F.lit(0))


def tokens_word(text: Column, lower: bool = True) -> Column:
    """Runs of at least two word characters of any script."""
    return F.regexp_extract_all(_cased(text, lower), F.lit(WORD_TOKEN), F.lit(0))


def tokens_punct(text: Column, lower: bool = True) -> Column:
    """Word tokens with contractions split off (``don't`` gives ``do`` and ``n't``); numbers stay."""
    split = F.regexp_replace(_cased(text, lower), CONTRACTED_NOT, "$1 n't")
    split = F.regexp_replace(split, CONTRACTED_VERB, " '$1$2")
    return F.regexp_extract_all(split, F.lit(PUNCT_TOKEN), F.lit(0))


def tokens_standard(text: Column) -> Column:
    """Lower-cased text split at each white space character, as ``pyspark.ml``'s Tokenizer does."""
    return F.split(F.regexp_replace(F.lower(text), r"\s+\z", ""), r"\s")


def min_len(tokens: Column, length: int = 3) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= length)


def drop_stop_words(tokens: Column, words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Tokens outside ``words``; order and repeats are kept."""
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def common_words(left: Column, right: Column) -> Column:
    """Words two token arrays share, each once, in order."""
    return F.array_sort(F.array_intersect(left, right))
