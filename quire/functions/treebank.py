"""Treebank words of a text as spans: ordered rewrites that set words apart, with a map back to the source.

Every rule puts blanks around parts of what it matches, and some write a double quote, or a pair of quotes, as a pair of
others.  Nothing else changes, so the words of the rewritten text are found in the source one behind the other.
"""

from __future__ import annotations

import re

# The public Treebank rules for splitting words, in order.  A replacement lists groups (numbers), blanks, and
# for a quote that is written anew its text with the group that it stands for.
OPENING = [
    (r'^(")', [("``", 1)]),
    (r"(``)", [" ", 1, " "]),
    (r"([ \(\[{<])(\"|'{2})", [1, " ", ("``", 2), " "]),
]
PUNCTUATION = [
    (r"([:,])([^\d])", [" ", 1, " ", 2]),
    (r"([:,])$", [" ", 1, " "]),
    (r"(\.\.\.)", [" ", 1, " "]),
    (r"([;@#$%&])", [" ", 1, " "]),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", [1, " ", 2, 3, " "]),
    (r"([?!])", [" ", 1, " "]),
    (r"([^'])(') ", [1, " ", 2, " "]),
    (r"([\]\[\(\)\{\}\<\>])", [" ", 1, " "]),
    (r"(--)", [" ", 1, " "]),
]
CLOSING = [
    (r"('')", [" ", 1, " "]),
    (r'(")', [" ", ("''", 1), " "]),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", [1, " ", 2, " "]),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", [1, " ", 2, " "]),
]
PAIRS = [("can", r"not\b"), ("d", r"'ye\b"), ("gim", r"me\b"), ("gon", r"na\b"), ("got", r"ta\b"), ("lem", r"me\b"), ("more", r"'n\b"), ("wan", r"na(?=\s)")]
CONTRACTIONS = [(rf"(?i)\b({a})({b})", [" ", 1, " ", 2, " "]) for a, b in PAIRS]
CONTRACTIONS += [(rf"(?i) ('t)({b})\b", [" ", 1, " ", 2, " "]) for b in ("is", "was")]



def _rules(listed: list) -> list[tuple[re.Pattern, str]]:
    put = lambda x: x if isinstance(x, str) else rf"\g<{x}>" if isinstance(x, int) else x[0]
    return [(re.compile(pattern), "".join(map(put, parts))) for pattern, parts in listed]


_BEFORE, _AFTER = _rules(OPENING + PUNCTUATION), _rules(CLOSING + CONTRACTIONS)


def _end(text: str, at: int, word: str) -> int:
    """Where a word that begins at a place of the source ends; a pair of quotes may stand for a double quote, or for another pair."""
    i = 0
    while i < len(word):
        pair = word[i : i + 2] in ("``", "''")
        i += 2 if pair else 1
        at += 2 if pair and text[at] != '"' else 1
    return at


def treebank_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the Treebank words of a text, in order; null and empty texts have none."""
    text = text or ""
    new = text
    for pattern, put in _BEFORE:
        new = pattern.sub(put, new)
    new = f" {new} "
    for pattern, put in _AFTER:
        new = pattern.sub(put, new)
    spans, at = [], 0
    for word in new.split():
        # words are the text's characters in order, less its white space
        while text[at].isspace():
            at += 1
        end = at + len(word) if text.startswith(word, at) else _end(text, at, word)
        spans.append((at, end))
        at = end
    return spans
