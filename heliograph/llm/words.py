"""Words of raw texts, the same for every text operator: markup, invisible characters, case and punctuation do not count."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import regex

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿￹-￻]")
_BLOCK = re.compile(r"<!--.*?-->|<(script|style)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
#: A tag begins with a letter, so "a < b" stays text; tags inside a line of text join nothing and split nothing.
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>|<\?[^<>]*>")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);?")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_CLUSTER, _ANY = regex.compile(r"\X"), re.compile(r"(?s).")


def plain(text: str | None) -> str:
    """``text`` without markup, with entities resolved and invisible characters removed; '' for null."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _BLOCK.sub(" ", text)))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if "<" in text:
            text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of a text, in lower case."""
    text = plain(text).lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def words_in_place(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of ``words``, with their places in ``text`` itself."""
    if not text:
        return []
    at = [(k, k + 1) for k in range(len(text))]

    def sub(pattern, make: Callable[[str], str], text: str, at: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
        parts, places, last = [], [], 0
        for m in pattern.finditer(text):
            new = make(m.group())
            parts += [text[last : m.start()], new]
            places += at[last : m.start()] + [(at[m.start()][0], at[m.end() - 1][1])] * len(new)
            last = m.end()
        return "".join([*parts, text[last:]]), places + at[last:]

    blank, none = (lambda _: " "), (lambda _: "")
    if "<" in text:
        for pattern, make in ((_BLOCK, blank), (_INLINE, none), (_TAG, blank)):
            text, at = sub(pattern, make, text, at)
    if "&" in text:
        text, at = sub(_ENTITY, html.unescape, text, at)
        if "<" in text:
            for pattern, make in ((_INLINE, none), (_TAG, blank)):
                text, at = sub(pattern, make, text, at)
    if not text.isascii():
        text, at = sub(_INVISIBLE, none, text, at)
        text, at = sub(_CLUSTER, lambda x: unicodedata.normalize("NFKC", x), text, at)
    text, at = sub(_ANY, str.lower, text, at)
    return [(m.group(), at[m.start()][0], at[m.end() - 1][1]) for m in (_ASCII_WORD if text.isascii() else _WORD).finditer(text)]
