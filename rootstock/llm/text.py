"""Wiki and web text as a reader sees it, and its words."""

from __future__ import annotations

import html
import re
import unicodedata

# Tags that end a line or cell; other tags may stand inside a word.
_BREAKS = "br|p|div|li|ul|ol|dl|dt|dd|tr|td|th|table|caption|hr|h[1-6]|blockquote|center|poem|gallery|section|references"
_BREAK = re.compile(rf"</?(?:{_BREAKS})\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:[\s/][^<>]*)?>")
_REF = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>(.*?)</ref\s*>", re.I | re.S)
_COMMENT = re.compile(r"<!--\s*-->|<!--|-->")
_LINK = re.compile(r"\[\[([^\[\]|]*)((?:\|[^\[\]|]*)*)\]\]")
_WEB = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_QUOTES = re.compile(r"''+")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_AMPERSANDS = re.compile(r"&(?:amp;)+(?=[#a-zA-Z])")
#: Zero-width and formatting characters, soft hyphens, variation selectors.
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
#: UTF-8 that was read as Windows-1252 or Latin-1.
_DAMAGED = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")


def _mend(m: re.Match) -> str:
    out = bytearray()
    for ch in m[0]:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return m[0]
            out.append(ord(ch))
    try:
        return out.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def decoded(text: str) -> str:
    """One encoding per letter: entities resolved and damaged UTF-8 mended, however often escaped or damaged, compatibility forms composed, nothing invisible."""
    while "&" in text and _ENTITY.search(text):
        # An ampersand escaped many times over is taken at once, so that few rounds are needed.
        plain = html.unescape(_AMPERSANDS.sub("&", text))
        if plain == text:
            break
        text = plain
    if not text.isascii():
        while (mended := _DAMAGED.sub(_mend, text)) != text:
            text = mended
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    return text


def _label(m: re.Match) -> str:
    return m[2].rpartition("|")[2] if m[2] and m[2].rpartition("|")[2].strip() else m[1]


_LINK_PARTS = re.compile(r"(\[+|\]+|\|)")


def _links(text: str) -> str:
    """Links of any depth as their labels, in one pass; a single bracket inside a link leaves it and what is around it as they are."""
    out: list[str] = []
    levels: list[tuple[int, list[int]]] = []  # where a link begins in out, and its bars
    for part in _LINK_PARTS.split(text):
        if part[:1] == "[":
            if len(part) & 1:
                levels.clear()
                out.append("[")
            for _ in range(len(part) // 2):
                levels.append((len(out), []))
                out.append("[[")
        elif part[:1] == "]":
            left = len(part)
            while left > 1 and levels:
                begin, bars = levels.pop()
                left -= 2
                out[begin] = ""
                if bars and any(x.strip() for x in out[bars[-1] + 1 :]):
                    out[begin : bars[-1] + 1] = [""] * (bars[-1] + 1 - begin)
                elif bars:
                    out[bars[0] :] = [""] * (len(out) - bars[0])
            if left:
                if left & 1 or levels:
                    levels.clear()
                out.append("]" * left)
        elif part == "|":
            if levels:
                levels[-1][1].append(len(out))
            out.append(part)
        else:
            out.append(part)
    return "".join(out)


def readable(text: str) -> str:
    """`decoded` text without markup: links show their labels, comments, tables and template arguments stay in place."""
    if "[" in text:
        shown = _LINK.sub(_label, text)
        if shown != text and "[[" in shown:
            shown = _links(text)
        text = _WEB.sub(r" \1 ", shown)
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", _COMMENT.sub("", text)))
    return _QUOTES.sub("", text) if "''" in text else text


#: Stands in a text where something was lifted out.
LIFTED = "\x00"


def apart(text: str) -> str | None:
    """`decoded` text with footnotes and templates lifted out of the sentences that they interrupt, to the end; None if there are none.

    LIFTED marks where they were.
    """
    held: list[str] = []

    def lift(m: re.Match) -> str:
        if m[1]:
            held.append(m[1])
        return LIFTED

    out = _REF.sub(lift, text) if "<ref" in text or "<REF" in text or "<Ref" in text else text
    shorter = _TEMPLATE.sub(lift, out) if "{{" in out else out
    if shorter != out and "{{" in shorter:
        shorter = _templates(shorter, held)
    out = shorter
    return None if out == text else out + "\n" + "\n".join(held).replace(LIFTED, "")


_BRACES = re.compile(r"(\{+|\}+)")


def _templates(text: str, held: list[str]) -> str:
    """The text with templates of any depth lifted out, in one pass; a single brace inside a template leaves it and what is around it as they are."""
    out: list[str] = []
    begins: list[int] = []
    for part in _BRACES.split(text):
        if part[:1] == "{":
            if len(part) & 1:
                begins.clear()
                out.append("{")
            for _ in range(len(part) // 2):
                begins.append(len(out))
                out.append("{{")
        elif part[:1] == "}":
            left = len(part)
            while left > 1 and begins:
                at, left = begins.pop(), left - 2
                if inner := "".join(out[at + 1 :]):
                    held.append(inner)
                out[at:] = [LIFTED]
            if left:
                if left & 1 or begins:
                    begins.clear()
                out.append("}" * left)
        else:
            out.append(part)
    return "".join(out)


def words(text: str) -> list[str]:
    """Words of readable text in lower case, without punctuation."""
    return _WORD.findall(text.casefold() if not text.isascii() else text.lower())
