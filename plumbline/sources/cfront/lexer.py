"""Tokens of C and C++ by one pattern over spliced text; offsets are bytes of the file.

Line splices are taken out first, with a map back to the file; a raw string is matched in the file itself, as
splices are part of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# The keywords of C++20 and C11, and the alternative spellings of operators.
KEYWORDS = frozenset(
    """alignas alignof and and_eq asm auto bitand bitor bool break case catch char char8_t char16_t char32_t class co_await co_return
    co_yield compl concept const const_cast consteval constexpr constinit continue decltype default delete do double dynamic_cast else
    enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not not_eq nullptr operator
    or or_eq private protected public register reinterpret_cast requires restrict return short signed sizeof static static_assert
    static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void
    volatile wchar_t while xor xor_eq _Bool _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local""".split()
)
RAW_PREFIXES = frozenset(("R", "LR", "uR", "UR", "u8R"))
_TOKEN = re.compile(
    r"""(?P<space>[ \t\v\f\r\n]+)|(?P<line>//[^\n]*)|(?P<block>/\*(?:.*?\*/|.*))|(?P<number>\.?[0-9](?:'?[A-Za-z0-9_]|\.|(?<=[eEpP])[+-])*)
    |(?P<word>[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*)|(?P<string>"(?:[^"\\\n]|\\.)*"?)|(?P<char>'(?:[^'\\\n]|\\.)*'?)
    |(?P<punct><=>|<<=|>>=|\.\.\.|->\*|::|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\*|\#\#|.)""",
    re.X | re.S,
)
_RAW = re.compile(r'"([^()\\ \t\v\f\n]{0,16})\(')
_SPLICE = re.compile(r"\\\r?\n")


@dataclass(slots=True)
class Token:
    kind: str  # keyword, identifier, literal, punctuation, comment
    begin: int
    end: int
    text: str
    first: bool  # no other token but comments before it on its logical line
    made: object = None  # the macro, where the token is an invocation that may make a declaration


@dataclass(slots=True)
class Part:
    """A directive's line, or the tokens between two of them; comments stand apart."""

    directive: bool
    begin: int
    tokens: list[Token]
    comments: list[Token]
    names: frozenset


def _spliced(source: str) -> tuple[str, np.ndarray | None]:
    """source without splices, and the place in it of each character left (None: the same)."""
    spans = [m.span() for m in _SPLICE.finditer(source)] if "\\" in source else []
    if not spans:
        return source, None
    keep = np.ones(len(source) + 1, bool)
    for a, b in spans:
        keep[a:b] = False
    return _SPLICE.sub("", source), np.flatnonzero(keep)


def _without_bom(content: bytes) -> str:
    source = content.decode("latin-1")
    return "   " + source[3:] if content.startswith(b"\xef\xbb\xbf") else source


def lex(content: bytes) -> list[Token]:
    source = _without_bom(content)
    text, at = _spliced(source)
    out: list[Token] = []
    i, first = 0, True
    while i < len(text):
        m = _TOKEN.match(text, i)
        kind, word, j = m.lastgroup, m[0], m.end()
        if kind == "space":
            first |= "\n" in word
            i = j
            continue
        begin, end = (i, j) if at is None else (int(at[i]), int(at[j - 1]) + 1)
        if kind == "word":
            raw = _RAW.match(source, end) if word in RAW_PREFIXES and text[j : j + 1] == '"' else None
            if raw:
                close = source.find(f"){raw[1]}\"", raw.end())
                end = len(source) if close < 0 else close + len(raw[1]) + 2
                out.append(Token("literal", begin, end, source[begin:end], first))
                i, first = end if at is None else int(np.searchsorted(at, end)), False
                continue
            if word in ("L", "u", "U", "u8") and text[j : j + 1] in ('"', "'"):  # a prefix belongs to its literal
                j = _TOKEN.match(text, j).end()
                end = j if at is None else int(at[j - 1]) + 1
                out.append(Token("literal", begin, end, text[i:j], first))
            else:
                out.append(Token("keyword" if word in KEYWORDS else "identifier", begin, end, word, first))
            first = False
        elif kind in ("line", "block"):
            out.append(Token("comment", begin, end, word, first))
        else:
            out.append(Token("punctuation" if kind == "punct" else "literal", begin, end, word, first))
            first = False
        i = j
    return out


def _parts(content: bytes) -> list[Part]:
    tokens, out, i = lex(content), [], 0
    while i < len(tokens):
        t = tokens[i]
        directive = t.kind == "punctuation" and t.text == "#" and t.first
        j = i + 1
        if directive:
            while j < len(tokens) and not tokens[j].first:
                j += 1
        else:
            while j < len(tokens) and not (tokens[j].first and tokens[j].text == "#"):
                j += 1
        run = tokens[i + directive : j]
        code = [x for x in run if x.kind != "comment"]
        out.append(Part(directive, t.begin, code, [x for x in run if x.kind == "comment"], frozenset(x.text for x in code if x.kind == "identifier")))
        i = j
    return out


_cached_parts = lru_cache(maxsize=256)(_parts)
#: Files up to this size are kept tokenised in a worker: headers that many units include are lexed once.
KEPT_BYTES = 200_000


def parts(content: bytes) -> list[Part]:
    return _cached_parts(content) if len(content) <= KEPT_BYTES else _parts(content)


# Line kinds: only quotes and slashes are looked at; what stands before a quote says what it is.
_MARK = re.compile(r"[/\"']")
_STRING, _CHAR = re.compile(r'"(?:[^"\\\n]|\\.)*"?', re.S), re.compile(r"'(?:[^'\\\n]|\\.)*'?", re.S)
_RUN = re.compile(r"(\.?[0-9](?:[A-Za-z0-9_$\x80-\xff.]|(?<=[eEpP])[+-])*)|[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*|.", re.S)
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$") | frozenset(map(chr, range(128, 256)))
_CODE = np.full(256, 2, np.uint8)
_CODE[np.frombuffer(b" \t\v\f\r\n", np.uint8)] = 0


def _in_number(text: str, since: int, at: int, within: bool) -> bool:
    """Whether a number ends at `at`; within: the text from `since` on goes on with one."""
    j = at
    while j > since and (text[j - 1] in _WORD or text[j - 1] == "." or text[j - 1] in "+-" and j - 2 >= since and text[j - 2] in "eEpP"):
        j -= 1
    if within and j == since:
        return True
    last = None
    for m in _RUN.finditer(text, j, at):
        last = m[1]
    return last is not None


def _comments(source: str, text: str, at: np.ndarray | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Bounds in the file of comments and of raw strings."""
    place = (lambda i: i) if at is None else (lambda i: int(at[i]))
    notes, raws, i, within = [], [], 0, False
    while m := _MARK.search(text, i):
        s, c = m.start(), m[0]
        if c == "/":
            after = text[s + 1 : s + 2]
            if after not in ("/", "*"):
                i, within = s + 1, False
                continue
            e = text.find("\n", s) if after == "/" else text.find("*/", s + 2)
            e = len(text) if e < 0 else e if after == "/" else e + 2
            notes.append((place(s), place(e - 1) + 1))
        elif c == "'":
            if text[s + 1 : s + 2] in _WORD and _in_number(text, i, s, within):
                i, within = s + 1, True  # a digit separator
                continue
            e = _CHAR.match(text, s).end()
        else:
            j = s
            while j > max(i, s - 4) and text[j - 1] in _WORD:
                j -= 1
            raw = _RAW.match(source, place(s)) if text[j:s] in RAW_PREFIXES else None
            if raw:
                close = source.find(f"){raw[1]}\"", raw.end())
                end = len(source) if close < 0 else close + len(raw[1]) + 2
                raws.append((raw.start(), end))
                e = end if at is None else int(np.searchsorted(at, end))
            else:
                e = _STRING.match(text, s).end()
        i, within = e, False
    return notes, raws


def _kinds(content: bytes) -> np.ndarray:
    """0 blank, 1 comment, 2 code for each physical line: code wins over comment over blank."""
    data = np.frombuffer(content, np.uint8)
    kind = _CODE[data]
    if content.startswith(b"\xef\xbb\xbf"):
        kind[:3] = 0
    spliced = b"\\\n" in content or b"\\\r\n" in content
    if spliced or b"//" in content or b"/*" in content:
        source = _without_bom(content)
        notes, raws = _comments(source, *_spliced(source))
        for a, b in notes:
            np.minimum(kind[a:b], 1, out=kind[a:b])
        if spliced:  # the backslash of a splice is neither code nor comment
            kept = np.zeros(len(data), bool)
            for a, b in raws:
                kept[a:b] = True
            at = np.array([m.start() for m in _SPLICE.finditer(source)])
            kind[at[~kept[at]]] = 0
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends + 1])
    return np.maximum.reduceat(kind, starts[starts < len(data)])


def line_kinds(content: bytes) -> list[str]:
    return [("blank", "comment", "code")[k] for k in _kinds(content)] if content else []


def line_counts(content: bytes) -> tuple[int, int, int]:
    """How many lines are blank, comment and code."""
    if not content:
        return 0, 0, 0
    n = np.bincount(_kinds(content), minlength=3)
    return int(n[0]), int(n[1]), int(n[2])
