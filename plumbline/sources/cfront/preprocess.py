"""Conditional directives, includes and macro definitions over tokens. What is written counts: macro bodies are only
expanded to judge conditions and to see which functions and declarations an invocation at file or class level makes.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

from .command import Flags
from .lexer import Part, Token, lex, parts

_BINARY = {"||": 1, "or": 1, "&&": 2, "and": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
#: Questions about the compiler; defined, and 0 for whatever they are asked (but for headers, which are looked up).
_ASKS = ("__has_include", "__has_include_next", "__has_cpp_attribute", "__has_c_attribute", "__has_attribute", "__has_builtin", "__has_feature", "__has_extension", "__has_warning", "__has_declspec_attribute")
#: An expansion that grows beyond this many tokens is given up: the invocation then counts as written.
MOST_EXPANDED = 200_000


def _number(text: str) -> int:
    text = text.replace("'", "").rstrip("uUlLzZ") if text[0] != "'" else text
    try:
        return int(text, 0 if not (len(text) > 1 and text[0] == "0" and text[1].isdigit()) else 8)
    except ValueError:
        return ord(text[1]) if len(text) == 3 and text[0] == "'" else 0


@dataclass(slots=True)
class Macro:
    params: list[str] | None  # None: without a parameter list
    body: list[Token]
    makes: bool = False  # its expansion may hold a body or a whole declaration


def macro_of(rest: list[Token]) -> Macro:
    """The macro that the tokens behind #define and its name give; rest[0] is the name."""
    if len(rest) > 1 and rest[1].text == "(" and rest[1].begin == rest[0].end:
        close = next((k for k, t in enumerate(rest) if t.text == ")"), len(rest))
        params = [t.text for t in rest[2:close] if t.text != ","]
        return Macro(["__VA_ARGS__" if p == "..." else p for p in params], rest[close + 1 :])
    return Macro(None, rest[1:])


def _arguments(tokens: list[Token], opening: int) -> tuple[list[list[Token]], int]:
    """The arguments of an invocation by top-level commas, and the place after its bracket."""
    out, depth, i = [[]], 0, opening
    while i < len(tokens):
        s = tokens[i].text
        if s in ("(", "[", "{"):
            depth += 1
        elif s in (")", "]", "}"):
            depth -= 1
            if depth == 0:
                return out, i + 1
        if s == "," and depth == 1:
            out.append([])
        elif not (s == "(" and depth == 1 and i == opening):
            out[-1].append(tokens[i])
        i += 1
    return out, i


def _substituted(macro: Macro, given: list[list[Token]], macros: dict, hidden: frozenset) -> list[Token]:
    by = {p: given[k] if k < len(given) else [] for k, p in enumerate(macro.params)}
    if macro.params and macro.params[-1] == "__VA_ARGS__":
        comma = Token("punctuation", 0, 0, ",", False)
        rest = given[len(macro.params) - 1 :]
        by["__VA_ARGS__"] = [t for k, a in enumerate(rest) for t in ([comma] if k else []) + a]
    out, body, i = [], macro.body, 0
    while i < len(body):
        t = body[i]
        if t.text == "##" and out and i + 1 < len(body):
            i += 1
            right = by.get(body[i].text, [body[i]])
            if right:
                glued = out[-1].text + right[0].text
                kind = "identifier" if glued[0].isalpha() or glued[0] == "_" else "literal" if glued[0].isdigit() else "punctuation"
                out[-1] = replace(out[-1], text=glued, kind=kind)
                out += right[1:]
        elif t.text == "#" and i + 1 < len(body) and body[i + 1].text in by:
            i += 1
            out.append(replace(t, kind="literal", text='"' + " ".join(x.text for x in by[body[i].text]) + '"'))
        elif t.text in by:
            pasted = i + 1 < len(body) and body[i + 1].text == "##"
            out += by[t.text] if pasted else expand(by[t.text], macros, hidden)
        else:
            out.append(t)
        i += 1
    return out


def expand(tokens: list[Token], macros: dict[str, Macro], hidden: frozenset = frozenset()) -> list[Token]:
    """tokens with all macros but the hidden ones replaced; a name isn't replaced within its own replacement."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        m = macros.get(t.text) if t.kind in ("identifier", "keyword") and t.text not in hidden else None
        if m is None or m.params is not None and (i + 1 >= len(tokens) or tokens[i + 1].text != "("):
            out.append(t)
            i += 1
            continue
        if m.params is None:
            body, i = m.body, i + 1
        else:
            given, i = _arguments(tokens, i + 1)
            body = _substituted(m, given, macros, hidden)
        out += expand(body, macros, hidden | {t.text})
        if len(out) > MOST_EXPANDED:
            return out
    return out


class Condition:
    """The value of an #if expression: its macros expanded, then precedence climbing; an unknown name is 0."""

    def __init__(self, tokens: list[Token], macros: dict[str, Macro], has: Callable[[str, bool], bool] = lambda name, angled: False):
        self.i, self.t = 0, [t.text for t in expand(self._asked([x for x in tokens if x.kind != "comment"], macros, has), macros)]

    @staticmethod
    def _asked(tokens: list[Token], macros: dict[str, Macro], has) -> list[Token]:
        """`defined` and the questions about the compiler answered, before anything is expanded."""
        out, i = [], 0
        answer = lambda t, yes: replace(t, kind="literal", text=str(int(yes)))
        while i < len(tokens):
            t = tokens[i]
            if t.text == "defined" and i + 1 < len(tokens):
                paren = tokens[i + 1].text == "("
                name = tokens[i + 1 + paren].text if i + 1 + paren < len(tokens) else ""
                out.append(answer(t, name in macros or name in _ASKS))
                i += 4 if paren else 2
            elif t.text in _ASKS and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                close = next((k for k in range(i, len(tokens)) if tokens[k].text == ")"), len(tokens) - 1)
                inner = tokens[i + 2 : close]
                found = False
                if t.text == "__has_include" and inner:
                    angled = inner[0].text == "<"
                    found = has("".join(x.text for x in inner[1:-1]) if angled else inner[0].text.strip('"'), angled)
                out.append(answer(t, found))
                i = close + 1
            else:
                out.append(t)
                i += 1
        return out

    def _take(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def _peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def value(self, least: int = 0) -> int:
        left = self._unary()
        while (op := self._peek()) == "?" and least == 0 or _BINARY.get(op, 0) > least:
            self._take()
            if op == "?":
                yes = self.value()
                self._take()
                no = self.value()
                left = yes if left else no
                continue
            left = self._apply(op, left, self.value(_BINARY[op]))
        return left

    @staticmethod
    def _apply(op: str, a: int, b: int) -> int:
        if op in ("/", "%"):
            q = 0 if b == 0 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)  # towards zero
            return q if op == "/" else a - q * b if b else 0
        calls = {
            "||": lambda: int(bool(a or b)), "or": lambda: int(bool(a or b)), "&&": lambda: int(bool(a and b)), "and": lambda: int(bool(a and b)), "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b,
            "==": lambda: int(a == b), "!=": lambda: int(a != b), "<": lambda: int(a < b), ">": lambda: int(a > b), "<=": lambda: int(a <= b), ">=": lambda: int(a >= b),
            "<<": lambda: a << min(max(b, 0), 64), ">>": lambda: a >> min(max(b, 0), 64), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b,
        }
        return calls[op]()

    def _unary(self) -> int:
        op = self._take()
        if op in ("!", "not"):
            return int(not self._unary())
        if op in ("-", "+", "~", "compl"):
            v = self._unary()
            return -v if op == "-" else v if op == "+" else ~v
        if op == "(":
            v = self.value()
            self._take()
            return v
        if op and (op[0].isdigit() or op[0] == "'"):
            return _number(op)
        if self._peek() == "(" and op and (op[0].isalpha() or op[0] == "_"):  # a call of what no macro names
            n = 0
            while self.i < len(self.t):
                n += {"(": 1, ")": -1}.get(self._take(), 0)
                if not n:
                    break
            return 0
        return int(op == "true")


@dataclass
class Pass:
    """What one inclusion of a file holds: its active tokens, its active comments, the places of all its directives."""

    tokens: list[Token]
    comments: list[Token]
    directives: list[int]


@dataclass
class Unit:
    """A unit's files in the order in which they end, each with one pass for each different set of active tokens."""

    passes: dict[str, list[Pass]] = field(default_factory=dict)
    includes: set[tuple[str, str]] = field(default_factory=set)
    errors: list[str] = field(default_factory=list)
    content: dict[str, bytes] = field(default_factory=dict)
    system: set[str] = field(default_factory=set)
    macros: dict[str, Macro] = field(default_factory=dict)


def _define(rest: list[Token], macros: dict[str, Macro]) -> None:
    m = macro_of(rest)
    m.makes = any(t.text in ("{", ";") or t.text in macros and macros[t.text].makes for t in m.body)
    macros[rest[0].text] = m


@lru_cache(maxsize=64)
def _given(definitions: tuple[tuple[str, str | None], ...]) -> dict[str, Macro]:
    """The macros of a command's definitions; units of equal ones share them, so each copies the dictionary."""
    macros: dict[str, Macro] = {}
    for name, value in definitions:
        if value is None:
            macros.pop(name, None)
        else:
            _define(lex(f"{name} {value}".encode()), macros)
    return macros


class _Run:
    def __init__(self, read: Callable[[str], bytes | None], flags: Flags):
        self.read, self.flags, self.unit = read, flags, Unit()
        self.macros, self.once, self.seen = self.unit.macros, set(), set()
        self.cache: dict[str, bytes | None] = {}
        self.macros.update(_given(tuple(flags.definitions)))

    def get(self, p: str) -> bytes | None:
        if p not in self.cache:
            self.cache[p] = self.read(p)
        return self.cache[p]

    def found(self, name: str, angled: bool, at: str) -> str | None:
        near = [] if angled else [posixpath.dirname(at), *self.flags.quote]
        for system, folders in ((False, near), (False, self.flags.search), (True, self.flags.system)):
            for folder in folders:
                p = posixpath.normpath(posixpath.join(folder, name))
                if self.get(p) is not None:
                    if system or at in self.unit.system and folder == posixpath.dirname(at):
                        self.unit.system.add(p)
                    return p
        return None

    def include(self, name: str, angled: bool, p: str, depth: int) -> None:
        target = self.found(name, angled, p)
        if target is None:
            if not angled:
                self.unit.errors.append(f"{p}: '{name}' file not found")
            return
        self.unit.includes.add((p, target))
        if target not in self.once and depth < 200:
            self.visit(target, depth + 1)

    def visit(self, p: str, depth: int) -> None:
        out, notes, lines, stack = [], [], [], []  # stack, each: [active now, some branch taken, active outside]
        live = True
        for part in parts(self.get(p)):
            if not part.directive:
                if live:
                    notes += part.comments
                    out += self._marked(part)
                continue
            lines.append(part.begin)
            what, rest = (part.tokens[0].text, part.tokens[1:]) if part.tokens else ("", [])
            if live:
                notes += part.comments
            if what in ("if", "ifdef", "ifndef", "elif", "else", "elifdef", "elifndef", "endif"):
                self._condition(what, rest, stack, live, p)
                live = all(s[0] for s in stack)
            elif live:
                self._directive(what, rest, p, depth)
        if stack:
            self.unit.errors.append(f"{p}: unterminated conditional directive")
        key = (p, hash(tuple(t.begin for t in out)), len(out))
        if p not in self.unit.passes or out and key not in self.seen:
            self.unit.content[p] = self.get(p)
            earlier = [x for x in self.unit.passes.get(p, []) if x.tokens]  # a guarded file that includes itself ends empty first
            self.unit.passes[p] = [*earlier, Pass(out, notes, lines)]
        self.seen.add(key)

    def _marked(self, part: Part) -> list[Token]:
        """The part's tokens, invocations of macros that may make a declaration marked with their macro."""
        if not any(t in self.macros for t in part.names):
            return part.tokens
        return [replace(t, made=m) if t.kind == "identifier" and (m := self.macros.get(t.text)) is not None and m.makes else t for t in part.tokens]

    def _condition(self, what: str, rest: list[Token], stack: list, live: bool, p: str) -> None:
        known = lambda: bool(rest) and (rest[0].text in self.macros or rest[0].text in _ASKS)
        holds = lambda: bool(Condition(rest, self.macros, lambda n, angled: self.found(n, angled, p) is not None).value())
        if what in ("if", "ifdef", "ifndef"):
            on = live and (holds() if what == "if" else known() == (what == "ifdef"))
            stack.append([on, on, live])
        elif not stack:
            self.unit.errors.append(f"{p}: #{what} without #if")
        elif what == "endif":
            stack.pop()
        else:
            s = stack[-1]
            s[0] = bool(s[2] and not s[1] and (what == "else" or (holds() if what == "elif" else known() == (what == "elifdef"))))
            s[1] = s[1] or s[0]

    def _directive(self, what: str, rest: list[Token], p: str, depth: int) -> None:
        if what == "define" and rest:
            _define(rest, self.macros)
        elif what == "undef" and rest:
            self.macros.pop(rest[0].text, None)
        elif what == "pragma" and rest and rest[0].text == "once":
            self.once.add(p)
        elif what == "error":
            self.unit.errors.append(f"{p}: #error {' '.join(x.text for x in rest)}")
        elif what in ("include", "include_next", "import") and rest:
            if rest[0].text != "<" and rest[0].kind != "literal":
                rest = expand(rest, self.macros) or rest
            angled = rest[0].text == "<"
            close = next((k for k, t in enumerate(rest) if t.text == ">"), len(rest)) if angled else 0
            self.include("".join(x.text for x in rest[1:close]) if angled else rest[0].text.strip('"'), angled, p, depth)


def run(path: str, read: Callable[[str], bytes | None], flags: Flags) -> Unit:
    """path with its conditions, following the includes that `read` knows. An <...> header that isn't found is skipped.

    A file that is included again under other macros has a pass for each different set of active tokens.
    """
    r = _Run(read, flags)
    if r.get(path) is None:
        r.unit.errors.append(f"{path}: file not found")
        return r.unit
    for name in flags.forced:
        r.include(name, False, posixpath.join(flags.directory, "."), 0)
    r.unit.includes.clear()
    r.visit(path, 0)
    main = r.unit.passes[path][-1].tokens
    depth = 0
    for t in main:
        if t.kind == "punctuation" and t.text in "{}" and t.made is None:
            depth += 1 if t.text == "{" else -1
            if depth < 0:
                break
    if depth and not any(t.made for t in main):
        r.unit.errors.append(f"{path}: " + ("expected '}'" if depth > 0 else "extraneous closing brace ('}')"))
    return r.unit
