"""A structural scan of active tokens: definitions with bodies, lambdas, and declarations of the public interface.

It works by brackets and declarator shapes, without types. What that can't tell apart is listed in the README.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field, replace

from .lexer import Token
from .preprocess import MOST_EXPANDED, Macro, _arguments, _substituted, expand

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_TYPE_WORDS = {"int", "char", "bool", "auto", "long", "short", "unsigned", "signed", "float", "double", "void", "const", "volatile", "typename", "wchar_t", "char8_t", "char16_t", "char32_t"}
_SPECIFIERS = {"static", "inline", "constexpr", "consteval", "constinit", "virtual", "explicit", "extern", "friend", "mutable", "thread_local", "register", "typename"}
_DECISIONS = {"if", "for", "while", "do", "case", "catch", "?"}


@dataclass
class Function:
    name: str
    kind: str
    at: int
    begin: int
    end: int
    first: int  # tokens [first, last)
    last: int
    params: list[tuple[int, int]] = field(default_factory=list)  # token ranges where && is a reference
    nested: list[tuple[int, int]] = field(default_factory=list)  # token ranges of inner functions
    own: list[dict] = field(default_factory=list)


@dataclass
class Declaration:
    name: str
    kind: str
    at: int
    begin: int
    end: int
    scope: str


def position(content: bytes) -> tuple:
    """offset -> (line, column), from 1, in bytes."""
    starts = [0] + [i + 1 for i, b in enumerate(content) if b == 10]

    def of(offset: int) -> tuple[int, int]:
        k = bisect_right(starts, offset)
        return k, offset - starts[k - 1] + 1

    return of


class Scanner:
    """macros: the unit's, for invocations that the preprocessor has marked; plain_c: constants have linkage; spaces: names
    of the unit's namespaces so far, which tell a qualified function from a member."""

    def __init__(self, tokens: list[Token], macros: dict[str, Macro] | None = None, plain_c: bool = False, spaces: set[str] | None = None):
        self.t, self.macros, self.plain_c = tokens, macros or {}, plain_c
        self.spaces = spaces if spaces is not None else set()
        self.match = self._matches()
        self.functions: list[Function] = []
        self.api: list[Declaration] = []
        self.siblings: list[tuple[str, int]] = []

    def _matches(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind != "punctuation":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                while stack and _OPEN[self.t[stack[-1]].text] != t.text:
                    out[stack.pop()] = i
                if stack:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.t) - 1
        return out

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def angles(self, i: int, end: int) -> int:
        """The place after the template list that begins at i."""
        depth = 0
        while i < end:
            s = self.text(i)
            if s in ("(", "[", "{"):
                i = self.match.get(i, i)
            elif s == "<":
                depth += 1
            elif s in (">", ">>"):
                depth -= len(s)
                if depth <= 0:
                    return i + 1
            elif s == ";":
                return i
            i += 1
        return i

    def scan(self) -> Scanner:
        self.scope(0, len(self.t), [], None, True, None)
        self.functions.sort(key=lambda f: f.at)
        for f in self.functions:
            self._own(f)
        return self

    def scope(self, i: int, end: int, names: list[str], cls: str | None, public: bool, owner: Function | None) -> None:
        while i < end:
            s = self.text(i)
            if s in ("public", "private", "protected") and self.text(i + 1) == ":":
                public = s == "public"
                i += 2
            elif s in (";", "}"):
                i += 1
            elif s == "namespace" or (s == "inline" and self.text(i + 1) == "namespace"):
                i = self._namespace(i + (s == "inline"), end, names, public, owner)
            elif s == "extern" and self.t[i + 1 : i + 2] and self.t[i + 1].text.startswith('"') and self.text(i + 2) == "{":
                close = self.match[i + 2]
                self.scope(i + 3, close, names, cls, public, owner)
                i = close + 1
            else:
                i = self._declaration(i, end, names, cls, public, owner)

    def _namespace(self, i: int, end: int, names: list[str], public: bool, owner) -> int:
        j, parts = i + 1, []
        while j < end and self.text(j) not in ("{", ";", "="):
            if self.text(j) == "[":
                j = self.match[j]
            elif self.t[j].kind == "identifier":
                parts.append(self.text(j))
            j += 1
        if self.text(j) != "{":
            return self._semicolon(j, end) + 1
        close = self.match[j]
        hidden = not parts
        self.spaces.update(parts)
        self.scope(j + 1, close, names + (parts or ["(anonymous namespace)"]), None, public and not hidden, owner)
        return close + 1

    def _semicolon(self, i: int, end: int) -> int:
        while i < end and self.text(i) != ";":
            i = self.match.get(i, i) + 1 if self.text(i) in _OPEN else i + 1
        return i

    def _invocation(self, i: int, end: int, names: list[str], cls: str | None, public: bool, owner) -> int | None:
        """What a macro makes at i, with a body that is written behind it; its place is that of the invocation."""
        macro, at, after = self.t[i].made, self.t[i], i + 1
        if macro.params is None:
            body = macro.body
        elif self.text(after) == "(":
            given, after = _arguments(self.t[:end], after)
            body = _substituted(macro, given, self.macros, frozenset((at.text,)))
        else:
            return None
        last = self.t[after - 1].end
        made = [replace(t, begin=at.begin, end=last, first=False, made=None) for t in expand(body, self.macros, frozenset((at.text,)))]
        depth = sum({"{": 1, "}": -1}.get(t.text, 0) for t in made if t.kind == "punctuation")
        if depth or not made or len(made) > MOST_EXPANDED:
            return None
        stop = self.match[after] + 1 if self.text(after) == "{" and made[-1].text not in ("}", ";") else after
        sub = Scanner(made + self.t[after:stop], self.macros, self.plain_c, self.spaces)
        sub.scope(0, len(sub.t), names, cls, public, None)
        back = lambda k: after + max(k - len(made), 0)
        for f in sub.functions:
            inside = f.first >= len(made)
            spans = [(back(a), back(b)) for a, b in f.params + [(0, 0)] if b > len(made)]
            nested = [(back(a), back(b)) for a, b in f.nested if a >= len(made)]
            self.functions.append(replace(f, first=back(f.first) if inside else i, last=back(f.last) if f.last > len(made) else after, params=spans, nested=nested))
            if owner is not None and not inside:
                owner.nested.append((i, stop))
        self.api += sub.api
        self.siblings += sub.siblings
        return stop

    def _declaration(self, i: int, end: int, names: list[str], cls: str | None, public: bool, owner) -> int:
        if self.t[i].made is not None and (made := self._invocation(i, end, names, cls, public, owner)) is not None:
            return made
        start, template, here = i, False, "::".join(names)
        while self.text(i) in ("template", "[") or self.text(i) == "requires":
            if self.text(i) == "template":
                template = True
                if self.text(i + 1) != "<":
                    return self._semicolon(i, end) + 1
                i = self.angles(i + 1, end)
            elif self.text(i) == "[":
                i = self.match[i] + 1
            else:
                i += 1
                while i < end and self.text(i) not in ("class", "struct", "union", "auto", "void", "constexpr", "inline", "static") and self.t[i].kind != "keyword" and self.text(i) != ";":
                    i = self.angles(i, end) if self.text(i) == "<" else self.match.get(i, i) + 1
                break
        begin = self.t[start].begin if start < len(self.t) else 0
        word = self.text(i)
        if word in ("using", "typedef"):
            stop = self._semicolon(i, end)
            if word == "using" and self.text(i + 2) == "=" and self.t[i + 1].kind == "identifier":
                self._add("type_alias", i + 1, here, begin, stop, public, names)
            elif word == "typedef":
                body = next((k for k in range(i, stop) if self.text(k) == "{"), None)
                name = self._typedef_name(i, stop)
                if body is not None and name is not None:
                    self._members(body + 1, self.match[body], [*names, self.text(name)], public)
                if name is not None:
                    self._add("type_alias", name, here, begin, stop, public, names)
            return stop + 1
        if word in ("static_assert", "asm", "concept", "friend", "_Static_assert"):
            k = i
            while k < end and self.text(k) not in (";", "{"):
                k = self.match[k] + 1 if self.text(k) in ("(", "[") else k + 1
            if self.text(k) == "{" and word == "friend":
                return self._function(i, start, end, names, cls, False, owner, template) or self.match[k] + 1
            return self._semicolon(i, end) + 1
        head = i
        while self.text(head) in _SPECIFIERS:
            head += 1
        if self.text(head) in ("class", "struct", "union", "enum"):
            j = head + 1
            while j < end and self.text(j) not in ("{", ";", "(", "="):
                if self.text(j) == "<":
                    j = self.angles(j, end)
                else:
                    j = self.match[j] + 1 if self.text(j) == "[" else j + 1
            if self.text(j) == "{":
                return self._class(head, j, end, names, cls, public, begin, owner)
            if self.text(j) == ";":
                return j + 1
        return self._function(i, start, end, names, cls, public, owner, template) or self._variable(i, end, here, cls, begin, public, names)

    def _typedef_name(self, i: int, stop: int) -> int | None:
        for k in range(i, stop):
            if self.text(k) == "(" and self.text(k + 1) == "*" and self.t[k + 2].kind == "identifier":
                return k + 2
        k = stop - 1
        while k > i and self.text(k) == "]":
            k = next((o for o, c in self.match.items() if c == k), k) - 1
        return k if self.t[k].kind == "identifier" else None

    def _class(self, head: int, body: int, end: int, names: list[str], cls: str | None, public: bool, begin: int, owner) -> int:
        close = self.match[body]
        at = None
        j = head + 1
        while j < body and self.text(j) != ":":
            if self.text(j) == "[" or self.text(j) == "(":
                j = self.match[j]
            elif self.t[j].kind == "identifier" and self.text(j) != "final":
                at = j
            elif self.text(j) == "<":
                j = self.angles(j, body) - 1
            j += 1
        kind = self.text(head)
        name = self.text(at) if at is not None else ""
        stop = self._semicolon(close + 1, end)
        if at is not None:
            self._add("type", at, "::".join(names), begin, stop, public, names)
        if kind != "enum":
            inner = [*names, name] if name else [*names, "(anonymous)"]
            self.scope(body + 1, close, inner, name or "(anonymous)", (kind != "class") if public and name else False, owner)
        if stop > close + 1 and self.text(close + 1) != "}":
            self._variable(close + 1, end, "::".join(names), cls, begin, public, names, bare=True, words={self.text(k) for k in range(max(head - 4, 0), head) if self.t[k].begin >= begin})
        return stop + 1

    def _members(self, i: int, close: int, names: list[str], public: bool) -> None:
        self.scope(i, close, names, names[-1], public, None)

    def _add(self, kind: str, at: int, scope: str, begin: int, stop: int, public: bool, names: list[str], suffix: str = "") -> None:
        t = self.t[at]
        self.siblings.append((scope, t.begin))
        if public:
            name = f"{scope}::{t.text}" if scope else t.text
            self.api.append(Declaration(name + suffix, kind, t.begin, begin, self.t[min(stop, len(self.t) - 1)].end, scope))

    def _variable(self, i: int, end: int, here: str, cls: str | None, begin: int, public: bool, names: list[str], bare: bool = False, words: set | None = None) -> int:
        """Each declarator of a declaration without a body; bare: the type stands before i."""
        stop = self._semicolon(i, end)
        words = set(words or ())
        k, head = i, True
        while k < stop:
            name, pointer, const = None, False, False
            first = k
            while k < stop:
                s = self.text(k)
                if s == "<" and k > first and self.t[k - 1].kind == "identifier":
                    k = self.angles(k, stop)
                    continue
                if s == "(" and self.text(k + 1) in ("*", "&", "^") and name is None or s == "(" and self.text(k + 1) in ("*", "&", "^") and self.text(self.match[k] + 1) == "(":
                    name = next((x for x in range(k + 1, self.match[k]) if self.t[x].kind == "identifier"), None)
                    pointer, const = True, False
                    break
                if s in ("__attribute__", "alignas", "decltype", "_Alignas", "__declspec") and self.text(k + 1) == "(":
                    k = self.match[k + 1] + 1
                    continue
                if s == "[" and self.text(k + 1) == "[":
                    k = self.match[k] + 1
                    continue
                if s in ("=", "{", ":", "[", ",", "("):
                    break
                if self.t[k].kind == "identifier":
                    name = k
                elif s in ("*", "&", "&&"):
                    pointer, const = True, False
                elif s == "const" and pointer:
                    const = True
                if head:
                    words.add(s)
                k += 1
            if name is not None and (name > i or bare or not head):
                fixed = "constexpr" in words or const or "const" in words and not pointer
                hidden = cls is None and ("static" in words or fixed and not self.plain_c and not words & {"extern", "inline"})
                self._add("field" if cls else "variable", name, here, begin, stop, public and not hidden, names)
            while k < stop and self.text(k) != ",":
                if self.text(k) in _OPEN:
                    k = self.match[k] + 1
                else:
                    k = self.angles(k, stop) if self._template(k, stop) else k + 1
            k, head = k + 1, False
        return stop + 1

    def _template(self, i: int, stop: int) -> bool:
        """Whether a template list that is closed begins at i, rather than a comparison."""
        if self.text(i) != "<" or self.t[i - 1].kind != "identifier":
            return False
        return self.text(self.angles(i, stop) - 1) in (">", ">>")

    def _declarator(self, i: int, end: int) -> tuple[int, int, str] | None:
        """The name's place, the parameter list's place and the name as written, if this is a function declarator."""
        j = i
        while j < end:
            s = self.text(j)
            if s == "operator":
                k = j + 1
                if self.text(k) == "(" and self.text(k + 1) == ")":
                    return j, k + 2, "operator()"
                while k < end and self.text(k) != "(":
                    k = self.match[k] + 1 if self.text(k) == "[" else k + 1
                sep = " " if self.t[j + 1].kind != "punctuation" else ""
                return j, k, "operator" + sep + self.spell(j + 1, k)
            if s in (";", "{", "}", "=") or s in ("return", "if", "for", "while", "switch"):
                return None
            if s == "<" and j > i and self.t[j - 1].kind == "identifier":
                j = self.angles(j, end)
                continue
            if s in ("decltype", "noexcept", "alignas", "__attribute__", "explicit") and self.text(j + 1) == "(":
                j = self.match[j + 1] + 1
                continue
            if s == "[":
                j = self.match[j] + 1
                continue
            if s == "(":
                k = j - 1
                if self.text(k) in (">", ">>"):  # an explicit template list before the parameters
                    while k > i and self.text(k) != "<":
                        k -= 1
                    k -= 1
                if self.text(j + 1) in ("*", "&", "^") and self.text(self.match[j] + 1) in ("(", "["):
                    return None  # a pointer to a function or an array
                if k >= i and self.t[k].kind == "identifier":
                    name = self.text(k)
                    return (k - 1, j, "~" + name) if self.text(k - 1) == "~" else (k, j, name)
                return None
            j += 1
        return None

    def spell(self, a: int, b: int) -> str:
        out = ""
        for k in range(a, b):
            s = self.text(k)
            glue = out and (s in ("*", "&", "&&") and out[-1] not in "*& " or (out[-1].isalnum() or out[-1] in "_>") and (s[0].isalnum() or s[0] == "_") or out[-1] == "," or out[-1] in "*&" and (s[0].isalpha()))
            out += (" " if glue else "") + s
        return out

    def parameters(self, opening: int) -> str:
        """Parameter types as written, without names and default arguments."""
        out, k, close = [], opening + 1, self.match[opening]
        while k < close:
            a, depth, stop = k, 0, None
            while k < close and not (self.text(k) == "," and depth == 0):
                s = self.text(k)
                depth += {"<": 1, ">": -1, ">>": -2}.get(s, 0)
                if s == "=" and depth == 0 and stop is None:
                    stop = k
                k = self.match[k] + 1 if s in _OPEN else k + 1
            b = stop if stop is not None else k
            words = [x for x in range(a, b) if self.t[x].kind == "identifier"]
            last = b - 1
            if words and last == words[-1] and last > a and self.text(last - 1) != "::" and (len(words) > 1 or any(self.text(x) in _TYPE_WORDS - {"const", "volatile", "typename"} for x in range(a, last))) and not (self.text(last - 1) in ("struct", "class", "enum", "union", "const") and len(words) == 1):
                b = last
            spelled = self.spell(a, b)
            if spelled and spelled != "void":
                out.append(spelled)
            k += 1
        return "(" + ", ".join(out) + ")"

    def _function(self, i: int, start: int, end: int, names: list[str], cls: str | None, public: bool, owner, template: bool) -> int | None:
        d = self._declarator(i, end)
        if d is None:
            return None
        at, opening, name = d
        if opening >= end or self.text(opening) != "(":
            return None
        j = self.match[opening] + 1
        refs = [(start, at), (opening, j)]
        defaulted, trailing = False, j
        while j < end:
            s = self.text(j)
            if s == "=":
                defaulted = self.text(j + 1) in ("default", "delete")
                j = self._semicolon(j, end)
                break
            if s == ":":
                j += 1
                while j < end:  # members are initialised as name(...) or name{...}
                    while j < end and self.text(j) not in ("(", "{"):
                        j = self.angles(j, end) if self.text(j) == "<" else j + 1
                    j = self.match.get(j, j) + 1
                    if self.text(j) == "...":
                        j += 1
                    if self.text(j) != ",":
                        break
                    j += 1
                continue
            if s in ("{", ";"):
                break
            if s == "," or s == "}":
                return None
            j = self.match[j] + 1 if s in ("(", "[") else self.angles(j, end) if s == "<" else j + 1
        refs.append((trailing, trailing if self.text(trailing) == ":" else j))
        qualifier = []
        k = at - 1
        while self.text(k) == "::" and k > i:
            k -= 1
            if self.text(k) == ">":
                while k > i and self.text(k) != "<":
                    k -= 1
                k -= 1
            qualifier.insert(0, self.text(k))
            k -= 1
        full = "::".join([*names, *qualifier, name]) + self.parameters(opening)
        within = (None if qualifier[-1] in self.spaces else qualifier[-1]) if qualifier else cls
        kind = self._kind(name, within, template)
        scope = "::".join(names)
        static = any(self.text(x) == "static" for x in range(start, at))
        if not defaulted and not qualifier:
            begin = self.t[start].begin
            if public and (cls or not static) and not any(self.text(x) == "friend" for x in range(start, at)):
                t = self.t[at]
                self.siblings.append((scope, t.begin))
                self.api.append(Declaration(full, "method" if cls else "function", t.begin, begin, self.t[min(j, len(self.t) - 1)].end, scope))
            else:
                self.siblings.append((scope, self.t[at].begin))
        if self.text(j) != "{":
            return min(j, end) + 1
        close = self.match[j]
        after = close + 1
        while self.text(after) == "catch" and self.text(trailing) == "try":
            after = self.match[self.match[after + 1] + 1] + 1
        begin = start if not template else start
        f = Function(full, kind, self.t[at].begin, self.t[begin].begin, self.t[after - 1].end, begin, after, refs)
        self.functions.append(f)
        if owner is not None:
            owner.nested.append((f.first, f.last))
        self._body(opening, after, f, full)
        return after

    def _kind(self, name: str, within: str | None, template: bool) -> str:
        if template:
            return "function_template"
        if name.startswith("~"):
            return "destructor"
        if within and name == within:
            return "constructor"
        if name.startswith("operator ") and not name.startswith(("operator new", "operator delete", "operator co_await")):
            return "conversion"
        return "method" if within else "function"

    def _body(self, i: int, end: int, f: Function, full: str) -> None:
        """Lambdas and local classes within a function."""
        while i < end:
            s = self.text(i)
            if s == "[" and self._lambda_start(i):
                j = self.match[i] + 1
                if self.text(j) == "<":
                    j = self.angles(j, end)
                refs = []
                if self.text(j) == "(":
                    refs.append((j, self.match[j]))
                    j = self.match[j] + 1
                tail = j
                while j < end and self.text(j) not in ("{", ";", ")", "]", "}"):
                    j = self.match[j] + 1 if self.text(j) in ("(", "[") else self.angles(j, end) if self.text(j) == "<" else j + 1
                if self.text(j) == "{":
                    close = self.match[j]
                    g = Function(full + "::(lambda)", "lambda", self.t[i].begin, self.t[i].begin, self.t[close].end, i, close + 1, [*refs, (tail, j)])
                    self.functions.append(g)
                    f.nested.append((i, close + 1))
                    self._body(i + 1, close, g, g.name)
                    i = close + 1
                    continue
            elif s in ("struct", "class", "union") and self.text(i - 1) in (";", "{", "}"):
                j = i + 1
                while j < end and self.text(j) not in ("{", ";", "(", "=", ")"):
                    j += 1
                if self.text(j) == "{" and self.t[i + 1].kind == "identifier":
                    name = self.text(i + 1)
                    self.scope(j + 1, self.match[j], [full, name], name, False, f)
                    i = self.match[j] + 1
                    continue
            i += 1

    def _lambda_start(self, i: int) -> bool:
        if self.text(i + 1) == "[" or self.text(i - 1) == "[" and self.match.get(i - 1) == self.match[i] + 1:
            return False
        p = self.t[i - 1] if i else None
        after = self.text(self.match[i] + 1)
        if after not in ("(", "{", "<", "mutable", "noexcept", "->"):
            return False
        return p is None or p.kind == "keyword" and p.text not in ("this", "operator", "new", "delete") or p.kind == "punctuation" and p.text not in (")", "]")

    def _own(self, f: Function) -> None:
        inside = sorted(f.nested)
        closing = set()
        k = 0
        i = f.first
        while i < f.last:
            while k < len(inside) and inside[k][1] <= i:
                k += 1
            if k < len(inside) and inside[k][0] <= i:
                i = inside[k][1]
                continue
            t, construct = self.t[i], ""
            if t.text == "do" and t.kind == "keyword":
                body = self.match[i + 1] if self.text(i + 1) == "{" else self._semicolon(i + 1, f.last)
                if self.text(body + 1) == "while":
                    closing.add(body + 1)
            if t.kind in ("keyword", "punctuation"):
                if t.text in _DECISIONS and i not in closing:
                    construct = t.text
                elif t.text in ("&&", "||", "and", "or") and self._logical(i, f):
                    construct = {"and": "&&", "or": "||"}.get(t.text, t.text)
            f.own.append({"kind": t.kind, "spelling": t.text, "construct": construct, "offset": t.begin})
            i += 1

    def _logical(self, i: int, f: Function) -> bool:
        if self.text(i - 1) == "operator":
            return False
        if self.text(i) in ("||", "or"):
            return True
        if any(a <= i < b for a, b in f.params) and not any(self.text(k) == "=" for a, b in f.params if a <= i < b for k in range(a, i)):
            return False
        after = self.text(i + 1)
        if after == "..." and self.text(i + 2) != ")" or after in (">", ",", ")", ";"):
            return False
        if self.text(i - 1) in _TYPE_WORDS or self.text(i - 1) == ">" and self.text(i + 2) in ("=", ":", "{"):
            return False
        k = i - 1  # a declaration: only a type stands between the statement's start and &&
        while k > f.first and (self.t[k].kind == "identifier" or self.text(k) in ("::", "const", "typename")):
            k -= 1
        starts = self.text(k) in (";", "{", "}") or self.text(k) == "(" and self.text(k - 1) == "for"
        return not (starts and k < i - 1 and self.text(i + 2) in ("=", ":", "{", "("))
