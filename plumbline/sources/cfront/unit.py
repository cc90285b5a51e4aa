"""Facts of one translation unit: functions, declarations, include edges, errors."""

from __future__ import annotations

import re
from collections.abc import Callable

from ...functions.paths import HEADER_EXTENSIONS
from . import preprocess
from .command import flags
from .scanner import Scanner, position

_BREAKS = re.compile(rb"[;{}#@]")
_HEADERS = tuple("." + x for x in HEADER_EXTENSIONS)


def facts(path: str, directory: str, arguments: list[str], read: Callable[[str], bytes | None], accept: Callable[[str], bool], resource: str = "") -> dict:
    """functions, api (headers only), marks (declared names by file), includes and errors of a unit.

    They are of the files that accept() takes, but for those found in system folders. A file that is included again
    under other macros gives the facts of each pass, the first one at a place counts.
    """
    given = flags(arguments, directory, path, resource)
    unit = preprocess.run(path, read, given)
    functions, api, marks, seen, spaces = [], [], [], set(), set()
    for file, passes in unit.passes.items():
        if not accept(file) or file in unit.system:
            continue
        at, header, places = position(unit.content[file]), file.lower().endswith(_HEADERS), set()
        for part in passes:
            scan = Scanner(part.tokens, unit.macros, given.plain_c, spaces).scan()
            for f in scan.functions:
                if f.at not in places:
                    places.add(f.at)
                    line, column = at(f.at)
                    functions.append({"file": file, "line": line, "column": column, "kind": f.kind, "name": f.name, "seq": len(functions), "tokens": [{k: t[k] for k in ("kind", "spelling", "construct")} for t in f.own]})
            if header:
                names = sorted(o for _, o in scan.siblings)
                api += _api(file, unit.content[file], scan, part, names, at, seen, len(api))
                marks.append({"file": file, "name_at": names})
    system = unit.system
    edges = sorted((a, b) for a, b in unit.includes if accept(a) and accept(b) and a not in system and b not in system)
    return {"functions": functions, "api": api, "marks": marks, "includes": [{"src": a, "dst": b} for a, b in edges], "errors": unit.errors}


def _api(file: str, content: bytes, scan: Scanner, part: preprocess.Pass, names: list[int], at, seen: set, count: int) -> list[dict]:
    """Each declaration with the comment that may belong to it; whether it does is decided by the gap join.

    seen: what the unit has declared already; functions and variables count where they are declared first.
    """
    out = []
    comments = part.comments
    for d in sorted(scan.api, key=lambda d: d.at):
        key = (file, d.at) if d.kind in ("type", "type_alias", "field") else d.name
        if key in seen:
            continue
        seen.add(key)
        line, column = at(d.at)
        end_line = at(max(d.end - 1, d.begin))[0]
        after = next((c for c in comments if c.begin >= d.end and at(c.begin)[0] == end_line and not any(d.end < o < c.begin for o in names)), None)
        before = [c for c in comments if c.end <= d.begin]
        note = before[-1] if before else None
        if note is not None:
            if _BREAKS.search(content, note.end, d.begin):
                note = None  # the end of another declaration, a body or a directive stands between
            elif any(o < note.begin and at(o)[0] == at(note.begin)[0] for o in names):
                note = None  # it trails a declaration on its own line
        while note is not None and len(before) > 1 and note.text.startswith("//") and before[-2].text.startswith("//") and at(before[-2].end)[0] + 1 == at(note.begin)[0]:
            before.pop()
            note_end, note = note.end, before[-1]
            note = type(note)(note.kind, note.begin, note_end, note.text, note.first)
        trailing = after is not None and d.kind in ("field", "variable")  # data's own line comes first
        c = after if trailing else note
        out.append({"file": file, "line": line, "column": column, "kind": d.kind, "name": d.name, "seq": count + len(out), "scope": d.scope, "at": d.at, "begin": d.begin, "comment": c.text if c else None, "comment_end": c.end if c else None, "trailing": trailing})
    return out
