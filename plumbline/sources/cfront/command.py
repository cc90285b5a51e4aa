"""What a compile command says about a unit: folders, definitions, forced headers, and the compiler's own macros."""

from __future__ import annotations

import posixpath
import shlex
from dataclasses import dataclass, field

# The language standards' version macros, and what compilers define for x86-64 Linux and Windows targets.
CPLUSPLUS = {"98": "199711L", "03": "199711L", "0x": "201103L", "11": "201103L", "1y": "201402L", "14": "201402L", "1z": "201703L", "17": "201703L", "2a": "202002L", "20": "202002L", "2b": "202302L", "23": "202302L", "latest": "202302L"}
STDC = {"89": None, "90": None, "iso9899:1990": None, "99": "199901L", "9x": "199901L", "11": "201112L", "1x": "201112L", "17": "201710L", "18": "201710L", "2x": "202311L", "23": "202311L"}
COMMON = "__STDC_HOSTED__=1 __x86_64__=1 __CHAR_BIT__=8 __SIZEOF_SHORT__=2 __SIZEOF_INT__=4 __SIZEOF_LONG_LONG__=8 __SIZEOF_POINTER__=8 __SIZEOF_SIZE_T__=8 __INT_MAX__=2147483647 __SHRT_MAX__=32767 __SCHAR_MAX__=127 __LONG_LONG_MAX__=9223372036854775807LL __ORDER_LITTLE_ENDIAN__=1234 __ORDER_BIG_ENDIAN__=4321 __BYTE_ORDER__=1234 __LITTLE_ENDIAN__=1 __SSE__=1 __SSE2__=1 __clang__=1 __clang_major__=18 __clang_minor__=1 __clang_patchlevel__=0 __COUNTER__=0 __LINE__=1"
LINUX = "__STDC__=1 __linux__=1 __linux=1 __gnu_linux__=1 __unix__=1 __unix=1 __ELF__=1 __x86_64=1 __amd64__=1 __amd64=1 __LP64__=1 _LP64=1 __SIZEOF_LONG__=8 __SIZEOF_WCHAR_T__=4 __LONG_MAX__=9223372036854775807L __GNUC__=4 __GNUC_MINOR__=2 __GNUC_PATCHLEVEL__=1"
WINDOWS = "_WIN32=1 _WIN64=1 _M_X64=100 _M_AMD64=100 _MSC_VER=1933 _MSC_FULL_VER=193300000 _MSC_EXTENSIONS=1 _INTEGRAL_MAX_BITS=64 _MT=1 __SIZEOF_LONG__=4 __SIZEOF_WCHAR_T__=2 __LONG_MAX__=2147483647L"
_SEARCH = {"-iquote": "quote", "-I": "search", "-isystem": "system", "-idirafter": "after", "-external:I": "system", "-imsvc": "system", "-include": "forced", "-imacros": "forced", "-FI": "forced", "-D": "define", "-U": "undefine"}


@dataclass
class Flags:
    """Folders are absolute; definitions in order, a value of None undefines."""

    directory: str = "/"
    search: list[str] = field(default_factory=list)
    quote: list[str] = field(default_factory=list)
    system: list[str] = field(default_factory=list)
    definitions: list[tuple[str, str | None]] = field(default_factory=list)
    forced: list[str] = field(default_factory=list)
    plain_c: bool = False


def command(entry: dict) -> list[str]:
    """The arguments of a database's entry, in either of its forms."""
    given = entry.get("arguments")
    return list(given) if given is not None and len(given) else shlex.split(entry.get("command") or "")


def is_cl(arguments: list[str]) -> bool:
    stem = arguments[0].replace("\\", "/").rsplit("/", 1)[-1].lower().removesuffix(".exe") if arguments else ""
    return "--driver-mode=cl" in arguments or stem in ("cl", "clang-cl")


def language(arguments: list[str], path: str) -> str:
    """c or c++: the last -x, /TC or /TP; else a C++ driver's name; else the extension."""
    cl, out = is_cl(arguments), None
    for i, a in enumerate(arguments):
        if a == "-x" and i + 1 < len(arguments):
            out = arguments[i + 1]
        elif a.startswith("-x") and len(a) > 2 and not cl:
            out = a[2:]
        elif cl and a.upper() in ("/TC", "-TC", "/TP", "-TP"):
            out = "c" if a[-1].upper() == "C" else "c++"
    if out is not None:
        return "c" if out.split("-")[0] == "c" else "c++"
    if not cl and arguments and arguments[0].rstrip("0123456789.-").endswith("++"):
        return "c++"
    return "c" if path.endswith(".c") or cl and path.endswith(".C") else "c++"


def predefined(arguments: list[str], path: str) -> list[tuple[str, str]]:
    """The compiler's own macros for the driver, the language and its standard."""
    cl, lang = is_cl(arguments), language(arguments, path)
    std = next((a.split(("=" if "=" in a else ":"), 1)[1] for a in reversed(arguments) if a.startswith(("-std=", "--std=", "/std:", "-std:"))), "")
    if "-ansi" in arguments and not std:
        std = "c89" if lang == "c" else "c++98"
    out = [tuple(x.split("=", 1)) for x in f"{COMMON} {WINDOWS if cl else LINUX}".split()]
    version = std.removeprefix("gnu").removeprefix("c").removeprefix("++")
    if lang == "c++":
        out.append(("__cplusplus", CPLUSPLUS.get(version, "201402L" if cl else "201703L")))
        if not cl:
            out += [("__GNUG__", "4"), ("_GNU_SOURCE", "1")]
        if "-fno-exceptions" not in arguments:
            out += [("__EXCEPTIONS", "1"), ("__cpp_exceptions", "199711L")]
        if "-fno-rtti" not in arguments:
            out += [("__GXX_RTTI", "1"), ("__cpp_rtti", "199711L")]
    elif STDC.get(version, "201710L"):
        out.append(("__STDC_VERSION__", STDC.get(version, "201710L")))
    if not cl and not std.startswith(("c", "iso")):
        out += [("linux", "1"), ("unix", "1")]
    if any(a.startswith("-O") and a not in ("-O0", "-O") for a in arguments):
        out.append(("__OPTIMIZE__", "1"))
    if "-fopenmp" in arguments:
        out.append(("_OPENMP", "201811"))
    if "-pthread" in arguments:
        out.append(("_REENTRANT", "1"))
    return out


def flags(arguments: list[str], directory: str, path: str = "a.cpp", resource: str = "") -> Flags:
    """What the command sets, relative folders from its directory; either driver's spelling."""
    cl = is_cl(arguments)
    found: dict[str, list] = {k: [] for k in ("quote", "search", "system", "after", "forced")}
    out = Flags(directory, plain_c=language(arguments, path) == "c", definitions=predefined(arguments, path))
    prefix, i = "", 1
    absolute = lambda p: posixpath.normpath(posixpath.join(directory, p))
    while i < len(arguments):
        a = arguments[i]
        spelled = "-" + a[1:] if cl and a.startswith("/") else a
        flag = next((f for f in sorted(_SEARCH, key=len, reverse=True) if spelled.startswith(f)), None)
        if spelled in ("-iprefix", "-iwithprefix", "-iwithprefixbefore") and i + 1 < len(arguments):
            i += 1
            if spelled == "-iprefix":
                prefix = arguments[i]
            else:
                found["search" if spelled.endswith("before") else "after"].append(absolute(prefix + arguments[i]))
        elif flag and not (flag == "-include" and spelled.startswith("-include-pch")):
            value = a[len(flag) :]
            if not value and i + 1 < len(arguments):
                i += 1
                value = arguments[i]
            what = _SEARCH[flag]
            if what == "define":
                name, eq, body = value.partition("=")
                out.definitions.append((name, body if eq else "1"))
            elif what == "undefine":
                out.definitions.append((value, None))
            else:
                found[what].append(value if what == "forced" else absolute(value))
        i += 1
    out.quote, out.search, out.forced = found["quote"], found["search"], found["forced"]
    out.system = found["system"] + found["after"] + ([posixpath.join(resource, "include")] if resource else [])
    return out
