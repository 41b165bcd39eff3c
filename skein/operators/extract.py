"""Symbols, imports and references from source texts by declaration patterns and scope tracking.

A declared subset, not a syntax tree: declarations that begin a line, scopes by braces,
indentation or ``end``; members (fields, properties, enum members, variables) where their
scope says what a line can be. A language without rules of its own gets the generic ones.
One text is one row, so nothing is gathered to read it, and one pass yields all three.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import map_columns

_M = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|synchronized|export|default|declare|pub(?:\([^)]*\))?|unsafe|extern|const|suspend|open|data|inline|fun(?=\s+interface))\s+)*"
_T = r"[\w.<>\[\],?&*:][\w.<>\[\],?&*: ]*?"
_KEYWORDS = frozenset("class record struct interface enum namespace module def defmodule defstruct func function fn fun type trait mod impl delegate event get set init constructor object protocol extension mixin actor sub proc".split())
#: language: (scopes by, patterns of (kind, expression with a name group n, words of which a line must hold one to be asked))
LANGUAGES: dict[str, tuple[str, list[tuple[str, re.Pattern, tuple[str, ...]]]]] = {}


def _needs(pattern: str) -> tuple[str, ...]:
    """A keyword or a bracket that every line that fits the pattern holds; the empty text where there is none."""
    own = pattern.replace(_M, "")
    # what must not follow does not count
    ahead = re.sub(r"\(\?!(?:[^()]|\([^()]*\))*\)", "", own)
    ahead = re.sub(r"\(\?:[^()]*(?:\\?\([^()]*\\?\))?[^()]*\)[?*]", "", ahead)  # nor in what may be left out
    words = _KEYWORDS & set(re.findall(r"[a-z]{2,}", ahead))
    return tuple(sorted(words)) or (("(",) if r"\(" in ahead else ("",))


def _add(names: str, scope: str, *rules: tuple[str, str]) -> None:
    for n in names.split():
        LANGUAGES[n] = (scope, [(k, re.compile(p), _needs(p)) for k, p in rules])


_add("python", "indent", ("class", r"^[ \t]*class\s+(?P<n>\w+)"), ("function", r"^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)\s*\("))
_add("ruby", "end", ("class", r"^\s*class\s+(?P<n>[A-Z]\w*)"), ("namespace", r"^\s*module\s+(?P<n>[A-Z]\w*)"), ("function", r"^\s*def\s+(?:self\.)?(?P<n>\w+[?!=]?)"))
_add("elixir", "end", ("class", r"^\s*defmodule\s+(?P<n>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<n>\w+[?!]?)"), ("struct", r"^\s*(?P<n>defstruct)\b"))
_add("go", "brace", ("struct", r"^type\s+(?P<n>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<n>\w+)\s+interface\b"), ("type_alias", r"^type\s+(?P<n>\w+)\s+[^si{]"), ("method", r"^func\s+\((?:\w+\s+)?\*?(?P<o>\w+)(?:\[[^\]]*\])?\)\s*(?P<n>\w+)\s*\("), ("function", r"^func\s+(?P<n>\w+)\s*[\[(]"))
_add("rust", "brace", ("struct", rf"^\s*{_M}struct\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}trait\s+(?P<n>\w+)"), ("scope", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<n>\w+)"), ("namespace", rf"^\s*{_M}mod\s+(?P<n>\w+)\s*\{{"), ("type_alias", rf"^\s*{_M}type\s+(?P<n>\w+)"), ("function", rf"^\s*{_M}fn\s+(?P<n>\w+)"))
_add("java", "brace", ("class", rf"^\s*{_M}(?:class|record)\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}@?interface\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("method", rf"^(?!\s*(?:return|new|else|throw|case)\b)\s*{_M}(?:<[^>]*>\s+)?{_T}\s+(?P<n>\w+)\s*\([^;=]*\)?\s*(?:throws\s+[\w., ]+)?\s*[{{;]?\s*$"), ("constructor", r"^\s*(?:public|private|protected)\s+(?P<n>[A-Z]\w*)\s*\("))
_add("csharp", "brace", ("namespace", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("class", rf"^\s*{_M}(?:class|record)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_M}struct\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}interface\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("delegate", rf"^\s*{_M}delegate\s+\S+\s+(?P<n>\w+)"), ("event", rf"^\s*{_M}event\s+\S+\s+(?P<n>\w+)"), ("constructor", r"^\s*(?:public|private|protected|internal)\s+(?P<n>[A-Z]\w*)\s*\("), ("property", rf"^\s*{_M}{_T}\s+(?P<n>\w+)\s*\{{\s*(?:get|set|init)\b"), ("method", rf"^(?!\s*(?:return|new|else|throw|await|case)\b)\s*{_M}{_T}\s+(?P<n>\w+)\s*(?:<[^>]*>)?\s*\([^;=]*\)?\s*(?:[{{;]|=>.*)?\s*$"))
_add("typescript javascript tsx jsx", "brace", ("class", rf"^\s*{_M}class\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}interface\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("type_alias", rf"^\s*{_M}type\s+(?P<n>\w+)\s*[<=]"), ("function", rf"^\s*{_M}function\s*\*?\s*(?P<n>\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("constructor", r"^\s*(?P<n>constructor)\s*\("), ("method", rf"^\s+{_M}(?:get\s+|set\s+|\*\s*)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<n>\w+)\s*(?:<[^>]*>)?\s*\([^;]*\)\s*(?::[^{{;]+)?[{{;]\s*$"))
_add("php", "brace", ("namespace", r"^namespace\s+(?P<n>[\w\\]+)"), ("class", rf"^\s*{_M}(?:class|trait)\s+(?P<n>\w+)"), ("interface", r"^\s*interface\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"), ("function", rf"^\s*{_M}function\s+&?(?P<n>\w+)"))
_add("c cpp", "brace", ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{?"), ("class", r"^\s*class\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?:class\s+)?(?P<n>\w+)"), ("namespace", r"^\s*namespace\s+(?P<n>[\w:]+)"), ("function", r"^(?!\s*(?:return|else|if|for|while|switch)\b)[\w:*&<>,\s]+?\b(?P<n>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$"))
_add("kotlin", "brace", ("class", rf"^\s*{_M}(?:class|object)\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}interface\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+class\s+(?P<n>\w+)"), ("function", rf"^\s*{_M}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<n>\w+)\s*\("))
_add("swift", "brace", ("class", rf"^\s*{_M}(?:class|actor)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_M}struct\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}protocol\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("scope", rf"^\s*{_M}extension\s+(?P<n>\w+)"), ("function", rf"^\s*{_M}func\s+(?P<n>\w+)"))
_add("scala", "brace", ("class", r"^\s*(?:(?:final|sealed|abstract|case|private|implicit)\s+)*(?:class|object)\s+(?P<n>\w+)"), ("interface", r"^\s*(?:sealed\s+)?trait\s+(?P<n>\w+)"), ("function", r"^\s*(?:(?:override|private|protected|final|implicit)\s+)*def\s+(?P<n>\w+)"))
_add("dart", "brace", ("class", r"^\s*(?:abstract\s+)?(?:class|mixin)\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"), ("function", r"^\s*(?:static\s+)?(?:[\w<>?,\s]+\s)?(?P<n>\w+)\s*\([^;]*\)\s*(?:async\s*)?(?:\{|=>)"))
_add("bash", "brace", ("function", r"^\s*(?:function\s+)?(?P<n>[\w-]+)\s*\(\s*\)\s*\{?"), ("variable", r"^(?:export\s+|readonly\s+)?(?P<n>[A-Z_]\w*)="))

_add("generic", "brace", ("class", rf"^\s*{_M}(?:class|object|record)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_M}struct\s+(?P<n>\w+)"), ("interface", rf"^\s*{_M}(?:interface|trait|protocol)\s+(?P<n>\w+)"), ("enum", rf"^\s*{_M}enum\s+(?P<n>\w+)"), ("namespace", rf"^\s*{_M}(?:namespace|module|package)\s+(?P<n>[\w.]+)"), ("type_alias", rf"^\s*{_M}(?:type|typedef)\s+(?P<n>\w+)\s*="), ("function", rf"^\s*{_M}(?:function|func|fun|fn|def|sub|proc)\s+(?P<n>\w+)"))

_TYPES = frozenset("class struct interface enum namespace scope".split())
_GENERIC = frozenset(["", "text", "markdown", "json", "yaml", "toml", "xml", "html", "css", "scss", "sql", "protobuf", "graphql", "unknown"])  # languages without declarations that the generic rules could find

#: language: (what a line is directly inside a type, or at the outermost level, pattern); members have no scope of their own.
_V = r"(?:(?:public|private|protected|internal|static|final|readonly|const|volatile|transient|override|required|virtual|abstract|declare|late|lazy|implicit|lateinit|open|weak)\s+)*"
_MEMBERS: dict[str, list[tuple[str, str, re.Pattern]]] = {}


def _members(names: str, *rules: tuple[str, str, str]) -> None:
    for n in names.split():
        _MEMBERS[n] = [(where, kind, re.compile(p)) for where, kind, p in rules]


_ENUM = r"^\s*(?P<n>[A-Za-z_]\w*)\s*(?:=[^,;]*|\([^)]*\)\s*\{?)?\s*[,;]?\s*$"
_FIELD = rf"^(?!\s*(?:return|throw|new|else|package|import|using|goto|yield|await|case)\b)\s*{_V}[A-Za-z_][\w.]*(?:<[^;=()]*>)?(?:\[[\],]*\])*\??\s+(?P<n>[A-Za-z_]\w*)\s*(?:=[^=>].*|=\s*)?;\s*$"
_members("java", ("enum", "enum_member", _ENUM), ("type", "field", _FIELD))
_members("csharp", ("enum", "enum_member", _ENUM), ("type", "field", _FIELD))
_members("typescript tsx", ("enum", "enum_member", _ENUM), ("type", "property", rf"^\s*{_V}(?P<n>[A-Za-z_#$]\w*)\s*[?!]?\s*:\s*[^=;,]+(?:=[^>].*)?[;,]?\s*$"), ("type", "property", rf"^\s*{_V}(?P<n>[A-Za-z_#$]\w*)\s*=\s*[^=>].*;\s*$"), ("top", "variable", r"^(?:export\s+)?(?:const|let|var)\s+(?P<n>[A-Za-z_$]\w*)\s*(?::[^=]+)?="))
_members("javascript jsx", ("type", "property", rf"^\s*{_V}(?P<n>[A-Za-z_#$]\w*)\s*=\s*[^=>].*;\s*$"), ("top", "variable", r"^(?:export\s+)?(?:const|let|var)\s+(?P<n>[A-Za-z_$]\w*)\s*="))
_members("python", ("type", "property", r"^\s+(?P<n>[A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)"), ("type", "property", r"^\s+(?P<n>[A-Za-z_]\w*)\s*:\s*[A-Za-z_][^=]*$"), ("top", "variable", r"^(?P<n>[A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)"))
_members("go", ("struct", "field", r"^\s+(?P<n>[A-Za-z_]\w*)(?:\s*,\s*\w+)*\s+(?:[\[\]*.\w]|map|chan|func)"), ("top", "variable", r"^(?:var|const)\s+(?P<n>[A-Za-z_]\w*)\b"))
_members("rust", ("enum", "enum_member", r"^\s*(?P<n>[A-Z]\w*)\s*(?:\(.*\)|\{.*\}?|=\s*[^,]+)?\s*,?\s*$"), ("any", "variable", rf"^\s*{_M}(?:static|const)\s+(?:mut\s+)?(?P<n>[A-Z_]\w*)\s*:"))
_members("c cpp", ("enum", "enum_member", _ENUM), ("top", "type_alias", r"^\s*typedef\s+.*\b(?P<n>\w+)\s*;\s*$"), ("top", "variable", r"^(?!\s*(?:return|typedef|using|struct|class|enum|goto|extern\s+\"C\")\b)(?:static\s+|extern\s+|const\s+)*[A-Za-z_][\w:<>]*[\s*&]+(?P<n>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:=.*)?;\s*$"))
_members("php", ("enum", "enum_member", r"^\s*case\s+(?P<n>\w+)"), ("type", "property", r"^\s*(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<n>\w+)"), ("type", "field", r"^\s*(?:(?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?(?P<n>\w+)\s*="))
_members("ruby", ("type", "property", r"^\s*attr_(?:accessor|reader|writer)\s+:(?P<n>\w+)"))
_members("kotlin", ("enum", "enum_member", _ENUM), ("any", "property", rf"^\s*(?:{_V}|private\s+)(?:val|var)\s+(?:\w+\.)?(?P<n>\w+)"))
_members("swift", ("enum", "enum_member", r"^\s*case\s+(?P<n>\w+)"), ("any", "property", rf"^\s*{_V}(?:let|var)\s+(?P<n>\w+)\s*[:=]"))
_members("scala", ("enum", "enum_member", r"^\s*case\s+(?P<n>\w+)"), ("type", "property", rf"^\s*{_V}(?:val|var)\s+(?P<n>\w+)"))
_members("dart", ("enum", "enum_member", _ENUM), ("type", "property", _FIELD), ("top", "variable", r"^(?:final|const|var)\s+(?:[\w<>?]+\s+)?(?P<n>\w+)\s*="))
_members("elixir", ("type", "variable", r"^\s*@(?P<n>(?!doc\b|moduledoc\b|spec\b|type\b|impl\b|behaviour\b|callback\b)\w+)\s+\S"))

_ENUM_MEMBER = re.compile(_ENUM)
_PLAIN_ENUMS = frozenset("java csharp typescript tsx c cpp kotlin dart".split())
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function def fn func class new elif match sizeof typeof await super raise throw and or not in is lambda with except print constructor foreach using lock unless until".split())
#: language: (pattern, groups of names, of the module); a name group may list several.
_IMPORT: dict[str, list[tuple[re.Pattern, int, int]]] = {}


def _imports(names: str, *rules: tuple[str, int, int]) -> None:
    for n in names.split():
        _IMPORT[n] = [(re.compile(p), a, b) for p, a, b in rules]


_imports("python", (r"^\s*from\s+([\w.]+)\s+import\s+\(?([\w, *]+)", 2, 1), (r"^\s*import\s+([\w.]+)", 0, 1))
_imports("java", (r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*)\s*;", 2, 1))
_imports("kotlin scala", (r"^\s*import\s+([\w.]+)\.(\w+|\*|_)", 2, 1))
_imports("csharp", (r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", 1, 1))
_imports("typescript tsx", (r"^\s*import\s+(?:type\s+)?\{\s*([\w, $]+?)\s*\}\s+from\s+[\"']([^\"']+)", 1, 2), (r"^\s*import\s+(?:type\s+)?(?:\*\s+as\s+)?([\w$]+)\s+from\s+[\"']([^\"']+)", 1, 2))
_imports("javascript jsx", (r"^\s*import\s+\{\s*([\w, $]+?)\s*\}\s+from\s+[\"']([^\"']+)", 1, 2), (r"^\s*import\s+(?:\*\s+as\s+)?([\w$]+)\s+from\s+[\"']([^\"']+)", 1, 2), (r"^\s*(?:const|let|var)\s+\{?\s*([\w, $]+?)\s*\}?\s*=\s*require\(\s*[\"']([^\"']+)", 1, 2))
_imports("go", (r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", 0, 1))
_imports("rust", (r"^\s*(?:pub\s+)?use\s+([\w:]+)::\{([\w, ]+)\}", 2, 1), (r"^\s*(?:pub\s+)?use\s+([\w:]+)::(\w+|\*)", 2, 1))
_imports("ruby", (r"^\s*require(?:_relative)?\s+[\"']([^\"']+)", 0, 1))
_imports("php", (r"^\s*use\s+([\w\\]+)\\(\w+)\s*;", 2, 1))
_imports("c cpp", (r"^\s*#\s*include\s+[<\"]([^>\"]+)", 0, 1))
_imports("swift", (r"^\s*import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)", 0, 1))
_imports("dart", (r"^\s*import\s+[\"']([^\"']+)", 0, 1))
_imports("elixir", (r"^\s*(?:alias|import|require|use)\s+([\w.]+)", 0, 1))
_imports("bash", (r"^\s*(?:source|\.)\s+([\w./-]+)", 0, 1))
_imports("generic", (r"^\s*import\s+([\w.]+)", 0, 1))

_BASES = re.compile(r"\bclass\s+\w+(?:<[^>]*>)?\s*(?:\(\s*([\w., ]+)\)|(?:extends|<|:)\s*([\w., ]+))")
_IMPLEMENTS = re.compile(r"\bimplements\s+([\w., ]+)")
_NEW = re.compile(r"\bnew\s+([A-Z]\w*)")
_TYPED = re.compile(r"[:(,]\s*(?:final\s+)?([A-Z]\w*)(?:<[\w, ]*>)?[?\[\]]*\s+\w+\s*[,)]|\w\s*\??:\s*([A-Z]\w*)|->\s*([A-Z]\w*)")
_STRINGS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`")
_BRACES = re.compile(r"[{}]")


@dataclass
class Found:
    name: str
    qualified_name: str
    kind: str
    line: int
    col: int
    end_line: int | None
    scope_path: str | None
    signature: str
    visibility: str | None
    refs: list = field(default_factory=list)


def _bare(line: str, hashes: bool) -> str:
    """A line without string contents and comments, of the same length."""
    if '"' in line or "'" in line or "`" in line:
        line = _STRINGS.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], line)
    at = line.find("#" if hashes else "//")
    return line if at < 0 else line[:at] + " " * (len(line) - at)


def _visibility(language: str, line: str, name: str) -> str | None:
    m = re.search(r"\b(public|private|protected|internal)\b", line)
    if m:
        return m[1]
    if language == "python" or language == "ruby":
        return "private" if name.startswith("_") else "public"
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if re.match(r"\s*pub\b", line) else "private"
    return "public" if re.match(r"\s*export\b", line) else None


def language_rules(language: str) -> str:
    """The rules a language is read by: its own, the generic ones, or none ("")."""
    return language if language in LANGUAGES else "" if language in _GENERIC else "generic"


def extract(language: str, content: str) -> list[Found]:
    """The symbols of a text with the references inside each; imports are symbols of kind import, with the module as qualified name."""
    language = language_rules(language)
    if not language:
        return []
    how, rules = LANGUAGES[language]
    members, imports = _MEMBERS.get(language, ()), _IMPORT.get(language, ())
    hashes = language in ("python", "ruby", "elixir", "bash")
    out: list[Found] = []
    stack: list[tuple[Found, int]] = []  # symbol, depth or indentation at which it ends
    depth, space, doc, last, marked, wide = 0, "", None, 0, False, False
    pending: Found | None = None
    for n, raw in enumerate(content.replace("\r\n", "\n").split("\n")):
        line = raw
        if doc:
            doc = None if doc in line else doc
            continue
        if hashes and ('"""' in line or "'''" in line):
            mark = re.search(r"\"\"\"|'''", line)[0]
            if line.count(mark) % 2:
                doc = mark
            continue
        if not hashes and "/*" in line:
            if "*/" not in line[line.find("/*") :]:
                doc = "*/"
            line = line[: line.find("/*")]
        bare = _bare(line, hashes)
        body = bare.strip()
        if not body:
            continue
        indent = len(bare) - len(bare.lstrip())
        if how == "indent":
            while stack and indent <= stack[-1][1]:
                stack.pop()[0].end_line = last
        if not stack or language == "rust":
            if language in ("java", "kotlin", "scala", "go", "dart") and (m := re.match(r"package\s+([\w.]+)", body)):
                space = m[1]
                if language != "go":
                    out.append(Found(space.rsplit(".", 1)[-1], space, "namespace", n, indent, n, None, body.rstrip(" ;"), None))
                continue
            if imports and (wide := wide and ")" not in body or body in ("import (", "from (")) | bool(_imported(line, n, imports, out)):
                if not body.endswith("{"):
                    continue
        hit = None
        inside = stack[-1][0] if stack else None
        if inside is not None and inside.kind == "enum" and (m := _ENUM_MEMBER.match(bare)) and m["n"] != inside.name and language in _PLAIN_ENUMS:
            _member(language, bare, body, n, indent, space, inside, 0, members, out)
            rules_here = ()
        else:
            rules_here = rules
        for kind, p, needs in rules_here:
            for word in needs:
                if word in bare:
                    break
            else:
                continue
            m = p.match(bare)
            if m and (kind == "constructor" or m["n"] not in _NOT_CALLS):
                hit = kind, m
                break
        if hit:
            kind, m = hit
            name = m["n"]
            outer = next((s for s, _ in reversed(stack) if s.kind in _TYPES), None)
            scope = outer.qualified_name if outer else (space or None)
            if "o" in m.groupdict() and m.groupdict()["o"]:
                scope = ".".join(x for x in (space, m["o"]) if x)
            if kind == "function" and (outer and outer.kind in ("class", "struct", "interface", "scope")):
                kind = "method"
            if kind == "function" and re.match(r"(?i)test(_|[A-Z])", name):
                kind = "test"
            if language == "python" and name == "__init__" or kind == "method" and outer and name == outer.name:
                kind = "constructor"
            elif kind == "method" and marked:
                kind = "property"
            f = Found(name, ".".join(x for x in (scope, name) if x), kind, n, indent, None, scope, re.sub(r"\s*[{:]\s*$", "", body), _visibility(language, bare, name))
            if kind != "scope":
                out.append(f)
            if kind in _TYPES:
                for rx, ref in ((_BASES, "inherits"), (_IMPLEMENTS, "implements")):
                    b = rx.search(bare)
                    for base in re.split(r"\s*,\s*", next((x for x in b.groups() if x), "")) if b else ():
                        base = base.split(" ")[0].strip()
                        if base:
                            # by the usage of C#, an I and a capital begin an interface
                            f.refs.append((base, "implements" if language == "csharp" and re.match(r"I[A-Z]", base) else ref, n))
            else:
                f.refs += [(next(x for x in t if x), "type_ref", n) for t in _TYPED.findall(body[body.find("(") :])]
            if how == "indent":
                stack.append((f, indent))
            elif how == "end":
                if not re.search(r"\bend\s*$", bare):
                    stack.append((f, indent))
            elif re.search(r"\{.*\}\s*$", body) or kind not in _TYPES and body.endswith(";"):
                f.end_line = n
            else:
                pending = f
        marked = language == "python" and body == "@property"
        owner = stack[-1][0] if stack else None
        if not hit:
            if members and rules_here:
                _member(language, bare, body, n, indent, space, owner, depth if how == "brace" else indent, members, out)
            if owner is not None and "(" in bare:
                if "new" in bare:
                    owner.refs += [(name, "instantiates", n) for name in _NEW.findall(bare)]
                owner.refs += [(name, "calls", n) for name in _CALL.findall(bare) if name not in _NOT_CALLS]
        elif f.kind not in _TYPES and "{" in bare:
            f.refs += [(name, "calls", n) for name in _CALL.findall(bare[bare.find("{") :]) if name not in _NOT_CALLS]
        if how == "brace":
            for c in _BRACES.findall(bare):
                if c == "{":
                    if pending is not None:
                        stack.append((pending, depth))
                        pending = None
                    depth += 1
                else:
                    depth -= 1
                    while stack and depth <= stack[-1][1]:
                        stack.pop()[0].end_line = n
            if pending is not None and body.endswith(";"):
                if pending.kind == "namespace":
                    space = pending.name
                pending.end_line, pending = n, None
        elif how == "end" and body.startswith("end") and re.match(r"end\b", body) and stack and indent <= stack[-1][1]:
            stack.pop()[0].end_line = n
        last = n
    for f, _ in stack:
        f.end_line = last if how == "indent" else f.end_line
    return out


def _imported(line: str, n: int, rules, out: list[Found]) -> int:
    """Adds the imports of a line; how many."""
    for p, names, module in rules:
        m = p.match(line)
        if m:
            path = m[module].replace("::", ".").replace("\\", ".")
            found = [x.split(" as ")[0].strip() for x in m[names].split(",")] if names else [re.split(r"[/.]", re.sub(r"\.(?:h|hpp|hh|dart|sh|rb|exs?)$", "", path))[-1]]
            found = [path if names == module and names else x for x in found if x]
            out += [Found(x, path, "import", n, 0, n, None, line.strip(), None) for x in found]
            return len(found)
    return 0


def _member(language: str, bare: str, body: str, n: int, indent: int, space: str, owner: Found | None, depth: int, rules, out: list[Found]) -> None:
    """Adds the member that a line without a declaration of its own may be, by the scope it stands in."""
    where = "top" if owner is None else owner.kind if owner.kind in ("enum", "struct", "class", "interface", "scope") else ""
    if where == "top" and depth > 0 or not where:
        return
    for at, kind, p in rules:
        if at != "any" and at != where and not (at == "type" and where in ("class", "struct", "interface", "enum", "scope")):
            continue
        m = p.match(bare)
        if m and m["n"] not in _NOT_CALLS:
            scope = owner.qualified_name if owner else (space or None)
            out.append(Found(m["n"], ".".join(x for x in (scope, m["n"]) if x), kind, n, indent, n, scope, re.sub(r"\s*[,;{]\s*$", "", body), _visibility(language, bare, m["n"])))
            if owner is not None and (t := _TYPED.search(body)):
                owner.refs.append((next(x for x in t.groups() if x), "type_ref", n))
            return


def imports_of(language: str, content: str) -> list[tuple[str, str | None, int]]:
    """(imported name, module, line from 0)."""
    return [(f.name, f.qualified_name, f.line) for f in extract(language, content) if f.kind == "import"]


_SYMBOLS = "file_id long, name string, qualified_name string, kind string, line int, col int, end_line int, scope_path string, signature string, visibility string, refs array<struct<target:string,kind:string,line:int>>"


def _run(cols):
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", _SYMBOLS)]
    out: dict[str, list] = {k: [] for k in names}
    for f, language, content in zip(cols["file_id"], cols["language"], cols["content"]):
        for s in extract(language or "", content or ""):
            for k, v in zip(names, (f, s.name, s.qualified_name, s.kind, s.line, s.col, s.end_line, s.scope_path, s.signature, s.visibility, [{"target": t, "kind": k2, "line": n} for t, k2, n in s.refs])):
                out[k].append(v)
    return out


def extract_all(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols with their references, and imports (kind import), of all texts in one pass."""
    read = files.select(F.col("id").alias("file_id"), "language").join(sources.select("file_id", "content"), "file_id")
    return map_columns(read, _run, _SYMBOLS)


def extract_symbols(files: DataFrame, sources: DataFrame) -> DataFrame:
    """The symbols of all texts (file_id, language, content), each with its references."""
    return extract_all(files, sources).filter("kind <> 'import'")


def extract_imports(found: DataFrame) -> DataFrame:
    """file_id, imported_name, module_path, line of the imports in what ``extract_all`` found."""
    return found.filter("kind = 'import'").select("file_id", F.col("name").alias("imported_name"), F.col("qualified_name").alias("module_path"), "line")


def extract_refs(found: DataFrame) -> DataFrame:
    """file_id, source (qualified name), source_line (of its declaration), target_name, kind, line of the references inside extracted symbols."""
    return found.filter("kind <> 'import'").select("file_id", F.col("qualified_name").alias("source"), F.col("line").alias("source_line"), F.explode("refs").alias("r")).select("file_id", "source", "source_line", F.col("r.target").alias("target_name"), F.col("r.kind").alias("kind"), F.col("r.line").alias("line"))


def split_chunk(text: str, first: int, limit: int = 512) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the pieces of a chunk of more than ``limit`` tokens (4 characters each): its parts between blank lines, and where such a part is too long still, cuts of four bytes a token between characters. Blank pieces are left out; a text that leaves none stays whole."""
    if -(-len(text) // 4) <= limit:
        return [(first, first + max(0, len(text.split("\n")) - 1), text)]
    out: list[tuple[int, int, str]] = []
    lines = text.split("\n")
    start = 0
    for i in range(len(lines) + 1):
        if i < len(lines) and (lines[i].strip() or i == start):
            continue
        part = "\n".join(lines[start:i])
        if -(-len(part) // 4) > limit:
            raw, at, line = part.encode("utf-8", "surrogatepass"), 0, first + start
            while at < len(raw):
                end = min(len(raw), at + limit * 4)
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end -= 1
                piece = raw[at:end].decode("utf-8", "surrogatepass")
                rows = len(piece.splitlines())
                if piece.strip():
                    out.append((line, line + max(0, rows - 1), piece))
                line, at = line + rows, end
        elif part.strip():
            out.append((first + start, first + i - 1, part))
        start = i + 1
    return out or [(first, first + len(lines) - 1, text)]


def _split_chunks(cols):
    out: dict[str, list] = {k: [] for k in ("file_id", "symbol_id", "start_line", "end_line", "content")}
    for f, s, a, text in zip(cols["file_id"], cols["symbol_id"], cols["start_line"], cols["content"]):
        for first, last, piece in split_chunk(text, a):
            for k, v in zip(out, (f, s, first, last, piece)):
                out[k].append(v)
    return out


def chunk_files(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """The chunks of ``whole_chunks``, those of more than 512 tokens split (see ``split_chunk``); all others never leave the JVM."""
    whole = whole_chunks(symbols, sources)
    long = F.length("content") > 2048
    split = map_columns(whole.filter(long), _split_chunks, "file_id long, symbol_id long, start_line int, end_line int, content string")
    return whole.filter(~long).unionByName(split)


def whole_chunks(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, symbol_id (null for gaps), start_line, end_line, content of symbol bodies and the gaps between outermost ones; blank pieces are left out.

    The spans of a file are one array no longer than the file, which the text then cuts in the JVM."""
    s = symbols.filter("line is not null and end_line is not null").select("file_id", F.col("id").alias("symbol_id"), F.col("line").alias("a"), F.col("end_line").alias("b"))
    lines = sources.select("file_id", F.split("content", "\n").alias("lines"))
    text = F.array_join(F.slice("lines", F.col("a") + 1, F.greatest(F.lit(1), F.col("b") - F.col("a") + 1)), "\n")
    bodies = s.join(lines, "file_id").filter("a < size(lines)").select("file_id", "symbol_id", F.col("a").alias("start_line"), F.least("b", F.size("lines") - 1).alias("end_line"), text.alias("content"))
    spans = s.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    gaps = F.expr("""aggregate(spans, named_struct('at', 0, 'out', CAST(array() AS array<struct<a:int,b:int>>)),
        (acc, x) -> named_struct('at', greatest(acc.at, x.b + 1), 'out', IF(x.a > acc.at, concat(acc.out, array(named_struct('a', acc.at, 'b', x.a - 1))), acc.out)), acc -> acc.out)""")
    with_gaps = lines.join(spans, "file_id", "left").withColumn("spans", F.coalesce("spans", F.expr("CAST(array() AS array<struct<a:int,b:int>>)")))
    tail = F.expr("greatest(0, coalesce(array_max(transform(spans, x -> x.b + 1)), 0))")
    every = with_gaps.select("file_id", "lines", F.explode(F.concat(gaps, F.array(F.struct(tail.alias("a"), (F.size("lines") - 1).alias("b"))))).alias("g")).filter("g.a <= g.b and g.a < size(lines)")
    cut = every.select("file_id", F.lit(None).cast("long").alias("symbol_id"), F.col("g.a").alias("start_line"), F.least("g.b", F.size("lines") - 1).alias("end_line"), F.array_join(F.slice("lines", F.col("g.a") + 1, F.col("g.b") - F.col("g.a") + 1), "\n").alias("content"))
    return bodies.unionByName(cut).filter(F.length(F.trim(F.regexp_replace("content", r"\s+", " "))) > 0)
