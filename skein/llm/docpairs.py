"""Problem 3: functions paired with their documentation.

The documentation of a function is its ``doc_comment`` or, where that is null, a comment
of the source. ``comment_candidates`` reads each text once, without moving it, and keeps
its comment blocks and the strings that open Python bodies. The comments and functions of
a file then meet in a bipartite assignment: an edge joins a comment and each function
declared up to ``REACH`` lines below it; its weight comes from the parameters that the
comment's tags name, from the function's name in the comment, from the lines in between
and from whether anything but annotations stands there. A link whose weight is below
``LEAST`` is implausible and refused: its tags name other parameters than the function
has, or nothing speaks for it. ``assign`` finds the matching of the greatest total weight
among the others. What it links is checked
against the definition, by which documentation ends on the line above its function.
Documentation that says nothing is dropped by ``prose_words``.

Odd input: a null name or signature matches nothing; a null or negative line, or a line
behind the end of the text, finds no comment; a null content has no comments; repeated
rows give one row each; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re

from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import map_columns

MIN_WORDS = 5
REACH = 12  # lines below a comment within which functions compete for it
LEAST = 3.0  # weight of a plausible link, at least

# -- what a comment says ----------------------------------------------------------
_MARK = re.compile(r"^[ \t]*(?:/\*\*?!?|\*/|///?!?|//!|\*(?!\*)|#+!?(?!\[))[ \t]?", re.M)
_QUOTES = re.compile(r"^\s*[rRbBuUfF]{0,2}(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')\s*$")
_XML_TAG = re.compile(r"(?s)<(param|typeparam|returns|exception|value|see|seealso|paramref|example|code|permission)\b[^>]*?(?:/>|>.*?</\1>)")
_XML = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s[^<>]*)?/?>")
#: Tags of documentation tools; a tag's text runs to the next tag or empty line.
_TAG = re.compile(r"^[ \t]*(?:@\w[\w-]*|[:\\](?:param|type|returns?|rtype|raises?|arg|args|keyword|var|ivar|cvar|throws|yields?)\b|\{@\w+[^}]*\}\s*$|-\s*(?:Parameters?|Returns?|Throws)\b.*:)")
_SECTION = re.compile(r"^[ \t]*(?:Args?|Arguments|Params?|Parameters|Returns?|Raises|Yields?|Throws|Attributes|Keyword Args|Other Parameters|Examples?|See Also|References)[ \t]*:", re.I)
_TODO = re.compile(r"^[ \t]*(?:(?-i:TODO|XXX|HACK|BUG|NOTE TO SELF|TBD)\b[ \t]*(?:[:(\-–]|$|(?!(?:items|entries|notes|comments|markers|lists?|tasks|tags)\b)\w)|FIXME\b|to-?do\b[ \t]*[:(\-])", re.I)
_DIRECTIVE = re.compile(
    r"(?i)^[ \t]*(?:eslint|jshint|jslint|tslint|prettier|istanbul|c8|webpack|noinspection|nolint|golint|go:|clippy|rustfmt|rubocop|reek|frozen_string_literal|noqa|nosonar|nosec|pylint|flake8|mypy|pyright|type:[ ]*ignore|pragma|fmt:|yapf|isort|resharper|stylecop|checkstyle|suppress\w*|sonar|spotbugs|findbugs|coverage|codecov|@ts-|ts-|biome|region|endregion|-\*-|vim?:|:nodoc:|:startdoc:|:stopdoc:)"
)
_RIGHTS = re.compile(
    r"(?i)^[ \t]*(?:copyright\b(?!-)|\(c\)|©|all rights reserved|licen[cs]ed? (?:under|to)\b|spdx|authors?\b[ \t]*:|owners?\b[ \t]*:|maintainers?\b[ \t]*:|contact\b[ \t]*:|created\b.*\bby\b|written by\b|last (?:change|changed|modified|update|updated|edit)\b|since\b[ \t]*:|version\b[ \t]*:|date\b[ \t]*:)"
)
_POINTER = re.compile(r"(?i)^[ \t]*(?:see(?: also)?|cf\.?|vgl\.?|siehe|voir|véase|refer to|compare|details:?|docs?:?|more:?|spec:?)\b")
_URL = re.compile(r"\b[a-z][a-z+.-]*://\S+|\b[A-Z]{1,10}-\d+\b|#\d+\b|\{@link[^}]*\}")
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?")
_FILLER = frozenset(
    "a an and add adds added available be being brief class coming comes come comment constructor describe describes described description desc detail details do doc docs documentation documented does done empty explain explanation field file fill filled follow follows following for function goes here if in info information insert is it later lorem ipsum method missing more n/a na needed needs no none nothing of placeholder please pending property provide purpose put sample self-explanatory should soon stub summary tba tbc tbd text that the this to todo undocumented unknown up what write written yet your".split()
)
_LINK_WORDS = frozenset("a an the this is of to for and method function member procedure der die das le la les el los un une it its in on".split())
_CODE_LINE = re.compile(
    r"[{}]\s*$|[=()\[\]\"'].*;\s*$|\w\.\w.*;\s*$|^\s*(?:return|break|continue|pass)\s*;\s*$|^\s*[})\]]|=>|->\s*\S+\s*[{:]|[-+*/|&]=\s|==|!=|\w\s*:?=\s*[\w\"'\[({&*!-]|\w\(\s*\)|\w\([^()]*\)\s*$|\w\.\w+\(|\w\[[^\]]*\]|^\s*(?:if|elif|while|for|else|try|except|with|def|class)\b.*:\s*$|^\s*(?:return|raise|throw)\b.*[\d\"'(]|^\s*(?:end|begin|else|ensure|pass|break|continue|rescue(?:\s+\w+)?)\s*$|^\s*(?:if|while|unless|elsif|until|return|raise)\s.*(?:[<>]|\.\w+\?|\bnil\b|\bNone\b|\")|^\s*(?:public|private|protected|static|func|fn|pub|def|let|var|const|function|export|async)\s.*[({=]"
)


def _plain(doc: str) -> str:
    doc = doc.replace("\r\n", "\n").replace("\r", "\n").strip()
    if doc[:1] in "\"'rRbBuUfF" and _QUOTES.match(doc):
        doc = _QUOTES.sub("", doc)
    else:
        doc = _MARK.sub("", doc)
        doc = re.sub(r"\s*\*+/\s*$", "", doc)
    doc = _XML_TAG.sub(" ", doc)
    return _XML.sub(lambda m: "\n" if m[0].lower().strip("</> ") in ("summary", "remarks", "para", "p", "br") else " ", doc)


def prose(doc: str) -> list[str]:
    """The paragraphs of a comment that are prose: no tags, notes, directives, rights, pointers or code."""
    out = []
    for para in re.split(r"\n[ \t]*\n", _plain(doc)):
        lines = [x for x in para.split("\n") if x.strip()]
        code = sum(1 for x in lines if _CODE_LINE.search(x))
        if lines and 2 * code >= len(lines):
            continue
        kept: list[str] = []
        for k, line in enumerate(lines):
            if _TAG.match(line) or _SECTION.match(line) or _TODO.match(line):
                break  # to the end of the paragraph
            if _DIRECTIVE.match(line):
                continue
            if _RIGHTS.match(line):
                continue
            if not re.search(r"[^\W\d_]", line):
                continue
            kept.append(line.strip())
        if kept:
            out.append(" ".join(kept))
    return out


def _parts(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+", name or "")}


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: len(w) - len(end)]
    return w


def prose_words(doc: str | None, name: str | None) -> int:
    """Words of prose in a documentation comment beyond the function's own name."""
    if not doc:
        return 0
    own = {_stem(p) for p in _parts(name)}
    total = 0
    for para in prose(doc):
        for sentence in re.split(r"(?<=[.!?;:])\s+(?=\S)", para):
            bare = _URL.sub(" ", sentence)
            words = _WORD.findall(bare)
            if _POINTER.match(sentence) and len(words) <= 5:
                continue
            if all(w.lower() in _FILLER for w in words):
                continue
            if name and name in sentence:
                words = [w for w in words if w != name]
            said = [w for w in words if w.lower() not in _LINK_WORDS]
            if all(_stem(p) in own for w in said for p in (_parts(w) or {w.lower()})):
                continue
            total += len(words)
    return total


# -- where comments stand ---------------------------------------------------------
_ANNOTATION = re.compile(r"^\s*(?:@[\w.]+|\[\w[^\]]*\]\s*$|#!?\[)")
_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+", re.M)
_DOCSTRING = re.compile(r"\s*(?:#[^\n]*\n\s*)*([rRuU]?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))")
_SKIP = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]")
_BEFORE = re.compile(r"^[ \t]*(?:(?P<slash>///?.*)|(?P<hash>#(?!!?\[).*)|(?P<close>.*\*/[ \t]*))\r?$")


def _docstring(content: str, start: int) -> str | None:
    depth = 0
    for m in _SKIP.finditer(content, start):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            d = _DOCSTRING.match(content, m.end())
            return d[1] if d else None
    return None


def comment_blocks(content: str):
    """(style, last line, line it is attached to, text) of each comment; style is slash, hash or string. A comment is attached to the next line that is no annotation, unless that is empty (null), a string that opens a body to its declaration."""
    lines = content.split("\n")
    i, n = 0, len(lines)
    while i < n:
        line = lines[i].strip()
        first, style = i, ""
        if line.startswith("//"):
            style = "slash"
            while i + 1 < n and lines[i + 1].lstrip().startswith("//"):
                i += 1
        elif line.startswith("/*"):
            style = "slash"
            while i < n and "*/" not in lines[i][lines[i].find("/*") + 2 if i == first else 0 :]:
                i += 1
            if i == n or lines[i].rstrip()[-2:] != "*/":
                style = ""
        elif line.startswith("#") and not line.startswith(("#[", "#!")):
            style = "hash"
            while i + 1 < n and lines[i + 1].lstrip().startswith("#") and not lines[i + 1].lstrip().startswith("#["):
                i += 1
        last = min(i, n - 1)
        i += 1
        if style:
            d = last + 1
            while d < n and _ANNOTATION.match(lines[d]):
                d += 1
            yield style, last, d if d < n and lines[d].strip() else None, "\n".join(x.strip() for x in lines[first : last + 1])
    if "def " in content:
        at, line = 0, 0
        for m in _DEF.finditer(content):
            line += content.count("\n", at, m.start())
            at = m.start()
            doc = _docstring(content, m.end())
            if doc is not None:
                yield "string", line - 1, line, doc


def _candidates(cols):
    out = {"file_id": [], "style": [], "line": [], "attached": [], "text": []}
    for f, content in zip(cols["file_id"], cols["content"]):
        for style, last, attached, text in comment_blocks(content or ""):
            for k, v in zip(out, (f, style, last, attached, text)):
                out[k].append(v)
    return out


def comment_candidates(sources: DataFrame) -> DataFrame:
    """file_id, style, line (the last of the comment), attached, text: see ``comment_blocks``. The texts do not move."""
    return map_columns(sources.select("file_id", "content"), _candidates, "file_id long, style string, line int, attached int, text string")


# -- pairs -------------------------------------------------------------------------
_TAGGED = re.compile(r"(?:@param|:param|\\param)\s+(?:\{[^}]*\}\s*)?\[?(\w+)|<param name=\"(\w+)\"|^\s+(\w+)\s*(?:\([^)]*\))?:", re.M)
_PARAMS = re.compile(r"\((.*)\)", re.S)


def tags_of(comment: str) -> set[str]:
    """The parameters that a comment's tags name."""
    return {a or b or c for a, b, c in _TAGGED.findall(comment)}


def params_of(signature: str | None) -> set[str]:
    m = _PARAMS.search(signature or "")
    return set(re.findall(r"\w+", m[1])) if m else set()


def link_weight(tags: set[str], params: set[str], named: bool, lines: int, attached: bool) -> float:
    """Weight of the edge between a comment and a function ``lines`` below it."""
    strangers = len(tags - params) if params else 0
    return (10.0 if attached else 2.0) + 3.0 * len(tags & params) - 2.0 * strangers + named - 0.25 * lines


def assign(edges: dict[tuple[int, int], float]) -> dict[int, int]:
    """The matching of greatest total weight between comments and functions, given as weights of (comment, function).

    Where comments prefer different functions, that is it. A comment whose first choice
    goes to another one is brought in along the alternating path that gains most; paths
    end where what they have lost outweighs all that a comment could still win, so that
    the search stays near, however many comments a file has."""
    of: dict[int, dict[int, float]] = defaultdict(dict)
    for (c, f), w in sorted(edges.items()):
        if w > 0:
            of[c][f] = w
    most = {c: max(fs.values()) for c, fs in of.items()}
    mate: dict[int, int] = {}  # function: comment
    for c, fs in of.items():
        f = next(x for x, w in fs.items() if w == most[c])
        if f not in mate or fs[f] > of[mate[f]][f]:
            mate[f] = c
    match = {c: f for f, c in mate.items()}
    for c in of:
        if c not in match:
            _bring_in(c, of, most, match, mate)
    return match


def _bring_in(start: int, of: dict[int, dict[int, float]], most: dict[int, float], match: dict[int, int], mate: dict[int, int]) -> None:
    """Adds a comment to a best matching: over a free function, or at the cost of the comment that can best do without."""
    gain = {start: 0.0}
    came: dict[int, tuple[int, int]] = {}  # comment: (the comment before it on the path, the function that one takes from it)
    best, end = 1e-9, None
    todo = [start]
    while todo:
        again = []
        for c in todo:
            for f, w in of[c].items():
                c2 = mate.get(f)
                if c2 == c:
                    continue
                g = gain[c] + w - (of[c2][f] if c2 is not None else 0.0)
                if g > best:
                    best, end = g, (c, f)
                if c2 is not None and c2 != start and g + most[c2] > best and g > gain.get(c2, -1e18) + 1e-9:
                    gain[c2], came[c2] = g, (c, f)
                    again.append(c2)
        todo = again
    if end is None:
        return
    c, f = end
    dropped = mate.get(f)
    if dropped is not None:
        del match[dropped]
    while True:
        match[c], mate[f] = f, c
        if c == start:
            return
        c, f = came[c]


_PAIRED = "symbol_id long, file_id long, line int, origin string, description string, words int, weight double"


def _link_file(rows: list[tuple]) -> list[tuple]:
    """The judged documentation of the functions of one file that have none in their column: rows of (file_id, what, line, attached, symbol_id, text, name, signature, documented)."""
    style = next((r[5] for r in rows if r[1] == "style"), "slash")
    comments = [r for r in rows if r[1] == style]
    copies = Counter(r[4] for r in rows if r[1] == "function")
    functions = sorted({r[4]: r for r in rows if r[1] == "function"}.values(), key=lambda r: (r[2], r[3] if r[3] is not None else 1 << 40, r[4]))
    lines = [r[2] for r in functions]
    params = [None] * len(functions)
    edges, at = {}, {}
    for k, c in enumerate(comments):
        near = range(bisect_left(lines, c[2] + 1), bisect_left(lines, c[2] + 1 + REACH))
        # an annotation block may be longer than the reach, the declaration it leads to is not further
        far = range(bisect_left(lines, c[3]), bisect_left(lines, c[3] + 1)) if c[3] is not None and c[3] > c[2] + REACH else ()
        tags = tags_of(c[5]) if near or far else set()
        for j in [*near, *far]:
            f = functions[j]
            if params[j] is None:
                params[j] = params_of(f[7])
            named = bool(f[6]) and re.search(rf"\b{re.escape(f[6])}\b", c[5]) is not None
            w = link_weight(tags, params[j], named, min(f[2] - c[2] - 1, REACH), c[3] == f[2])
            if w >= LEAST:
                edges[k, j] = w
    out = []
    for k, j in assign(edges).items():
        c, f = comments[k], functions[j]
        if f[8] or c[3] != f[2]:
            continue
        n = prose_words(c[5], f[6])
        out += [(f[4], f[0], f[2], "source", " ".join(prose(c[5])) if n else None, n, edges[k, j])] * copies[f[4]]
    return out


def _link(batches):
    """Files come one after the other, each whole; only one is held."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]
    names = [x.split()[0] for x in _PAIRED.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
    held: list[tuple] = []
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                out += _link_file(held)
                held = []
            held.append(row)
        if len(out) > 5_000:
            yield pack(out)
            out = []
    if held:
        out += _link_file(held)
    if out:
        yield pack(out)


def _judge(cols):
    out = {k: cols[k] for k in ("symbol_id", "file_id", "line")}
    words = [prose_words(d, n) for d, n in zip(cols["doc_comment"], cols["name"])]
    docs = [" ".join(prose(d)) if n else None for d, n in zip(cols["doc_comment"], words)]
    return out | {"origin": ["column"] * len(words), "description": docs, "words": words, "weight": [None] * len(words)}


def source_links(symbols: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """The links of the assignment, for functions without a doc_comment: symbol_id, file_id, line, origin (source), description, words, weight."""
    none = lambda t: F.lit(None).cast(t)
    style = F.when(F.col("language") == "python", "string").when(F.col("language") == "ruby", "hash").otherwise("slash")
    said = comment_candidates(sources).filter("file_id is not null").select("file_id", F.col("style").alias("what"), "line", "attached", none("long").alias("symbol_id"), "text", none("string").alias("name"), none("string").alias("signature"), F.lit(False).alias("documented"))
    spoken = files.filter("id is not null").select(F.col("id").alias("file_id"), F.lit("style").alias("what"), F.lit(-1).alias("line"), none("int").alias("attached"), none("long").alias("symbol_id"), style.alias("text"), none("string").alias("name"), none("string").alias("signature"), F.lit(False).alias("documented"))
    s = symbols.filter(F.col("kind").isin("function", "method") & F.col("line").isNotNull() & F.col("file_id").isNotNull() & F.col("id").isNotNull())
    declared = s.select("file_id", F.lit("function").alias("what"), "line", F.col("col").alias("attached"), F.col("id").alias("symbol_id"), none("string").alias("text"), "name", "signature", F.col("doc_comment").isNotNull().alias("documented"))
    return said.unionByName(spoken).unionByName(declared).repartition("file_id").sortWithinPartitions("file_id").mapInArrow(_link, _PAIRED)


def documented_functions(symbols: DataFrame, files: DataFrame, sources: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """symbol_id, file_id, line, origin (column or source), words, description of each function or method whose documentation says something."""
    stored = symbols.filter(F.col("kind").isin("function", "method") & F.col("doc_comment").isNotNull()).select(F.col("id").alias("symbol_id"), "file_id", "line", "doc_comment", "name")
    both = map_columns(stored, _judge, _PAIRED).unionByName(source_links(symbols, files, sources)).filter(F.col("words") >= min_words)
    return both.select("symbol_id", "file_id", "line", "origin", "words", "description")


def code_pairs(symbols: DataFrame, files: DataFrame, sources: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The pairs themselves: symbol_id, language, signature, code (lines of the function), description, words."""
    found = documented_functions(symbols, files, sources, min_words).select("symbol_id", "file_id", "words", "description")
    spans = symbols.select(F.col("id").alias("symbol_id"), "line", "end_line", "signature").dropDuplicates(["symbol_id"])
    code = F.array_join(F.slice(F.split("content", "\n"), F.col("line") + 1, F.greatest(F.lit(1), F.coalesce(F.col("end_line"), F.col("line")) - F.col("line") + 1)), "\n")
    kept = found.join(spans.filter("line >= 0"), "symbol_id").join(files.select(F.col("id").alias("file_id"), "language"), "file_id")
    return kept.join(sources.select("file_id", "content"), "file_id").select("symbol_id", "language", "signature", code.alias("code"), "description", "words")
