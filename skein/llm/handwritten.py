"""Problem 4: which source files are generated, minified, vendored or plain data.

``classify_files`` reads every text once and keeps a few small facts of it: what its
leading comment says, how it is laid out, and a fingerprint of its code. Merkle hashes
are then built bottom-up over the directory trees of all projects: the hash of a
directory is a commutative combination of its entries' hashes that adds up in parts, so
that no directory, however large, is ever gathered in one place. A subtree whose hash stands
in several projects is a copy from a common origin; everything below it is vendored.

Results for odd input: a null content is an empty file; empty files and files with less
than ``MIN_CODE`` characters of code are never recognised by their fingerprint alone, but
they do count as part of a shared subtree; a null path or project takes no part in the
trees; repeated rows give one row each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.operators.offsets import partitions_for
from skein.plans.session import cut_lineage

MIN_CODE = 120  # characters of code below which a fingerprint proves nothing
SHARED_PROJECTS = 2  # projects from which on a subtree counts as shared

_HASH_LANGS = frozenset(["python", "ruby"])
_LEAD = {
    True: re.compile(r"(?:\s*(?:#[^\n]*(?:\n|$)|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''))*"),
    False: re.compile(r"(?:\s*(?://[^\n]*(?:\n|$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))*"),
}
_COMMENT = {True: r"#[^\n]*|", False: r"//[^\n]*|/\*[\s\S]*?\*/|"}
_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_STRIP = {k: re.compile(v + _LITERAL) for k, v in _COMMENT.items()}

#: What tools write at the top of their output.
_MACHINE = re.compile(
    r"(?i)<auto-?generated|@generated\b|\bauto-?generated\b|\bcode (?:generated|made|produced|written) by\b|\bgenerated (?:by|from|with|using)\b"
    r"|\bdo not (?:edit|modify|change)\b|\bedits? will be (?:overwritten|lost)\b|\bautomatically (?:created|generated|produced|written)\b"
    r"|\bmachine[- ](?:written|generated|made)\b|\bmanual changes (?:are|will be) lost\b|\bproduced from \S+\.\w+|\bemitted by\b|\bregenerate instead\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|erstellt)\b|\bwurde von \S+ (?:erzeugt|generiert|erstellt)\b|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)\b"
    r"|\bg[ée]n[ée]r[ée] (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)\b|\bgenerado (?:por|automáticamente)\b|\bno (?:editar|modificar)\b"
)
_MACHINE_NAME = re.compile(r"(?i)(?:\.generated\.|\.gen\.|\.g\.|_generated\.|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:rb|js|d\.ts)$|\.pb\.|\.designer\.|_bindings\.|stub\.java$|\.freezed\.|\.snap\.)[a-z]*")
_MACHINE_DIR = re.compile(r"(?i)/(?:generated|autogen|auto-generated|gen|generated-sources|__generated__)/")
_SQUEEZED_NAME = re.compile(r"(?i)[.-](?:min|bundle|prod)\.(?:js|css|mjs)$")
_THIRD_DIR = re.compile(r"(?i)/(?:vendor|node_modules|bower_components|third[_-]party|3rd[_-]?party|deps|pods|external|site-packages|jspm_packages)/")
#: Statements of origin; a group names the owner.
_ORIGIN = [
    re.compile(p)
    for p in (
        r"(?i)\b(?:imported|copied|taken|vendored) (?:without change |unchanged |verbatim )?from (?P<o>[\w.@/-]+)",
        r"(?i)\bbundled from (?P<o>[\w./-]+)@",
        r"(?i)@license (?P<o>[\w.@/-]+)",
        r"(?i)\bthis file is part of (?:the )?(?P<o>[\w-]+)",
        r"(?i)copyright \(c\) (?P<o>[\w.-]+) project",
        r"(?i)\(c\) [\d, -]+(?:the )?(?P<o>[\w.-]+) contributors",
        r"(?m)^[\s/*#!]*(?P<o>[\w.-]+) - [^\n]*\n[\s/*#]*https?://[^\n]*\| ?\d+\.\d+",
        r"(?m)^[\s/*#]*!\s*(?P<o>[\w.-]+) v?\d+\.\d+(?:\.\d+)?",
    )
]
_MEMBER = re.compile(r"\b([A-Za-z_]\w*+)[ \t]*+\(")
_WORD = re.compile(r"[^\W\d]\w*")
_FLOW = re.compile(r"\b(?:if|for|foreach|while|return|switch|match|try|catch|throw|raise|yield|await|def|func|fn|function|lambda)\b|=>|^\s*(?:import|from|use|using|require|export\s*[*{])\b", re.M)
_NUMBER = re.compile(r"[-+]?\b(?:0[xX][\da-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)\w*")


def _ending(name: str) -> tuple[str, str]:
    """The last word of a name and the number behind it: ("Step", "12") of runStep_12."""
    word = name.rstrip("0123456789")
    number = name[len(word) :]
    if word.endswith("_"):
        word = word[:-1]
    k = len(word)
    while k and "a" <= word[k - 1] <= "z":
        k -= 1
    if k < len(word) and k and "A" <= word[k - 1] <= "Z":
        k -= 1
    return ("" if k == len(word) else word[k:]), number


def _numbered(code: str) -> bool:
    """Members whose names end with the same word and 0, 1, 2, 3 ... as they come."""
    next_of: dict[str, int] = {}
    for name in _MEMBER.findall(code):
        stem, number = _ending(name)
        if not stem or not number:
            continue
        want = next_of.get(stem, 0)
        number = number.lstrip("0") or "0"
        if number == str(want) or want == 0 and number == "1":
            next_of[stem] = int(number) + 1
    return any(n >= 4 for n in next_of.values())


def facts(path: str, project: str, language: str, content: str) -> tuple[str | None, str | None]:
    """(class of the file or None as far as it alone tells, fingerprint of its code or None)."""
    text = content[1:] if content.startswith("\ufeff") else content
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    hashes = language in _HASH_LANGS
    m = _LEAD[hashes].match(text)
    lead, code = text[: m.end()], text[m.end() :]
    print_ = None
    body = code.strip()
    if len(body) >= MIN_CODE:
        print_ = hashlib.sha256("\n".join(map(str.rstrip, body.split("\n"))).encode("utf-8", "surrogatepass")).hexdigest()
    if lead and _MACHINE.search(lead) or _MACHINE_NAME.search(path) or _MACHINE_DIR.search(path):
        return "generated", print_
    if body:
        bare = _STRIP[hashes].sub('""', body)
        if _literal_data(bare, body):
            return "data", print_
        lines = [x for x in bare.split("\n") if x.strip()]
        dense = len(bare) / max(1, len(lines))
        spaces = sum(map(bare.count, " \n\t")) / len(bare)
        if _SQUEEZED_NAME.search(path) or dense > 120 and spaces < 0.1 and len(bare) > 200:
            return "minified", print_
        if _numbered(bare):
            return "generated", print_
    own = re.sub(r"\W|_", "", project.lower())
    for rule in _ORIGIN if lead else ():
        for m in rule.finditer(lead):
            owner = re.sub(r"\W|_", "", m["o"].lower())
            if owner and owner not in own and own not in owner:
                return "vendored", print_
    if _THIRD_DIR.search(path):
        return "vendored", print_
    return None, print_


def _literal_data(bare: str, body: str) -> bool:
    """Literals and hardly anything else: by characters, or as a table of many records of few named fields."""
    if _FLOW.search(bare):
        return False
    literals = bare.count('""') + len(_NUMBER.findall(bare))
    rest = _NUMBER.sub("", bare.replace('""', ""))
    words = _WORD.findall(rest)
    if len(set(words)) > 24:
        return False
    said = len("".join(rest.split())) - rest.count(",")
    if len(body) >= 400 and said <= 0.12 * len(body) and len(words) <= 24:
        return True
    return literals >= 16 and (len(words) <= 0.2 * literals + 14 or len(set(words)) <= 12 and len(words) <= 2.2 * literals)


def _facts(cols: dict[str, list]) -> dict[str, list]:
    out = [facts(p or "", j or "", g or "", c or "") for p, j, g, c in zip(cols["path"], cols["project"], cols["language"], cols["content"])]
    return {"file_id": cols["file_id"], "project": cols["project"], "path": cols["path"], "alone": [a for a, _ in out], "print": [p for _, p in out]}


def file_facts(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a file: file_id, project, path, alone (its class as far as it alone tells), print (fingerprint of its code)."""
    f = files.select(F.col("id").alias("file_id"), "project", "path", "language")
    read = f.join(sources.select("file_id", "content"), "file_id")
    return map_columns(read, _facts, "file_id long, project string, path string, alone string, print string")


# -- trees ---------------------------------------------------------------------------
_SUM = 1 << 128
_NODES = "project string, node string, depth int, hash string, n long, told long, whole boolean"
_NODE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]


def _digest(kind: bytes, *parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join([kind, *parts]), digest_size=16).digest(), "big")


def _folder_hash(total: int, n: int) -> int:
    """The hash of a folder: of the sum of its entries' hashes, which are well mixed, so that the sum stands for the set in any order and in parts."""
    return _digest(b"folder", total.to_bytes(16, "big"), str(n).encode())


class _Walk:
    """Paths in order, folders closed as soon as they are left. Folders on the way to the first or the last path of a partition may go on in another one and are given in part."""

    def __init__(self):
        self.open: list[list] = []  # [name, sum, n, told, may have begun before]
        self.project: str | None = None
        self.first: list[str] | None = None
        self.out: list[tuple] = []

    def add(self, project: str, path: str, print_: str | None) -> None:
        parts = path.split("/")
        fresh = self.first is None
        if project != self.project:
            self.close(0, False)
            self.project = project
        k = 0
        while k < len(self.open) and k < len(parts) - 1 and self.open[k][0] == parts[k]:
            k += 1
        self.close(k, False)
        if fresh:
            self.first = parts
        for name in parts[k:-1]:
            self.open.append([name, 0, 0, 0, fresh])
        h = _digest(b"file", (print_ or "").encode())
        told = int(print_ is not None)
        self.out.append((project, path, len(parts), f"{h:032x}", 1, told, True))
        if self.open:
            self.give(h, 1, told)

    def give(self, h: int, n: int, told: int) -> None:
        top = self.open[-1]
        top[1], top[2], top[3] = (top[1] + h) % _SUM, top[2] + n, top[3] + told

    def close(self, depth: int, last: bool) -> None:
        """Closes the folders below a depth; at the end of a partition none of them is known to be whole."""
        while len(self.open) > depth:
            name, total, n, told, before = self.open[-1]
            node = "/".join(x[0] for x in self.open)
            at = len(self.open)
            self.open.pop()
            if before or last:
                self.out.append((self.project, node, at, f"{total:032x}", n, told, False))
            else:
                h = _folder_hash(total, n)
                self.out.append((self.project, node, at, f"{h:032x}", n, told, True))
                if self.open:
                    self.give(h, n, told)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _NODE_TYPES)], names=[x.split()[0] for x in _NODES.split(", ")])


def _walk(batches):
    walk = _Walk()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            walk.add(*row)
        if walk.out:
            yield _nodes(walk.out)
            walk.out = []
    walk.close(0, True)
    if walk.out:
        yield _nodes(walk.out)


def _finish(batches):
    """Puts the parts of folders together, deepest first: what each part holds beside the folders that are in parts themselves."""
    parts: dict[tuple[str, str, int], list] = {}
    for batch in batches:
        for project, node, depth, total, n, told, _ in zip(*(c.to_pylist() for c in batch.columns)):
            have = parts.setdefault((project, node, depth), [0, 0, 0])
            have[0], have[1], have[2] = (have[0] + int(total, 16)) % _SUM, have[1] + n, have[2] + told
    out = []
    for project, node, depth in sorted(parts, key=lambda x: -x[2]):
        total, n, told = parts[project, node, depth]
        h = _folder_hash(total, n)
        out.append((project, node, depth, f"{h:032x}", n, told, True))
        up = parts.get((project, node.rpartition("/")[0], depth - 1))
        if up is not None:
            up[0], up[1], up[2] = (up[0] + h) % _SUM, up[1] + n, up[2] + told
    if out:
        yield _nodes(out)


def merkle_nodes(facts_: DataFrame, partitions: int | None = None) -> DataFrame:
    """The nodes of all trees, files and folders: project, node (path), depth, hash, n (files below), told (files below with a fingerprint).

    Paths are laid out in order, so that a folder is a run of them; one pass hashes each
    folder when it is left, bottom-up. Folders that lie across partitions, at most two
    for each level of each partition, are put together in one small task."""
    paths = facts_.filter("path is not null and project is not null").select("project", "path", "print")
    n = partitions or partitions_for(facts_.count(), int(facts_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    walked = cut_lineage(paths.repartitionByRange(n, "project", "path").sortWithinPartitions("project", "path").mapInArrow(_walk, _NODES))
    split = walked.filter("not whole").repartition(1).mapInArrow(_finish, _NODES)
    return walked.filter("whole").unionByName(split).drop("whole")


def classify_files(files: DataFrame, sources: DataFrame, shared_projects: int = SHARED_PROJECTS) -> DataFrame:
    """One row a file: file_id, project, path, class (generated, minified, data, vendored; null if hand-written), shared (projects that hold the largest shared subtree over it, or null)."""
    told = cut_lineage(file_facts(files, sources))
    # a subtree must hold some recognisable code; whole projects are not each other's copies
    nodes = merkle_nodes(told).filter((F.col("told") > 0) & (F.col("depth") > 1))
    hashes = nodes.groupBy("hash", "n", "project").agg(F.count("*").alias("k")).groupBy("hash", "n").agg(F.count("*").alias("projects")).filter(F.col("projects") >= shared_projects)
    shared = nodes.join(hashes, ["hash", "n"]).groupBy("project", "node").agg(F.max("projects").alias("projects"))
    ups = told.select("file_id", "project", F.explode(F.expr("transform(sequence(2, greatest(2, size(split(path, '/')))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("node"))
    above = ups.join(shared, ["project", "node"]).groupBy("file_id").agg(F.max("projects").alias("shared"))
    kind = F.when(F.col("alone").isin("generated", "minified", "data"), F.col("alone")).when(F.col("shared").isNotNull() | F.col("alone").isNotNull(), F.lit("vendored"))
    return told.join(above, "file_id", "left").select("file_id", "project", "path", kind.alias("class"), "shared")
