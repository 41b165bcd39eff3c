"""Reader of SCIP index files (protocol buffers), as a distributed scan of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.functions.batches import map_columns


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def fields(b: bytes):
    """(number, value) of a message's fields; values are numbers or bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def _numbers(v) -> list[int]:
    if isinstance(v, int):
        return [v]
    out, i = [], 0
    while i < len(v):
        n, i = _varint(v, i)
        out.append(n)
    return out


def document_path(path: str, roots: tuple[str, ...] = ()) -> str:
    """The path of a document as files have it: no scheme, forward slashes, relative to the first root that it lies under."""
    p = path.removeprefix("file:///").replace("\\", "/")
    for root in roots:
        r = root.removeprefix("file:///").replace("\\", "/").rstrip("/") + "/"
        if len(r) > 1 and p.startswith(r):
            p = p[len(r) :]
            break
    short = p.lstrip("/")
    while short.startswith("./"):
        short = short[2:]
    return short or p.lstrip("/")


def occurrences_of(index: bytes, roots: tuple[str, ...] = ()):
    """(path, line, symbol, definition) of an index: documents are field 2, their path 1 and occurrences 2; of these the range is 1, the symbol 2, the roles 3."""
    for n, doc in fields(index):
        if n != 2:
            continue
        path, occ = "", []
        for k, v in fields(doc):
            if k == 1:
                path = v.decode()
            elif k == 2:
                occ.append(v)
        for o in occ:
            span, symbol, roles = [], "", 0
            for k, v in fields(o):
                if k == 1:
                    span += _numbers(v)
                elif k == 2:
                    symbol = v.decode()
                elif k == 3:
                    roles = v
            if span and symbol and not symbol.startswith("local "):
                yield document_path(path, roots), span[0], symbol, bool(roles & 1)


def read_scip(spark: SparkSession, path: str, roots: tuple[str, ...] = ()) -> DataFrame:
    """path (below the first of ``roots`` that holds it), line, symbol, definition of all index files under a path."""

    def run(cols):
        out: dict[str, list] = {k: [] for k in ("path", "line", "symbol", "definition")}
        for b in cols["content"]:
            for row in occurrences_of(b, roots):
                for k, v in zip(out, row):
                    out[k].append(v)
        return out

    return map_columns(spark.read.format("binaryFile").load(path).select("content"), run, "path string, line int, symbol string, definition boolean")
