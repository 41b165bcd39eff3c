"""Problem 2: splitting oversized items at natural boundaries.

Balanced targets: the smallest number of pieces that can hold a text is computed, equal
targets are placed, and each is moved to the strongest boundary near it: the end of a
top-level block, an empty line, the end of a line that closes a block, any line end, the
end of a statement, a space. If a piece cannot keep the limit, one more piece is made.
Consecutive pieces overlap by exactly ``OVERLAP`` tokens; a token is 4 characters and a
rest counts as one, so a piece of at most 2,048 characters keeps 512 tokens.

Results for odd input: null and empty contents and those within the limit are one piece
(or none if null); texts without any boundary are cut evenly; a null start_line counts
from 0; repeated rows are split each; texts of any length are read whole; a chunk of
tables with other columns keeps only the columns named.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import map_columns

TOKEN = 4
LIMIT = 512
OVERLAP = 32

_STRONG = re.compile(r"\n(?:[ \t\r]*\n)+|\n|[;,})\]][ \t]*|[ \t]+")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets after which a piece may begin, with their strength."""
    at, strength = [], []
    for m in _STRONG.finditer(text):
        e, s = m.end(), m[0]
        if s[0] == "\n":
            nxt = text[e : e + 1]
            if s.count("\n") > 1:
                g = 5.0 if nxt and not nxt.isspace() else 4.0
            else:
                line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
                g = 3.5 if line[-1:] in ("}", "]", ")") and len(line) < 4 or line in ("end", "end;", "});", "};") else 3.0
                g += 0.5 if nxt and not nxt.isspace() else 0.0
            g -= 0.02 * min(20, _indent(text, e))
        else:
            g = 1.5 if s[0] in ";,})]" else 1.0
        at.append(e)
        strength.append(g)
    return np.array(at, dtype=np.int64), np.array(strength)


def _indent(text: str, at: int) -> int:
    n = at
    while n < len(text) and text[n] in " \t" and n - at < 40:
        n += 1
    return n - at


def cuts(text: str, limit: int = LIMIT * TOKEN, overlap: int = OVERLAP * TOKEN) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most ``limit`` characters, each starting ``overlap`` before the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    room = limit - overlap
    at, strength = boundaries(text)
    least = -(-(n - overlap) // room)
    for pieces in (least, least + 1, least + 2):
        got = _place(n, pieces, limit, overlap, at, strength)
        if got is not None:
            return got
    return _place(n, least, limit, overlap, at[:0], strength[:0])  # even cuts always keep the limit


def _place(n, pieces, limit, overlap, at, strength):
    """Ends of pieces near equal targets, or None where a limit cannot be kept."""
    step = (n - overlap) / pieces
    out, start = [], 0
    for k in range(1, pieces):
        target = overlap + k * step
        # what comes after must still fit, and this piece must bring something new
        low = max(start + overlap + 1, n - (pieces - k) * (limit - overlap))
        high = min(start + limit, n - 1)
        if low > high:
            return None
        slack = max(16.0, min(0.35 * step, 0.9 * (limit - overlap - step) + 0.1 * step))
        a, b = np.searchsorted(at, [max(low, target - slack), min(high, target + slack) + 1e-9], side="left")
        if b > a:
            score = strength[a:b] - 2.0 * np.abs(at[a:b] - target) / slack
            end = int(at[a + int(np.argmax(score))])
        else:
            end = int(min(max(round(target), low), high))
        out.append((start, end))
        start = end - overlap
    if n - start > limit:
        return None
    out.append((start, n))
    return out


def _split(cols):
    out = {k: [] for k in ("chunk_id", "file_id", "piece", "pieces", "start_line", "end_line", "tokens", "content")}
    for i, f, text, first in zip(cols["id"], cols["file_id"], cols["content"], cols["start_line"]):
        parts = cuts(text)
        line, seen = first or 0, 0
        for k, (a, b) in enumerate(parts):
            line += text.count("\n", seen, a)
            seen = a
            piece = text[a:b]
            last = line + piece.count("\n") - (1 if piece.endswith("\n") and len(piece) > 1 else 0)
            for name, v in zip(out, (i, f, k, len(parts), line, last, -(-len(piece) // TOKEN), piece)):
                out[name].append(v)
    return out


_PIECES = "chunk_id long, file_id long, piece int, pieces int, start_line int, end_line int, tokens int, content string"


def split_oversized(chunks: DataFrame) -> DataFrame:
    """The pieces of the chunks over the limit only. Chunks within it never leave the JVM."""
    over = chunks.filter(F.length("content") > LIMIT * TOKEN).select("id", "file_id", "content", "start_line")
    return map_columns(over, _split, _PIECES)


def split_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks as pieces: those within the limit as they are."""
    fits = chunks.filter(F.length("content") <= LIMIT * TOKEN)
    whole = fits.select(F.col("id").alias("chunk_id"), "file_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "start_line", "end_line", F.ceil(F.length("content") / TOKEN).cast("int").alias("tokens"), "content")
    return whole.unionByName(split_oversized(chunks))
