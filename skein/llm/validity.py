"""Problem 5: source files that are not valid in their language.

The token stream of each file is run through memoised derivatives of its language's
grammar (see ``derivatives`` and ``grammars``). The memo is shared by all files that a
Python worker meets, so that soon nearly every step is one look-up. The token whose
derivative is empty is the failing one; a last derivative without the empty word means
that the text stops too early.

A text whose nesting exceeds the stack is not judged (valid is null, token is depth).

Results for odd input: null contents are empty files, and empty files and those of
comments only are valid; a null, unknown or style-sheet language is not judged (valid is
null); byte-order marks and all line ends are valid; repeated rows give one row each;
texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.llm.grammars import LEXERS, check

_DEPTH = 20_000  # of nested derivatives; a text that needs more is not judged


def _judge(cols):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEPTH))
    out = {"file_id": cols["file_id"], "project": cols["project"], "language": cols["language"], "valid": [], "fails_at": [], "token": []}
    for language, text in zip(cols["language"], cols["content"]):
        valid, at, token = None, None, None
        if language in LEXERS:
            try:
                found = check(text or "", language)
                valid = found is None
                if found:
                    at, token = found
            except RecursionError:
                token = "depth"
        out["valid"].append(valid)
        out["fails_at"].append(at)
        out["token"].append(token)
    return out


def check_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """file_id, project, language, valid, fails_at (index of the failing token), token (its kind; end if the text stops too early)."""
    f = files.select(F.col("id").alias("file_id"), "project", "language")
    read = f.join(sources.select("file_id", "content"), "file_id")
    return map_columns(read, _judge, "file_id long, project string, language string, valid boolean, fails_at int, token string")


def invalid_rates(checked: DataFrame) -> DataFrame:
    """project, language, files, invalid, rate over all judged files."""
    by = checked.filter("valid is not null").groupBy("project", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
    return by.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
