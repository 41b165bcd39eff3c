"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from skein.functions.batches import map_columns

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_loaded: dict[str, object] = {}


def tokenizer(path: str = TOKENIZER):
    """The tokenizer of a file, loaded once a process; it works on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def token_pieces(documents: DataFrame, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, tokens, start_char, end_char: texts of more than ``capacity`` tokens in as few pieces as possible, all others whole. Null texts have no row, empty ones a row of 0 tokens."""

    def run(cols):
        t = tokenizer(path)
        out = {k: [] for k in ("doc_id", "piece", "tokens", "start_char", "end_char")}
        for i, text in zip(cols["doc_id"], cols["text"]):
            enc = t.encode(text, add_special_tokens=False)
            n = len(enc)
            if n <= capacity:
                rows = [(i, 0, n, 0, len(text))]
            else:
                at = enc.offsets
                # a character of several tokens stays with the piece in which it begins
                starts = [0, *(at[k][0] for k in range(capacity, n, capacity)), len(text)]
                rows = [(i, p, min(capacity, n - p * capacity), starts[p], starts[p + 1]) for p in range(len(starts) - 1)]
            for row in rows:
                for k, v in zip(out, row):
                    out[k].append(v)
        return out

    return map_columns(documents.filter("text is not null").select("doc_id", "text"), run, "doc_id long, piece int, tokens int, start_char int, end_char int")


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``documents`` without its text, with ``tokens``. Null texts have no row."""

    def run(cols):
        t = tokenizer(path)
        texts = cols.pop("text")
        return cols | {"tokens": [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]}

    rest = [f for f in documents.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", tokens int"
    return map_columns(documents.filter("text is not null"), run, schema)
