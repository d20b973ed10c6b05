"""Token lengths of documents by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from leadloom.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Whole texts' token counts; null and empty count 0."""
    t = _tokenizer(path)
    return [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


def token_lengths(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), one row a document; repeated rows count once, rows without doc_id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "n_tokens": count_tokens(list(b.text), path)})

    rows = documents.select("doc_id", "source", "text").filter("doc_id is not null")
    return spread(rows).mapInPandas(run, "doc_id bigint, source string, n_tokens bigint").distinct()
