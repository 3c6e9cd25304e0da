"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Only if the tokenizer refuses a whole text it is cut into stretches of about this many characters, before the last line end
#: above a letter, where no token goes across; a stretch without such a place is cut at its last blank, or where it ends.
STRETCH = 100_000


@lru_cache(maxsize=4)
def load(path: str, pattern: str | None = None):  # noqa: ANN201
    """The byte-level BPE of a rank file; a bare file name is looked for among the installed public tokenizers."""
    import tiktoken

    if "/" not in path or pattern is None:
        import public_tokenizers

        path = path if "/" in path else public_tokenizers.path(path)
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, encoding) -> int:  # noqa: ANN001
    """Tokens of one text; null and empty texts have none."""
    if not text:
        return 0
    try:
        return len(encoding.encode_ordinary(text))
    except BaseException as refused:  # the library's panics are no Exceptions
        if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return sum(len(encoding.encode_ordinary(s)) for s in stretches(text))


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """text in pieces of at most `size` characters."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        place = next((i for i in range(end, at, -1) if text[i] == "\n" and not text[i + 1 : i + 2].isspace()), 0)
        place = place or next((i for i in range(end, at, -1) if text[i] == " " and not text[i - 1].isspace()), end)
        out.append(text[at:place])
        at = place
    return [*out, text[at:]]


def n_tokens(column: str, path: str = TOKENIZER, pattern: str | None = None) -> Column:
    """A column's sizes in tokens (long, never null)."""

    @F.pandas_udf(T.LongType())
    def sizes(texts: pd.Series) -> pd.Series:
        encoding = load(path, pattern)
        return texts.map(lambda t: count(t, encoding)).astype("int64")

    return sizes(F.col(column))


def sized(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """documents (..., text) to keep's columns and `n_tokens`."""
    return documents.select(*keep, n_tokens("text", path).alias("n_tokens"))
