"""Token counts of whole texts by a two-tier map-side lookup.

The driver encodes the most frequent pre-tokens of a bounded sample of texts
and broadcasts their lengths as a compact table. Each Python worker answers
most pre-tokens from it, and the others from a bounded cache that it fills by
running the tokenizer once a pre-token. No pre-token is ever shuffled, and the
sample decides only how fast the counts come, never what they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenized, Remembered, pack_table, unpack_table
from .common import read_table

#: Bounds of the sample that the table of frequent pre-tokens comes from, and of the table.
SAMPLE_DOCS, SAMPLE_CHARS, TABLE_SIZE = 512, 20_000, 32_768

_counters: dict = {}


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> tuple[bytes, bytes, bytes]:
    """Lengths of the most frequent pre-tokens in at most SAMPLE_DOCS texts of at most SAMPLE_CHARS characters."""
    bpe = PreTokenized(tokenizer) if tokenizer.endswith(".json") else None
    if bpe is None or not bpe.known:
        return pack_table({})
    rows = docs.select(F.col(text_col).alias("t")).where(F.length("t") <= SAMPLE_CHARS).limit(SAMPLE_DOCS).collect()
    seen = Counter(p for r in rows for p in _keys(bpe, r.t)[1] if len(p) <= 64)
    return pack_table({p: len(bpe.piece_ids(p)) for p, _ in seen.most_common(TABLE_SIZE)})


def _keys(bpe: PreTokenized, text: str) -> tuple[str, list[str]]:
    """A text as its first word and the others, each with the space before it; or as pre-tokens."""
    words = None if bpe.fold else bpe.words(text)
    if words is None:
        return "", bpe.pieces(text)
    return words[0], [" " + w for w in words[1:]]


def _counter(tokenizer: str, table: tuple[bytes, bytes, bytes]):
    """text -> number of tokens, kept for the worker's later tasks."""
    key = (tokenizer, hash(table))
    if key not in _counters:
        _counters.clear()
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            _counters[key] = lambda text: len(model.encode(text))
        elif not (bpe := PreTokenized(tokenizer)).known:
            _counters[key] = lambda text: len(bpe.ids(text))
        else:
            frequent = unpack_table(table)
            pieces = Remembered(lambda p: len(bpe.piece_ids(p)), most=100_000)
            # keyed without the space that all of them follow
            spaced = Remembered(lambda w: len(bpe.piece_ids(" " + w)), {p[1:]: n for p, n in frequent.items() if p[0] == " "})

            def count(text: str) -> int:
                words = bpe.words(text) if not bpe.fold else None
                if words is None:
                    return sum(map(pieces.__getitem__, bpe.pieces(text)))
                return pieces[words[0]] + sum(map(spaced.__getitem__, words[1:]))

            _counters[key] = count
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null ids
    are counted each for itself; other columns are ignored; no rows give no rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_col))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = _counter(tokenizer, table.value)
        for batch in texts:
            yield pd.Series([n(t) if t else 0 for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
