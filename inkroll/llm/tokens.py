"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded piece by piece, to keep memory linear.
CHUNK = 100_000
# Fixed value: after a letter and before a blank and a letter the pattern always ends a piece, so a cut there changes no token.
_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")
_loaded: dict[str, object] = {}


def tokenizer(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per Python worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def token_count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; null and empty texts have none."""
    if not text:
        return 0
    encoder, total, at = tokenizer(vocabulary), 0, 0
    while at < len(text):
        cut = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        end = cut.start() if cut else len(text)
        total += len(encoder.encode_ordinary(text[at:end]))
        at = end
    return total


def with_copies(df: DataFrame, key: str) -> DataFrame:
    """Add ``_copy``: 0 where a key occurs once, else a number of the row, by which the rows of a hot key are spread.

    One shuffle of what is given, so it should hold ids and sizes only; keys are counted before it.
    """
    many = df.groupBy(F.col(key).alias("_many")).agg(F.count("*").alias("_n")).where("_n > 1").select("_many", F.lit(True).alias("_is"))
    return df.join(many, F.col(key).eqNullSafe(F.col("_many")), "left").withColumn("_copy", F.when(F.col("_is"), F.monotonically_increasing_id()).otherwise(F.lit(0))).drop("_many", "_is")


def with_tokens(df: DataFrame, text: str, into: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace ``text`` by its size in tokens; all other columns and all rows are kept. No shuffle."""
    keep = [c for c in df.columns if c not in (text, into)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([token_count(x, vocabulary) for x in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), sizes], names=[*keep, into])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{into}` bigint"]))
