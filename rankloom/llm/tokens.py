"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file; a parameter of every operator that counts tokens.  Ranks, one token for each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published pattern that cuts texts before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file, once for each Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., key, tokens): the number of tokens of each whole text; null and empty texts have none."""
    names = [*keep, key]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(x)) if x else 0 for x in batch[len(names)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[i] for i in range(len(names))), pa.array(counts, pa.int64())], [*names, "tokens"])

    return df.select(*names, text).filter(F.col(key).isNotNull()).mapInArrow(run, schema)
