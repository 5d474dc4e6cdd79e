"""Exact token counts under a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.tokenizers import VOCABULARY as VOCABULARY, rank_file as encoder
from ..session import map_arrow, spread

#: Places where a text can be cut without changing its tokens: the pattern never joins a character that is no white
#: space with white space after it, and never looks back.
SAFE_CUT = re.compile(r"(?<=\S)(?=\n)|(?<=[.:;!?。！？])(?=[ \t])")


def count_column(df: DataFrame, text: str, path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """`df` without `text`, with the number of its tokens; 0 for null and ''."""
    place = df.columns.index(text)
    kept = [f for f in df.schema.fields if f.name != text]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(place).to_pylist()]
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64())], names=[*(f.name for f in kept), name])

    return map_arrow(spread(df, kept[0].name) if kept else df, count, f"{types}, `{name}` bigint")
