"""Token budget per source, language and domain (problem 3).

Every string of a row's messages (contents and call arguments) is a piece. Each task builds prefix tries of its own rows:
the distinct pieces of a batch are put in order, so that those with a common beginning follow each other, and walked;
the nodes on the path to the last piece carry the exact state of the tokenizer there (tokens so far, whether anything but
white space came), so a shared beginning is tokenized once, and what a task has met before is remembered by segment.
Nodes lie only at places where the text can be cut without changing its tokens. The counts at the terminals are joined
to the rows by position within the batch. So no text is shuffled, and a frequent piece (a system prompt) is one terminal
of each batch, however many rows use it; it costs a task one walk, not a shuffle to one place.

Defined cases: rows without an id are left out; null messages, null and empty strings have no tokens; a row without
instance, language, source or domain counts under 'unknown'; an instance delivered with different languages counts under
'unclear'; repeated rows are rows; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.instance_ids import issue_suffix, repo_name, unified_id
from ..session import map_arrow, spread
from .splits import names_of
from .texts import strings
from .tokens import SAFE_CUT, VOCABULARY, encoder

#: Segments whose counts a task remembers apart from the path.
MEMO = 100_000


class Trie:
    """Token counts of pieces that come in order. States: (tokens so far, whether anything but white space came)."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self.path: list[str] = []
        self.states: list[tuple[int, bool]] = [(0, False)]  # states[i]: after the first i segments of the last piece
        self.memo: dict[str, tuple[int, bool]] = {}

    def count(self, piece: str) -> tuple[int, bool]:
        segments, states, memo = SAFE_CUT.split(piece), self.states, self.memo
        shared = 0
        for a, b in zip(segments, self.path):
            if a != b:
                break
            shared += 1
        del states[shared + 1 :]
        total, some = states[-1]
        for s in segments[shared:]:
            own = memo.get(s)
            if own is None:
                if len(memo) >= MEMO:
                    memo.clear()
                own = memo[s] = len(self.encode(s)), not (not s or s.isspace())
            total += own[0]
            some |= own[1]
            states.append((total, some))
        self.path = segments
        return total, some


def _sums(texts: pa.ListArray, of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sum, any) for each row over its texts; `of` gives both for every distinct text."""
    flat = texts.flatten()
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    tokens, solid = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    if len(flat):
        coded = flat.dictionary_encode()
        counts, some = of(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(tokens, row, counts[at])
        np.logical_or.at(solid, row, some[at])
    return tokens, solid


def _count(kept: list[str], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(encoder(path).encode_ordinary)

        def walk(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            order = pc.array_sort_indices(pieces)
            counts, some = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
            for at, piece in zip(order.to_pylist(), pieces.take(order).to_pylist()):
                counts[at], some[at] = trie.count(piece)
            return counts, some

        for batch in batches:
            tokens, solid = _sums(batch.column(len(kept)), walk)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(tokens), pa.array(solid)], names=[*kept, "n_tokens", "usable"])

    return run


def row_tokens(rows: DataFrame, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """(row_id, columns to keep, n_tokens, usable): one row for each of `rows` with an id."""
    kept = ["row_id", *keep]
    texts = rows.where("row_id IS NOT NULL").select(*kept, strings(F.col("messages")).alias("_texts"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return map_arrow(spread(texts, "row_id"), _count(kept, path), f"{types}, n_tokens bigint, usable boolean")


def plain_tokens(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(row_id, n_tokens) by encoding every string by itself, for proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            counts = [sum(len(encode(t)) for t in texts) for texts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["row_id", "n_tokens"])

    texts = rows.where("row_id IS NOT NULL").select(F.col("row_id").cast("long").alias("row_id"), strings(F.col("messages")).alias("_texts"))
    return map_arrow(texts, run, "row_id bigint, n_tokens bigint")


def source_name(source: Column) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "[- ]", "_")
    return F.when(s.isNull() | s.isin("", "unknown", "none", "null", "n/a"), "unknown").otherwise(s)


def _instance_key(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `issue` (the instance under its repo's present name) and `repo`; both null where the id names none."""
    parsed = rows.withColumns({"name": repo_name(F.col("instance_id")), "suffix": issue_suffix(F.col("instance_id")), "plain": unified_id(F.col("instance_id"))})
    joined = parsed.join(names, "name", "left")
    return joined.withColumn("issue", F.coalesce(F.concat(F.lower("repo"), "suffix"), "plain")).drop("name", "suffix", "plain")


def labels(rows: DataFrame, instances: DataFrame, repos: DataFrame) -> DataFrame:
    """`rows` (row_id, instance_id, source, ...) with `source`, `lang` and `domain` brought to what they count under."""
    names = names_of(repos)
    langs = (
        _instance_key(instances.select("instance_id", "issue_lang"), names)
        .where("issue IS NOT NULL")
        .groupBy("issue")
        .agg(F.min("issue_lang").alias("lang"), F.max("issue_lang").alias("other"))
        .select("issue", F.when(F.col("lang") != F.col("other"), "unclear").otherwise(F.col("lang")).alias("lang"))
    )
    domains = repos.where("repo IS NOT NULL").groupBy("repo").agg(F.min("domain").alias("domain"))
    others = [c for c in rows.columns if c not in ("row_id", "instance_id", "source")]
    return (
        _instance_key(rows, names)
        .withColumn("issue", F.coalesce("issue", F.concat(F.lit("row:"), F.col("row_id").cast("string"))))
        .join(langs, "issue", "left")
        .join(domains, "repo", "left")
        .select("row_id", source_name(F.col("source")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"), *others)
    )


def row_budget(rows: DataFrame, instances: DataFrame, repos: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(row_id, source, lang, domain, n_tokens, usable): one row for each of `rows`."""
    return labels(row_tokens(rows, "instance_id", "source", path=path), instances, repos)


def budget(per_row: DataFrame) -> DataFrame:
    """(source, lang, domain, rows, usable_rows, tokens); every row counts once."""
    return per_row.groupBy("source", "lang", "domain").agg(F.count("*").alias("rows"), F.count_if("usable").alias("usable_rows"), F.sum("n_tokens").alias("tokens"))
