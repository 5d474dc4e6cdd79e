"""Splitting oversized items at natural boundaries (problem 4).

A row's text is all `content` and `function.arguments` of its messages, one after the other. Rows above the limit are
cut by a hierarchy of separators: message, section, paragraph, line, sentence, word, character. Pieces are packed
greedily, in order: each takes what the limit allows and is then closed at the boundary of the best level in its last
half; where that half has none above a word, at the one of the best level anywhere in the piece; only a piece without
any such boundary ends at a word, and one without white space or a separator at a character. Each piece but the first
begins with the last `overlap` characters of the piece before (with all of it, if it is shorter); they count towards the
limit.

Defined cases: rows at or below the limit, null and empty messages give no piece; the concatenation of the new parts is
the row's text; repeated rows are split each; further columns are ignored. A row is handled as one value, so it must
fit into a task's memory.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import map_arrow
from .texts import n_chars, strings

LEVELS = ("message", "section", "paragraph", "line", "sentence", "word", "character")
#: A boundary is where a match ends; a section ends before its successor's heading.
_SEPARATORS = {
    "section": re.compile(r"\n(?=#{1,6}[ \t]+\S|[^\n]{1,200}\n(?:={3,}+|-{3,}+)[ \t]*(?:\n|\Z))"),
    "paragraph": re.compile(r"\n[ \t]*\n\s*"),
    "line": re.compile(r"\r\n|\n|\r"),
    "sentence": re.compile(r"(?<![.!?…])[.!?…]++[\"')\]]*+\s++|(?<![。！？])[。！？]++[」』”’）]*+\s*+"),
}
_WORD = re.compile(r"\s+|[,;}\])](?=\S)")


@dataclass(frozen=True)
class Limits:
    size: int
    overlap: int

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be at least 0 and below the limit")


def limits(size_limits: DataFrame, name: str = "trajectory_piece") -> Limits:
    """The limit of that name; a table of a few rows."""
    row = size_limits.where(F.col("limit_name") == name).select("max_size", "overlap_size").first()
    if row is None:
        raise ValueError(f"no limit named {name}")
    return Limits(row.max_size, row.overlap_size or 0)


class Boundaries:
    """The natural boundaries of a text by level, found when first asked for."""

    def __init__(self, text: str, starts: list[int]):
        self.text, self.found = text, {"message": starts}

    def last(self, level: str, low: int, high: int) -> int | None:
        """The last boundary of a level with low < position <= high."""
        if level not in self.found:
            self.found[level] = [m.end() for m in _SEPARATORS[level].finditer(self.text)]
        at = bisect_right(self.found[level], high)
        return x if at and (x := self.found[level][at - 1]) > low else None

    def best(self, low: int, high: int) -> tuple[int, str]:
        """Where to end a piece whose new part begins at `low` and that may reach to `high`."""
        for least in (low + (high - low) // 2, low):
            for level in LEVELS[:5]:
                if (x := self.last(level, least, high)) is not None:
                    return x, level
        word = None
        for m in _WORD.finditer(self.text, low, high):
            if m.end() > low:
                word = m.end()
        if word is not None:
            return word, "word"
        return high, "character"


def pieces(texts: list[str], size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(from, new from, to, kind of boundary at the end) of each piece of the joined texts, in order."""
    text = "".join(texts)
    starts, at = [], 0
    for t in texts:
        if t:
            starts.append(at)
        at += len(t)
    cuts = Boundaries(text, starts[1:])
    out: list[tuple[int, int, int, str]] = []
    begin = new = 0
    while len(text) - begin > size:
        stop, kind = cuts.best(new, begin + size)
        out.append((begin, new, stop, kind))
        begin, new = max(begin, stop - overlap), stop
    if len(text) > new:
        out.append((begin, new, len(text), "end"))
    return out


_SCHEMA = pa.schema(
    [("row_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("char_from", pa.int64()), ("new_from", pa.int64()),
     ("char_to", pa.int64()), ("ends_at", pa.string()), ("text", pa.string())]
)
#: Characters of pieces that one batch of results has, about.
BATCH_CHARS = 4_000_000


def split_rows(rows: DataFrame, size_limits: DataFrame, name: str = "trajectory_piece") -> DataFrame:
    """(row_id, piece_no, n_pieces, char_from, new_from, char_to, ends_at, text), piece_no from 0, of rows above the limit."""
    bound = limits(size_limits, name)
    size, overlap = bound.size, bound.overlap
    large = rows.select("row_id", "messages").where(n_chars(F.col("messages")) > size).select(F.col("row_id").cast("long").alias("row_id"), strings(F.col("messages")).alias("texts"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _SCHEMA]
            held = 0
            for row_id, texts in zip(batch.column(0), batch.column(1)):
                texts = texts.as_py()
                whole, found = "".join(texts), pieces(texts, size, overlap)
                for i, (a, new, b, kind) in enumerate(found):
                    for column, value in zip(columns, (row_id.as_py(), i, len(found), a, new, b, kind, whole[a:b])):
                        column.append(value)
                held += len(whole)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
                    columns, held = [[] for _ in _SCHEMA], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return map_arrow(large, split, "row_id bigint, piece_no int, n_pieces int, char_from bigint, new_from bigint, char_to bigint, ends_at string, text string")


def rows_cut(split: DataFrame, size_limits: DataFrame, name: str = "trajectory_piece") -> DataFrame:
    """(row_id, n_chars): rows whose pieces have, without what they repeat, more characters than one piece may have."""
    whole = split.groupBy("row_id").agg(F.sum(F.col("char_to") - F.col("new_from")).alias("n_chars"))
    return whole.where(F.col("n_chars") > limits(size_limits, name).size)


def rebuilt(split: DataFrame, size_limits: DataFrame, name: str = "trajectory_piece") -> DataFrame:
    """(row_id, n_chars, digest, fits, repeats): the text that the new parts make up, whether no piece is above the
    limit, and whether every piece begins with the overlap of the one before (or all of it)."""
    bound = limits(size_limits, name)
    new = F.substr("text", (F.col("new_from") - F.col("char_from") + 1).cast("int"))
    one = split.select(
        "row_id", F.struct("piece_no", "char_from", "new_from", "char_to", new.alias("new"), "text").alias("p"), (F.length("text") <= bound.size).alias("fits"),
    )
    per = one.groupBy("row_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.bool_and("fits").alias("fits"))
    least = lambda a: F.least(F.lit(bound.overlap), a["char_to"] - a["char_from"])
    agrees = lambda a, b: (b["new_from"] == a["char_to"]) & (b["new_from"] - b["char_from"] >= least(a)) & a["text"].endswith(F.substr(b["text"], F.lit(1), (b["new_from"] - b["char_from"]).cast("int")))
    pairs = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), agrees)
    text = F.array_join(F.transform("p", lambda x: x["new"]), "")
    return per.select("row_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"), "fits", F.forall(pairs, lambda x: x).alias("repeats"))
