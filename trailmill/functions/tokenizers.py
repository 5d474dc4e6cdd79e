"""Tokenizers for Python workers: anything that maps a text to a list of ids."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

Tokenizer = Callable[[str], list[int]]
#: The rank file that is used where no path is given; TRAILMILL_VOCABULARY names another.
VOCABULARY = os.environ.get("TRAILMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
_LOADED: dict[str, RankFile] = {}

#: White space as the pattern of the vocabulary has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class RankFile:
    """The byte-level BPE of a rank file.

    The library's pattern engine gives up on very long runs of white space. They are therefore cut out where the pattern
    itself ends a piece: before the run, and before its last character if something follows.
    """

    def __init__(self, path: str, long_run: int = 10_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_run, self.runs = long_run, re.compile(f"[{_SPACE}]{{{long_run},}}")

    def encode_ordinary(self, text: str) -> list[int]:
        encode = self.plain.encode_ordinary
        if len(text) < self.long_run or not self.runs.search(text):
            return encode(text)
        out, at = [], 0
        for m in self.runs.finditer(text):
            start, stop = m.start(), m.end() - (m.end() < len(text))
            out += encode(text[at:start])
            out += self.plain._encode_single_piece(text[start:stop])
            at = stop
        return out + encode(text[at:])


def rank_file(path: str) -> RankFile:
    """The tokenizer of a rank file; loaded once per worker."""
    if path not in _LOADED:
        _LOADED[path] = RankFile(path)
    return _LOADED[path]
