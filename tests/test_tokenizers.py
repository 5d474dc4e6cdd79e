import random

from trailmill.functions.tokenizers import RankFile, rank_file

PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_cut_out_runs_change_nothing():
    t, rng = RankFile(PATH, long_run=2), random.Random(0)
    signs = [" ", "  ", "\n", "\t", "a", "B", ".", "é", "字", "　", "\xa0", "\r\n", "'s", "9", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert t.encode_ordinary(text) == t.plain.encode_ordinary(text)


def test_very_long_runs():
    encode = rank_file(PATH).encode_ordinary
    for text in (" " * 1_000_000, "\n" * 1_000_000 + "x", "x" * 1_000_000, "x " + " \n" * 400_000 + "y"):
        assert rank_file(PATH).plain.decode(encode(text)) == text
