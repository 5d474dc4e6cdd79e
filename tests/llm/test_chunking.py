import hashlib
import random

import pytest
from conftest import MESSAGES, msg

from trailmill.llm import chunking as K


def check(texts, size, overlap):
    whole, got = "".join(texts), K.pieces(texts, size, overlap)
    at = 0
    for i, (begin, new, end, _) in enumerate(got):
        assert new == at and begin <= new < end and end - begin <= size
        assert begin == (max(got[i - 1][0], new - overlap) if i else 0)
        at = end
    assert at == len(whole)
    return got


def test_random_texts():
    rng = random.Random(4)
    parts = ["word ", "x", "\n", "\r\n", "\n## T\n", "\n\n", ". ", "。", "long" * 8, " ", "é", "🙂", ",", "!"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(1, 6))]
        check(texts, rng.choice([20, 50, 120]), rng.choice([0, 5, 19]))


def test_boundaries_in_order_of_rank():
    assert [p[3] for p in check(["a" * 30, "b" * 30], 40, 5)] == ["message", "end"]
    assert [p[3] for p in check(["a" * 20 + "\n\n" + "b" * 20], 30, 5)] == ["paragraph", "end"]
    assert [p[3] for p in check(["a" * 20 + "\n" + "b" * 20], 30, 5)] == ["line", "end"]
    assert [p[3] for p in check(["a" * 20 + ". " + "b" * 20], 30, 5)] == ["sentence", "end"]
    assert [p[3] for p in check(["文" * 20 + "。" + "字" * 20], 30, 5)] == ["sentence", "end"]
    assert [p[3] for p in check(["a" * 20 + " " + "b" * 20], 30, 5)] == ["word", "end"]
    assert [p[3] for p in check(["a" * 60], 30, 5)] == ["character", "character", "end"]
    assert [p[3] for p in check(["a" * 10 + "\n\n" + "b" * 10 + "\n## Title\n" + "c" * 20], 38, 5)] == ["section", "end"]
    assert [p[3] for p in check(["a" * 10 + "\n\n" + "b" * 10 + "\nTitle\n=====\n" + "c" * 20], 38, 5)] == ["section", "end"]


def test_a_piece_goes_back_to_its_best_boundary():
    prose = "One sentence of prose stands here. " * 145
    text = prose + "\n\n" + "word " * 6000 + "end"
    first, second, *_ = check([text], 12_000, 400)
    assert first[2:] == (len(prose) + 2, "paragraph") and second[3] == "word"
    # A better boundary in the last half wins over a lesser one that lies farther on; one before that half does not.
    assert check(["a" * 60 + "\n\n" + "b" * 20 + ". " + "c" * 40], 100, 0)[0][2:] == (62, "paragraph")
    assert check(["a" * 10 + "\n\n" + "b" * 60 + ". " + "c" * 40], 100, 0)[0][2:] == (74, "sentence")
    assert check(["a" * 10, "b" * 200], 100, 0)[0][2:] == (10, "message")


@pytest.fixture(scope="module")
def limit(spark):
    return spark.createDataFrame([("trajectory_piece", "characters", 100, 10)], "limit_name string, unit string, max_size bigint, overlap_size bigint")


def test_rows(spark, limit):
    rows = [(1, [msg("user", "a" * 100)]), (2, [msg("user", "a" * 60, [("1", "b" * 41)])]), (3, None), (4, [msg("user", None)]), (5, [msg("user", "é\n" * 5000)]), (6, [msg("user", "é\n" * 5000)]), (None, [msg("user", "z" * 101)])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"row_id bigint, messages {MESSAGES}, text string, piece_no int")
    got = K.split_rows(df, limit).collect()
    assert {r.row_id for r in got} == {2, 5, 6, None} and all(len(r.text) <= 100 for r in got)
    five = sorted((r for r in got if r.row_id == 5), key=lambda r: r.piece_no)
    assert "".join(r.text[r.new_from - r.char_from :] for r in five) == "é\n" * 5000
    assert all(a.text[-10:] == b.text[:10] for a, b in zip(five, five[1:])) and five[0].n_pieces == len(five)
    assert K.split_rows(df.limit(0), limit).count() == 0
    assert {r.row_id: r.n_chars for r in K.rows_cut(K.split_rows(df, limit), limit).collect()} == {2: 101, 5: 10_000, 6: 10_000, None: 101}
    proofs = K.rebuilt(K.split_rows(df, limit), limit).collect()
    assert {r.row_id: r.digest for r in proofs}[5] == hashlib.md5(("é\n" * 5000).encode()).hexdigest() and all(r.fits and r.repeats for r in proofs) and len(proofs) == 4
    with pytest.raises(ValueError):
        K.split_rows(df, limit.limit(0))
    with pytest.raises(ValueError):
        K.Limits(10, 10)
