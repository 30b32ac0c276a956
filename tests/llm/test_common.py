import pyarrow as pa
import pytest

from deckloom.llm.common import BATCH_BYTES, BATCH_SETTING, PIECE_BYTES, pieces, small_batches


@pytest.mark.parametrize(("was", "now"), [("64m", BATCH_BYTES), ("67108864b", BATCH_BYTES), ("1g", BATCH_BYTES), ("4m", 4 << 20), ("1000", 1000)])
def test_small_batches(spark, was, now):
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, was)
    small_batches(spark)
    got = spark.conf.get(BATCH_SETTING).rstrip("b")
    spark.conf.set(BATCH_SETTING, before)
    assert got in (str(now), was)
    assert got == str(now) or now in (4 << 20, 1000)


def test_pieces_hold_every_row_once():
    texts = pa.array([b"x" * n for n in (0, PIECE_BYTES + 1, 5, PIECE_BYTES // 2, PIECE_BYTES // 2, 7)] + [None], pa.binary())
    got = list(pieces(texts))
    assert [r for a, n in got for r in range(a, a + n)] == list(range(len(texts))) and len(got) > 1
    assert list(pieces(pa.array([], pa.binary()))) == []
