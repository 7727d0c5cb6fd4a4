import numpy as np
import pytest

from marlstone.llm._tally import tally


@pytest.mark.parametrize("length,rows", [(1 << 20, 500), (5000, 4000), (1 << 14, 0)])
def test_counts_match_one_array(spark, length, rows):
    """Few and many codes for the array's length, a last chunk that is not full, and no rows."""
    df = spark.range(rows).selectExpr("id * id % 4999 AS code").repartition(5)
    got = tally(df, lambda b: [b.column(0).to_numpy()] * 2, length)
    want = 2 * np.bincount(np.arange(rows, dtype=np.int64) ** 2 % 4999, minlength=length)
    assert got.shape == (length,) and (got == want).all()
