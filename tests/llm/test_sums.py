import numpy as np

from loomary.llm import sums


def test_sums_of_any_width(spark):
    big = 3 * sums.CHUNK + 5

    def count(b, total):
        ids = b.column("id").to_numpy()
        total[0] += len(ids)
        total[sums.CHUNK] += int(ids.sum()) * 10**9
        total[big - 1] -= 1000 * len(ids)
        total[sums.CHUNK * 2 : sums.CHUNK * 2 + 3] += 70_000

    got = sums.summed(spark.range(1000).repartition(5), count, big)
    want = np.zeros(big, np.int64)
    want[0], want[sums.CHUNK], want[big - 1] = 1000, sum(range(1000)) * 10**9, -1_000_000
    n = got[sums.CHUNK * 2] // 70_000
    want[sums.CHUNK * 2 : sums.CHUNK * 2 + 3] = n * 70_000
    assert (got == want).all() and n >= 1
    assert not sums.summed(spark.range(0), count, 10 + big)[1:].any()
