"""Means of quotes that are halves in the last digit."""

import random

from pyspark.sql import functions as F

from florin.operators import ingest as I


def test_halves_of_means_round_up_in_any_order(spark):
    rng = random.Random(5)
    groups, k = {}, 0
    while len(groups) < 100:
        ticks = [rng.randrange(16_000, 22_000) for _ in range(20)]
        if sum(ticks) % 2:  # the mean, sum / 400,000, ends in a half of the sixth digit for odd sums
            groups[k], k = ticks, k + 1
    rows = [(g, 0.82 + (t - 16_400) / 20000.0) for g, ticks in groups.items() for t in ticks]
    got = dict(spark.createDataFrame(rows, "g int, rate double").groupBy("g").agg(I.exact_mean(F.col("rate"), 6)).collect())
    assert got == {g: (sum(t) * 5 + 1) // 2 / 10**6 for g, t in groups.items()}
    plain = dict(spark.createDataFrame(rows, "g int, rate double").groupBy("g").agg(F.round(F.avg("rate"), 6)).collect())
    assert plain != got
