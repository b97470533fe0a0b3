"""Text pairs are sorted before they are encoded, both columns in one worker and in runs of bounded length."""

import numpy as np

from recsift.operators import embed as em
from recsift.operators import metrics as mt


def _plan(df, optimized=False):
    q = df._jdf.queryExecution()
    return (q.optimizedPlan() if optimized else q.executedPlan()).toString()


def test_two_columns_share_a_worker_and_pairs_are_sorted_before_they_are_encoded(spark):
    df = spark.createDataFrame([(i, f"a b {i}", f"c {i}") for i in range(40)], "i int, x string, y string")
    both = em.embed_text(em.embed_text(df, "x", "a"), "y", "b")
    assert _plan(both).count("ArrowEvalPython") == 1
    encode = lambda d: em.embed_text(em.embed_text(d, "x", "a"), "y", "b")
    late = mt.in_batch_contrastive(df, ["i"], "a", "b", batch_size=16, encode=encode)
    early = mt.in_batch_contrastive(both, ["i"], "a", "b", batch_size=16)
    assert sorted(late.collect()) == sorted(early.collect())


def test_encoder_runs_of_bounded_length_give_the_same_vectors():
    texts = [None, "", "a b c", "b " * 50, "x", *[f"w{i} a" for i in range(30)]]
    whole, cut = em.HashEncoder(), em.HashEncoder()
    cut.RUN_CHARS = 8
    assert np.array_equal(whole(texts), cut(texts)) and cut([]).shape == (0, 64)
