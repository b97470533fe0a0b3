"""Workers give freed memory back; sets that share keys are found in bounded runs."""

import numpy as np

from recsift.llm import common, jaccard, packing


def test_a_task_gives_its_memory_back(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))

    @common.giving_back
    def run(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(run(iter([1, 2]))) == [1, 2] and seen == [1, 2, "back"]
    begun = run(iter([3, 4]))
    next(begun)
    begun.close()
    assert seen[-1] == "back"
    monkeypatch.undo()
    common.give_back()
    assert packing.give_back is common.give_back


def test_sharing_sets_in_small_runs(spark, monkeypatch):
    assert jaccard.BUCKET_KEYS <= 500_000
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 50)
    monkeypatch.setattr(jaccard, "ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-400, 400, int(rng.integers(0, 6))).tolist()) for i in range(300)] + [(5, [1000]), (5, [1000])]
    owners = {}
    for s, keys in rows:
        for k in keys:
            owners.setdefault(k, set()).add(s)
    want = {s for x in owners.values() if len(x) > 1 for s in x}
    sets = spark.createDataFrame(rows, "s1 long, heavy array<long>").repartition(3)
    assert {r["s1"] for r in jaccard.sharing_sets(sets).collect()} == want
