"""Sketches keep pairs that can't link from leaving their cells, and no pair that links."""

import random

import numpy as np

from tidemark.llm import jaccard_join


def distances(spark, texts, percent=80):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(jaccard_join.shingle_sets(df, 5, percent).collect(), key=lambda r: r["doc_id"])
    ids = np.arange(len(rows))
    g = {"n": np.array([r["n"] for r in rows]), "id": ids, "comp": ids, "sketch": np.frombuffer(b"".join(bytes(r["sketch"]) for r in rows), np.uint64).reshape(len(rows), -1)}
    i, j = np.triu_indices(len(rows), 1)
    return jaccard_join._distance(g, i, j, percent)


def changed(words, rng, every):
    return [rng.choice("abcdefgh") + str(rng.random()) if i % every == every // 2 else w for i, w in enumerate(words)]


def test_pairs_below_the_threshold_stay_in_their_cells(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    unrelated = distances(spark, [" ".join(words(900)) for _ in range(12)])
    assert (unrelated >= 0).sum() == 0
    template = words(300)
    below = distances(spark, [" ".join(changed(template, rng, 34)) for _ in range(16)])  # near 0.73
    assert (below >= 0).mean() < 0.1
    linked = distances(spark, [" ".join(changed(template, rng, 60)) for _ in range(16)])  # above 0.8
    assert (linked >= 0).all()
