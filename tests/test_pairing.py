"""Pairing of findings against sorting all pairs, and its growth with the length of the lists."""

import random
import time

from pyspark.sql import functions as F

from docplan.operators.pairing import pairing, strongest_pairs


def all_pairs(left, right, at_least):
    def overlap(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    ranked = sorted((-overlap(a, b), l, r) for l, a in enumerate(left) for r, b in enumerate(right))
    pairs = []
    for score, l, r in ranked:
        if -score >= at_least and all(l != x and r != y for x, y in pairs):
            pairs.append((l, r))
    return pairs


def random_lists(rng, words, n):
    return [rng.sample(words, rng.randint(0, min(8, len(words)))) for _ in range(n)]


def test_pairs_equal_sorting_all():
    rng = random.Random(5)
    for case in range(400):
        words = [f"w{i}" for i in range(rng.choice([3, 6, 12, 40]))]
        left = random_lists(rng, words, rng.randint(0, 14))
        right = random_lists(rng, words, rng.randint(0, 14)) + [
            [w for w in x if rng.random() < 0.9] for x in left if rng.random() < 0.6]
        at_least = rng.choice([0.5, 0.3, 0.8, 1.0])
        assert strongest_pairs(left, right, at_least) == all_pairs(left, right, at_least), (case, left, right)


def seconds(n):
    """Equal wordings, wordings that all tie at one half, and reworded ones, a third each."""
    def side(tag):
        return ([["attend", "meeting"]] * (n // 3) + [["send", "form", f"{tag}{i}"] for i in range(n // 3)]
                + [["visit", f"room{i}", f"floor{i}", f"{tag}{i}"] for i in range(n // 3)])

    start = time.process_time()
    pairs = strongest_pairs(side("old"), side("new"), 0.5)
    assert len(pairs) == 3 * (n // 3)
    return time.process_time() - start


def test_time_grows_with_length():
    assert min(seconds(6000) for _ in range(3)) < 3 * min(seconds(3000) for _ in range(3)) + 0.05


def test_column_with_nulls_and_empty_lists(spark):
    rows = [(0, [["a", "b"], ["c"]], [["c"], ["d"]]), (1, None, [["a"]]), (2, [[]], [[]]), (3, [], None)]
    df = spark.createDataFrame(rows, "k int, p array<array<string>>, c array<array<string>>")
    got = {r.k: r.x for r in df.select("k", pairing(F.col("p"), F.col("c"), 0.5).alias("x")).collect()}
    plain = {k: ([tuple(p) for p in x.pairs], x.added, x.removed) for k, x in got.items()}
    assert plain == {0: ([(1, 0)], [1], [0]), 1: ([], [0], []), 2: ([], [0], [0]), 3: ([], [], [])}
