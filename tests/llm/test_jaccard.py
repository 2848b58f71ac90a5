import random

import pytest
from pyspark.sql import functions as F

from tideglass.llm import jaccard
from tideglass.llm.jaccard import ngram_jaccard


def brute(rows, t=0.85, k=4):
    sets = []
    for _, text in rows:
        import re

        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    base = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 or not base:
            w = [rng.choice(words) for _ in range(rng.choice([3, 8, 12, 30, 90, 300]))]
            if rng.random() < 0.4:
                w = passage + w[: rng.choice([0, 2, 5, 20])]
            base.append(w)
        else:
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.5:
                base.append(w)
        rows.append((i, " ".join(w) if rng.random() < 0.9 else "\n".join(w).upper()))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "é one"), (n + 6, "x " * 5000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = made(seed, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, ngram_jaccard(df).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("tiles", [1 << 14, 3])
def test_chain_in_one_tile_needs_full_comparison(spark, monkeypatch, tiles):
    """A long passage with edits that pile up: the first member of a tile is far from the last; a block's tiles are looked at in slices."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "TILE_SLICE", tiles)
    rng = random.Random(5)
    w = [f"u{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        w[(i * 2) % 120] = f"v{i}"
    rng.shuffle(rows)
    got = sorted(map(tuple, ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard(df).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (None, 1, None)], key=str)
    assert ngram_jaccard(df.limit(0)).collect() == []


def test_tiles_of_two_that_a_bound_cuts(spark):
    """With more partitions than rows, every row of the tiles is alone in one."""
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))]
    own = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == brute(rows) and {r[2] for r in got} == {1}
