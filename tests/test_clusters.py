import datetime
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import context as X
from barloom.operators import pair_blocks as B
from barloom.plans.q_context import x09
from barloom.session import shared_dir


def linkage(names, dist):
    """Nearest pair first, by the definition: the mean of all distances between two clusters."""
    clusters, merges = [(n,) for n in names], []
    while len(clusters) > 1:
        mean = lambda a, b: round(sum(dist.get((x, y), 1.0) for x in a for y in b) / (len(a) * len(b)), 12)
        height, _, _, a, b = min((mean(a, b), min(a), min(b), a, b) for a, b in itertools.combinations(sorted(clusters, key=min), 2))
        merges.append((min(a), min(b), height))
        clusters = [c for c in clusters if c not in (a, b)] + [tuple(sorted(a + b))]
    return merges


@pytest.mark.parametrize("seed", [9, 1])
def test_average_linkage_equals_nearest_pair_first(spark, seed):
    rng = random.Random(seed)
    names = [f"T{i:02d}" for i in range(25)]
    spots = {n: (rng.uniform(0, 1), rng.uniform(0, 1)) for n in names}
    dist = {}
    for a, b in itertools.permutations(names, 2):
        d = ((spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2) ** 0.5
        dist[a, b] = dist.get((b, a), d)
    for pair in [("T03", "T11"), ("T07", "T20")]:  # pairs without a distance
        dist.pop(pair), dist.pop(pair[::-1])
    table = spark.createDataFrame([(a, b, float(d)) for (a, b), d in dist.items()], "a string, b string, dist double")
    merges = X.average_linkage(table)
    got = [(r.a, r.b, r.height) for r in merges.orderBy("step").collect()]
    expect = linkage(names, dist)
    assert len(got) == 24 and sorted(m[:2] for m in got) == sorted(m[:2] for m in expect)
    assert [round(m[2], 9) for m in got] == [round(m[2], 9) for m in sorted(expect, key=lambda m: m[2])]
    people = spark.createDataFrame([(n,) for n in names], "a string")
    for k in (1, 4, 25):
        groups = {}
        for r in X.cut_tree(merges, people, [k]).collect():
            groups.setdefault(r.cluster, set()).add(r.a)
        assert len(groups) == k and all(min(v) == c for c, v in groups.items())
    assert X.average_linkage(table.limit(0)).collect() == []
    with pytest.raises(ValueError):
        X.cut_tree(merges, people, [2], limit=10)


def test_x09_searches_the_default_numbers_of_clusters(spark):
    found = {r.cluster for r in x09(spark, "/root/testdata/sf0.01").select("cluster").distinct().collect()}
    assert 8 <= len(found - {"MARKET"}) <= 20


@pytest.mark.parametrize("kind", ["far", "copies", "gaps"])
def test_linkage_reads_rows_again_only_beyond_what_it_remembers(spark, monkeypatch, kind):
    """Rows in files, few remembered neighbours, rewritten blocks: the merges of the definition."""
    for name, size in (("TILE", 9), ("NEAR", 4), ("WHOLE", 6), ("FEW", 2)):
        monkeypatch.setattr(B, name, size)
    monkeypatch.setattr(X, "TILE", 9)
    rng = random.Random(4)
    names = list(range(100, 140))
    spots = {n: (rng.uniform(0, 2), rng.uniform(0, 2)) for n in names}
    if kind == "copies":
        spots = {n: spots[100 + n % 5] for n in names}
    dist = {}
    for a, b in itertools.combinations(names, 2):
        d = ((spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2) ** 0.5
        if kind != "gaps" or rng.random() < 0.7:
            dist[a, b] = dist[b, a] = d
    table = spark.createDataFrame([(a, b, float(d)) for (a, b), d in dist.items()], "a int, b int, dist double")
    got = sorted((r.a, r.b, round(r.height, 9)) for r in X.average_linkage(table).collect())
    assert got == sorted((a, b, round(h, 9)) for a, b, h in linkage(names, dist))


def files_of(folder):
    return {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def test_clusters_of_a_panel_leave_no_pairs_behind_and_shuffle_none(spark, monkeypatch):
    monkeypatch.setattr(X, "TILE", 5)
    monkeypatch.setattr(B, "WHOLE", 4)
    rng = np.random.default_rng(2)
    first, rows = datetime.date(2020, 1, 1), []
    common = rng.normal(size=(3, 60))
    for t in range(14):
        close = np.exp(np.cumsum(0.01 * (common[t % 3] + 0.3 * rng.normal(size=60))))
        rows += [(t, first + datetime.timedelta(d), float(c)) for d, c in enumerate(close)]
    panel = spark.createDataFrame(rows, "ticker int, date date, close double")
    folder = shared_dir(spark).removeprefix("file:")
    before = files_of(folder)
    got = X.correlation_clusters(panel, panel.select("ticker").distinct(), k_range=(2, 6), min_obs=50)
    found = {r.ticker: r.cluster for r in got.collect()}
    assert {found[t] for t in range(3)} == {"CL00", "CL01", "CL02"} and all(found[t] == found[t % 3] for t in found)
    left = {f for f in files_of(folder) - before if "linkage" in f or "distance" in f or "tiles" in f}
    assert not left, left
    # The silhouettes of blocks are those of the pairs.
    r = panel.withColumn("r", F.col("close"))
    names = list(range(14))
    corr = X.pair_correlation(r, "r")
    clusters = spark.createDataFrame([(k, t, t % k if t else 13) for k in (2, 3) for t in names], "k int, a int, cluster int")
    of_rows = {x.k: x.silhouette for x in X.silhouettes(X.pair_distance(corr), clusters).collect()}
    of_blocks = {x.k: x.silhouette for x in X.silhouettes(X.pair_distances(r, "r", names), clusters, names).collect()}
    assert of_rows.keys() == of_blocks.keys() and all(abs(of_rows[k] - of_blocks[k]) < 1e-9 for k in of_rows)
