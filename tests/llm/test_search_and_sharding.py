import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import maxscore, mixing, sharding


def brute(vectors, queries, k):
    out = []
    for q, a in queries:
        scores = sorted((-int(np.dot(a, b)), v) for v, b in vectors if v != q)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 300])
def test_topk_matches_brute_force(spark, spread):
    draw = random.Random(spread)
    vectors = [(i, [draw.randint(-spread, spread) for _ in range(12)]) for i in range(500)]
    vectors += [(500 + i, vectors[7][1]) for i in range(200)] + [(900, [0] * 12), (901, [-spread] * 12)]
    rows = spark.createDataFrame([(i, v, 1.0, 2) for i, v in vectors], "vec_id long, vector array<long>, score double, rank int")
    found = maxscore.maxscore_topk(rows, rows.filter("vec_id % 50 = 0"), 5, shard_rows=128, block_rows=4)
    assert sorted(map(tuple, found.collect())) == brute(vectors, [x for x in vectors if x[0] % 50 == 0], 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=11, max_size=11), min_size=1, max_size=40), st.integers(1, 6))
def test_one_shard_is_exact(vectors, k):
    ids = np.arange(len(vectors)) * 3
    shard = maxscore.Shard(ids[::-1].copy(), np.array(vectors, float)[::-1].copy())
    for i, q in zip(ids.tolist(), vectors, strict=True):
        found = list(zip(*map(list, shard.search(np.array(q, float), i, k)), strict=True))
        assert [(i, r + 1, int(v), int(s)) for r, (v, s) in enumerate(found)] == brute(list(zip(ids.tolist(), vectors, strict=True)), [(i, q)], k)


def test_search_reads_less_where_bounds_can_prune():
    """Rows with few large components in few dimensions: most postings are never read and most rows never probed, and answers stay those of all pairs."""
    draw = np.random.default_rng(3)
    vectors = np.where(draw.random((6000, 40)) < 0.1, draw.geometric(0.02, (6000, 40)) * draw.choice([-1, 1], (6000, 40)), 0).astype(float)
    ids = draw.permutation(6000)
    shard = maxscore.Shard(ids, vectors, segment_rows=256)
    for at in range(0, 6000, 300):
        found = shard.search(vectors[at], int(ids[at]), 5)
        scores = vectors @ vectors[at]
        scores[at] = -math.inf
        want = np.lexsort((ids, -scores))[:5]
        assert found[0].tolist() == ids[want].tolist() and found[1].tolist() == scores[want].tolist()
    nonzero, pairs = 20 * np.count_nonzero(vectors), 20 * vectors.size
    assert shard.read < 0.5 * nonzero and shard.probed < 0.2 * pairs, (shard.read / nonzero, shard.probed / pairs)


def test_vectors_of_another_length_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [1]), (3, [1, 2, 3]), (50, []), (4, [5, 6])], "vec_id long, vector array<long>")
    found = maxscore.maxscore_topk(rows, rows.filter("vec_id % 50 = 0"), 5)
    assert sorted((r.query_id, r.vec_id, r.score) for r in found.collect()) == [(0, 1, 11), (0, 4, 17)]


def test_topk_leaves_out_unusable_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.001, 2.0]), (None, [1.0, 1.0]), (0, [1.0, 0.5])],
        "vec_id long, embedding array<float>",
    )
    rows = rows.select("vec_id", maxscore.quantised("embedding").alias("vector"))
    assert {r.vec_id: r.vector for r in rows.collect() if r.vector and r.vec_id is not None} == {0: [256, 128], 5: [-1, 512]}
    found = maxscore.maxscore_topk(rows, rows.filter("vec_id = 0"), 5)
    assert {(r.vec_id, r.score) for r in found.collect()} == {(5, -256 + 128 * 512)}
    assert maxscore.maxscore_topk(rows.limit(0), rows.limit(0), 5).count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 9) for i, t, s in rows], "doc_id long, text string, source string, size long, shard int")


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess again and again."""
    sources = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sources if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        target = {s: weight[s] * left / w for s in free}
        over = {s: most * sizes[s] for s in free if target[s] > most * sizes[s]}
        if not over:
            return capped | target
        capped |= over


def test_targets_by_water_filling(spark):
    sizes = {"a": 1000, "b": 10, "c": 4, "d": 30, None: 7, "é": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water(sizes)
    assert all(math.isclose(found[s], want[s], abs_tol=1e-9) for s in sizes) and sum(found.values()) == pytest.approx(1051)


def test_mix_and_emit(spark):
    draw = random.Random(1)
    rows = [(i, "w " * draw.randint(0, 9), draw.choice(["hot", "hot", "b", "c", None])) for i in range(3000)] + [(None, "a b", "b"), (7, None, "c"), (7, None, "c")]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and max(r.copies for r in mixed) <= 3
    taken, target = Counter(), {}
    for r in mixed:
        taken[r.source_size] += r.size * r.copies
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) <= 0.1 * t for s, t in target.items())
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.emit(docs.limit(0)).count() == 0


def test_many_sources_are_joined_by_shuffle(spark):
    docs = documents(spark, [(i, "w " * (i % 7), None if i % 11 == 0 else f"s{i % 40}") for i in range(800)])
    assert sorted(map(str, mixing.mix(docs, broadcast_sources=3).collect())) == sorted(map(str, mixing.mix(docs).collect()))


@pytest.mark.parametrize("folder, share", [("sf0.01", 0.05), ("sf0.1", 0.02)])
def test_taken_words_come_near_the_targets(spark, folder, share):
    taken, target, rows = Counter(), {}, Counter()
    for r in mixing.op8_mixing(spark, f"/root/testdata/{folder}").collect():
        taken[r.source_size] += r.taken
        target[r.source_size], rows[r.source_size] = r.target, rows[r.source_size] + 1
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - t) <= share * t for s, t in target.items() if rows[s] >= 50)


def test_rows_of_a_source_of_size_zero_stay(spark):
    found = mixing.mix(documents(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in found] == [(0, 0, 0.0, 0)] * 2


def test_shards(spark):
    rows = [(i, "t" * (i % 5), "s") for i in range(4000)] + [(None, None, None)] * 3 + [(5, "other", "s")]
    out = sharding.assign_shards(documents(spark, rows), buckets=16).collect()
    assert len(out) == len(rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of[r.doc_id].add((r.shard, r.grown_shard))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(len(x) == 1 for x in of.values())
    moved = [r for r in out if r.grown_shard != r.shard]
    assert all(r.grown_shard == 8 for r in moved) and len(rows) / 9 * 0.8 < len(moved) < len(rows) / 9 * 1.2
    assert {r.size for r in out if r.doc_id is None} == {1}
    assert sharding.assign_shards(documents(spark, rows).limit(0)).count() == 0


def test_weighted_shards(spark):
    rows = documents(spark, [(i, "t", "s") for i in range(6000)])
    counts = Counter(r.shard for r in sharding.assign_shards(rows, weights=(1, 2, 0, 3)).collect())
    assert 2 not in counts and all(abs(counts[s] - 1000 * w) < 200 for s, w in ((0, 1), (1, 2), (3, 3)))
