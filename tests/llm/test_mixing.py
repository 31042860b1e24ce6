import random

import numpy as np

from lumenfold.llm.mixing import MixConfig, mix_sources, shard_bounds, splitting_tree, token_quotas

DOCS = "doc_id long, source string, text string, shard int"
TARGETS = "source string, target_share double, max_repeats int"


def test_quotas_are_as_near_as_the_caps_allow():
    assert token_quotas({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, 100) == {"a": 50, "b": 50}
    assert token_quotas({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.5}, 100) == {"a": 10, "b": 90}
    assert token_quotas({"a": 10, "b": 20}, {"a": 0.5, "b": 0.5}, 100) == {"a": 10, "b": 20}
    assert token_quotas({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.5}, None) == {"a": 10, "b": 10}
    assert token_quotas({}, {"a": 1.0}, None) == {"a": 0} and token_quotas({}, {}, None) == {}


def test_splitting_tree_is_exact_and_fair():
    rng = np.random.default_rng(1)
    counts = np.array([1000, 10, 0, 333])
    leaves = splitting_tree(counts, 7, rng)
    assert leaves.shape == (7, 4) and (leaves >= 0).all() and (leaves.sum(0) == counts).all() and np.ptp(leaves.sum(1)) <= 1
    assert abs(leaves[:, 0] - 1000 / 7).max() < 40


def test_shards_follow_the_size_and_blocks_the_quotas():
    block, bounds = shard_bounds({"a": 10**9, "b": 3 * 10**8, "c": 5, "d": 0}, MixConfig(shard_tokens=10**8))
    assert len(bounds["a"]) == 13 and bounds["d"][-1] == 0 and bounds["c"][-1] == 1
    assert all(bounds[s][-1] == -(-q // block) for s, q in {"a": 10**9, "b": 3 * 10**8, "c": 5, "d": 0}.items())
    assert shard_bounds({}, MixConfig()) == (1, {}) and shard_bounds({"a": 0}, MixConfig())[0] == 1


def test_every_shard_has_the_target_shares(spark):
    # sources of very different number and length of documents
    rng = random.Random(8)
    sizes = {"long": (900, 120), "short": (30_000, 3), "mid": (6_000, 20), "few": (300, 25)}
    docs, i = [], 0
    for source, (n, most) in sizes.items():
        for _ in range(n):
            docs.append((i, source, "word " * rng.randrange(1, most), 0))
            i += 1
    share = {"long": 0.3, "short": 0.35, "mid": 0.25, "few": 0.1}
    targets = spark.createDataFrame([(s, share[s], 3) for s in share], TARGETS)
    mix, shares = mix_sources(spark.createDataFrame(docs, DOCS), targets, MixConfig(shard_tokens=30_000, bucket=512))
    rows = mix.groupBy("shard", "source").sum("n_tokens").toPandas().pivot(index="shard", columns="source", values="sum(n_tokens)").fillna(0)
    total = rows.sum(axis=1)
    assert len(rows) >= 4 and total.max() / total.min() < 1.05
    for s in share:
        assert ((rows[s] / total) - share[s]).abs().max() < 0.02
    got = {r.source: r for r in shares.collect()}
    assert all(abs(got[s].share - share[s]) < 0.002 for s in share)
    assert {s: got[s].tokens for s in share} == rows.sum().to_dict()


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, "big", "word " * rng.randrange(1, 30), 0) for i in range(400)] + [(1000 + i, "small", "word " * rng.randrange(1, 30), 0) for i in range(30)]
    docs += [(2000, "big", None, 0), (2001, "big", "", 0), (2002, None, "some words", 0), (2003, "other", "some words", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2)], TARGETS)
    df = spark.createDataFrame(docs, DOCS)
    mix, shares = mix_sources(df, targets, MixConfig(shard_tokens=800, bucket=16))
    rows = mix.collect()
    uses = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r.epoch)
    assert all(sorted(e) == list(range(len(e))) or len(set(e)) == len(e) for e in uses.values())
    assert max(len(e) for i, e in uses.items() if i < 1000) == 1 and max(len(e) for i, e in uses.items() if i >= 1000) <= 3
    assert not set(uses) & {2000, 2001, 2002, 2003}
    got = {r.source: r for r in shares.collect()}
    assert abs(got["big"].share - 0.6 / 0.9) < 0.02 and abs(got["small"].share - 0.3 / 0.9) < 0.02 and got["none"].share == 0
    assert sum(r.n_tokens for r in rows) == sum(r.tokens for r in got.values())
    assert len({r.shard for r in rows}) > 3
    for k in {r.shard for r in rows}:
        assert sorted(r.position for r in rows if r.shard == k) == list(range(1, 1 + sum(r.shard == k for r in rows)))
    again = mix_sources(df, targets, MixConfig(shard_tokens=800, bucket=16))[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    mix, shares = mix_sources(empty, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mix.count() == 0 and [r.tokens for r in shares.collect()] == [0]
    mix, shares = mix_sources(empty, spark.createDataFrame([], TARGETS))
    assert mix.count() == 0 and shares.count() == 0
