"""Mixing sources to target weights (problem 7).

The documents of a source are put in the order of a hash, which lays them out on a line of tokens; the
line repeated for each pass over the source, and cut at the source's exact quota, is what the mix takes
of it. Lines are cut into blocks of equal tokens, the same for all sources. A splitting tree divides
the blocks among output shards: each node splits its vector of blocks by source with one multivariate
hypergeometric draw, so every shard is a fair sample of the mix and the leaves add up exactly. A shard
takes disjoint runs of each source's blocks and is shuffled locally. Shards have a fixed size in
tokens, so their number grows with the mix and no task sorts more than one shard.

The driver sees one row a source, and makes one row of block counts a shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.tokens import VOCABULARY, count_tokens
from lumenfold.session import materialise


@dataclass(frozen=True)
class MixConfig:
    """``total_tokens``: size of the mix; None takes the largest in which every source with
    documents reaches its share of them. ``shard_tokens``: about the size of an output shard;
    ``blocks``: a shard; ``bucket``: documents that one task puts in order."""

    total_tokens: int | None = None
    shard_tokens: int = 1 << 26
    blocks: int = 1 << 14
    bucket: int = 1 << 15
    seed: int = 7
    vocabulary: str = VOCABULARY


def token_quotas(capacity: dict[str, int], share: dict[str, float], total: int | None) -> dict[str, int]:
    """Tokens a source: its share of the total, as nearly as its capacity allows.

    What a source cannot give is spread over the others in proportion to their shares, again and
    again until all is given or every source is exhausted.
    """
    live = {s for s in share if share[s] > 0 and capacity.get(s, 0) > 0}
    quota = {s: 0 for s in share}
    if not live:
        return quota
    if total is None:
        weight = sum(share[s] for s in live)
        total = int(min(capacity[s] * weight / share[s] for s in live))
    rest = float(total)
    while live and rest >= 1:
        weight = sum(share[s] for s in live)
        full = {s for s in live if capacity[s] <= rest * share[s] / weight + 0.5}
        if not full:
            for s in live:
                quota[s] = round(rest * share[s] / weight)
            break
        for s in full:
            quota[s] = capacity[s]
            rest -= capacity[s]
        live -= full
    return quota


def splitting_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks by shard and source: exact row sums (equal to within one) and exact column sums."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    take = int(counts.sum()) * left // shards
    part = rng.multivariate_hypergeometric(counts, take, method="marginals") if counts.sum() else counts * 0
    return np.vstack([splitting_tree(part, left, rng), splitting_tree(counts - part, shards - left, rng)])


def shard_bounds(quota: dict[str, int], cfg: MixConfig) -> tuple[int, dict[str, np.ndarray]]:
    """(block, bounds): tokens a block, and of each source the block after the last of each shard."""
    names, total = sorted(quota), sum(quota.values())
    shards = max(1, round(total / cfg.shard_tokens))
    block = max(1, -(-total // (shards * cfg.blocks)))
    counts = np.array([-(-quota[s] // block) for s in names], np.int64)
    if not names:
        return block, {}
    leaves = splitting_tree(counts, shards, np.random.default_rng(cfg.seed))
    return block, {s: np.cumsum(leaves[:, k]) for k, s in enumerate(names)}


def _sizes(documents: DataFrame, targets: DataFrame, cfg: MixConfig) -> DataFrame:
    wanted = targets.where("source is not null").select("source").distinct()
    rows = documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi")
    return materialise(count_tokens(rows, "text", "n_tokens", cfg.vocabulary).where("n_tokens > 0"))


def _placed(sizes: DataFrame, plan: DataFrame, cfg: MixConfig) -> DataFrame:
    """Documents with ``pos``, their beginning on the source's line of tokens, and ``uses``.

    Two levels: a bucket of documents is put in order by one task, and buckets by their sums; a
    source has buckets in proportion to its documents.
    """
    mark = lambda k: F.xxhash64("doc_id", "n_tokens", F.lit(cfg.seed + k))
    rows = sizes.join(plan, "source").withColumn("bucket", F.pmod(mark(0), F.col("buckets")))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy(mark(1), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(base, ["source", "bucket"]).withColumn("pos", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # pass e takes the document if at least half of it lies before the quota
    room = F.expr("quota - pos - n_tokens div 2")
    uses = F.when(room >= 0, F.least(F.expr("(quota - pos - n_tokens div 2) div whole") + 1, F.col("repeats").cast("long"))).otherwise(0)
    return rows.withColumn("uses", uses.cast("int")).where("uses > 0")


def _sharder(bounds: dict[str, np.ndarray], block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("source").dictionary_encode()
            which, at = source.indices.to_numpy(zero_copy_only=False), batch.column("at").to_numpy() // block
            shard = np.zeros(batch.num_rows, np.int32)
            for k, name in enumerate(source.dictionary.to_pylist()):
                mine = which == k
                ends = bounds[name]
                shard[mine] = np.minimum(np.searchsorted(ends, at[mine], "right"), np.searchsorted(ends, ends[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *[batch.column(c) for c in ("source", "doc_id", "epoch", "n_tokens")]], names=["shard", "source", "doc_id", "epoch", "n_tokens"])

    return run


def mix_sources(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: shard, position, source, doc_id, epoch, n_tokens; the epochs of one document number its
    uses from 0. shares: source, target_share, max_repeats, tokens, share, documents, draws.

    Defined results: texts without a token (null, empty) are not mixed; documents whose source is
    null or no target are not; a target without documents has share 0 and the others make up for
    it; a null or negative share or max_repeats counts as 0; the last document of a source's quota
    is taken if at least half of it fits. The documents are tokenised once.
    """
    cfg, spark = config, documents.sparkSession
    sizes = _sizes(documents, targets, cfg)
    wanted = {r.source: r for r in targets.where("source is not null").dropDuplicates(["source"]).collect()}
    has = {r.source: (r.n, r.docs) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    share = {s: max(0.0, r.target_share or 0.0) for s, r in wanted.items()}
    repeats = {s: max(0, r.max_repeats or 0) for s, r in wanted.items()}
    quota = token_quotas({s: n * repeats[s] for s, (n, _) in has.items()}, share, cfg.total_tokens)
    block, bounds = shard_bounds(quota, cfg)
    plan = spark.createDataFrame(
        [(s, -(-has[s][1] // cfg.bucket), quota[s], has[s][0], repeats[s]) for s in sorted(has)], "source string, buckets int, quota long, whole long, repeats int"
    )
    placed = _placed(sizes, plan, cfg)
    drawn = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1))).withColumn("at", F.col("pos") + F.col("epoch") * F.col("whole"))
    kind = dict(sizes.dtypes)["doc_id"]
    mix = drawn.select("source", "doc_id", "epoch", "n_tokens", "at").mapInArrow(_sharder(bounds, block), f"shard int, source string, doc_id {kind}, epoch int, n_tokens long")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", F.lit(cfg.seed + 2), "epoch"), "doc_id", "epoch", "n_tokens")
    mix = mix.select("shard", F.row_number().over(local).alias("position"), "source", "doc_id", "epoch", "n_tokens")
    got = placed.groupBy("source").agg(F.sum(F.expr("n_tokens * uses")).alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.sum("uses").alias("draws"))
    total = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shares = (
        targets.where("source is not null").dropDuplicates(["source"]).select("source", "target_share", "max_repeats")
        .join(got, "source", "left").select("source", "target_share", "max_repeats", zero("tokens"), zero("documents"), zero("draws"))
        .withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(total)), F.lit(0.0)))
    )
    return mix, shares
