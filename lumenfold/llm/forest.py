"""Deduplicating new batches against all history (problem 4): a prefix-tree hash forest.

Each distinct set of content pieces has one label a tree: the MinHash values of the tree's own
permutations in order, packed into one number. A run of the history is the sorted list of the labels
of all trees (``sorted_runs``); the sets whose labels share a prefix lie next to each other. An entry
of a batch begins with the prefix of full depth and widens it (shortens the prefix) until the recall
expected at its least similarity reaches the target; its range is then searched in every run. The sets
found are read by a second range search and verified exactly. Accepted files are a further run, and
runs of about one size are merged when they become many, so all writing is n log n and a batch
neither rebuilds nor shuffles the history.

Pieces found in more than ``common`` sets of a run (a constant, learned for each run and stored with
it) take no part in its labels, so that no prefix gathers more sets than that. A pair may share, of
its rare pieces, too few for the trees, if it shares several common ones. Every set with two or more
common pieces therefore has exact entries beside its labels, which miss no pair: the first pieces in
rare-first order (the prefix filter of set-similarity joins), and where a set is so dominated by
common pieces that the first shared piece may be a common one, *pairs* of its common pieces (large
sets: the two first common pieces of every tree). One common piece alone is an entry only of sets so
small that sharing it is enough to match, told apart by their sizes. So one piece in a third of all
sets never brings those sets together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.sorted_runs import assign, delete, file_system, folders, index_of, rows_of, search, write_sorted
from lumenfold.session import scratch_path

#: Bits of a label below the tree's number, and of its first component; the others share the rest.
LABEL_BITS, FIRST_BITS = 56, 32
#: Common pieces are paired in sets of at most so many pieces; larger ones use the trees.
PAIRED = 24


@dataclass(frozen=True)
class ForestConfig:
    """``threshold``: least share of pieces; ``recall``: expected at the threshold, at least.

    ``trees``: sorted permutations; ``depth``: values a label; ``common``: a piece in more sets of a
    run is common there; ``fanout``: so many runs of one level become one of the next.
    """

    threshold: float = 0.5
    trees: int = 41
    depth: int = 2
    recall: float = 0.99999
    common: int = 64
    fanout: int = 8

    def __post_init__(self) -> None:
        if not (0 < self.threshold <= 1 and 1 <= self.trees <= 60 and 1 <= self.depth <= 4):
            raise ValueError("threshold, trees or depth out of range")
        if self.expected(self.least(4, True), 1) < self.recall:
            raise ValueError("the recall target needs more trees at this threshold")

    def widths(self) -> list[int]:
        """Bits of each component of a label."""
        rest = LABEL_BITS - FIRST_BITS
        return [LABEL_BITS] if self.depth == 1 else [FIRST_BITS, *[rest // (self.depth - 1)] * (self.depth - 1)]

    def least(self, n: int, shares_common: bool) -> float:
        """The least similarity of the rare pieces of a set of ``n`` with any that it matches.

        A pair that shares one common piece and others has (o-1)/(u-1) of its rare ones in common for
        a share o/u of all; pairs that share several, or nothing but one, have exact entries.
        """
        return _least(self.threshold, n, shares_common)

    def expected(self, similarity: float, k: int) -> float:
        return 1 - (1 - similarity**k) ** self.trees

    def prefix(self, n: int, shares_common: bool = False) -> int:
        """Widen the prefix from full depth until the expected recall meets the target."""
        k = self.depth
        while k > 1 and self.expected(self.least(n, shares_common), k) < self.recall:
            k -= 1
        return k


@lru_cache(4096)
def _least(t: float, n: int, shares_common: bool) -> float:
    u = np.arange(n, min(int(n / t) + 1, n + 1000) + 1)
    o = np.maximum(np.ceil(t * u - 1e-9), 1)
    if not shares_common:
        return float((o / u).min())
    keep = o >= 2
    return float(((o[keep] - 1) / (u[keep] - 1)).min()) if keep.any() else t


def content_classes(files: DataFrame, *keep: Column | str) -> DataFrame:
    """Files to (id, digest, pieces, class): files of equal digest and pieces are one class.

    ``pieces`` is the sorted set without nulls; empty or null gives null, which matches nothing.
    """
    # sorted once, in its own projection: the parts below would each repeat it
    sets = files.select("id", *keep, "digest", F.sort_array(F.array_distinct(F.array_compact("pieces"))).alias("pieces"))
    names = [c for c in sets.columns if c not in ("id", "digest", "pieces")]
    pieces = F.when(F.size("pieces") > 0, F.col("pieces"))
    return sets.select(
        "id", *names, "digest", pieces.alias("pieces"),
        # 128 bits of a hash name the class
        F.unhex(F.md5(F.concat_ws("|", F.coalesce("digest", F.lit("-")), F.coalesce(pieces.cast("string"), F.lit("-"))))).alias("class"),
    )


def arriving(batch: DataFrame) -> DataFrame:
    """Files of a batch (id, batch_no, digest, pieces) with their class."""
    return content_classes(batch, F.col("batch_no").cast("int").alias("batch_no"))


def class_key(column: str) -> Column:
    """62 bits by which a class is sorted and looked up; the class itself is compared after that."""
    return F.shiftrightunsigned(F.xxhash64(column), 2)


# -- labels --------------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 64-bit numbers chosen by ``seed``."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy().view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def forest_labels(values: np.ndarray, offsets: np.ndarray, cfg: ForestConfig) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): the rows with pieces, and their labels of all trees (rows x trees)."""
    rows = np.flatnonzero(np.diff(offsets))
    keys = np.zeros((len(rows), cfg.trees), np.int64)
    if len(rows):
        for tree in range(cfg.trees):
            label = np.full(len(rows), tree, np.uint64)
            for j, bits in enumerate(cfg.widths()):
                least = np.minimum.reduceat(_mix(values, 1 + tree * cfg.depth + j), offsets[rows])
                # mixed again: a minimum is small, a label evenly spread
                label = label << np.uint64(bits) | _mix(least, 7) >> np.uint64(64 - bits)
            keys[:, tree] = (label << np.uint64(LABEL_BITS - sum(cfg.widths()))).view(np.int64)
    return rows, keys


def _exact_key(cfg: ForestConfig, *what: int) -> int:
    x = np.zeros(1, np.uint64)
    for w in what:
        x = _mix(x ^ np.uint64(w & 0xFFFFFFFFFFFFFFFF), 11)
    return (cfg.trees << LABEL_BITS) | int(x[0] >> np.uint64(64 - LABEL_BITS))


def exact_keys(rare: list[int], common: list[int], cfg: ForestConfig, asked: bool) -> set[int]:
    """Entries that miss no pair that shares two or more common pieces, or nothing but one.

    ``asked``: the entries of a search; stored ones differ in the order of the two sizes.
    """
    n, c, t = len(rare) + len(common), len(common), cfg.threshold
    out = set()
    for m in range(1, int((1 + t) / t + 1e-9) - n + 1):  # sizes at which one shared piece is enough
        out |= {_exact_key(cfg, 1, p, *((m, n) if asked else (n, m))) for p in common}
    if c < 2:
        return out
    rare, common = sorted(rare), sorted(common)
    need = max(1, math.ceil(t * n - 1e-9))
    out |= {_exact_key(cfg, 2, p) for p in rare[: n - need + 1]}
    need = max(2, need)
    reached = common[: max(0, n - need + 2 - len(rare))]
    if len(reached) >= 2:  # as many common pieces as a match needs
        if n <= PAIRED:
            out |= {_exact_key(cfg, 3, *two) for two in combinations(reached, 2)}
        if 2 * n > PAIRED:
            every = np.array(common, np.int64).view(np.uint64)
            for tree in range(cfg.trees):
                ranks = _mix(every, 1000 + tree)
                out.add(_exact_key(cfg, 4 + tree, *sorted(common[i] for i in np.argpartition(ranks, 1)[:2])))
    return out


def _keys(batch: pa.RecordBatch, cfg: ForestConfig, asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of all entries of sets with columns rare, common, dkey; stored ones have lo = hi."""
    (values, offsets), (cvalues, coffsets) = _ints(batch.column("rare")), _ints(batch.column("common"))
    r, c = np.diff(offsets), np.diff(coffsets)
    rows, keys = forest_labels(values, offsets, cfg)
    lo, hi = keys.copy(), keys.copy()
    if asked and len(rows):
        widths = cfg.widths()
        depths = np.array([cfg.prefix(int(n), bool(s)) for n, s in zip((r + c)[rows], (c > 0)[rows])])
        free = np.array([LABEL_BITS - sum(widths[:k]) for k in range(cfg.depth + 1)])[depths]
        mask = ((np.int64(1) << free) - 1)[:, None]
        lo, hi = keys & ~mask, keys | mask
    out_rows, out_lo, out_hi = [np.repeat(rows, cfg.trees)], [lo.ravel()], [hi.ravel()]
    few = int((1 + cfg.threshold) / cfg.threshold + 1e-9)
    extra_rows, extra = [], []
    signed, csigned = values.view(np.int64), cvalues.view(np.int64)
    for i in np.flatnonzero((c >= 2) | (c == 1) & (r + c < few)).tolist():
        found = exact_keys(signed[offsets[i] : offsets[i + 1]].tolist(), csigned[coffsets[i] : coffsets[i + 1]].tolist(), cfg, asked)
        extra_rows += [i] * len(found)
        extra += found
    told = batch.column("dkey").is_valid().to_numpy(zero_copy_only=False)
    digests = np.flatnonzero(told)
    dkeys = batch.column("dkey").fill_null(0).to_numpy(zero_copy_only=False)[digests] | np.int64(cfg.trees + 1) << LABEL_BITS
    out_rows += [np.array(extra_rows, np.int64), digests]
    for out in (out_lo, out_hi):
        out += [np.array(extra, np.int64), dkeys]
    return np.concatenate(out_rows), np.concatenate(out_lo), np.concatenate(out_hi)


def _storing(cfg: ForestConfig):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, key, _ = _keys(batch, cfg, False)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("ckey").take(pa.array(row))], names=["key", "ckey"])

    return run


def _asking(cfg: ForestConfig, runs: dict[int, tuple]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, lo, hi = _keys(batch, cfg, True)
            of = batch.column("run").to_numpy()[row]
            q = batch.column("ckey").to_numpy()[row]
            for r in np.unique(of).tolist():
                mine = np.flatnonzero(of == r)
                at, file = assign(lo[mine], hi[mine], *runs[r][1:])
                at = mine[at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[at], file.astype(np.int32), lo[at], hi[at], q[at])], names=["run", "file", "lo", "hi", "q"])

    return run


def _placing(runs: dict[int, tuple], key: str, carry: list[str]):
    """Rows to the ranges [key, key] of a search in the files of their run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys = batch.column("run").to_numpy(), batch.column(key).to_numpy()
            for r in np.unique(of).tolist():
                mine = np.flatnonzero(of == r)
                at, file = assign(keys[mine], keys[mine], *runs[r][1:])
                at = mine[at]
                bound = pa.array(keys[at])
                carried = [batch.column(c).take(pa.array(at)) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(file.astype(np.int32)), bound, bound, *carried], names=["run", "file", "lo", "hi", *carry])

    return run


RANGE = "run int, file int, lo long, hi long"
#: The columns of the written tables, so that no job has to find them out.
SCHEMAS = {
    "files": "id long, batch_no int, digest string, pieces array<long>, class binary", "classes": "key long, class binary, digest string, pieces array<long>, n int, i long",
    "labels": "key long, ckey long", "common": "p long", "members": "key long, class binary, id long",
    "found": "q binary, qn int, qi long, a binary, an int, ai long", "edges": "q binary, a binary", "pairs": "case_id long, accepted_id long",
}


def _no_place() -> list[Column]:
    """n and i of a class of the library or of merged runs: it comes before every batch."""
    return [F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("i")]


class HashForest:
    """The persisted history below one folder: sorted runs of labels, classes and members.

    ``open`` continues with what an earlier session has written. A run holds ``labels`` (key, ckey),
    ``classes`` (key, class, digest, pieces, and n, i: batch and id of the first file), its ``common`` pieces, and ``members`` (key, class, id):
    the accepted files. What is in ``classes`` without a member was not accepted.
    """

    def __init__(self, spark: SparkSession, folder: str, config: ForestConfig = ForestConfig()):
        self.spark, self.folder, self.config = spark, folder, config
        self.runs: list[dict] = []
        self.written = 0
        self._indices: dict[tuple[str, str], tuple] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "HashForest":
        fs, at = file_system(folder)
        with fs.open_input_stream(f"{at}/state.json") as f:
            state = json.loads(f.read())
        forest = cls(spark, folder, ForestConfig(**state["config"]))
        forest.runs, forest.written = state["runs"], state["written"]
        return forest

    def _save(self) -> None:
        """The list of runs, replaced as a whole: a session that ends before has changed nothing."""
        fs, at = file_system(self.folder)
        with fs.open_output_stream(f"{at}/state.new") as f:
            f.write(json.dumps({"config": asdict(self.config), "runs": self.runs, "written": self.written}).encode())
        fs.move(f"{at}/state.new", f"{at}/state.json")

    def _new(self, kind: str) -> str:
        self.written += 1
        return f"{kind}-{self.written}"

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _read(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[part]).parquet(self._path(name, part))

    def _written(self, df: DataFrame, name: str, part: str) -> DataFrame:
        df.write.parquet(self._path(name, part))
        return self._read(name, part)

    def _index(self, names: list[str], part: str) -> dict[int, tuple]:
        for name in names:
            if (name, part) not in self._indices:
                self._indices[name, part] = index_of(self._path(name, part))
        return {i: self._indices[name, part] for i, name in enumerate(names)}

    # -- writing --------------------------------------------------------------------------

    def _write_classes(self, name: str, classes: DataFrame, n: int) -> None:
        """Classes, common pieces and labels of a run; ``classes``: (class, digest, pieces, n, i)."""
        rows = classes.select(class_key("class").alias("key"), "class", "digest", "pieces", F.col("n").cast("int").alias("n"), F.col("i").cast("long").alias("i"))
        write_sorted(rows, self._path(name, "classes"), n, "class")
        stored = self._read(name, "classes")
        often = stored.select(F.explode("pieces").alias("p")).groupBy("p").count().where(F.col("count") > self.config.common)
        often.select("p").write.parquet(self._path(name, "common"))
        sets = self._split(stored, [name]).select("ckey", "dkey", "rare", "common")
        labels = sets.mapInArrow(_storing(self.config), "key long, ckey long")
        write_sorted(labels, self._path(name, "labels"), n * (self.config.trees + 1), "ckey")

    def _split(self, classes: DataFrame, names: list[str]) -> DataFrame:
        """(run, ckey, dkey, rare, common): each set by each run's common pieces."""
        sets = classes.select(F.col("key").alias("ckey"), F.shiftrightunsigned(F.xxhash64("digest"), 64 - LABEL_BITS).alias("h"), "digest", "pieces")
        sets = sets.select("ckey", F.when(F.col("digest").isNotNull(), F.col("h")).alias("dkey"), F.coalesce("pieces", F.array().cast("array<bigint>")).alias("pieces"))
        common = reduce(DataFrame.unionByName, [self._read(n, "common").withColumn("run", F.lit(i)) for i, n in enumerate(names)])
        hits = sets.select("ckey", F.explode("pieces").alias("p")).join(common, "p").groupBy("ckey", "run").agg(F.collect_set("p").alias("hit"))
        rows = sets.withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(len(names))]))).join(hits, ["ckey", "run"], "left")
        none = F.array().cast("array<bigint>")
        shared = F.array_intersect("pieces", F.coalesce("hit", none))
        return rows.select("run", "ckey", "dkey", F.array_except("pieces", shared).alias("rare"), shared.alias("common"))

    def _append(self, name: str, members: DataFrame, n: int, classes: int) -> None:
        write_sorted(members.select(class_key("class").alias("key"), "class", "id"), self._path(name, "members"), n, "id")
        self.runs.append({"name": name, "level": max(0, math.ceil(math.log(max(1, classes), self.config.fanout)))})
        self._save()

    def build(self, files: DataFrame) -> "HashForest":
        """Index an accepted library: (id, digest, pieces), one row per id."""
        name = self._new("run")
        rows = self._written(content_classes(files), name, "files")
        n = rows_of(self._path(name, "files"))
        self._write_classes(name, rows.groupBy("class").agg(F.first("digest").alias("digest"), F.first("pieces").alias("pieces")).select("*", *_no_place()), n)
        self._append(name, rows, n, rows_of(self._path(name, "classes")))
        delete(self._path(name, "files"))
        return self

    def merge_runs(self) -> None:
        """Merge the runs of any level that has ``fanout`` of them into one run of the next level."""
        while True:
            levels = [r["level"] for r in self.runs]
            full = [lv for lv in set(levels) if levels.count(lv) >= self.config.fanout]
            if not full:
                return
            old = [r for r in self.runs if r["level"] == min(full)]
            name = self._new("run")
            read = lambda part: reduce(DataFrame.unionByName, [self._read(r["name"], part) for r in old])
            members = read("members")
            n = sum(rows_of(self._path(r["name"], "members")) for r in old)
            accepted = members.select("class").distinct()
            classes = read("classes").join(accepted, "class", "left_semi").groupBy("class").agg(F.first("digest").alias("digest"), F.first("pieces").alias("pieces")).select("*", *_no_place())
            self._write_classes(name, classes, n)
            self.runs = [r for r in self.runs if r not in old]
            self._append(name, members, n, self.config.fanout ** (min(full) + 1))
            for r in old:  # the new list is stored: nothing refers to them
                delete(self._path(r["name"]))

    # -- searching ------------------------------------------------------------------------

    def _candidates(self, classes: DataFrame, names: list[str]) -> DataFrame:
        """(run, q, ckey): keys of the classes of the batch and of those found in the runs."""
        labels = self._index(names, "labels")
        asked = self._split(classes, names).mapInArrow(_asking(self.config, labels), f"{RANGE}, q long")
        return search(asked, self.folder, labels, ["q"], ["ckey"], "run int, q long, ckey long").distinct()

    def _verified(self, classes: DataFrame, names: list[str]) -> DataFrame:
        """(run, q, qn, qi, a, an, ai): classes of the batch and those of the runs which they match, with their first files."""
        stored = self._index(names, "classes")
        placed = self._candidates(classes, names).mapInArrow(_placing(stored, "ckey", ["q"]), f"{RANGE}, q long")
        columns = ["class", "digest", "pieces", "n", "i"]
        found = search(placed, self.folder, stored, ["q"], columns, "run int, q long, a binary, d string, y array<long>, an int, ai long")
        mine = classes.select(F.col("key").alias("q"), "class", "digest", F.col("pieces").alias("x"), F.col("n").alias("qn"), F.col("i").alias("qi"))
        shared = F.size(F.array_intersect("x", "y"))
        similar = shared >= self.config.threshold * (F.size("x") + F.size("y") - shared)
        return (
            found.join(mine, "q").where((F.col("digest") == F.col("d")) | F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), similar))
            .select("run", F.col("class").alias("q"), "qn", "qi", "a", "an", "ai").distinct()
        )

    def _members(self, matches: DataFrame, names: list[str]) -> DataFrame:
        """(q, accepted_id): the accepted files of the classes matched."""
        stored = self._index(names, "members")
        keyed = matches.select("run", "q", "a", class_key("a").alias("ckey"))
        placed = keyed.mapInArrow(_placing(stored, "ckey", ["q", "a"]), f"{RANGE}, q binary, a binary")
        found = search(placed, self.folder, stored, ["q", "a"], ["class", "id"], "run int, q binary, a binary, class binary, id long")
        return found.where("a = class").select("q", F.col("id").alias("accepted_id"))

    def check(self, batch: DataFrame) -> DataFrame:
        """(case_id, accepted_id) of new files (id, digest, pieces[, batch_no]).

        Files go by batch_no, then id; one batch or several may be given. A file that matches no
        accepted file is accepted, counts for the later ones and joins the history as part of a
        new run. Classes of equal content are decided together, by their first file.
        """
        if "batch_no" not in batch.columns:
            batch = batch.withColumn("batch_no", F.lit(0))
        step = self._new("step")
        files = self._written(arriving(batch), step, "files")
        return self._check(files, rows_of(self._path(step, "files")), step)

    def _check(self, files: DataFrame, n: int, step: str) -> DataFrame:
        """``check`` of ``n`` stored files with their classes; ``step`` names the folder of what lies between."""
        name = self._new("run")
        told = files.where("digest is not null or pieces is not null")
        first = F.min(F.struct("batch_no", "id"))
        grouped = told.groupBy("class").agg(F.first("digest").alias("digest"), F.first("pieces").alias("pieces"), first["batch_no"].alias("n"), first["id"].alias("i"))
        self._write_classes(name, grouped, n)
        classes = self._read(name, "classes")
        history = [r["name"] for r in self.runs]
        own = len(history)
        matches = self._verified(classes, [*history, name])
        found = matches.where((F.col("run") == own) & (F.col("q") != F.col("a"))).drop("run")
        if history:  # of earlier runs the accepted files, of the batch itself the classes
            stored = self._members(matches.where(F.col("run") < own), history)
            found = found.unionByName(stored.select("q", F.col("accepted_id").alias("ai")), allowMissingColumns=True)
        found = self._written(found.select("q", "qn", "qi", "a", "an", "ai"), step, "found")
        old, edges = found.where("a is null"), found.where("a is not null")
        blocked = old.select(F.col("q").alias("class")).distinct()
        before = edges.where("struct(an, ai) < struct(qn, qi)").select("q", "a")
        both = before.join(blocked.withColumnRenamed("class", "q"), "q", "left_anti").join(blocked.withColumnRenamed("class", "a"), "a", "left_anti")
        free = classes.select("class").join(blocked, "class", "left_anti")
        chosen = self._decide(free, both, step).join(classes.select("class", F.col("i").alias("id")), "class")
        self._append(name, chosen, n, rows_of(self._path(name, "classes")))
        accepted = self._read(name, "members").select("class")
        near = edges.join(accepted.withColumnRenamed("class", "a"), "a", "left_semi").select("q", "an", "ai")
        same = classes.join(accepted, "class", "left_semi").select(F.col("class").alias("q"), F.col("n").alias("an"), F.col("i").alias("ai"))
        member = told.select(F.col("class").alias("q"), "batch_no", "id")
        # files without digest and pieces match nothing and are accepted; nothing can match them
        pairs = (
            old.select("q", "an", "ai").unionByName(near).unionByName(same).join(member, "q")
            .where("an is null or struct(an, ai) < struct(batch_no, id)")
            .select(F.col("id").alias("case_id"), F.col("ai").alias("accepted_id"))
        )
        out = self._written(pairs, step, "pairs")
        for part in ("files", "found", "edges"):
            delete(self._path(step, part))
        self.merge_runs()
        return out

    def _decide(self, free: DataFrame, edges: DataFrame, step: str) -> DataFrame:
        """The classes of ``free`` accepted when going through them in order; ``edges`` (q, a): a comes before q.

        Rounds: a class none of whose earlier neighbours is undecided or accepted is accepted; one
        with an accepted earlier neighbour is a case. Every round decides at least the first
        undecided class of each component, so they end with the longest chain inside a batch.
        """
        edges = self._written(edges, f"{step}/edges/0", "edges")
        open_rows = rows_of(self._path(step, "edges/0/edges"))
        later = edges.select(F.col("q").alias("class")).distinct()
        accepted = [free.join(later, "class", "left_anti") if open_rows else free]
        fresh, rounds = accepted[0], 0
        while open_rows:
            hit = edges.join(fresh.select(F.col("class").alias("a")), "a", "left_semi").select("q").distinct()
            left = edges.join(hit, "q", "left_anti")
            open_ = left.join(hit.withColumnRenamed("q", "a"), "a", "left_anti")
            freed = left.select("q").distinct().join(open_.select("q"), "q", "left_anti")
            rounds += 1
            at = f"{step}/edges/{rounds}"
            # one written table a round: the edges still open, and (without a) the classes accepted
            both = self._written(open_.select("q", "a").unionByName(freed.select("q", F.lit(None).cast("binary").alias("a"))), at, "edges")
            edges, fresh = both.where("a is not null"), both.where("a is null").select(F.col("q").alias("class"))
            accepted.append(fresh)
            open_rows = rows_of(self._path(at, "edges"), "a")
        return reduce(DataFrame.unionByName, accepted)

    def close(self) -> None:
        """Delete all runs; the pairs found stay."""
        for r in self.runs:
            delete(self._path(r["name"]))
        self.runs = []
        self._save()


def batch_matches(library: DataFrame, batches: DataFrame, config: ForestConfig = ForestConfig(), backlog: bool = True) -> DataFrame:
    """Problem 4: (asset_id_a, asset_id_b), each case with every accepted file it matches.

    Defined results: of one asset_id in the library the latest indexed_at counts, of one in the
    batches the first batch (earliest delivery); null ids or batch numbers are left out; digests of
    hashes that did not complete, and null or empty pieces, say nothing. An empty library or no
    batches are fine. All batches delivered so far are a ``backlog`` and checked in one call, in which
    the files go by batch number; without it each batch is checked on its own, against the runs
    persisted before it, which gives the same pairs.
    """
    from lumenfold.functions.identity import digest

    spark = library.sparkSession
    known = F.when(F.lower(F.trim(F.col("hash_status"))) == "completed", digest(F.col("sha256")))
    row = lambda df, *more: df.where("asset_id is not null").select(F.col("asset_id").alias("id"), known.alias("digest"), F.col("chunk_sums").alias("pieces"), *more)
    lib = row(library, "indexed_at").groupBy("id").agg(F.max(F.struct("indexed_at", "digest", "pieces")).alias("b")).select("id", "b.digest", "b.pieces")
    new = row(batches.where("batch_no is not null"), "batch_no", "delivered_at").groupBy("id").agg(
        F.min(F.struct("batch_no", "delivered_at", "digest", "pieces")).alias("b")
    ).select("id", "b.batch_no", "b.digest", "b.pieces")
    forest = HashForest(spark, scratch_path(spark, "forest"), config)
    delivered = f"{forest.folder}/delivered"
    rows = arriving(new.join(lib, "id", "left_anti")).withColumn("n", F.lit(0) if backlog else F.col("batch_no"))
    (rows if backlog else rows.repartition("n", F.pmod(F.xxhash64("id"), F.lit(8)))).write.partitionBy("n").parquet(delivered)
    forest.build(lib)
    spark.createDataFrame([], SCHEMAS["pairs"]).write.parquet(f"{forest.folder}/step-0/pairs")
    steps = [f"{forest.folder}/step-0/pairs"]
    for n in sorted(folders(delivered, "n")):
        step = forest._new("step")
        stored = spark.read.schema(SCHEMAS["files"]).parquet(f"{delivered}/n={n}")
        forest._check(stored, rows_of(f"{delivered}/n={n}"), step)
        steps.append(f"{forest.folder}/{step}/pairs")
    out = spark.read.schema(SCHEMAS["pairs"]).parquet(*steps)
    forest.close()
    delete(delivered)
    return out.select(
        F.least("case_id", "accepted_id").alias("asset_id_a"), F.greatest("case_id", "accepted_id").alias("asset_id_b")
    )
