"""N-gram Jaccard join with a MinHash LSH forest (Bawa, Condie and Ganesan 2005).

A document is its set of 5-word shingles (all its words together if it has fewer). Documents with equal
sets are one class. Classes are signed with MinHash; the signature is dealt to trees, a run of values each,
and a tree is a prefix trie of its classes' runs: distinct runs sorted by tree and run, with nodes at every
depth by aggregation over prefixes. Candidates first are classes that share a longest prefix (a node of
more than one class at the greatest depth). Signatures of candidates are compared: the weakest band of
estimated similarity, at the threshold or above, in which candidates were found must be found with the
target recall. As long as a prefix of the current depth finds too few of that band, prefixes are shortened
to the depth that would find enough, and candidates are gathered and measured anew. Without any candidate
the band at the threshold itself is taken.

Candidates are verified exactly, on the shingle sets themselves, in units of which each is cheaper: a
whole connected component of shared prefixes (all its pairs are compared), or each of its nodes by itself
(a pair is counted in the first tree where it shares a prefix). A unit is compared within one task, or a
large one in pairs of blocks, each pair of classes once. What leaves a task is a row per class: its number
of links and the smallest class it is connected with, never pairs.

Defined results: a null text has no words; documents without words are copies of each other and similar
to nothing else; repeated rows are copies; a row with a null id takes part, and stays only if all in its
group have null ids; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, reclaim, release, table, text_or_empty
from tessera.llm.components import components
from tessera.llm.words import U, batches, inside, mix, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST_PREFIX, RECALL = 20, 6, 0.9995
#: Classes of a candidate group that one task compares with each other, and with another block.
BLOCK = 1024
#: Classes of small candidate groups in one task.
TASK_CLASSES = 1500
BATCH_BYTES = 4 << 20


def prefix_recall(similarity: float, trees: int, depth: int) -> float:
    """How probably a pair shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix that finds pairs of that similarity with the target recall."""
    return max((d for d in range(1, longest + 1) if prefix_recall(similarity, trees, d) >= recall), default=1)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts)
    hashes = window_hashes(words, size)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(hashes[lo : hi - size + 1])
        elif hi > lo:
            yield window_hashes(words[lo:hi], hi - lo)
        else:
            yield np.empty(0, U)


def signatures(sets: list[np.ndarray], values: int) -> np.ndarray:
    """MinHash values by set; sets aren't empty."""
    seeds = mix(np.arange(1, 2 * values + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    times, plus = seeds[:values] | U(1), seeds[values:]
    out, lo = np.empty((len(sets), values), U), 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) <= 32_768):
            held += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        for k in range(values):
            out[lo:hi, k] = np.minimum.reduceat((flat ^ plus[k]) * times[k], starts)
        lo = hi
    return out


def _signed(rows: DataFrame, shingle: int, values: int) -> DataFrame:
    """rid, id, h, n, d1, d2, runs: d1 and d2 are a digest of the whole set, runs the signature (16 bits a value, big-endian)."""

    def sign(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in batches(arrow, BATCH_BYTES):
            sets = list(shingle_sets(texts, shingle))
            some = [s for s in sets if len(s)]
            runs = iter((mix(signatures(some, values)) >> U(48)).astype(">u2") if some else [])
            out = [(*name, len(s), int(s.sum().view(np.int64)) if len(s) else 0, int(mix(s ^ U(0x5851F42D4C957F2D)).sum().view(np.int64)) if len(s) else 0, next(runs).tobytes() if len(s) else b"") for name, s in zip(names, sets, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["rid", "id", "h", "n", "d1", "d2", "runs"])

    return rows.select("rid", "id", "h", "text").mapInArrow(sign, "rid long, id long, h long, n long, d1 long, d2 long, runs binary")


def _runs(classes: DataFrame, trees: int, longest: int) -> DataFrame:
    """cid, tree, run: a class's run of values in each tree."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("runs", t * (2 * longest) + 1, F.lit(2 * longest)))
    return classes.where("n > 0").select("cid", F.posexplode(runs).alias("tree", "run"))


def _prefix(depth: int):
    return F.substring("run", 1, 2 * depth).alias("prefix")


def _forest(classes: DataFrame, trees: int, longest: int) -> DataFrame:
    """tree, run, m (smallest class), n (classes): the tries' leaves, sorted."""
    leaves = _runs(classes, trees, longest).groupBy("tree", "run").agg(F.min("cid").alias("m"), F.count(F.lit(1)).alias("n"))
    return materialize(leaves.repartitionByRange("tree", "run").sortWithinPartitions("tree", "run"), "op10-forest")


def _members(classes: DataFrame, forest: DataFrame, depth: int, trees: int, longest: int) -> DataFrame:
    """cid, tree, node, m, many: classes and the nodes of several classes at the depth that they are in."""
    nodes = forest.groupBy("tree", _prefix(depth)).agg(F.min("m").alias("m"), F.sum("n").alias("many")).where("many > 1")
    nodes = materialize(nodes, "op10-nodes")
    found = _runs(classes, trees, longest).select("cid", "tree", _prefix(depth)).join(nodes.hint("merge"), ["tree", "prefix"])
    return materialize(found.select("cid", "tree", F.xxhash64("tree", "prefix").alias("node"), "m", "many"), "op10-members")


def _groups(members: DataFrame) -> DataFrame:
    """cid, comp: the component of each class that shares a prefix."""
    found = components(members.select(F.col("cid").alias("u"), F.col("m").alias("v")))
    heads = found.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct()
    return materialize(found.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(heads), "op10-groups")


def _units(members: DataFrame | None, groups: DataFrame, block: int) -> DataFrame:
    """cid, unit, tree, blocks: what is compared together. tree is -1 for a whole component; with members, nodes
    take the place of components that cost more."""
    whole = materialize(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("many")), "op10-sizes")
    sizes = whole.withColumn("nodes", F.lit(None).cast("double"))
    if members is not None:
        cost = lambda n: n.cast("double") * F.ceil(n / block)
        nodes = members.where("cid = m").select("cid", "many").join(groups, "cid").groupBy("comp").agg(F.sum(cost(F.col("many"))).alias("nodes"))
        sizes = materialize(whole.join(materialize(nodes, "op10-costs"), "comp", "left").withColumn("nodes", F.when(F.col("nodes") < cost(F.col("many")), F.col("nodes"))), "op10-choice")
    blocks = F.ceil(F.col("many") / block).alias("blocks")
    out = groups.join(sizes.where("nodes is null"), "comp").select("cid", F.col("comp").alias("unit"), F.lit(-1).alias("tree"), blocks)
    if members is not None:
        split = groups.join(sizes.where("nodes is not null").select("comp"), "comp").select("cid")
        out = out.unionByName(members.join(split, "cid").select("cid", F.col("node").alias("unit"), "tree", blocks))
    return materialize(out, "op10-units")


def _placed(units: DataFrame) -> DataFrame:
    """Units in tasks: small units together, large ones in pairs of blocks. Adds block, i, other, task."""
    tasks = max(1, -(-units.where("blocks = 1").count() // TASK_CLASSES))
    own = F.pmod(F.xxhash64(F.col("cid"), F.lit(7)), F.col("blocks"))
    placed = units.withColumn("block", own).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "partner"), F.greatest("block", "partner")
    return placed.withColumns({"i": low, "other": high - low, "task": F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(tasks))).otherwise(F.xxhash64("unit", "tree", low, high))})


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the classes of a unit, or of two blocks of one, that are compared with each other."""
    block, every = rows["block"].to_numpy(), np.arange(len(rows))
    if not (block == block[0]).all():
        return every[block == block.min()], every[block != block.min()]
    return (every[:0], every[:0]) if int(rows["other"].iloc[0]) else (every, every)  # the other block may be empty


def _agreeing(rows: pd.DataFrame, values: int) -> np.ndarray:
    """Pairs by the number of equal values of their signatures."""
    left, right = _sides(rows)
    runs = np.frombuffer(b"".join(rows["runs"]), "<u2").reshape(len(rows), values)
    equal = np.zeros((len(left), len(right)), np.uint16)
    for k in range(values if len(left) else 0):
        equal += runs[left, k][:, None] == runs[right, k][None, :]
    counts = np.bincount(equal.ravel(), minlength=values + 1)
    if left is right:
        counts[values] -= len(left)
        counts //= 2
    return counts


def _weakest(classes: DataFrame, groups: DataFrame, threshold: float, values: int, block: int) -> float:
    """The least estimated similarity, at the threshold or above, that candidates have; the threshold if there are none."""

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(values + 1, np.int64)
        for _, part in group.groupby(["unit", "i", "other"], sort=False):
            counts += _agreeing(part.drop_duplicates("cid"), values)
        return pd.DataFrame({"equal": np.arange(values + 1), "pairs": counts})

    placed = _placed(_units(None, groups, block)).join(classes.select("cid", "runs").hint("merge"), "cid")
    found = placed.groupBy("task").applyInPandas(measure, "equal long, pairs long").where((F.col("pairs") > 0) & (F.col("equal") >= threshold * values))
    return (found.agg(F.min("equal")).first()[0] or threshold * values) / values


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right."""
    if len(left) * len(right) <= 100:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left]).reshape(len(left), len(right))
    used = np.unique(np.concatenate((left, right)))
    flat, of = np.concatenate([sets[i] for i in used]), np.repeat(used, [len(sets[i]) for i in used])
    kinds, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[code] > 1  # a shingle of one set is in no intersection
    of, code = of[shared], np.unique(code[shared], return_inverse=True)[1]
    place = np.zeros(len(sets), np.int64)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(code.max(initial=-1)) + 1, 4096):
        now = (code >= lo) & (code < lo + 4096)
        dense = np.zeros((len(used), 4096), np.float32)
        place[used] = np.arange(len(used))
        dense[place[of[now]], code[now] - lo] = 1
        out += dense[place[left]] @ dense[place[right]].T
    return out.astype(np.int64)


def _first_shared(runs: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Which pairs share a prefix in that tree, and in none before it. runs: values by class, tree and place."""
    same = lambda t: (runs[left, t, :depth][:, None] == runs[right, t, :depth][None]).all(axis=2)
    out = same(tree)
    for t in range(tree):
        out &= ~same(t)
    return out


def _verify(rows: pd.DataFrame, threshold: float, shingle: int, trees: int, depth: int) -> list[tuple[int, int, int]]:
    """cid, linked documents, smallest connected class: of one unit, or of two blocks of one."""
    rows = rows.drop_duplicates("cid").sort_values("cid")
    left, right = _sides(rows)
    if not len(left):
        return []
    cids, sizes, tree = rows["cid"].to_numpy(), rows["size"].to_numpy(), int(rows["tree"].iloc[0])
    sets = list(shingle_sets([t.encode("utf-8", "surrogatepass") for t in rows["text"]], shingle))
    n = np.array([len(s) for s in sets])
    both = _overlaps(sets, left, right)
    total = n[left][:, None] + n[right][None, :]
    linked = both * (1 + threshold) >= threshold * total - 1e-9
    if tree >= 0:
        linked &= _first_shared(np.frombuffer(b"".join(rows["runs"]), "<u2").reshape(len(rows), trees, -1), left, right, tree, depth)
    if left is right:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(cids), np.int64)
    np.add.at(links, left, linked @ sizes[right])
    if left is not right:
        np.add.at(links, right, linked.T @ sizes[left])
    root = np.arange(len(cids))
    while True:  # smallest connected class: the classes are sorted, so places do for numbers
        new = root.copy()
        np.minimum.at(new, left, np.where(linked, root[right][None, :], len(cids)).min(axis=1, initial=len(cids)))
        np.minimum.at(new, right, np.where(linked, root[left][:, None], len(cids)).min(axis=0, initial=len(cids)))
        new = new[new]
        if (new == root).all():
            break
        root = new
    return list(zip(cids.tolist(), links.tolist(), cids[root].tolist(), strict=True))


def candidates(classes: DataFrame, threshold: float, trees: int, longest: int, recall: float, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Members of nodes and groups of classes (cid, n, runs) at the depth, which is the last one, that reaches the recall."""
    forest, depth = _forest(classes, trees, longest), longest
    while True:
        members = _members(classes, forest, depth, trees, longest)
        groups = _groups(members)
        enough = prefix_depth(_weakest(classes, groups, threshold, trees * longest, block), trees, longest, recall)
        if enough >= depth:
            release(forest)
            return members, groups, depth
        release(members, groups)
        depth = enough


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, trees: int = TREES, longest: int = LONGEST_PREFIX, recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, class_id (smallest doc_id of its group of near duplicates), class_size,
    n_links (other documents at the threshold or above), text_class_id and text_class_size (documents with
    the same shingles), keep (one row of each group), text_hash."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("text"))
    signed = materialize(_signed(rows, shingle, trees * longest), "op10-signed")

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "h")).alias("first")
    grouped = signed.groupBy("n", "d1", "d2").agg(first, F.count(F.lit(1)).alias("size"), F.first("runs").alias("runs"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "op10-classes")

    members, groups, depth = candidates(classes, threshold, trees, longest, recall, block)
    reclaim(spark)
    placed = _placed(_units(members, groups, block)).join(classes.select("cid", "size", "first", "runs").hint("merge"), "cid")
    placed = placed.withColumn("runs", F.when(F.col("tree") >= 0, F.col("runs")).otherwise(F.lit(b"")))
    same = F.expr("a.id <=> b.first.id and a.h = b.first.h")
    texts = rows.select("id", "h", "text").alias("a").join(placed.hint("merge").alias("b"), same).select("b.cid", "b.unit", "b.tree", "b.runs", "b.size", "b.block", "b.i", "b.other", "b.task", "a.text")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        for _, part in group.groupby(["unit", "tree", "i", "other"], sort=False):
            out += _verify(part, threshold, shingle, trees, depth)
        return pd.DataFrame(out, columns=["cid", "links", "root"]).astype("int64")

    verified = materialize(texts.groupBy("task").applyInPandas(verify, "cid long, links long, root long"), "op10-verified")
    links = materialize(verified.groupBy("cid").agg(F.sum("links").alias("links")), "op10-links")
    roots = components(verified.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"u": "cid", "v": "root"})

    found = classes.select("cid", "n", "d1", "d2", "size", "first").join(roots, "cid", "left").join(links, "cid", "left")
    found = materialize(found.withColumn("root", F.coalesce("root", "cid")), "op10-found")
    heads = found.groupBy("root").agg(F.min("first").alias("head"), F.sum("size").alias("class_size"))
    found = found.join(materialize(heads, "op10-heads"), "root").select("n", "d1", "d2", "size", "first", "head", "class_size", "links")
    out = signed.select("rid", "id", "h", "n", "d1", "d2").join(materialize(found, "op10-classes-found"), ["n", "d1", "d2"])
    release(groups, members, verified, links, classes)
    return out.select(
        F.col("id").alias("doc_id"), F.col("head.id").alias("class_id"), "class_size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.col("first.id").alias("text_class_id"), F.col("size").alias("text_class_size"), (F.col("rid") == F.col("head.rid")).alias("keep"), F.col("h").alias("text_hash"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
