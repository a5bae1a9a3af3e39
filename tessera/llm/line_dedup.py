"""Line dedup with a log-template tree of fixed depth.

A line is parsed down the tree by its token count, then by its leading tokens, then to its templates. The
first template is the line with every token that holds a digit generalised to a variable field. Further
fields are found in leaves. A leaf is a token count and a run of tokens at its place: the leading tokens,
and ANCHORS - 1 more runs spread over the line, so that a line whose leading tokens are fields themselves
is in some leaf with its like. In a leaf the distinct lines with each token are counted by position; a
token that at least DOMINANT of them have is constant and the others are fields, and a template has more
than CONSTANT of its tokens constant. A template that at least MIN_DOCS documents hold is recurring; lines
with a recurring template are dropped from all documents. Unlike similarity merging in the leaves of such
a tree, the result doesn't depend on the order of lines and needs no leaf in one place: counting tokens
and templates is aggregation. Not found are templates with a field in each of their line's runs.

Defined results: a null text has no lines; blank lines have no template and stay; a line that one
document repeats counts once for it; repeated rows count as documents of their own; rows with null ids
take part; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, table, text_or_empty
from tessera.llm.words import U, batches, mix, span_hashes, word_hashes

LEADING, MIN_DOCS = 2, 3
ANCHORS, DOMINANT, CONSTANT = 4, 0.5, 0.5
#: Lines of a leaf that one task counts.
LEAF_PART = 50_000
VARIABLE = U(0x2545F4914F6CDD1D)


def line_templates(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First template's key by line; 0 for a line without words."""
    starts, ends = bounds[:-1], bounds[1:]
    n = ends - starts
    branch = mix(n.astype(U) * U(0x9E3779B97F4A7C15) + span_hashes(words, starts, np.minimum(starts + LEADING, ends)))
    return np.where(n > 0, mix(branch + span_hashes(words, starts, ends)), U(0))


def line_leaves(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of lines of three words and more, and how many each has. Short lines have as many as they have adjacent pairs."""
    start, n = bounds[:-1], np.diff(bounds)
    size, count = np.maximum(LEADING, n // (2 * ANCHORS)), np.minimum(n - 1, ANCHORS)
    at = np.minimum(np.arange(ANCHORS) * (n - size)[:, None] // np.maximum(count - 1, 1)[:, None], (n - size)[:, None])
    a = start[:, None] + at
    leaf = mix(span_hashes(words, a.ravel(), (a + size[:, None]).ravel()).reshape(a.shape) + mix(n.astype(U))[:, None] + at.astype(U) * U(0x9E3779B97F4A7C15))
    return leaf[np.arange(ANCHORS) < count[:, None]], count


def _lines(rows: DataFrame) -> DataFrame:
    """id, h, line (place), key, fresh (whether no earlier line of the document has the key). The first line of a batch with
    a key, if it has three words or more, also has held (how many documents of the batch hold the key), leaves, and tokens
    (four bytes of each hash)."""

    def parse(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in batches(arrow, 2 << 20):
            split = [t.split(b"\n") for t in texts]
            words, bounds = word_hashes([line for x in split for line in x], VARIABLE)
            key, n = line_templates(words, bounds), np.diff(bounds)
            many = np.array([len(x) for x in split])
            of = np.repeat(np.arange(len(split)), many)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            fresh = np.zeros(len(key), bool)
            fresh[np.unique(mix(key + mix(of.astype(U) + U(1))), return_index=True)[1]] = True
            _, some, kind = np.unique(key, return_index=True, return_inverse=True)
            held, first = np.bincount(kind, weights=fresh).astype(np.int64)[kind], np.zeros(len(key), bool)
            first[some] = True
            first &= n > 2
            cuts = np.append(0, np.cumsum(n[first]))
            own = words[np.repeat(bounds[:-1][first] - cuts[:-1], n[first]) + np.arange(cuts[-1])]
            leaf, count = line_leaves(own, cuts)
            tokens = (own >> U(32)).astype("<u4").tobytes()
            whole, wide = np.flatnonzero(n > 0), np.zeros(len(key), np.int64)
            wide[first] = count
            absent = pa.array(~first[whole])
            leaves = pa.ListArray.from_arrays(np.append(0, np.cumsum(wide[whole])).astype(np.int32), pa.array(leaf.view(np.int64)), mask=absent)
            wide[first] = 4 * n[first]
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(np.append(0, np.cumsum(wide[whole])).astype(np.int32)), pa.py_buffer(tokens)])
            ids, hs = pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64())
            at = pa.array(of[whole])
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), hs.take(at), pa.array(place[whole].astype(np.int32)), pa.array(key[whole].view(np.int64)), pa.array(fresh[whole]), pa.array(held[whole], mask=~first[whole]), leaves, blobs],
                names=["id", "h", "line", "key", "fresh", "held", "leaves", "tokens"],
            )

    return rows.mapInArrow(parse, "id long, h long, line int, key long, fresh boolean, held long, leaves array<long>, tokens binary")


def _unpacked(members: DataFrame) -> DataFrame:
    """leaf, key, tokens as an array, of which a part is read without copying the whole."""

    def unpack(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            tokens = [np.frombuffer(t.as_py(), "<i4") for t in batch.column("tokens")]
            cuts = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("key"), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.empty(0, "<i4"), *tokens])))], names=["leaf", "key", "tokens"])

    return members.select("leaf", "key", "tokens").mapInArrow(unpack, "leaf long, key long, tokens array<int>")


def _constants(members: DataFrame) -> DataFrame:
    """leaf, constant: places and tokens that at least DOMINANT of the leaf's lines have. Lines are dealt to tasks by
    leaf, those of a large leaf by parts of it, so that only large leaves have counts to be added up."""
    sizes = materialize(members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "op9-sizes")
    dealt = members.join(sizes.hint("merge"), "leaf").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / LEAF_PART)))
    dealt = dealt.repartition("leaf", "part").select("leaf", "part", "n", F.posexplode("tokens").alias("at", "token"))
    enough = F.col("c") >= DOMINANT * F.col("n")
    counts = dealt.groupBy("leaf", "part", "n", "at", "token").agg(F.count(F.lit(1)).alias("c")).where((F.col("n") > LEAF_PART) | enough)
    counts = counts.groupBy("leaf", "n", "at", "token").agg(F.sum("c").alias("c")).where(enough)
    return materialize(counts.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("constant")), "op9-constant")


def _generalised(lines: DataFrame, min_docs: int) -> DataFrame:
    """key: the first templates of lines that have a recurring template of a leaf."""
    distinct = lines.where("held is not null")
    pairs = distinct.select("key", "held", F.explode("leaves").alias("leaf"))
    # No template of a leaf can recur if the leaf has but one line, or lines of fewer documents.
    several = pairs.groupBy("leaf").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("held").alias("held"))
    several = materialize(several.where((F.col("lo") != F.col("hi")) & (F.col("held") >= min_docs)).select("leaf"), "op9-several")
    within = materialize(pairs.select("key", "leaf").join(several.hint("merge"), "leaf").distinct(), "op9-leaves")
    tokens = distinct.select("key", "tokens").join(within.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    members = materialize(_unpacked(within.join(tokens.hint("merge"), "key")), "op9-members")
    release(several, within)
    own = F.filter("constant", lambda x: F.get("tokens", x["at"]) == x["token"])
    found = members.join(_constants(members).hint("merge"), "leaf").withColumn("own", own).where(F.size("own") > CONSTANT * F.size("tokens"))
    templates = materialize(found.select("key", F.xxhash64("leaf", "own").alias("template")), "op9-templates")
    # The key's hash in place of the key: what follows is dealt anew, so that the join can split the lines of a frequent key.
    held = lines.where("fresh").select("id", "h", "key").join(templates.hint("merge"), "key").select("template", "id", "h", F.xxhash64("key").alias("own"))
    copies = held.groupBy("template", "id", "h", "own").count().groupBy("template", "id", "h").agg(F.max("count").alias("n"))  # rows that are repeated
    recurring = copies.groupBy("template").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("template")
    return templates.join(recurring.hint("merge"), "template").select("key")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_lines, n_dropped, kept (the lines that stay)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("text"))
    lines = materialize(_lines(rows), "op9-lines")
    recurring = lines.where("fresh").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("key")
    recurring = materialize(recurring.unionByName(_generalised(lines, min_docs)).distinct(), "op9-recurring")
    hits = lines.select("id", "h", "line", "key").join(recurring.hint("merge"), "key")
    gone = materialize(hits.groupBy("id", "h").agg(F.collect_set("line").alias("gone")), "op9-dropped")

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in batches(arrow, 4 << 20):
            out = []
            for (name, gone), text in zip(names, texts, strict=True):
                every, drop = text.decode("utf-8", "surrogatepass").split("\n") if text else [], set(gone or ())
                kept = [x for i, x in enumerate(every) if i not in drop]
                out.append((name, len(every), len(every) - len(kept), "\n".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_lines", "n_dropped", "kept"])

    same = F.expr("a.id <=> b.id and a.h = b.h")
    return rows.alias("a").join(gone.hint("merge").alias("b"), same, "left").select("a.id", "b.gone", "a.text").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
