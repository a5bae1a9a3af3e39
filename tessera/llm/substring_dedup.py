"""Substring dedup with fixed-block anchors.

A window is 35 consecutive words of one document; each word of a window whose word sequence also starts
elsewhere is removed. Any window of 35 words holds a whole block of 18 words that begins at a multiple of
18. So the non-overlapping blocks of all documents are the reference index, and every rolling window of
18 words of all documents probes it. Where a block's words occur twice, the hit is extended: the windows
of 35 words around it are compared as wholes, and runs of repeated windows are the maximal repeats.

Both comparisons are joins by hash, dealt to tasks by hash in packed form (sorted hashes as differences,
places as three bytes). Equal hashes within a batch of documents are joined before they are dealt, so
that a hash has at most one entry a batch, however frequent it is. The first comparison only narrows
down, so 32 bits beyond the bucket are enough there; the second verifies the words: it compares BLAKE2b
digests of 128 bits of the words themselves (of 10^14 windows, two different ones would agree with a
probability of about 10^-11). A task compares about BUCKET_ENTRIES entries, whatever the size of the input.

Defined results: a null text has no words; a document shorter than a window loses none; repeated rows
are repeats of each other and lose what lies in windows; rows with null ids take part as others do; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, reclaim, table, text_or_empty
from tessera.llm.words import U, batches, give_back, inside, window_hashes, word_hashes

WINDOW = 35
#: Bytes of text that are hashed, sorted and packed together.
BATCH_BYTES = 8 << 20
#: Entries in a bucket, about: what one task compares.
BUCKET_ENTRIES = 2_000_000
PACKED = "bucket long, batch string, n long, hashes binary, checks binary, places binary, docs binary"
KEY = ["g", "z", "h"]
FOUND = "batch string, places binary, docs binary"


def _squeeze(values: np.ndarray) -> bytes:
    """Byte planes of values, compressed."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _docs_blob(rows: list[tuple], bounds: np.ndarray) -> bytes:
    """Ids, text hashes and first words of a batch's documents."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    none = np.array([r[0] is None for r in rows], "<i8")
    return zstandard.compress(np.concatenate((ids, none, np.array([r[1] for r in rows], "<i8"), bounds[:-1].astype("<i8"))).tobytes(), 1)


def _entries(hashes: np.ndarray, checks: np.ndarray | None, places: np.ndarray, anchors: np.ndarray, batch: str, docs: bytes, buckets: int, kept_bits: int) -> Iterator[tuple]:
    """Rows as PACKED. Of equal hashes (and checks, if there are any) one goes to their bucket. What needs no comparison has
    n = -1: places whose hash is repeated within the batch, and the batch's documents."""
    if len(hashes):
        yield int(hashes[0] % U(buckets)), batch, -1, b"", b"", b"", docs
    order, first, counts = _runs(hashes, checks)
    hashes, places, anchors = hashes[order], places[order], anchors[order]
    if (counts > 1).any():
        again = np.sort(places[np.repeat(counts > 1, counts)])
        yield int(again[0]) % buckets, batch, -1, b"", b"", _squeeze(np.diff(again, prepend=0).astype("<u4")), b""
    flag = np.logical_or.reduceat(anchors, first) if len(first) else first.astype(bool)
    hashes, coded = hashes[first], places[first].astype("<u4") * np.uint32(2) + flag
    checks = None if checks is None else checks[order][first].astype("<u8")
    step = (1 << 64) // buckets + 1
    cuts = np.searchsorted(hashes, np.array([min(k * step, (1 << 64) - 1) for k in range(buckets + 1)], U))
    cuts[-1] = len(hashes)
    shift = U(max(0, 64 - max(1, (buckets - 1).bit_length()) - kept_bits))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        own = hashes[lo:hi] >> shift
        yield k, batch, int(hi - lo), _squeeze(np.diff(own, prepend=U(0)).astype("<u8")), b"" if checks is None else checks[lo:hi].tobytes(), _squeeze(coded[lo:hi]), b""


def _runs(hashes: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal entries stand together, where each kind begins in it, and how many there are of each."""
    order = np.argsort(hashes, kind="stable") if checks is None else np.lexsort((checks, hashes))
    new = hashes[order][1:] != hashes[order][:-1]
    if checks is not None:
        new |= checks[order][1:] != checks[order][:-1]
    first = np.flatnonzero(np.concatenate(([True], new))) if len(order) else np.empty(0, np.int64)
    return order, first, np.diff(np.append(first, len(order)))


def _packed(rows: Iterator[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "n", "hashes", "checks", "places", "docs"])


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the places whose hash another batch has as well, with an anchor among them."""
    done, own = rows[rows.n < 0], rows[rows.n >= 0].reset_index(drop=True)
    out = [(b, p, d) for b, p, d in zip(done["batch"], done["places"], done["docs"], strict=True)]
    if len(own) > 1:
        hashes = np.concatenate([np.cumsum(_unsqueeze(x, "<u8"), dtype=U) for x in own["hashes"]])
        checks = np.frombuffer(b"".join(own["checks"]), "<u8") if own["checks"].iloc[0] else None
        coded = np.concatenate([_unsqueeze(x, "<u4") for x in own["places"]])
        of = np.repeat(np.arange(len(own)), own["n"])
        order, first, counts = _runs(hashes, checks)
        good = (counts > 1) & np.bitwise_or.reduceat(coded[order] & 1, first).astype(bool)
        hit = np.sort(order[np.repeat(good, counts)])
        bounds = np.searchsorted(of[hit], np.arange(len(own) + 1))
        for i in range(len(own)):
            if bounds[i] < bounds[i + 1]:
                places = np.sort(coded[hit[bounds[i] : bounds[i + 1]]] >> 1)
                out.append((own["batch"][i], _squeeze(np.diff(places, prepend=0).astype("<u4")), b""))
        del hashes, checks, coded, of, order, hit
        give_back()
    return pd.DataFrame(out, columns=["batch", "places", "docs"])


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one batch: the places found, by document."""
    found = [np.cumsum(_unsqueeze(x, "<u4"), dtype=np.int64) for x in rows["places"] if x]
    if not found:
        return pd.DataFrame({"id": pd.array([], "Int64"), "h": np.empty(0, np.int64), "found": []})
    docs = np.frombuffer(zstandard.decompress(next(x for x in rows["docs"] if x)), "<i8").reshape(4, -1)
    places = np.unique(np.concatenate(found))
    of = np.searchsorted(docs[3], places, side="right") - 1
    which, first = np.unique(of, return_index=True)
    ends = np.append(first[1:], len(places))
    out = [(None if docs[1, d] else int(docs[0, d]), int(docs[2, d]), _squeeze(np.diff(places[a:b] - docs[3, d], prepend=0).astype("<u4"))) for d, a, b in zip(which, first, ends, strict=True)]
    return pd.DataFrame(out, columns=["id", "h", "found"]).astype({"id": "Int64"})


def _matches(packed: DataFrame, label: str, buckets: int, many: int) -> DataFrame:
    """id, h, found (places of a document, packed) of all entries that are equal. many: about how many batches there are."""
    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_compare, FOUND)
    return materialize(found.repartition(many, "batch").groupBy("batch").applyInPandas(_by_document, "id long, h long, found binary"), label)


def _digests(texts: list[bytes], bounds: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of the windows that start at these words (ascending) of the texts."""
    out, first = [], np.searchsorted(starts, bounds)
    for text, lo, a, b in zip(texts, bounds[:-1].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a < b:
            words = text.split()
            line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
            at = starts[a:b] - lo
            out += [blake2b(line[i:j], digest_size=16).digest() for i, j in zip((ends[at] - [len(words[k]) + 1 for k in at.tolist()]).tolist(), (ends[at + window - 1] - 1).tolist(), strict=True)]
    both = np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)
    return both[:, 0].astype(U), both[:, 1].astype(U)


def _places(blob: bytes | None) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob, "<u4"), dtype=np.int64) if blob else np.empty(0, np.int64)


def _spread(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n words lie from before places ahead of a place to after places behind it."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(places - before, 0), 1)
    np.add.at(edge, np.minimum(places + after + 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"g": F.coalesce("id", F.lit(-1)), "z": F.col("id").isNull()})


def _once(found: DataFrame) -> DataFrame:
    """One row a document: repeated rows have the same places, each as repeats of the others. The join's exchange serves here too."""
    return _keyed(found).dropDuplicates(KEY).select(*KEY, "found")


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    block = (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, many = max(4, size // 6 // bucket_entries + 1), max(4, size // batch_bytes + 1)

    def probe(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (names, texts) in enumerate(batches(arrow, batch_bytes)):
            words, bounds = word_hashes(texts)
            own = np.flatnonzero(inside(bounds, block))
            first = np.repeat(bounds[:-1], np.diff(bounds))
            hashes = window_hashes(words, block)[own]
            yield _packed(_entries(hashes, None, own, (own - first[own]) % block == 0, f"{task}-{k}", _docs_blob(names, bounds), buckets, 32))

    hits = _matches(rows.mapInArrow(probe, PACKED), "op6-hits", buckets, many)
    reclaim(docs.sparkSession)

    def extend(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (names, texts) in enumerate(batches(arrow, batch_bytes)):
            words, bounds = word_hashes(texts)
            n = max(0, len(words) - window + 1)
            near = np.zeros(len(words), bool)
            for (_, _, blob), lo, hi in zip(names, bounds[:-1], bounds[1:], strict=True):
                near[lo:hi] = _spread(_places(blob), window - block, 0, hi - lo)
            own = np.flatnonzero(near[:n] & inside(bounds, window))
            hashes, checks = _digests(texts, bounds, own, window)
            yield _packed(_entries(hashes, checks, own, np.ones(len(own), bool), f"{task}-{k}", _docs_blob(names, bounds), buckets, 64))

    around = _keyed(rows).join(_once(hits), KEY).select("id", "h", "found", "text")
    repeats = _matches(around.mapInArrow(extend, PACKED), "op6-repeats", buckets, many)
    reclaim(docs.sparkSession)

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in batches(arrow, 4 << 20):
            out = []
            for (name, blob), text in zip(names, texts, strict=True):
                words = text.split()
                gone = _spread(_places(blob), 0, window - 1, len(words)) if blob else np.zeros(0, bool)
                kept = [w for w, g in zip(words, gone, strict=True) if not g] if blob else words
                out.append((name, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return _keyed(rows).join(_once(repeats), KEY, "left").select("id", "found", "text").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select rid, unnest(range(1, len(ws) - {WINDOW - 2})) as p, ws from d where len(ws) >= {WINDOW}),
k as (select rid, p, md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) as m from s),
r as (select rid, p from (select rid, p, count(*) over (partition by m) as n from k) where n > 1),
t as (select rid, unnest(ws) as w, generate_subscripts(ws, 1) as p from d),
c as (select t.rid, t.p, t.w, coalesce(max(r.p) over (partition by t.rid order by t.p rows between {WINDOW - 1} preceding and current row), 0) > 0 as gone from t left join r on r.rid = t.rid and r.p = t.p),
g as (select rid, count(*) filter (where gone) as n_removed, string_agg(w, ' ' order by p) filter (where not gone) as kept from c group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join g using (rid)
"""
