"""Benchmark decontamination by latent semantic retrieval.

Passages (word windows) are TF-IDF vectors over the words of a block of items of one size class, with
document frequencies counted over all documents. A randomised SVD (Halko et al. 2011) of the block's
vectors gives its latent space; blocks hold at most RANK items, so the space holds them all and the
projection of a passage keeps its products with every item. Directions that passages add to it are
orthogonal to the items and would change no product, so fitting needs no documents and no sample.

Every passage of every document that holds enough of the heaviest words of some item (its keys; without
them PARAPHRASE of its words cannot stand there) is projected and compared with the items. What an item
must reach follows from what the verifier accepts: the longest common subsequence of the item's words with
the words around the passage must hold SAME of the item, or PARAPHRASE of it together with a whole answer.
Words in such a number weigh at least as much as the item's lightest ones, so no window of the item's
length that the verifier would accept falls under the limit.

The answer is the item's answer column if there is one. Else an item has two: its closing sentence (its
last ANSWER_WORDS words, if that is shorter, or more than half of the item) and its heaviest run of
ANSWER_WORDS words.

Defined results: null or empty texts and items match nothing; items of any number of words are compared
alike; repeated rows are judged each for itself, and so are rows with null ids; with an empty benchmark
nothing is contaminated; an empty table gives an empty result; other columns, whatever their names, are
ignored (decontaminate() keeps those of its documents).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_or_empty
from tessera.llm.words import U, batches, word_hashes

#: Items in one latent space.
RANK = 128
#: Items compared in one pass over the documents: what is broadcast.
ITEM_BLOCK = 5000
#: Words of the shortest passages' items; each further class holds twice as many.
LEAST_SIZE = 16
SAME, PARAPHRASE, ANSWER_WORDS = 0.8, 0.6, 5
#: Share of an item's words that a contaminated passage is asked to hold of the item's keys.
KEYS = 0.1
SENTENCE = re.compile(r"[.!?]\s+|\n")
BATCH_BYTES = 1 << 20
#: Words projected at a time.
PIECE = 1 << 15
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of ASCII letters, digits and characters beyond ASCII), and where each text's begin."""
    return word_hashes([t.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts])


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over a (Hyyro 2004)."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = at.get(w)
        if m is not None:
            u = v & m
            v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def _step(size: int) -> int:
    return size // 4


def window_sums(rows: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows (words at ascending places) over passages of five quarter-size blocks; the first block of each."""
    block = places // _step(size)
    first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    sums = np.add.reduceat(rows, first, axis=0)
    some = np.unique(block[first][:, None] + np.arange(-4, 1))
    out = np.zeros((len(some), rows.shape[1]), rows.dtype)
    at = np.searchsorted(some, block[first])
    for k in range(5):  # passage b - k holds blocks b - k to b - k + 4
        out[at if not k else np.searchsorted(some, block[first] - k)] += sums
    return out, some


def _hashed(texts: list[str]) -> list[list[int]]:
    words, at = words_of([t.encode("utf-8", "surrogatepass") for t in texts])
    return [words[lo:hi].tolist() for lo, hi in zip(at[:-1], at[1:], strict=True)]


class Items:
    """A block of items, ready for comparison."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.ids = [r[0] for r in rows]
        self.words = _hashed([r[1] or "" for r in rows])
        given = _hashed([r[2] or "" for r in rows])
        self.given = [bool(a) for a in given]
        closing = _hashed([([x for x in SENTENCE.split(r[1] or "") if x.strip()] or [""])[-1] for r in rows])
        self.answers = [[a] if a else [c if ANSWER_WORDS <= len(c) <= len(w) // 2 else w[-ANSWER_WORDS:]] if w else [] for a, c, w in zip(given, closing, self.words, strict=True)]
        self.counts = [Counter(w) for w in self.words]
        self.sizes = [LEAST_SIZE << max(0, (len(w) - 1).bit_length() - (LEAST_SIZE - 1).bit_length()) for w in self.words]
        self.vocabulary = np.unique(np.array([w for x in self.words for w in x], U))

    def weigh(self, words: list[int], weights: np.ndarray) -> np.ndarray:
        return weights[np.searchsorted(self.vocabulary, np.array(words, U))]

    def add_rare_answers(self, idf: np.ndarray) -> None:
        """The heaviest run of ANSWER_WORDS words is an answer too, where none was given."""
        for i, words in enumerate(self.words):
            if len(words) > ANSWER_WORDS and not self.given[i]:
                sums = np.convolve(self.weigh(words, idf), np.ones(ANSWER_WORDS), "valid")
                at = int(sums.argmax())
                self.answers[i] = [*self.answers[i], words[at : at + ANSWER_WORDS]]

    def least(self, i: int, weights: np.ndarray) -> float:
        """The least weight of a passage with as much of item i as contaminates() asks for; weights by word of the vocabulary."""
        n = len(self.words[i])
        out = np.sort(self.weigh(self.words[i], weights))[: math.ceil(SAME * n - 1e-9)].sum()
        for given in self.answers[i]:
            answer = Counter(given) & self.counts[i]
            others = np.sort(self.weigh(list((self.counts[i] - answer).elements()), weights))
            rest = max(0, math.ceil(PARAPHRASE * n - 1e-9) - answer.total())
            out = min(out, self.weigh(list(answer.elements()), weights).sum() + others[:rest].sum())
        return out

    def keys(self, i: int, weights: np.ndarray) -> tuple[list[int], int]:
        """Words of item i of which a contaminated passage holds at least so many: the heaviest ones, so many that
        PARAPHRASE of the item cannot do with fewer of them."""
        n, need = len(self.words[i]), math.ceil(PARAPHRASE * len(self.words[i]) - 1e-9)
        many = max(1, min(need, int(KEYS * n)))
        order = np.argsort(-self.weigh(self.words[i], weights), kind="stable")[: n - need + many]
        return sorted({self.words[i][k] for k in order}), many

    def contaminates(self, i: int, region: list[int]) -> float:
        """The share of item i found in order in the region, if that is contamination; else 0."""
        words, have = self.words[i], Counter(region)
        if sum(min(n, have.get(w, 0)) for w, n in self.counts[i].items()) < PARAPHRASE * len(words):
            return 0.0
        share = lcs(words, region) / len(words)
        if share >= SAME:
            return share
        whole = share >= PARAPHRASE and any(a and any(region[k : k + len(a)] == a for k in range(len(region) - len(a) + 1)) for a in self.answers[i])
        return share if whole else 0.0


def _known(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words of the vocabulary, and their numbers there."""
    code = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    places = np.flatnonzero(vocabulary[code] == words)
    return places, code[places]


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n = shared.value, 0
        total = np.zeros(len(vocabulary), np.int64)
        for names, texts in batches(arrow, BATCH_BYTES):
            words, bounds = words_of(texts)
            places, code = _known(words, vocabulary)
            of = np.searchsorted(bounds, places, side="right") - 1
            total += np.bincount(np.unique(of * len(vocabulary) + code) % len(vocabulary), minlength=len(vocabulary))
            n += len(names)
        if n:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["w", "n"])

    found = {r.w: r.n for r in docs.select("text").mapInArrow(_with_name(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}  # at most the vocabulary
    return np.array([found.get(w, 0) for w in range(len(vocabulary))], float), found.get(-1, 0)


def _with_name(f):
    """batches() wants a column before the text."""
    return lambda arrow: f(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(0)], names=["none", "text"]) for b in arrow)


def latent_space(vectors: np.ndarray) -> np.ndarray:
    """Right singular vectors (words by rank) of the items' matrix, from a random sketch of its whole row space."""
    q = np.linalg.qr(vectors.T @ np.random.default_rng(7).standard_normal((len(vectors), min(vectors.shape))))[0]
    return q @ np.linalg.svd(vectors @ q, full_matrices=False)[2].T


class Space:
    """Items of one size class, their latent space, and what the product of a passage with each must reach."""

    def __init__(self, items: Items, of: list[int], idf: np.ndarray):
        self.of, self.size = np.array(of), items.sizes[of[0]]
        vocabulary = np.unique(np.array([w for i in of for w in items.words[i]], U))
        at = np.searchsorted(items.vocabulary, vocabulary)
        self.code = np.full(len(items.vocabulary), -1)  # of words of the items' vocabulary in the space's own
        self.code[at] = np.arange(len(at))
        own = idf[at]
        vectors = np.zeros((len(of), len(own)))
        for row, i in enumerate(of):
            code = np.searchsorted(vocabulary, np.array(items.words[i], U))
            vectors[row, code] = own[code]
        space = latent_space(vectors)
        self.rows, self.queries = (own[:, None] * space).astype(np.float32), (vectors @ space).T.astype(np.float32)
        self.least = (np.array([items.least(i, idf**2) for i in of]) * (1 - 1e-3)).astype(np.float32)  # less what float32 rounds
        self.holds = np.zeros((len(of), len(own) + 1), bool)  # the last column is for words that no item has
        self.holds[:, :-1] = vectors > 0
        self.enough = np.array([math.ceil(PARAPHRASE * len(items.words[i]) - 1e-9) for i in of])
        posted = [[] for _ in own]  # the items that each word is a key of
        self.many = np.zeros(len(of), np.int64)
        for row, i in enumerate(of):
            keys, self.many[row] = items.keys(i, idf)
            for k in np.searchsorted(vocabulary, np.array(keys, U)):
                posted[k].append(row)
        self.n_posted = np.array([len(x) for x in posted])
        self.first_posted = np.cumsum(self.n_posted) - self.n_posted
        self.posted = np.array([row for x in posted for row in x], np.int64)

    def living(self, code: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The passages (by first block, ascending) that hold enough keys of some item: no other can be contaminated."""
        n = self.n_posted[code]
        if not n.any():
            return np.empty(0, np.int64)
        ends = np.cumsum(n)
        item = self.posted[np.repeat(self.first_posted[code] - ends + n, n) + np.arange(ends[-1])]
        blocks, at = np.unique(np.repeat(block, n), return_inverse=True)
        held = np.bincount(at * len(self.of) + item, minlength=len(blocks) * len(self.of)).reshape(len(blocks), -1)
        some = np.unique(blocks[:, None] + np.arange(-4, 1))
        total = np.zeros((len(some), len(self.of)), np.int32)
        for k in range(5):  # passage b - k holds blocks b - k to b - k + 4
            total[np.searchsorted(some, blocks - k)] += held.astype(np.int32)
        return some[(total >= self.many).any(axis=1)]


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.maximum(np.log((n_docs + 1) / (df + 1)), 1e-2)


def _search(docs: DataFrame, items: Items, rank: int) -> DataFrame:
    """id, h, item_id, share of the contaminated documents."""
    if not len(items.vocabulary):
        return docs.sparkSession.createDataFrame([], "id long, h long, item_id long, share double")
    idf, spaces = _idf(*_document_frequencies(docs, items.vocabulary)), []
    items.add_rare_answers(idf)
    for size in sorted(set(items.sizes)):
        of = sorted((i for i, words in enumerate(items.words) if words and items.sizes[i] == size), key=lambda i: len(items.words[i]))
        spaces += [Space(items, of[lo : lo + rank], idf) for lo in range(0, len(of), rank)]
    shared = docs.sparkSession.sparkContext.broadcast((items, spaces))

    def search(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in batches(arrow, BATCH_BYTES):
            out = [(*names[d], shared.value[0].ids[i], share) for d, i, share in _found(texts, *shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "h", "item_id", "share"])

    return docs.select("id", "h", "text").mapInArrow(search, "id long, h long, item_id long, share double")


def _candidates(n_words: int, places: np.ndarray, code: np.ndarray, bounds: np.ndarray, space: Space) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts, items (by place in the space) and regions of the passages that reach the limit and hold enough words of the item.
    places and code: the words of the items' vocabulary.

    Texts lie on one line of words, with gaps longer than any passage."""
    code = space.code[code]
    places, code = places[code >= 0], code[code >= 0]
    if not len(places):
        return
    step = _step(space.size)
    shift = np.arange(len(bounds) - 1) * 2 * space.size
    where = places + np.repeat(shift, np.diff(bounds))[places]
    every = np.full(n_words + 1, len(space.n_posted))
    every[places] = code
    cuts = np.append(np.arange(0, len(places), PIECE), len(places))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        # Passages that begin in this piece need the words of the five blocks that follow it.
        first = where[lo] // step if lo else None
        last = where[hi] // step if hi < len(where) else None
        a = lo if lo == 0 else np.searchsorted(where, first * step)
        b = len(where) if last is None else np.searchsorted(where, (last + 4) * step)
        living = space.living(code[a:b], where[a:b] // step)
        living = living[(living >= first if lo else True) & (living < last if last is not None else True) & np.ones(len(living), bool)]
        if not len(living):
            continue
        among = np.unique(living[:, None] + np.arange(5))
        near = a + np.flatnonzero(among[np.minimum(np.searchsorted(among, where[a:b] // step), len(among) - 1)] == where[a:b] // step)
        sums, block = window_sums(space.rows[code[near]], where[near], space.size)
        mine = np.searchsorted(block, living)
        at, k = np.nonzero(sums[mine] @ space.queries >= space.least)
        start = living[at] * step
        text = np.clip(np.searchsorted(bounds[:-1] + shift, start + 5 * step, side="left") - 1, 0, len(shift) - 1)
        start -= shift[text]
        for c in range(0, len(at), 1 << 14):
            t, i, s = text[c : c + (1 << 14)], k[c : c + (1 << 14)], start[c : c + (1 << 14)]
            begin, end = np.maximum(bounds[t], s - step), np.minimum(bounds[t + 1], s + 6 * step)
            spread = begin[:, None] + np.arange(7 * step)
            held = space.holds[i[:, None], every[np.where(spread < end[:, None], spread, n_words)]].sum(axis=1)
            good = held >= space.enough[i]
            yield t[good], space.of[i[good]], begin[good], end[good]


def _found(texts: list[bytes], items: Items, spaces: list[Space]) -> Iterator[tuple[int, int, float]]:
    """Text, item and share, of all items that texts hold."""
    words, bounds = words_of(texts)
    places, code = _known(words, items.vocabulary)
    hits: dict = {}
    for space in spaces:
        for found in _candidates(len(words), places, code, bounds, space):
            for d, i, lo, hi in zip(*(x.tolist() for x in found), strict=True):
                hits.setdefault((d, i), []).append((lo, hi))
    for (d, i), spans in hits.items():
        if share := max(items.contaminates(i, words[lo:hi].tolist()) for lo, hi in spans):
            yield d, i, share


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, item_block: int = ITEM_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and item found in it: id, h (hash of the text), item_id, share."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text", answer.alias("answer"))
    found, block = [docs.sparkSession.createDataFrame([], "id long, h long, item_id long, share double")], []
    for r in items.toLocalIterator():  # a stated query set, in blocks of bounded size
        block.append(tuple(r))
        if len(block) == item_block:
            found.append(materialize(_search(rows, Items(block), rank), "op5-found"))
            block = []
    if block:
        found.append(_search(rows, Items(block), rank))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no item."""
    found = materialize(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select("id", "h").distinct(), "op5-documents")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("b.id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("b.h"))
    return docs.join(found.alias("b"), same, "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents and the items they hold."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "share")
