"""Packing of token sequences by multiway number partitioning (Karmarkar and Karp 1982).

Documents are tokenised, an end id is added, and each is cut into pieces of at most piece_tokens. Pieces
are dealt by a hash into bins of bounded size; in a bin they are taken in order into groups of about
group_windows windows, each ended where its total is just short of whole windows. In a group, every piece
is at first a partition of its own (one window loaded, the others empty); the two partitions with the
largest differences between windows are merged, the fullest window of one onto the emptiest of the other,
until one partition is left: near-equal windows. Where the fullest exceeds the capacity, the window count
rises by one and the differencing is done again.

Defined results: a null text is empty and yields its end id alone; rows with equal or null ids are packed
each for itself, and ids of any type keep their values; any length of text works, as it is cut; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_or_empty

CAPACITY = 4096
PIECE_TOKENS = 512
GROUP_WINDOWS = 48
#: Share of the capacity that windows are filled to on average.
FILL = 0.99
#: Tokens in a bin: what one task packs. It bounds the task's memory.
BIN_TOKENS = 8_000_000
END_ID = 2
#: What a worker's cache holds at most before it starts anew.
CACHED_WORDS, CACHED_IDS = 600_000, 4_000_000
#: Characters of texts that are tokenised together (a longer text by itself).
BATCH_CHARS = 1 << 19
#: Stands for the end of a text among its words; no word holds a blank.
END = " "
# Texts that hold one of these go to the tokenizer whole (special tokens, letters whose lower case
# depends on their neighbours, control characters that only str.split takes for white space).
WHOLE = ("<|", "\u03a3", "\u0130", "\x1c", "\x1d", "\x1e", "\x1f")
PLAIN_WORD = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
MARKED_WORD = re.compile(f"({PLAIN_WORD.pattern})([!-&(-/:-@\\[-`{{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1, else 256 and on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    other = iter(range(256, 512))
    letters = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class Tokenizer:
    """Ids as the tokenizer itself gives them, with a cache of words.

    Exact for this vocabulary because its pre-tokenizer drops white space and never joins letters with
    punctuation after them (but for apostrophes, which may begin a suffix). Words of plain letters go to its model directly, other words to the
    whole tokenizer, and so do whole texts that may hold special tokens, a letter whose lower case
    depends on its neighbours, or a control character that is white space to str.split alone.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        from tokenizers import Tokenizer as Full

        self.full, self.end_id = Full.from_file(path), end_id
        self.model, self.letters = self.full.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.starts, self.lengths, self.flat = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.used = 0
        self._store([END], [0 if self.end_id is None else 1], [] if self.end_id is None else [self.end_id])

    def _store(self, words: list[str], sizes: list[int] | np.ndarray, ids: list[int] | np.ndarray) -> None:
        """Gives words their codes: ids holds the ids of all of them, sizes how many each has."""
        k, n = len(self.code), len(ids)
        while k + len(words) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        if self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + n))
        ends = self.used + np.cumsum(sizes, dtype=np.int64)
        self.starts[k : k + len(words)], self.lengths[k : k + len(words)] = ends - sizes, sizes
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.code.update(zip(words, range(k, k + len(words)), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Words that end in punctuation take the ids of the rest, and of the punctuation, from the cache."""
        plain, model, letters = PLAIN_WORD.fullmatch, self.model.tokenize, self.letters
        marked = [(w, m) for w in words if (m := MARKED_WORD.fullmatch(w))]
        rest = dict.fromkeys(words)
        for w, m in marked:
            del rest[w]
        rest |= {part: None for _, m in marked for part in m.groups() if part not in self.code}
        sizes, ids = [], []
        for w in rest:
            if plain(w):
                own = [t.id for t in model(w if w.isascii() else w.translate(letters))]
            else:
                own = self.full.encode(w, add_special_tokens=False).ids
            sizes.append(len(own))
            ids += own
        self._store(list(rest), sizes, ids)
        if marked:
            parts = np.fromiter((self.code[part] for _, m in marked for part in m.groups()), np.int64, 2 * len(marked))
            self._store([w for w, _ in marked], self.lengths[parts].reshape(-1, 2).sum(axis=1), self._gather(parts))

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _words(self, text: str) -> list[str]:
        if not any(map(text.__contains__, WHOLE)):
            return text.lower().split()
        if text not in self.code:
            ids = self.full.encode(text, add_special_tokens=False).ids
            self._store([text], [len(ids)], ids)
        return [text]

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id behind each, and where each text's begin (one place more than texts)."""
        if len(self.code) > CACHED_WORDS or self.used > CACHED_IDS:
            self._clear()
        words, bounds = [], [0]
        for text in texts:
            words += self._words(text)
            words.append(END)
            bounds.append(len(words))
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys(words[i] for i in unknown)))
            codes[unknown] = [self.code[words[i]] for i in unknown]
        return self._gather(codes).astype("<u4"), np.concatenate(([0], np.cumsum(self.lengths[codes])))[bounds]

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]


#: The tokenizers of this worker by path and end id: later tasks find the words that earlier ones learnt.
_tokenizers: dict[tuple, Tokenizer] = {}


def _tokenizer(path: str, end_id: int | None) -> Tokenizer:
    if (path, end_id) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path, end_id] = Tokenizer(path, end_id)
    return _tokenizers[path, end_id]


def differencing(sizes: list[int], windows: int) -> tuple[list[list[int]], int]:
    """Places of sizes by window, and the largest window's sum."""
    if not sizes:
        return [[] for _ in range(windows)], 0
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[0] = size
        heap.append((-size if windows > 1 else 0, i, loads, [[i]] + [[]] * (windows - 1)))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        loads = a + b[::-1]  # both from the fullest to the emptiest
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        y = y[::-1]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), at, loads, [x[k] + y[k] for k in order]))
        at += 1
    return heap[0][3], int(heap[0][2][0])


def pack_group(sizes: list[int], capacity: int = CAPACITY, fill: float = FILL) -> list[list[int]]:
    """Windows of places of sizes, none above the capacity."""
    windows = max(1, -(-sum(sizes) // max(1, int(capacity * fill))))
    while True:
        out, most = differencing(sizes, windows)
        if most <= capacity:
            return [x for x in out if x]
        windows += 1


def _groups(sizes: list[int], capacity: int, fill: float, windows: int) -> Iterator[tuple[int, int]]:
    """Runs of sizes: each ends just short of a whole number of windows, once there are enough."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        filled = total / (capacity * fill)
        if filled >= windows and -filled % 1 <= 0.05 or filled >= 2 * windows:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_tokens: int = PIECE_TOKENS, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document."""

    def cut(names: pa.Array, texts: list[str], tokenizer: Tokenizer) -> pa.RecordBatch:
        ids, bounds = tokenizer.ids_of(texts)
        n = np.diff(bounds)
        many = -(-n // piece_tokens)
        of = np.repeat(np.arange(len(n)), many)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * piece_tokens
        length = np.minimum(piece_tokens, n[of] - start)
        data, lo = memoryview(ids.tobytes()), 4 * (bounds[of] + start)
        crc = [zlib.crc32(data[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([names.take(pa.array(of)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(n[of])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, end_id)
        for batch in batches:
            texts, lo, held = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held > BATCH_CHARS or i + 1 == batch.num_rows:
                    yield cut(batch.column(0).slice(lo, len(texts)), texts, tokenizer)
                    texts, lo, held = [], i + 1, 0

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, fill: float = FILL, windows: int = GROUP_WINDOWS, bin_tokens: int = BIN_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and others), each no longer than the capacity."""
    pieces = materialize(pieces, "op7-pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    bins = max(1, -(-total // bin_tokens))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(n, "ascending") for n in ("doc_id", "start", "ids_crc32")])
        sizes = rows["length"].to_pylist()
        sequence, offset, k = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), rows["bin"][0].as_py() << 32
        for lo, hi in _groups(sizes, capacity, fill, windows):
            for window in pack_group(sizes[lo:hi], capacity, fill):
                at = 0
                for i in sorted(window):
                    sequence[lo + i], offset[lo + i] = k, at
                    at += sizes[lo + i]
                k += 1
        return rows.drop_columns("bin").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(packed, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
