"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a
language is the sum, over all its segmentations into pieces, of the products of the pieces'
probabilities, which a forward algorithm adds up; a text's log likelihood is the sum over its words. The
piece probabilities are fitted by expectation maximisation (forward-backward) on all words of a bounded
sample of labelled rows: at most TRAIN_DOCS documents a language, chosen by a hash of their id; whole texts.

Words are runs of letters, lower-cased, of any length, with the vocabulary's word mark before them;
characters that no piece covers count as an unknown piece. Scores are posteriors under equal priors.

Defined results: a null text, or one without a letter, gives `und` and score 0; without labelled rows
every text gives `und`; rows with null labels, and rows with null ids, don't train (these are not held out
either); repeated rows are judged each for itself; an empty table gives an empty result; columns
named lang_pred or score are replaced, others kept; ties go to the alphabetically first language.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
TRAIN_DOCS = 300
ROUNDS = 3
CACHED_WORDS = 600_000
#: Characters of the words whose segmentations are added up together.
LATTICE_CHARS = 1 << 16
#: Characters after which the forward sums are scaled anew.
SCALED = 16
UNKNOWN, SMOOTHING = 1e-7, 0.01


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the word mark before them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = {p.lower() for p in pieces if LETTERS.fullmatch(p.replace(MARK, "", 1) or "a") and MARK not in p[1:]}
    return {p: i for i, p in enumerate(sorted(pieces))}


class Finder:
    """All pieces that stand anywhere in a text. The id after the last piece's is the unknown character."""

    def __init__(self, pieces: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.automaton.add_word(piece, i)
        if pieces:
            self.automaton.make_automaton()
        self.unknown = len(pieces)
        self.sizes = np.array([*map(len, sorted(pieces, key=pieces.get)), 1])
        self.longest = int(self.sizes.max())

    def __call__(self, text: str) -> np.ndarray:
        """Two columns: the place of the last character, and the piece."""
        found = chain.from_iterable(self.automaton.iter(text)) if self.unknown else ()
        return np.fromiter(found, np.int64).reshape(-1, 2)


class Lattice:
    """The segmentations of words: edges from one place between characters to a later one, each a piece.

    Places are offsets in the words' text, one word after another with a character between them."""

    def __init__(self, words: list[str], finder: Finder):
        text = "\n".join(words)
        self.lengths = np.array([len(w) for w in words])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.ends, self.places, self.longest = self.starts + self.lengths, len(text) + 1, finder.longest
        last, piece = finder(text).T
        plain = np.ones(len(text), bool)
        plain[last[finder.sizes[piece] == 1]] = False
        plain[self.ends[:-1]] = False
        last, piece = np.concatenate((last, np.flatnonzero(plain))), np.concatenate((piece, np.full(int(plain.sum()), finder.unknown)))
        to = last + 1
        word = np.searchsorted(self.starts, last, side="right") - 1
        level = to - self.starts[word]
        order = np.lexsort((to, level))
        self.to, self.piece, self.word, level = to[order], piece[order], word[order], level[order]
        self.origin = self.to - finder.sizes[self.piece]
        self.levels = np.searchsorted(level, np.arange(1, int(self.lengths.max(initial=0)) + 2))

    def forward(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations up to each place, by language, and the logarithms that are to be added to theirs:
        long words' sums are divided as they go, lest they vanish."""
        alpha, grown = np.zeros((self.places, theta.shape[1])), np.zeros((self.places, theta.shape[1]))
        scale = np.zeros((len(self.lengths), theta.shape[1]))
        alpha[self.starts] = 1
        long = int(self.lengths.max(initial=0)) > SCALED
        for level, (lo, hi) in enumerate(zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True), 1):
            to = self.to[lo:hi]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[first]] = np.add.reduceat(alpha[self.origin[lo:hi]] * theta[self.piece[lo:hi]], first)
            if long:
                grown[to[first]] = scale[self.word[lo:hi][first]]
            if level % SCALED == 0 and (more := np.flatnonzero(self.lengths > level)).size:
                near = self.starts[more][:, None] + np.arange(max(0, level - self.longest + 1), level + 1)
                most = np.maximum(alpha[near].max(axis=1), 1e-300)
                alpha[near] /= most[:, None]
                grown[near] += np.log(most)[:, None]
                scale[more] += np.log(most)
        return alpha, grown

    def log_likelihoods(self, theta: np.ndarray) -> np.ndarray:
        alpha, grown = self.forward(theta)
        return np.log(np.maximum(alpha[self.ends], 1e-300)) + grown[self.ends]

    def expectations(self, theta: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language over words with counts by language."""
        alpha, grown = self.forward(theta)
        total = np.log(np.maximum(alpha[self.ends], 1e-300)) + grown[self.ends]
        beta, shrunk = np.zeros_like(alpha), np.zeros_like(alpha)
        beta[self.ends] = 1
        order = np.lexsort((self.origin, self.origin - self.ends[self.word]))
        distance = (self.ends[self.word] - self.origin)[order]
        cuts = np.searchsorted(-distance, -np.arange(int(self.lengths.max(initial=0)), -1, -1), side="left")
        for lo, hi in reversed(list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))):
            some = order[lo:hi]
            if len(some):
                origin, to = self.origin[some], self.to[some]
                first = np.flatnonzero(np.diff(origin, prepend=-1))
                least = np.maximum.reduceat(shrunk[to], first)
                of = np.cumsum(np.diff(origin, prepend=origin[0] - 1) != 0) - 1
                sums = np.add.reduceat(beta[to] * theta[self.piece[some]] * np.exp(shrunk[to] - least[of]), first)
                far = np.where(sums < 1e-100, np.maximum(sums, 1e-300), 1.0)
                beta[origin[first]], shrunk[origin[first]] = sums / far, least + np.log(far)
        weight = np.exp(grown[self.origin] + shrunk[self.to] - total[self.word]) * counts[self.word]
        out = np.zeros_like(theta)
        np.add.at(out, self.piece, alpha[self.origin] * theta[self.piece] * beta[self.to] * weight)
        return out


def _portions(words: list[str]) -> Iterator[list[str]]:
    """Words in groups of bounded length; a longer word by itself."""
    part, held = [], 0
    for w in words:
        if part and held + len(w) > LATTICE_CHARS:
            yield part
            part, held = [], 0
        part.append(w)
        held += len(w) + 1
    if part:
        yield part


def fit(words: dict[str, list[float]], languages: int, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities by piece and language from counts of words by language; the last row is the unknown character's."""
    finder = Finder(pieces)
    theta = np.full((len(pieces) + 1, languages), 1 / max(1, len(pieces)))
    theta[-1] = UNKNOWN
    names = sorted(words, key=lambda x: (len(x), x))
    parts = [(Lattice([MARK + w for w in part], finder), np.array([words[w] for w in part], float)) for part in _portions(names)]
    for _ in range(rounds):
        uses = sum((lattice.expectations(theta, counts) for lattice, counts in parts), np.zeros_like(theta))
        uses[:-1] += SMOOTHING
        uses[-1] = 0
        theta = uses / np.maximum(uses.sum(axis=0), 1e-9)
        theta[-1] = UNKNOWN
    return theta


class Judge:
    """Log likelihoods of texts, with a cache of words."""

    def __init__(self, theta: np.ndarray, pieces: dict[str, int]):
        self.theta, self.finder = theta, Finder(pieces)
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.theta.shape[1]), np.float32)

    def learn(self, words: list[str]) -> None:
        for part in _portions(sorted(words, key=len)):
            at = len(self.code)
            while at + len(part) > len(self.rows):
                self.rows = np.resize(self.rows, (2 * len(self.rows), self.rows.shape[1]))
            self.rows[at : at + len(part)] = Lattice([MARK + w for w in part], self.finder).log_likelihoods(self.theta)
            self.code.update(zip(part, range(at, at + len(part)), strict=True))

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, and the number of words of each text."""
        if len(self.code) > CACHED_WORDS:
            self._clear()
        found = [LETTERS.findall(t.lower()) for t in texts]
        found = [x if any(c.isalpha() for w in x for c in w) else [] for x in found]
        self.learn(list(set().union(*found).difference(self.code)))
        out = np.zeros((len(texts), self.theta.shape[1]))
        for i, words in enumerate(found):
            if words:
                out[i] = self.rows[np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return out, np.array([len(x) for x in found])


#: The judge of this worker by model: later tasks find the words that earlier ones learnt.
_judges: dict[str, Judge] = {}


def _judge(model: str, theta: np.ndarray, pieces: dict[str, int]) -> Judge:
    if model not in _judges:
        _judges.clear()
        _judges[model] = Judge(theta, pieces)
    return _judges[model]


def train_words(labelled: DataFrame, train_docs: int) -> tuple[list[str], dict[str, list[float]]]:
    """Languages, and counts by language of the words of the bounded sample. labelled: doc_id, text, lang."""
    by_lang = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", F.row_number().over(by_lang)).where(F.col("r") <= train_docs).select("doc_id").distinct()
    words = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w"))
    got = words.groupBy("lang", "w").count().select("lang", "w", "count").collect()  # words of the sample, which is bounded in rows
    languages = sorted({r[0] for r in got})
    out: dict[str, list[float]] = {}
    for lang, w, n in got:
        out.setdefault(w, [0.0] * len(languages))[languages.index(lang)] = n
    return languages, out


def language_id(docs: DataFrame, path: str, may_train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs with lang_pred and score added. may_train: which rows of docs may train."""
    labelled = docs.where(may_train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    languages, words = train_words(labelled, train_docs)
    pieces = vocabulary(path)
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, languages, fit(words, len(languages), pieces) if words else None, pieces))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        name, languages, theta, pieces = model.value
        own = None if theta is None else _judge(name, theta, pieces)
        for batch in batches:
            langs, scores = ["und"] * len(batch), np.zeros(len(batch))
            for lo in range(0, len(batch) if own else 0, 128):
                logs, n = own.log_likelihoods([x or "" for x in batch.iloc[lo : lo + 128]])
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                scores[lo : lo + len(n)] = np.where(n > 0, share, 0.0)
                langs[lo : lo + len(n)] = [languages[b] if k else "und" for b, k in zip(best, n, strict=True)]
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    rows = docs.withColumn("_judged", judge(F.col(text_col)))
    return rows.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


def trains(id_col: str = "doc_id") -> Column:
    """The contract's fold: rows whose remainder is 2 are held out."""
    return F.coalesce(_remainder(id_col) != 2, F.lit(False))


def _remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id(docs, public_tokenizers.path("piece_bpe_32k.model"), trains())
    return out.select("doc_id", F.coalesce(_remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
