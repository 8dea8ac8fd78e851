"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word is hashed into WORDS places, and its shape (letter case, digits and symbols, runs collapsed) into SHAPES
places, so no word is without a vector. Each word's place has a fixed sparse random index vector; the vector of a
place adds up the index vectors of the words within RADIUS words of it, over all documents: tasks add up integers,
which are then added up in rounds of FAN_IN, so the sums are the same in any order. A document is the mean of its
words' vectors and of their squares and the mean of its shapes' vectors, with the share of distinct words, the share of words equal to
the one before and the log length. A two-layer numpy network gives the logit; its temperature is
calibrated on held-back sample rows. Only the network is fitted on a sample: SAMPLE_ROWS labelled rows of at most
SAMPLE_CHARS characters.

Defined cases: null and empty texts are scored like any other, by the pooled zero vector; without labels every score is
0.5; null labels and null ids teach nothing; a repeated id teaches by one of its rows; repeated rows get equal
scores; a very long text is read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint_dir, held_out, labelled_sample, lean, small_batches, table, trim
from millrace.llm.toxicity import score_texts

WORDS, SHAPES, DIM, NONZERO, RADIUS = 8192, 1024, 48, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
#: Words that a task remembers before it starts afresh, and words that it counts at once.
CACHE_WORDS, BLOCK_WORDS = 300_000, 1_000_000
#: Places of a block of sums as it travels, and tasks whose sums one task adds up.
BLOCK_PLACES, FAN_IN = 256, 16

_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return _RUN.sub(r"\1", "".join(kinds))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, divided by spaces and the code points 9 to 13."""
    return text.encode("utf-8", "replace").split() if text else []


def place_of(word: bytes) -> int:
    """The word's place times SHAPES, with its shape's place."""
    form = shape(word.decode("utf-8", "replace")).encode("utf-8", "replace")
    return zlib.crc32(word) % WORDS * SHAPES + zlib.crc32(form) % SHAPES


class Places:
    """A word's place and its shape's (after all words' places), remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two rows: the words' places, their shapes' places."""
        known = self.known
        for w in set(words).difference(known):
            known[w] = place_of(w)
        both = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
        if len(known) > CACHE_WORDS:
            known.clear()
        return np.stack([both // SHAPES, WORDS + both % SHAPES])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each word's place the NONZERO dimensions of its index vector, and their signs."""
    rng = np.random.default_rng(3)
    at = np.array([rng.choice(DIM, NONZERO, replace=False) for _ in range(WORDS)])
    return at, rng.choice([-1, 1], (WORDS, NONZERO))


def context_sums(texts) -> np.ndarray:
    """Sums of neighbours' index vectors of every place, integers, over an iterable of texts."""
    dims, signs = index_vectors()
    sums, places = np.zeros((WORDS + SHAPES) * DIM, dtype=np.int64), Places()
    held: list[np.ndarray] = []

    def add() -> None:
        both = np.concatenate(held, axis=1)
        held.clear()
        total = np.zeros(len(sums))  # whole numbers far below 2**53
        for d in range(1, RADIUS + 1):
            for near, far in ((both[:, d:], both[0, :-d]), (both[:, :-d], both[0, d:])):
                inside = (near[0] >= 0) & (far >= 0)
                near, word = near[:, inside].astype(np.int64) * DIM, far[inside]
                for k in range(NONZERO):
                    at, sign = dims[word, k], signs[word, k].astype(np.float64)
                    for row in near:
                        total += np.bincount(row + at, weights=sign, minlength=len(total))
        sums[:] += total.astype(np.int64)

    gap, n = np.full((2, RADIUS), -1, dtype=np.int32), 0  # neighbours are of one text
    for text in texts:
        words = words_of(text)
        held += [places.of(words), gap]
        n += len(words)
        if n >= BLOCK_WORDS:
            add()
            n = 0
    if held:
        add()
    return sums.reshape(-1, DIM)


def corpus_context(documents: DataFrame) -> np.ndarray:
    """context_sums() over all documents, added up in rounds, so no task holds more than its own and one block's sums."""
    spark = documents.sparkSession
    schema = "block int, sums binary"

    def batches_of(sums: np.ndarray):
        import pyarrow as pa

        for b, begin in enumerate(range(0, len(sums), BLOCK_PLACES)):
            part = sums[begin : begin + BLOCK_PLACES].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.binary())], names=["block", "sums"])

    def count(batches):
        sums = context_sums(t.as_py() for batch in batches for t in batch.column("text"))
        if sums.any():
            yield from batches_of(sums)

    def added(batches):
        sums = np.zeros((WORDS + SHAPES, DIM), dtype=np.int64)
        for batch in batches:
            for b, part in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                some = np.frombuffer(part.as_py(), dtype=np.int64).reshape(-1, DIM)
                sums[b * BLOCK_PLACES : b * BLOCK_PLACES + len(some)] += some
        if sums.any():
            yield from batches_of(sums)

    blocks = -(-(WORDS + SHAPES) // BLOCK_PLACES)
    rows = documents.select("text").mapInArrow(lean(count), schema)
    with small_batches(spark, blocks):
        rows = checkpointed(rows)
        while (n := rows.count()) > blocks:
            rows = checkpointed(rows.repartition(-(-n // (FAN_IN * blocks))).mapInArrow(lean(added), schema))
        out = np.zeros((WORDS + SHAPES, DIM), dtype=np.int64)
        for r in rows.collect():  # one task's sums
            some = np.frombuffer(r.sums, dtype=np.int64).reshape(-1, DIM)
            out[r.block * BLOCK_PLACES : r.block * BLOCK_PLACES + len(some)] += some
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Like cut(), with the size of Python's batches left as it is."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class QualityModel:
    def __init__(self, context: np.ndarray | None = None):
        """context: context_sums() of the corpus."""
        dims, signs = index_vectors()
        own = np.zeros((WORDS + SHAPES, DIM))
        np.put_along_axis(own[:WORDS], dims, signs / np.sqrt(NONZERO), axis=1)
        sums = np.zeros_like(own) if context is None else context
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        self.vectors = (sums / np.maximum(size, 1e-9) + own).astype(np.float32)
        self.layers: tuple | None = None
        self.temperature = 1.0
        self.places = Places()

    def __getstate__(self):
        return self.__dict__ | {"places": Places()}

    def pooled(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        n = len(words)
        if not n:
            return np.zeros(3 * DIM + 3)
        at = self.places.of(words)
        means = []
        for column in (0, 1):
            place, count = np.unique(at[column], return_counts=True)
            vectors, share = self.vectors[place], count / n
            means += [share @ vectors] + ([share @ vectors**2] if column == 0 else [])
        same = np.count_nonzero((at[:, 1:] == at[:, :-1]).all(axis=0)) / n
        return np.concatenate([*means, [len(set(words)) / n, same, np.log1p(n)]])

    def fit(self, texts: list[str], labels: list[int], seed: int = 5) -> QualityModel:
        if not texts:
            return self
        rng = np.random.default_rng(seed)
        X, y = np.array([self.pooled(t) for t in texts]), np.array(labels, dtype=np.float64)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        mu, sd = X[train].mean(axis=0), X[train].std(axis=0) + 1e-6
        X = np.clip((X - mu) / sd, -8, 8)
        P = [
            rng.normal(0, 1 / np.sqrt(X.shape[1]), (X.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        m, s, step = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
                x = X[part]
                hidden = np.tanh(x @ P[0] + P[1])
                error = (1 / (1 + np.exp(-(hidden @ P[2] + P[3]))) - y[part]) / len(part)
                back = np.outer(error, P[2]) * (1 - hidden**2)
                grads = [x.T @ back + DECAY * P[0], back.sum(axis=0), hidden.T @ error + DECAY * P[2], error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    P[i] = P[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = (mu, sd, *P)
        if len(held):
            z = np.array([self._logit(x, scaled=True) for x in X[held]])
            grid = np.exp(np.linspace(np.log(0.1), np.log(20), 80))
            loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray, scaled: bool = False) -> float:
        mu, sd, w1, b1, w2, b2 = self.layers
        if not scaled:
            x = np.clip((x - mu) / sd, -8, 8)
        return float(np.tanh(x @ w1 + b1) @ w2 + b2[0])

    def score(self, text: str | None) -> float:
        if self.layers is None:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self._logit(self.pooled(text)) / self.temperature, -500, 500))))


def fit(documents: DataFrame, labels: DataFrame) -> QualityModel:
    model = QualityModel(corpus_context(documents))
    sample = labelled_sample(documents, labels, "quality", 4, 2, SAMPLE_ROWS, SAMPLE_CHARS)
    model = model.fit([x[1] for x in sample], [x[2] for x in sample])
    del sample
    trim()
    return model


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text; labels, lang, source and doc_id are no inputs."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score_texts(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
