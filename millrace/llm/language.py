"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 2-, 3- and 4-grams of the lower-cased text (ASCII non-letters become one space).
Embeddings and softmax are trained by stochastic gradient descent in numpy on word windows of a
bounded sample of labelled rows (SAMPLE_ROWS). As the model is linear in the averaged embedding, a
prediction is an average over a table of per-bucket logits, so whole texts are scored at any length.
A temperature is calibrated on held-back sample rows; documents whose calibrated probability
falls under a threshold taken from those rows are marked as rejected.

Defined cases: a null text or one without a letter gets `und`, score 0, rejected; a null id or language is no lesson; an
empty table gives no rows and one without labels `und` throughout; a very long text is read whole; repeated rows get
equal predictions, and a repeated id teaches by one of its rows; languages that tie are settled by their names' order;
other columns pass through, and new_names can name the new ones where an input column has such a name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Shipped, held_out, lean, sample_ids, table, texts_of, trim

BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 4, 0.5
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: Word windows for training: of so many words, so many from each sampled row and epoch.
WINDOW_WORDS, WINDOWS = (2, 60), 3
#: No document at or over this calibrated probability is rejected.
MAX_THRESHOLD = 0.5

NAMES = ("lang_pred", "lang_score", "lang_rejected")

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(text: str) -> np.ndarray:
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out, h = [], b
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(257) + b[n - 1 :]
        out.append((h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(16))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 80))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.logit_table: np.ndarray | None = None
        self.bias = np.zeros(len(langs))
        self.temperature, self.threshold = 1.0, 0.0

    def fit(self, rows: list[tuple[str, str]], seed: int = 7) -> LanguageModel:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        keep = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
        label = {lang: i for i, lang in enumerate(self.langs)}
        E = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        Wt, bias = np.zeros((DIM, len(self.langs))), np.zeros(len(self.langs))

        def windows(which):
            for i in which:
                words = rows[i][0].split()
                for _ in range(WINDOWS):
                    n = int(np.exp(rng.uniform(*np.log(WINDOW_WORDS))))
                    at = int(rng.integers(0, max(1, len(words) - n + 1)))
                    if len(g := subwords(" ".join(words[at : at + n]))):
                        yield g, label[rows[i][1]]

        train = [i for i in range(len(rows)) if i not in keep]
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for g, y in windows(rng.permutation(train).tolist()):
                hidden = E[g].mean(axis=0)
                delta = softmax(hidden @ Wt + bias)
                delta[y] -= 1
                back = Wt @ delta
                Wt -= rate * np.outer(hidden, delta)
                bias -= 0.1 * rate * delta
                np.add.at(E, g, (-rate / len(g)) * back)
        self.logit_table, self.bias = (E @ Wt).astype(np.float32), bias
        if keep:
            held = list(windows(sorted(keep)))
            logits = np.array([self.logits(g) for g, _ in held])
            y = np.array([y for _, y in held])
            self.temperature = best_temperature(logits, y)
            p = softmax(np.array([self.logits(subwords(rows[i][0])) for i in sorted(keep)]) / self.temperature)
            right = p.argmax(axis=1) == np.array([label[rows[i][1]] for i in sorted(keep)])
            if right.any():
                self.threshold = min(MAX_THRESHOLD, float(np.quantile(p.max(axis=1)[right], 0.001)))
        return self

    def logits(self, grams: np.ndarray, step: int = 1_000_000) -> np.ndarray:
        total = np.zeros(len(self.langs))
        for i in range(0, len(grams), step):
            total += self.logit_table[grams[i : i + step]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(grams)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or self.logit_table is None or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        p = softmax(self.logits(subwords(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def fit(documents: DataFrame) -> LanguageModel:
    """Learn from text and lang of at most SAMPLE_ROWS rows outside the held-out fold."""
    taught = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    found = texts_of(taught, sample_ids(taught.select("doc_id"), SAMPLE_ROWS), SAMPLE_CHARS, "lang")
    rows = sorted(set((r.doc_id, r.text, r.lang) for r in found))
    rows = [(text, lang) for _, text, lang in rows if any(c.isalpha() for c in text)]
    model = LanguageModel(sorted({lang for _, lang in rows}))
    model = model.fit(rows) if rows else model
    del found, rows
    trim()
    return model


def identify(documents: DataFrame, model: LanguageModel, new_names: tuple[str, ...] = NAMES) -> DataFrame:
    """All columns of documents, with lang_pred, lang_score and lang_rejected, or what new_names calls them, after them."""
    shared = Shipped(documents.sparkSession, model)  # bounded: BUCKETS x languages
    names = [*documents.columns, *new_names]

    def run(batches):
        import pyarrow as pa

        predict = shared.get().predict
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # whole texts are long: a few at a time
                rows = batch.slice(at, 500)
                found = [predict(t.as_py()) for t in rows.column(names.index("text"))]
                new = [
                    pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=names)

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType(list(documents.schema.fields))
    for name, kind in zip(new_names, (StringType(), DoubleType(), BooleanType()), strict=True):
        schema = schema.add(name, kind)
    # plain names on the way in: mapInArrow looks columns up by name, and takes a dot for a field
    return documents.toDF(*[f"c{i}" for i in range(len(documents.columns))]).mapInArrow(lean(run), schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every whole text; lang, source and doc_id are no inputs."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents)
    return identify(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )
