"""Language ID by string kernels.

The kernel of two texts is that of blended-spectrum n-gram presence: the number
of distinct n-grams (of 1 to 3 bytes of the lower-cased text, blanks folded to
one) that both hold, over the square root of the product of how many each
holds. N-grams are counted in the space of those that occur in a landmark.

Nyström: `landmarks` training texts stand for all. With K the kernel among them,
a text x has the features k(x, landmarks) K^(-1/2); one-versus-rest kernel ridge
regression on these has a closed form from the sample's features, and its weights
fold into one matrix W, so scores of a batch are k(batch, landmarks) W: two matrix
products. The language is that of the highest score; the score shown is the margin
to the second as a probability-like figure between 0 and 1.

Training takes a bounded sample: up to `PER_LABEL` labelled texts of each language, of at most
`SAMPLE_BYTES` bytes each, those with the smallest hash of doc_id, and `MOST_ROWS` in all, so at most
60 MB reach the driver. A language that only longer texts have isn't learned. All rows are
predicted, whole texts, from the text alone.

A null text, or one without a letter, is `und` with score 0. Without any training
row all are `und`. Of languages with equal scores the first in byte order is taken. Rows are
predicted one by one, however long they are: repeated rows and other columns make no difference.
An empty table gives no rows; columns with the names of the two that are added are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linesets.llm import _text
from linesets.llm._common import table, tidy, with_workers, worker_cache

UNDETERMINED = "und"
PER_LABEL = 150
MOST_ROWS = 3000
LANDMARKS = 96
RIDGE = 0.1
#: Texts shorter than this in bytes aren't taken as training rows while longer ones are there; longer ones than SAMPLE_BYTES never are.
LEAST_BYTES = 200
SAMPLE_BYTES = 20_000

#: Any letter: the first is nearly always among the first characters of a text.
LETTER = re.compile(r"[^\W\d_]")

# Lower-case ASCII, all blanks as a space; everything else as it is
FOLD = _text.LOWER.copy()
FOLD[list(_text.BLANKS)] = 32


def has_letter(text: str) -> bool:
    m = LETTER.search(text)
    while m and not m.group().isalpha():
        m = LETTER.search(text, m.end())
    return m is not None


def _codes(raw: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that end at each byte; those that don't exist are left out."""
    wide = raw.astype(np.int32)
    two = wide[:-1] << 8 | wide[1:]
    return [wide, 256 + two, 65792 + (two[:-1] << 8 | wide[2:])] if len(wide) > 2 else [wide, 256 + two]


CODES = 256 + (1 << 16) + (1 << 24)


def grams(text: bytes) -> np.ndarray:
    """Distinct n-gram codes of a text."""
    raw = FOLD[np.frombuffer(text, np.uint8)]
    return np.unique(np.concatenate(_codes(raw))) if len(raw) > 1 else np.unique(raw.astype(np.int32))


_columns: dict[bytes, np.ndarray] = worker_cache(__name__)


@dataclass
class Model:
    """columns: n-gram code to column, sorted codes; marks: landmarks by columns; weights: landmarks by labels."""

    labels: list[str]
    codes: np.ndarray
    marks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def column(self) -> np.ndarray:
        key = hashlib.sha256(self.codes.tobytes()).digest()
        if key not in _columns:
            _columns.clear()  # a worker serves one model at a time
            # the last column takes the n-grams that no landmark has
            found = np.full(CODES, len(self.codes), dtype=np.uint16 if len(self.codes) < 65535 else np.int32)
            found[self.codes] = np.arange(len(self.codes))
            _columns[key] = found
        return _columns[key]

    def presence(self, part: list[bytes]) -> np.ndarray:
        """Texts by n-grams, 1 where a text has it."""
        column, width = self.column(), len(self.codes) + 1
        out = np.zeros((len(part), width), dtype=np.float32)
        flat = out.reshape(-1)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        raw = FOLD[np.frombuffer(b"".join(part), np.uint8)]
        if not len(raw):
            return out[:, :-1]
        base = np.repeat(np.arange(len(part)) * width, sizes)
        # an n-gram must not reach over the end of its text
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))
        for n, codes in enumerate(_codes(raw), 1):
            at = base[: len(codes)] + column[codes]
            flat[at if n == 1 else at[left[: len(codes)] >= n]] = 1
        return out[:, :-1]

    def kernel(self, part: list[bytes]) -> np.ndarray:
        x = self.presence(part)
        held = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.marks.T) / held

    def scores(self, part: list[bytes]) -> np.ndarray:
        return self.kernel(part) @ self.weights + self.bias


def train(rows: list[tuple[bytes, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features of labelled texts."""
    rows = [(t, label) for t, label in rows if t]
    if not rows:
        return None
    labels = sorted({label for _, label in rows})
    by_label = {x: [t for t, label in rows if label == x] for x in labels}
    # landmarks in turn from each language
    chosen: list[bytes] = []
    for i in range(max(map(len, by_label.values()))):
        chosen += [ts[i] for ts in by_label.values() if i < len(ts)]
    chosen = list(dict.fromkeys(chosen))[: max(landmarks, len(labels))]
    codes = np.unique(np.concatenate([grams(t) for t in chosen]))
    model = Model(labels, codes, np.empty((0, len(codes)), np.float32), np.empty(0), np.empty(0))
    marks = model.presence(chosen)
    model.marks = marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    among = model.kernel(chosen).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    useful = values > 1e-6 * values.max()
    root = vectors[:, useful] / np.sqrt(values[useful])
    features = model.kernel([t for t, _ in rows]).astype(np.float64) @ root
    target = np.array([[1.0 if label == x else -1.0 for x in labels] for _, label in rows])
    # languages weigh the same, however many rows each has
    weight = np.array([1 / len(by_label[label]) for _, label in rows])[:, None] * len(rows) / len(labels)
    mean_x, mean_y = (weight * features).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    centred = features - mean_x
    gram = centred.T @ (weight * centred) + ridge * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centred.T @ (weight * (target - mean_y)))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (mean_y - mean_x @ solved).astype(np.float32)
    return model


def predict(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if model is None:
        return labels, scores
    ask = [i for i, t in enumerate(texts) if t and has_letter(t.decode())]
    for at, part in _text.slices([texts[i] for i in ask], 1 << 19):
        for a in range(0, len(part), 256):
            found = model.scores(part[a : a + 256])
            best = found.argmax(axis=1)
            top = found[np.arange(len(best)), best]
            found[np.arange(len(best)), best] = -np.inf
            second = found.max(axis=1) if found.shape[1] > 1 else np.full(len(best), -1.0)
            # scores run from -1 to 1, so a clear margin is about 2
            shown = 1 / (1 + np.exp(-3.0 * (top - second)))
            for j, (b, s) in enumerate(zip(best.tolist(), shown.tolist(), strict=True)):
                i = ask[at + a + j]
                labels[i], scores[i] = model.labels[b], min(1.0, max(0.0, s))
    return labels, scores


def sample(docs: DataFrame, text: str, label: str, id_col: str, per_label: int = PER_LABEL, most_rows: int = MOST_ROWS) -> list[tuple[bytes, str]]:
    """Labelled texts of a bounded sample, the same at every partitioning."""
    spoken = docs.filter(F.col(label).isNotNull() & F.octet_length(text).between(1, SAMPLE_BYTES) & F.col(text).rlike(r"\p{L}"))
    ranked = spoken.select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), F.xxhash64(text).alias("body"),
        # long enough first
        (F.octet_length(text) < LEAST_BYTES).alias("odd"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("draw"),
    )
    order = Window.partitionBy("label").orderBy("odd", "draw", "body")
    picked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label)
    chosen = picked.orderBy("rank", "label").limit(most_rows).select("id", "label", "body", "rank")
    # at most most_rows rows
    joined = docs.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(text).alias("text")).withColumn("body", F.xxhash64("text"))
    found = joined.join(F.broadcast(chosen), joined["id"].eqNullSafe(chosen["id"]) & (joined["label"] == chosen["label"]) & (joined["body"] == chosen["body"]))
    rows = found.select(joined["label"], "rank", joined["text"]).distinct().orderBy("rank", joined["label"]).limit(most_rows).collect()
    return [(r["text"].encode(), r["label"]) for r in rows]


#: Columns that identify adds; columns of these names in the input are replaced.
LANG, SCORE = "language_id_lang", "language_id_score"


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with the predicted language and its score, from the text alone."""
    with_workers(docs.sparkSession)
    docs = docs.drop(LANG, SCORE)
    # the model goes with the tasks: landmarks by their n-grams, a few MB however large the corpus
    schema = T.StructType([*docs.schema.fields, T.StructField(LANG, T.StringType()), T.StructField(SCORE, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = predict(model, _text.texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def remainder(id_col: str, parts: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def learn(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Model from rows outside the held-out fold (crc32 of doc_id as text, modulo 4, is 2); a null doc_id trains."""
    return train(sample(docs.filter(~(F.coalesce(remainder(id_col, 4), F.lit(0)) == 2)), text, label, id_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    slim = docs.select("doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "text")
    found = identify(slim, model)
    return found.select("doc_id", "held_out", F.col(LANG).alias("lang_pred"), F.col(SCORE).alias("score"))
