"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded by four hashed rows: two independent hashes of the word, and one each of its first five and first four
bytes, so that a collision rarely counts in full and an inflected form meets its stem. Filters of widths one to three run over
the embedded words, each is pooled to its maximum over the whole text, and a logistic layer gives the raw score. Because a
convolution is linear before pooling, each distinct word of a batch is projected once.

Thresholds are calibrated by language on part of the training rows: raw scores of each language group are shifted so that the
best threshold there lies at 0.5. The group is guessed from the text's letters, since ``lang`` is no input of a score.

The model is fitted on the driver from at most ``max_train`` rows of each label, those least by hash of their id (a documented
bound). Null and empty texts are scored as texts without words. Labels that are null are left out; of several labels of one id
the greatest holds. Without examples of both labels the score is 0. Repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import doc_crc, map_texts, texts_of

MAX_TRAIN = 2_000  # of each label
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS, PARTS = 8, 12, (1, 2, 3), 4
CACHE_WORDS = 150_000
_EDGES = b".,;:!?\"'()[]#*$%&|<>"
GROUPS = ("", "äöüß", "àâçèéêëîôùûœ", "áíñóú¿¡", "other")
_LETTERS = {c: g for g, chars in enumerate(GROUPS[:4]) for c in chars}


def language_group(text: str) -> int:
    """Index into GROUPS: whose letters the text has most of, 0 if it has hardly any but ASCII, 4 if others prevail."""
    raw = text.lower()
    if raw.isascii():
        return 0
    n = [0] * 5
    for c in set(raw):
        if c > "\x7f":
            n[_LETTERS.get(c, 4)] += raw.count(c)
    return 0 if sum(n) < 0.002 * len(raw) else int(np.argmax(n[1:])) + 1


def buckets(word: bytes) -> tuple[int, int, int, int]:
    """The four rows of a lower-cased word."""
    word = word.strip(_EDGES) or word
    a = xxhash.xxh64_intdigest(word, 1)
    mask = BUCKETS - 1
    return (
        a & mask,
        BUCKETS + (a >> 32 & mask),
        2 * BUCKETS + (zlib.crc32(word[:5]) & mask),
        3 * BUCKETS + (zlib.crc32(word[:4], 7) & mask),
    )


class Words:
    """Numbers words as they come; row 0 stands for padding."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []

    def numbers(self, text: str) -> list[int]:
        number, rows = self.number, self.rows
        out = []
        for w in text.encode().lower().split():
            k = number.get(w)
            if k is None:
                rows.append(buckets(w))
                k = number[w] = len(rows)
            out.append(k)
        return out

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return laid_out([self.numbers(t) for t in texts])


def laid_out(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by padding of the greatest width, and the first and last place of each.

    A text's last place is its first padding: a filter that begins there still ends before the next text.
    """
    starts = np.cumsum([0] + [len(p) + max(WIDTHS) for p in parts])
    flat = np.zeros(starts[-1], np.int64)
    for at, p in zip(starts, parts):
        flat[at : at + len(p)] = p
    return flat, np.stack([starts[:-1], starts[1:] - max(WIDTHS) + 1], axis=1)


@dataclass
class Convolution:
    embed: np.ndarray
    filters: list[np.ndarray]  # for each width: width x (PARTS * DIM) x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(GROUPS)))
    constant: float | None = None

    def project(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each offset; the first row is padding."""
        e = self.embed[rows].reshape(len(rows), PARTS * DIM)
        w = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        return np.concatenate([np.zeros((1, w.shape[1]), np.float32), e @ w])

    def pooled(self, p: np.ndarray, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The maximum of every filter over each text."""
        out, at = [], 0
        for f, b in zip(self.filters, self.biases):
            width = len(f)
            total = p[:, at : at + FILTERS][flat]
            for k in range(1, width):
                total[:-k] += p[:, at + k * FILTERS : at + (k + 1) * FILTERS][flat[k:]]
            at += width * FILTERS
            out.append(np.maximum(np.maximum.reduceat(total, places.ravel(), axis=0)[::2] + b, 0))
        return np.concatenate(out, axis=1)

    def margins(self, words: Words, texts: list[str]) -> np.ndarray:
        flat, places = words.batch(texts)
        p = self.project(np.array(words.rows, np.int64).reshape(-1, PARTS))
        return self.pooled(p, flat, places) @ self.out + self.bias

    def score(self, words: Words, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        m = self.margins(words, texts).astype(np.float64) - self.shift[[language_group(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def fit(texts: list[str], y: np.ndarray, steps: int = 640, size: int = 32, rate: float = 0.02, seed: int = 11) -> Convolution:
    """Adam over shuffled mini-batches; only the words that won a pool get a gradient."""
    rng = np.random.default_rng(seed)
    d = PARTS * DIM
    model = Convolution(
        rng.normal(0, 0.01, (PARTS * BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, (w * d) ** -0.5, (w, d, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32),
        0.0,
    )
    if not len(y) or y.min() == y.max():
        model.constant = 0.0
        return model
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    epochs = min(24, max(4, round(steps * size / len(used))))
    words = Words()
    numbers = [np.array(words.numbers(t), np.int64) for t in texts]
    rows = np.concatenate([np.full((1, PARTS), -1), np.array(words.rows, np.int64).reshape(-1, PARTS)])
    dense = [*model.filters, *model.biases, model.out]
    moments = [[np.zeros_like(a), np.zeros_like(a)] for a in dense]
    power = np.zeros(PARTS * BUCKETS, np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) ** 0.5
        rng.shuffle(used)
        for at in range(0, len(used), size):
            some = used[at : at + size]
            flat, places = laid_out([numbers[i] for i in some])
            own, where = np.unique(flat, return_inverse=True)
            e = np.zeros((len(own), d), np.float32)
            real = own > 0
            e[real] = model.embed[rows[own[real]]].reshape(-1, d)
            grad_e, pooled, best = np.zeros_like(e), [], []
            for f, b in zip(model.filters, model.biases):
                total = (e @ f[0])[where]
                for k in range(1, len(f)):
                    total[:-k] += (e @ f[k])[where[k:]]
                top = np.stack([total[s:t].argmax(axis=0) + s for s, t in places])
                best.append(top)
                pooled.append(np.maximum(np.take_along_axis(total, top, axis=0) + b, 0))
            z = np.concatenate(pooled, axis=1)
            m = z @ model.out + model.bias
            delta = (weight[some] * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[some]) / len(some)).astype(np.float32)
            gz = np.outer(delta, model.out) * (z > 0)
            grads_f, grads_b = [], []
            for q, (f, top) in enumerate(zip(model.filters, best)):
                g = gz[:, q * FILTERS : (q + 1) * FILTERS]
                gf = np.zeros_like(f)
                for k in range(len(f)):
                    word = where[np.minimum(top + k, len(where) - 1)]
                    gf[k] = np.einsum("bfd,bf->df", e[word], g)
                    np.add.at(grad_e, word.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, d))
                grads_f.append(gf)
                grads_b.append(g.sum(axis=0))
            step += 1
            for a, g, (m1, m2) in zip(dense, [*grads_f, *grads_b, z.T @ delta + 1e-4 * model.out], moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                a -= (pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            model.bias -= pace * float(delta.sum())
            touched = real & (np.abs(grad_e).sum(axis=1) > 0)
            at_rows, g = rows[own[touched]].ravel(), grad_e[touched].reshape(-1, DIM)
            np.add.at(power, at_rows, (g * g).mean(axis=1))
            np.add.at(model.embed, at_rows, -5 * pace * g / (np.sqrt(power[at_rows])[:, None] + 1e-6))
    some = [texts[i] for i in held]
    if some:
        model.shift = _calibrated(model.margins(Words(), some), y[held], np.array([language_group(t) for t in some]))
    return model


def _calibrated(m: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each group the shift of its margins that makes its labels likeliest, drawn towards that of all groups if it is small."""

    def best(m: np.ndarray, y: np.ndarray, near: float, pull: float) -> float:
        shift = near
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(m - shift, -30, 30)))
            step = ((p - y).sum() - pull * (shift - near)) / ((p * (1 - p)).sum() + pull)
            shift += float(np.clip(step, -1, 1))
        return shift

    every = best(m, y, 0.0, 2.0)
    return np.array([best(m[group == g], y[group == g], every, 2.0) for g in range(len(GROUPS))])


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN) -> Convolution:
    """Fit on labelled rows for which ``usable`` (an expression over ``doc_id``) holds."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * max_train ids
    got = rows.select("doc_id", "y", "text").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda k: (got["doc_id"][k], got["text"][k]))
    return fit([got["text"][k] for k in order], np.array([got["y"][k] for k in order], dtype=np.float32))


def score(docs: DataFrame, model: Convolution) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # arrays of fixed size

    def start():
        words = Words()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, out, at, size = texts_of(batch), [], 0, 0
            for k, t in enumerate(texts):  # some million characters at a time
                size += len(t)
                if size > 1_500_000 or k + 1 == len(texts):
                    if len(words.number) > CACHE_WORDS:
                        words.__init__()
                    out.append(shared.value.score(words, texts[at : k + 1]))
                    at, size = k + 1, 0
            s = np.concatenate(out)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

        return each

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs.select("doc_id", "text"), start, f"doc_id {kind}, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Scores of all documents by a model that never saw the rows whose crc32 of the id is divisible by 5."""
    held = doc_crc() % 5 == 0
    out = score(docs, train(docs, labels, ~held, max_train))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
