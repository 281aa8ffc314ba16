"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes some 17 measurements of its whole text. Cyclic boosting visits the measurements in turn and adds a
shallow tree over the bins of one, then of chosen pairs, so the model is one table for each measurement and pair. A score is
the logistic of the sum of table entries, read by bin numbers for a batch of documents at once.

The model is fitted on the driver from at most ``max_train`` labelled rows, those least by hash of their id (a documented
bound); only their measurements are collected. Everything else covers all rows.

Null and empty texts have measurements of zero and get a score like any other. Of rows with one id, each is scored by its
own text; of several labels of an id the greatest holds, null labels are left out. Without examples of both labels the score
is the smoothed share of label 1. Other columns, such as ``label`` or ``score``, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import doc_crc, map_texts, texts_of

FEATURES = (
    "log_words", "log_chars", "word_bytes", "word_spread", "distinct", "trigrams_repeated", "lines_repeated", "line_words",
    "upper", "digits", "stops", "bangs", "symbols", "quotes", "non_ascii", "words_with_symbols", "short_words",
)
MAX_TRAIN = 20_000
_SYMBOLS, _STOPS, _BANGS, _QUOTES = b"#*$%&|<>=_~^{}[]\\/@", b".,;:", b"!?", b"\"'()"
_SPACES = b" \t\n\x0b\x0c\r"


def measurements(text: str) -> list[float]:
    """The values of FEATURES for one whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    many = lambda chars: int(of[list(chars)].sum())
    solid = len(raw) - many(_SPACES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    symbols = many(_SYMBOLS)
    flagged = sum([1 for w in words if w[-1] in _SYMBOLS or w[0] in _SYMBOLS]) if symbols else 0
    return [
        float(np.log1p(n)),
        float(np.log1p(len(text))),
        solid / n,
        float(sizes.std()),
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        int(of[65:91].sum()) / solid,
        int(of[48:58].sum()) / solid,
        many(_STOPS) / n,
        many(_BANGS) / n,
        symbols / n,
        many(_QUOTES) / n,
        int(of[128:].sum()) / solid,
        flagged / n,
        float((sizes <= 2).mean()),
    ]


@dataclass
class Additive:
    """Lookup tables over binned measurements."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    coarse: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if self.tables:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                out += t[b[:, j]]
            for (i, j), g in zip(self.pairs, self.grids):
                out += g[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Newton steps of a tree over ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0), -1.0)
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, least)])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pairs: int = 6) -> Additive:
    """Cyclic boosting of one-measurement trees, then of trees over the pairs that explain most of what is left."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Additive(bias, [], [], [], [], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(bias, edges, [np.zeros(len(e) + 1) for e in edges], [], [], [])
    b = model.bins(x)
    f = np.full(len(y), bias)
    # of the two labels, each weighs half
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -35, 35)))
        return w * (y - p), w * np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), 2, 1e-3)
            t += step
            f += step[b[:, j]]
    side = 8
    model.coarse = [np.minimum(np.arange(len(t)) * side // len(t), side - 1) for t in model.tables]
    c = np.stack([m[b[:, j]] for j, m in enumerate(model.coarse)], axis=1)
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * side + c[:, j], v, side * side).reshape(side, side)

    found = [(float((grid(i, j, g) ** 2 / (grid(i, j, h) + 1.0)).sum()), i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:pairs]]
    model.grids = [np.zeros((side, side)) for _ in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), table in zip(model.pairs, model.grids):
            g, h = slopes()
            gs, hs = grid(i, j, g), grid(i, j, h)
            rows = _tree(gs.sum(1), hs.sum(1), 1, 1e-3)  # first a split along one side, then along the other within each part
            step = np.zeros_like(table)
            for v in np.unique(rows):
                part = rows == v
                step[part] = _tree(gs[part].sum(0), hs[part].sum(0), 1, 1e-3)
            table += rate * step
            f += rate * step[c[:, i], c[:, j]]
    return model


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the measurements."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([measurements(t) for t in texts_of(batch)])
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

        return each

    return map_texts(docs.select("doc_id", "text"), start, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


def training_rows(labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids, least by hash: bounded whatever the input."""
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN) -> Additive:
    """Fit on labelled rows for which ``usable`` (an expression over ``doc_id``) holds."""
    chosen = F.broadcast(training_rows(labels, "quality", usable, max_train))  # at most max_train rows
    rows = measured(docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id")).join(chosen, "doc_id")
    got = rows.select("doc_id", "y", "x").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda k: (got["doc_id"][k], got["x"][k]))
    x = np.array([got["x"][k] for k in order]).reshape(-1, len(FEATURES))
    return fit(x, np.array([got["y"][k] for k in order], dtype=float))


def score(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = shared.value.score(np.array([measurements(t) for t in texts_of(batch)]))
            out = [batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted"])

        return each

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs.select("doc_id", "text"), start, f"doc_id {kind}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Scores of all documents by a model that never saw the rows whose crc32 of the id leaves 2 when divided by 4."""
    held = doc_crc() % 4 == 2
    out = score(docs, train(docs, labels, ~held, max_train))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score reaches ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([measurements(t or "") for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array(shared.value.score(x) >= threshold))

        return each

    return map_texts(docs, start, docs.schema)
