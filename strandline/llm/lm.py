"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Words are counted over all training texts; the base score is their add-one unigram probability. The model factors a word as
its class given the two words before it, times the word given its class. The most frequent words are classes of their own, all
others share classes by a hash of their last bytes, so a class is known for every word, seen or not. Classes are predicted from
hashed indicator features of the context. Features of words: the word before, and the word before that as a skip feature, each by
its own 64-bit hash, so there are as many as the training texts have distinct words. Features of classes, which serve rare words:
either class before, both together, and neither. Within a class, words have add-one shares of its training tokens, and one share is kept for unseen words.

Training is full-batch: the sufficient statistics, tokens by context and class, are summed over the whole training corpus,
and every update adds up gradients that Spark tasks compute from their share of them; a step compares observed with
expected feature counts, as iterative scaling does. Features of classes are trained first. Then each word's features are trained
where all its counts meet, against the counts that the features of classes expect around it; a pair of feature and class has a
weight only if it adds GAIN to the log-likelihood. The trained weights go by shuffle to the blocks that have the word. Scores are
read from log-probabilities of the batch's distinct contexts, which numpy computes from the sparse features; each token's share is
then changed by the weights of the words before it and normalised over all classes.

Counting avoids a row for each token: every task packs its documents into compressed blocks of bounded size, which are written
once; a block reports each distinct word once, and gets its count back the same way. So a very frequent word has one row a
block, and texts travel packed.

A null text is the empty text: no words and one end mark. An empty table or one without training rows is scored with counts
of zero. Repeated rows count and score as often as they come; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import bound_batches, materialise, remove, slices

END = b""  # no word is empty
HEAD, TAIL = 112, 16  # classes of single words, and of all other words
CLASSES = HEAD + TAIL
HASHES = 1 << 15
BLOCK_BYTES = 12 << 20  # of text; a longer document is a block of its own
TOKENISED_BYTES = 1 << 20  # of text, made tokens at once
SCORED_TOKENS = 25_000  # scored at once
STEPS = 8
PARTS = 4  # tasks that share the gradient
PACE = 0.25  # four features are on at once
BEFORE, AFTER, SECOND = 0, CLASSES + 1, 2 * CLASSES + 1  # slots of the classes around a word
SLOTS = 3 * CLASSES + 1
PRIOR, GAIN, WORD_PACE = 30.0, 3.0, 0.7  # word features: prior tokens, least gain in nats, share of a step
PIECE_TEXTS = 100_000
MOST = 127  # of a record of neighbours
WEIGHT = np.dtype([("slot", "u1"), ("w", "<f2")])
WORDS_AT_ONCE = 4_096
GAINS_AT_ONCE = 1_000


def tokens(text: str | None) -> list[bytes]:
    """The tokens of one text; ``tokenised`` gives the same for many."""
    out = (text or "").encode().lower().split()  # of bytes: A-Z alone, and only ASCII spaces
    out.append(END)
    return out


def tokenised(texts: pa.ChunkedArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words by first occurrence, the number of each token's word, and the tokens of each text; no token is a Python object."""
    pc, found, sizes = pa.compute, [], []
    for part in itertools.chain.from_iterable(_slices(chunk) for chunk in texts.chunks):
        part = pc.ascii_trim_whitespace(pc.ascii_lower(part))
        closed = pc.if_else(pc.equal(part, ""), part, pc.binary_join_element_wise(part, "", " "))
        lists = pc.ascii_split_whitespace(closed)  # behind a last space, and in an empty text, stands the empty word: the end
        found.append(lists.flatten().dictionary_encode())
        sizes.append(lists.value_lengths().to_numpy())
    del part, closed, lists
    coded = pa.chunked_array(found).unify_dictionaries()
    words, numbers = coded.chunk(0).dictionary.cast(pa.binary()), np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    del found, coded
    pa.default_memory_pool().release_unused()
    return words, numbers, np.concatenate(sizes).astype(np.int64)


def _slices(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    rows = max(1, len(texts) * TOKENISED_BYTES // max(texts.nbytes, 1))
    for at in range(0, max(len(texts), 1), rows):
        yield texts.slice(at, rows)


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-2:]) % TAIL


def classes_of(words: pa.BinaryArray, head: dict[bytes, int]) -> np.ndarray:
    """The class of each word: its own, or one of the TAIL."""
    own = pa.compute.index_in(words, pa.array(list(head), pa.binary()))
    last = pa.compute.binary_slice(words, -2).dictionary_encode()  # few distinct ones
    tail = np.array([tail_class(w) for w in last.dictionary.to_pylist()], np.int32)[last.indices.to_numpy()]
    found = np.fromiter(head.values(), np.int32, len(head))[own.fill_null(0).to_numpy()]
    return np.where(own.is_valid().to_numpy(zero_copy_only=False), found, tail)


def features(context: np.ndarray) -> np.ndarray:
    """The four hashed features of contexts ``a * (CLASSES + 1) + b`` (b the class before, a the one before that)."""
    a, b = context // (CLASSES + 1), context % (CLASSES + 1)

    def place(kind: int, x: np.ndarray) -> np.ndarray:
        h = (x.astype(np.uint64) + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - int(math.log2(HASHES)))).astype(np.int64)

    return np.stack([place(0, np.zeros_like(a)), place(1, b), place(2, a), place(3, context)], axis=1)


def log_probabilities(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural logarithms of the class shares for each context."""
    z = weights[features(context)].sum(axis=1)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Model:
    head: dict[bytes, int]
    logs: np.ndarray  # log_probabilities of all contexts
    mass: np.ndarray  # of each class: its add-one tokens and one for unseen words
    tokens: int
    distinct: int

    @functools.cached_property
    def shares(self) -> np.ndarray:
        return np.exp(self.logs)


def contexts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the two classes before it in its text; CLASSES stands for none."""
    b = np.full(len(classes), CLASSES, np.int64)
    b[1:] = classes[:-1]
    b[starts] = CLASSES
    a = np.full(len(classes), CLASSES, np.int64)
    a[1:] = b[:-1]
    a[starts] = CLASSES
    return a * (CLASSES + 1) + b


def _packed(docs: DataFrame, held: str) -> DataFrame:
    """``block, payload``: documents of each task in compressed Arrow batches of some BLOCK_BYTES of text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(held).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, k = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for part in held:
                    w.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "payload"])

        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES - size, side="right")) - at)
                held.append(batch.slice(at, n))
                size += int(ends[at + n - 1] - (ends[at - 1] if at else 0))
                at += n
                if size >= BLOCK_BYTES or at < batch.num_rows:
                    yield out()
                    held, size, k = [], 0, k + 1
        if held:
            yield out()

    return rows.mapInArrow(run, "block bigint, payload binary")


def _unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _block_words(blocks: DataFrame) -> DataFrame:
    """``block, place, word, n``: each distinct word of a block once, at its place by first occurrence, with its training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                rows = _unpacked(payload)
                words, flat, sizes = tokenised(rows.column("text"))
                n = np.bincount(flat[np.repeat(~rows.column("held_out").to_numpy(), sizes)], minlength=len(words))
                found = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), words, pa.array(n)],
                    ["block", "place", "word", "n"],
                )
                del rows, words, flat
                yield from slices(found)
                del found
                pa.default_memory_pool().release_unused()

    return blocks.mapInArrow(run, "block bigint, place int, word binary, n bigint")


def _evidence(blocks: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """What the training texts say, in one pass: ``block, place, key, data``.

    A row of a block tells which classes stand before, after and second after a word, for each distinct word of the block without
    a class of its own (words of held-out texts have empty data). Rows of block -1 hold a task's tokens by context and class.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(head)  # HEAD words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(((CLASSES + 1) ** 2) * CLASSES, np.int32)
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                rows = _unpacked(payload)
                words, every, sizes = tokenised(rows.column("text"))
                train = ~rows.column("held_out").to_numpy()
                del rows
                every, ends = every[np.repeat(train, sizes)], np.concatenate([[0], np.cumsum(sizes[train])])
                own = classes_of(words, shared.value)
                keys = word_keys(words, own)
                for at in range(0, max(len(ends) - 1, 1), PIECE_TEXTS):
                    cuts = ends[at : at + PIECE_TEXTS + 1]
                    flat, starts = every[cuts[0] : cuts[-1]], cuts[:-1] - cuts[0]
                    classes = own[flat]
                    own_contexts = contexts(classes, starts) if len(flat) else np.zeros(0, np.int64)
                    sums += np.bincount(own_contexts * CLASSES + classes, minlength=len(sums)).astype(np.int32)
                    data = _neighbours(flat, classes, own_contexts, own, len(own))
                    # held-out words are named once, with the first piece
                    use = np.flatnonzero((own >= HEAD) & ((np.diff(data[0]) > 0) | (at == 0)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(use), block)), pa.array(use.astype(np.int32)), pa.array(keys[use].view(np.int64)),
                            _binaries(*data).take(pa.array(use)),
                        ],
                        ["block", "place", "key", "data"],
                    )
        at = np.flatnonzero(sums)
        chunks = [np.stack([c // CLASSES, c % CLASSES, sums[c]]).astype(np.int32).tobytes() for c in np.array_split(at, len(at) // 8192 + 1)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(chunks), -1)), pa.array(np.zeros(len(chunks), np.int32)), pa.array(np.zeros(len(chunks), np.int64)),
                pa.array(chunks, pa.binary()),
            ],
            ["block", "place", "key", "data"],
        )

    return blocks.mapInArrow(run, "block bigint, place int, key bigint, data binary")


def word_key(word: bytes) -> int:
    """A word's hash; its low bits are its class among the TAIL, so that a key tells the class."""
    return int(word_keys(pa.array([word], pa.binary()), np.array([tail_class(word)]))[0])


def word_keys(words: pa.BinaryArray, classes: np.ndarray) -> np.ndarray:
    """As ``word_key``, for words of these classes; those of the head have no key of use."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
    return hashes & ~np.uint64(TAIL - 1) | (classes % TAIL).astype(np.uint64)  # HEAD is a multiple of TAIL


def _binaries(offsets: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """Values between offsets as one binary each."""
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _neighbours(flat: np.ndarray, classes: np.ndarray, context: np.ndarray, own: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by word, and ``slot << 7 | count`` of the classes around its places."""
    tail = np.flatnonzero(own[flat] >= HEAD)
    found = []
    for first, step in ((BEFORE, 0), (AFTER, 1), (SECOND, 2)):
        at = tail[tail + step < len(flat)]
        if step == 2:
            at = at[classes[at + 1] != 0]  # the end mark is followed by another text
        side = context[at] % (CLASSES + 1) if step == 0 else classes[at + step]
        found.append(np.unique(flat[at].astype(np.int64) * 512 + first + side, return_counts=True))
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
    order = np.argsort(keys)
    records = (counts[order] - 1) // MOST + 1  # a count over MOST takes several
    keys, left = np.repeat(keys[order], records), np.repeat(counts[order], records)
    counts = np.minimum(left - MOST * (np.arange(len(keys)) - np.repeat(np.cumsum(records) - records, records)), MOST)
    return np.searchsorted(keys // 512, np.arange(words + 1)), ((keys % 512) << 7 | counts).astype(np.uint16)


def _statistics(evidence: DataFrame) -> DataFrame:
    """``context, class, n`` over training texts, for the features of classes: at most (CLASSES + 1) ** 2 * CLASSES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                context, label, n = np.frombuffer(data, np.int32).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(label), pa.array(n.astype(np.int64))], ["context", "class", "n"])

    rows = evidence.where("block = -1").select("data").mapInArrow(run, "context int, class int, n bigint")
    return rows.groupBy("context", "class").agg(F.sum("n").alias("n")).repartition(PARTS, "context")


def word_weights(observed: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, classes and weights of the selected pairs of word feature (a row) and class.

    ``expected`` are the counts that the features of classes alone expect. A pair is selected if it was seen twice, or less than
    expected, and adds GAIN to the log-likelihood; selected ones take STEPS updates along the smoothed gradient.
    """
    n = observed.sum(axis=1)
    q = np.maximum(expected, 1e-9)
    q = q / q.sum(axis=1, keepdims=True)
    # a class that is seen less than expected adds -n log(1 - q) at most
    row, column = np.nonzero((observed >= 2) | (q >= -np.expm1(-GAIN / np.maximum(n, 1))[:, None]))
    seen, q, of = observed[row, column], q[row, column], n[row]
    prior = PRIOR * q
    w = np.log(seen + prior) - np.log((of + PRIOR) * q)
    chosen = (seen * w - of * np.log1p(q * np.expm1(w)) >= GAIN) & ((seen >= 2) | (w < 0))
    row, column, q, of, prior = row[chosen], column[chosen], q[chosen], of[chosen], prior[chosen]
    target, w = np.log(seen[chosen] + prior), np.zeros(len(row))
    for _ in range(STEPS):
        total = 1 + np.bincount(row, q * np.expm1(w), len(n))
        w += WORD_PACE * (target - np.log(of * q * np.exp(w) / total[row] + prior))
    return row, column, w


def _word_features(evidence: DataFrame, weights: np.ndarray) -> DataFrame:
    """``block, place, data``: the weights of the features of each word of a block, if it has any, of type WEIGHT.

    All counts of a word meet in one task, which reads them in a stream and holds sums of one size, and 12 bytes for each block that
    has the word; the features thus grow with the vocabulary, and no table of them is held anywhere as a whole.
    """
    shared = evidence.sparkSession.sparkContext.broadcast(weights)  # HASHES x CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = CLASSES + 1
        every, tail = np.arange(k), HEAD + np.arange(TAIL)
        shares = lambda c: np.exp(log_probabilities(shared.value, c.ravel())).reshape(*c.shape, CLASSES)
        after, second = shares(every[None, :] * k + tail[:, None]), shares(tail[:, None] * k + every[None, 1:CLASSES])

        def trained(key: np.ndarray, sums: np.ndarray) -> pa.BinaryArray:
            n = sums[:, AFTER:SECOND].sum(axis=1)
            some = np.flatnonzero(n >= 2)  # no pair of others can be selected
            both = [np.zeros((len(some), CLASSES)) for _ in range(2)]
            kind, part = (key[some].view(np.uint64) % TAIL).astype(np.int64), sums[some]
            for c in np.unique(kind):
                at = np.flatnonzero(kind == c)
                both[0][at] = part[at, BEFORE:AFTER] @ after[c]
                both[1][at] = part[at, AFTER + 1 : SECOND] @ second[c]
            found = [word_weights(part[:, AFTER:SECOND], both[0]), word_weights(part[:, SECOND:], both[1])]
            row = some[np.concatenate([r for r, _, _ in found])]
            packed = np.zeros(len(row), WEIGHT)
            packed["slot"] = np.concatenate([c + k * CLASSES for k, (_, c, _) in enumerate(found)])
            packed["w"] = np.concatenate([w for _, _, w in found])
            order = np.argsort(row, kind="stable")
            return _binaries(np.searchsorted(row[order], np.arange(len(key) + 1)), packed[order])

        def rows(block: np.ndarray, place: np.ndarray, data: pa.Array) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(block), pa.array(place), data], ["block", "place", "data"])
            return out.filter(pa.compute.greater(pa.compute.binary_length(data), 0))

        open_key, open_sums, open_rows = None, np.zeros(SLOTS), []

        def ended() -> Iterator[pa.RecordBatch]:
            found = trained(np.array([open_key]), open_sums[None])
            for block, place in open_rows:
                yield rows(block, place, found.take(pa.array(np.zeros(len(block), np.int32))))

        for whole in batches:
            for at in range(0, whole.num_rows, WORDS_AT_ONCE):
                batch = whole.slice(at, WORDS_AT_ONCE)
                key, block, place = (batch.column(c).to_numpy() for c in ("key", "block", "place"))
                data = batch.column("data")
                ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] // 2
                flat = np.frombuffer(data.buffers()[2] or b"", np.uint16)[ends[0] : ends[-1]]
                own, where = np.unique(key, return_inverse=True)
                owner = np.repeat(where, np.diff(ends))
                sums = np.bincount(owner * SLOTS + (flat >> 7), flat & MOST, len(own) * SLOTS).reshape(len(own), SLOTS)
                if open_key is not None and own[0] == open_key:
                    open_sums, first = open_sums + sums[0], 1
                    open_rows.append((block[where == 0], place[where == 0]))
                else:
                    first = 0
                if first == len(own):
                    continue
                if open_key is not None:
                    yield from ended()
                last = len(own) - 1
                use = np.flatnonzero((where >= first) & (where < last))
                if len(use):
                    found = trained(own[first:last], sums[first:last])
                    yield rows(block[use], place[use], found.take(pa.array(where[use] - first)))
                open_key, open_sums, open_rows = int(own[last]), sums[last], [(block[where == last], place[where == last])]
        if open_key is not None:
            yield from ended()

    words = evidence.where("block >= 0").repartition("key").sortWithinPartitions("key")
    return words.mapInArrow(run, "block bigint, place int, data binary")


class WordFeatures:
    """Weights of a block's words by their places; words without any share row 0."""

    def __init__(self, place: np.ndarray, data: pa.Array, words: int):
        data = pa.array([], pa.binary()) if not len(data) else data
        lengths = pa.compute.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // WEIGHT.itemsize
        first = data.buffers()[1] and np.frombuffer(data.buffers()[1], np.int32)[data.offset]
        flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[first or 0 :][: int(lengths.sum()) * WEIGHT.itemsize].view(WEIGHT)
        owner = np.repeat(np.arange(1, len(data) + 1), lengths)
        self.row = np.zeros((2, words), np.int64)
        self.ends, self.slot, self.factor = [], [], []
        for kind in range(2):
            use = np.flatnonzero(flat["slot"] // CLASSES == kind)
            n = np.bincount(owner[use], minlength=len(data) + 1)
            has = np.flatnonzero(n)
            self.row[kind, place[has - 1]] = has
            self.ends.append(np.concatenate([[0], np.cumsum(n)]))
            self.slot.append((flat["slot"][use] % CLASSES).astype(np.int64))
            self.factor.append(np.exp(flat["w"][use].astype(np.float32)))

    def factors(self, rows: np.ndarray, kind: int) -> np.ndarray:
        """exp of the weights of ``kind`` (0: the word before, 1: the one before that), by row and class."""
        ends = self.ends[kind]
        sizes = ends[rows + 1] - ends[rows]
        at = np.repeat(ends[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.ones((len(rows), CLASSES), np.float32)
        out[np.repeat(np.arange(len(rows)), sizes), self.slot[kind][at]] = self.factor[kind][at]
        return out

    def gains(self, flat: np.ndarray, starts: np.ndarray, classes: np.ndarray, shares: np.ndarray, where: np.ndarray) -> np.ndarray:
        """What the words before add to the natural logarithm of each token's class share; ``shares[where]`` are those without them."""
        rows = np.zeros((2, len(flat)), np.int64)
        rows[0, 1:] = self.row[0, flat[:-1]]
        rows[1, 2:] = self.row[1, flat[:-2]]
        rows[:, starts] = 0
        rows[1, starts[starts + 1 < len(flat)] + 1] = 0
        factors, at = [], []
        for kind in range(2):
            used = np.zeros(len(self.ends[kind]) - 1, bool)
            used[rows[kind]] = True
            factors.append(self.factors(np.flatnonzero(used), kind))
            at.append((np.cumsum(used) - 1)[rows[kind]])
        out = np.zeros(len(flat))
        active = (rows[0] > 0) + 2 * (rows[1] > 0)
        for which in (1, 2, 3):
            tokens_of = np.flatnonzero(active == which)
            for k in range(0, len(tokens_of), GAINS_AT_ONCE):  # so few that they stay in the processor's cache
                part = tokens_of[k : k + GAINS_AT_ONCE]
                product = factors[1 if which == 2 else 0][at[1 if which == 2 else 0][part]]
                if which == 3:
                    product *= factors[1][at[1][part]]
                total = np.einsum("ij,ij->i", shares[where[part]], product)
                out[part] = np.log(product[np.arange(len(part)), classes[part]]) - np.log(total)
        return out


def _gradient(statistics: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the tasks' gradients of the log-likelihood, and the tokens of each feature."""
    shared = statistics.sparkSession.sparkContext.broadcast(weights)  # HASHES x CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([b.column(c).to_numpy() for c in ("context", "class", "n")], axis=1) for b in batches if b.num_rows]
        if not rows:
            return
        context, label, n = np.concatenate(rows).T
        own, where = np.unique(context, return_inverse=True)
        logs = log_probabilities(shared.value, own)
        size = np.bincount(where, n, len(own))
        g = -np.exp(logs) * size[:, None]
        np.add.at(g, (where, label), n)
        used, at = np.unique(features(own), return_inverse=True)
        full, mass = np.zeros((len(used), CLASSES), np.float64), np.zeros(len(used))
        for column in at.reshape(len(own), -1).T:
            np.add.at(full, column, g)
            np.add.at(mass, column, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in full.astype(np.float32)], pa.binary()), pa.array(mass)],
            ["row", "g", "mass"],
        )

    # contexts of different tasks share a few hundred features only, so this is about HASHES rows
    got = statistics.mapInArrow(run, "row int, g binary, mass double").toArrow()
    shared.destroy()  # each step's weights would stay on every executor's disk
    full, mass = np.zeros((HASHES, CLASSES), np.float32), np.zeros(HASHES)
    np.add.at(mass, got.column("row").to_numpy(), got.column("mass").to_numpy())
    for r, g in zip(got.column("row").to_pylist(), got.column("g").to_pylist()):
        full[r] += np.frombuffer(g, np.float32)
    return full, mass


def _train(statistics: DataFrame) -> np.ndarray:
    """Feature weights after STEPS full-batch updates."""
    weights = np.zeros((HASHES, CLASSES), np.float32)
    observed = None
    for _ in range(STEPS):
        g, mass = _gradient(statistics, weights)
        if observed is None:  # under equal weights every class of a feature is expected alike
            observed = np.maximum(g + (mass / CLASSES)[:, None].astype(np.float32), 0)
        expected = np.maximum(observed - g, 0)
        weights += PACE * (np.log(observed + 2) - np.log(expected + 2))
    return weights


def score_documents(docs: DataFrame, held: str = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2") -> DataFrame:
    """Scores of all documents by a model of those for which ``held`` is false.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = materialise(_packed(docs, held), "blocks")  # so that a recomputed task can't pack otherwise
    same = Window.partitionBy("word")  # as many rows as blocks
    counted = materialise(
        _block_words(blocks).select(
            "block", "place", "word", F.sum("n").over(same).alias("c"), (F.col("block") == F.min("block").over(same)).alias("first")
        ),
        "words",
        free=True,
    )
    once = counted.where("first and c > 0")
    total, distinct = once.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = once.where(F.octet_length("word") > 0).orderBy(F.desc("c"), "word").limit(HEAD - 1).select("word").collect()
    head = {END: 0} | {bytes(r[0]): k + 1 for k, r in enumerate(top)}
    known = spark.createDataFrame([(bytearray(w), k) for w, k in head.items()], "word binary, class int")
    tail = F.lit(HEAD) + F.crc32(F.expr("substring(word, -2)")) % TAIL
    by_class = (
        once.join(F.broadcast(known), "word", "left")  # HEAD rows
        .groupBy(F.coalesce("class", tail.cast("int")).alias("class"))
        .agg(F.sum(F.col("c") + 1).alias("mass"))
        .collect()  # CLASSES rows
    )
    mass = np.ones(CLASSES)
    for r in by_class:
        mass[r["class"]] += r["mass"]
    evidence = materialise(_evidence(blocks, head), "evidence")
    weights = _train(materialise(_statistics(evidence), "statistics", free=True))
    features_of = materialise(_word_features(evidence, weights), "features", free=True)
    remove(evidence)  # its counts are as large as the features
    logs = log_probabilities(weights, np.arange((CLASSES + 1) ** 2))  # half as large as the weights
    model = spark.sparkContext.broadcast(Model(head, logs, mass, total, distinct))

    def each(words: pa.Table, rows: pa.Table) -> pa.Table:
        m = model.value
        is_word = pa.compute.is_null(words.column("data"))
        trained, words = words.filter(pa.compute.invert(is_word)), words.filter(is_word)
        counts = np.zeros(len(words), np.int64)
        counts[words.column("place").to_numpy()] = words.column("c").to_numpy()
        added = WordFeatures(trained.column("place").to_numpy(), trained.column("data").combine_chunks(), len(words))
        known, gain = counts > 0, np.log10(counts + 1.0)
        rows = _unpacked(rows.column("payload")[0].as_py())
        words, every, n = tokenised(rows.column("text"))
        class_of = classes_of(words, m.head)
        weight, ends, sums = np.log10(m.mass)[class_of], np.concatenate([[0], np.cumsum(n)]), []
        at = 0
        while at < len(n):  # some texts are scored at once
            stop = int(np.searchsorted(ends, min(ends[at] + SCORED_TOKENS, ends[-1])))
            flat, starts = every[ends[at] : ends[stop]], ends[at:stop] - ends[at]
            classes = class_of[flat]
            where = contexts(classes, starts)
            logs = m.logs[where, classes] + added.gains(flat, starts, classes, m.shares, where)
            logs = logs / math.log(10)
            each_sum = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            sums.append(np.stack([each_sum(known[flat].astype(np.float64)), each_sum(gain[flat]), each_sum(gain[flat] + logs - weight[flat])]))
            at = stop
        seen, base, score = np.concatenate(sums, axis=1)
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": n, "n_known": seen.astype(np.int64),
            "train_tokens": np.full(len(n), m.tokens, np.int64), "base_score": base - n * math.log10(m.tokens + m.distinct + 1), "score": score,
        })

    kind = dict(docs.dtypes)["doc_id"]
    return (
        counted.selectExpr("block", "place", "c", "cast(null as binary) as data")
        .union(features_of.selectExpr("block", "place", "cast(0 as bigint)", "data")).groupBy("block")
        .cogroup(blocks.groupBy("block"))
        .applyInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )
