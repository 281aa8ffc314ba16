"""Training-order materialisation: token sequences in a keyed global order, as fixed-stride shards.

Every task lays its documents one after another, each followed by an end mark, and cuts the row of tokens into sequences of
``length``; only a task's last sequence is padded. Tokens are the UTF-8 bytes, or what ``encode`` makes of the texts; the end
mark and the padding are the two ids from ``free`` on, which lie outside the vocabulary. Ids have 16 bits, or 32 if they don't
fit. Sequences are numbered in the order of the written table; a keyed Feistel network over the next even number of bits,
walked until it falls below the number of sequences, sends each number to its slot without a table and can be inverted.
Ranges of slots are shards, and every range goes to one task by its number alone. Slot ``s`` lies at byte
``(s % records) * stride`` of shard ``s // records``, so a reader resumes at any slot by one seek.

The numbering is that of the written sequence table, so a recomputed task can't change it. ``write_shards`` writes a shard to
a name of its task attempt and renames it when complete, so a repeated task leaves whole files only.

The manifest has a row for each sequence: slot, shard, offset, tokens without padding, the hash of the record, and its pieces:
which tokens of which document lie where. A null text is the empty text: an end mark alone. Repeated rows are documents of their
own, ties need nothing, very long texts go on through as many sequences as they need. An empty table has no shard. Other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import batches_of, bound_batches, materialise, texts_of

LENGTH, RECORDS, ROUNDS = 1024, 4096, 6
FREE = 256  # the first id that is no byte


def _mix(x: np.ndarray, key: int, r: int, mask: int) -> np.ndarray:
    h = (x ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(29)) & np.uint64(mask)


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot of each number below ``n``, or with ``inverse`` the number of each slot."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & np.uint64(mask)
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            a, b = (b ^ _mix(a, key, r, mask), a) if inverse else (b, a ^ _mix(b, key, r, mask))
        x[todo] = a << np.uint64(half) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def as_bytes() -> Callable[[list[str]], list[bytes]]:
    """The ids of texts where no vocabulary is given."""
    return lambda texts: [np.frombuffer(t.encode(), np.uint8).astype("<u2").tobytes() for t in texts]


def sequences(docs: DataFrame, length: int = LENGTH, encode=as_bytes, free: int = FREE, width: int = 2) -> DataFrame:
    """``task, k, n_tokens, payload, pieces`` of each sequence, with its place in the task; the payload is the whole record."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    ids = f"<u{width}"
    stride = length * width
    end, pad = np.array([free], ids).tobytes(), np.array([free + 1], ids).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, ready = TaskContext.get().partitionId(), 0, encode()
        held, pieces = bytearray(), []  # of the sequence begun: its bytes, and (document, its first token there, place, tokens)
        payloads, owners, cuts, out = [], [], [0], None

        def close() -> None:
            payloads.append(bytes(held))
            owners.extend(pieces)
            cuts.append(len(owners))
            held.clear()
            pieces.clear()

        def made(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal k, payloads, owners, cuts
            place = np.arange(k, k + len(payloads))
            k += len(payloads)
            doc, begin, at, n = zip(*owners)
            used = np.add.reduceat(np.array(n, np.int32), cuts[:-1])
            inner = pa.StructArray.from_arrays(
                [pa.array(doc, kind), pa.array(begin, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "first", "at", "n"]
            )
            columns = [
                pa.array(np.full(len(place), task, np.int32)), pa.array(place), pa.array(used, pa.int32()), pa.array(payloads, pa.binary()),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), inner),
            ]
            payloads, owners, cuts = [], [], [0]
            return pa.RecordBatch.from_arrays(columns, ["task", "k", "n_tokens", "payload", "pieces"])

        for batch in batches_of(batches):
            out = batch.schema.field("doc_id").type
            for doc, code in zip(batch.column("doc_id").to_pylist(), ready(texts_of(batch))):
                code += end
                for begin in _cuts(len(code), stride, len(held)):
                    part = code[begin : begin + stride - len(held)]
                    pieces.append((doc, begin // width, len(held) // width, len(part) // width))
                    held += part
                    if len(held) == stride:
                        close()
            if payloads:
                yield made(out)
        if held:
            held += pad * ((stride - len(held)) // width)
            close()
            yield made(out)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"task int, k bigint, n_tokens int, payload binary, pieces array<struct<doc_id:{kind},first:bigint,at:int,n:int>>"
    )


def _cuts(size: int, stride: int, held: int) -> Iterator[int]:
    """Where the parts of a document of ``size`` bytes begin, if ``held`` bytes of a sequence are full already."""
    at = 0
    while at < size:
        yield at
        at += stride - held
        held = 0


def placed(docs: DataFrame, key: int, length: int = LENGTH, records: int = RECORDS, encode=as_bytes, free: int = FREE, width: int = 2) -> tuple[DataFrame, int]:
    """The written sequences with ``slot`` and ``shard``, and how many there are."""
    made = materialise(sequences(docs, length, encode, free, width), "sequences", level=9)
    counts = made.groupBy("task").agg(F.max("k").alias("last"))
    over = Window.orderBy("task")  # one row for each task
    first = counts.select("task", (F.sum(F.col("last") + 1).over(over) - F.col("last") - 1).alias("first"))
    n = counts.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(0))).first()[0]

    @F.arrow_udf("bigint")
    def slot_of(number: pa.Array) -> pa.Array:  # payloads stay in the JVM
        return pa.array(permute(number.to_numpy(zero_copy_only=False), n, key))

    numbered = made.join(F.broadcast(first), "task").withColumn("slot", slot_of(F.col("first") + F.col("k")))
    return numbered.withColumn("shard", F.expr(f"slot div {records}")), n


def _manifest(rows: DataFrame, records: int, stride: int) -> DataFrame:
    at = (F.col("slot") % records) * stride
    return rows.select("slot", "shard", at.alias("byte_offset"), "n_tokens", F.sha2("payload", 256).alias("record_sha256"), "pieces")


def manifest(docs: DataFrame, key: int, length: int = LENGTH, records: int = RECORDS, encode=as_bytes, free: int = FREE, width: int = 2) -> DataFrame:
    """Where each sequence lies, and the hash of its record; no shard is written."""
    return _manifest(placed(docs, key, length, records, encode, free, width)[0], records, length * width)


def write_shards(
    docs: DataFrame, folder: str, key: int, length: int = LENGTH, records: int = RECORDS, encode=as_bytes, free: int = FREE, width: int = 2
) -> DataFrame:
    """Write ``shard-*.bin`` under ``folder`` (any URI that pyarrow opens, shared by all executors) and return the manifest.

    The shards are complete when this returns; the manifest is read from the sequence table.
    """
    rows, n = placed(docs, key, length, records, encode, free, width)
    dealt = rows.select("slot", "shard", "payload").repartitionById(max(1, -(-n // records)), F.col("shard").cast("int")).sortWithinPartitions("slot")
    got = _written(dealt, folder).agg(F.sum("records")).first()[0] or 0
    if got != n:
        raise RuntimeError(f"{got} of {n} records were written")
    return _manifest(rows, records, length * width)


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of sorted rows and returns ``shard, records`` of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_shard, out, name, count = None, None, "", 0

        def done() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(name, f"{root}/shard-{open_shard:08d}.bin")
                yield pa.RecordBatch.from_arrays([pa.array([open_shard], pa.int64()), pa.array([count], pa.int64())], ["shard", "records"])

        for batch in batches:
            for payload, shard in zip(batch.column("payload"), batch.column("shard").to_numpy().tolist()):
                if shard != open_shard:
                    yield from done()
                    open_shard, name, count = shard, f"{root}/.{shard}-{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(name)
                out.write(payload.as_buffer())  # of the batch, not copied
                count += 1
        yield from done()

    return rows.mapInArrow(run, "shard bigint, records bigint")


def read_records(folder: str, slot: int, count: int, n: int, length: int = LENGTH, records: int = RECORDS, width: int = 2) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``slot`` on, padding included; each shard is opened once and read in order."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    stride, end = width * length, min(slot + count, n)
    while slot < end:
        shard, at = divmod(slot, records)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            for _ in range(min(end - slot, records - at)):
                yield np.frombuffer(f.read(stride), f"<u{width}")
                slot += 1
