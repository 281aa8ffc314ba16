"""Near-duplicates by SimHash.

A fingerprint has 64 bits; two documents link if theirs differ in at most three, and components of links are groups of near
copies. The search embeds a fingerprint as the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the number of differing bits, so pairs further apart than three need no look. Of two halves of a vector
at distance three or less, one is at distance one or less: each fingerprint stands in the grid cell of each half and asks its
own cell and those one count higher; every link thus meets in some cell, whichever of the two asks. There the distances are
verified, first of the vectors' halves by construction, then exactly by XOR.

Only distinct fingerprints enter the search, so exact copies cost one row. In a cell, links are reported as a spanning forest,
never as all pairs; a cell of more than ``CELL`` fingerprints is cut into chunks and each pair of chunks is searched apart, so
no task holds an unbounded group and no link is lost. Components come from alternating large-star and small-star steps over
the links (Kiveris et al., "Connected components in MapReduce and beyond"), each written to the shared folder.

``keep_one`` has a criterion of its own: texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. The same search, over the same fingerprints, gives its first candidates: texts of one fingerprint, and links of the grid.
It can't tell all, as most pairs at 0.8 differ in more than three bits. So texts that share one of ``BANDS`` bands of ``ROWS``
MinHash values are candidates besides, which a pair at 0.8 misses with a probability of 5e-8; each candidate pair is then verified
on the whole sets. With the grid's, every text is compared with the first text of a few of its cells. Then texts go that can't be
similar to any other of those not connected yet, as too many of their shingles stand in none. What is left is dealt by cell, with
its shingles, and each text outside a cell's largest component is held against the whole cell, through the list of texts that
each shingle stands in; a cell reports a spanning forest of links. A cell of over ``CHUNK`` shingles is cut into chunks and every
two chunks meet in a task, so no task holds an unbounded group and no link is lost.

A null text is the empty text: its fingerprint is zero and links like any other. Null ids take part and count as greater than
all others; rows with equal ids are rows of one document id with their own texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import map_texts, materialise, texts_of

SHINGLE = 3
DISTANCE = 3
CELL = 4096
NEAR_SHINGLE, NEAR, BANDS, ROWS = 5, 0.8, 32, 4
ASKED = 3
CHUNK = 2_000_000  # shingles that meet in one task
_BLOCK = 65_536


def _shingles(text: str, size: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle starts and ends; no words have none."""
    words = text.encode().lower().split()  # of bytes: A-Z alone, and only ASCII spaces
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = size - 1 if len(words) > size else len(words) - 1
    return joined, starts[: len(words) - last].tolist(), ends[last:].tolist()


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Bits set in over half the hashes of the text's shingles, as an unsigned number."""
    joined, a, b = _shingles(text, size)
    if not a:
        return 0
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(a), _BLOCK):
        raw = b"".join([digest(joined[i:j], 42) for i, j in zip(a[k : k + _BLOCK], b[k : k + _BLOCK])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h`` (a hash of the text) and ``fp``, the fingerprint as a signed number."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps)], ["doc_id", "h", "fp"])

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_texts(rows, start, "doc_id bigint, h bigint, fp bigint")


def _cell(fp: Column, half: int) -> Column:
    """The counts of the 16 segments of a half, packed in two bits each."""
    x = fp if half == 0 else F.shiftrightunsigned(fp, 32)
    x = x.bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = F.lit(0x55555555)
    return x.bitwiseAND(pairs) + F.shiftrightunsigned(x, 1).bitwiseAND(pairs)


def candidates(fps: DataFrame) -> DataFrame:
    """``cell, asks, fp``: where each fingerprint stands (asks false) and which cells it asks."""
    cells = []
    for half in (0, 1):
        cell = _cell(F.col("fp"), half) * 2 + half
        more = [
            F.when(F.shiftrightunsigned(cell, 1 + 2 * k).bitwiseAND(F.lit(3)) < 2, cell + (2 << (2 * k))) for k in range(16)
        ]  # one count higher, if a segment has room
        cells.append(F.struct(cell.alias("cell"), F.lit(False).alias("asks")))
        cells += [F.struct(c.alias("cell"), F.lit(True).alias("asks")) for c in more]
    return fps.select("fp", F.inline(F.filter(F.array(*cells), lambda c: c["cell"].isNotNull())))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers, numpy would count the bits of the absolute value


def _forest(home: np.ndarray, asking: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``home`` and between it and ``asking``."""
    every = np.concatenate([home, asking])
    label = np.arange(len(every))
    out: list[tuple[int, int]] = []
    for i, one in enumerate(home):
        near = np.flatnonzero((_distance(every, one) <= DISTANCE) & (label != label[i]))
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            out += [(int(one), int(x)) for x in every[near[first]] if x != one]
            label[np.isin(label, joined)] = label[i]
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells come sorted; the last of a batch may go on in the next."""

    def found(cells: np.ndarray, asks: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[cuts, len(cells)])
        homes = np.add.reduceat((~asks).astype(np.int64), cuts) if len(cuts) else cuts
        two = cuts[(sizes == 2) & (homes > 0)]
        x, y = fps[two], fps[two + 1]
        close = (_distance(x, y) <= DISTANCE) & (x != y)
        more: list[tuple[int, int]] = []
        for at, n in zip(cuts[(sizes > 2) & (homes > 0)].tolist(), sizes[(sizes > 2) & (homes > 0)].tolist()):
            one, ask = fps[at : at + n], asks[at : at + n]
            more += _forest(one[~ask], one[ask])
        pair = np.concatenate([np.stack([x[close], y[close]], axis=1), np.array(more, np.int64).reshape(-1, 2)])
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        cells = np.stack([batch.column(c).to_numpy() for c in ("cell", "chunk")], axis=1)
        asks, fps = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()
        if held:
            cells, asks, fps = np.concatenate([held[0], cells]), np.concatenate([held[1], asks]), np.concatenate([held[2], fps])
        if not len(cells):
            continue
        last = int(np.flatnonzero((cells != cells[-1]).any(axis=1))[-1]) + 1 if (cells != cells[-1]).any() else 0
        held = cells[last:], asks[last:], fps[last:]
        if last:
            yield found(cells[:last], asks[:last], fps[:last])
    if held:
        yield found(*held)


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints, ``fp``: enough of them to connect whatever is linked."""
    spark = fps.sparkSession
    rows = candidates(fps)
    full = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("asks")).alias("homes")).where("homes > 0 and n > 1")
    # cells where two or more meet: the rest of the rows need not move again. Spark takes either side for no larger than the
    # fingerprints, of which each makes some 34 rows, and would broadcast it through the driver
    met = rows.join(full.hint("merge"), "cell").withColumn("chunks", F.ceil(F.col("n") / CELL).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # home chunk i meets chunk j of the asking and, for i <= j, of the other homes
    many = F.when(
        F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i * F.col("chunks") + part)
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: part * F.col("chunks") + j))
    dealt = met.select("cell", "asks", "fp", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(many)).alias("chunk"), "chunks")
    # homes of one cell in several chunks meet each other as home and asking
    again = met.where("chunks > 1 and not asks").select(
        "cell", F.lit(True).alias("asks"), "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i * F.col("chunks") + part)).alias("chunk"), "chunks",
    )
    dealt = dealt.unionByName(again).drop("chunks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "chunk").sortWithinPartitions("cell", "chunk").mapInArrow(_search, "a bigint, b bigint")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node, root``: the least node that each node of ``edges`` (``a, b``) is connected with."""
    # signed order puts fingerprints in some fixed order; any will do
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        stars = least.select("u", F.col("m").alias("v"))
        after = materialise(small.unionByName(stars).where("u != v").distinct(), "stars")
        now, sign = after, after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the component is named by its least id."""
    prints = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = components(links(distinct.select("fp")))
    named = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # left, so that only the side of fewer rows may be broadcast: the files of the other may be small and its rows many
    named = named.join(names, "root", "left").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, size: int = NEAR_SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the sorted hashes of its distinct shingles."""
    joined, a, b = _shingles(text, size)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
    return xxhash.xxh64_intdigest(joined, 42), np.unique(hashes)


_SALTS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """The cell of each band: a hash of its MinHash values."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[k : k + 512] ^ _SALTS[0]) * _SALTS[1]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)]


def _nodes(docs: DataFrame) -> DataFrame:
    """``doc_id, h, node, n, fp, bands`` of every row; rows with the same words are one node."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(t) for t in texts_of(batch)]
            cells = np.array([bands(s) for _, s in found], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(cells))
            node, n = np.array([x for x, _ in found], np.uint64).view(np.int64), np.array([len(s) for _, s in found], np.int64)
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(node), pa.array(n), pa.array(fps), lists],
                ["doc_id", "h", "node", "n", "fp", "bands"],
            )

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return map_texts(rows, start, "doc_id bigint, h bigint, node bigint, n bigint, fp bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of ``node, text``."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(t)[1].view(np.int64) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

        return each

    return map_texts(texts, start, "node bigint, shingles array<bigint>")


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes, not verified yet: the first node of each fingerprint with its others, and with those of linked fingerprints."""
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = nodes.select("node", "fp").distinct().join(firsts, "fp", "left").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = links(firsts.select("fp")).join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return materialise(same.where("a != b").unionByName(near).distinct(), "grid")


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` of nodes with a similarity of ``NEAR`` or more: enough of them to connect whatever is linked."""
    grid = grid_pairs(nodes)
    cells = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands")).select("node", "n", F.explode("bands").alias("cell"))
    own = Window.partitionBy("cell")
    met = cells.select("cell", "node", "n", F.min("node").over(own).alias("least"), F.max("node").over(own).alias("most"))
    met = materialise(met.where("least != most").drop("least", "most"), "cells")
    # one text of each node that meets another, in a cell of either kind
    meeting = met.select("node").unionByName(grid.select(F.col("a").alias("node"))).unionByName(grid.select(F.col("b").alias("node")))
    of = nodes.join(meeting.distinct(), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(of, "h").dropDuplicates(["node"])
    sets = materialise(_sets(texts.select("node", "text")), "shingles")
    met = met.select("cell", "node", "n")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        shared = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("s") + F.size("t")).alias("all"))
        return materialise(shared.where(F.col("both") / (F.col("all") - F.col("both")) >= NEAR).select("a", "b"), name)

    able = F.least("n", "m") >= NEAR * F.greatest("n", "m") - 1e-6
    # the first text of each cell meets the others; every text asks in a few of its cells
    order = F.xxhash64("cell", "node")
    first = F.min(F.struct(order.alias("h"), "node", "n")).over(own)
    asked = met.withColumn("p", first).where("node != p.node").withColumn("m", F.col("p.n")).where(able)
    some = F.row_number().over(Window.partitionBy("node").orderBy(order))  # BANDS rows at most
    stars = asked.withColumn("k", some).where(F.col("k") <= ASKED).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
    linked = verified(grid.unionByName(stars).distinct(), "stars")
    roots = met.join(components(linked), "node", "left").select("cell", "node", "n", F.coalesce("root", "node").alias("root"))
    left = _apart(_able(_apart(roots), sets)).join(sets, "node")
    # of a large cell, every two chunks meet
    load = F.sum("n").over(own)
    dealt = left.withColumn("chunks", F.ceil(load / CHUNK).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met_with = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, "part") * F.col("chunks") + F.greatest(k, "part"))
    dealt = dealt.select("cell", F.explode(met_with).alias("chunk"), "node", "root", "shingles")
    return linked.unionByName(dealt.groupBy("cell", "chunk").applyInArrow(_forest_of_sets, "a bigint, b bigint"))


def _forest_of_sets(rows: pa.Table) -> pa.Table:
    """Links that connect whatever in a cell is similar enough and has different roots."""
    node, sets = rows.column("node").to_numpy(), rows.column("shingles").combine_chunks()
    offsets, n = sets.offsets.to_numpy(), np.diff(sets.offsets.to_numpy())
    code = np.unique(sets.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
    offsets = offsets - offsets[0]
    held = np.repeat(np.arange(len(node)), n)[np.argsort(code, kind="stable")]  # the texts of each shingle
    many = np.bincount(code, minlength=1)
    begin = np.cumsum(many) - many
    label = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():  # those of the largest component are asked only
        mine = code[offsets[i] : offsets[i + 1]]
        size = many[mine]
        places = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        both = np.bincount(held[places], minlength=len(node))
        near = np.flatnonzero((both / np.maximum(n[i] + n - both, 1) >= NEAR) & (label != label[i]))
        if len(near):
            joined, at = np.unique(label[near], return_index=True)
            out += [(int(node[i]), int(x)) for x in node[near[at]]]
            label[np.isin(label, joined)] = label[i]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _apart(met: DataFrame) -> DataFrame:
    """The rows of cells whose nodes are not all connected yet."""
    own = Window.partitionBy("cell")
    marked = met.withColumns({"x": F.min("root").over(own), "y": F.max("root").over(own)})
    return materialise(marked.where("x != y").drop("x", "y"), "apart")


def _able(met: DataFrame, sets: DataFrame) -> DataFrame:
    """``met`` without nodes that can't be similar to any other: too many of their shingles stand in no other node."""
    here = sets.join(met.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    alone = here.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return met.join(alone, "node", "left").where(F.col("n") - F.coalesce("alone", F.lit(0)) >= NEAR * F.col("n") - 1e-6).drop("alone")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, less all but one of each group that ``near_links`` connects: that of least id, then least text hash."""
    prints = materialise(_nodes(docs), "nodes")
    of = components(near_links(docs, prints))
    named = prints.select("doc_id", "h", "node").join(of, "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    best = named.groupBy("root").agg(F.min(first).alias("first"))
    chosen = best.select(*[F.col(f"first.{c}").alias(f"__{c}") for c in ("none", "id", "h")])
    keyed = docs.withColumns({
        "__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__h": F.xxhash64("text"),
    })
    same = Window.partitionBy("__none", "__id", "__h").orderBy("__h")  # rows that are copies with one id
    kept = keyed.join(chosen, ["__none", "__id", "__h"], "left_semi")
    return kept.withColumn("__k", F.row_number().over(same)).where("__k = 1").select(*docs.columns)
