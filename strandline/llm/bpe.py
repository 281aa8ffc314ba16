"""BPE encoding and decoding by a tokenisation automaton.

The merges of a public vocabulary are compiled into a deterministic automaton over token labels by applying one
merge gadget after another (Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA"; Cognetta and
Okazaki, "Tokenization as finite-state transduction"). The automaton starts with one state and a loop for each byte.
The gadget of merge ``(u, v) -> w`` gives every state that has an arc ``u`` an arc ``w`` leading where ``v`` led, and
moves the target of ``u`` to a copy that lacks the arc ``v``. All arcs of one label keep one common target, so a state is
named by the label that enters it. Written out, the table would have a cell for each pair of labels, some 2.4e9; it is kept as
what the gadgets did (the parts and the time of each label, the time at which each arc was cut), from which a cell follows
by a few lookups, and as a direct-mapped table of the cells last used.

A word is encoded symbol by symbol, without search: a trie of all labels with failure links (Aho and Corasick) gives the labels
that end at a symbol, and exactly one of them is an arc of the state that the automaton has at the symbol where it begins. So
each prefix of a word has one last label, and the word's labels are read back from its end. All words of a batch advance
together, one symbol at a time, by array lookups; a very long word walks alone by the same tables, in linear time. Decoding
emits the labels of the arcs.

The tables are compiled once, on the driver, and broadcast: their size is that of the vocabulary.

Letters and digits are those of Python's Unicode tables; code points that these don't know yet count as signs, and
marks are ordered by them. Nulls count as the
empty text, which has no tokens. Rows are handled one by one, so repeated rows, ties and an empty
table need nothing special; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from strandline.llm._common import map_texts, texts_of

CACHE_RUNS = 100_000  # runs of characters that a worker remembers, in each of two generations
LONG = 256  # bytes; longer words walk alone
CELLS = 20  # the bits of a place in the table of cells
MARK = 256  # the symbol of a word's end
_NEVER, _NONE = 1 << 60, 1 << 61
_LETTERS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_SPACES = regex.compile(r"\p{White_Space}+")
_WIDE_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # those that Arrow doesn't split at
_ODD_SPACES = re.compile(r"[\x1c-\x1f]")  # spaces to str.split only


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """A fixed map of non-negative numbers, read for whole arrays; open addressing, mostly empty."""

    def __init__(self, of: dict[int, int], none: int):
        self.__setstate__((np.fromiter(of, np.int64, len(of)), np.fromiter(of.values(), np.int64, len(of)), none))

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray, int]:
        used = self.keys >= 0  # what is empty isn't sent
        return self.keys[used], self.values[used], self.none

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray, int]) -> None:
        keys, values, self.none = state
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        todo, home = np.arange(len(keys)), _place(keys, self.bits)
        while len(todo):  # of those that want one free place, one gets it
            free = self.keys[home] < 0
            self.keys[home[free]] = keys[todo[free]]
            self.values[home[free]] = values[todo[free]]
            left = self.keys[home] != keys[todo]
            todo, home = todo[left], (home[left] + 1) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = _place(keys, self.bits)
        here = self.keys[at]
        out = np.where(here == keys, self.values[at], self.none)
        todo = np.flatnonzero((here != keys) & (here >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            here = self.keys[at]
            hit = here == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (here >= 0)
            todo, at = todo[more], at[more]
        return out

    def items(self) -> dict[int, int]:
        used = self.keys >= 0
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist()))


class Automaton:
    """Token-level automaton of a BPE vocabulary file, with or without word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        self.marked = int(bool(end))
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.n = max(self.label) + 1
        self.kind = np.dtype("<u2" if self.n + 2 <= 1 << 16 else "<u4")  # two more ids are left for marks
        self.left, self.right, self.born = (np.full(self.n, -1, np.int64) for _ in range(3))
        cuts: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(cuts, k, vocab[a], vocab[b], vocab[a + b])
        self.cut = Lookup(cuts, _NONE)
        self.cells = np.full(1 << CELLS, -2, np.int64)
        symbol = {s: b for b, s in enumerate(byte_symbols())}
        spelt = {}
        for t, i in vocab.items():
            last = self.marked and t.endswith(end) and len(t) > len(end)
            body = t.removesuffix(end) if last else t
            if i not in self.special.values() and all(c in symbol for c in body) and (self.left[i] >= 0 or len(body) == 1):
                spelt[i] = [symbol[c] for c in body] + [MARK] * last
        real = self._real(spelt)
        self._trie({i: s for i, s in spelt.items() if i in real})
        self._scalar: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cells": None, "_scalar": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"cells": np.full(1 << CELLS, -2, np.int64)}

    def _gadget(self, cuts: dict[int, int], k: int, u: int, v: int, w: int) -> None:
        if self.left[w] >= 0:
            raise ValueError("two merges make one token: labels would not be unique")
        self.left[w], self.right[w], self.born[w] = u, v, k
        cuts[u * self.n + v] = k

    def _real(self, spelt: dict[int, list[int]]) -> set[int]:
        """The labels that some state has an arc of: their own parts spell them."""
        made = np.flatnonzero(self.born >= 0)
        u, v = self.left[made], self.right[made]
        ok = dict(zip(made.tolist(), self._replay(u, v, self.born[made] - 1).tolist()))
        real = {i for i in spelt if self.left[i] < 0}
        for w in made[np.argsort(self.born[made])].tolist():
            if ok[w] and int(self.left[w]) in real and int(self.right[w]) in real and w in spelt:
                real.add(w)
        return real

    def _trie(self, spelt: dict[int, list[int]]) -> None:
        edges: dict[int, int] = {}
        token, depth, parent, entered = [-1], [0], [0], [0]
        for i, symbols in spelt.items():
            at = 0
            for c in symbols:
                key = at << 9 | c
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    entered.append(c)
                at = edges[key]
            token[at] = i
        fail, shorter = [0] * len(token), [0] * len(token)
        for x in sorted(range(1, len(token)), key=depth.__getitem__):
            if parent[x]:
                f, c = fail[parent[x]], entered[x]
                while f and f << 9 | c not in edges:
                    f = fail[f]
                fail[x] = edges.get(f << 9 | c, 0)
            shorter[x] = fail[x] if token[fail[x]] >= 0 else shorter[fail[x]]
        self.edge = Lookup(edges, -1)
        self.token, self.fail, self.shorter = (np.array(x, np.int32) for x in (token, fail, shorter))
        self.size = np.zeros(self.n, np.int64)
        self.size[list(spelt)] = [len(s) for s in spelt.values()]

    def _replay(self, states: np.ndarray, labels: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Has each state an arc of the label, just after the gadget ``now``? Follows back what the gadgets did."""
        out, todo = np.ones(len(states), bool), np.arange(len(states))
        x, y = states, labels
        while len(todo):
            gone = self.cut(x * self.n + y) <= now
            out[todo[gone]] = False
            tx, ty = self.born[x], self.born[y]
            # the arc y was given to states that had the arc of its left part; state x was copied from that of its right part, before the cut
            now = np.where(ty > tx, ty, tx - 1)
            x, y = np.where(tx >= ty, self.right[x], x), np.where(ty >= tx, self.left[y], y)
            on = ~gone & ((tx >= 0) | (ty >= 0))
            todo, x, y, now = todo[on], x[on], y[on], now[on]
        return out

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Has each state, named by the label that enters it, an arc of the label?"""
        key = states * self.n + labels
        at = _place(key, CELLS)
        known = self.cells[at]
        out, new = (known & 1).astype(bool), np.flatnonzero(known >> 1 != key)
        if len(new):
            out[new] = self._replay(states[new], labels[new], np.full(len(new), _NEVER))
            self.cells[at[new]] = key[new] << 1 | out[new]
        return out

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.edge(node << 9 | symbol)
        todo = np.flatnonzero(out < 0)
        at = node[todo]
        while len(todo):
            on = at > 0
            out[todo[~on]] = 0
            todo, at = todo[on], self.fail[at[on]]
            out[todo] = found = self.edge(at << 9 | symbol[todo])
            todo, at = todo[found < 0], at[found < 0]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the one path that spells each word, one word after another, and their counts."""
        alone = [k for k, w in enumerate(words) if len(w) > LONG]
        if alone:
            paths = {k: self._walk(words[k]) for k in alone}
            ids, counts = self.encode_words([b"" if k in paths else w for k, w in enumerate(words)])
            for k, path in paths.items():
                counts[k] = len(path)
            cuts = np.cumsum(counts) - counts
            out = np.empty(int(counts.sum()), np.int64)
            free = np.ones(len(out), bool)
            for k, path in paths.items():
                out[cuts[k] : cuts[k] + len(path)], free[cuts[k] : cuts[k] + len(path)] = path, False
            out[free] = ids
            return out, counts
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        order = order[: int((sizes > 0).sum())]
        n = sizes[order] + self.marked
        base, total = np.cumsum(n) - n, int(n.sum())
        symbols, body = np.full(total, MARK), np.ones(total, bool)
        if self.marked:
            body[base + n - 1] = False
        symbols[body] = np.frombuffer(b"".join([words[k] for k in order.tolist()]), np.uint8)
        last, many, node = np.full(total, -1), np.zeros(total, np.int64), np.zeros(len(order), np.int64)
        for i in range(1, int(n[0]) + 1 if len(n) else 1):
            live = int(np.searchsorted(-n, -i, side="right"))
            node = self._step(node[:live], symbols[base[:live] + (i - 1)])
            # the last symbol before the mark is no place to stop
            word = np.flatnonzero(n[:live] != i + 1) if self.marked else np.arange(live)
            at = node[word]
            at = np.where(self.token[at] >= 0, at, self.shorter[at])
            while len(word):
                if not at.all():
                    raise ValueError("no path spells a word")
                t = self.token[at]
                begin = i - self.size[t]
                before = np.where(begin > 0, base[word] + begin - 1, 0)
                ok = begin == 0
                inner = np.flatnonzero(begin > 0)
                ok[inner] = self.arcs(last[before[inner]], t[inner])
                here = base[word[ok]] + (i - 1)
                last[here] = t[ok]
                many[here] = np.where(begin[ok] > 0, many[before[ok]], 0) + 1
                word, at = word[~ok], self.shorter[at[~ok]]
        count = many[base + n - 1]
        counts = np.zeros(len(words), np.int64)
        counts[order] = count
        out = np.empty(int(count.sum()), np.int64)
        place, left = (np.cumsum(counts) - counts)[order] + count - 1, n.copy()
        row = base
        while len(row):
            t = last[row + left - 1]
            out[place] = t
            left = left - self.size[t]
            on = left > 0
            row, left, place = row[on], left[on], place[on] - 1
        return out, counts

    def _walk(self, word: bytes) -> list[int]:
        """As ``encode_words``, for one word."""
        if self._scalar is None:
            self._scalar = self.edge.items(), self.token.tolist(), self.fail.tolist(), self.shorter.tolist(), self.size.tolist()
        edge, token, fail, shorter, size = self._scalar
        symbols = list(word) + [MARK] * self.marked
        last, node, known = [-1], 0, {}
        for i, c in enumerate(symbols, 1):
            while (found := edge.get(node << 9 | c, -1)) < 0 and node:
                node = fail[node]
            node = at = max(found, 0)
            if self.marked and i == len(word):
                last.append(-1)
                continue
            if token[at] < 0:
                at = shorter[at]
            while True:
                if not at:
                    raise ValueError("no path spells a word")
                begin = i - size[token[at]]
                pair = last[begin], token[at]
                if begin and pair not in known:
                    known[pair] = bool(self.arcs(np.array(pair[:1]), np.array(pair[1:]))[0])
                if not begin or known[pair]:
                    break
                at = shorter[at]
            last.append(token[at])
        out, i = [], len(symbols)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(Encoder(self).encode([text])[0], self.kind).tolist()

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined as a vocabulary without decoder joins them."""
        return " ".join(map(self.label.__getitem__, ids))


class Encoder:
    """Texts as their ids, little-endian; the ids of runs of characters without spaces are remembered."""

    def __init__(self, machine: Automaton):
        self.machine = machine
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = sorted(machine.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: Special strings stand in a list of runs with a space before them, as no run has one.
        self.own = {f" {s}": np.array([i], machine.kind).tobytes() for s, i in machine.special.items()}

    @staticmethod
    def _folded(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # sigma is folded without its context

    @classmethod
    def _split(cls, text: str) -> list[str]:
        text = cls._folded(text)
        return _SPACES.split(text) if _ODD_SPACES.search(text) else text.split()

    def runs(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(f" {m[0]}")
            at = m.end()
        return out + self._split(text[at:])

    def _learn(self, runs: list[str]) -> None:
        words, ends = [], [0]
        for r in runs:
            if r.isascii():
                if r.isalpha():
                    words.append(r)
                else:
                    words += _ASCII.findall(r)
            else:
                words += _LETTERS.findall(r)
            ends.append(len(words))
        ids, counts = self.machine.encode_words([w.encode() for w in words])
        raw, width = ids.astype(self.machine.kind).tobytes(), self.machine.kind.itemsize
        cuts = (np.concatenate([[0], np.cumsum(counts)])[ends] * width).tolist()
        self.seen.update(zip(runs, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) >= CACHE_RUNS:
            self.seen, self.older = {}, self.seen
        # texts with special strings are cut apart; the runs of all others are numbered and put together by Arrow
        apart = {k: self.runs(t) for k, t in enumerate(texts) if self.cut is not None and self.cut.search(t)}
        folded = ["" if k in apart else self._folded(t) for k, t in enumerate(texts)]
        folded = [t if t.isascii() else _WIDE_SPACES.sub(" ", t) for t in folded]
        lists = pa.compute.ascii_split_whitespace(pa.array(folded, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        seen, older, new = self.seen, self.older, []
        seen.update(self.own)
        for r in set(own).union(*apart.values()) - seen.keys():
            if (known := older.get(r)) is None:
                new.append(r)
            else:
                seen[r] = known
        self._learn(new)
        flat = pa.array([seen[r] for r in own], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        cuts, raw = ends[lists.offsets.to_numpy()].tolist(), memoryview(flat.buffers()[2] or b"")
        return [b"".join(map(seen.__getitem__, apart[k])) if k in apart else bytes(raw[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


_ready: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in each process."""
    if path not in _ready:
        _ready[path] = Automaton(path)
    return _ready[path]


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` (array<int>) and ``decoded``.
    """
    schema = "doc_id {}, n_tokens bigint, ids_sha256 string, decoded_sha256 string".format(dict(docs.dtypes)["doc_id"])
    shared = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary))  # as large as the vocabulary

    def start():
        machine = shared.value
        number, label = list(map(str, range(machine.n))), machine.label
        encoder = Encoder(machine)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, decoded, raw, plain = [], [], [], [], []
            for code in encoder.encode(texts_of(batch)):
                own = np.frombuffer(code, machine.kind).tolist()
                labels = " ".join(map(label.__getitem__, own))
                n.append(len(own))
                ids.append(hashlib.sha256(" ".join(map(number.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(labels.encode()).hexdigest())
                if keep_ids:
                    raw.append(own)
                    plain.append(labels)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out += [pa.array(raw, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(out, names)

        return each

    return map_texts(docs.select("doc_id", "text"), start, schema + ", ids array<int>, decoded string" * keep_ids)


def id_bytes(docs: DataFrame, vocabulary: str) -> tuple[Callable[[], Callable[[list[str]], list[bytes]]], int, int]:
    """For writers: a maker of functions from texts to their ids as little-endian numbers, the bytes of one, and the least free id."""
    machine = automaton(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return lambda: Encoder(shared.value).encode, machine.kind.itemsize, machine.n
