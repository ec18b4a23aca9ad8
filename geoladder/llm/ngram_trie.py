"""LM scoring (2): an n-gram model in an Elias-Fano trie.

*Vocabulary.* Words are hashed on the bytes; the vocabulary is the sorted hashes, and a word's id is its rank.

*Counting.* Tasks cut their texts into units. A unit's distinct trigrams (a word, the next one and the one after that or a
pad at a text's end; so the bigrams' counts are sums of these) go, sorted and packed, to the shard that owns them. Shards
are ranges of (first word, second word) with about equal shares of the tokens, as the words' own counts let expect. So the
successors of a very common word are spread over several shards.

*Smoothing.* Interpolated absolute discounting with three discounts per level (for counts 1, 2 and more), estimated from
the counts of counts of the whole corpus; below the bigrams lies the add-1/2 unigram model. A level holds each n-gram's
discounted probability and each context's back-off weight, both as logs quantised to 8 bits; a query adds the level below
times the back-off weight. For a word whose successors lie in several shards the weight is summed on the driver.

*Trie.* A shard of a level is one file with: monotone pointers to each context's first successor, in Elias-Fano code; the
successors' ids, made monotone by adding the last value of the context before, in Elias-Fano code; and the quantised
numbers. Files lie in the shared folder and are memory-mapped. A query goes to its context's successors through two
pointers, makes the word relative to the context, and takes one successor search: two selects of zeros give the bucket of
equal upper halves, in which lower halves are compared. Everything is vectorised.

*Scoring.* Queries go to the shards, not the model to the queries: a shard opens its own two files, looks each distinct
n-gram up once and answers every unit that has it. A unit has meanwhile left its tokens' places in its list of n-grams in
the shared folder, and its answers are added up along them. So a task maps one shard
and the vocabulary.

Sizes: ``shard_bytes`` of text per shard bounds what one task merges and builds (some 30 bytes a token); a unit is
``UNIT`` bytes of text, or one longer text. The driver holds a line per shard (about 200 bytes).

Defined results: null texts are empty (their end token alone); null doc ids are training rows; repeated rows count as
often as they are there; with no training rows every token has probability 1; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _vec

U = np.uint64
#: The end token's stand-in for a word hash. It is also the context of a text's first token.
END = U(0x5851F42D4C957F2D)
SHARD_BYTES = 8 << 20
#: Quantised logs: 0 is log10 = 0, each step is this much less; the last code stands for no probability.
STEP, NONE = 0.04, 255
#: The step of the bigrams' logs in answers, which are 16 bits.
FINE = 0.001
SAMPLE_BITS = 3
SAMPLE = 1 << SAMPLE_BITS
#: Bytes of text of a unit.
UNIT = 6 << 20
#: Distinct words that a task gathers before it sends them.
GATHER = 1_000_000


# ------------------------------------------------------------------------------------------------------- Elias-Fano


def _lowest(word: np.ndarray) -> np.ndarray:
    """Place of the lowest one of each word."""
    return np.bitwise_count(~word & (word - U(1))).astype(np.int64)


@dataclass
class Bits:
    """A bit vector with the places of every eighth one and zero."""

    words: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th (from 0) one or zero."""
        at = (self.ones if one else self.zeros)[i >> SAMPLE_BITS].astype(np.int64)
        r = (i & (SAMPLE - 1)).astype(np.uint8)
        w = at >> 6
        word = self.words[w]
        if not one:
            np.invert(word, out=word)
        word &= ~U(0) << (at & 63).astype(U)
        left = np.bitwise_count(word)
        open_ = np.flatnonzero(r >= left)
        while len(open_):
            r[open_] -= left[open_]
            w[open_] += 1
            word[open_] = self.words[w[open_]] if one else ~self.words[w[open_]]
            left[open_] = np.bitwise_count(word[open_])
            open_ = open_[r[open_] >= left[open_]]
        for k in range(SAMPLE - 1):  # drop the lowest ones before the wanted one
            more = r > k
            word = np.where(more, word & (word - U(1)), word)
        return (w << 6) + _lowest(word)

    def after(self, at: np.ndarray, one: bool) -> np.ndarray:
        """Place of the first one or zero behind each place."""
        at = at + 1
        w = at >> 6
        word = self.words[w]
        if not one:
            np.invert(word, out=word)
        word &= ~U(0) << (at & 63).astype(U)
        open_ = np.flatnonzero(word == 0)
        while len(open_):
            w[open_] += 1
            word[open_] = self.words[w[open_]] if one else ~self.words[w[open_]]
            open_ = open_[word[open_] == 0]
        return (w << 6) + _lowest(word)


class EliasFano:
    """A monotone sequence: ``low`` bits of each number as they are, the rest in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, bits: Bits):
        self.n, self.width, self.bits = n, width, bits
        self.low = np.ndarray(max(len(low) - 7, 1), "<u8", low.data if hasattr(low, "data") else low, strides=(1,)) if len(low) >= 8 else np.zeros(1, U)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        return ((self.low[at >> 3] >> (at & 7).astype(U)) & U((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.bits.select(i, True) - i) << self.width | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers i and i + 1."""
        a = self.bits.select(i, True)
        b = self.bits.after(a, True)
        return (a - i) << self.width | self._low(i), (b - i - 1) << self.width | self._low(i + 1)

    def search(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Index of the successor of x among [least, most) if it equals x, else -1.

        Two neighbouring zeros bound the numbers with x's upper half; their lower halves ascend. A crowded context can
        fill such a bucket, so it is searched by halves.
        """
        high = x >> self.width
        zero = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(high > 0)
        zero[some] = self.bits.select(high[some] - 1, False)
        begin = np.maximum(zero + 1 - high, least)
        end = np.minimum(self.bits.after(zero, False) - high, most)
        low = x & ((1 << self.width) - 1)
        stop = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        out = np.full(len(x), -1, np.int64)
        inside = np.flatnonzero(begin < stop)
        inside = inside[self._low(begin[inside]) == low[inside]]
        out[inside] = begin[inside]
        return out


def ef_bytes(values: np.ndarray, universe: int) -> tuple[dict, list[bytes]]:
    """(what a reader must know, the parts) of a monotone sequence below ``universe``."""
    n = len(values)
    width = max(0, int(math.floor(math.log2(max(universe, 1) / max(n, 1)))) if n else 0)
    low = np.zeros((n * width + 7) // 8 + 8, np.uint8)
    block = 1 << 14  # values per step; a multiple of 8, so steps begin at whole bytes
    for i in range(0, n if width else 0, block):
        v = values[i : i + block].astype(U)
        b = ((v[:, None] >> np.arange(width, dtype=U)) & U(1)).astype(np.uint8).ravel()
        p = np.packbits(b, bitorder="little")
        low[i * width // 8 : i * width // 8 + len(p)] = p
    high = values.astype(np.int64) >> width
    most = (universe >> width) + 2  # zeros; one ends each possible upper half
    words = np.zeros((n + most + 63) // 64 + 1, U)
    place = high + np.arange(n)
    if n:
        at = place >> 6
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words[at[first]] = np.bitwise_or.reduceat(U(1) << (place & 63).astype(U), first)
    kind = "<u4" if 64 * len(words) < 1 << 32 else "<u8"
    # the z-th zero lies behind z others and all values whose upper half is z at most
    z = np.arange(0, most, SAMPLE)
    zeros = (z + np.searchsorted(high, z, "right")).astype(kind)
    parts = [low.tobytes(), words.tobytes(), place[::SAMPLE].astype(kind).tobytes(), zeros.tobytes()]
    return {"n": n, "width": width, "kind": kind}, parts


class Shard:
    """One file of a level, memory-mapped."""

    def __init__(self, uri: str):
        raw = np.frombuffer(_shared.read_shared(uri), np.uint8)
        head_size = int(raw[:8].view("<i8")[0])
        self.head = json.loads(raw[8 : 8 + head_size].tobytes())
        at, parts = 8 + head_size + -head_size % 8, []
        for size in self.head["sizes"]:
            parts.append(raw[at : at + size])
            at += size + -size % 8

        def ef(k: str, i: int) -> EliasFano:
            h = self.head[k]
            return EliasFano(h["n"], h["width"], parts[i], Bits(parts[i + 1].view("<u8"), parts[i + 2].view(h["kind"]), parts[i + 3].view(h["kind"])))

        self.low, self.n_contexts = self.head["low"], self.head["n_contexts"]
        self.pointers, self.successors = ef("pointers", 0), ef("successors", 4)
        self.probability, self.backoff = parts[8], parts[9]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, code of the probability, code of the context's back-off); an unknown context has the weight 1.

        ``context`` ascends; each is looked up once.
        """
        node = np.full(len(word), -1, np.int64)
        probability, backoff = np.full(len(word), NONE, np.uint8), np.zeros(len(word), np.uint8)
        known = np.flatnonzero((context >= self.low) & (context < self.low + self.n_contexts))
        if not len(known):
            return node, probability, backoff
        c = context[known] - self.low
        first = np.append(True, c[1:] != c[:-1])
        at, one = np.cumsum(first) - 1, c[first]
        backoff[known] = self.backoff[one][at]
        begin, end = self.pointers.pair(one)
        base = np.zeros(len(one), np.int64)  # what makes words relative to their context
        later = np.flatnonzero((begin > 0) & (begin < end))
        base[later] = self.successors.get(begin[later] - 1) + 1
        x = base[at] + word[known]
        ok = np.flatnonzero((begin < end)[at] & (x < self.head["universe"]))
        got = self.successors.search(x[ok], begin[at[ok]], end[at[ok]])
        hit = got >= 0
        node[known[ok[hit]]] = got[hit]
        probability[known[ok[hit]]] = self.probability[got[hit]]
        return node, probability, backoff


def codes(p: np.ndarray) -> np.ndarray:
    """Quantised logs of probabilities or weights."""
    return np.minimum(np.rint(np.log10(np.clip(p, 1e-300, 1.0)) / -STEP), NONE - 1).astype(np.uint8)


#: The numbers that codes stand for.
VALUE = np.append(10.0 ** (-STEP * np.arange(NONE)), 0.0)


def shard_file(folder: str, name: str, context: np.ndarray, word: np.ndarray, low: int, n_contexts: int, probability: np.ndarray, backoff: np.ndarray) -> str:
    """Writes a shard from its sorted (context, word) pairs; contexts are low .. low + n_contexts - 1."""
    n, context = len(context), context - low
    pointers = np.searchsorted(context, np.arange(n_contexts + 1))
    last = np.flatnonzero(np.append(context[1:] != context[:-1], True)) if n else np.zeros(0, np.int64)
    # a context's numbers begin after the last number of the context before
    top = np.cumsum(word[last] + 1)
    base = np.repeat(np.concatenate([[0], top[:-1]]) if n else np.zeros(0, np.int64), np.diff(np.concatenate([[-1], last])))
    values = base + word
    universe = int(values[-1]) + 1 if n else 1
    h1, p1 = ef_bytes(pointers, n + 1)
    h2, p2 = ef_bytes(values, universe)
    parts = [*p1, *p2, probability.tobytes(), backoff.tobytes()]
    head = json.dumps({"pointers": h1, "successors": h2, "universe": universe, "low": int(low), "n_contexts": int(n_contexts), "sizes": [len(x) for x in parts]}).encode()
    f = _shared.SharedFile(folder, name)
    for x in (np.int64(len(head)).tobytes(), head + b"\0" * (-len(head) % 8), *[x + b"\0" * (-len(x) % 8) for x in parts]):
        f.write(x)
    return f.close()


# ------------------------------------------------------------------------------------------------------ packed rows


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length: byte plane by byte plane, compressed. The first one mostly ascends, and so
    does the second where the first stays the same: there, differences are kept."""
    x = np.stack([np.asarray(c).astype("<i8") for c in columns])
    if len(columns) > 1 and x.shape[1]:
        same = np.flatnonzero(x[0, 1:] == x[0, :-1])
        x[1, same + 1] -= x[1, same]
    x[0, 1:] -= x[0, :-1].copy()
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))
    return struct.pack("<ii", len(columns), x.shape[1]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<ii", data)
    if not n:
        return [np.zeros(0, np.int64)] * k
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], 8 * k * n, codec="zstd", asbytes=True), np.uint8).reshape(k, 8, n)
    out = []
    for i in range(k):
        x = np.zeros(n, np.int64)
        for b in range(8):
            if planes[i, b].any():
                x |= planes[i, b].astype(np.int64) << (8 * b)
        out.append(x)
    np.cumsum(out[0], out=out[0])
    if k > 1:
        first = np.flatnonzero(np.append(True, out[0][1:] != out[0][:-1]))
        total = np.cumsum(out[1])
        out[1] = total - np.repeat(total[first] - out[1][first], np.diff(np.append(first, n)))
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.add.reduceat(counts[order], at)


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the distinct rows in order, the place of each row among them)."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, np.int64)
    spans = [int(c.max()) + 1 for c in columns]
    if math.prod(spans) < 1 << 63:
        key = columns[0]
        for c, s in zip(columns[1:], spans[1:], strict=True):
            key = key * s + c
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        order = np.lexsort(columns[::-1])
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    one = order[new]
    return [c[one] for c in columns], place


def _grouped(batches, key: int):
    """(key, rows) for the rows of each value of a column; equal values come one after another."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and r[key] != now:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


# ------------------------------------------------------------------------------------------------------- vocabulary


@dataclass
class Vocabulary:
    """What a task must know to open the vocabulary: per shard the first id, the tokens before, and the file."""

    n_shards: int = 1
    first: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    uri: list[str] = field(default_factory=list)
    n_words: int = 0
    tokens: int = 0

    @property
    def pad(self) -> int:
        """The id behind a text's end; the next one is that of all unknown words."""
        return self.n_words


def _shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Equal parts of the 64-bit numbers, in their order."""
    return ((keys >> U(32)) * U(n_shards) >> U(32)).astype(np.int64)


_open: dict = {}


class Words:
    """An opened vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, self.files = v, {}

    @classmethod
    def of(cls, v: Vocabulary) -> Words:
        key = tuple(v.uri)
        if key not in _open:
            _open.clear()  # one model at a time
            _open[key] = cls(v)
        return _open[key]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, tokens of all smaller ids) of words that ascend; an unknown one has the last id and the count 0."""
        v = self.v
        ids, counts, before = np.full(len(hashes), v.pad + 1), np.zeros(len(hashes), np.int64), np.full(len(hashes), v.tokens)
        shard = _shard_of(hashes, v.n_shards)
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(hashes) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hashes)], strict=False):
            s = int(shard[a])
            if not v.uri or not v.uri[s]:
                continue
            known, c, t = self._file(s)
            i = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            hit = np.flatnonzero(known[i] == hashes[a:b])
            i = i[hit]
            ids[a + hit], counts[a + hit], before[a + hit] = v.first[s] + i, c[i].astype(np.int64), v.before[s] + t[i].astype(np.int64)
        return ids, counts, before

    def _file(self, s: int) -> list[np.ndarray]:
        if s not in self.files:
            self.files[s] = np.split(np.frombuffer(_shared.read_shared(self.v.uri[s]), "<u8"), 3)
        return self.files[s]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id; 0 for the pad and the unknown word."""
        own, at = np.unique(ids, return_inverse=True)
        out = np.zeros(len(own), np.int64)
        cut = np.searchsorted(own, [*self.v.first, self.v.n_words])
        for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if a < b:
                out[a:b] = self._file(s)[1][own[a:b] - self.v.first[s]].astype(np.int64)
        return out[at]


RUNS = "shard int, data binary"


def _count_words(n_shards: int):
    def run(batches):
        held, size = [], 0

        def flush():
            k, c = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            shard = _shard_of(k, n_shards)
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            end = np.append(cut[1:], len(shard))
            data = [pack(k[a:b].view(np.int64), c[a:b]) for a, b in zip(cut, end, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(data, pa.binary())], ["shard", "data"])

        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(0))
            for i, j, b, o in _vec.chunks(buf, bounds, UNIT):
                hashes, _ = _vec.word_hashes(b, o, lower=True)
                k, c = np.unique(np.append(hashes, END), return_counts=True)
                c = c.astype(np.int64)
                c[np.searchsorted(k, END)] += j - i - 1
                held.append((k, c))
                size += len(k)
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _write_words(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, k, c = int(pdf["shard"].iloc[0]), np.zeros(0, U), np.zeros(0, np.int64)
        for i in range(0, len(pdf), 16):  # a few runs at a time, so that not all are held unpacked
            runs = [unpack(x) for x in pdf["data"].iloc[i : i + 16]]
            k, c = summed(np.concatenate([k, *[r[0].view(U) for r in runs]]), np.concatenate([c, *[r[1] for r in runs]]))
        f = _shared.SharedFile(folder, f"words-{shard:06d}-{_shared.attempt()}.bin")
        for x in (k, c, np.cumsum(c) - c):
            f.write(x.astype("<u8").tobytes())
        return pd.DataFrame([(shard, f.close(), len(k), int(c.sum()))], columns=["shard", "uri", "n", "total"])

    return run


def vocabulary(texts: DataFrame, spark: SparkSession, folder: str, n_shards: int) -> Vocabulary:
    """Counts the words of a column ``text`` and writes them."""
    runs = texts.select("text").mapInArrow(_count_words(n_shards), RUNS)
    made = _shared.written(runs.repartition(n_shards, "shard").groupBy("shard").applyInPandas(_write_words(folder), "shard int, uri string, n bigint, total bigint"), spark, "trie-words")
    rows = {r.shard: r for r in made.collect()}  # a line per shard
    _shared.discard(made)
    v = Vocabulary(n_shards)
    for s in range(n_shards):
        r = rows.get(s)
        v.first.append(v.n_words)
        v.before.append(v.tokens)
        v.uri.append(r.uri if r else "")
        v.n_words += r.n if r else 0
        v.tokens += r.total if r else 0
    return v


# ------------------------------------------------------------------------------------------------------------ units


@dataclass
class Model:
    """The vocabulary, the files of each level by shard, and the back-off codes of words at the shards' edges."""

    words: Vocabulary
    order: int
    n_shards: int
    uri: dict[int, list[str]] = field(default_factory=dict)
    edges: dict[int, int] = field(default_factory=dict)


_UNITS = "unit bigint, shard int, data binary"


def _gather(shared, n_shards: int, order: int, folder: str):
    """Per unit a row for each shard with its distinct n-grams and their counts in training rows, and one (with a negative
    shard) that says where its tokens' places among them and all else that its scores need are kept."""

    def run(batches):
        from pyspark import TaskContext

        v: Vocabulary = shared.value
        reader, log_total = Words.of(v), math.log10(v.tokens + 0.5 * (v.n_words + 1))
        unit = TaskContext.get().partitionId() << 32
        tokens = _shared.SharedFile(folder, f"tokens-{_shared.attempt()}.bin")
        pointers = []
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(2))
            for i, j, b, o in _vec.chunks(buf, bounds, UNIT):
                hashes, first = _vec.word_hashes(b, o, lower=True)
                n = np.diff(first) + 1  # with the end
                end = np.cumsum(n)
                every = np.full(len(hashes) + len(n), END)
                inside = np.ones(len(every), bool)
                inside[end - 1] = False
                every[inside] = hashes
                del hashes
                own, at = np.unique(np.append(every, END), return_inverse=True)
                ids, counts, before = reader.lookup(own)
                # ranks by id, with the pad between the known words and the unknown one
                ids, back = np.unique(np.append(ids, v.pad), return_inverse=True)
                count, earlier = np.zeros(len(ids), np.int64), np.full(len(ids), v.tokens)
                count[back[:-1]], earlier[back[:-1]] = counts, before
                at = back[at]
                word, start = at[:-1], at[-1]
                previous, following = np.empty_like(word), np.empty_like(word)
                previous[1:], following[:-1] = word[:-1], word[1:]
                previous[end - n], following[end - 1] = start, back[-1]
                if order == 2:
                    following[:] = back[-1]
                base = np.log10(count + 0.5) - log_total
                sums = [np.add.reduceat(x, end - n) for x in ((count > 0)[word], base[word])]
                (x, y, z), place = distinct([previous, word, following])
                del previous, following, every
                held = np.asarray(batch.column(1).slice(i, j - i).fill_null(False)).astype(bool)
                times = np.bincount(place, np.repeat(~held, n), len(x)).astype(np.int64)
                gram = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
                mass = earlier[x] + count[x].astype(np.float64) * earlier[y] / max(v.tokens, 1)
                shard = np.minimum((mass * n_shards / max(v.tokens, 1)).astype(np.int64), n_shards - 1)
                doc = batch.column(0).slice(i, j - i)
                parts = [pack(np.arange(len(place)), place), pack(np.flatnonzero(gram)), pack(end, np.asarray(doc.fill_null(0)).astype(np.int64), np.asarray(doc.is_null()), held, sums[0], sums[1].view(np.int64))]
                where = tokens.write(b"".join([struct.pack("<qqq", *map(len, parts)), *parts]))
                pointers.append((unit, where, tokens.size - where))
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                rows = [pack(ids[x[a:c]], ids[y[a:c]], ids[z[a:c]], times[a:c]) for a, c in zip(cut.tolist(), [*cut[1:].tolist(), len(x)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), unit)), pa.array(shard[cut].astype(np.int32)), pa.array(rows, pa.binary())], ["unit", "shard", "data"])
                unit += 1
        uri = tokens.close()
        if pointers:
            data = [json.dumps([uri, a, s]).encode() for _, a, s in pointers]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pointers], pa.int64()), pa.array([-1 - p[0] % n_shards for p in pointers], pa.int32()), pa.array(data, pa.binary())], ["unit", "shard", "data"])

    return run


_MERGED = "shard int, unit bigint, pointer binary, grams binary, units binary, places binary, ones array<bigint>, twos array<bigint>, edges array<bigint>"
_MERGED_NAMES = [x.split()[0] for x in _MERGED.split(", ")]


def _levels(x: np.ndarray, y: np.ndarray, z: np.ndarray, times: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row and count of each bigram that was seen, rows of the trigrams that were, the bigram of each of these)."""
    seen = np.flatnonzero(times > 0)
    if not len(seen):
        return seen, seen, seen, seen
    new = np.append(True, (x[seen[1:]] != x[seen[:-1]]) | (y[seen[1:]] != y[seen[:-1]]))
    first = np.flatnonzero(new)
    three = z[seen] != pad
    return seen[first], np.add.reduceat(times[seen], first), seen[three], (np.cumsum(new) - 1)[three]


def _merge(pad: int):
    """Per shard: all units' n-grams with their counts, each unit's places among them, counts of counts, and what the
    words at its edges are followed by. Units' own rows are handed on."""

    def run(batches):
        for shard, rows in _grouped(batches, 1):
            if shard < 0:
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), *[pa.nulls(n, pa.binary())] * 3, *[pa.nulls(n, pa.list_(pa.int64()))] * 3], _MERGED_NAMES)
                continue
            runs = [unpack(r[2]) for r in rows]
            sizes = np.array([len(r[0]) for r in runs])
            units = np.array([r[0] for r in rows])
            columns = [np.concatenate([r[k] for r in runs]) for k in range(4)]
            del runs, rows
            times = columns.pop()
            columns[0] -= (low := int(columns[0].min()))
            (x, y, z), place = distinct(columns)
            del columns
            x += low
            times = np.bincount(place, times, len(x)).astype(np.int64)
            two, c2, three, _ = _levels(x, y, z, times, pad)
            counts = [[int((c == k).sum()) for k in (1, 2, 3, 4)] for c in (c2, times[three])]
            edges = []
            for w in {int(x[0]), int(x[-1])}:
                c = c2[x[two] == w]
                edges += [w, int((c == 1).sum()), int((c == 2).sum()), int((c > 2).sum()), int(c.sum())]
            order = np.argsort(units)  # a packed column must ascend
            data = pack(units[order], sizes[order], (np.cumsum(sizes) - sizes)[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack(x, y, z, times)], pa.binary()), pa.array([data], pa.binary()), pa.array([pack(place)], pa.binary()), *[pa.array([e], pa.list_(pa.int64())) for e in (*counts, edges)]],
                _MERGED_NAMES,
            )

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts 1, 2 and more, from the counts of counts; within (0, count)."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass
class Statistics:
    """Of the whole corpus: the discounts of each level, and of the words at shards' edges the sums of discounts and counts."""

    cuts: dict[int, tuple]
    edges: dict[int, tuple[float, int]]

    def codes(self) -> dict[int, int]:
        return {w: int(codes(np.array([a / b]))[0]) for w, (a, b) in self.edges.items()}


def write_levels(shard: int, grams: list[np.ndarray], pad: int, of: Statistics, order: int, folder: str) -> list[str]:
    """Writes a shard's levels from its merged n-grams; returns the files (none without any n-gram)."""
    x, y, z, times = grams
    two, c2, three, parent = _levels(x, y, z, times, pad)
    if not len(two):
        return []
    context, word, low = x[two], y[two], int(x[two[0]])
    n = int(context[-1]) - low + 1
    off = np.array([0.0, *of.cuts[2]])[np.minimum(c2, 3)]
    total, weight = np.bincount(context - low, c2, n), np.bincount(context - low, off, n)
    for w in {low, low + n - 1} & of.edges.keys():
        weight[w - low], total[w - low] = of.edges[w]
    name = f"{shard:06d}-{_shared.attempt()}.trie"
    uris = [shard_file(folder, f"level2-{name}", context, word, low, n, codes((c2 - off) / total[context - low]), codes(weight / np.maximum(total, 1)))]
    if order > 2:
        c3 = times[three]
        off = np.array([0.0, *of.cuts[3]])[np.minimum(c3, 3)]
        total, weight = np.bincount(parent, c3, len(two)), np.bincount(parent, off, len(two))
        uris.append(shard_file(folder, f"level3-{name}", parent, z[three], 0, len(two), codes((c3 - off) / total[parent]), codes(np.where(total > 0, weight / np.maximum(total, 1), 1.0))))
    return uris


def _write_levels(pad: int, of: Statistics, order: int, folder: str):
    def run(batches):
        for batch in batches:
            for shard, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                uris = write_levels(shard, unpack(grams.as_buffer()), pad, of, order, folder)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uris], pa.list_(pa.string()))], ["shard", "uris"])

    return run


def _answer(shared, of: Statistics | None, folder: str):
    """Per unit and shard: the code of each of its trigrams, and of each of its bigrams the log probability in steps of
    ``FINE`` and the back-off code. Without files of the model's, a shard's are made on the spot and deleted when it has answered."""

    def run(batches):
        m: Model = shared.value
        words = Words.of(m.words)
        log_total = math.log10(m.words.tokens + 0.5 * (m.words.n_words + 1))
        for batch in batches:
            for shard, grams, units, places in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                x, y, z, times = unpack(grams.as_buffer())
                uri = m.uri.get(shard) if of is None else write_levels(shard, [x, y, z, times], m.words.pad, of, m.order, folder)
                del times
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                gram = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
                p2, b2, b3 = np.full(len(first), NONE, np.uint8), np.zeros(len(first), np.uint8), np.zeros(len(first), np.uint8)
                p3 = np.full(len(x), NONE, np.uint8)
                if uri:
                    node, p2, b2 = Shard(uri[0]).find(x[first], y[first])
                    if m.order > 2:
                        rows = np.flatnonzero((node[gram] >= 0) & (z != m.words.pad))
                        level = Shard(uri[1])
                        _, p3[rows], _ = level.find(node[gram[rows]], z[rows])
                        known = node >= 0
                        b3[known] = level.backoff[node[known]]
                if of is not None:
                    for u in uri:
                        _shared.delete_file(u)
                # words at the shard's edges, of whose successors others may have some or all
                for w in {int(x[0]), int(x[-1])} & m.edges.keys():
                    b2[x[first] == w] = m.edges[w]
                p2 = VALUE[p2] + VALUE[b2] * 10.0 ** (np.log10(words.counts(y[first]) + 0.5) - log_total)
                p2 = np.rint(np.log10(p2) / -FINE).astype("<u2")
                index = unpack(places.as_buffer())[0]  # ascends within a unit
                for u, size, at in zip(*(c.tolist() for c in unpack(units.as_buffer())), strict=True):
                    rows = index[at : at + size]
                    g = gram[rows]
                    g = g[np.append(True, g[1:] != g[:-1])]
                    data = pa.compress(b"".join([p3[rows].tobytes(), b3[g].tobytes(), *[np.ascontiguousarray(x).tobytes() for x in p2[g].view(np.uint8).reshape(-1, 2).T]]), codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([shard], pa.int32()), pa.array([struct.pack("<ii", size, len(g)) + data], pa.binary())], ["unit", "shard", "data"])

    return run


def _finish(tokens: int):
    """Adds a unit's answers up along its tokens."""

    def run(batches):
        for _, rows in _grouped(batches, 0):
            uri, where, size = json.loads(rows[0][2])  # a negative shard comes first
            raw = memoryview(_shared.read_shared(uri))[where : where + size]
            at, parts = 24, []
            for k in struct.unpack_from("<qqq", raw):
                parts.append(unpack(raw[at : at + k]))
                at += k
            place, (first,), (end, doc, null, held, known, base) = parts[0][1], parts[1], parts[2]
            got: list[list[np.ndarray]] = [[], [], []]
            for _, _, data in rows[1:]:
                n, g = struct.unpack_from("<ii", data)
                raw = np.frombuffer(pa.decompress(memoryview(data)[8:], n + 3 * g, codec="zstd", asbytes=True), np.uint8)
                got[0].append(raw[:n])
                got[1].append(raw[n : n + g])
                got[2].append(raw[n + g : n + 2 * g].astype(np.uint16) | raw[n + 2 * g :].astype(np.uint16) << 8)
            p3, b3, p2 = (np.concatenate(x) for x in got)
            gram = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p3))))
            two = 10.0 ** (-FINE * p2)
            here = gram[place]
            p = two[here]
            start = np.concatenate([[0], end[:-1]])
            later = np.ones(len(place), bool)
            later[start] = False
            later = np.flatnonzero(later)
            p[later] = VALUE[p3[place[later - 1]]] + VALUE[b3[here[later - 1]]] * p[later]
            score = np.add.reduceat(np.log10(p), start)
            ids = pa.array(doc, pa.int64(), mask=null.astype(bool))
            cols = [ids, pa.array(held.astype(bool)), pa.array(end - start), pa.array(known), pa.array(np.full(len(end), tokens)), pa.array(base.view(np.float64)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCORES.split(", ")])

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


# --------------------------------------------------------------------------------------------------------- operator


def prepare(docs: DataFrame, spark: SparkSession, words: Vocabulary, order: int, n_shards: int, folder: str) -> DataFrame:
    """(doc_id, held_out, text) as units: a written table of pointers to their tokens (shard < 0) and of the merged n-grams
    by shard, in which training rows count."""
    shared = spark.sparkContext.broadcast(words)  # a line per shard
    rows = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    gathered = rows.mapInArrow(_gather(shared, n_shards, order, folder), _UNITS)
    by_shard = gathered.repartition(n_shards, "shard").sortWithinPartitions("shard", "unit")
    return _shared.written(by_shard.mapInArrow(_merge(words.pad), _MERGED), spark, "trie-merged")


def statistics(work: DataFrame) -> Statistics:
    rows = work.where("shard >= 0").select("ones", "twos", "edges").collect()  # some 20 numbers per shard
    cuts = {2: discounts(*[sum(r.ones[k] for r in rows) for k in range(4)]), 3: discounts(*[sum(r.twos[k] for r in rows) for k in range(4)])}
    counts: dict[int, list[int]] = {}
    for r in rows:
        for i in range(0, len(r.edges), 5):
            counts[r.edges[i]] = [a + b for a, b in zip(counts.get(r.edges[i], [0] * 4), r.edges[i + 1 : i + 5], strict=True)]
    return Statistics(cuts, {w: (sum(a * d for a, d in zip(c, cuts[2], strict=False)), c[3]) for w, c in counts.items() if c[3]})


def build(work: DataFrame, spark: SparkSession, words: Vocabulary, order: int, n_shards: int, folder: str) -> Model:
    """The model of the merged n-grams; its files go to ``folder``."""
    of = statistics(work)
    files = work.where("shard >= 0").select("shard", "grams").mapInArrow(_write_levels(words.pad, of, order, folder), "shard int, uris array<string>")
    files = _shared.written(files, spark, "trie-files")
    m = Model(words, order, n_shards, {r.shard: r.uris for r in files.collect()}, of.codes())
    _shared.discard(files)
    return m


def answers(work: DataFrame, model: Model, spark: SparkSession, of: Statistics | None = None, folder: str = "") -> DataFrame:
    """The scores of the units' documents. With ``of``, of a model of the same n-grams whose files are not kept."""
    shared = spark.sparkContext.broadcast(model)  # a line per shard
    got = work.where("shard >= 0").select("shard", "grams", "units", "places").mapInArrow(_answer(shared, of, folder), _UNITS)
    units = work.where("shard < 0").select("unit", "shard", F.col("pointer").alias("data"))
    return units.unionByName(got).repartition("unit").sortWithinPartitions("unit", "shard").mapInArrow(_finish(model.words.tokens), SCORES)


def shards_for(texts: DataFrame, shard_bytes: int) -> int:
    size = texts.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-int(size) // shard_bytes))


def train(texts: DataFrame, spark: SparkSession, order: int = 3, shard_bytes: int = SHARD_BYTES) -> Model:
    """Builds a model of order 2 or 3 from a column ``text``; its files stay in the shared folder."""
    _shared.small_batches(spark)
    folder, tokens = _shared.new_folder(spark, "trie"), _shared.new_folder(spark, "trie-tokens")
    texts = texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("held_out"), F.col("text").cast("string").alias("text"))
    n = shards_for(texts, shard_bytes)
    words = vocabulary(texts, spark, folder, n)
    work = prepare(texts, spark, words, order, n, tokens)
    _shared.release(spark)
    model = build(work, spark, words, order, n, folder)
    _shared.discard(work)
    _shared.discard_folder(tokens)
    return model


def score(docs: DataFrame, model: Model, spark: SparkSession) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, held_out, text); a written table."""
    _shared.small_batches(spark)
    tokens = _shared.new_folder(spark, "trie-tokens")
    work = prepare(docs, spark, model.words, model.order, model.n_shards, tokens)
    out = _shared.written(answers(work, model, spark), spark, "scores")
    _shared.discard(work)
    _shared.discard_folder(tokens)
    return out


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``part``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score_corpus(docs: DataFrame, spark: SparkSession, order: int = 3, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Trains on the documents that are not held out and scores all of them; texts are cut into units once for both, and a
    shard's files live only as long as it answers. ``train`` and ``score`` keep the model."""
    _shared.small_batches(spark)
    folder, tokens = _shared.new_folder(spark, "trie"), _shared.new_folder(spark, "trie-tokens")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    n = shards_for(base, shard_bytes)
    words = vocabulary(base.where("not held_out"), spark, folder, n)
    work = prepare(base, spark, words, order, n, tokens)
    _shared.release(spark)
    of = statistics(work)
    model = Model(words, order, n, {}, of.codes())
    out = _shared.written(answers(work, model, spark, of, folder), spark, "scores")
    _shared.discard(work)
    for f in (folder, tokens):
        _shared.discard_folder(f)
    return out
