"""Token-ID output (8): directly addressable codes.

Every text is encoded, an end id is appended, and the ids of all documents in ascending ``doc_id`` are written as
*directly addressable codes*: an id is cut into chunks of 8 bits; level 0 holds the lowest chunk of every id, level l + 1
the next chunk of those ids that have one; a bitmap per level says which ids go on, and a rank directory (ones before
each 512-bit block) tells where on the next level an id goes on. Any token is thus found by one rank per level, with no
block to decode.

File layout (little-endian): magic ``DAC1``; int64 documents, tokens, levels; int64 doc ids; uint8 null flags of the doc
ids, padded to 8; int64 token starts (documents + 1); then per level int64 count, the chunks, the bitmap (padded to 64
bytes) and the rank directory, each padded to 8 bytes.

Defined results: a null text is empty (its end id alone); null doc ids come first; equal doc ids are ordered by a hash
of their text, and rows equal in both take either order, which gives the same ids; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, _vec

U = np.uint64
MAGIC = b"DAC1\0\0\0\0"
#: Tokens of a file at most (but for one longer document).
FILE_TOKENS = 4 << 20
#: Distinct word pieces that a worker keeps encoded.
CACHE_PIECES = 1_000_000
#: Bytes of text that are cut into pieces at a time.
ENCODE_BYTES = 1 << 20
#: Unicode's White_Space code points.
SPACE_POINTS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_state: dict = {}


# ---------------------------------------------------------------------------------------------------------- encoding


def _classes() -> np.ndarray:
    """The class of every code point, as the pre-tokenizer's pattern tells them apart."""
    if "classes" not in _state:
        major = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[SPACE_POINTS] = SPACE
        _state["classes"] = t
    return _state["classes"]


def pieces(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte starts of the pre-tokens of all texts of a buffer, as the byte-level pre-tokenizer cuts them.

    A run of letters, of numbers or of other signs takes a space before it along; of a longer run of white space the
    last sign stands alone; an apostrophe takes s, t, m, d, re, ve or ll along.
    """
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    cls = _classes()[:256][lead]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        b = [buf[np.minimum(at[wide] + i, len(buf) - 1)].astype(np.int64) for i in range(4)]
        cp = np.where(
            b[0] < 0xE0,
            (b[0] & 0x1F) << 6 | (b[1] & 0x3F),
            np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | (b[2] & 0x3F), (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | (b[3] & 0x3F)),
        )
        cls[wide] = _classes()[np.minimum(cp, 0x10FFFF)]
    n = len(at)
    new_text = np.zeros(n + 1, bool)
    new_text[np.searchsorted(at, bounds)] = True
    new_text[n] = True
    cut = new_text.copy()
    cut[1:n] |= cls[1:] != cls[:-1]
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    # white space before something in the same text
    s = np.flatnonzero((cls[starts] == SPACE) & ~new_text[ends])
    last = ends[s] - 1
    cut[last] = True
    cut[ends[s][lead[last] == 32]] = False
    # an apostrophe alone, not after a space that it took along
    o = starts[(lead[starts] == 39) & (ends - starts == 1) & cut[starts] & ~new_text[ends]]
    if len(o):
        letter = lambda i: np.where((o + i < n), lead[np.minimum(o + i, n - 1)], 0)
        same = lambda i: ~new_text[np.minimum(o + i, n)] & (o + i < n)
        a, b = letter(1), letter(2)
        one = same(1) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = same(1) & same(2) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for k, hit in ((1, one), (2, two)):
            cut[o[hit] + 1] = False
            cut[o[hit] + 1 + k] = True
    return at[np.flatnonzero(cut[:n])]


piece_hashes = _vec.stretch_hashes


class Encoder:
    """The library's encoding of whole texts, with each distinct piece encoded once.

    Byte-pair merges never cross pieces, so the ids of a text are those of its pieces in turn. Texts that hold one of
    the vocabulary's added tokens, and vocabularies with another pre-tokenizer, go to the library whole.
    """

    def __init__(self, spec: str):
        import json

        from tokenizers import Tokenizer

        self.lib, j = Tokenizer.from_str(spec), json.loads(spec)
        pre = j.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not j.get("normalizer") and (j.get("model") or {}).get("type") == "BPE"
        self.added = [x["content"].encode() for x in j.get("added_tokens") or []]
        self.reset()

    def reset(self) -> None:
        # per known piece: hash, first id, number of ids, first byte, number of bytes
        self.main = [np.zeros(0, U), *[np.zeros(0, np.int64) for _ in range(4)]]
        self.new = [x.copy() for x in self.main]
        self.tokens, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes, self.n_bytes = np.zeros(1 << 18, np.uint8), 0

    def _find(self, table, keys):
        i = np.minimum(np.searchsorted(table[0], keys), max(len(table[0]) - 1, 0))
        return (i, table[0][i] == keys) if len(table[0]) else (i, np.zeros(len(keys), bool))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for g in got for x in g), np.uint32, int(n.sum())), n

    def _add(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        raw = buf.tobytes()
        flat, n = self._library([raw[a : a + k].decode("utf-8", "replace") for a, k in zip(start.tolist(), size.tolist(), strict=True)])
        while self.used + len(flat) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[self.used : self.used + len(flat)] = flat
        whole = int(size.sum())
        while self.n_bytes + whole > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.n_bytes : self.n_bytes + whole] = buf[_vec.ragged(start, size)]
        self.new = self._merged(self.new, [keys, self.used + np.cumsum(n) - n, n, self.n_bytes + np.cumsum(size) - size, size])
        self.used += len(flat)
        self.n_bytes += whole
        if len(self.new[0]) > max(1 << 16, len(self.main[0]) // 4):
            self.main, self.new = self._merged(self.main, self.new), [x[:0] for x in self.new]

    @staticmethod
    def _merged(a, b):
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return [keys[order]] + [np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True)]

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        got = None
        if self.by_piece:
            raw = buf.tobytes()
            if not any(x in raw for x in self.added):
                got = self._by_piece(buf, bounds)
        if got is None:
            raw = buf.tobytes()
            got = self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        return got

    def _by_piece(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``encode``; None if two different pieces have one hash, which byte comparison finds."""
        if len(self.main[0]) + len(self.new[0]) > CACHE_PIECES:
            self.reset()
        start = pieces(buf, bounds)
        size = np.append(start[1:], len(buf)) - start
        keys, index, inverse = np.unique(piece_hashes(buf, start, start + size), return_index=True, return_inverse=True)
        first, length = start[index], size[index]
        if not ((size == length[inverse]) & _vec.same_stretches(buf, start, buf, first[inverse], size)).all():
            return None
        known = self._find(self.main, keys)[1] | self._find(self.new, keys)[1]
        if not known.all():
            miss = np.flatnonzero(~known)
            self._add(keys[miss], buf, first[miss], length[miss])
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for table in (self.main, self.new):
            i, hit = self._find(table, keys)
            i = i[hit]
            if not ((table[4][i] == length[hit]) & _vec.same_stretches(buf, first[hit], self.bytes, table[3][i], length[hit])).all():
                return None
            at[hit], n[hit] = table[1][i], table[2][i]
        counts = n[inverse]
        ids = self.tokens[_vec.ragged(at[inverse], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.searchsorted(start, bounds)])


def encoder(spec: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = ("encoder", zlib.crc32(spec.encode()))
    if key not in _state:
        _state[key] = Encoder(spec)
    return _state[key]


# ------------------------------------------------------------------------------------------------------------- codes


def _padded(b: bytes, to: int = 8) -> bytes:
    return b + b"\0" * (-len(b) % to)


def dac_bytes(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray) -> bytes:
    """A whole file of directly addressable codes."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits = _padded(bits, 64)
        ones = np.bitwise_count(np.frombuffer(bits, U)).reshape(-1, 8).sum(1, dtype=np.int64) if bits else np.zeros(0, np.int64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<i8")
        levels.append(struct.pack("<q", len(rest)) + _padded((rest & 0xFF).astype(np.uint8).tobytes()) + bits + rank.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<qqq", len(doc_ids), len(ids), len(levels)) + doc_ids.astype("<i8").tobytes() + _padded(nulls.astype(np.uint8).tobytes()) + starts.astype("<i8").tobytes()
    return head + b"".join(levels)


class DacFile:
    """Reads tokens at any place of a file, without decoding what lies before."""

    def __init__(self, data):
        raw = np.frombuffer(data, np.uint8)
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_tokens, n_levels = raw[8:32].view("<i8").tolist()
        at = 32

        def take(nbytes, kind, pad=8):
            nonlocal at
            x = raw[at : at + nbytes].view(kind)
            at += nbytes + -nbytes % pad
            return x

        self.doc_ids, self.nulls = take(8 * self.n_docs, "<i8"), take(self.n_docs, np.uint8)
        self.starts, self.levels = take(8 * (self.n_docs + 1), "<i8"), []
        for _ in range(n_levels):
            n = int(take(8, "<i8")[0])
            chunks = take(n, np.uint8)
            words = (n + 511) // 512 * 8
            self.levels.append((chunks, take(8 * words, "<u8"), take(8 * (words // 8 + 1), "<i8")))

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64)
        out, live = np.zeros(len(at), np.int64), np.arange(len(at))
        for k, (chunks, bits, rank) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.int64) << (8 * k)
            word = at >> 6
            goes = (bits[word] >> (at & 63).astype(U) & U(1)).astype(bool)
            live, at, word = live[goes], at[goes], word[goes]
            if not len(at):
                break
            before = rank[at >> 9].copy()
            for i in range(7):
                earlier = (word & 7) > i
                before += np.where(earlier, np.bitwise_count(bits[(word & ~7) + i]).astype(np.int64), 0)
            below = (U(1) << (at & 63).astype(U)) - U(1)
            at = before + np.bitwise_count(bits[word] & below).astype(np.int64)
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of a stretch: per level one run of chunks, whose place one rank gives."""
        out, live = np.zeros(end - start, np.int64), slice(None)
        a, b = start, end
        for k, (chunks, bits, rank) in enumerate(self.levels):
            if k == 0:
                out[:] = chunks[a:b]
            else:
                out[live] |= chunks[a:b].astype(np.int64) << (8 * k)
            w0, w1 = a >> 6, (b + 63) >> 6
            goes = np.unpackbits(bits[w0:w1].view(np.uint8), bitorder="little")[a - (w0 << 6) : b - (w0 << 6)].astype(bool)
            live = np.flatnonzero(goes) if k == 0 else live[goes]
            n = int(goes.sum())
            if not n:
                break
            before = int(rank[a >> 9]) + int(np.bitwise_count(bits[(a >> 9) * 8 : a >> 6]).sum())
            if a & 63:
                before += int(bits[a >> 6] & ((U(1) << U(a & 63)) - U(1))).bit_count()
            a, b = before, before + n
        return out


# ---------------------------------------------------------------------------------------------------------- operator

FILES = "part int, file_no int, uri string, n_docs bigint, n_tokens bigint"
DIRECTORY = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_codes(docs: DataFrame, spark: SparkSession, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the codes of all texts in ascending doc_id; returns the files: part, file_no (their order), uri, counts.

    ``vocabulary`` is the path of a tokenizer file on the driver; its text goes to the executors (a few MB, whatever
    the data are).
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    folder = folder or _shared.new_folder(spark, "codes")
    _shared.small_batches(spark)

    def write(batches):
        from pyspark import TaskContext

        enc, part, no, rows = encoder(spec.value), TaskContext.get().partitionId(), 0, []
        held: list[tuple] = []

        def flush():
            nonlocal no, held
            if not held:
                return
            counts = np.concatenate([h[3] for h in held])
            starts = np.concatenate([[0], np.cumsum(counts)])
            f = _shared.SharedFile(folder, f"{_shared.attempt()}-{no:05d}.dac")
            f.write(dac_bytes(np.concatenate([h[2] for h in held]), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), starts))
            rows.append((part, no, f.close(), len(counts), int(starts[-1])))
            no, held = no + 1, []

        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(1))
            ids = batch.column(0)
            nulls = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for i, j, b, o in _vec.chunks(buf, bounds, ENCODE_BYTES):
                toks, n = enc.encode(b, o)
                at = np.cumsum(n)
                toks = np.insert(toks, at, np.uint32(end_id))
                held.append((ids[i:j], nulls[i:j], toks, n + 1))
                if sum(len(h[2]) for h in held) >= FILE_TOKENS:
                    flush()
        flush()
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["part", "file_no", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return _shared.written(ordered.mapInArrow(write, FILES), spark, "code-files")


def read_codes(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    with_base = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = DacFile(_shared.read_shared(uri))
                starts = np.asarray(f.starts)
                crc = np.zeros(f.n_docs, np.int64)
                for i in range(0, f.n_docs, 512):
                    j = min(i + 512, f.n_docs)
                    ids = f.slice(int(starts[i]), int(starts[j])).astype("<u4")
                    raw = memoryview(ids.tobytes())
                    for d in range(i, j):
                        crc[d] = zlib.crc32(raw[4 * (starts[d] - starts[i]) : 4 * (starts[d + 1] - starts[i])])
                ids = pa.array(np.asarray(f.doc_ids), pa.int64(), mask=np.asarray(f.nulls).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a given number of tasks: adaptive execution would read rows as small as names in a single one
    return with_base.select("uri", "base").repartition(max(1, files.count()), "uri").mapInArrow(read, DIRECTORY)


def default_vocabulary() -> str:
    """The vocabulary file of the registered query, where this machine keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(docs: DataFrame, spark: SparkSession, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the codes of all texts and reads each document's entry back from the files."""
    return read_codes(write_codes(docs, spark, vocabulary or default_vocabulary(), end_id))
