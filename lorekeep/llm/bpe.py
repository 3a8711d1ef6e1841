"""Operator 10: byte-level BPE encoding and decoding through a distinct-word table.

Documents are split into words, block by block: a block has its distinct words, numbered, and each document as the
numbers of its words, in order. The blocks' words meet in buckets by a hash of the word, so that all occurrences of a
word come to one bucket, which encodes it once; the ids go back to the block and are joined there by number, at each
position of the documents. Decoding joins the ids with a table of their pieces, which is as large as the tokenizer's
vocabulary. A word is a run of other characters than white space with the one space before it, or white space, so the
pattern of the pre-tokenizer never crosses its border.

What crosses the network: each block's distinct words once, their ids once, and the documents as numbers. A block and a
part of a document are of bounded size; a frequent word is one entry a block, so no bucket grows with its frequency.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.llm.common import settled, small_batches, trim, trimmed

#: Characters and parts of texts that are split at a time, words and distinct words of a block, about.
SLICE_CHARS, SLICE_PARTS, BLOCK_WORDS, BLOCK_DISTINCT = 1 << 18, 1 << 13, 2_000_000, 300_000
#: Buckets of distinct words for each shuffle partition, and words of which a bucket keeps the ids.
BUCKETS, KEPT_WORDS = 4, 100_000
#: The characters of the property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[SPACES] = True
_SAFE = re.compile("[^{0}](?=[{0}])".format("".join(map(chr, SPACES))))


class Vocabulary:
    """What splitting and decoding need of a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        spec["truncation"] = spec["padding"] = None
        self.spec = json.dumps(spec)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = sorted(added, key=len, reverse=True)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        names = {i: t for t, i in {**spec["model"]["vocab"], **added}.items()}
        pieces = [bytes(alphabet[c] for c in names[i]) if i in names and all(c in alphabet for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(pieces), np.uint8)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of ids one after the other, and the end of each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


def word_starts(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in code points c; first: where a text or a part of one begins, whose borders no word crosses."""
    space = _IS_SPACE[np.minimum(c, 0x3001)]
    before, more = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = False, space[:-1]
    more[-1], more[:-1] = False, ~space[1:] & ~first[1:]
    bare = np.empty_like(space)  # after white space that no word takes along
    bare[0], bare[1:] = False, c[:-1] != 0x20
    return first | (space & (~before | more)) | (~space & before & bare)


def numbered(parts: list[tuple[str, bool]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the numbers of all words in order, and how many each part has. parts: texts, and whether one is a word as a whole."""
    sizes = np.array([len(p) for p, _ in parts], np.int64)
    text = "".join(p for p, _ in parts)
    if not text:
        return [], np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
    ends = np.cumsum(sizes)
    first = np.zeros(len(text) + 1, bool)
    first[ends - sizes] = True
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begins = word_starts(c, first[:-1])
    for (_, whole), b, e in zip(parts, (ends - sizes).tolist(), ends.tolist()):
        if whole:
            begins[b + 1 : e] = False
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], len(text))
    x = c.astype(np.uint64) * M1
    x += (np.arange(len(c)) - np.repeat(starts, stops - starts)).astype(np.uint64) * M2
    x ^= x >> np.uint64(31)
    x *= M3
    x ^= x >> np.uint64(29)
    _, at, codes = np.unique(np.add.reduceat(x, starts), return_index=True, return_inverse=True)
    words = [text[s:e] for s, e in zip(starts[at].tolist(), stops[at].tolist())]
    if "".join([words[i] for i in codes.tolist()]) != text:  # words of one hash
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(starts.tolist(), stops.tolist())], np.int64)
        words = list(known)
    return words, codes, np.diff(np.searchsorted(starts, np.append(ends - sizes, len(text))))


def planes(x: np.ndarray) -> bytes:
    """Numbers as all first bytes, all second bytes and so on."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Blocks:
    """Documents dealt into blocks; rows of a block's words by bucket, or of its documents as numbers, come when it is full."""

    def __init__(self, vocabulary: Vocabulary, serial: int, buckets: int | None = None):
        """serial: of the first block; buckets: of words, or None for rows of documents."""
        self.cuts = re.compile("(" + "|".join(map(re.escape, vocabulary.added)) + ")") if vocabulary.added else None
        self.added, self.serial, self.buckets = vocabulary.added, serial, buckets
        self.pack = zstandard.ZstdCompressor(level=6).compress
        self.keys, self.owner, self.parts, self.chars = [], [], [], 0
        self.clear()

    def clear(self) -> None:
        self.known, self.counts, self.rows, self.words = {}, np.zeros(0, np.int64), [], 0

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """A text in parts of at most about SLICE_CHARS characters, cut where white space begins; added tokens are parts."""
        out = []
        for k, p in enumerate(self.cuts.split(text) if self.cuts and any(a in text for a in self.added) else [text]):
            at = 0
            while not k % 2 and len(p) - at > SLICE_CHARS and (m := _SAFE.search(p, at + SLICE_CHARS - 1)):
                out.append((p[at : m.end()], False))
                at = m.end()
            out.append((p[at:], bool(k % 2)))
        return out

    def add(self, key, text: str):
        for k, p in enumerate(self.pieces(text)):
            if self.parts and (self.chars + len(p[0]) > SLICE_CHARS or len(self.parts) >= SLICE_PARTS):
                self.slice(open_=k > 0)
                if not k and (self.words > BLOCK_WORDS or len(self.known) > BLOCK_DISTINCT):
                    yield self.close()
            if not k or not self.keys:  # else another part of the text before
                self.keys.append(key)
            self.owner.append(len(self.keys) - 1)
            self.parts.append(p)
            self.chars += len(p[0])

    def slice(self, open_: bool) -> None:
        words, codes, n = numbered(self.parts)
        number = np.array([self.known.setdefault(w, len(self.known)) for w in words], np.uint32)
        if len(self.known) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.known), np.int64)])
        self.counts[number] += np.bincount(codes, minlength=len(words))
        if self.buckets is None:
            sizes = np.bincount(self.owner, n, len(self.keys)).astype(np.int64)
            self.rows.append((self.keys, sizes.tolist(), open_, number[codes]))
        self.words += len(codes)
        self.keys, self.owner, self.parts, self.chars = [], [], [], 0

    def close(self) -> list[tuple]:
        """(bucket, block, mark, slots, words) or (block, rank, mark, keys, sizes, open, data)."""
        if self.parts:
            self.slice(open_=False)
        ws = [w.encode() for w in self.known]
        mark, block = xxhash.xxh3_64_intdigest(b"".join(ws), len(ws)) >> 1, self.serial
        # frequent words get low numbers, which are packed best
        by = np.argsort(-self.counts[: len(ws)], kind="stable")
        slot = np.empty(len(ws), np.uint32)
        slot[by] = np.arange(len(ws))
        out = [(block, k + 1, mark, *row[:3], self.pack(planes(slot[row[3]]))) for k, row in enumerate(self.rows)]
        if self.buckets is not None and ws:
            ws = [ws[i] for i in by.tolist()]
            size, bucket = np.array([len(w) for w in ws], "<u4"), np.array([xxhash.xxh3_64_intdigest(w) % self.buckets for w in ws])
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                slots = np.diff(own, prepend=0).astype("<u4").tobytes()
                out.append((int(bucket[own[0]]), block, mark, self.pack(slots), self.pack(size[own].tobytes() + b"".join([ws[i] for i in own.tolist()]))))
        self.clear()
        self.serial += 1
        return out


def encoder(spec: str):
    """From words to their ids as little-endian unsigned 32-bit integers, in this thread alone: others would keep memory of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)

    def encoded(words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(words), 512) for e in tokenizer.encode_batch_fast(words[k : k + 512], add_special_tokens=False)]

    return encoded


def _rows(blocks: Blocks, batches, names: list[str], kinds: list):
    """Record batches of the rows of blocks over batches of (doc_id, text)."""

    def out(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for rows in blocks.add(key, text):
                yield from out(rows)
                trim()
    yield from out(blocks.close())
    trim()


def _encoded_words(spec: str, batches):
    """The ids of the words of rows (bucket, block, mark, slots, words), sorted by bucket; within a bucket each word is encoded once."""
    own, known, now = encoder(spec), {}, None
    pack, unpack = zstandard.ZstdCompressor(level=6).compress, zstandard.ZstdDecompressor().decompress
    for b in batches:
        out = []
        for bucket, block, mark, slots, words in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now or len(known) > KEPT_WORDS:
                known, now = {}, bucket
            n, raw = len(unpack(slots)) // 4, unpack(words)
            ends = (np.cumsum(np.frombuffer(raw, "<u4", n)) + 4 * n).tolist()
            ws = [raw[x:y] for x, y in zip([4 * n, *ends], ends)]
            if new := [w for w in ws if w not in known]:
                known.update(zip(new, own([w.decode() for w in new])))
            ids = [known[w] for w in ws]
            out.append((block, mark, slots, pack(np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids))))
        if out:
            a = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.binary()), pa.array(a[3], pa.binary())], names=["block", "mark", "slots", "data"])


class Block:
    """The ids of a block's words by their numbers."""

    def __init__(self, rows: list[tuple[bytes, bytes]], mark: int):
        """rows: slots and data of each bucket."""
        unpack, self.mark = zstandard.ZstdDecompressor().decompress, mark
        slots = [np.cumsum(np.frombuffer(unpack(s), "<u4"), dtype=np.int64) for s, _ in rows]
        raw = [unpack(d) for _, d in rows]
        counts = [np.frombuffer(r, "<u4", len(s)) for r, s in zip(raw, slots)]
        at, n = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (slots, counts))
        self.ids = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r, "<u4", offset=4 * len(s)) for r, s in zip(raw, slots))])
        self.count, self.begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        self.count[at], self.begin[at] = n, np.cumsum(n) - n

    def joined(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their numbers in data, and the end of each word's."""
        codes = from_planes(zstandard.ZstdDecompressor().decompress(data))
        n = self.count[codes]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.begin[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Result:
    """What is gathered of a document whose parts come one after the other."""

    def __init__(self, digests: bool):
        self.digests, self.n, self.decoder = digests, 0, codecs.getincrementaldecoder("utf-8")("replace")
        self.a, self.b = (hashlib.sha256(), hashlib.sha256()) if digests else (bytearray(), bytearray())

    def add(self, ids: bytes, text: bytes, last: bool) -> None:
        self.n += len(ids) // 4
        text = self.decoder.decode(text, last).encode()
        if self.digests:
            self.a.update(ids), self.b.update(text)
        else:
            self.a += ids
            self.b += text

    def row(self, key) -> tuple:
        return (key, self.n, self.a.hexdigest(), self.b.hexdigest()) if self.digests else (key, bytes(self.a), bytes(self.b))


def _documents(vocabulary, digests: bool, batches, names: list[str], kinds: list):
    """Results of documents from rows (block, rank, mark, keys, sizes, open, slots, data), sorted by block and rank: words' ids first."""
    now, held, block, result = None, [], None, None
    for b in batches:
        for at, rank, mark, keys, sizes, open_, slots, data in zip(*(c.to_pylist() for c in b.columns)):
            if at != now:
                now, held, block, result = at, [], None, None
            if not rank:
                held.append((mark, slots, data))
                continue
            if block is None:
                if any(m != mark for m, _, _ in held):
                    raise RuntimeError("documents differed between two passes over them")
                block, held = Block([x[1:] for x in held], mark), []
            ids, ends = block.joined(data)
            text, text_ends = vocabulary.decoded(ids)
            ids, text = ids.tobytes(), text.tobytes()
            stops = np.concatenate([[0], ends])[np.cumsum(sizes)]
            places = np.concatenate([[0], text_ends])[stops]
            out, x, y = [], 0, 0
            for k, (key, stop, place) in enumerate(zip(keys, stops.tolist(), places.tolist())):
                result = result or Result(digests)
                last = not open_ or k + 1 < len(keys)
                result.add(ids[4 * x : 4 * stop], text[y:place], last)
                if last:
                    out.append(result.row(key))
                    result = None
                x, y = stop, place
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary), decoded (binary, UTF-8) of every row of documents.

    A null text counts as empty and has no ids; repeated rows and null ids are kept; extra columns are ignored.
    """
    return _encoded(documents, path, digests=False)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() gives, without moving the ids on."""
    return _encoded(documents, path, digests=True)


def _encoded(documents: DataFrame, path: str, digests: bool) -> DataFrame:
    spark = documents.sparkSession
    small_batches(spark)
    voc = spark.sparkContext.broadcast(Vocabulary(path))
    kind = dict(documents.dtypes)["doc_id"]
    key_type = to_arrow_type(documents.schema["doc_id"].dataType)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = BUCKETS * n
    # both passes split the same rows in the same order, which is checked
    rows = settled(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "bpe-documents")

    def words(batches):
        return _rows(Blocks(voc.value, TaskContext.get().partitionId() << 32, buckets), batches, ["bucket", "block", "mark", "slots", "words"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def numbers(batches):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.bool_(), pa.binary()]
        return _rows(Blocks(voc.value, TaskContext.get().partitionId() << 32), batches, ["block", "rank", "mark", "keys", "sizes", "open", "data"], kinds)

    def encoded(batches):
        return trimmed(_encoded_words(voc.value.spec, batches))

    def finish(batches):
        names, kinds = (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [key_type, pa.int64(), pa.string(), pa.string()]) if digests else (["doc_id", "ids", "decoded"], [key_type, pa.binary(), pa.binary()])
        return trimmed(_documents(voc.value, digests, batches, names, kinds))

    table = rows.mapInArrow(words, "bucket int, block long, mark long, slots binary, words binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(encoded, "block long, mark long, slots binary, data binary")
    places = rows.mapInArrow(numbers, f"block long, rank int, mark long, keys array<{kind}>, sizes array<long>, open boolean, data binary")
    both = places.unionByName(table.withColumn("rank", F.lit(0)), allowMissingColumns=True).select("block", "rank", "mark", "keys", "sizes", "open", "slots", "data")
    shape = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"doc_id {kind}, ids binary, decoded binary"
    return both.repartition(n, "block").sortWithinPartitions("block", "rank").mapInArrow(finish, shape)
