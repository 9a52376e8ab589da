"""Operator 10: token ids as sorted-string-table shards.

Documents are dealt by ranges of their id, sorted, encoded and written as one file for each range. A file holds
documents keyed by id in blocks whose keys share prefixes, then a sparse index (first key of each block), a Bloom
filter over the keys and a footer of fixed size; a lookup asks the filter, finds the block by binary search in the
index and scans that block.

    file   = block* index bloom footer
    block  = (varint shared, varint rest, varint n_ids, rest key bytes, ids)*       shared is 0 for a block's first key
    index  = (u32 key length, key, u64 offset, u32 length, u64 ids before the block, u32 documents)*
    footer = u64 index offset, u32 index length, u64 bloom offset, u32 bloom length, u64 documents, u64 ids, u8 bytes
             of an id (2 if the vocabulary fits, else 4), u8 hashes, 8 bytes magic       (all little-endian)

Keys are 8 bytes, big-endian with the sign bit turned, so that byte order is the order of ids; a null id has the empty
key and comes first. A table with one row for each shard (path and totals) says what was written; where each shard starts
follows from sums over runs of shards and sums inside a run, so no task or driver holds all of them. Shards are written under
fresh names in the shared folder through pyarrow's file systems; only files that a finished task reported are read, so lost
executors and repeated attempts leave at most unused files.

Defined results: a null text counts as empty (the end id alone); rows with equal ids are all kept, ordered by text;
extra columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import cut, only, parts_for, shared_dir, whole_text
from charlspark.llm.shingles import mixed
from charlspark.llm.suffix_dedup import BASE, powers, ragged

MAGIC = b"idtable1"
FOOTER = struct.Struct("<QIQIQQBB8s")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Encoded chunks that a Python worker remembers, at most.
MEMO_CHUNKS = 500_000
#: Texts and characters of them that are encoded at a time, about.
SLICE_TEXTS, SLICE_CHARS = 1000, 2_000_000
#: Shards in a run, for the running sums.
RUN_SHARDS = 4096
#: White space for Python's split() that Unicode's White_Space property lacks.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: White space of Latin-1 for split(), without the odd one.
SPACE = np.zeros(256, bool)
SPACE[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = True


def chunks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start and length of each run of other bytes than white space, the first of those that equal it, as a number, and where
    the first ones are. Hashes find equal ones, bytes decide."""
    gap = np.concatenate([[True], SPACE[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64)])
    inverse = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(data) + 1)
    h = mixed((total[starts + lengths] - total[starts]) * inverse[starts])
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    same = first[code]
    alike = lengths == lengths[same]
    alike[alike] = ~np.logical_or.reduceat(data[ragged(starts[alike], lengths[alike])] != data[ragged(starts[same[alike]], lengths[alike])], np.cumsum(lengths[alike]) - lengths[alike]) if alike.any() else True
    odd = np.flatnonzero(~alike)  # another chunk with the same hash: a number of its own
    code[odd] = len(first) + np.arange(len(odd))
    return starts, lengths, code, np.concatenate([first, odd])


class ChunkEncoder:
    """Ids of the library for a tokenizer that drops white space, whose words never span it. Texts are put together from
    chunks between white space, chunks from words, and the library encodes each distinct word once, many in a call.

    Texts beyond Latin-1, where lower case and composition need the library's own rules, and texts with special tokens or
    odd white space are cut at white space only, or not at all."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(spec)
        self.words = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        end, vocab = told["model"]["end_of_word_suffix"], self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.marks = regex.compile("|".join(regex.escape(t["content"]) for t in told["added_tokens"]) or "(?!)")
        self.id_bytes = 2 if len(self.ends) <= 1 << 16 else 4
        self.dtype = f"<u{self.id_bytes}"
        self.chunks: dict[bytes, bytes] = {}  # lower-case Latin-1 chunks
        self.others: dict[str, bytes] = {}  # chunks that the library encodes as they stand
        self.known: dict[str, bytes] = {}  # words

    def learn_words(self, words: list[str]) -> None:
        """A word's last token carries the end mark, so many words go to the library as one text."""
        for at in range(0, len(words), 50_000):
            lines = [words[i : i + 250] for i in range(at, min(at + 50_000, len(words)), 250)]
            for line, e in zip(lines, self.library.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(line):
                    raise ValueError("the tokenizer does not mark the ends of words")
                data, ends = ids.tobytes(), [0, *(cuts * self.id_bytes).tolist()]
                self.known.update((w, data[i:j]) for w, i, j in zip(line, ends, ends[1:]))

    def is_plain(self, text: str) -> bool:
        """Latin-1 without special tokens and odd white space."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not (ODD_SPACE.search(text) or self.marks.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian integers of id_bytes."""
        for memo in (self.chunks, self.others, self.known):
            if len(memo) > MEMO_CHUNKS:
                memo.clear()
        plain = [self.is_plain(t) for t in texts]
        done = iter(self.encode_plain([t for t, p in zip(texts, plain) if p]))
        odd = iter(self.encode_odd([t for t, p in zip(texts, plain) if not p]))
        return [next(done if p else odd) for p in plain]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Each distinct chunk of all texts is looked up once; the ids are gathered for all chunks at a time."""
        raw = "\n".join([t.lower() for t in texts]).encode("latin-1")
        starts, lengths, code, first = chunks_of(np.frombuffer(raw, np.uint8))
        distinct = [raw[a:b] for a, b in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist())]
        new = {c: self.words.findall(c.decode("latin-1")) for c in distinct if c not in self.chunks}
        self.learn_words([w for w in {w for x in new.values() for w in x} if w not in self.known])
        self.chunks.update((c, b"".join([self.known[w] for w in x])) for c, x in new.items())
        found = [self.chunks[c] for c in distinct]
        table, n_ids = np.frombuffer(b"".join(found), self.dtype), np.array([len(f) for f in found], np.int64) // self.id_bytes
        ids = table[ragged((np.cumsum(n_ids) - n_ids)[code], n_ids[code])].tobytes()
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        before = np.concatenate([[0], np.cumsum(n_ids[code])]) * self.id_bytes
        cuts = [0, *before[np.searchsorted(starts, ends)].tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_odd(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if ODD_SPACE.search(t) or self.marks.search(t) else t.split() for t in texts]
        new = list({p for parts in cut for p in parts if p not in self.others})
        for chunk, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            self.others[chunk] = np.array(e.ids, self.dtype).tobytes()
        return [b"".join(map(self.others.__getitem__, parts)) for parts in cut]


def text_slices(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts, SLICE_TEXTS or about SLICE_CHARS at a time."""
    at, held, run = 0, 0, []
    for k in range(len(texts)):
        run.append(texts[k].as_py())
        held += len(run[-1])
        if held >= SLICE_CHARS or len(run) == SLICE_TEXTS or k + 1 == len(texts):
            yield keys.slice(at, len(run)).to_pylist(), run
            at, held, run = k + 1, 0, []


def encoder(spec: str) -> ChunkEncoder:
    """One encoder for each worker and file."""
    return only(f"sstable {hash(spec)}", lambda: ChunkEncoder(spec))


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_at(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The bits of each hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard from entries in key order; holds one block, the index and a hash of each key."""

    def __init__(self, uri: str, id_bytes: int) -> None:
        self.uri, self.id_bytes = uri, id_bytes
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.block, self.held, self.last, self.first = [], 0, b"", None
        self.index: list[bytes] = []
        self.hashes: list[int] = []
        self.offset = self.docs = self.ids = self.block_ids = self.block_docs = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.held >= BLOCK_BYTES:
            self.end_block()
        if self.first is None:
            self.first, self.block_ids, self.block_docs, self.last = key, self.ids, self.docs, b""
        shared = next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))
        n = len(ids) // self.id_bytes
        self.block += [varint(shared), varint(len(key) - shared), varint(n), key[shared:], ids]
        self.held += len(ids) + 16
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + n
        self.hashes.append(xxhash.xxh64_intdigest(key))

    def end_block(self) -> None:
        data = b"".join(self.block)
        self.out.write(data)
        self.index.append(struct.pack("<I", len(self.first)) + self.first + struct.pack("<QIQI", self.offset, len(data), self.block_ids, self.docs - self.block_docs))
        self.offset += len(data)
        self.block, self.held, self.first = [], 0, None

    def close(self) -> None:
        if self.first is not None:
            self.end_block()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * self.docs + 7 & ~7)
        bloom = np.zeros(bits, bool)
        bloom[bloom_at(np.array(self.hashes, np.uint64), bits, BLOOM_HASHES).ravel().astype(np.int64)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), self.docs, self.ids, self.id_bytes, BLOOM_HASHES, MAGIC))
        self.out.close()


class Shard:
    """Reads a shard: scan() for all documents, lookup() for one."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        at, n, bloom_off, bloom_n, self.docs, self.ids, self.id_bytes, self.hashes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a table of ids")
        self.dtype = f"<u{self.id_bytes}"
        self.file.seek(at)
        data, i = self.file.read(n), 0
        self.bloom_place = (bloom_off, bloom_n)
        self.keys, self.blocks = [], []
        while i < n:
            (k,) = struct.unpack_from("<I", data, i)
            self.keys.append(data[i + 4 : i + 4 + k])
            self.blocks.append(struct.unpack_from("<QIQI", data, i + 4 + k))
            i += 4 + k + 24
        self._bloom = None

    def read_block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids of the shard before the document, ids) for each document of block k."""
        offset, length, before, _ = self.blocks[k]
        self.file.seek(offset)
        data, at, key = self.file.read(length), 0, b""
        while at < length:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, before, np.frombuffer(data, self.dtype, n, at)
            before, at = before + n, at + n * self.id_bytes

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, before, ids in self.read_block(k):
                yield id_of(key), before, ids

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self.file.seek(self.bloom_place[0])
            self._bloom = np.unpackbits(np.frombuffer(self.file.read(self.bloom_place[1]), np.uint8), bitorder="little")
        at = bloom_at(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self._bloom), self.hashes)
        return bool(self._bloom[at.ravel().astype(np.int64)].all())

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        k, found = max(0, bisect_right(self.keys, key) - 1), []
        while k > 0 and self.keys[k] == key:  # equal keys may begin in an earlier block
            k -= 1
        while k < len(self.keys) and self.keys[k] <= key:
            found += [ids for own, _, ids in self.read_block(k) if own == key]
            k += 1
        return found


def write_shards(docs: DataFrame, spec: str, end_id: int = 1, shard_mb: float = 16.0, key: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """Encodes every text and writes the shards. Returns a table with a row for each shard: part (in key order), path, docs,
    ids, start (ids in all shards before). shard_mb: size of the input in a shard, about."""
    spark = docs.sparkSession
    folder = out or f"{shared_dir(spark)}/ids"
    ranged = (
        docs.select(F.col(f"`{key}`").cast("long").alias("k"), whole_text(f"`{text}`").alias("t"))
        .repartitionByRange(parts_for(docs, shard_mb), "k")
        .sortWithinPartitions("k", "t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, end = encoder(spec), None, None
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = ShardWriter(f"{folder}/shard-{part:06d}-{attempt}.ids", enc.id_bytes)
                end = np.array([end_id], enc.dtype).tobytes()
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                for k, ids in zip(keys, enc.encode(texts)):
                    writer.add(key_of(k), ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.uri]), pa.array([writer.docs]), pa.array([writer.ids])], names=["part", "path", "docs", "ids"])

    shards = cut(ranged.mapInArrow(run, "part int, path string, docs long, ids long"))
    numbered = shards.withColumn("run", F.floor(F.col("part") / RUN_SHARDS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = numbered.groupBy("run").agg(F.sum("ids").alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(before.orderBy("run")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(before.partitionBy("run").orderBy("part")), F.lit(0))
    return cut(numbered.withColumn("start", inside).join(runs, "run").select("part", "path", "docs", "ids", (F.col("start") + F.col("base")).alias("start")))


def read_shards(spark, shards: DataFrame) -> DataFrame:
    """Reads the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). One task reads about one shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(d, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, before, ids in Shard(path).scan()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "start").repartition(max(1, shards.count())).mapInArrow(run, schema)


def read_spec(path: str | None = None) -> str:
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()
