"""Operator 3: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The ids equal those of the tokenizers library for a byte-level BPE file (add_special_tokens=False). Texts are cut at
single spaces into units; the distinct units' words go into a trie, which is walked depth first. Each trie node is a
prefix of some word, and its state is the last token of that prefix's encoding. By BPE's prefix property the encoding
of a prefix is (encoding of what lies before the last token) + (last token), so a node's state follows from one
ancestor's state and is computed once for all words that share the prefix.

Spark spreads the documents; each task holds one Arrow batch and a bounded dictionary of encoded units. Nothing is
shuffled or collected. The tokenizer file (1-2 MB) travels with the tasks.

Defined results: a null text counts as empty; an empty text has 0 tokens and the hash of the empty string; null ids and
repeated rows pass through row by row; other columns are untouched (output columns replace input columns of the same
name); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from charlspark.llm.common import only, whole_text

#: Encoded units that a Python worker remembers, at most; then it starts afresh.
MEMO_UNITS = 400_000
#: Characters of text that are cut into words at a time.
SLICE_CHARS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encodes with a byte-level BPE vocabulary by walking a trie of words."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        model, alphabet = json.loads(spec), byte_alphabet()
        if model["normalizer"] or model["pre_tokenizer"].get("type") != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = model["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.raw = {i: b for b, i in self.ids.items()}
        self.tails = {b[i:]: -1 for b in self.ids for i in range(1, len(b))} | self.ids  # every end of a token; -1: no token
        self.merges = {}
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        text = self.raw | {i: s.encode() for s, i in self.special.items()}
        self.as_text, self.as_decimal = Strings(text), Strings({i: b"%d," % i for i in text})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.fits: dict[tuple[int, int], bool] = {}
        self.spaced: dict[str, bytes] = {}  # unit that follows a space -> ids
        self.bare: dict[str, bytes] = {}  # piece as it stands -> the same

    def words(self, piece: str) -> list[str]:
        """The pattern's words; for rare scripts, whose classes differ between Unicode versions, the library cuts."""
        if piece.isascii() or max(piece) < "Ԁ":
            return self.pattern.findall(piece)
        return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]

    def merged(self, parts: list[int]) -> list[int]:
        """Plain BPE on a short list of ids: the lowest rank merges first, the leftmost of equals."""
        while len(parts) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts

    def follows(self, left: int | None, right: int) -> bool:
        """Whether an encoding may have right just after left (None: at the start)."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            text = (self.raw[left] if left is not None else b"") + self.raw[right]
            known = self.merged([self.ids[text[i : i + 1]] for i in range(len(text))]) == ([right] if left is None else [left, right])
            self.fits[left, right] = known
        return known

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Depth-first walk over the trie of words, in sorted order. states[i]: last token of the current path's first i
        bytes. Two neighbours in sorted order share the path as far as their common prefix, whose states stay. Exactly
        one token can end a prefix's encoding, so candidates are tried from the shortest on."""
        tails, raw, fits, follows = self.tails.get, self.raw, self.fits, self.follows
        states: list[int | None] = [None]
        before = b""
        for word in sorted(words):
            n = len(word)
            shared = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), n))
            del states[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(end - 1, -1, -1):
                    token = tails(word[start:end])
                    if token is None:
                        raise ValueError(f"no encoding of {word[:end]!r}")
                    if token >= 0:
                        known = fits.get((states[start], token))
                        if follows(states[start], token) if known is None else known:
                            states.append(token)
                            break
            path, end = [], n
            while end:
                path.append(states[end])
                end -= len(raw[path[-1]])
            yield word, path[::-1]
            before = word

    def learn(self, spaced: set[str], bare: set[str]) -> None:
        """Encodes units and pieces that are not known yet; their distinct words share one trie."""
        jobs = [(self.spaced, u, self.words(" " + u)) for u in spaced] + [(self.bare, u, self.words(u)) for u in bare]
        as_bytes = {w: w.encode() for _, _, words in jobs for w in words}
        encoded = {w: np.array(path, "<u4").tobytes() for w, path in self.walk(list(as_bytes.values()))}
        for memo, unit, words in jobs:
            memo[unit] = b"".join([encoded[as_bytes[w]] for w in words])

    def pieces(self, text: str) -> list[tuple[str, list[str], list[str]]]:
        """(special token before, bare pieces, spaced units) in order. Runs of spaces need the whole pattern, as a word
        takes one space of a run only; else units between single spaces are independent."""
        cut = [("", text)]
        if self.special_pattern and self.special_pattern.search(text):
            marks = ["", *self.special_pattern.findall(text)]
            cut = list(zip(marks, self.special_pattern.split(text)))
        out = []
        for mark, part in cut:
            if "  " in part:
                out.append((mark, self.words(part), []))
            else:
                head, *units = part.split(" ")
                out.append((mark, [head] if head else [], units))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.spaced) + len(self.bare) > MEMO_UNITS:
            self.spaced.clear(), self.bare.clear()
        texts_cut = [self.pieces(t) for t in texts]
        cut = [(mark, bare, list(map(self.bare.get, bare)), spaced, list(map(self.spaced.get, spaced))) for t in texts_cut for mark, bare, spaced in t]
        new = [{u for part in cut if None in part[k + 1] for u, known in zip(part[k], part[k + 1]) if known is None} for k in (3, 1)]
        self.learn(*new)
        parts, out = iter(cut), []
        for n in map(len, texts_cut):
            ids: list[bytes] = []
            for mark, bare, known, spaced, known_spaced in itertools.islice(parts, n):
                if mark:
                    ids.append(np.array([self.special[mark]], "<u4").tobytes())
                ids += known if None not in known else map(self.bare.__getitem__, bare)
                ids += known_spaced if None not in known_spaced else map(self.spaced.__getitem__, spaced)
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        return self.as_text.join(ids).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return self.as_decimal.join(ids)[:-1]


class Strings:
    """Byte strings by id, joined for whole arrays of ids at a time."""

    def __init__(self, by_id: dict[int, bytes]) -> None:
        self.lengths = np.zeros(max(by_id) + 1, np.int64)
        self.lengths[list(by_id)] = [len(b) for b in by_id.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.data[np.repeat(self.starts[ids] - before, lengths) + np.arange(lengths.sum())].tobytes()


def coder(spec: str) -> TrieBPE:
    """One coder for each worker and file."""
    return only(f"bpe_trie {hash(spec)}", lambda: TrieBPE(spec))


def slices(texts: pa.ChunkedArray | pa.Array) -> Iterator[list[str]]:
    """Runs of whole texts of about SLICE_CHARS."""
    run, held = [], 0
    for t in texts:
        run.append(t.as_py() or "")
        held += len(run[-1])
        if held >= SLICE_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}
ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}


def encode_decode(docs: DataFrame, outputs: list[str], spec: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds outputs (of OUTPUTS) to the columns keep (all) of docs: ids, their number and hash, the text that the ids
    decode to and its hash."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    source = "__text"
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], whole_text(f"`{text}`").alias(source))
    schema = T.StructType([*[f for f in frame.schema if f.name != source], *[T.StructField(o, OUTPUTS[o]) for o in outputs]])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(spec)
        make = {
            "ids": lambda ids, back: ids,
            "n_tokens": lambda ids, back: len(ids),
            "ids_sha256": lambda ids, back: sha(bpe.decimals(ids)),
            "decoded": lambda ids, back: back,
            "decoded_sha256": lambda ids, back: sha(back.encode()),
        }
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for texts in slices(batch.column(batch.schema.get_field_index(source))):
                for ids in bpe.encode(texts):
                    back = bpe.decode(ids) if {"decoded", "decoded_sha256"} & made.keys() else ""
                    for o, values in made.items():
                        values.append(make[o](ids, back))
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != source]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(made[o], ARROW[o]) for o in outputs]], names=schema.names)

    return frame.mapInArrow(run, schema)


def read_spec(path: str | None = None) -> str:
    """The tokenizer file's content (read on the driver, so executors need no such file)."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()
