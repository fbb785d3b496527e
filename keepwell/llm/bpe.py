"""Byte-level BPE by backtracking.

The text is cut as the tokenizer's pattern says. Within a piece an Aho-Corasick automaton names every token that occurs,
so the longest at each place is known; the encoder walks from left to right, takes the longest token that may follow the
one before it, and steps back where none may. Whether two tokens may stand side by side is asked of a table of pairs: a
pair is compatible when merging by rank would not join anything across their border. This gives the merges' own result
in time linear in the piece. Decoding reads one table of token bytes by offsets.

Each worker loads the vocabulary file once and keeps the ids of short pieces in a bounded cache. Null texts count as
empty and have no tokens, whole texts are encoded however long, repeated rows give repeated results, an empty table an
empty one. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import python_ready, small

#: Pieces kept with their ids in each worker, and the longest that is kept: about 100 MB.
CACHE_PIECES, CACHE_CHARS = 400_000, 32
KEEP_FIRST = 60_000
CACHE_PAIRS = 500_000
# Fixed value: how the tokenizer cuts texts (its ByteLevel step).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, for which the standard library's engine is twice as fast.
ASCII_PIECES = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        self.to_letters = {b: c for b, c in enumerate(letters)}
        self.latin = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = 1 + max([*vocab.values(), *special.values()])

        spelled = [b""] * size
        for word, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in word)
        for word, i in special.items():
            spelled[i] = word.encode()
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.cumsum([0, *map(len, spelled)])
        self.lengths = [len(s) for s in spelled]

        # a token's age is the order in which merging makes it: bytes first, then by rank
        self.made = {i: (i, i) for w, i in vocab.items() if len(w) == 1}
        self.age = {i: -1 - i for i in self.made}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((left, right), both)
            if both not in self.age:
                self.age[both], self.made[both] = rank, (left, right)
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}

        self.words = ahocorasick.Automaton()
        for word, i in vocab.items():
            self.words.add_word(word, i)
        self.words.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for word, i in vocab.items():
            self.shorter[i] = next((vocab[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in vocab), None)

        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PIECES.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ascii_pieces = re.compile(ASCII_PIECES)
        self.decimals = [str(i) for i in range(size)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._border_holds(left, right)
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Take both tokens apart again in the reverse of the order in which merging made them, the younger first. Each
        pair of parts that met at the border must have had no merge that came before the next step on either side."""
        latest = len(self.rank)  # ranks below this one were tried while the two parts met
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < latest:
                return False
            left_age, right_age = self.age[left], self.age[right]
            if left_age < 0 and right_age < 0:
                return True
            if left_age > right_age:
                latest, left = left_age, self.made[left][1]
            else:  # a merge of the right token's own rank would have come first at the border, which lies further left
                latest, right = right_age + 1, self.made[right][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        word = piece.encode().decode("latin-1").translate(self.latin)
        n = len(word)
        if n == 1:
            return (self.words.get(word),)
        sizes = self.lengths  # a letter stands for a byte
        longest: list[int] = [-1] * (n + 1)  # by the place before the token's first letter, -1 for the first of all
        for end, token in self.words.iter(word):  # of those that begin together, the longer end later
            longest[end - sizes[token]] = token
        open_ = bytearray(b"\x01") * (n + 1)  # places from which the rest has not failed
        out: list[int] = []
        at, last, token = 0, None, longest[-1]
        pairs, shorter = self.pairs, self.shorter
        while True:
            while token is not None:
                if open_[at + sizes[token]]:
                    fits = True if last is None else pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:  # step back: the rest cannot begin here
                open_[at] = 0
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else None
                continue
            out.append(token)
            at += sizes[token]
            if at == n:
                return tuple(out)
            last, token = token, longest[at - 1]

    def _kept(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece, put into the cache; of a full cache half goes, but for the KEEP_FIRST oldest, among which are the common ones."""
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_PIECES:
                    for old in list(islice(self.cache, KEEP_FIRST, KEEP_FIRST + (CACHE_PIECES - KEEP_FIRST) // 2)):
                        del self.cache[old]
                self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            pieces = (self.ascii_pieces if part.isascii() else self.pieces).findall(part)
            found = list(map(cache.get, pieces))
            if None in found:
                found = [self._kept(piece) if ids is None else ids for piece, ids in zip(pieces, found, strict=True)]
            out.extend(chain.from_iterable(found))
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return self.blob[places].tobytes().decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def load(path: str | None = None) -> Bpe:
    """The vocabulary at a path, or the default one, which each machine looks up for itself."""
    return Bpe(default_path() if path is None else path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>", lambda bpe, text: (bpe.encode(text),), [pa.list_(pa.int32())])


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; the text decoded from the ids is not kept."""

    def told(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        decoded = bpe.decode(np.array(ids, np.int64))
        return len(ids), hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", told, [pa.int64(), pa.string(), pa.string()])


def encode_checked(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text)."""

    def told(bpe: Bpe, text: str) -> tuple:
        ids = np.array(bpe.encode(text), np.int32)
        return len(ids), ids, bpe.decode(ids) == text

    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids array<int>, round_trip boolean", told, [pa.int64(), pa.list_(pa.int32()), pa.bool_()])


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text."""
    return _mapped(encoded, path, id_col, ids_col, "text string", lambda bpe, ids: (bpe.decode(np.array(ids, np.int64)),), [pa.string()], [])


def _mapped(rows: DataFrame, path: str | None, id_col: str, value_col: str, columns: str, f, types: list[pa.DataType], empty="") -> DataFrame:
    python_ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in small(batches):
            found = [f(bpe, empty if v is None else v) for v in batch.column(1).to_pylist()]
            columns_ = zip(*found, strict=True) if found else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns_, types, strict=True)]], names=["doc_id", *[c.split()[0] for c in columns.split(", ")]])

    picked = rows.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {columns}")


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
