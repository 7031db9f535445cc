"""Byte-level BPE in linear time, by backtracking.

Encoding a piece walks it from the left with the longest vocabulary token at
each place, found for all places by one Aho-Corasick pass over the reversed
bytes.  A token is taken if it is compatible with the one before it, that is if the
merges of the two, run together, would leave the border between them; the table
of pair compatibility is filled by undoing merges on demand.  If not, the next
shorter token at that place is tried, then the token before is taken back.
Places known to lead nowhere are marked, so every place is tried once per token
length and the result is exactly that of merging in rank order.

Decoding gathers from one byte string with an offset table.

Defined results: a null text is empty; empty texts have no ids; the string of an
added token is that token, as in the tokenizers library; decoding replaces byte
sequences that aren't UTF-8.  Texts of any length are encoded whole: of a text over
``LONG_TEXT`` characters ``FLUSH`` pieces are held at a time, and the memory of known pieces is bounded.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The public pre-tokenization pattern of this vocabulary family; white space is
#: Unicode's White_Space.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces that a process remembers.
REMEMBERED = 400_000
#: Characters from which a text's pieces are taken a few at a time, and how many.
LONG_TEXT = 1 << 18
FLUSH = 1 << 16
NONE = 1 << 30


def printable_bytes() -> dict[str, int]:
    """The public byte alphabet of byte-level BPE: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, model = printable_bytes(), spec["model"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in model["vocab"].items() if k not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Inside, a token is a byte (0..255) or 256 + the rank of the merge that makes it.
        self.bytes_of = [bytes([b]) for b in range(256)]
        self.split = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        own = {bytes([b]): b for b in range(256)}
        for a, b in merges:
            left, right = own[raw(a)], own[raw(b)]
            made = self.bytes_of[left] + self.bytes_of[right]
            token = own.setdefault(made, len(self.bytes_of))
            self.pair.setdefault((left, right), token)
            if token == len(self.bytes_of):
                self.bytes_of.append(made)
                self.split.append((left, right))
        self.ids = [vocab[x] for x in self.bytes_of]
        self.length = [len(x) for x in self.bytes_of]
        # The longest token that is a proper prefix of each token.
        self.shorter = [next((own[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in own), -1) for x in self.bytes_of]
        self.longest = ahocorasick.Automaton()
        for x, token in own.items():
            self.longest.add_word(x[::-1].decode("latin-1"), token)
        self.longest.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.added = added
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = max([*self.ids, *added.values()]) + 1
        text_of = [b""] * size
        for token, x in zip(self.ids, self.bytes_of):
            text_of[token] = x
        for x, token in added.items():
            text_of[token] = x.encode()
        self.offsets = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(x) for x in text_of], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(text_of), dtype=np.uint8)
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order keeps the border between two tokens."""
        key, limit, answer = (left, right), NONE, True
        while True:
            made = self.pair.get((left, right))
            if made is not None and made < limit:
                answer = False
                break
            # Undo the later of the two merges; equal splits mark single bytes.
            if left > right:
                limit, after = left, self.split[left][1]
                if after == left:
                    limit, first = right + 1, self.split[right][0]
                    if first == right:
                        break
                    right = first
                else:
                    left = after
            else:
                limit, first = right + 1, self.split[right][0]
                if first == right:
                    limit, after = left, self.split[left][1]
                    if after == left:
                        break
                    left = after
                else:
                    right = first
        if len(self.fits) >= 4 * REMEMBERED:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def piece(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        # Matches that end at one place of the reversed bytes come longest first.
        longest, last = [], -1
        for end, token in self.longest.iter(data[::-1].decode("latin-1")):
            if end != last:
                longest.append(token)
                last = end
        longest.reverse()
        alive = bytearray(b"\1" * (n + 1))
        length, shorter, fits = self.length, self.shorter, self.fits
        taken: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not alive[end]:
                good = False
            elif not taken:
                good = True
            elif (good := fits.get((taken[-1], token))) is None:
                good = self.compatible(taken[-1], token)
            if good:
                taken.append(token)
                at = end
                if at == n:
                    return tuple(self.ids[t] for t in taken)
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = taken.pop()
                at -= length[token]

    def _learn(self, piece: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = self.piece(piece.encode())
        if len(piece) <= 256:
            self.known[piece] = ids
        return ids

    def _run(self, text: str):
        """The pieces of a text without added tokens."""
        if len(text) <= LONG_TEXT:
            return self.pieces.findall(text)
        return (m[0] for m in self.pieces.finditer(text))

    def runs(self, text: str):
        """The pieces of a text; added tokens as their id."""
        if self.special is None or not any(x in text for x in self.added):
            return self._run(text)
        return self._between(text)

    def _between(self, text: str):
        at = 0
        for m in self.special.finditer(text):
            yield from self._run(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self._run(text[at:])

    def encode(self, text: str) -> np.ndarray:
        known, learn, found = self.known, self._learn, self.runs(text)
        if found.__class__ is list:
            parts = [known.get(p) or learn(p) for p in found]
            return np.fromiter(itertools.chain.from_iterable(parts), dtype=np.uint32)
        out = []
        while some := list(itertools.islice(found, FLUSH)):
            parts = [(known.get(p) or learn(p)) if p.__class__ is str else (p,) for p in some]
            out.append(np.fromiter(itertools.chain.from_iterable(parts), dtype=np.uint32))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self.blob[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder per process and vocabulary."""
    return Bpe(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id, ids, decoded``: the token ids of every whole text and their decoding."""
    path = path or vocabulary()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            values = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, ids array<int>, decoded string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
