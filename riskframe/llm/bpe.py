"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

For each word the leaves of the tree hold rank * leaves + position of the pair that starts there, so the
root is the leftmost pair of the lowest rank. A merge changes three leaves; each is a walk to the root.
Spark deals the documents out; a task encodes the words of a few hundred texts that it does not remember
together, one row of a numpy forest for each word (words over 64 bytes: one tree each), and remembers them
in a bounded cache of two generations, and so it does what stands between two spaces.

Null and empty texts have no tokens and decode to the empty text. Repeated rows each keep their own row;
other columns of the input are ignored or carried by the caller.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskframe.llm.tables import in_batches

NONE = 1 << 62
#: Encoded words in a generation of a task's cache; bytes of the longest word that goes there and to the forest.
CACHE_WORDS, SHORT = 200_000, 64


class PairTree:
    """Minimum tree over the pairs of one word; point updates in logarithmic time."""

    __slots__ = ("leaves", "node")

    def __init__(self, keys: list[int]) -> None:
        self.leaves = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [NONE] * self.leaves + keys + [NONE] * (self.leaves - len(keys))
        for i in range(self.leaves - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def set(self, at: int, key: int) -> None:
        node, i = self.node, at + self.leaves
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            least = a if a < b else b
            if node[i] == least:
                break
            node[i] = least
            i >>= 1


class Vocabulary:
    """A byte-level BPE vocabulary file (tokenizers JSON): pieces by id, merges by pair of ids."""

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        # Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        pieces = {i: bytes(self.byte_of[c] for c in piece) for piece, i in vocab.items()}
        pieces |= {i: content.encode() for content, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.start = [0] * 256
        for char, byte in self.byte_of.items():
            self.start[byte] = vocab[char]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def encode_word(self, word: bytes) -> list[int]:
        ids = [self.start[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        found = [merges.get(pair) for pair in zip(ids, ids[1:], strict=False)]
        tree = PairTree([NONE if m is None else m[0] * n + i for i, m in enumerate(found)])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (least := tree.node[1]) < NONE:
            i = least % n
            gone = after[i]
            ids[i] = merges[ids[i], ids[gone]][1]
            ids[gone] = -1
            k = after[i] = after[gone]
            if gone < n - 1:
                tree.set(gone, NONE)
            if k < n:
                before[k] = i
                m = merges.get((ids[i], ids[k]))
                tree.set(i, NONE if m is None else m[0] * n + i)
            else:
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                m = merges.get((ids[h], ids[i]))
                tree.set(h, NONE if m is None else m[0] * n + h)
        return [i for i in ids if i >= 0]


class Forest:
    """The trees of many short words as rows of arrays: each round makes one merge in every word that has one left."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.start = np.array(vocabulary.start, np.int64)
        pairs = np.array([(a, b, rank, made) for (a, b), (rank, made) in vocabulary.merges.items()], np.int64).reshape(-1, 4)
        self.ids = len(vocabulary.pieces)
        order = np.argsort(keys := pairs[:, 0] * self.ids + pairs[:, 1])
        self.keys, self.ranks = keys[order], pairs[order, 2]
        self.made = np.zeros(int(pairs[:, 2].max(initial=0)) + 1, np.int64)
        self.made[pairs[:, 2]] = pairs[:, 3]
        self.first = self.rank(np.repeat(self.start, 256), np.tile(self.start, 256))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; -1 for those that don't merge."""
        at = np.minimum(np.searchsorted(self.keys, key := a * self.ids + b), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The words (1 to SHORT bytes each) as ids in little-endian 32-bit integers."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_width.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            ids, left = self.merged([words[k] for k in members], width)
            flat, ends = ids[left].astype("<u4").tobytes(), np.cumsum(left.sum(1) * 4).tolist()
            for k, a, b in zip(members, [0, *ends], ends, strict=False):
                out[k] = flat[a:b]
        return out

    def merged(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids, left = self.start[chars], place < size[:, None]
        pad = np.full((n, 1), NONE)
        first = np.where(left[:, 1:], self.first[chars[:, :-1].astype(np.int64) << 8 | chars[:, 1:]], -1)
        node = np.empty((n, 2 * width), np.int64)
        node[:, width:] = np.hstack([np.where(first < 0, NONE, first * width + place[:-1]), pad])
        level = width
        while level > 1:
            node[:, level // 2 : level] = np.minimum(node[:, level : 2 * level : 2], node[:, level + 1 : 2 * level : 2])
            level //= 2
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        row = np.flatnonzero(node[:, 1] < NONE)
        while len(row):
            root = node[row, 1]
            i = root % width
            made, gone = self.made[root // width], after[row, i]
            k = after[row, gone]
            ids[row, i], left[row, gone], after[row, i] = made, False, k
            self.set(node, row, gone, np.full(len(row), NONE), width)
            has = k < size[row]
            before[row[has], k[has]] = i[has]
            key = np.full(len(row), NONE)
            rank = self.rank(made[has], ids[row[has], k[has]])
            key[has] = np.where(rank < 0, NONE, rank * width + i[has])
            self.set(node, row, i, key, width)
            has = (h := before[row, i]) >= 0
            r, h = row[has], h[has]
            rank = self.rank(ids[r, h], made[has])
            self.set(node, r, h, np.where(rank < 0, NONE, rank * width + h), width)
            row = row[node[row, 1] < NONE]
        return ids, left

    @staticmethod
    def set(node: np.ndarray, row: np.ndarray, at: np.ndarray, key: np.ndarray, width: int) -> None:
        i = at + width
        node[row, i] = key
        while width > 1:
            width //= 2
            i = i >> 1
            node[row, i] = np.minimum(node[row, 2 * i], node[row, 2 * i + 1])


class Known(dict):
    """Ids by word, in two generations. An unknown word gets an empty bytearray that is filled in later."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.pending: list[str] = []

    def __missing__(self, word: str) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            ids = bytearray()
            self.pending.append(word)
        self[word] = ids
        return ids

    def fill(self, ids: list[bytes]) -> None:
        """The ids of the pending words, in their order."""
        for word, data in zip(self.pending, ids, strict=True):
            self[word][:] = data
            if len(word) <= SHORT:
                self[word] = data
            else:
                del self[word]
        self.pending = []
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encodes whole texts, a few hundred at a time.

    A text whose spaces all stand alone between other characters is cut at them first: no word of the pattern
    goes beyond such a space, so what follows one up to the next (a chunk) is remembered as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        self.vocabulary, self.find, self.forest = vocabulary, regex.compile(pattern).findall, Forest(vocabulary)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.odd_space = re.compile(r" (?:\s|\Z)").search
        self.words, self.chunks = Known(), Known()

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if not self.special or not self.special.search(text):
            return self.find(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return parts + self.find(text[at:])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        found = []
        for text in texts:
            if self.odd_space(text) or self.special and self.special.search(text):
                found.append(list(map(self.words.__getitem__, self.split(text))))
            else:
                first, *chunks = text.split(" ")
                found.append([*map(self.words.__getitem__, self.find(first)), *map(self.chunks.__getitem__, chunks)])
        parts = [list(map(self.words.__getitem__, self.find(" " + chunk))) for chunk in self.chunks.pending]
        self.words.fill(self.encode_words(self.words.pending))
        self.chunks.fill([b"".join(x) for x in parts])
        return map(b"".join, found)

    def encode_words(self, words: list[str]) -> list[bytes]:
        data = [word.encode() for word in words]
        short = [k for k, d in enumerate(data) if len(d) <= SHORT]
        out = dict(zip(short, self.forest.encode([data[k] for k in short]), strict=True))
        for k, word in enumerate(words):
            if word in self.vocabulary.special:
                out[k] = np.array([self.vocabulary.special[word]], "<u4").tobytes()
            elif k not in out:
                out[k] = np.array(self.vocabulary.encode_word(data[k]), "<u4").tobytes()
        return [out[k] for k in range(len(words))]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """For each row: doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256 and decoded_sha256 of its whole text.

    The vocabulary (a fixed file of some 50,000 merges) is read on the driver and broadcast as its text.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = docs.select("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, id_hashes, text_hashes, all_ids = [], [], [], []
                for data in encoder.encode([text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]):
                    ids = np.frombuffer(data, "<u4")
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(data).hexdigest())
                    text_hashes.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                    all_ids.append(ids)
                out = [*batch.columns[:-1], pa.array(counts, pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, "<u4"), *all_ids]).astype(np.int32)))
                names = [*batch.schema.names[:-1], "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in columns.drop("text").schema.fields]
    fields += ["n_tokens long", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"]
    return in_batches(columns).mapInArrow(encoded, ", ".join(fields))
