"""SentencePiece (BPE with byte fallback) encoding and decoding over tables of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next one. Where no piece of the model has a marker
behind another character, no merge crosses from a chunk into the next, so that a chunk has the same ids wherever it
stands. The frequent chunks of the corpus are segmented once, in Spark tasks, into a table of bounded size that every
task gets. A task takes rows in blocks: their chunks become a table of distinct ones and, by position, indices into
it; each distinct chunk that the table lacks is segmented once, and ids and texts are joined back by position.

Null and empty texts have the begin and end ids alone and decode to the empty text. Texts are whole, however long;
their chunks are remembered up to LONGEST characters only. Repeated rows each keep their own row, and their order is
no part of the result; an empty table gives an empty one. Of the input only doc_id and text are read: other columns,
of whatever name, are left out. A literal U+2581 is a marker, as it is to the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.bpe import Known
from riskframe.llm.tables import drop_written, written

MARK = "▁"
#: Chunks of the table that every task gets, characters of the longest one there; bytes of text of a block of rows.
TABLE, LONGEST, BLOCK = 200_000, 64, 4 << 20
# Field numbers and kinds of the model file's format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class Model:
    """A model file: pieces by id, ranks of merges, and the ids of control and byte pieces."""

    def __init__(self, data: bytes) -> None:
        parts = list(fields(data))
        trainer = dict(x for n, v in parts if n == TRAINER for x in fields(v))
        norm = dict(x for n, v in parts if n == NORMALIZER for x in fields(v))
        pieces = [dict(fields(v)) for n, v in parts if n == PIECES]
        self.pieces = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        plain = trainer.get(3) == 2 and trainer.get(35) == 1 and not norm.get(2) and norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1
        if not plain or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models with byte fallback, a marker in front and no other normalisation or user-defined pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in self.ids.items()}
        self.bytes_ = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        control = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL}
        name = lambda n, default: trainer.get(n, default.encode()).decode()
        self.begin, self.end = control[name(46, "<s>")], control[name(47, "</s>")]
        self.unknown = trainer.get(44, " ⁇ ".encode())
        self.shown = [self.show(i) for i in range(len(self.pieces))]
        #: Whether pieces cross from one chunk into the next: then a text is a chunk as a whole.
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.ids)

    def show(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if kind == CONTROL else self.unknown if kind == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def segment(self, chunk: str) -> list[int]:
        """The ids of a chunk: the best-ranked pair that is a piece merges first, of equal ones the leftmost."""
        parts: list[str | None] = list(chunk)
        n, rank = len(parts), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pairs = []
        for i in range(n - 1):
            if (r := rank.get(chunk[i : i + 2])) is not None:
                pairs.append((r, i, 2))
        heapq.heapify(pairs)
        while pairs:
            _, i, size = heapq.heappop(pairs)
            left = parts[i]
            if left is None or (gone := after[i]) >= n or len(left) + len(parts[gone]) != size:
                continue
            parts[i], parts[gone] = left + parts[gone], None
            k = after[i] = after[gone]
            if k < n:
                before[k] = i
                if (r := rank.get(both := parts[i] + parts[k])) is not None:
                    heapq.heappush(pairs, (r, i, len(both)))
            if (h := before[i]) >= 0 and (r := rank.get(both := parts[h] + parts[i])) is not None:
                heapq.heappush(pairs, (r, h, len(both)))
        out: list[int] = []
        for part in parts:
            if part is None:
                continue
            if (found := self.ids.get(part)) is not None:
                out.append(found)
            else:
                out += map(self.bytes_.__getitem__, part.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the marker in front goes, byte pieces join, each byte that is no character is U+FFFD."""
        try:
            if any(self.kinds[i] == CONTROL for i in ids[1:-1]):  # byte pieces do not join over it
                raise ValueError
            text = b"".join(map(self.shown.__getitem__, ids)).decode()
        except ValueError:
            text, run = "", b""
            for i in [*ids, self.begin]:
                if self.kinds[i] == BYTE:
                    run += self.shown[i]
                else:
                    text += characters(run) + self.shown[i].decode()
                    run = b""
        # The first piece that shows anything gives up the marker it begins with; a byte piece keeps its space.
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK) else text


def characters(run: bytes) -> str:
    out = ""
    while run:
        for size in (1, 2, 3, 4):
            try:
                out += run[:size].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            out, size = out + "�", 1
        run = run[size:]
    return out


class Chunks:
    """The chunks of a block of texts by position: one array over all texts, and where each text ends in it.

    A chunk stands without its first marker, as each has one.
    """

    def __init__(self, texts: pa.Array, crossing: bool) -> None:
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.equal(texts, ""))
        odd_at, even_at = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (odd, pc.invert(odd)))
        if crossing:
            odd_at, even_at = np.arange(len(texts)), even_at[:0]
        split = pc.split_pattern(texts.take(pa.array(even_at)), " ")
        rest = [self.split(t, crossing) for t in texts.take(pa.array(odd_at)).to_pylist()]
        #: Rows of the block in the order in which their chunks stand here.
        self.rows = np.concatenate([even_at, odd_at])
        sizes = [split.value_lengths().to_numpy(zero_copy_only=False), np.array([len(x) for x in rest], np.int64)]
        self.ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        self.flat = pa.concat_arrays([split.flatten().cast(pa.large_string()), pa.array([c for x in rest for c in x], pa.large_string())])

    @staticmethod
    def split(text: str, crossing: bool) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked[1:]] if crossing else [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", marked)]


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // BLOCK
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def chunk_table(docs: DataFrame, model_bytes: bytes, most: int = TABLE) -> pa.Table:
    """(chunk, ids): the most frequent chunks of the corpus, at most `most`, each segmented once in a task.

    What is left out is segmented where it stands, so that the table bears on the cost alone.
    """
    crossing = Model(model_bytes).crossing
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 0):
                each = Chunks(batch.column(0), crossing).flat
                each = each.filter(pc.less_equal(pc.utf8_length(each), LONGEST)).value_counts()
                yield pa.RecordBatch.from_arrays([each.field(0).cast(pa.string()), each.field(1)], ["chunk", "n"])

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            ids = [np.array(model.segment(MARK + c), "<u4").tobytes() for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    counts = docs.select("text").mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1").withColumn("size", F.floor(8 * F.log2("n")).cast("int")), "chunks")
    least, total = 1 << 30, 0
    for size, n in sorted(counts.groupBy("size").count().collect(), reverse=True):
        if (total := total + n) > most:
            break
        least = size
    table = counts.where(F.col("size") >= least).select("chunk").mapInArrow(segmented, "chunk string, ids binary").toArrow()
    drop_written(counts)
    return table


def encode(docs: DataFrame, model_path: str, *, with_ids: bool = True, table: int = TABLE) -> DataFrame:
    """For each row: doc_id, n_tokens (begin and end among them), ids (array<int>, if asked for), ids_sha256 and
    decoded_sha256 of its whole text.

    The model (a fixed file of half a megabyte) is read on the driver and broadcast, and so is the chunk table.
    """
    with open(model_path, "rb") as f:
        model_bytes = f.read()
    columns = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes, chunk_table(columns, model_bytes, table)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, known = shared.value
        model, cache = Model(data), Known()
        cache.old = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True))
        table_ids = cache.old
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        shown = model.shown
        for whole in batches:
            for batch in blocks(whole, 1):
                chunks = Chunks(batch.column(1), model.crossing)
                distinct = chunks.flat.dictionary_encode()
                ids = [table_ids.get(c) or cache[c] for c in distinct.dictionary.to_pylist()]
                cache.fill([np.array(model.segment(MARK + c), "<u4").tobytes() for c in cache.pending])
                ids = [bytes(x) for x in ids]
                # (b"" stays only for a chunk without ids, which no chunk is: each has a marker.)
                texts = [b"".join(map(shown.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
                ids_at, ids_data = joined(ids, distinct.indices, chunks.ends)
                text_at, text_data = joined(texts, distinct.indices, chunks.ends)
                n, id_hashes, text_hashes, all_ids = ([None] * batch.num_rows for _ in range(4))
                for k, row in enumerate(chunks.rows.tolist()):
                    own = b"".join((begin, ids_data[ids_at[k] : ids_at[k + 1]], end))
                    n[row], id_hashes[row] = len(own) // 4, hashlib.sha256(own).hexdigest()
                    text_hashes[row] = hashlib.sha256(text_data[text_at[k] + 1 : text_at[k + 1]]).hexdigest()
                    all_ids[row] = np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None
                out = [batch.column(0), pa.array(n, pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *all_ids])))
                names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names)

    kind = columns.schema["doc_id"].dataType.simpleString()
    fields_ = [f"doc_id {kind}", "n_tokens long", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"]
    return columns.mapInArrow(encoded, ", ".join(fields_))


def joined(values: list[bytes], indices: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The values by position as one buffer, and where each text begins and the last ends in it."""
    taken = pa.array(values, pa.large_binary()).take(indices)
    if not len(taken):
        return np.zeros(len(ends) + 1, np.int64), memoryview(b"")
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
    return at[np.concatenate([[0], ends])], memoryview(taken.buffers()[2] or b"")
