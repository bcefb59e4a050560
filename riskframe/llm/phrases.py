"""Phrase collocation mining: exact counts of word sequences by language, level by level, with double-array tries.

Words that are frequent in their language become numbers (a number belongs to one language, so that tries need not
know languages); the texts become sequences of numbers, with 0 for every break and every rare word, which no frequent
phrase holds. At level L the candidates, whose parts of L - 1 words are all frequent, form tries of bounded size. Each
trie is broadcast, and a task moves the states of all its positions through it at once, a word at a time; the states
that accept are counted, and each task's counts are summed. In the same pass, an accepting position whose next L words
may be frequent too (a bit array of fixed size) tallies the longer phrase: those that reach the least count in sum are
the next candidates.

Numbers of words go out in blocks of WORDS, candidates in tries of PHRASES, so that no broadcast grows with the corpus;
more of them take more passes. Null texts are empty, null languages `und`; empty texts and empty tables have no
phrases; repeated rows each count; very long texts are taken whole. Ties are settled by count and phrase. Only lang
and text are read: other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import drop_written, join_salted, written

#: Words of a block of the vocabulary, phrases of a trie, positions moved at once, tallies held by a task.
WORDS, PHRASES, POSITIONS, TALLIES = 1_000_000, 250_000, 1 << 20, 2_000_000
#: Symbols of a state up to which all states with as many find their places together.
FEW = 16
#: Bits of the array of frequent phrases: for each phrase, and at most.
BITS, MOST_BITS = 16, 1 << 26
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z to lower case, every break to a line end, tab to space.
TABLE = bytes.maketrans(UPPER + b".,;:!?\n\v\f\r\t", UPPER.lower() + b"\n" * 10 + b" ")


def counted_words(rows: DataFrame, held: int = 200_000) -> DataFrame:
    """(lang, word, n): words of each language with their counts, and the count of all words under a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out = [(lang, word, n) for lang, c in counts.items() for word, n in [*c.items(), (None, c.total())]]
            counts.clear()
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.translate(TABLE).split())
                if sum(map(len, counts.values())) > held:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, least: int, block_words: int) -> tuple[DataFrame, int, int]:
    """(id, block, lang, word, n of the language) of the frequent words, numbered from 1; how many, and their blocks."""
    counts = written(counted_words(rows).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    frequent = counts.where("word IS NOT NULL")
    size = frequent.count()
    blocks = max(1, -(-size // block_words))
    frequent = frequent.withColumn("block", F.pmod(F.xxhash64("lang", "word"), F.lit(blocks)).cast("int"))
    before, starts = 0, []
    for block, n in sorted(frequent.groupBy("block").count().collect()):
        starts.append((block, before))
        before += n
    own = F.row_number().over(Window.partitionBy("block").orderBy("lang", "word"))
    numbered = frequent.drop("n").withColumn("own", own).join(F.broadcast(rows.sparkSession.createDataFrame(starts, "block int, start long")), "block")
    totals = counts.where("word IS NULL").select("lang", "n")
    out = join_salted(numbered.select((F.col("own") + F.col("start")).cast("int").alias("id"), "block", "lang", "word"), totals, "lang", "word")
    return written(out.select("id", "block", "lang", "word", "n"), "vocabulary"), size, blocks


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def numbered(rows: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """codes: the numbers of each text's words as 32-bit integers, runs of 0 cut to one."""
    for block in range(blocks):
        known = words.where(F.col("block") == block).select("id", "lang", "word").toArrow()
        shared, last = rows.sparkSession.sparkContext.broadcast(known), block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, first=block == 0) -> Iterator[pa.RecordBatch]:
            ids: dict[str, Numbers] = {}
            for i, lang, word in zip(*(c.to_pylist() for c in shared.value.columns), strict=True):
                ids.setdefault(lang, Numbers())[word] = i
            for batch in batches:
                out = []
                columns = [c.to_pylist() for c in batch.columns]
                for k, (lang, text) in enumerate(zip(columns[0], columns[1], strict=True)):
                    found = filter(None, text.translate(TABLE).replace(b"\n", b" \n ").split(b" "))
                    codes = np.fromiter(map(ids.get(lang, Numbers()).__getitem__, found), np.int32)
                    if not first:
                        codes = np.maximum(codes, np.frombuffer(columns[2][k], np.int32))
                    if last:
                        codes = codes[(codes > 0) | (np.append(codes[1:], 0) > 0)]
                    out.append(codes.tobytes())
                kept = [] if last else batch.columns[:2]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], [*["lang", "text"][: len(kept)], "codes"])

        more = rows.mapInArrow(run, "codes binary" if last else "lang string, text binary, codes binary")
        before, rows = rows, written(more, "codes")
        if block:
            drop_written(before)
    return rows


class DoubleArray:
    """A trie of phrases of equal length: the child of state s by symbol c is base[s] + c, if check says s there."""

    def __init__(self, phrases: np.ndarray) -> None:
        self.phrases = phrases = phrases[np.lexsort(phrases.T[::-1])]
        n, self.length = phrases.shape
        self.words = np.unique(phrases)
        symbols = np.searchsorted(self.words, phrases) + 1
        self.most = len(self.words) + 1
        self.base, self.check = (np.full(2 * (self.most + n), v, np.int32) for v in (0, -1))
        self.free_from = self.most  # below are the root's children, as its base is 0
        state, changed = np.zeros(n, np.int64), np.zeros(n, bool)
        changed[0] = True
        for depth in range(self.length):
            changed[1:] |= symbols[1:, depth] != symbols[:-1, depth]
            at = np.flatnonzero(changed)
            parent, symbol = state[at], symbols[at, depth]
            starts = np.flatnonzero(np.diff(parent, prepend=-1))
            sizes = np.diff(np.append(starts, len(at)))
            if depth:
                self.settle(parent[starts], symbol, starts, sizes)
                alone = starts[sizes == 1]
                self.put(parent[alone], symbol[alone], self.free(len(alone)) - symbol[alone])
            else:
                self.put(0, symbol, 0)
            state = (self.base[parent] + symbol)[np.cumsum(changed) - 1]
        self.accepts = np.full(len(self.check), -1, np.int32)
        self.accepts[state] = np.arange(n)

    def put(self, parent: np.ndarray | int, symbols: np.ndarray, base: np.ndarray | int) -> None:
        self.base[parent] = base
        self.check[base + symbols] = parent

    def reserve(self, size: int) -> None:
        if size > len(self.check):
            more = size + size // 2 - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int32)), np.append(self.check, np.full(more, -1, np.int32))

    def free(self, n: int) -> np.ndarray:
        """The first n free places that any symbol can stand at."""
        self.reserve(self.free_from + int((self.check >= 0).sum()) + n + self.most)
        return np.flatnonzero(self.check[self.free_from :] < 0)[:n] + self.free_from

    def settle(self, parents: np.ndarray, symbol: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Bases of all groups of several symbols, the largest first: those of more than FEW symbols one by one, each from
        where the last one was found on (until they are half as large), the others of a size together."""
        order = np.argsort(-sizes, kind="stable")
        at, since = self.free_from, 0
        for g in order[sizes[order] > FEW].tolist():
            if 2 * sizes[g] < since or not since:
                at, since = self.first_free(), sizes[g]
            own = symbol[starts[g] : starts[g] + sizes[g]]
            base, at = self.fit(own, at)
            self.put(parents[g], own, base)
        self.first_free()
        for size in range(FEW, 1, -1):
            of_size = order[sizes[order] == size]
            self.settle_together(parents[of_size], symbol[starts[of_size][:, None] + np.arange(size)])

    def first_free(self, step: int = 4096) -> int:
        """Where to look from: places that are nearly full are not looked at again."""
        while self.free_from + step < len(self.check) and (self.check[self.free_from : self.free_from + step] < 0).sum() < step // 32:
            self.free_from += step
        return self.free_from

    def fit(self, symbols: np.ndarray, at: int, step: int = 4096) -> tuple[int, int]:
        """A base with which all symbols fall on free places, and where it was found; steps too full for so many are passed over."""
        while True:
            self.reserve(at + step + 2 * self.most)
            places = np.flatnonzero(self.check[at : at + step] < 0) + at
            if len(places) * (len(places) / step) ** (len(symbols) - 1) > 0.01:
                bases, some = places - symbols[0], min(64, (1 << 18) // len(symbols) + 1)
                for part in np.split(bases, range(some, len(bases), some)):
                    fits = (self.check[part[:, None] + symbols] < 0).all(1)
                    if fits.any():
                        return int(part[fits.argmax()]), at
            at += step

    def settle_together(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Bases of groups of equally many symbols: in each round every group tries one of the first free places, and gets
        it if all its symbols' places are free and no group before it wants one of them."""
        draw, spare = np.random.default_rng(0), 4
        while len(parents):
            free = self.free(max(65_536, spare * symbols.size))
            bases = draw.choice(free, len(parents), replace=False) - symbols[:, 0]
            places = bases[:, None] + symbols
            self.reserve(int(places.max()) + 1)
            mine = np.zeros(places.size, bool)
            mine[np.unique(places, return_index=True)[1]] = True
            won = (mine.reshape(places.shape) & (self.check[places] < 0)).all(1)
            self.base[parents[won]] = bases[won]
            self.check[places[won]] = parents[won][:, None]
            if won.sum() < len(won) // 8:
                spare *= 2
            parents, symbols = parents[~won], symbols[~won]

    def accepted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) of each phrase in codes, which end in zeros as many as a phrase has words."""
        near = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        symbols = np.where(self.words[near] == codes, near + 1, 0)
        at = np.flatnonzero(symbols)
        state = symbols[at]
        for depth in range(self.length):
            if depth:
                symbol = symbols[at + depth]
                state, before = self.base[state] + symbol, state
                alive = (symbol > 0) & (self.check[state] == before)
            else:
                alive = self.check[state] == 0
            at, state = at[alive], state[alive]
        return at, self.accepts[state]


def mixed(codes: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Hashes below `bits` (a power of two) of the `length` codes from each place on."""
    h = np.zeros(len(at), np.uint64)
    for i in range(length):
        h = (h ^ codes[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h & np.uint64(bits - 1)


class Tally:
    """Counts of 64-bit keys, in arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        keys, n = np.unique(keys, return_counts=True)
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > 4 * TALLIES:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.parts = [(keys[first], np.add.reduceat(n, first))]
        self.size = sum(len(p[0]) for p in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        keys, n = self.parts[0] if self.parts else (np.empty(0, np.int64),) * 2
        self.parts, self.size = [], 0
        return keys, n


def packed(phrases: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of words as byte strings of big-endian 32-bit integers, with counts."""
    width = 4 * phrases.shape[1]
    data = np.ascontiguousarray(phrases, ">i4").tobytes()
    ends = pa.py_buffer(np.arange(0, width * (len(phrases) + 1), width, np.int32).tobytes())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(phrases), [None, ends, pa.py_buffer(data)]), pa.array(n.astype(np.int64))], ["phrase", "n"])


def level(codes: DataFrame, candidates: DataFrame, length: int, least: int, extend: bool, trie_size: int) -> DataFrame:
    """(phrase, n): the frequent phrases of this length, and candidates of the next one (those longer by a word)."""
    spark = codes.sparkSession
    size = candidates.count()
    tries = max(1, -(-size // trie_size))
    bits = 1 << min(MOST_BITS, max(64, BITS * size)).bit_length()
    shard = F.pmod(F.xxhash64("phrase"), F.lit(tries))
    unpacked = lambda part: np.frombuffer(b"".join(part.column(0).to_pylist()), ">i4").reshape(-1, length).astype(np.int32)
    maybe = np.zeros(bits, bool)
    built = []
    for i in range(tries):
        phrases = unpacked(candidates.where(shard == i).select("phrase").toArrow())
        if not len(phrases):
            continue
        maybe[mixed(phrases.reshape(-1), np.arange(len(phrases)) * length, length, bits)] = True
        built.append(spark.sparkContext.broadcast(DoubleArray(phrases)))
    frequent = spark.sparkContext.broadcast(np.packbits(maybe)) if extend and length > 1 else None

    def run(batches: Iterator[pa.RecordBatch], trie) -> Iterator[pa.RecordBatch]:
        own, tally = trie.value, Tally()
        known = frequent.value if frequent else None
        total = np.zeros(len(own.phrases), np.int64)
        gap = bytes(4 * (length + 1))

        def moved(texts: list[bytes]) -> None:
            c = np.frombuffer(gap.join([*texts, b""]), np.int32)
            at, phrase = own.accepted(c)
            np.add(total, np.bincount(phrase, minlength=len(total)), out=total)
            if extend:
                more = c[at + length] > 0
                if known is not None:
                    h = mixed(c, at[more] + 1, length, bits)
                    more[more] = (known[h >> np.uint64(3)] << (h & np.uint64(7)).astype(np.uint8) & 128) > 0
                at, phrase = at[more], phrase[more]
                tally.add(phrase.astype(np.int64) << 32 | c[at + length])

        def tallied() -> pa.RecordBatch:
            keys, n = tally.take()
            return packed(np.hstack([own.phrases[keys >> 32], (keys & 0xFFFFFFFF).astype(np.int32)[:, None]]), n)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text) // 4 + length + 1
                if size > POSITIONS:
                    moved(held)
                    held, size = [], 0
                    if tally.size > TALLIES:
                        tally.merge()
                        if tally.size > TALLIES:
                            yield tallied()
        moved(held)
        yield packed(own.phrases[total > 0], total[total > 0])
        if extend:
            yield tallied()

    out = None
    for trie in built:
        part = codes.mapInArrow(lambda batches, trie=trie: run(batches, trie), "phrase binary, n long")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "phrase binary, n long")
    return written(out.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")


def counts(rows: DataFrame, longest: int = 5, least: int = 100, *, block_words: int = WORDS, trie_size: int = PHRASES) -> tuple[DataFrame, DataFrame]:
    """((phrase, n), vocabulary): all phrases of up to `longest` words that occur at least `least` times in a language."""
    words, size, blocks = vocabulary(rows, least, block_words)
    codes = numbered(rows, words, blocks)
    found = None
    candidates = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("phrase"))
    for length in range(1, longest + 1):
        both = level(codes, candidates, length, least, length < longest, trie_size)
        own = both.where(F.length("phrase") == 4 * length)
        found = own if found is None else found.union(own)
        candidates = both.where(F.length("phrase") == 4 * (length + 1))
    drop_written(codes)
    return found, words


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, most: int = 2_000, *, block_words: int = WORDS, trie_size: int = PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `most` best phrases of 2 to `longest` words.

    The score of a phrase is the smallest of floor(1000 * a * n / (l * r)) over its cuts in two, the first of equal
    ones; phrases that a longer one always surrounds are left out.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found, words = counts(rows, longest, least, block_words=block_words, trie_size=trie_size)
    found = written(found, "counts")
    long = found.where(F.length("phrase") > 4).withColumnRenamed("n", "a")
    # What a longer phrase always surrounds, one that is longer by a word does, as counts only fall with length.
    parts = F.array(F.expr("substring(phrase, 1, length(phrase) - 4)"), F.expr("substring(phrase, 5)"))
    around = found.where(F.length("phrase") > 8).select(F.explode(parts).alias("phrase"), "n").groupBy("phrase").agg(F.max("n").alias("most"))
    long = long.join(around.hint("merge"), "phrase", "left").where("100 * coalesce(most, 0) < 100 * a").drop("most")  # both grow with the corpus
    each = long.select("phrase", "a", F.posexplode(F.expr("transform(sequence(0, length(phrase) div 4 - 1), i -> cast(conv(hex(substring(phrase, 4 * i + 1, 4)), 16, 10) as int))")).alias("at", "id"))
    named = join_salted(each, words.select("id", "lang", "word", "n"), "id", "phrase")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ")
    long = named.groupBy("phrase", "a").agg(F.first("lang").alias("lang"), F.first("n").alias("n"), text.alias("text"))
    cuts = long.withColumn("k", F.explode(F.expr("sequence(1, length(phrase) div 4 - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring(phrase, 1, 4 * k)"), "rest": F.expr("substring(phrase, 4 * k + 1)")})
    cuts = join_salted(cuts, found.select(F.col("phrase").alias("first"), F.col("n").alias("l")), "first", "phrase")
    cuts = join_salted(cuts, found.select(F.col("phrase").alias("rest"), F.col("n").alias("r")), "rest", "phrase")
    score = F.expr("(CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0))) div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))")
    best = cuts.groupBy("phrase", "lang", F.col("text"), "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("lang", F.col("text").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "_part").orderBy(*order)  # a language is dealt over tasks, each keeps its best
    near = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
