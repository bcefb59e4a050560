"""Jaccard self-join on word shingles by PartEnum signatures, and the components that its links form.

Sets of hashed 5-word shingles are joined within bands of sizes (powers of two; a set whose partners may fall
into the next band joins there too). In a band, sets that are similar enough differ in at most d shingles. The
domain is cut into N units of three parts each, and every two parts of a unit are a signature. d differing
shingles spoil min(2 d, N + d) signatures at most, so of any order that all sets share a set enumerates one more
than that: those with the most shingles that are not common come first. Signatures without shingles say nothing
and are left out: a set with too few also joins on a finer partition, and so on, until it has enough. Which
shingles are common, and which signatures are hot, is learned from a bounded sample; it bears on the cost alone,
not on the result.

Equal sets are one node from the start. A signature's sets are not paired with one another: they form the star of
a pivot (the set with the fewest rare shingles). Two similar sets share a signature and so a star. Within a star,
a set that is similar to the pivot is linked; each other set x must be told from all the rest, by how they differ
from the pivot p: with Dx = x ^ p, |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|. A star of bounded size is one group of a
task, which counts these overlaps. Larger ones are dealt over tasks by set, and their sets are joined on a prefix
of Dx: similar ones share (|Dx| + |Dy| - d) / 2 elements of their differences, so the prefixes must meet.

Documents with fewer words than a shingle are one shingle; null and empty ones have no set, link with nothing and
are their own component. An id that is repeated with another text is another document, with a component of its
own; rows with a null id take no part (null component). Ties of a component go to the smallest id. Texts of any
length are whole sets. An empty table has an empty result, and other columns of any name play no part. Sets are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.tables import drop_written, in_batches, join_salted, written

#: Rows that a task holds as Python strings at once.
ROWS = 256
#: Documents (about) in which common shingles and hot signatures are sought, and how many are remembered.
SAMPLE, COMMON, HOT = 5_000, 200_000, 50_000
#: Sampled texts that share a signature which counts as hot.
HOT_LEAST = 25
#: Stars with more sets or shingles than these are dealt over several tasks.
STAR_SETS, STAR_SHINGLES = 1_000, 1_000_000
#: Earlier keys of its prefix that a row of the join on differences knows.
EARLIER = 8
#: Nodes whose ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Words and nodes that a task remembers.
REMEMBERED = 200_000

U = np.uint64
K1, K2, K3, K4 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * K2
    x = (x ^ (x >> U(27))) * K3
    return x ^ (x >> U(31))


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


def shingles(text: str, words: Words, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, U)
    h = np.fromiter(map(words.__getitem__, found), U, len(found))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, U)
    for i in range(min(size, len(h))):
        out = out * K1 + mix(h[i : i + n] + U(i))
    return np.unique(mix(out + U(min(size, len(h)))))


def part_signatures(h: np.ndarray, m: np.ndarray, rare: np.ndarray, units: int, keep: int) -> tuple[np.ndarray, int]:
    """The first `keep` signatures (what two parts of a unit hold, hashed), and how many are not empty. m: mix(h)."""
    part = (((h >> U(32)) * U(3 * units)) >> U(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    at = part[starts]
    holds = np.zeros(3 * units, U)
    holds[at] = mix(np.add.reduceat(m, starts) + np.array([units], U) * K4)
    scarce, some = np.zeros(3 * units, np.int64), np.zeros(3 * units, bool)
    scarce[at], some[at] = np.add.reduceat(rare, starts), True
    holds, scarce, some = holds.reshape(-1, 3), scarce.reshape(-1, 3), some.reshape(-1, 3)
    two = [(0, 1), (0, 2), (1, 2)]
    sig = np.concatenate([mix(holds[:, i] * K1 + holds[:, j] * K2 + U(i + j)) for i, j in two])
    rich = np.concatenate([scarce[:, i] + scarce[:, j] for i, j in two])
    full = np.flatnonzero(np.concatenate([some[:, i] | some[:, j] for i, j in two]))
    sig, rich = sig[full], rich[full]
    return sig[np.lexsort((sig, -rich))[:keep]], len(full)


def rare(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """1 for the hashes that are not in common (sorted), else 0."""
    if not len(common):
        return np.ones(len(h), np.int64)
    return (common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h).astype(np.int64)


def signatures(h: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """All signatures of a set that may have partners other than itself. common: sorted hashes of shingles."""
    a = len(h)
    most = a * 100 // percent
    m = mix(h)
    scarce = rare(h, common)
    out = []
    for band in range(a.bit_length(), most.bit_length() + 1):
        upper = (1 << band) - 1
        d = (a + min(upper, most)) * (100 - percent) // (100 + percent)
        units, filled, keep = 2 * upper * (100 - percent) // (100 + percent) * 11 // 20 + 2, 0, 1
        while filled < keep:
            keep = min(2 * d, units + d) + 1
            sig, filled = part_signatures(h, m, scarce, units, keep)
            out.append(sig)
            units *= 4
    return np.unique(np.concatenate(out))


def sampled(docs: DataFrame) -> DataFrame:
    """(text) of about SAMPLE documents, the same at each run."""
    every = max(1, docs.count() // SAMPLE)
    return written(docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(every)) == 0).select("text"), "sample")


def often(sample: DataFrame, hashes_of: Callable[[str], np.ndarray], least: int, most: int) -> np.ndarray:
    """Sorted: those of a text's hashes that `least` distinct texts of a sample share, `most` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([lists_of([hashes_of(t or "") for t in batch.column(0).to_pylist()])], ["s"])

    counts = in_batches(sample).mapInArrow(run, "s array<long>").dropDuplicates().select(F.explode("s").alias("h")).groupBy("h").count()
    found = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).select("h").toArrow()["h"].to_numpy()
    return np.sort(found.view(U))


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, U), *arrays]).view(np.int64))


def node_of(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes()) - 2**63


def signed(docs: DataFrame, percent: int, size: int, shared) -> DataFrame:
    """A row for each signature: sig, hot (the signature, if it is hot), node (a hash of the set), rare (shingles).

    The first row of a document, which has one in any case, also says doc_id, text_hash and n_shingles. A node's
    signatures come once, at least, in each task. Where there is none, or a hot one, sig just spreads the rows.
    shared: (common shingles, hot signatures), broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        common, hot = shared.value
        spread = mix(np.array([TaskContext.get().partitionId() + 1], U) * K4)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                counts, nodes, scarce, sigs = [], [], [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    h = shingles(text or "", words, size)
                    own, node = np.empty(0, U), None
                    if len(h) and i is not None:
                        node = node_of(h)
                        if node not in seen and 200 * len(h) // percent * (100 - percent) // (100 + percent):
                            own = signatures(h, percent, common)
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                    counts.append(len(h))
                    nodes.append(node)
                    scarce.append(int(rare(h, common).sum()))
                    sigs.append(own)
                rows = np.maximum(1, [len(x) for x in sigs])
                sig = np.concatenate([x if len(x) else np.zeros(1, U) for x in sigs])
                of = pa.array(np.repeat(np.arange(len(rows)), rows))
                first = np.zeros(len(sig), bool)
                first[np.cumsum(rows) - rows] = True
                among = rare(sig, hot) == 0
                loose = among | (np.repeat([len(x) for x in sigs], rows) == 0)
                spread = spread + U(len(sig))
                key = np.where(loose, mix(spread - np.arange(len(sig), dtype=U)), sig)
                once = pa.array(np.where(first, np.repeat(np.arange(len(rows)), rows), 0), mask=~first)
                columns = [pa.array(key.view(np.int64)), pa.array(sig.view(np.int64), mask=~among)]
                columns += [pa.array(nodes, pa.int64()).take(of), pa.array(scarce, pa.int32()).take(of)]
                columns += [c.take(once) for c in (batch.column(0), batch.column(1), pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "hot", "node", "rare", "doc_id", "text_hash", "n_shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return in_batches(rows).mapInArrow(run, "sig long, hot long, node long, rare int, doc_id long, text_hash long, n_shingles long")


def starred(signed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of each document, and the distinct (p, x): nodes with their signatures' pivots.

    A signature's pivot is its node with the fewest rare shingles. One shuffle by signature; hot ones, a bounded
    number, are aggregated before any and their pivots broadcast.
    """
    order = F.struct("rare", F.xxhash64("node").alias("o"), "node")
    rows = signed_rows.withColumn("p", F.min(order).over(Window.partitionBy("sig"))["node"])
    rows = written(rows.where("p != node OR n_shingles IS NOT NULL OR hot IS NOT NULL").drop("sig"), "signatures")
    hot = rows.where("hot IS NOT NULL").select("hot", "node", "rare")
    pivots = hot.groupBy("hot").agg(F.min(order)["node"].alias("p"))
    hot = hot.join(F.broadcast(pivots), "hot")
    star = rows.where("hot IS NULL").select("p", "node").union(hot.select("p", "node")).where("p != node").toDF("p", "x").distinct()
    return rows.where("n_shingles IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "node"), written(star, "stars")


def members_of(each: DataFrame, star: DataFrame) -> DataFrame:
    """(id, x, ps): a document that holds the set x, and the stars that x belongs to, also as their pivot.

    Of a star: p, the least and the greatest size of its sets, and salts: the tasks it needs, 0 if it is small.
    """
    nodes = each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"))
    star = star.union(star.select("p", F.col("p").alias("x")).distinct()).join(nodes, F.col("x") == F.col("node"))
    sizes = star.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("sum_n"), F.min("n").alias("n_least"), F.max("n").alias("n_most"))
    large = (F.col("k") > STAR_SETS) | (F.col("sum_n") > STAR_SHINGLES)
    salts = F.when(large, F.ceil(F.greatest(F.col("k") / STAR_SETS, F.col("sum_n") / STAR_SHINGLES))).otherwise(F.lit(0).cast("long"))
    sizes = sizes.select("p", "n_least", "n_most", salts.alias("salts"))
    return join_salted(star, sizes, "p", "x").groupBy("id", "x").agg(F.collect_list(F.struct("p", "n_least", "n_most", "salts")).alias("ps"))


def sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(x, ps, s): the shingle hashes of x, for members (id, x, ps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingles(t or "", words, size) for t in batch.column(2).to_pylist()]
                # Repeated rows of an id may come with another text; the node tells them apart.
                kept = pa.array([len(h) > 0 and node_of(h) == x for h, x in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists_of(sets)], ["x", "ps", "s"]).filter(kept)

    size_of = members.agg(F.count(F.lit(1)), F.sum(F.size("ps"))).first()
    if size_of[0] <= BROADCAST_NODES and (size_of[1] or 0) <= 4 * BROADCAST_NODES:
        members = F.broadcast(members)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(members, F.col("doc") == F.col("id"))
    return in_batches(texts.select("x", "ps", "text")).mapInArrow(run, "x long, ps array<struct<p:long,n_least:long,n_most:long,salts:long>>, s array<long>")


def star_links(p: int, sets: dict[int, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that join all of the star's sets that links among them join.

    Sets that are similar to the pivot are one component. Each of the others is compared with all sets at once:
    with Dx = x ^ p, |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, and the elements of Dx say which sets share them.
    """
    hp = sets[p]
    names = [x for x in sets if x != p]
    apart = [np.setxor1d(sets[x], hp, assume_unique=True) for x in names]
    sizes, n = np.array([len(sets[x]) for x in names]), np.array([len(d) for d in apart])
    near = n * (100 + percent) <= (sizes + len(hp)) * (100 - percent)
    links = [(p, x) for x, k in zip(names, near, strict=True) if k]
    if len(names) < 2 or near.all():
        return links
    ids, count = np.unique(np.concatenate(apart), return_inverse=True, return_counts=True)[1:]
    member = np.repeat(np.arange(len(names)), n)[np.argsort(ids, kind="stable")]
    starts, ends = np.cumsum(count) - count, np.cumsum(n)
    root = np.where(near, -1, np.arange(len(names)))
    for i in np.flatnonzero(~near):
        own = ids[ends[i] - n[i] : ends[i]]
        own = own[count[own] > 1]
        long = count[own]
        others = member[np.arange(long.sum()) + np.repeat(starts[own] - (np.cumsum(long) - long), long)]
        differ = n[i] + n - 2 * np.bincount(others, minlength=len(names))
        alike = differ * (100 + percent) <= (sizes[i] + sizes) * (100 - percent)
        for j in np.flatnonzero(alike & (root != root[i])):
            if root[j] != root[i]:
                links.append((names[i], names[j]))
                root[root == root[j]] = root[i]
    return links


def closed(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within stars of bounded size, from (p, x, s); the pivot is one of its x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sets = None, {}

        def out() -> pa.RecordBatch:
            links = star_links(p, sets, percent) if p in sets else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for q, x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if q != p:
                    yield out()
                    p, sets = q, {}
                sets[x] = s.values.to_numpy().view(U).copy()
        yield out()

    return in_batches(members.repartition("p").sortWithinPartitions("p")).mapInArrow(run, "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) with the components that links (a, b) join: each takes the smallest label."""
    ends = labels.select("node", "comp")
    edges = links.join(ends.toDF("a", "u"), "a").join(ends.toDF("b", "v"), "b").where("u != v").select("u", "v").distinct()
    edges = written(edges, "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = written(up, "parents")
        jump = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        up2 = up.join(jump, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        new = written(labels.join(up2, labels["comp"] == up2["u"], "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        left = edges.join(up2.toDF("u", "pu"), "u").join(up2.toDF("v", "pv"), "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        left = written(left, "edges")
        for old in (edges, up, labels):
            drop_written(old)
        labels, edges = new, left
    return labels


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    a, b = (sets.select(F.col("x").alias(c), F.size("s").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    out = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    return out.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def differences(members: DataFrame, percent: int, shared) -> DataFrame:
    """From (p, n_least, n_most, salts, x, s): (p, x, near, size, n, probe, keys), the prefixes of x ^ p to be joined on.

    near: x is similar to p; size: of x; n: of x ^ p. probe: the prefix of a set that is not near, to meet those
    of sets whose difference is no larger. A pivot's set comes in `salts` copies, so that a star has as many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[0]
        names = ["p", "x", "near", "size", "n", "probe", "keys"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            ids = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (p, x, least, most), sp, sx in zip(ids, batch.column(4), batch.column(5), strict=True):
                hp, hx = (v.values.to_numpy().view(U) for v in (sp, sx))
                added = np.setdiff1d(hx, hp, assume_unique=True)
                gone = np.setdiff1d(hp, hx, assume_unique=True)
                few = rare(added, common) == 1
                # An order that all sets of p share: what p and others have comes last.
                order = np.concatenate([added[few], np.sort(np.concatenate([added[~few], gone]))])
                n, size = len(order), len(hx)
                d = (size + min(most, size * 100 // percent)) * (100 - percent) // (100 + percent)
                near = n * (100 + percent) <= (len(hp) + size) * (100 - percent)
                if near:
                    other = (len(hp) + max(least, -(-size * percent // 100))) * (100 - percent) // (100 + percent) + 1
                    t = -(-(n + other - d) // 2)
                else:
                    t = -(-(2 * n - d) // 2)
                    out.append((p, x, near, size, n, True, order[: n - max(1, n - d) + 1]))
                out.append((p, x, near, size, n, False, order[: n - max(1, t) + 1]))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, lists_of([o[6] for o in out])], names)

    each = members.where("p != x").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    pivots = members.where("p = x").select("p", F.col("s").alias("sp"), copies.alias("salt"))
    full = each.join(pivots, ["p", "salt"]).select("p", "x", "n_least", "n_most", "sp", F.col("s").alias("sx"))
    return in_batches(full).mapInArrow(run, "p long, x long, near boolean, size long, n long, probe boolean, keys array<long>")


def may_be_linked(percent: int) -> Column:
    """Whether x and y, if this key is the first that their differences share, may be similar enough.

    Then they share no more than what is left from here (left, left_y), and of n + n_y elements all that the two
    do not share tell x from y. Similar sets pass at their first key, so none is lost.
    """
    apart = F.col("n") + F.col("n_y") - 2 * F.least("left", "left_y")
    return (apart * (100 + percent) <= (F.col("size") + F.col("size_y")) * (100 - percent)) & (100 * F.least("size", "size_y") >= percent * F.greatest("size", "size_y"))


def met(keys: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components whose differences meet in their prefixes and may be similar.

    A pair that meets in several keys should count once, at the first. A row knows the EARLIER keys before its own:
    where two rows share one of those, the pair has met before.
    """
    comp = labels.select(F.col("node").alias("x"), "comp")
    before = F.slice("keys", F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least("at", F.lit(EARLIER)))
    rows = keys.select("*", F.posexplode("keys").alias("at", "key")).withColumns({"left": F.col("n") - F.col("at"), "before": before}).drop("keys")
    rows = rows.join(comp, "x").select("p", "key", "x", "comp", "probe", "size", "n", "left", "before")
    index = rows.where(~F.col("probe")).select("p", "key", *(F.col(c).alias(f"{c}_y") for c in ("x", "comp", "size", "n", "left", "before")))
    both = rows.where("probe").join(index, ["p", "key"])
    both = both.where((F.col("comp") != F.col("comp_y")) & may_be_linked(percent) & ~F.arrays_overlap("before", "before_y"))
    return both.select(F.least("x", "x_y").alias("a"), F.greatest("x", "x_y").alias("b")).distinct()


def components(docs: DataFrame, percent: int = 80, size: int = 5, log=None) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_hash, component_key.

    component_key tells components apart even where their smallest ids are the same, as an id may have several texts.
    """
    log = log or (lambda *_: None)
    broadcast = docs.sparkSession.sparkContext.broadcast
    sample, words = sampled(docs), Words()
    common = often(sample, lambda text: shingles(text, words, size), 2, COMMON)
    hot = often(sample, lambda text: signatures(h, percent, common) if len(h := shingles(text, words, size)) > 1 else np.empty(0, U), HOT_LEAST, HOT)
    shared = broadcast((common, hot))
    each, star = starred(signed(docs, percent, size, shared))
    sets = written(sets_of(docs, written(members_of(each, star), "members"), size), "sets")
    members = sets.select(F.explode("ps").alias("star"), "x", "s").select("star.*", "x", "s")
    links = closed(members.where("salts = 0").select("p", "x", "s"), percent)
    keys = written(differences(members.where("salts > 0"), percent, shared), "differences")
    links = written(links.union(keys.where("near").select("p", "x")), "links")
    labels = written(star.select(F.explode(F.array("p", "x")).alias("node")).distinct().select("node", F.col("node").alias("comp")), "labels")
    labels = merged(labels, links)
    log("stars", star.count(), links.count(), keys.count())
    if not keys.isEmpty():
        pairs = written(met(keys, labels, percent), "pairs")
        more = written(linked(pairs, sets, percent), "links")
        log("differences", pairs.count(), more.count())
        labels = merged(labels, more)
    nodes = each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    least = nodes.join(labels, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    own = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Nodes in no star are their own component and find no row there.
    by_node = join_salted(own, least, "comp", "node", "left")
    by_node = by_node.select(F.col("node").alias("k"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("comp").alias("component_key"))
    out = each.join(by_node, each["node"] == by_node["k"], "left")
    own_id = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", own_id).alias("component_id"), "text_hash", "component_key")
