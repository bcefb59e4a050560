"""Centroids, phrases and pieces against plain Python and the library, on odd rows and with the bounds lowered."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskframe.llm import centroids, phrases, queries, sentence_piece
from riskframe.llm.tables import join_salted, written

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", "en"), (3, "word", None), (3, "word", None), (4, "x y " * 30_000, "en"), (None, "No id: a  b.\tc▁d é😀 \n", "fr"), (6, " \n\t ", "en"), (7, "a" * 5000, "en")]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in ("n", "phrase", "ids", "chunk", "word", "id", "score", "rank", "x")})


# Centroids


def plain_clusters(vectors, k, rounds):
    """By the definition, in whole numbers of Python."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    means = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        means = [tuple(sum(x) // len(g) for x in zip(*g, strict=True)) if (g := groups.get(c)) else m for c, m in enumerate(means)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    said = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], inertia.total(), said[c]) for i, c, d in out), key=str)


@pytest.mark.parametrize("k", [1, 7, 100])
def test_clusters_by_brute_force(spark, k):
    r = random.Random(k)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25)) if i % 3 else r.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    rows += [(100 + i, rows[1][1]) for i in range(20)] + [rows[2], (None, rows[4][1])]
    rows += [(200, None), (201, [1.0] * 63), (202, [None, *[1.0] * 63]), (203, [float("nan"), *[1.0] * 63]), (204, [float("-inf"), *[1.0] * 63]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("cluster", "x", "distance", "n")})
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, centroids.cluster(df, k, 3).collect()), key=str) == plain_clusters(rows, k, 3)


def test_no_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema))


@pytest.mark.parametrize("scale", [3, 1 << 27])
def test_tree_search_is_exact_with_ties(scale):
    """Points of a small grid have many equal distances; the large scale takes the way without floating products."""
    r = np.random.default_rng(scale)
    for k in (1, 2, 5, 40, 200):
        points, vectors = (r.integers(-2, 3, (n, 6)) * scale for n in (k, 500))
        away = ((vectors[:, None] - points[None]) ** 2).sum(2)
        number, distance = centroids.VantageTree(points).nearest(vectors)
        assert (number == away.argmin(1)).all() and (distance == away.min(1)).all()


# Phrases


def plain_phrases(rows, longest, least, most):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        pieces = [[]]
        word = ""
        for c in (text or "") + "\n":
            c = c.lower() if c.isascii() else c
            if c in ".,;:!?\n\v\f\r\t ":
                if word:
                    pieces[-1].append(word)
                word = ""
                if c not in "\t ":
                    pieces.append([])
            else:
                word += c
        for p in pieces:
            n[lang] += len(p)
            for m in range(1, longest + 1):
                for i in range(len(p) - m + 1):
                    f[lang, tuple(p[i : i + m])] += 1
    f = {x: c for x, c in f.items() if c >= least}
    surrounded = set()
    for (lang, g), c in f.items():
        for m in range(1, len(g)):
            for i in range(len(g) - m + 1):
                if 100 * c >= 100 * f[lang, g[i : i + m]]:
                    surrounded.add((lang, g[i : i + m]))
    out = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and (lang, g) not in surrounded:
            cuts = [(math.floor(Fraction(1000 * a * n[lang], f[lang, g[:k]] * f[lang, g[k:]])), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most], 1))


def made_texts(seed, n=400):
    r = random.Random(seed)
    words = ["a", "b", "C", "the", "Été", "x-y", "日本", "…", "z", "\x00"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n", "\v"]
    return [(i % 50, "".join(r.choice(words[: 2 + i % 9]) + r.choice(ends) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"])) for i in range(n)]


@pytest.mark.parametrize(("block_words", "trie_size"), [(1_000_000, 250_000), (4, 30), (1, 1_000)])
def test_phrases_by_brute_force(spark, monkeypatch, block_words, trie_size):
    monkeypatch.setattr(phrases, "POSITIONS", 500)
    monkeypatch.setattr(phrases, "TALLIES", 50)
    rows = made_texts(3) + ODD
    found = phrases.collocations(docs_of(spark, rows).repartition(3), 5, 20, 25, block_words=block_words, trie_size=trie_size)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 5, 20, 25)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).collect() == []
    assert phrases.collocations(docs_of(spark, [(1, "a b c", "en"), (2, None, None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 * a * n is some 6e19 here."""
    rows = [(1, "a b " * 120_000 + "c " * 100, "en")] * 1
    rows = rows * 2
    assert sorted(map(tuple, phrases.collocations(docs_of(spark, rows)).collect())) == plain_phrases(rows, 5, 100, 2_000)
    big = spark.sql("SELECT (CAST(1000 AS DECIMAL(38,0)) * CAST(9000000000000 AS DECIMAL(38,0)) * CAST(10000000000000 AS DECIMAL(38,0))) div (CAST(9000000000001 AS DECIMAL(38,0)) * CAST(9500000000000 AS DECIMAL(38,0))) AS x")
    assert big.first()[0] == 1000 * 9000000000000 * 10000000000000 // (9000000000001 * 9500000000000)


def test_double_array_accepts_its_phrases_only():
    r = np.random.default_rng(1)
    for length, words, n in ((1, 30, 20), (2, 8, 40), (3, 300, 20_000), (5, 3, 100)):
        own = np.unique(r.integers(1, words + 1, (n, length)).astype(np.int32) * 7, axis=0)
        trie = phrases.DoubleArray(own)
        codes = np.append(r.integers(0, words + 1, 30_000) * 7, np.zeros(length + 1, int)).astype(np.int32)
        at, phrase = trie.accepted(codes)
        known = {tuple(p): i for i, p in enumerate(trie.phrases.tolist())}
        want = [(i, known[w]) for i in range(30_000) if (w := tuple(codes[i : i + length].tolist())) in known]
        assert list(zip(at.tolist(), phrase.tolist(), strict=True)) == want


def test_tables_that_grow_with_the_corpus_are_not_broadcast(spark):
    """Their files are small beside their rows, of which join_salted makes copies."""
    rows = spark.createDataFrame([(i % 7, f"x{i}") for i in range(50)], "k int, x string")
    small = written(spark.range(7).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v")), "small")
    for how in ("inner", "left"):
        joined = join_salted(rows, small, "k", "x", how)
        assert sorted(map(tuple, joined.collect())) == sorted((i % 7, f"x{i}", i % 7 * 2) for i in range(50))
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    found = phrases.collocations(docs_of(spark, made_texts(3)), 5, 20, 25)
    assert found.collect() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_states_of_a_trie_find_their_places_together(monkeypatch):
    """Looked for one by one from the beginning, places took time that grew with the square of the phrases."""
    fitted, fit = [], phrases.DoubleArray.fit
    monkeypatch.setattr(phrases.DoubleArray, "fit", lambda self, symbols, *x: fitted.append(len(symbols)) or fit(self, symbols, *x))
    r = np.random.default_rng(5)
    own = np.unique((r.random((30_000, 3)) ** 3 * 2_000).astype(np.int32) + 1, axis=0)
    trie = phrases.DoubleArray(own)
    assert fitted and min(fitted) > 16
    at, phrase = trie.accepted(np.append(own.reshape(-1), np.zeros(4)).astype(np.int32))
    found = dict(zip(at.tolist(), phrase.tolist(), strict=True))
    assert (trie.phrases[[found[3 * i] for i in range(len(own))]] == own).all()


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def said(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op13_query_is_the_library(spark, library):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_sentence_piece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert rows == {i: said(library, t) for i, t in texts.items()}


@pytest.mark.parametrize("table", [0, 5, 200_000])
def test_pieces_of_odd_rows(spark, library, monkeypatch, table):
    monkeypatch.setattr(sentence_piece, "BLOCK", 2_000)
    r = random.Random(2)
    bits = ["▁", " ", "  ", "a", "the ", "é", "日本", "\n", "<s>", "xyz" * 10, "\x00", "😀", "<0x41>", "ſ", " " * 40, "́"]
    rows = ODD + [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 12))), "en") for i in range(2_000)]
    rows.append((5, "".join(r.choice("ab c") for _ in range(200_000)), "en"))
    found = sentence_piece.encode(docs_of(spark, rows), queries.PIECES, table=table)
    got = found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(((i, *said(library, t)) for i, t, _ in rows), key=str)
    assert all(hashlib.sha256(np.array(x["ids"], "<u4").tobytes()).hexdigest() == x["ids_sha256"] for x in got)
    assert sentence_piece.encode(docs_of(spark, []), queries.PIECES).collect() == []


def test_decoding_of_any_ids_is_the_library(library):
    model = sentence_piece.Model(open(queries.PIECES, "rb").read())
    r = random.Random(4)
    for _ in range(5_000):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), 28705, 259, r.randrange(259, 32000)]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_a_text_as_one_chunk_has_the_same_ids(library):
    """What a model with crossing pieces would need; with this one it is only slower."""
    model = sentence_piece.Model(open(queries.PIECES, "rb").read())
    assert not model.crossing
    for t in ("a b  c", "", " the end ", "x"):
        chunks = sentence_piece.Chunks.split(t, True)
        assert len(chunks) == bool(t) and [1, *(i for c in chunks for i in model.segment("▁" + c)), 2] == library.encode(t, add_bos=True, add_eos=True)
