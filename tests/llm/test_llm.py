"""The training-data operators against plain Python versions, on the driver's tables and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import bpe, decontaminate, html_text, licenses, ngram_join, pii, quality, queries, secret_scan, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "word", None, None, 4), (3, "word", None, None, 4), (4, "x " * 30_000, "en", "a", 60_000), (None, "some text without an id at all here", "en", "a", 3), (6, " \n\t ", "en", "a", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1))


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(*columns).collect()), key=str) == sorted(b.select(*columns).fetchall(), key=str)


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans(spark, texts):
    r = random.Random(5)
    made = ["".join(r.choice("ab.@-+ 0149()é:") for _ in range(60)) for _ in range(3000)]
    for text in [*texts.values(), *made, "1.2.3.4.5.6.7.8", "a@b.c@d.e", "x@y", "+1 (2", "4111 1111-1111 1111"]:
        assert pii.plain_spans(text) == plain_pii(text), text
    rows = {r["doc_id"]: r for r in queries.op2_pii(spark, SF).collect()}
    for i, text in texts.items():
        spans = plain_pii(text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(filter(None, rows[i]["spans"].split(",")))
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert rows[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.all_spans(text)[1])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("a [at] b [dot] org", "email", "a [at] b [dot] org"),
        ("call plus one five five five one two three four five six seven eight", "phone", "plus one five five five one two three four five six seven eight"),
        ("is ４１１１ 1111 1111 1111 ok", "card", "４１１１ 1111 1111 1111"),
        ("at one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("ana (arroba) casa (punto) es", "email", "ana (arroba) casa (punto) es"),
        ("card ④①①① ¹¹¹¹ ११११ 1111.", "card", "④①①① ¹¹¹¹ ११११ 1111"),
    ],
)
def test_pii_disguises(text, kind, found):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.all_spans(text)[1] if text[a:b] == found] == [(kind, found)]


@pytest.mark.parametrize("text", ["0" * 5000 + "1.2.3.4", "7" * 1_000_000, "one " * 250_000, "dot" + " " * 1_000_000 + "x", "[ " * 500_000, "a@" * 500_000, "1." * 500_000, "+1((" * 250_000, "x at " * 200_000])
def test_pii_of_a_long_odd_text_takes_no_time(text):
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 10


def test_plain_prose_has_no_pii():
    for text in ("look at example.com and dot it", "one two three at the dot", "Ein Satz über nichts."):
        assert pii.all_spans(text)[1] == []


def test_bpe_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()), public_tokenizers.PATTERN), Tokenizer.from_file(path)
    r = random.Random(1)
    bits = ["a" * 50, "ab", "\n", "  ", " ", "<|endoftext|>", "<|endof", "é", "日本", "'re", "\r\n", "xyz" * 40, "1234", "\x1c", "　", "²"]
    made = ["".join(r.choice(bits) for _ in range(20)) for _ in range(300)]
    for part in (made, list(texts.values())):
        for text, data in zip(part, own.encode(part), strict=True):
            ids = lib.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(data, "<u4").tolist() == ids
            assert own.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_op9_query_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.VOCABULARY)
    lib.no_truncation(), lib.no_padding()
    rows = {r["doc_id"]: r for r in queries.op9_bpe(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_query_is_noisy_or_by_plain_python(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(spark, SF, docs)
    rows = {r["doc_id"]: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        none = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            words = {w for w in re.findall(r"[^\W\d_]+", sentence)}
            # Each distinct word brings its features, as the scorer has it.
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
            none *= 1 - 1 / (1 + np.exp(-np.clip(z, -50, 50))) if sentence or not text else 1.0
        assert rows[i]["score"] == pytest.approx(1 - none, abs=1e-6)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3)


def test_op6_query_adds_up_tables_by_plain_python(spark, texts):
    from bisect import bisect_right

    from riskframe.llm.tables import labelled

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = quality.fit(docs, labelled(spark.read.parquet(f"{SF}/labels.parquet"), "quality", 5, 0, queries.MOST_LABELS))
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        x = quality.features(text or "")
        z = m.intercept + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(m.edges, m.tables, x, strict=True))
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            z += t[bisect_right(m.pair_edges[a].tolist(), x[a]), bisect_right(m.pair_edges[b].tolist(), x[b])]
        assert rows[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and rows[i]["predicted"] == int(rows[i]["score"] >= 0.3)


class PlainPage(HTMLParser):
    """Words outside the elements that are never shown; no layout."""

    GONE = ("head", "script", "style", "template", "noscript", "iframe", "object", "audio", "video", "canvas")
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag == "img" and d.get("alt") and not any(g for _, g in self.open):
            self.words += d["alt"].split()
        if tag not in self.VOID:
            style = (d.get("style") or "").replace(" ", "").lower()
            self.open.append((tag, tag in self.GONE or "hidden" in d or "display:none" in style or "visibility:hidden" in style))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(g for _, g in self.open):
            self.words += data.split()


def test_op5_query_has_the_words_of_a_plain_parser(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r["page_id"]: r["text"] for r in queries.op5_html_text(spark, SF).collect()}
    assert set(rows) == set(pages)
    for i, page in pages.items():
        plain = PlainPage()
        plain.feed(page or "")
        plain.close()
        marks = lambda words: [w for w in words if w not in ("-", "---") and not re.fullmatch(r"\d+\.", w)]
        # Layout breaks lines inside words of the source never, so the words are the same in the same order.
        assert "".join(marks(rows[i].split())) == "".join(marks(plain.words))


def test_bpe_tree_and_forest_agree():
    v = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    words = [b"a", b"the", b"aaaaaaa", b"interesting", b"x" * 64, bytes(range(40))]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Forest(v).encode(words)] == [v.encode_word(w) for w in words]


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op4_secrets(spark, SF).collect()}
    for i, text in texts.items():
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in plain_secrets(text))
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in secret_scan.KINDS] == [sum(s[1] == k for s in plain_secrets(text)) for k in range(3)]
        assert set(filter(None, said.split(","))) <= set(filter(None, rows[i]["spans"].split(",")))


def test_automaton_prefers_its_format():
    r = random.Random(2)
    keys = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(200)]
    a = secret_scan.Automaton(keys)
    assert len(a.to) < 200 * 20
    assert a.score("AKIA" + "Q7" * 8) > a.score("interestingly-not-a-key") + 1


def test_secrets_short_dotted_and_of_letters(spark):
    r = random.Random(4)

    def some(n, chars):
        return "".join(r.choice(chars) for _ in range(n))

    words = [some(r.randrange(3, 14), "aeinorstlmdgh") for _ in range(3000)]
    made = (lambda: some(9, "0123456789"), lambda: f"{some(3, '0123456789')}.{some(4, 'ABCDEFGH')}.{some(4, '0123456789')}", lambda: some(12, "QZXKWVJPTRMN"))
    rows = [(i, " ".join(r.choices(words, k=40)) + f" token = {made[i % 3]()}" + " ".join(r.choices(words, k=9)) + ".") for i in range(600)]
    bare = {1000 + k: f() for k, f in enumerate(made)}
    rows += [(i, f"we saw {key}. then {r.choice(words)}") for i, key in bare.items()]
    out = {x["doc_id"]: x["spans"] for x in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: out[i] for i in bare} == {i: f"assign:7:{7 + len(key)}" for i, key in bare.items()}
    assert sum("," in out[i] for i in range(600)) < 6  # ordinary words are none


def test_secret_automata_learn_from_all_matches_uncut(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(secret_scan, "Automaton", lambda strings: learned.append(strings))
    keys = [f"{i}" * (8 if i > 1 else 300) for i in range(1, 60)]
    text = " ".join(f"token={k}" for k in keys) + " " + " ".join("some-word-" + "x" * i for i in range(250))
    secret_scan.infer(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert set(keys) <= set(learned[0]) and len(learned[-1]) == 250


def test_classifiers_hold_out(spark):
    for f, n, held, label in ((queries.op1_toxicity, 4, 2, "toxic"), (queries.op6_quality, 5, 0, "quality")):
        rows = f(spark, "/root/testdata/sf0.01").collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == held) for r in rows)
        truth = dict(duckdb.sql(f"select doc_id, {label} from '/root/testdata/sf0.01/labels.parquet'").fetchall())
        right = [truth[r["doc_id"]] == r["predicted"] for r in rows if r["held_out"] and r["doc_id"] in truth]
        assert np.mean(right) > 0.85


def test_offending_sentence():
    s = toxicity.Scorer(toxicity.Model({"idiot": 14.0}, -9.0))
    score, found = s.sentences("All is well. You idiot! Fine.")
    assert score > 0.9 and [(x["start"], x["end"]) for x in found] == [(12, 22)]


def test_quality_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y, rounds=20)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("way", ["groups of a task", "stars over tasks", "hot signatures"])
def test_ngram_join_by_brute_force(spark, monkeypatch, way):
    if way == "stars over tasks":
        monkeypatch.setattr(ngram_join, "STAR_SETS", 2)
    if way == "hot signatures":
        monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for base in range(40):
        text = [r.choice(words) for _ in range(r.choice([4, 6, 9, 20, 60, 150]))]
        for copy in range(r.choice([1, 1, 3, 12])):
            own = list(text)
            for _ in range(copy % 5):
                own[r.randrange(len(own))] = r.choice(words)
            docs.append((len(docs), " ".join(own) + (" " if copy % 2 else "\t")))
    shared = " ".join(r.choice(words) for _ in range(40))
    docs += [(len(docs) + i, shared + " " + " ".join(r.choice(words) for _ in range(r.choice([10, 40])))) for i in range(60)]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in docs]
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    rows = {x["doc_id"]: x for x in ngram_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [rows[i]["component_id"] for i in range(len(docs))] == comp
    assert [rows[i]["n_shingles"] for i in range(len(docs))] == list(map(len, sets))


def test_similar_sets_share_a_signature():
    """Also at the limit, in small sets and over the edge of a band of sizes; common shingles change nothing of it."""
    r = np.random.default_rng(3)
    for n in (*range(2, 40), 63, 64, 120, 127, 128, 250, 255, 400, 511):
        for _ in range(12):
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            gone = int(r.integers(0, n // 9 + 1))
            added = (n - gone) * 100 // 80 - n if gone < n // 9 else n // 9
            added = max(0, min(added, (100 * (n - gone) - 80 * n) // 80))
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**64, added, np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            if len(b) == n and not gone:
                continue
            common = np.sort(r.choice(a, n // 3, replace=False))
            assert len(np.intersect1d(ngram_join.signatures(a, 80, common), ngram_join.signatures(b, 80, common)))


def test_decontamination_without_the_set_is_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, decontaminate.scan(docs, bench, most).collect())) for most in (100_000, 10))
    assert a == b


def test_short_items_and_union_of_hits(spark):
    docs = spark.createDataFrame([(1, "Alpha beta GAMMA delta"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "beta gamma"), (8, "gamma, delta"), (9, None), (9, "!!")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.scan(docs, bench).collect()}
    assert (rows[1]["n_words"], rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (4, 3, 2, True)
    assert rows[1]["items_sha256"] == hashlib.sha256(b"7,8").hexdigest()
    assert not rows[2]["contaminated"] and rows[3]["n_words"] == 0


def test_topk_ties_bad_vectors_and_blocks(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=4).round(1)]) for i in range(300)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 500)]
    rows += [(500, None), (600, [1.0, None, 1.0, 1.0]), (700, [float("nan")] * 4), (800, [float("inf"), 0.0, 0.0, 0.0])]
    good = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i < 500]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if i < 500]
    want = set()
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:10]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for block in (2048, 2):
        assert {tuple(x) for x in topk.search(df, F.col("vec_id") % 100 == 0, block=block).collect()} == want


def test_html_layout():
    page = "<head><title>no</title></head><p>One<p>two <b>bold</b><br>three<ul><li>a<li>b<ol start=3><li>c</ol></ul><script>x='</p>'</script><div style='display: none'>no<p>no</div><table><tr><th>k<th>value<tr><td>long key<td>1</table><pre> a\n  b</pre>&amp; <span hidden>no</span>end"
    assert html_text.visible_text(page) == "One\n\ntwo bold\nthree\n\n- a\n- b\n  3. c\n\nk         value\nlong key  1\n\n a\n  b\n\n& end"
    assert html_text.visible_text("") == "" and html_text.visible_text("a < b") == "a < b"
    assert html_text.visible_text("<div>" * 5000 + "deep") == "deep"


def test_html_text_of_a_table_outside_its_cells():
    assert html_text.visible_text("<table><caption>Sales</caption><tr><td>1</table>") == "Sales\n\n1"
    assert html_text.visible_text("<table>a<tr>b<td>1</td>c<td>2<tr>d<td><table><caption>In</caption><td>3</table></table>end") == "abc\nd\n\n1   2\nIn\n\n3\n\nend"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>text", "text"),
        ("<html><head><title>T</title><meta charset=x><noscript><p>no</noscript>bare <b>text</b>", "bare text"),
        ("<head><title>T</title></head><body>text", "text"),
        ("<head><title>T</title><body>text", "text"),
        ("a <textarea rows=2>\nx &amp; y\n  <b>z</textarea> b", "a\nx & y\n  <b>z\nb"),
        ("<form><select><optgroup label=Fruit><option>Apple<option selected>Pear</select></form>", "Fruit\nApple\nPear"),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds.", "So x=1 holds."),
        ("a<svg><title>no</title><title/><defs><text>no</text></defs><g>no<text x=1>Label <tspan>one</tspan></text><path d='M0'/><text>two</text></g></svg>b", "a\nLabel one\ntwo\nb"),
        ("<svg><foreignObject><p>in HTML</p></foreignObject><path d='M0'><p>after", "in HTML\n\nafter"),
        ("<svg hidden><text>no</text></svg><textarea hidden>no</textarea>yes", "yes"),
    ],
)
def test_html_shows_all_that_is_visible(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.h{display:none} p#x , b.y {visibility:hidden}</style><div class='a h'>no</div><p id=x>no<b style='visibility:visible'>yes</b></p><b class=y>no</b><b>and</b>", "yes\n\nand"),
        ("<style>/* .a{display:none} */@media print{.b{display:none}}</style><i class=a>a</i> <i class=b>b</i>", "a b"),
        ("<ol start='--5'><li>a</ol><ol start=-2><li>b<li>c</ol>", "1. a\n\n-2. b\n-1. c"),
        (f"<ol start={'9' * 5000}><li>a</ol>", "1. a"),
        (f"a&#{'9' * 5000};b &#{'0' * 5000}65; &#x{'0' * 5000}41;", "a\ufffdb A A"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        (f"<table><tr><td>{'w' * 90}<td>x<tr><td>1<td>2</table>", f"{'w' * 90}  x\n1  2"),
        ("a <b title=\"1 > 0\">b</b> c", "a b c"),
        ("a <b title=\"1 > b</b> c", "a b c"),
    ],
)
def test_html_rules_of_visibility_and_tables(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "<a \"" * 200_000, "<b>" * 100_000 + "<p>x</i>" * 50_000, "<li>" * 200_000, "<table><tr>" + "<td>x<tr>" * 100_000, "<style>" + "/*{" * 200_000, "<svg>" * 100_000 + "x<g>" * 50_000]
    + ["<a><div>" + "<b>" * 50_000 + "</a>" * 100_000, "<table>" + "<tr><td>" + "w " * 20_000 + "<tr><td>x<td>y" * 50_000, "&#" * 300_000, "<td rowspan=9999 colspan=1000>x" * 1_000],
)
def test_html_of_a_long_odd_page_takes_no_time(page):
    began = time.process_time()
    text = html_text.visible_text(page)
    assert time.process_time() - began < 10
    assert len(text) < 100 * len(page)


@pytest.mark.parametrize(
    "page",
    ["<ul>" * 5_000 + "<li>x" * 200_000, "<dl><dd>" * 20_000 + "<br>x" * 100_000, "<table><tr>" + f"<td rowspan=9999>{'w' * 80}" * 1_000 + "<tr><td>x" * 100_000]
    + ["<table><tr><td>x<td>" * 3_000 + "<br>y" * 100_000, ("<table><tr><td>" + "<ul>" * 40 + "<li>z") * 300 + "<br>y" * 100_000, "<ol><li>" * 30_000],
)
def test_html_text_stays_in_proportion_to_the_page(page):
    began = time.process_time()
    text = html_text.visible_text(page)
    assert len(text) < 300 * len(page) and text.count("y") == page.count("y")
    assert time.process_time() - began < 20


def test_html_displays_what_is_last_said():
    page = '<p style="display:none; display:block">a</p><p style="display:block;display:NONE">b</p><dialog>c</dialog><dialog open>d</dialog><p style="my-display:none">e</p>'
    assert html_text.visible_text(page).split() == ["a", "d", "e"]


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0"), (2, "a/b/c/x.txt", "plain text"), (3, "a/b/LICENSE", "Released under the MIT License."), (4, "a/y.txt", "words\nLicensed under CC BY-NC 4.0.\n" + "more words " * 50), (5, "z/x.txt", "plain"), (6, None, None)]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [out[i]["effective_license"] for i in range(1, 7)] == ["Apache-2.0", "MIT", "MIT", "CC-BY-NC-4.0", None, None]
    assert out[2]["inherited_from"] == "a/b" and out[1]["is_license_file"] and not out[4]["is_license_file"]


def license_rows(spark, rows):
    return {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}


def test_license_headers_do_not_depend_on_row_count_or_neighbours(spark):
    lines = {1: ("MIT", "Released under the MIT License, see the LICENSE file for details."), 2: ("MIT", "This project is released under the MIT License."), 3: ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), 4: ("Proprietary", "Copyright 2020 Some Name, Some Town. All rights reserved.")}
    for n in (0, 20_000):
        rows = [(i, None, f"some prose\n{line}\n" + "other words here " * 20) for i, (_, line) in lines.items()]
        rows += [(i, None, f"text {i}\nLicensed under terms {i} of seller {i}") for i in range(10, 10 + n // 100)] + [(i, None, "plain") for i in range(1000, 1000 + n)]
        out = license_rows(spark, rows)
        assert {i: out[i]["license"] for i in lines} == {i: name for i, (name, _) in lines.items()}
        assert not any(r["license"] for i, r in out.items() if i >= 10)


def test_license_weights_are_the_whole_tables(spark, monkeypatch):
    """Terms whose counts are joined weigh the same as those that every task has."""
    rows = [(i, f"d{i}/x", f"words {i} here\nReleased under {'very ' * (i % 3)}the {'new' * (i % 2)} MIT License{i % 5} {i}") for i in range(60)]
    rows += [(99, "m/LICENSE", "Copyright (c) 2021 Me\n\n" + dict(licenses.full_texts())["MIT"] + "\nextra words at the end")]
    a = license_rows(spark, rows)
    monkeypatch.setattr(licenses, "FREQUENT", 1)
    b = license_rows(spark, rows)
    assert {i: (r["license"], round(r["cosine"], 9), r["is_license_file"]) for i, r in a.items()} == {i: (r["license"], round(r["cosine"], 9), r["is_license_file"]) for i, r in b.items()}
    assert len({r["license"] for r in a.values()}) > 1


def test_full_license_texts_license_their_directory(spark):
    import textwrap

    texts = dict(licenses.full_texts())
    rows, want = [], {}
    for i, (name, text) in enumerate(sorted(texts.items())):
        wrapped = "\n\n".join(textwrap.fill(p, 70) for p in text.split("\n\n"))
        rows += [(2 * i, f"{name}/LICENSE", f"Copyright (c) 2024 Jane Roe\n\n{wrapped}"), (2 * i + 1, f"{name}/src/x.txt", "plain text")]
        want |= {2 * i: name, 2 * i + 1: name}
    rows.append((1000, "prose/a.txt", texts["MIT"] + " ".join(f"story{i} goes on" for i in range(900))))
    out = license_rows(spark, rows)
    assert {i: out[i]["effective_license"] for i in want} == want
    assert all(out[2 * i]["is_license_file"] for i in range(len(texts))) and not out[1000]["is_license_file"]


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    yield toxicity.score(docs, toxicity.Model({"x": 1.0}, -5.0))
    yield pii.find(docs)
    yield decontaminate.scan(docs, bench)
    yield secret_scan.find(docs)
    yield quality.score(docs, quality.train(np.empty((0, 15)), np.empty(0)))
    yield ngram_join.components(docs)
    yield bpe.encode(docs, queries.VOCABULARY, public_tokenizers.PATTERN)
    yield licenses.scan_licenses(docs.withColumn("path", F.col("source")))
    yield pii.redact(docs)


def test_odd_rows_and_clashing_columns(spark, odd):
    for df in operators(spark, odd):
        assert len(df.collect()) == len(ODD)


def test_empty_tables(spark, odd):
    for df in operators(spark, odd.limit(0)):
        assert df.collect() == []
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def plain_groups(rows):
    """Of each row with an id and words: the place of the first row (by id, then text hash) that links reach."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    having = {}
    for k, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in having[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    return [find(k) if s else None for k, s in enumerate(sets)]


def plain_contaminated(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = {tuple(w[i : i + 13]) for t in items if (w := words(t)) for i in range(max(1, len(w) - 12))}
    w = words(text)
    hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() as a whole, over the driver's table and rows with null and repeated ids, repeated texts and clashing columns."""
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = max(items, key=lambda t: len(t.split()))
    prose = " ".join(f"word{i}" for i in range(40))
    more = [(None, leak), (None, "clean words that nobody else has written down"), (7, leak), (7, prose), (7, prose), (7, prose + " more"), (5000, prose + " end"), (5001, ""), (5002, None), (5003, " "), (5003, " ")]
    more += [(5004, "write to jane.roe@example.org or call +1 555 123 4567 today please")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for c, other in (("lang", "en"), ("source", "s"), ("n_chars", 1), ("score", "x"), ("node", "y"), ("text_hash", "z"), ("n", 0), ("first", 0), ("offending", 0)):
        rows = rows.withColumn(c, F.lit(other))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = queries.toxicity_model(spark, str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"))

    def toxic(text):
        """By the definition of noisy-or, sentence by sentence."""
        none = 1.0
        for features in toxicity.sentence_features(text or ""):
            none *= 1 - 1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights.get(f, 0.0) for f in features), -50, 50)))
        return 1 - none >= 0.3

    left = [(r["doc_id"], r["text"]) for r in rows.collect()]
    left = sorted((r for r in left if not toxic(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = plain_groups(left)
    # Of a group one row stays: with its smallest id, whichever text of that id.
    least = {g: min(left[k][0] for k in range(len(left)) if groups[k] == g) for g in set(groups) - {None}}
    tokenizer = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    tokenizer.no_truncation(), tokenizer.no_padding()

    def end(row):
        text = pii.redacted_text(row[1]) if row[1] else ""
        assert not plain_pii(text)
        return row[0], hashlib.sha256(np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()

    want = sorted((end(r) for r, g in zip(left, groups, strict=True) if g is None and not plain_contaminated(r[1], items)), key=str)
    choices = {}
    for r, g in zip(left, groups, strict=True):
        if g is not None and r[0] == least[g]:
            choices.setdefault(g, set()).add(r)
    got = sorted(((r["doc_id"], r["ids_sha256"]) for r in out), key=str)
    for options in choices.values():
        hits = [x for r in options if not plain_contaminated(r[1], items) and (x := end(r)) in got]
        clean = [r for r in options if not plain_contaminated(r[1], items)]
        assert len(hits) == 1 or len(clean) < len(options) and not hits
        for x in hits:
            want.append(x)
    assert sorted(want, key=str) == got


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
