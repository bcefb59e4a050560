"""Secret automata on planted credentials without a label: formats, lengths and look-alikes."""

import random
import string
import uuid

import pytest

from riskframe.llm import secret_scan

HEX, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits


def some(r, n, chars):
    return "".join(r.choice(chars) for _ in range(n))


FORMATS = {
    "prefix": lambda r: "ghp_" + some(r, 36, ALNUM),
    "dashes": lambda r: "-".join(["key", *(some(r, 4, string.ascii_uppercase + string.digits) for _ in range(4))]),
    "hex": lambda r: some(r, 40, HEX),
    "base64": lambda r: some(r, 43, ALNUM + "+/") + "=",
}
LOOK_ALIKES = {
    "uuid": lambda r: str(uuid.UUID(int=r.getrandbits(128))),
    "short hex": lambda r: some(r, 24, HEX),
    "path": lambda r: "/".join(some(r, r.randrange(3, 9), "aeinorstlmd") for _ in range(4)),
    "class name": lambda r: "".join(some(r, r.randrange(3, 8), "aeinorstlmd").capitalize() for _ in range(4)),
    "date": lambda r: f"20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}",
}


@pytest.fixture(scope="module")
def found(spark):
    """Planted tokens, the spans of their texts, and the number of spans that the method adds to labelled texts."""
    r = random.Random(8)
    words = [some(r, r.randrange(3, 14), "aeinorstlmdgh") for _ in range(8000)]
    rows = []
    for i in range(800):
        prose = r.choices(words, k=40)
        prose[7] = r.choice(list(LOOK_ALIKES.values()))(r)
        rows.append((i, " ".join(prose) + f" secret = {r.choice(list(FORMATS.values()))(r)} " + " ".join(r.choices(words, k=9))))
    planted = [(name, f(r)) for name, f in {**FORMATS, **LOOK_ALIKES}.items() for _ in range(15)]
    rows += [(1000 + i, f"we saw {token} {' '.join(r.choices(words, k=30))}") for i, (_, token) in enumerate(planted)]
    out = secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=800).collect()
    more = sum(len(x["spans"].split(",")) - x["n_assign"] - x["n_access"] - x["n_hex"] for x in out if x["doc_id"] < 800)
    return planted, {x["doc_id"]: x["spans"] for x in out}, more


@pytest.mark.parametrize("name", FORMATS)
def test_unlabelled_credentials_are_found(found, name):
    planted, spans, _ = found
    whole = [any(s.split(":")[1:] == ["7", str(7 + len(token))] for s in spans[1000 + i].split(",")) for i, (n, token) in enumerate(planted) if n == name]
    assert sum(whole) >= 0.9 * len(whole)


def test_look_alikes_and_words_are_not(found):
    planted, spans, more = found
    added = [n for i, (n, _) in enumerate(planted) if n in LOOK_ALIKES and spans[1000 + i]]
    right = sum(bool(spans[1000 + i]) for i, (n, _) in enumerate(planted) if n in FORMATS)
    assert right / (right + len(added)) >= 0.9, added
    assert more <= 8


def test_states_keep_prefix_and_length():
    r = random.Random(5)
    a = secret_scan.Automaton([FORMATS["prefix"](r) for _ in range(300)])
    assert len(a.to) >= 41
    token = FORMATS["prefix"](r)
    assert a.score(token) > a.score("xyz_" + token[4:]) and a.score(token) > a.score(token[:30]) and a.score(token) > a.score(token + token)


def test_states_beyond_the_levels_lead_to_themselves():
    a = secret_scan.Automaton(["ab" * 5000, "abc" * 400, "q" * 100_000])
    assert len(a.to) <= 3 * (secret_scan.LEVELS + 1) + 1
    assert a.score("ab" * 6000) > a.score("zz" * 6000)


def test_without_credentials_or_ordinary_tokens(spark):
    for text in ("", None, "few words", "token=abcdefgh12345678"):
        (row,) = secret_scan.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert row["spans"] == ("assign:0:22" if text and "=" in text else "")
