import random
import re

import pytest

from quarry.llm import license_scan as S

SCHEMA = "doc_id long, text string, labels int, score string"


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in S.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["MIT", "License", "apache", "GENERAL", "public", "license", "the", "é", "x1", "mit", "\n", "2.0", "-", "under", "GNU"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(None, None), (1, ""), (2, "mit license mit license"), (2, "MIT-License.Apache   LICENSE general public licensé license"), (3, "K mit license ſ")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = S.scan_licenses(df).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    assert S.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("label,text", S.NOTICES)
def test_notices_are_found_whole_and_edited(label, text):
    s = S.Scanner()
    before, after = ["the", "zzz"] * 5, ["of", "qqq"] * 4
    words = [w.encode() for w in [*before, *text.split(), *after]]
    found = s.scan(words)
    assert label in found["labels"].split(",")
    assert any(x == label and a == len(before) and z == len(before) + len(text.split()) for x, a, z in found["spans"])
    if len(text.split()) >= 16:
        w = text.split()
        w[8:8] = ["inserted"]
        assert label in s.scan([x.encode() for x in [*before, *w, *after]])["labels"].split(",")


def test_clean_text_has_no_label():
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in S.NOTICES for w in t.split()})
    for _ in range(50):
        assert not S.Scanner().scan([rng.choice(vocabulary).encode() for _ in range(200)])["spans"]
    assert S.Scanner().scan([])["score"] == 0.0


@pytest.mark.parametrize("label,text", S.TEXTS)
def test_texts_are_found_whole_in_part_and_edited(label, text):
    s, words = S.Scanner(), S.words_of(text)
    around = [f"q{k}".encode() for k in range(9)]
    got = s.scan([*around, *words, *around])
    assert label in got["labels"].split(",") and got["score"] == 1.0
    assert any(x == label and a == 9 and z == 9 + len(words) for x, a, z in got["spans"])
    edited = [w for k, w in enumerate(words) if k % 13 != 12]
    assert label in s.scan([*around, *edited, *around])["labels"].split(",")
    if len(words) > 300:  # the later body alone
        assert label in s.scan([*around, *words[len(words) // 2 :], *around])["labels"].split(",")


def test_conditions_without_the_grant_are_found():
    """A disclaimer alone names its licence, and the licence with more of the words keeps a shared place."""
    s = S.Scanner()
    tail = lambda t, since: s.scan(S.words_of(t[t.index(since) :]))["labels"].split(",")
    assert tail(S.license_texts.BSD, "THIS SOFTWARE IS PROVIDED") == ["bsd"]
    assert tail(S.license_texts.ISC, "IN NO EVENT") == ["isc"]
    assert tail(S.license_texts.APACHE, "7. Disclaimer") == ["apache"]
    assert tail(S.license_texts.GPL_NOTICE, "This program is distributed") == ["gpl"]
    assert "mit" in tail(S.license_texts.MIT, "THE SOFTWARE IS PROVIDED")


def plain_matches(s, ids, texts):
    """Maximal diagonal matches by comparing every pair of places."""
    out = {}
    for k, t in enumerate(texts):
        for shift in range(-len(t) + 1, len(ids)):
            start = None
            for i in range(max(0, shift), min(len(ids), shift + len(t)) + 1):
                same = i < len(ids) and i - shift < len(t) and ids[i] and ids[i] == t[i - shift]
                if same and start is None:
                    start = i
                if not same and start is not None:
                    if i - start >= s.min_words:
                        out.setdefault(k, set()).add((start, start - shift, i - start))
                    start = None
    return out


def test_matches_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        words = "a b c d e".split()
        texts = [("x", " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for _ in range(4)]
        s = S.Scanner(notices=texts, texts=[], phrases={})
        ids = [s.ids.get(rng.choice([*words, "z"]).encode(), 0) for _ in range(60)]
        got: dict = {}
        for a, z in S._runs(ids):
            for k, p in s.matches(ids, a, z).items():
                got.setdefault(k, set()).update(p)
        assert got == plain_matches(s, ids, [[s.ids[w.encode()] for w in t.split()] for _, t in texts])


def test_long_and_repetitive_texts(spark):
    """Work stays in proportion to the text, and extra columns don't matter."""
    rows = [(1, S.license_texts.MIT * 400), (2, "of the software " * 40_000), (3, "plain words " * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).withColumns({c: S.F.lit("z") for c in ("spans", "n_words", "base_labels")})
    got = {r.doc_id: r for r in S.scan_licenses(df).collect()}
    assert "mit" in got[1].labels and len([x for x in got[1].spans if x.label == "mit" and x.end - x.start > 100]) >= 400
    assert got[2].labels == "" and got[3].labels == ""
