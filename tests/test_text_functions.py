import random
import re
import string
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T

SAMPLES = [
    "", " ", "a", "Hello, world! It's a test.", "éa b", "The cat. A dog?  An owl!\nNext one", "日本語。 テスト！ 次", "a_b 1° x y", "\t tab\x85end ",
    "A an THE", "...", "x. y", "no terminator", "ends. ", "ﬁne ① ½", "tail the", "the-end a.b", "\x1cfs \x1f", "Ünï códe", "a" * 300 + ". b",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def squash(s):
    return " ".join(s.split())


def nq(s):
    s = unicodedata.normalize("NFKC", s).lower()
    s = "".join(c for c in s if not unicodedata.category(c).startswith("P"))
    return squash(re.sub(r"\b(a|an|the)\b", " ", s, flags=re.I))


def paper(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return squash(re.sub(r"\b(a|an|the)\b", " ", s))


def test_tokens_and_strip(spark):
    df = rows(spark, SAMPLES)
    assert values(df, T.tokens("t")) == [re.findall(r"\w+|[^\w\s]", s) for s in SAMPLES]
    assert values(df, T.strip("t")) == [s.strip() for s in SAMPLES]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 400])
def test_truncation(spark, n):
    def cut(s):
        m = list(re.finditer(r"\w+|[^\w\s]", s))
        return s[m[0].start() : m[min(n, len(m)) - 1].end()] if m and n else ""

    assert values(rows(spark, SAMPLES), T.truncate_tokens(F.col("t"), n)) == [cut(s) for s in SAMPLES]


def test_sentences(spark):
    want = [[p.strip() for p in re.split(r"(?<=[.!?。！？])\s+", s.strip()) if p.strip()] for s in SAMPLES]
    assert values(rows(spark, SAMPLES), T.sentences("t")) == want


def test_normal_forms(spark):
    df = rows(spark, SAMPLES)
    assert values(df, T.normalize_short_answer("t")) == [nq(s) for s in SAMPLES]
    assert values(df, T.normalize_paper_answer("t")) == [paper(s) for s in SAMPLES]
    assert values(df, T.normalize_text("t")) == [squash(unicodedata.normalize("NFKC", s)) for s in SAMPLES]
    assert values(df, T.normalize_evidence("t")) == [s.replace("\r", " ").replace("\n", " ").strip() for s in SAMPLES]
    assert values(df, T.passage_body("t")) == [s.split("\n", 1)[1] if "\n" in s else s for s in SAMPLES]


def f1(p, g, empty):
    a, b = p.split(), g.split()
    if empty and not b:
        return float(not a)
    same = sum((Counter(a) & Counter(b)).values())
    return 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) if same else 0.0


def test_token_f1(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randrange(5))), " ".join(rng.choices("abcd", k=rng.randrange(5)))) for _ in range(80)] + [("", ""), ("a", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string")
    assert values(df, T.short_answer_f1(F.col("p"), F.col("g"))) == pytest.approx([f1(p, g, True) for p, g in pairs])
    assert values(df, T.paper_answer_f1(F.col("p"), F.col("g"))) == pytest.approx([f1(p, g, False) for p, g in pairs])


def test_evidence_f1_keeps_list_lengths(spark):
    cases = [([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0), (["a", "a"], ["a"], 2 / 3), (["a", "b"], ["b", "c", "b"], 2 * (1 / 2) * (1 / 3) / (1 / 2 + 1 / 3)), (["x"], ["y"], 0.0)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p array<string>, g array<string>")
    assert values(df, T.evidence_f1(F.col("p"), F.col("g"))) == pytest.approx([c[2] for c in cases])


def test_contains_answer_by_words(spark):
    cases = [("new york city", "york", True), ("new york city", "yor", False), ("a b", "", False), ("a b c", "b c", True), ("", "a", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, p string, g string")
    assert values(df, T.contains_answer(F.col("p"), F.col("g"))) == [c[2] for c in cases]


def test_redaction(spark):
    key = "sk-" + "a1_B" * 5
    df = rows(spark, [f"x {key} y", f"no{key}", "sk-short", f"({key})"])
    assert values(df, T.redact("t")) == ["x [REDACTED] y", f"no{key}", "sk-short", "([REDACTED])"]
