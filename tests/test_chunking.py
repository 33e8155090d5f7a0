import random
import re

import pytest

from quarry.operators import chunking as C

TOKEN = re.compile(r"\w+|[^\w\s]")


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, source string, page int, text string")


def test_fold_cases():
    def fold(units, size, overlap):
        return ["".join(n for n, _ in units[a:z]) for a, z in C.chunk_bounds([k for _, k in units], size, overlap)]

    assert fold([("a", 5)], 5, 0) == ["a"]
    assert fold([("a", 3), ("b", 2), ("c", 1)], 5, 2) == ["ab", "bc"]
    assert fold([("a", 3), ("b", 2)], 5, 2) == ["ab"]
    assert fold([("a", 4), ("b", 4)], 5, 4) == ["a", "b"]
    assert fold([("a", 2), ("b", 2), ("c", 2), ("d", 3)], 6, 4) == ["abc", "bc", "cd"]
    assert fold([], 5, 1) == []
    # A tail that the next unit doesn't fit beside is a chunk of its own after a full one.
    assert fold([("a", 3), ("b", 2), ("c", 4)], 5, 2) == ["ab", "b", "c"]


def token_by_token(counts, size, overlap):
    """The same rules on a queue of units, one at a time."""
    from collections import deque

    open_, out, new = deque(), [], False

    def close(limit):
        out.append(list(open_))
        while sum(counts[k] for k in open_) > limit:
            open_.popleft()

    for k, n in enumerate(counts):
        if open_ and sum(counts[j] for j in open_) + n > size:
            close(min(overlap, size - n))
        open_.append(k)
        new = sum(counts[j] for j in open_) < size
        if not new:
            close(overlap)
    return out + ([list(open_)] if new else [])


def test_bounds_equal_a_queue():
    rng = random.Random(11)
    for _ in range(2000):
        size = rng.randint(1, 12)
        overlap, counts = rng.randrange(size), [rng.randint(1, size) for _ in range(rng.randrange(30))]
        assert [list(range(a, z)) for a, z in C.chunk_bounds(counts, size, overlap)] == token_by_token(counts, size, overlap)


def test_units_are_sentences():
    split = re.compile(r"(?<=[.!?。！？])\s+")
    rng = random.Random(12)
    for _ in range(500):
        text = "".join(rng.choice(["a", "bc", ".", "!", "。", " ", "\n", "　", "é_1", ",", "\x1c"]) for _ in range(rng.randrange(40)))
        whole = [s.strip() for s in split.split(text.strip()) if s.strip()]
        begin, end, counts = C.sentence_units(text, 1000)
        assert [text[a:z] for a, z in zip(begin, end)] == whole
        begin, end, counts = C.sentence_units(text, 3)
        assert counts.sum() == len(TOKEN.findall(text)) and (counts <= 3).all()
        assert [TOKEN.findall(text[a:z]) for a, z in zip(begin, end)] == [w[k : k + 3] for w in map(TOKEN.findall, whole) for k in range(0, len(w), 3)]


@pytest.mark.parametrize("size,overlap", [(20, 5), (7, 0), (50, 49)])
def test_budget_coverage_and_partitions(spark, size, overlap):
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["word", "two,", "end.", "x"]) for _ in range(rng.randrange(200))) for _ in range(12)]
    rows = [(f"d{k % 5}", "s", k // 5 + 1, t) for k, t in enumerate(texts)]
    key = lambda df: sorted(map(tuple, df.collect()))
    a = C.fixed_sentence(pages(spark, rows).repartition(1), size, overlap)
    b = C.fixed_sentence(pages(spark, rows[::-1]).repartition(7), size, overlap)
    assert key(a) == key(b)
    made = a.collect()
    assert all(len(TOKEN.findall(r.text)) == r.token_count <= size for r in made)
    for d in {r[0] for r in rows}:
        units = [t[a:z] for i, _, _, t in rows if i == d for a, z, _ in zip(*C.sentence_units(t, size))]
        joined = " ".join(r.text for r in sorted((r for r in made if r.doc_id == d), key=lambda r: r.chunk_no))
        assert all(u in joined for u in units)
    pairs = [r.overlap for r in C.overlaps(a, max(overlap, 1)).collect()]
    assert all(o <= max(overlap, 1) for o in pairs)


def test_overlap_of_neighbours(spark):
    rows = [("d", 1, "a b c d"), ("d", 2, "c d e"), ("d", 3, "x"), ("e", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_no int, text string")
    assert {(r.doc_id, r.chunk_no): r.overlap for r in C.overlaps(df).collect()} == {("d", 2): 2, ("d", 3): 0}
    s = C.overlap_summary(C.overlaps(df)).first()
    assert (s.pairs, s.min_overlap, s.avg_overlap, s.median_overlap, s.max_overlap, s.zero_count) == (2, 0, 1, 1, 2, 1)
    none = C.overlap_summary(C.overlaps(df.limit(0))).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0)


def test_dense_ids_follow_text_order(spark):
    rows = [(str(k), "s", p, f"text {k} {p}") for k in range(60) for p in (1, 2, 3)]
    got = C.presegmented(pages(spark, rows).repartition(5)).orderBy("vector_id").collect()
    assert [(r.doc_id, r.page_start) for r in got] == sorted((r[0], r[2]) for r in rows)
    assert C.contiguous(C.presegmented(pages(spark, rows))).first().contiguous


def test_violations(spark):
    df = spark.createDataFrame([(0, " ", 1, 2, 3), (-1, "x", 2, 1, 0), (2, "y", 1, 1, 9)], "vector_id long, text string, page_start int, page_end int, token_count int")
    assert {r.vector_id: r.broken for r in C.chunk_violations(df, 5).collect()} == {0: ["blank"], -1: ["no tokens", "page order", "negative id"], 2: ["over budget"]}


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, -1)])
def test_windows_are_checked(size, overlap):
    with pytest.raises(ValueError):
        C.check_window(size, overlap)


def test_overlap_of_repeated_sentences_is_not_capped(spark):
    text = " ".join(["the same five words again."] * 200)
    made = C.fixed_sentence(pages(spark, [("d", "s", 1, text), ("e", "s", 1, "a b. " * 300)]))
    chunks = {(r.doc_id, r.chunk_no): TOKEN.findall(r.text) for r in made.collect()}
    want = {}
    for (d, n), right in chunks.items():
        if left := chunks.get((d, n - 1)):
            want[d, n] = max(k for k in range(min(len(left), len(right)) + 1) if k == 0 or left[-k:] == right[:k])
    assert max(want.values()) > 50
    assert {(r.doc_id, r.chunk_no): r.overlap for r in C.overlaps(made).collect()} == want
