import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sub int, length string"


def test_ids_equal_the_library():
    library, encode, rng = Tokenizer.from_file(PATH), pack.encoder(PATH), random.Random(3)
    texts = ["a  b\n\n c ", "<|endoftext|> hi", "it's 'S I'LL don't 123a ", "日本語 テスト éß", "a\x00b", "a\x85\x85b \x1c c"]
    texts += ["".join(rng.choice(" \n\tab'sé1. 　\x1c\x85") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def layout(slots):
    bins = defaultdict(list)
    for n, lo, hi, seq, per, offset in slots.itertuples(index=False):
        for r in range(hi - lo):
            bins[seq + r // per].append((offset + r % per * n, n))
    return bins


def test_other_settings_take_the_library(tmp_path):
    """A file that changes texts, or splits them otherwise, isn't encoded by ranks."""
    import json

    with open(PATH, encoding="utf-8") as f:
        plain = json.load(f)
    assert pack.is_plain(plain)
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": plain["model"] | {"ignore_merges": True}}]
    for k, change in enumerate(changes):
        assert not pack.is_plain(plain | change)
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(plain | change, f)
        library, encode = Tokenizer.from_file(path), pack.encoder(path)
        for t in ("Some TEXT here", " it's 12 words"):
            assert encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_limits_bind_and_weights_count():
    """All three weights change choices, and limits on documents and attention that bind give more sequences."""
    rng = random.Random(9)
    lengths = Counter(rng.choice([1, 2, 5, rng.randint(1, 60)]) for _ in range(3000))
    bins = {k: len(layout(pack.plan(lengths, 300, **o))) for k, o in {"free": {}, "docs": {"most_docs": 6}, "attention": {"most_attention": 5000}}.items()}
    assert bins["free"] < bins["docs"] and bins["free"] < bins["attention"]
    plans = [pack.plan(lengths, 300, most_docs=40, most_attention=8000, weights=w).to_csv() for w in ((1, 0, 0), (1, 0.5, 0), (1, 0, 0.5))]
    assert len(set(plans)) == 3


@pytest.mark.parametrize("options", [{}, {"select": "dot"}, {"most_docs": 3}, {"most_docs": 9, "most_attention": 90_000, "weights": (1, 0.4, 0.3)}, {"select": "dot", "most_docs": 4, "weights": (1, 1, 1)}])
def test_plan_keeps_every_capacity(options):
    rng = random.Random(1)
    lengths = [rng.choice([1, 5, rng.randint(1, 300)]) for _ in range(5000)]
    bins = layout(pack.plan(Counter(lengths), 300, **options))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 300 and len(b) <= options.get("most_docs", 300) and sum(n * n for _, n in b) <= options.get("most_attention", 90_000)
    if not options:
        assert len(bins) <= sum(lengths) / 300 * 1.01 + 1


def test_one_piece_at_a_time_gives_the_same_count():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(800)), reverse=True)
    free = []
    for n in lengths:
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(100 - n)
        else:
            free[free.index(fit)] = fit - n
    assert len(layout(pack.plan(Counter(lengths), 100))) == len(free)


def test_whole_tables(spark):
    rng, library = random.Random(6), Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma.", "é\n"]) for _ in range(rng.choice([0, 1, 5, 40, 150])))) for i in range(150)]
    rows += [(None, None), (3, ""), (3, "again"), (1000, "word " * 500)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = pack.pack(pack.pieces(df, PATH, capacity=64, keep_ids=True), capacity=64, ranked_together=3).collect()
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 64
    assert len(bins) <= sum(w[3] for w in want) / 64 * 1.05 + 1
    assert pack.pack(pack.pieces(df.limit(0), PATH)).count() == 0


def test_long_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "word another " * 100_000, 1, "x"), (2, "b", 1, "x")], SCHEMA).withColumns({c: pack.F.lit("z") for c in ("piece", "start", "sequence_id", "offset", "_no", "_sub", "_rank")})
    got = pack.pack(pack.pieces(df, PATH)).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(Tokenizer.from_file(PATH).encode("word another " * 100_000).ids) + 1
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 1024)
