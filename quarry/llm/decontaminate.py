"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits; shingles are ``shingle`` words, with repeats. A window is
item-sized: as many consecutive words as the item has, or the whole of a shorter text. A text is contaminated if any of its windows
has a weighted shingle similarity (sum of minima over sum of maxima of how often each occurs) of ``similarity`` or more with an item.

1. Places: the shingles of all texts are looked up among those of the benchmark, inside one generated stage; only places that match leave it.
2. Windows: a window of ``n`` shingles can reach similarity ``s`` with an item of ``m`` only if at least ``s / (1 + s) * (n + m)`` of its places
match, so every item-sized window with so many matching places is formed, wherever and in whatever order they lie; no other can be similar. Equal
windows are one from here on. 3. Each window's SimHash has ``HASHES * BITS`` bits, over its shingles numbered by occurrence,
so that the angle follows the weighted similarity: at 0.8, two fingerprints of 315 bits differ in 48 on average with a deviation of 6.4,
and the radius of 74 is four deviations away. Its 25 blocks of 12 or 13 bits are the index: two fingerprints
within the radius have a block in which at most two bits differ (25 blocks with three each would make 75), so items are
entered under all variants of each block within two bits (2,170 rows an item) and windows look up their 25 blocks as they are. A window meets a random item
of its size with a probability of about 0.3; the Hamming distance is then checked. 4. The exact similarity decides.

Edge cases: null and empty texts and items match nothing; items or texts of fewer words than a shingle have their whole word
sequence as the one shingle; a text shorter than an item is one window; very long texts are looked up place by place, and a window holds no more than
an item's words (fewer than two million); rows that share a ``doc_id`` are told apart by a hash of their text, and rows alike in both get the same result; null ids come
out null; extra columns are ignored; an empty table or benchmark gives no matches.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, checkpointed

#: Hashes of a fingerprint, and the bits that each gives: three lanes of a long count 21 bits each.
HASHES, LANE = 5, 21
BITS = 3 * LANE
#: Bits of the blocks of one hash.
CUTS = (13, 13, 13, 12, 12)
#: Bits by which a block may differ, and the largest radius for which some block then does not.
BLOCK_RADIUS = 2
MOST_RADIUS = (BLOCK_RADIUS + 1) * HASHES * len(CUTS) - 1
#: Shingles of a broadcast block of the benchmark (one long each), and document keys (one long each) up to which these are broadcast.
SHINGLES_A_BLOCK, MOST_KEYS = 2_000_000, 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_at(w: str, p: Column, n: int) -> Column:
    """The hash of ``n`` words from ``p`` on; of all, where there are fewer."""
    return F.xxhash64(*[F.get(w, p + k) for k in range(n)])


def places(w: str, n: int) -> Column:
    """The start of each shingle; one for a shorter, non-empty sequence."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def featured(df: DataFrame, shingles: str, out: str = "features") -> DataFrame:
    """Adds the hashes of the shingles numbered by occurrence; two such sets share as many as the sum of minima of the counts."""
    ordered = df.withColumn("_sorted", F.array_sort(shingles))
    nth = lambda x, i: F.xxhash64(x, i + 1 - F.array_position("_sorted", x))
    return ordered.withColumn(out, F.transform("_sorted", nth)).drop("_sorted")


def fingerprinted(df: DataFrame, features: str = "features") -> DataFrame:
    """Adds the SimHash as the longs ``fp0`` to ``fp4``: a bit is set if it is in over half of the hashes.

    Three bits are counted at once, in lanes of a long, so a bit's count stays below two million.
    """
    lanes = 1 | 1 << LANE | 1 << 2 * LANE
    shift = lambda name, x, n: F.call_function(name, x, n)
    mixed = lambda j: F.transform(features, lambda x: F.xxhash64(F.lit(j), x))
    df = df.withColumns({f"_h{j}": mixed(j) for j in range(HASHES)})
    total = lambda j, i: F.aggregate(f"_h{j}", F.lit(0).cast("long"), lambda s, x: s + F.shiftrightunsigned(x, i).bitwiseAND(F.lit(lanes)))
    df = df.withColumns({f"_s{j}": F.array(*[total(j, i) for i in range(LANE)]) for j in range(HASHES)})

    def bits(x, i):
        often = lambda k: F.shiftrightunsigned(x, k * LANE).bitwiseAND(F.lit((1 << LANE) - 1)) * 2 > F.size(features)
        one = shift("shiftleft", F.lit(1).cast("long"), i)
        return sum((F.when(often(k), shift("shiftleft", one, F.lit(k * LANE))).otherwise(F.lit(0).cast("long")) for k in (1, 2)), F.when(often(0), one).otherwise(F.lit(0).cast("long")))

    whole = {f"fp{j}": F.aggregate(F.transform(f"_s{j}", bits), F.lit(0).cast("long"), lambda s, x: s + x) for j in range(HASHES)}
    return df.withColumns(whole).drop(*[f"_{n}{j}" for n in "hs" for j in range(HASHES)])


def blocks() -> list[tuple[Column, int]]:
    """``(number and bits, width)`` of every block of the fingerprint ``fp0`` to ``fp4``."""
    out = []
    for j in range(HASHES):
        at = 0
        for width in CUTS:
            part = F.shiftrightunsigned(f"fp{j}", at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
            out.append((part + F.lit(len(out) << 16), width))
            at += width
    return out


def masks(width: int, most: int = BLOCK_RADIUS) -> Column:
    """All differences of at most ``most`` bits."""
    return F.array(*[F.lit(sum(1 << b for b in bits)) for r in range(most + 1) for bits in combinations(range(width), r)])


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = MOST_RADIUS) -> DataFrame:
    """``(did, tie, item, similarity)`` of each document and benchmark item at or above the similarity, with the best
    window's. ``did`` is the id (the largest long for null), ``tie`` a hash of the text."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"the blocks find no radius over {MOST_RADIUS}")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), words(F.col(item_text)).alias("iw")).where("size(iw) > 0").distinct()
    items = items.select("item", F.size("iw").alias("len"), F.transform(places("iw", shingle), lambda p: shingle_at("iw", p, shingle)).alias("ish"))
    items = checkpointed(fingerprinted(featured(items, "ish", "features")))
    spots = checkpointed(items.select("len", F.explode("ish").alias("sh")).groupBy("sh").agg(F.collect_set("len").alias("lens")))

    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("tie"), words(F.col(text_col)).alias("w"))
    n_blocks = -(-spots.count() // SHINGLES_A_BLOCK)  # a scan of the texts for each block of the benchmark's shingles
    widths = [shingle, *(r["len"] for r in items.where(F.col("len") < shingle).select("len").distinct().collect())]  # fewer than shingle numbers
    hits = None
    for k in range(max(1, n_blocks)):
        mine = spots.where(F.pmod("sh", F.lit(max(1, n_blocks))) == k)
        wanted = F.broadcast(mine.select("sh"))
        for width in widths:
            at = docs.select("did", "tie", "w", F.explode(places("w", width)).alias("p"))
            found = at.select("did", "tie", "p", F.size("w").alias("n"), shingle_at("w", F.col("p"), width).alias("sh")).join(wanted, "sh")
            hits = found if hits is None else hits.union(found)
    at = hits.join(spots, "sh").select("did", "tie", "n", "p", F.explode("lens").alias("len"))
    at = at.groupBy("did", "tie", "n", "len").agg(F.sort_array(F.collect_set("p")).alias("at"))
    at = at.withColumn("words", F.least("len", "n")).withColumn("nw", F.greatest(F.col("words") - (shingle - 1), F.lit(1)))
    enough = F.ceil((F.col("nw") + F.greatest(F.col("len") - (shingle - 1), F.lit(1))) * F.lit(similarity / (1 + similarity)) - 1e-9).cast("int")
    at = at.withColumn("need", F.greatest(enough, F.lit(1))).where("size(at) >= need")
    # The windows that hold the places i to i + need - 1 start between these bounds.
    bounds = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.greatest(F.get("at", i + F.col("need") - 1) - F.col("nw") + 1, F.lit(0)).alias("lo"), F.least(F.get("at", i), F.col("n") - F.col("words")).alias("hi")))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(bounds, lambda b: b["lo"] <= b["hi"]), lambda b: F.sequence(b["lo"], b["hi"]))))
    starts = at.select("did", "tie", "len", "words", starts.alias("starts")).where("size(starts) > 0")
    starts = checkpointed(starts.groupBy("did", "tie").agg(F.collect_list(F.struct("len", "words", "starts")).alias("spans")))

    near = docs
    if starts.count() <= MOST_KEYS:
        # One long a key; texts whose hashes collide are told apart by the join below.
        keys = starts.select(F.xxhash64("did", "tie").alias("key")).distinct()
        near = docs.withColumn("key", F.xxhash64("did", "tie")).join(F.broadcast(keys), "key", "left_semi").drop("key")
    near = near.dropDuplicates(["did", "tie"]).join(starts, ["did", "tie"]).select("did", "tie", "w", F.explode("spans").alias("span"))
    near = near.select("did", "tie", "w", F.col("span.len").alias("len"), F.col("span.words").alias("words"), F.explode("span.starts").alias("s"))
    near = near.select("did", "tie", "len", F.slice("w", F.col("s") + 1, F.col("words")).alias("ww"))
    windows = featured(near.select("did", "tie", "len", F.transform(places("ww", shingle), lambda p: shingle_at("ww", p, shingle)).alias("wsh")), "wsh")
    windows = checkpointed(windows.select("did", "tie", "len", "features", F.xxhash64("features").alias("wid"), F.xxhash64(F.lit(1), "features").alias("wid2")))

    name = ["len", "wid", "wid2"]
    own = checkpointed(fingerprinted(windows.select(*name, "features").dropDuplicates(name)))
    fps = [f"fp{j}" for j in range(HASHES)]
    left = own.select(*name, *fps, F.explode(F.array(*[b for b, _ in blocks()])).alias("block"))
    variants = lambda block, width: F.transform(masks(width), lambda m: block.bitwiseXOR(m))
    entered = F.flatten(F.array(*[variants(block, width) for block, width in blocks()]))
    right = items.select("item", "len", *[F.col(f).alias(f"i{f}") for f in fps], F.explode(entered).alias("block"))
    distance = sum(F.bit_count(F.col(f).bitwiseXOR(F.col(f"i{f}"))) for f in fps)
    # The estimate of the entries is that of the benchmark, before it was multiplied: no broadcast by it.
    pairs = left.join(right.hint("merge"), ["len", "block"]).where(distance <= radius).select(*name, "item").distinct()

    kept = items.select("item", F.col("features").alias("item_features"))
    both = F.size(F.array_intersect("features", "item_features"))
    scored = pairs.join(own.select(*name, "features"), name).join(kept, "item").select(*name, "item", (both / (F.size("features") + F.size("item_features") - both)).alias("similarity")).where(F.col("similarity") >= similarity)
    # A frequent window is split at run time: the join is on a hash that no side is dealt by.
    scored = scored.select(F.xxhash64(*name).alias("by"), *[F.col(c).alias(f"i_{c}") for c in name], "item", "similarity")
    named = windows.select("did", "tie", *name, F.xxhash64(*name).alias("by")).join(scored, "by").where(" and ".join(f"{c} = i_{c}" for c in name))
    return named.groupBy("did", "tie", "item").agg(F.max("similarity").alias("similarity"))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, contaminated, n_items, items, best_similarity)``, a row per input row."""
    found = matches(df, benchmark, id_col, text_col, **options)
    per_doc = found.groupBy("did", "tie").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("best"))
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("tie"))
    out = ids.join(per_doc, ["did", "tie"], "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.col("best").alias("best_similarity"))


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, without contaminated documents."""
    found = matches(df, benchmark, id_col, text_col, **options).select("did", "tie").distinct()
    left = df.alias("d")
    same = (F.coalesce(F.col(f"d.`{id_col}`").cast("long"), F.lit(NULL_ID)) == F.col("f.did")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("f.tie"))
    return left.join(found.alias("f"), same, "left_anti")
