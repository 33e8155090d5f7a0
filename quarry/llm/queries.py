"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontaminate, embedding_dedup, language_id, license_scan, line_dedup, media_ts, merkle, pack, shard, simhash_dedup, substring_dedup, toxicity, whitening
from quarry.llm.common import load

#: Where the tokenizer's file lies is a parameter of the packing operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), window=20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.learn(toxicity.training_rows(docs, load(spark, sf_dir, "labels"), most_rows=20_000))
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), shingle=5, similarity=0.8, radius=74)
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(load(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_runs(load(spark, sf_dir, "documents"), run_lines=2)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(load(spark, sf_dir, "documents"))
    spans = F.to_json("spans").alias("spans")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", spans)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    named = language_id.predict(docs, language_id.learn(docs, per_class=300, landmarks=128))
    return named.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op8_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = media_ts.from_media(media_ts.to_media(load(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), F.size("pts")), F.concat(F.lit("last_pts="), F.element_at("pts", -1)), F.concat(F.lit("access="), F.array_join("access_points", ",")))
    return parsed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.assignments(load(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pack.pieces(load(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)
    return pack.pack(cut, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(load(spark, sf_dir, "embeddings"), components=4)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"), cosine=0.98)


def rules_op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the scores: a row a document, scores from 0 to 1, predictions by the threshold, equal texts alike."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("tie"))
    scored = op2_toxicity(spark, sf_dir).join(docs, "doc_id")
    alike = F.min("score").over(Window.partitionBy("tie")) == F.max("score").over(Window.partitionBy("tie"))
    return scored.select("doc_id", F.col("score").between(0, 1).alias("in_range"), (F.col("predicted") == (F.col("score") >= 0.7).cast("int")).alias("by_threshold"), alike.alias("alike"))


def rules_op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest id of the documents with the same words is no smaller than their component's; fingerprints are zero only without words."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("tie"))
    found = op4_simhash_dedup(spark, sf_dir).join(docs, "doc_id")
    same = F.min("component_id").over(Window.partitionBy("tie")) == F.max("component_id").over(Window.partitionBy("tie"))
    return found.select("doc_id", (F.col("component_id") <= F.col("doc_id")).alias("least"), (F.length("fingerprint") == 16).alias("whole"), (F.col("fingerprint") == "0" * 16).alias("zero"), same.alias("together"))


def rules_op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, and that the method's labels only add to them."""
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    kept = F.size(F.array_except(base, F.split("labels", ","))) == 0
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels", kept.alias("kept"), F.col("score").between(0, 1).alias("in_range"))


def rules_op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``und`` just for texts without a letter, learned languages for all others, scores from 0 to 1."""
    docs = load(spark, sf_dir, "documents")
    langs = docs.select(F.col("lang").alias("lang_pred")).where("lang is not null").distinct().withColumn("known", F.lit(True))
    named = op7_language_id(spark, sf_dir).join(F.broadcast(langs), "lang_pred", "left")
    return named.select("doc_id", (F.col("lang_pred") == "und").alias("undetermined"), F.coalesce("known", F.lit(False)).alias("known"), F.col("score").between(0, 1).alias("in_range"))


def rules_op8_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the payloads as they were read back from the stored streams."""
    found = op8_media_ts(spark, sf_dir)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", (F.col("media_bytes") % 188 == 0).alias("whole_packets"), (F.col("media_bytes") > F.col("payload_bytes")).alias("stored"))


def rules_op9_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each shard has, their slots, and the bytes of all."""
    placed = op9_two_pass_shards(spark, sf_dir)
    per = placed.groupBy("shard").agg(F.count("*").alias("n"), (F.count_distinct("slot") == F.count("*")).alias("distinct_slots"), F.min("slot").alias("first"), (F.max("slot") == F.count("*") - 1).alias("gapless"), F.sum("size").alias("bytes"))
    return per.withColumn("all_bytes", F.sum("bytes").over(Window.partitionBy(F.lit(1)))).drop("bytes")  # one row a shard


def rules_op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is packed whole, without gaps, in sequences of at most 1024 tokens that are as few as their tokens allow, within one in a hundred."""
    packed = op10_best_fit_packing(spark, sf_dir)
    within = Window.partitionBy("sequence_id")
    before = F.coalesce(F.sum("length").over(within.orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = packed.withColumn("fits", F.sum("length").over(within) <= 1024).withColumn("gapless", F.col("offset") == before)
    per = rows.groupBy("doc_id").agg((F.max("piece") + 1 == F.count("*")).alias("whole"), F.min("fits").alias("fits"), F.min("gapless").alias("gapless"), (F.max(F.when(F.col("piece") > 0, F.when(F.col("length") != 1024, 1)).otherwise(0)) == 0).alias("only_first_short"))
    total = packed.agg((F.count_distinct("sequence_id") <= F.ceil(F.sum("length") / 1024 * 1.01) + 1).alias("few"))
    return per.crossJoin(F.broadcast(total)).select("doc_id", "whole", "fits", "gapless", F.coalesce("only_first_short", F.lit(True)).alias("only_first_short"), "few")


def rules_op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns, and that each component's whitened values have a mean of 0 and a variance of 1 over the fit list, that shares fall and errors are small."""
    found = op12_embedding_whitening(spark, sf_dir)
    x = whitening.integers(load(spark, sf_dir, "embeddings")).dropDuplicates(["x"]).select("vec_id")
    moments = found.join(x, "vec_id").groupBy("component").agg(F.abs(F.avg("whitened")) < 1e-4, F.abs(F.var_pop("whitened") - 1) < 1e-4).toDF("component", "centred", "unit")
    share = Window.partitionBy("vec_id").orderBy("component")
    rows = found.withColumn("falls", F.coalesce(F.lag("explained").over(share) >= F.col("explained"), F.lit(True)) & (F.col("explained") > 0))
    rows = rows.join(F.broadcast(moments), "component")  # four rows
    return rows.select("vec_id", "component", "n", "deviation", "falls", "centred", "unit", (F.col("identity_error") <= 1e-4).alias("whitens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_substring_dedup, op2_toxicity, op3_decontamination, op4_simhash_dedup, op5_line_dedup, op6_license_scan, op7_language_id, op8_media_ts, op9_two_pass_shards, op10_best_fit_packing, op11_merkle_manifest, op12_embedding_whitening, op13_embedding_dedup]
    named += [rules_op2_toxicity, rules_op4_simhash_dedup, rules_op6_license_scan, rules_op7_language_id, rules_op8_media_ts, rules_op9_two_pass_shards, rules_op10_best_fit_packing, rules_op12_embedding_whitening]
    return {f.__name__: f for f in named}


OP1_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20),
keyed AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM starts),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + d AS p FROM again, (SELECT unnest(range(20)) AS d)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


#: Every two neighbouring lines that occur earlier are removed; no winnowing here.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pairs AS (SELECT doc_id, unnest(range(1, len(l))) AS s, l FROM docs),
keyed AS (SELECT doc_id, s, l[s] AS a, l[s + 1] AS b FROM pairs),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT doc_id, s AS p FROM again UNION SELECT doc_id, s + 1 FROM again),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


#: Every item-sized window that shares any shingle with an item is compared with it exactly; no fingerprints here.
OP3_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ij AS (SELECT item_id, w, len(w) AS n, greatest(len(w) - 4, 1) AS ni, unnest(range(greatest(len(w) - 4, 1))) AS j FROM items WHERE len(w) > 0),
ish AS (SELECT item_id, n, ni, array_to_string(w[j + 1:j + 5], ' ') AS sh FROM ij),
want AS (SELECT item_id, n, ni, sh, count(*) AS ci FROM ish GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
dp AS (SELECT doc_id, w, len(w) AS dn, unnest(range(greatest(len(w) - 4, 1))) AS p FROM docs WHERE len(w) > 0),
dsh AS (SELECT doc_id, dn, p, array_to_string(w[p + 1:p + 5], ' ') AS sh FROM dp),
hits AS (SELECT doc_id, dn, p, item_id, n, ni, greatest(least(dn, n) - 4, 1) AS nw, sh, ci FROM dsh JOIN want USING (sh)),
spread AS (SELECT *, unnest(range(greatest(p - nw + 1, 0), least(p, greatest(dn - n, 0)) + 1)) AS s FROM hits),
have AS (SELECT doc_id, item_id, s, ni, nw, sh, least(count(*), any_value(ci)) AS same FROM spread GROUP BY doc_id, item_id, s, ni, nw, sh),
sims AS (SELECT doc_id, item_id, s, ni, nw, sum(same)::BIGINT AS same FROM have GROUP BY doc_id, item_id, s, ni, nw),
best AS (SELECT doc_id, item_id, max(same / (nw + ni - same)) AS sim FROM sims GROUP BY doc_id, item_id HAVING sim >= 0.8)
SELECT d.doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items, max(sim) AS best_similarity
FROM documents d LEFT JOIN best USING (doc_id) GROUP BY d.doc_id
"""


_LICENCE_WORDS = r"""words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
places AS (SELECT doc_id, p - 1 AS p, 'mit' AS label FROM spots WHERE w[p] = 'mit' AND w[p + 1] = 'license' UNION ALL SELECT doc_id, p - 1, 'apache' FROM spots WHERE w[p] = 'apache' AND w[p + 1] = 'license'
  UNION ALL SELECT doc_id, p - 1, 'gpl' FROM spots WHERE w[p] = 'general' AND w[p + 1] = 'public' AND w[p + 2] = 'license'),
base AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY doc_id)"""
RULES_SQL = {
    "rules_op2_toxicity": "SELECT doc_id, true AS in_range, true AS by_threshold, true AS alike FROM documents",
    "rules_op4_simhash_dedup": r"SELECT doc_id, true AS least, true AS whole, NOT regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]') AS zero, true AS together FROM documents",
    "rules_op6_license_scan": f"WITH {_LICENCE_WORDS} SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, coalesce(a, -1)::BIGINT AS first_word, coalesce(z, -1)::BIGINT AS last_word, coalesce(l, '') AS base_labels, true AS kept, true AS in_range FROM words LEFT JOIN base USING (doc_id)",
    "rules_op7_language_id": r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\p{L}') AS undetermined, regexp_matches(coalesce(text, ''), '\p{L}') AS known, true AS in_range FROM documents",
    "rules_op8_media_ts": """SELECT doc_id, strlen(t)::BIGINT AS n_bytes, (64 * greatest((strlen(t) + 63) // 64, 1))::BIGINT AS payload_bytes, sha256(t || repeat(chr(0), (64 * greatest((strlen(t) + 63) // 64, 1) - strlen(t))::BIGINT)) AS payload_sha256, true AS whole_packets, true AS stored
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "rules_op9_two_pass_shards": """WITH n AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS b FROM documents)
SELECT s::INTEGER AS shard, ((s + 1) * n + 23) // 24 - (s * n + 23) // 24 AS n, true AS distinct_slots, 0::BIGINT AS first, true AS gapless, b AS all_bytes FROM n, (SELECT unnest(range(24)) AS s)""",
    "rules_op10_best_fit_packing": "SELECT doc_id, true AS whole, true AS fits, true AS gapless, true AS only_first_short, true AS few FROM documents",
}


#: Levels by recursion; CRC-32 by the shift register, a bit at a time, over the decimal digits; the proof and the fold climb level by level.
OP11_SQL = r"""
WITH RECURSIVE
part AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
crc AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295::BIGINT), 4294967295) AS crc FROM part),
leaves AS (SELECT doc_id, coalesce('L' || lang, 'N') AS tree, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, level, i, h, n) AS (SELECT tree, 0, i, leaf, n FROM placed UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n),
subroots AS (SELECT tree, h AS subroot, level AS height FROM nodes WHERE n = 1),
langs AS (SELECT tree, row_number() OVER (ORDER BY any_value(lang) NULLS FIRST) - 1 AS k, count(*) OVER () AS langs FROM placed GROUP BY tree),
tops(level, i, h, n) AS (SELECT 0, k, subroot, langs FROM langs JOIN subroots USING (tree) UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, i // 8, n),
joined AS (SELECT tree, level, i, h, n FROM nodes UNION ALL SELECT 'T', level, i, h, n FROM tops),
ways AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM joined a JOIN joined b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i),
climb(doc_id, leaf, home, tree, level, i, seen, d) AS (SELECT doc_id, leaf, tree, tree, 0, i, '', coalesce(tampered, leaf) FROM placed
  UNION ALL SELECT doc_id, leaf, home, tree, level + 1, i // 8, seen || before || after, sha256(before || d || after) FROM climb JOIN ways USING (tree, level, i)),
over AS (SELECT doc_id, leaf, home, seen, d FROM climb JOIN subroots s ON home = s.tree AND climb.tree = home AND level = height),
climb2(doc_id, leaf, home, tree, level, i, seen, d) AS (SELECT doc_id, leaf, home, 'T', 0, k, seen, d FROM over JOIN langs ON home = langs.tree
  UNION ALL SELECT doc_id, leaf, home, tree, level + 1, i // 8, seen || before || after, sha256(before || d || after) FROM climb2 JOIN ways USING (tree, level, i))
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, d AS folded_root, d = root AS verified
FROM climb2 JOIN (SELECT h AS root, level AS height FROM tops WHERE n = 1) ON level = height JOIN subroots s ON home = s.tree
"""

RULES_SQL["rules_op12_embedding_whitening"] = """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
fit AS (SELECT DISTINCT x FROM rows),
sums AS (SELECT j, sum(x[j])::HUGEINT AS s, (SELECT count(*) FROM fit)::HUGEINT AS n FROM fit, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY j),
far AS (SELECT vec_id, any_value(n)::BIGINT AS n, sum((n * x[j] - s) * (n * x[j] - s))::BIGINT AS deviation FROM rows, sums GROUP BY vec_id)
SELECT vec_id, component::INTEGER AS component, n, deviation, true AS falls, true AS centred, true AS unit, true AS whitens FROM far, (SELECT unnest(range(1, 5)) AS component)
"""

#: All pairs of a label; classes by recursion over links.
OP13_SQL = """
WITH RECURSIVE
ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN counts ON e.vec_id = counts.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_line_dedup": OP5_SQL, "op11_merkle_manifest": OP11_SQL, "op13_embedding_dedup": OP13_SQL} | RULES_SQL
