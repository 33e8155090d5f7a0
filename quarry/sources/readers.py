"""Readers of the corpus and question formats, with the checks that each asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import variants as V
from quarry.functions.text import strip
from quarry.operators.chunking import dense_ids
from quarry.operators.papers import ARTICLE, SPLITS
from quarry.sources import arrow_files, splits

CONTEXTS = "array<struct<title:string,text:string,passage_id:string,id:string>>"
PASSAGES = "id string, title string, text string"


def positioned(rows: DataFrame) -> DataFrame:
    """Rows ``(file, start, number, ...)`` of splits with ``position`` instead: a number that grows from row to row and from split to split, with gaps.

    The driver gets the splits' names and starts, a row each, as it has them from listing the files.
    """
    splits = sorted((r.file, r.start) for r in rows.select("file", "start").distinct().collect())
    numbered = F.broadcast(rows.sparkSession.createDataFrame([(f, s, k) for k, (f, s) in enumerate(splits)], "file string, start long, split long"))
    place = F.shiftleft("split", 33).bitwiseOR(F.col("number").bitwiseAND((1 << 33) - 1))
    return rows.join(numbered, ["file", "start"]).withColumn("position", place).drop("file", "start", "number", "split")


def wikipedia_rows(spark: SparkSession, path: str, spans_lines: bool | None = None) -> DataFrame:
    """``(file, start, number, id, text, title)`` of tab-separated files, each with a header of just these names in any order; ``.gz`` is read as it is.

    A file is read in splits, whether quoted fields go over line ends (which a scan for lines with an odd number of quotes tells) or not; without, it is parsed by Spark's reader.
    """
    wanted = ("id", "text", "title")
    if spans_lines is None:
        odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        spans_lines = bool(spark.read.text(path).where(odd).limit(1).count())
    if not spans_lines:
        raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', mode="FAILFAST")
        names = {c.lstrip("\ufeff"): c for c in raw.columns}
        _check_header(names, raw.columns)
        return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), *[F.col(f"`{names[c]}`").alias(c) for c in wanted])
    rows = splits.delimited(spark, path)
    header = (F.col("start") == 0) & (F.col("number") == 0)
    heads = rows.where(header).select("file", "fields").collect()  # a row a file
    for h in heads:
        _check_header(set(h.fields), h.fields)
    places = F.broadcast(spark.createDataFrame([(h.file, *[h.fields.index(c) for c in wanted]) for h in heads], "file string, a int, b int, c int"))
    whole = F.when(F.size("fields") == 3, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("a row has not three fields: "), F.array_join("fields", " | "))).cast("array<string>"))
    kept = rows.where(~header).withColumn("fields", whole).join(places, "file")
    return kept.select("file", "start", "number", *[F.get("fields", F.col(k)).alias(c) for k, c in zip("abc", wanted)])


def _check_header(names, columns) -> None:
    if set(names) != {"id", "text", "title"} or len(columns) != 3:
        raise ValueError(f"the header must be id, text and title, not {columns}")


def wikipedia_tsv(spark: SparkSession, path: str, spans_lines: bool | None = None) -> DataFrame:
    """``(id, text, title)`` of :func:`wikipedia_rows`."""
    return wikipedia_rows(spark, path, spans_lines).select("id", "text", "title")


def passage_violations(passages: DataFrame) -> DataFrame:
    """``(id, problem)``: ids that aren't positive decimals, blank titles and texts, repeated ids."""
    number = F.col("id").try_cast("long")
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    problem = F.when(~F.col("id").rlike("^[0-9]+$") | F.coalesce(number <= 0, F.lit(True)), "id").when(blank("title"), "title").when(blank("text"), "text")
    bad = passages.select("id", problem.alias("problem")).where("problem is not null")
    return bad.union(passages.groupBy("id").count().where("count > 1").select("id", F.lit("repeated")))


#: Rows that a range of positions has, and levels of ranges: 2 ** 63 positions.
RANGE, RANGE_LEVELS = 100_000, 4


def order_violations(passages: DataFrame, position: str = "position") -> DataFrame:
    """``(p, n)`` of the rows whose id isn't larger than that of the row before by position; positions are distinct and may have gaps of any length.

    Neighbours are compared in ranges of positions. The ends of the ranges that have rows are rows of larger ranges, and so on, so that no window has more than
    ``RANGE`` rows. Ids that are no integers are left to :func:`passage_violations`.
    """
    n = F.col("id").try_cast("long")
    rows, out = passages.select(F.col(position).cast("long").alias("p"), n.alias("head"), n.alias("tail")).where("head is not null"), None
    for level in range(1, RANGE_LEVELS + 1):
        rows = rows.withColumn("g", F.floor(F.col("p") / RANGE**level) if level < RANGE_LEVELS else F.lit(0))
        before = F.lag("tail").over(Window.partitionBy("g").orderBy("p"))
        found = rows.withColumn("before", before).where("head <= before").select("p", F.col("head").alias("n"))
        out = found if out is None else out.union(found)
        rows = rows.groupBy("g").agg(F.min("p").alias("p"), F.min_by("head", "p").alias("head"), F.max_by("tail", "p").alias("tail"))
    return out


def question_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, number, record)``, each record a variant, of ``.jsonl`` or ``.ndjson`` lines, a JSON array, or an object with the array in ``data``.

    Lines and arrays are read in splits. An object is one value, as it is for any JSON parser. What isn't JSON, isn't whole or isn't an object raises.
    """
    if path.endswith((".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz")):
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        rows = lines.where(F.trim("value") != "").withColumn("record", V.parsed("value")).drop("value")
    else:
        first = spark.read.text(path, lineSep="}").where(F.trim("value") != "").select(F.regexp_extract("value", r"^[\s\ufeff]*(\S)", 1)).first()
        if first is None:
            raise ValueError("the file of questions is empty")
        if first[0] == "[":
            rows = splits.array_elements(spark, path).withColumn("record", V.parsed("value")).drop("value")
        else:
            whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), V.member(V.parsed(F.regexp_replace("value", "^\ufeff", "")), "data").alias("data"))
            listed = F.when(V.kind(F.col("data")) == "ARRAY", V.items(F.col("data"))).otherwise(F.raise_error(F.lit("a JSON object of questions has no array in data")).cast("array<variant>"))
            rows = whole.select("file", F.lit(0).cast("long").alias("start"), F.posexplode(listed).alias("number", "record")).withColumn("number", F.col("number").cast("long"))
    is_object = F.when(V.kind(F.col("record")) == "OBJECT", F.col("record")).otherwise(F.raise_error(F.lit("a question is no object")).cast("variant"))
    return rows.withColumn("record", is_object)


def question_columns(rows: DataFrame) -> DataFrame:
    """The columns of ``QUESTIONS`` for ``record``: answers may be one text or a list, ids texts or numbers, and contexts may be absent."""
    record = F.col("record")

    def contexts(name: str) -> Column:
        def one(c: Column) -> Column:
            fields = [V.text(V.member(c, f)).alias(f) for f in ("title", "text")] + [V.printed(V.member(c, f)).alias(f) for f in ("passage_id", "id")]
            return F.when(V.kind(c) == "OBJECT", F.struct(*fields)).otherwise(F.raise_error(F.lit(f"a context of {name} is no object")).cast(CONTEXTS[6:-1]))

        listed = V.member(record, name)
        return F.when(listed.isNull(), F.array().cast(CONTEXTS)).when(V.kind(listed) == "ARRAY", F.transform(V.items(listed), one)).otherwise(F.raise_error(F.lit(f"{name} is no list")).cast(CONTEXTS))

    kept = [c for c in rows.columns if c != "record"]
    return rows.select(*kept, V.text(V.member(record, "question")).alias("question"), V.strings(V.member(record, "answers")).alias("answers"), contexts("positive_ctxs").alias("positive_ctxs"), contexts("hard_negative_ctxs").alias("hard_negative_ctxs"))


def questions(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """Questions in any of the framings of :func:`question_records`; ``positions`` adds ``position``, which follows the files."""
    rows = question_columns(question_records(spark, path))
    return positioned(rows) if positions else rows.drop("file", "start", "number")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line; blank lines are skipped and lines that don't parse raise."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def prepared_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of prepared passages: ``dpr_wiki_passage:<id>``, the title as source, page 1, title and text as text."""
    p = jsonl(spark, path, PASSAGES)
    return p.select(F.concat(F.lit("dpr_wiki_passage:"), "id").alias("doc_id"), F.col("title").alias("source"), F.lit(1).alias("page"), F.concat("title", F.lit("\n"), "text").alias("text"))


def passage_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(position, id, title, text)`` of prepared passages, one JSON object a line with exactly these three keys, all of them texts; anything else raises."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), "value")
    rows = lines.where(F.trim("value") != "").withColumn("record", V.parsed("value"))
    keys = F.array_sort(F.map_keys(F.try_variant_get("record", "$", "map<string,variant>")))
    fields = [V.text(V.member(F.col("record"), c)) for c in ("id", "title", "text")]
    sound = F.coalesce(keys == F.array(*map(F.lit, ("id", "text", "title"))), F.lit(False)) & fields[0].isNotNull() & fields[1].isNotNull() & fields[2].isNotNull()
    value = F.when(sound, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a passage is not id, title and text: "), F.substring("value", 1, 80))).cast("string"))
    checked = rows.withColumn("value", value).where("value is not null")
    return positioned(checked.select("file", "start", "number", *[f.alias(c) for f, c in zip(fields, ("id", "title", "text"))]))


def listed_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(position, id)`` of a list of ids, one a line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), F.trim("value").alias("id"))
    return positioned(lines.where("id <> ''"))


def positional_differences(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """``(row, passage, listed)`` where the passage and the listed id of the same place, counted from 0 by ``position``, aren't the same, or one of them lacks."""
    place = lambda df, name: dense_ids(df.select("position", F.col("id").alias(name)).withColumn("_g", F.floor(F.col("position") / 4096)), "_g", [F.col("position")], "row").select("row", name)
    both = place(passages, "passage").join(place(ids, "listed"), "row", "full")
    return both.where(~F.col("passage").eqNullSafe(F.col("listed"))).select("row", "passage", "listed")


def id_list_differences(passages: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that only one of the passages and the id list has."""
    a, b = passages.select("id", F.lit(True).alias("in_passages")), ids.select("id", F.lit(True).alias("in_list"))
    return a.join(b, "id", "full").where("in_passages is null or in_list is null")


def papers(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Articles of all splits from ``path/<split>`` with their ``split``; columns are checked and no split may be empty.

    ``form`` is ``parquet``, or ``arrow`` for a dataset stored as Arrow files, whose articles also have their ``position`` in the split.
    """
    wanted, parts = ["abstract", "figures_and_tables", "full_text", "id", "qas", "title"], None
    if form not in ("parquet", "arrow"):
        raise ValueError("papers are stored as parquet or arrow")
    if form == "arrow":
        arrow_files.register(spark)
    for split in SPLITS:
        if form == "arrow":
            part = spark.read.format("arrow_ipc").option("columns", ",".join(wanted)).option("position", "position").load(f"{path}/{split}")
        else:
            part = spark.read.parquet(f"{path}/{split}")
        if missing := set(wanted) - set(part.columns):
            raise ValueError(f"{split} lacks {sorted(missing)}")
        if not part.limit(1).count():
            raise ValueError(f"{split} is empty")
        part = part.select(*wanted, *(["position"] if form == "arrow" else [])).withColumn("split", F.lit(split))
        parts = part if parts is None else parts.unionByName(part)
    return parts


ARTICLE_SCHEMA = ARTICLE
