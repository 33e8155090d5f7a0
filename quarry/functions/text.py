"""Column functions over text: tokens, sentences, normal forms, answer and evidence scores.

All are built-in expressions but :func:`nfkc`, for which Spark has no function; it is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, which is wider than Java's \s.
WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: A word of letters, numbers and underscores, or one other character that is no white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: Sentence ends, and those the extractive answers know.
SENTENCE_ENDS, ASCII_ENDS = ".!?。！？", ".!?"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.size(tokens(c))


def truncate_tokens(c: Column, n: Column | int) -> Column:
    """The original text from its first token to the end of the ``n``-th, or all of it if it has no more tokens.

    ``n`` may differ by row, so the cut is found from the tokens' lengths and the gaps between them.
    """
    gaps = F.split(c, TOKEN, -1)
    n = F.least(n if isinstance(n, Column) else F.lit(n), F.size(tokens(c)))
    length = F.aggregate(F.slice(tokens(c), 1, n), F.lit(0), lambda s, t: s + F.length(t)) + F.aggregate(F.slice(gaps, 2, F.greatest(n - 1, F.lit(0))), F.lit(0), lambda s, t: s + F.length(t))
    return F.when(n <= 0, F.lit("")).otherwise(F.substring(c, F.length(F.get(gaps, F.lit(0))) + 1, length))


def sentences(c: Column | str, ends: str = SENTENCE_ENDS) -> Column:
    """Stripped, non-blank sentences; one ends where white space follows an end mark."""
    parts = F.split(strip(c), f"(?<=[{ends}]){WS}+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column | str) -> Column:
    """The form in which questions and passages are compared."""
    return collapse(nfkc(c))


def normalize_short_answer(c: Column | str) -> Column:
    """NFKC, lower case, no Unicode punctuation, no English articles, single spaces."""
    bare = F.regexp_replace(F.lower(nfkc(c)), r"\p{P}", "")
    return collapse(F.regexp_replace(bare, r"(?i)\b(a|an|the)\b", " "))


def normalize_paper_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.translate(F.lower(c), ASCII_PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def normalize_evidence(c: Column | str) -> Column:
    """Line ends as spaces, stripped."""
    return strip(F.translate(c, "\r\n", "  "))


def words_of(c: Column) -> Column:
    """Words of a normal form; none if it's empty."""
    return F.filter(F.split(c, " ", -1), lambda w: w != "")


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays share, repeats counted. For short arrays, such as answers."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def _f1(same: Column, n_pred: Column, n_ref: Column) -> Column:
    p, r = same / n_pred, same / n_ref
    return F.when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def short_answer_f1(pred: Column, ref: Column) -> Column:
    """Token F1 of two normal forms; an empty reference scores 1 for an empty prediction."""
    a, b = words_of(pred), words_of(ref)
    return F.when(F.size(b) == 0, (F.size(a) == 0).cast("double")).otherwise(_f1(multiset_overlap(a, b), F.size(a), F.size(b)))


def paper_answer_f1(pred: Column, ref: Column) -> Column:
    """Token F1 of two normal forms; 0 without overlap, both empty included."""
    a, b = words_of(pred), words_of(ref)
    return _f1(multiset_overlap(a, b), F.size(a), F.size(b))


def evidence_f1(pred: Column, gold: Column) -> Column:
    """F1 whose overlap is of sets and whose denominators are the lists' lengths; 1 if both are empty."""
    same = F.size(F.array_intersect(pred, gold))
    score = _f1(same, F.size(pred), F.size(gold))
    return F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0).when((F.size(pred) == 0) | (F.size(gold) == 0), 0.0).otherwise(score)


def contains_answer(body: Column, answer: Column) -> Column:
    """Whether the words of a normal form stand one after another in another."""
    space = F.lit(" ")
    return (answer != "") & F.contains(F.concat(space, body, space), F.concat(space, answer, space))


def passage_body(c: Column | str) -> Column:
    """The text after the first line end, all of it if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.instr(c, "\n") > 0, F.substring(c, F.instr(c, "\n") + 1, F.length(c))).otherwise(c)


def reference_answer(ref: Column) -> Column:
    """A paper reference's ``(answer, answer_type)``: unanswerable, spans, free form, yes or no, else empty."""
    spans = F.coalesce(ref["extractive_spans"], F.array().cast("array<string>"))
    free = F.coalesce(ref["free_form_answer"], F.lit(""))
    kinds = [
        (F.coalesce(ref["unanswerable"], F.lit(False)), F.lit("Unanswerable"), "none"), (F.size(spans) > 0, F.array_join(spans, ", "), "extractive"),
        (free != "", free, "abstractive"), (ref["yes_no"].isNotNull(), F.when(ref["yes_no"], "Yes").otherwise("No"), "boolean"),
    ]
    out = F.struct(F.lit("").alias("answer"), F.lit("abstractive").alias("answer_type"))
    for when, answer, kind in reversed(kinds):
        out = F.when(when, F.struct(answer.alias("answer"), F.lit(kind).alias("answer_type"))).otherwise(out)
    return out


def redact(c: Column | str) -> Column:
    """API keys masked."""
    return F.regexp_replace(c, r"\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED]")
