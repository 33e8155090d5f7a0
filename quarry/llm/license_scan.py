"""Licence scans with a generalised suffix automaton of licence texts and notices.

Texts are lower-cased (A to Z) and cut into words of digits, letters and non-ASCII characters. The templates' words, those of whole licence
texts and of short notices, form one automaton (fixed, so it travels with the task), whose states know the places where their words stand. A
file's words stream through it: the matching statistic at a word is the longest match with any template that ends there, and the state and its
suffix links give every template that matches ``min_words`` words or more, with its place; matches that go on from word to word on the same
diagonal are one.

The matches are chained per template in order of both file and template. A notice is found where a chain covers ``min_cover`` of it
within a span that is at most ``max_stretch`` times as long. A licence text is found, in part or whole, where a chain without gaps of over
``most_gap`` words covers ``min_passage`` of its words, or ``min_cover`` of it; where licences share wording, the one whose chain covers
more of a place keeps it, and all that cover as much.

Base places are where a phrase of :data:`PHRASES` stands word by word; they are found on the same word stream, and their
labels stay whatever the method adds.

Edge cases: null and empty texts have no words, no labels and score 0; very long texts stream through the automaton whole; equal texts get equal
results; repeated rows give a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import license_texts
from quarry.llm.common import in_batches
from quarry.llm.substring_dedup import Automaton

NOTICES, PHRASES, TEXTS = license_texts.NOTICES, license_texts.PHRASES, license_texts.TEXTS

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A to Z are lower-cased; others become a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Scanner:
    """The automaton of all templates, and chains of what a file matches of them."""

    def __init__(self, notices=NOTICES, texts=TEXTS, phrases=PHRASES, min_words: int = 3, min_cover: float = 0.8, max_stretch: float = 1.5, min_passage: int = 25, most_gap: int = 8):
        self.min_words, self.min_cover, self.max_stretch, self.min_passage, self.most_gap = min_words, min_cover, max_stretch, min_passage, most_gap
        self.labels = [label for label, _ in [*notices, *texts]]
        self.first_text = len(notices)
        templates = [words_of(t) for _, t in [*notices, *texts]]
        every = [w for t in templates for w in t] + [w for p in phrases for w in p.encode().split()]
        self.ids = {w: k + 1 for k, w in enumerate(dict.fromkeys(every))}
        self.phrases = [([self.ids[w] for w in p.encode().split()], label) for p, label in phrases.items()]
        self.phrase_heads = {p[0] for p, _ in self.phrases}
        self.sizes = [len(t) for t in templates]
        numbered = [[self.ids[w] for w in t] for t in templates]
        self.automaton = Automaton()
        for t in numbered:
            self.automaton.feed(t)
        self.places = self._places(numbered)

    def _places(self, templates: list[list[int]]) -> list[list[tuple[int, int]]]:
        """For each state of ``min_words`` words or more, ``(template, place of the last word)`` of all its occurrences."""
        nxt, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        out: list[list[tuple[int, int]]] = [[] for _ in nxt]
        for k, t in enumerate(templates):
            state = 0
            for i, c in enumerate(t):
                state = nxt[state][c]
                out[state].append((k, i))
        for state in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):  # a state's occurrences are also its suffix's
            if length[link[state]] >= self.min_words:
                out[link[state]] += out[state]
        return [p if length[s] >= self.min_words else [] for s, p in enumerate(out)]

    def matches(self, ids: list[int], begin: int, end: int) -> dict[int, list[tuple[int, int, int]]]:
        """For each template the maximal matches ``(start, start in the template, length)`` of ``ids[begin:end]``, of ``min_words`` or more."""
        nxt, link, length, least = self.automaton.next, self.automaton.link, self.automaton.length, self.min_words
        state = size = 0
        running: dict[tuple[int, int], int] = {}  # (template, diagonal) -> start
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(begin, end):
            c = ids[i]
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            now: dict[tuple[int, int], int] = {}
            at, here = state, size
            while here >= least:
                for k, e in self.places[at]:
                    key = (k, i - e)
                    if key not in now:
                        now[key] = running.pop(key, i - here + 1)
                at = link[at]
                here = length[at]
            for (k, shift), start in running.items():
                found.setdefault(k, []).append((start, start - shift, i - start))
            running = now
        for (k, shift), start in running.items():
            found.setdefault(k, []).append((start, start - shift, end - start))
        return found

    def scan(self, words: list[bytes]) -> dict:
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        base, firsts = [], []
        heads = self.phrase_heads
        matched: dict[int, list[tuple[int, int, int]]] = {}
        # Runs of known words; only they can match anything.
        for run in _runs(ids):
            a, z = run
            if z - a >= self.min_words:
                for k, pieces in self.matches(ids, a, z).items():
                    matched.setdefault(k, []).extend(pieces)
            for i in range(a, z - 1):
                if ids[i] in heads:
                    for p, label in self.phrases:
                        if ids[i : i + len(p)] == p:
                            base.append(label), firsts.append(i)
        found, best = self._chains(matched)
        labels = sorted({*base, *(label for label, _, _ in found)})
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
            "base_labels": ",".join(sorted(set(base))), "labels": ",".join(labels), "score": 1.0 if base else best, "spans": found,
        }

    def _chains(self, matched: dict[int, list[tuple[int, int, int]]]):
        """Colinear chains: ``[(label, start, end)]`` in file words, and the best covered part of any template's wanted words."""
        notices, passages, best = [], [], 0.0
        for k, pieces in matched.items():
            total, is_text = self.sizes[k], k >= self.first_text
            reach = max(total + 1, int(total * self.max_stretch))
            wanted = min(self.min_passage, self.min_cover * total) if is_text else self.min_cover * total
            pieces = sorted(p for p in pieces if p[2] >= min(self.min_words, total))
            score, since, open_, low = [], [], [], 0
            ending: dict[int, list[int]] = {}  # where pieces end -> which
            for n, (s, a, m) in enumerate(pieces):
                score.append(m), since.append(s), open_.append(True)
                while pieces[low][0] < s - reach:
                    low += 1
                # A text's chain goes on from what ended within the gap, a notice's from all within its reach.
                near = [o for z in range(s - self.most_gap, s + 1) for o in ending.get(z, ())] if is_text else range(low, n)
                before = None
                for o in near:
                    s2, a2, m2 = pieces[o]
                    gap = a - a2 - m2
                    close = gap <= self.most_gap if is_text else s2 + m2 <= s and s + m - since[o] <= reach
                    if gap >= 0 and close and score[o] + m > score[n]:
                        score[n], since[n], before = score[o] + m, since[o], o
                if before is not None:
                    open_[before] = False
                ending.setdefault(s + m, []).append(n)
                best = max(best, min(1.0, score[n] / wanted * (1.0 if is_text else self.min_cover)))
                if score[n] >= wanted and not is_text:
                    notices.append((self.labels[k], since[n], s + m))
            if is_text:
                passages += [(since[n], s + m, score[n], self.labels[k]) for n, (s, _, m) in enumerate(pieces) if open_[n] and score[n] >= wanted]
        return sorted({*notices, *_widest(passages)}, key=lambda f: (f[1], f[2], f[0])), best


def _widest(passages: list[tuple[int, int, int, str]]) -> set[tuple[str, int, int]]:
    """Of ``(start, end, covered words, label)`` those that no other label's passage covers better where they lie."""
    passages = sorted(passages)
    starts, longest = [p[0] for p in passages], max((z - a for a, z, _, _ in passages), default=0)
    kept = set()
    for a, z, n, label in passages:
        beside = passages[bisect_left(starts, a - longest) : bisect_left(starts, z)]
        if not any(more > n and other != label and a < z2 for _, z2, more, other in beside):
            kept.add((label, a, z))
    return kept


def _runs(ids: list[int]):
    """``(start, end)`` of maximal runs of non-zero ids."""
    raw = bytes(1 if i else 0 for i in ids)
    return [m.span() for m in _KNOWN.finditer(raw)]


_KNOWN = re.compile(rb"\x01{2,}")


@lru_cache(maxsize=4)
def scanner(**options) -> Scanner:
    return Scanner(**options)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3, min_cover: float = 0.8) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``, a row per input row; ``spans`` are
    the covered places of notices, in words."""

    def run(batch):
        s = scanner(min_words=min_words, min_cover=min_cover)
        rows = [s.scan(words_of(t)) for t in batch.column(1).to_pylist()]
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        out = {"doc_id": batch.column(0)} | {k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()}
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        out["spans"] = pa.array([[{"label": a, "start": b, "end": c} for a, b, c in r["spans"]] for r in rows], pa.list_(span))
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(in_batches(run), schema)
