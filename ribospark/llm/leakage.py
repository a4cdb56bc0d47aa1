"""Evaluation passages inside a training corpus.

Words are compared without case, accents, punctuation, white space, invisible characters and line-end hyphens; a hyphen,
an apostrophe and a blank part words alike. The n-grams of the evaluation items are counted over the corpus, the rare
ones seed the search: a table bounded by the evaluation set meets the n-grams of every document, and each document
region that a seed anchors is aligned with the item by Smith-Waterman. A document leaks an item if the alignment holds a
run of enough item words with few enough edits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The items are sent to the workers in blocks of at most so many words; each block is searched in all documents.
MAX_ITEM_WORDS = 500_000
MATCH = 3

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]+")
_LINE_HYPHEN = re.compile("[-‐‑¬][ \t\r\x0b\x0c]*\n\\s*")
_GLUE = re.compile("['’ʼ‐‑-]")
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """A text without all that doesn't count but the marks that part words."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    text = _LINE_HYPHEN.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words(text: str | None, joined: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The words of a text as they are compared; those in ``joined`` are taken apart as it says."""
    found = _WORD.findall(plain(text)) if text else []
    if joined and not joined.keys().isdisjoint(found):
        found = [p for w in found for p in joined.get(w, (w,))]
    return found


def written_words(text: str, joined: dict[str, tuple[str, ...]]) -> list[int]:
    """For each of ``words``, the number of the word as written that it belongs to: `fifty-three` is one."""
    text, out, at, number = plain(text), [], 0, -1
    for m in _WORD.finditer(text):
        number += not (out and _GLUE.fullmatch(text, at, m.start()))
        out += [number] * len(joined.get(m[0], "x"))
        at = m.end()
    return out


def spellings(texts: Iterable[str | None]) -> dict[str, tuple[str, ...]]:
    """Joined form -> parts of the words of the items that no blank parts, such as `fifty-three`, as a document may join them."""
    found: dict[str, tuple[str, ...]] = {}
    for text in texts:
        for group in plain(text or "").split():
            parts = _WORD.findall(group)
            for a in range(len(parts)):
                for b in range(a + 2, len(parts) + 1):
                    found["".join(parts[a:b])] = tuple(parts[a:b])
    for w in sorted(found, key=len):  # parts are shorter, so they have been taken apart already
        found[w] = tuple(q for p in found[w] for q in found.get(p, (p,)))
    return found


@dataclass(frozen=True)
class Leak:
    """``run`` item words with at most one edit in ``per_edit`` of them make a leak; seeds have ``n`` words.

    A run of 15 words with 2 edits keeps 4 intact seeds of 4 words at least, however the edits lie.
    """

    run: int = 15
    per_edit: int = 8
    n: int = 4

    def edits(self, span: int) -> int:
        return span // self.per_edit

    def least_words(self) -> int:
        return self.run - self.edits(self.run)

    def least_score(self) -> int:
        """A score that the alignment of any leak reaches; a changed word may be up to three parts of one."""
        spans = range(self.run, self.run + self.per_edit)
        return min(MATCH * (span - self.edits(span)) - 3 * self.edits(span) for span in spans)

    def spare(self) -> int:
        """Seeds that may be left out of every run's worth of seeds without losing all intact ones."""
        lost = (self.edits(self.run) + 1) * self.n
        return max(0, self.run - self.n + 1 - lost - 1)


def seed_grams(ws: list[str], rule: Leak) -> list[tuple[str, ...]]:
    """The n-grams of an item, in order; none of one shorter than a run: it can't leak."""
    return list(zip(*(ws[k:] for k in range(rule.n)), strict=False)) if len(ws) >= rule.run else []


def rare_seeds(items: dict[int, list[str]], rule: Leak, documents: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[int]]:
    """Seed n-gram -> its items. Of each item the n-grams that are more common in the corpus than its median one are left
    out, most common first; ``documents`` has the number of documents that hold an n-gram.

    An n-gram is only left out of an item where every run of that item's words keeps so many seeds that one of them
    survives the allowed edits, so no leak is lost.
    """
    per_run, spare = rule.run - rule.n + 1, rule.spare()
    seeds: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for item, ws in items.items():
        gs = seed_grams(ws, rule)
        counts = [documents.get(g, 0) for g in gs]
        median = sorted(counts)[len(counts) // 2] if counts else 0
        dropped = np.zeros(len(gs), bool)
        for k in sorted((k for k in range(len(gs)) if counts[k] > median), key=lambda k: -counts[k]):
            dropped[k] = True
            around = dropped[max(0, k - per_run + 1) : k + per_run].astype(int)
            if np.convolve(around, np.ones(per_run, int)).max() > spare:
                dropped[k] = False
        for g in dict.fromkeys(g for g, d in zip(gs, dropped, strict=True) if not d):
            seeds[g].append(item)
    return dict(seeds)


Step = tuple[int, int]


def align(doc: np.ndarray, item: np.ndarray) -> list[Step]:
    """Smith-Waterman over word codes (mismatch and gap -1): the best local path.

    A match scores ``MATCH``, so much that the first or last words of a run are kept across two edits beside them.
    A step of the path is (place in doc, place in item), -1 on the side where no word is consumed.
    """
    n, m = len(doc), len(item)
    score = np.zeros((n + 1, m + 1), np.int32)
    gaps = np.arange(m + 1, dtype=np.int32)
    same = np.where(doc[:, None] == item, MATCH, -1).astype(np.int32)
    row = np.zeros(m + 1, np.int32)
    for i in range(1, n + 1):
        np.maximum(score[i - 1, :-1] + same[i - 1], score[i - 1, 1:] - 1, out=row[1:])
        np.maximum(row, 0, out=row)
        # gaps along the item: the best of any earlier cell less its distance
        score[i] = np.maximum.accumulate(row + gaps) - gaps
    i, j = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    path = []
    while score[i, j] > 0:
        if i and j and score[i, j] == score[i - 1, j - 1] + same[i - 1, j - 1]:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif i and score[i, j] == score[i - 1, j] - 1:
            i -= 1
            path.append((i, -1))
        else:
            j -= 1
            path.append((-1, j))
    return path[::-1]


def holds_run(path: list[Step], doc: Sequence, item: Sequence, rule: Leak, doc_words: Sequence[int], item_words: Sequence[int]) -> bool:
    """Whether some stretch of an alignment has ``run`` item words or more and no more edits than they allow.

    Words are counted by their numbers, ``doc_words`` and ``item_words``. Between two matches, changed and missing item
    words or changed and added document words are edits, whichever are more. Changed or missing words at the ends of a
    run count as well, as far as the item has words there.
    """
    hits = [i >= 0 and j >= 0 and doc[i] == item[j] for i, j in path]
    for a, hit in enumerate(hits):
        if not hit:
            continue
        first, edits = item_words[path[a][1]], 0
        lost, new = set(), set()
        for (i, j), hit in zip(path[a:], hits[a:], strict=True):
            if not hit:
                lost |= {item_words[j]} if j >= 0 else set()
                new |= {doc_words[i]} if i >= 0 else set()
                continue
            edits += max(len(lost), len(new))
            lost, new = set(), set()
            last = item_words[j]
            span = last - first + 1
            more = max(0, rule.run - span)
            if more <= first - item_words[0] + item_words[-1] - last and edits + more <= rule.edits(span + more):
                return True
    return False


class Index:
    """The items' words, seeds and word codes, as every worker needs them."""

    def __init__(self, rows: list[tuple[int, str]], rule: Leak):
        self.rule = rule
        self.joined = spellings(t for _, t in rows)
        self.items = {i: words(t, self.joined) for i, t in rows}
        self.written = {i: written_words(t, self.joined) for i, t in rows}
        self.codes: dict[str, int] = {}
        codes = self.codes
        self.coded = {i: np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64) for i, ws in self.items.items()}
        self.grams = frozenset(g for ws in self.items.values() for g in seed_grams(ws, rule))
        self.seeds = rare_seeds(self.items, rule, {})

    def choose(self, documents: dict[tuple[str, ...], int]) -> None:
        """Keeps the seeds that are rare in the corpus."""
        self.seeds = rare_seeds(self.items, self.rule, documents)

    def held(self, text: str | None) -> frozenset[tuple[str, ...]]:
        """The items' n-grams that a text holds."""
        ws = words(text, self.joined)
        return self.grams.intersection(zip(*(ws[k:] for k in range(self.rule.n)), strict=False))

    def leaks(self, text: str | None) -> list[int]:
        ws, n, seeds = words(text, self.joined), self.rule.n, self.seeds
        grams = list(zip(*(ws[k:] for k in range(n)), strict=False))
        if seeds.keys().isdisjoint(grams):
            return []
        hits: dict[int, list[int]] = defaultdict(list)
        for p, g in enumerate(grams):
            if g in seeds:
                for item in seeds[g]:
                    hits[item].append(p)
        written = written_words(text, self.joined)
        return [item for item, at in hits.items() if any(self._leaks(ws, written, item, a, b) for a, b in self._regions(item, at, len(ws)))]

    def _regions(self, item: int, at: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Stretches of the document that hold every alignment with the item through one of the seeds at ``at``."""
        reach = len(self.items[item]) * (self.rule.per_edit + 1) // self.rule.per_edit + self.rule.n
        start = end = None
        for p in at:
            a, b = max(0, p - reach), min(size, p + reach)
            if end is not None and a <= end:
                end = b
            else:
                if end is not None:
                    yield start, end
                start, end = a, b
        yield start, end

    def _leaks(self, ws: list[str], written: list[int], item: int, a: int, b: int) -> bool:
        """Aligns a region; where its best path holds no run, what lies on either side of the path is aligned in turn.

        A run may be counted in words as written or in their parts.
        """
        coded, parts = self.coded[item], [(a, b)]
        while parts:
            a, b = parts.pop()
            if b - a < self.rule.least_words():
                continue
            doc = np.array([self.codes.get(w, -1) for w in ws[a:b]], np.int64)
            path = align(doc, coded)
            score = sum(MATCH if i >= 0 and j >= 0 and doc[i] == coded[j] else -1 for i, j in path)
            if score < self.rule.least_score():
                continue
            for own, its in ((range(b - a), range(len(coded))), (written[a:b], self.written[item])):
                if holds_run(path, doc, coded, self.rule, own, its):
                    return True
            used = [i for i, _ in path if i >= 0]
            parts += [(a, a + used[0]), (a + used[-1] + 1, b)]
        return False


def seed_frequencies(documents: DataFrame, index: Broadcast, grams: list[tuple[str, ...]]) -> DataFrame:
    """(seed, n): the number of documents that hold each of the items' n-grams, by its place in ``grams``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = index.value, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(known.held(text))
        found = [(k, total[g]) for k, g in enumerate(grams) if g in total] if total else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["seed", "n"])

    return documents.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))


def leaked(documents: DataFrame, items: DataFrame, rule: Leak = Leak()) -> DataFrame:
    """(doc_id, item_id): every document that holds a run of an evaluation item's words, with few edits.

    ``documents`` needs doc_id and text, ``items`` item_id and item_text; other columns are ignored. Null, empty and
    blank texts leak nothing; items of fewer words than a run can't leak. Repeated rows give repeated results, a
    document that holds an item twice gives one row. Whole texts are searched, whatever their length.

    The items are sent to the workers in blocks of at most ``MAX_ITEM_WORDS`` words, by a size that is checked first.
    Each block reads all documents twice: to count its n-grams, and to search for the rare ones.
    """
    spark = documents.sparkSession
    documents = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    sized = items.where(F.col("item_text").isNotNull()).select(
        "item_id", "item_text", (F.length("item_text") / 2 + 1).cast("bigint").alias("size")
    )
    total = sized.select(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-total // MAX_ITEM_WORDS))
    kinds = [documents.schema["doc_id"].dataType, items.schema["item_id"].dataType]
    item_kind = to_arrow_type(kinds[1])
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}"
    out = None
    for block in range(blocks):
        own = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "item_text")
        known = Index([(r.item_id, r.item_text) for r in own.collect()], rule)
        grams = sorted(known.grams)
        if grams:
            # at most one row for each n-gram of the block
            rows = seed_frequencies(documents, spark.sparkContext.broadcast(known), grams).collect()
            known.choose({grams[r.seed]: r.n for r in rows})
        index = spark.sparkContext.broadcast(known)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                at, found = [], []
                for k, text in enumerate(texts):
                    for i in known.leaks(text):
                        at.append(k)
                        found.append(i)
                docs = batch.column("doc_id").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array(found, item_kind)], ["doc_id", "item_id"])

        found = documents.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
