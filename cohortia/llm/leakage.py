"""Evaluation passages inside training documents: n-gram seeds, an exact bound, then local alignment."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
COMMON_MARKS = re.compile("[\u0300-\u036f]+")
MATCH, MISMATCH, GAP = 2, -1, 1


@lru_cache(maxsize=1)
def _combining() -> re.Pattern[str]:
    """All combining marks, as runs of code points."""
    marks = [i for i in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    runs, first = [], None
    for i, c in enumerate(marks):
        first = c if first is None else first
        if i + 1 == len(marks) or marks[i + 1] != c + 1:
            runs.append(f"{chr(first)}-{chr(c)}")
            first = None
    return re.compile(f"[{''.join(runs)}]+")


def fold(text: str) -> str:
    """Lower case without accents; ñ becomes n."""
    low = text.casefold()
    if low.isascii():
        return low
    plain = COMMON_MARKS.sub("", unicodedata.normalize("NFKD", low))
    return plain if plain.isascii() else _combining().sub("", plain).casefold()


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; whatever stands between two words is dropped."""
    return WORD.findall(fold(text)) if text else []


# ---------------------------------------------------------------- alignment

def smith_waterman(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(best local score, longest run of equal words in both, place in doc after the best alignment), row by row. Of equal scores
    the one reached after the fewest words of both counts, then that with fewest of the item."""
    same = item[:, None] == doc[None, :]
    gain = np.where(same, MATCH, MISMATCH).astype(np.int32)
    slope = GAP * np.arange(1, len(doc) + 1, dtype=np.int32)
    score = np.zeros((len(item) + 1, len(doc) + 1), dtype=np.int32)
    run = np.zeros_like(score)
    for i in range(len(item)):
        row = score[i, :-1] + gain[i]
        np.maximum(row, score[i, 1:] - GAP, out=row)
        np.maximum(row, 0, out=row)
        row += slope  # a gap along the row costs GAP a place: a running maximum on the slope
        np.maximum.accumulate(row, out=row)
        row -= slope
        score[i + 1, 1:] = row
        np.multiply(run[i, :-1] + 1, same[i], out=run[i + 1, 1:])
    top = int(score.max())
    place = min(zip(*np.nonzero(score == top)), key=lambda x: (x[0] + x[1], x[0]))[1] if top else 0
    return top, int(run.max()), int(place)


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What smith_waterman gives, of many pairs at once: along antidiagonals, with the pairs side by side. Word ids are >= 0 in
    items, -1 in parts for words that the item doesn't have."""
    rows, width, pairs = max(map(len, items)), max(map(len, parts)), len(items)
    kind = np.int16 if MATCH * rows + width < 2**15 else np.int32
    ids = np.int16 if max(int(x.max()) for x in items) < 2**15 and max(int(x.max()) for x in parts) < 2**15 else np.int32
    item, doc = np.full((rows, pairs), -2, ids), np.full((width + 2 * rows, pairs), -1, ids)
    for p, (x, y) in enumerate(zip(items, parts)):
        item[: len(x), p] = x
        doc[rows + width - len(y) : rows + width, p] = y[::-1]  # reversed, so that an antidiagonal is one slice
    score, run = ([np.zeros((rows + 1, pairs), kind) for _ in range(3)] for _ in range(2))
    best, longest, place = np.zeros(pairs, kind), np.zeros(pairs, kind), np.zeros(pairs, np.int32)
    same, cell, gap = np.empty((rows, pairs), bool), np.empty((rows, pairs), kind), np.empty((rows, pairs), kind)
    for d in range(rows + width - 1):  # cell (i, d - i); outside the part nothing is equal
        np.equal(item, doc[(at := rows + width - 1 - d) : at + rows], out=same)
        new, last, before = score[d % 3], score[(d + 2) % 3], score[(d + 1) % 3]
        np.multiply(same, kind(MATCH + GAP), out=cell)  # a gap and another word cost the same, taken off below
        cell += before[:-1]
        np.maximum(last[:-1], last[1:], out=gap)
        np.maximum(cell, gap, out=cell)
        cell -= kind(GAP)
        np.maximum(cell, 0, out=new[1:])
        top = new.max(axis=0)
        if len(more := np.nonzero(top > best)[0]):
            best[more] = top[more]
            place[more] = d + 2 - new[:, more].argmax(axis=0)
        now = run[d % 3]
        np.add(run[(d + 1) % 3][:-1], kind(1), out=now[1:])
        now[1:] *= same
        np.maximum(longest, now.max(axis=0), out=longest)
    return best, longest, place


# ---------------------------------------------------------------- an exact bound

NEAR = 4  # distances up to this are told apart


class Marks:
    """Which words each of many texts holds, and how soon one follows another, in two tables by hash. A clash says that a text holds a
    word which it doesn't, or holds it sooner, which only loosens the bound."""

    def __init__(self, owner: np.ndarray, flat: np.ndarray) -> None:
        """owner: whose word each place of flat is; -1 in flat ends a text."""
        there = flat >= 0
        self.words = np.zeros(1 << max(10, int(flat.size * 16).bit_length()), bool)
        self.words[self.slot(owner[there], flat[there], self.words)] = True
        self.soon = np.full(len(self.words) * NEAR // 2, NEAR + 1, np.int8)
        for d in range(NEAR, 0, -1):  # the least distance is written last
            both = there[:-d] & there[d:] & (owner[:-d] == owner[d:])
            self.soon[self.slot(owner[:-d][both], _pair(flat[:-d][both], flat[d:][both]), self.soon)] = d

    @staticmethod
    def slot(owner: np.ndarray, word: np.ndarray, table: np.ndarray) -> np.ndarray:
        mixed = owner.astype(np.uint32) * np.uint32(0x9E3779B1)
        mixed += word.astype(np.uint32) * np.uint32(0x85EBCA77)
        mixed ^= mixed >> np.uint32(15)
        mixed &= np.uint32(len(table) - 1)
        return mixed


def _pair(word: np.ndarray, following: np.ndarray) -> np.ndarray:
    return word.astype(np.uint32) * np.uint32(0xC2B2AE35) + (following.astype(np.uint32) ^ np.uint32(0x27D4EB2F))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers in the ranges [low, high)."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)


def trim(flat: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, marks: Marks, min_score: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, from, to) of the parts of the stretches flat[low:high] in which an alignment with text `key` can reach min_score.

    A word of an alignment adds at most MATCH if the text holds it and costs at least 1 if not. Take two words, both held by the text,
    g apart and with none held between: if the text never has the second less than m behind the first, matching both
    costs m - g more. Leaving a word out that could match loses MATCH + 1, half of it for either side, so the
    extra cost of the side counts up to that half. No alignment over some words scores above the sum of these values, and words
    through which no sum reaches min_score belong to none. The greatest sum through a word is the greatest that ends
    there plus the greatest that begins there: two running extremes. All values are doubled to stay whole.
    """
    usable = np.nonzero(flat >= 0)[0]
    job, at = _ranges(np.searchsorted(usable, low), np.searchsorted(usable, high))
    at = usable[at]
    own = flat[at]
    held = marks.words[Marks.slot(key[job], own, marks.words)]
    job, at, own = job[held], at[held], own[held]
    if not len(job):
        return job, at, at
    apart = np.diff(at)
    soon = marks.soon[Marks.slot(key[job[1:]], _pair(own[:-1], own[1:]), marks.soon)]
    edge = np.empty(len(job), np.int64)
    edge[1:] = 2 * (apart - 1) + np.clip(2 * (soon - apart), 0, MATCH + 1)
    wall = 2 * MATCH * (int((high - low).max()) + 1)  # between two stretches
    edge[0] = wall
    new = job[1:] != job[:-1]
    edge[1:][new] = wall
    sums = np.cumsum(2 * MATCH - edge)
    ending = sums + 2 * MATCH - np.minimum.accumulate(sums)
    rest = np.maximum.accumulate(sums[::-1])[::-1] - sums
    kept = ending + rest >= 2 * min_score
    opens = np.ones(len(job), bool)  # no sum that is great enough crosses the side before
    opens[1:] = new | (ending[:-1] - edge[1:] + 2 * MATCH + rest[1:] < 2 * min_score)
    first = np.nonzero(kept & opens)[0]
    after = opens | ~kept
    stops = np.append(np.nonzero(after)[0], len(job))
    last = stops[np.searchsorted(stops, first + 1)] - 1
    return job[first], at[first], at[last] + 1


# ---------------------------------------------------------------- the items as arrays

@dataclass
class ItemIndex:
    """The query set as sorted arrays: word ids, n-grams built up word by word, and the items of each n-gram."""

    n: int
    ids: list[int]
    words: dict[str, int]
    levels: list[np.ndarray]  # level j: sorted keys (id of the run of j + 1 words) * number of words + next word
    first: np.ndarray  # items of n-gram g: holders[first[g] : first[g + 1]]
    holders: np.ndarray
    flat: np.ndarray  # the items' words in a row, -1 between two
    begin: np.ndarray  # place of each item in flat
    length: np.ndarray
    marks: Marks

    @classmethod
    def build(cls, ids: list[int], texts: list[list[str]], n: int) -> ItemIndex:
        words: dict[str, int] = {}
        tokens = [np.array([words.setdefault(w, len(words)) for w in t], np.int64) for t in texts]
        flat = np.concatenate([np.append(t, -1) for t in tokens] or [np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(tokens)), [len(t) + 1 for t in tokens])
        levels: list[np.ndarray] = []
        at, run = np.nonzero(flat >= 0)[0], flat[flat >= 0]
        for j in range(1, n):
            key, at = _extend(flat, at, run, j, len(words))
            level, run = np.unique(key, return_inverse=True)
            levels.append(level)
        pairs = np.unique(run * max(len(tokens), 1) + owner[at])
        grams, holders = np.divmod(pairs, max(len(tokens), 1))
        first = np.searchsorted(grams, np.arange((int(run.max()) + 1 if len(run) else 0) + 1))
        begin = np.cumsum([0, *(len(t) + 1 for t in tokens)])[:-1]
        return cls(n, ids, words, levels, first, holders, flat, begin, np.array([len(t) for t in tokens], np.int64), Marks(owner, flat))

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every item n-gram in a row of word ids, -1 where no item has the word or a text ends."""
        at = np.nonzero(flat >= 0)[0]
        run = flat[at]
        for j, level in enumerate(self.levels, 1):
            key, at = _extend(flat, at, run, j, len(self.words))
            if not len(level):
                return at[:0], at[:0]
            run = np.minimum(np.searchsorted(level, key), len(level) - 1)
            known = level[run] == key
            at, run = at[known], run[known]
        many = self.first[run + 1] - self.first[run] if len(run) else run
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.holders[np.repeat(self.first[run], many) + inner]


def _extend(flat: np.ndarray, at: np.ndarray, run: np.ndarray, j: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    inside = at + j < len(flat)
    at, run = at[inside], run[inside]
    following = flat[at + j]
    there = following >= 0
    return run[there] * words + following[there], at[there]


# ---------------------------------------------------------------- documents against the index

def _stretches(doc: np.ndarray, item: np.ndarray, at: np.ndarray, reach: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Rows (document, item, from, to): hits of a pair no more than 2 * reach apart form one stretch, widened by reach on both sides.

    A local alignment of an item of `reach` words spans at most 3 * reach words, as each gap costs half a match; longer
    stretches are cut into pieces that overlap by that much, and no alignment is lost.
    """
    opens = np.ones(len(at), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * reach[item[1:]])
    a = np.nonzero(opens)[0]
    z = np.append(a[1:], len(at)) - 1
    d, k = doc[a], item[a]
    low = np.maximum(at[a] - reach[k], begin[d])
    high = np.minimum(at[z] + n + reach[k], end[d])
    piece, step = 20 * reach[k], 17 * reach[k]
    many = 1 + np.maximum(0, -(-(high - low - piece) // np.maximum(step, 1)))
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    d, k, low, high, piece, step = (np.repeat(x, many) for x in (d, k, low, high, piece, step))
    low = low + turn * step
    return np.stack([d, k, low, np.minimum(high, low + piece)], axis=1)


def leaks_in(texts: list[str | None], index: ItemIndex, min_score: int, together: int = 512, room: int = 2_000_000) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, item, score, longest run, from, to) of every document and item that share a seed and score min_score or more; the
    best passage counts. Passages of like size are aligned `together` at a time, stretches bounded `room` words at a time."""
    rows = [list(map(index.words.get, words_of(t), repeat(-1))) for t in texts]
    size = np.array([len(r) + 1 for r in rows], np.int64)
    end = np.cumsum(size) - 1
    begin = end - size + 1
    flat = np.full(int(size.sum()), -1, np.int64)
    flat[np.concatenate([np.arange(b, e) for b, e in zip(begin, end)] or [np.empty(0, np.int64)])] = [w for r in rows for w in r]
    at, item = index.hits(flat)
    if not len(at):
        return
    doc = np.searchsorted(end, at, side="left")
    order = np.lexsort((at, item, doc))
    jobs = _stretches(doc[order], item[order], at[order], index.length, begin, end, index.n)
    turn = np.cumsum(jobs[:, 3] - jobs[:, 2]) // room
    edges = np.concatenate([[0], np.nonzero(np.diff(turn))[0] + 1, [len(jobs)]])
    pieces = [_passages(flat, jobs[a:b], index, min_score) for a, b in zip(edges[:-1], edges[1:])]
    doc, item, low, high, first, last = (np.concatenate(x) for x in zip(*pieces))
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    order = np.lexsort((last - first, (high - low) // 32))
    for j in range(0, len(order), together):
        block = order[j : j + together]
        score, run, place = align([index.flat[x:y] for x, y in zip(first[block], last[block])], [flat[x:y] for x, y in zip(low[block], high[block])])
        for q, s, r, p in zip(block.tolist(), score.tolist(), run.tolist(), place.tolist()):
            if s < min_score:
                continue
            pair, at = (int(doc[q]), int(item[q])), int(low[q])
            best = found.get(pair, (0, 0, 0, 0))
            better = (s, at, at + p) if (s, -at) > (best[0], -best[2]) else (best[0], *best[2:])
            found[pair] = (better[0], max(r, best[1]), *better[1:])
    for (d, k), (s, r, at, to) in found.items():
        yield d, k, s, r, int(at - begin[d]), int(to - begin[d])


def _passages(flat: np.ndarray, jobs: np.ndarray, index: ItemIndex, min_score: int) -> tuple[np.ndarray, ...]:
    """(document, item, from, to, item from, item to) of what is left of some stretches when both sides are trimmed."""
    job, low, high = trim(flat, jobs[:, 1], jobs[:, 2], jobs[:, 3], index.marks, min_score)
    doc, item = jobs[job, 0], jobs[job, 1]
    passage, place = _ranges(low, high)
    ends = index.begin[item] + index.length[item]
    at, first, last = trim(index.flat, np.arange(len(job)), index.begin[item], ends, Marks(passage, flat[place]), min_score)
    return doc[at], item[at], low[at], high[at], first, last


OUT = "doc_id bigint, item_id bigint, puntaje int, racha int, desde int, hasta int"


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = 5, min_score: int = 16, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, puntaje, racha, desde, hasta): documents that hold passages of the items.

    1. Every n-gram of an item is a seed, however frequent and at every size of the corpus: each document and item that share one
       make a candidate, also an edited copy in which n words in a row are left.
    2. Around the seeds only those words are kept through which an alignment could reach min_score (see passages); this
       bound is exact and drops nothing that would be reported.
    3. What is left is aligned by Smith-Waterman over words. `puntaje` is the best score (match 2, other word -1,
       gap -1), which tolerates edits; `racha` the longest run of equal consecutive words in such a passage; desde and hasta
       the words between which it lies. Pairs below min_score are left out; min_score is at least 1.

    The items are the stated query set: they come to the driver in blocks of at most block_words words and go to the tasks
    as arrays, so what is broadcast has a bound in bytes; up to that many words the corpus is read once. It is never
    shuffled. Words are runs of letters and digits without case and accents. Empty and missing texts hold nothing, items
    of fewer than n words can't be found; copies of a document or of an item each give their own rows; empty tables
    give no rows.
    """
    out: DataFrame | None = None
    spark = docs.sparkSession
    pairs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    for ids, texts in _blocks(items.select(item_id, item_text).orderBy(item_id), block_words):
        sent = spark.sparkContext.broadcast(ItemIndex.build(ids, texts, n))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = [
                    (docs[i + j], index.ids[k], score, run, a, z)
                    for i, to in _portions(texts)
                    for j, k, score, run, a, z in leaks_in(texts[i:to], index, max(min_score, 1))
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                columns = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "puntaje", "racha", "desde", "hasta"])

        part = pairs.mapInArrow(search, OUT)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], OUT) if out is None else out


def _portions(texts: list[str | None], most: int = 2000, most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """The texts in portions that fit in memory together with their arrays; a longer text is a portion by itself."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and (i - first == most or size + n > most_chars):
            yield first, i
            first, size = i, 0
        size += n
    if texts:
        yield first, len(texts)


def _blocks(items: DataFrame, most_words: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """The query set in blocks; at most one partition's rows wait on the driver."""
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        words = words_of(r[1])
        if ids and size + len(words) > most_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(words)
        size += len(words)
    if ids:
        yield ids, texts
