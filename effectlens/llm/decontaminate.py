"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max bounds.

Every document is cut into passages of overlapping words, so that each test item that it holds lies
whole within one of them, and every passage is a query.  The index keeps, for each term, its largest
contribution to any item and to any block of items.  A passage whose terms cannot reach the
threshold of any item is left at once; for the others only blocks whose bound reaches a threshold
are scored.  All items scoring at least ``share`` of what they would score against themselves are
retrieved, and a hit counts if the passage also holds the item's question, its answer, and its
five-word shingles.

An item's question is what stands up to its last question mark, its answer what follows; without a
question mark the last sentence is the answer, and of a single sentence the last quarter.

Document frequencies are of all items.  The index is built and sent out in shards of at most
``shard_items`` items and ``shard_bytes`` bytes of text, one pass over the documents for each.  With
more than one shard the result of a pass is stored and its index dropped before the next is built, so
that what is broadcast stays bounded however many items there are.

Edge cases: null or empty documents hold nothing; null or empty items are never found.  Items of
fewer than five words are one shingle as a whole.  Equal items are each reported; texts of one item id
are an item each, and the best of them is reported.  Repeated rows are reported once; ``decontaminated``
takes or leaves each row by its own text, ids or none.  Ids of items are taken as integers.  Empty tables
give an empty result.  Further columns are ignored, or kept as they are by ``decontaminated``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import frugal, slices, small_batches, stored

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
WIDTH = 5
BLOCK = 16
BATCH_BYTES = 1_500_000
TOGETHER = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    at = text.rfind("?") + 1
    if not words_of(text[at:]):
        at = 0
    if not at:
        ends = [m.end() for m in re.finditer(r"[.!?:]\s+|\n", text.rstrip())]
        at = next((e for e in reversed(ends) if words_of(text[:e]) and words_of(text[e:])), 0)
    if at:
        return words_of(text[:at]), words_of(text[at:])
    words = words_of(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def held(part: list[str], passage: Counter[str]) -> float:
    """The share of a part's words, with repeats, that the passage has."""
    return sum((Counter(part) & passage).values()) / len(part) if part else 1.0


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(WIDTH, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in a row, and the range of each."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (start - np.cumsum(size) + size)[of], of


@dataclass
class Index:
    """Items in blocks, and for each term the blocks that have it with its largest impact there."""

    ids: np.ndarray
    parts: list[tuple[list[str], list[str], list[str]]]  # all words, question, answer
    terms: dict[str, int]
    most: np.ndarray  # of each term, to any item
    first: np.ndarray  # of each term, its first (term, block) entry
    block: np.ndarray
    block_most: np.ndarray
    posting: np.ndarray  # of each entry, its first posting
    item: np.ndarray
    impact: np.ndarray
    need: np.ndarray  # of each item, the score that is enough
    block_need: np.ndarray
    key: np.ndarray  # of each entry, its term and block as one number
    span: int  # words that the longest item has

    @staticmethod
    def build(rows: list[tuple[int, str]], df: dict[str, int], items: int, mean: float, share: float) -> Index:
        split = [(words_of(t), *question_and_answer(t)) for _, t in rows]
        whole = []
        for words, *_ in split:
            norm = K1 * (1 - B + B * len(words) / mean)
            whole.append({t: math.log(1 + (items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(words).items()})
        # Items that share terms come to lie in one block if they are sorted by their words.
        order = sorted(range(len(rows)), key=lambda i: (sorted(split[i][0])[: 3 * WIDTH], rows[i][0]))
        terms = {t: k for k, t in enumerate(sorted({t for w in whole for t in w}))}
        flat = sorted((terms[t], at, x) for at, i in enumerate(order) for t, x in whole[i].items())
        term, item, impact = (np.array([f[k] for f in flat], kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        head = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)])
        first = np.searchsorted(term[head], np.arange(len(terms) + 1))
        need = np.array([share * sum(whole[i].values()) for i in order])
        return Index(
            np.array([rows[i][0] for i in order], np.int64), [split[i] for i in order], terms, np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(terms)))), first, item[head] // BLOCK,
            np.maximum.reduceat(impact, head), np.r_[head, len(item)], item, impact, need, np.minimum.reduceat(need, np.arange(0, len(need), BLOCK)), term[head] * -(-len(need) // BLOCK) + item[head] // BLOCK, max(len(w[0]) for w in split),
        )

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item by place, score) of the items whose score is enough, of n passages given as distinct (passage, term) pairs.

        Terms of a passage go by how much they can add, least first.  Those that together stay under the least
        score that any block asks for can't lift an item on their own: blocks that only they are in are skipped
        unseen.  Of the blocks that the others reach, the bound is completed, and only those whose bound is
        enough have their postings read.  Passages are taken together, about ``TOGETHER`` entries at a time.
        """
        blocks, least = len(self.block_need), self.need.min() - 1e-9
        order = np.lexsort((self.most[term], passage))
        passage, term = passage[order], term[order]
        ends = np.searchsorted(passage, np.arange(n), "right")
        cost = np.cumsum(np.bincount(passage, self.first[term + 1] - self.first[term], n) + blocks)
        out, at = [], 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + TOGETHER, "right")))
            low, high = (ends[at - 1] if at else 0), ends[to - 1]
            got = self.search_some(passage[low:high] - at, term[low:high], to - at, least)
            out.append((got[0] + at, *got[1:]))
            at = to
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.empty(0, np.int64),) * 3

    def search_some(self, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks, most = len(self.block_need), self.most[term]
        seen = np.cumsum(most)
        start = np.searchsorted(passage, np.arange(n))
        rest = seen - (seen - most)[np.minimum(start, len(seen) - 1)][passage] < least if len(seen) else np.empty(0, bool)
        slack = np.bincount(passage[rest], most[rest], n)
        # Entries of the terms that count, and the (passage, block) of each.
        entry, of = spread(self.first[term[~rest]], self.first[term[~rest] + 1])
        cell = passage[~rest][of] * blocks + self.block[entry]
        bound = np.bincount(cell, self.block_most[entry], n * blocks)
        alive = np.flatnonzero((bound > 0) & (bound + np.repeat(slack, blocks) >= np.tile(self.block_need, n) - 1e-9))
        # Entries of the other terms in the blocks that are left, found by search.
        small = term[rest]
        few = np.searchsorted(passage[rest], np.arange(n + 1))
        k, of = spread(few[alive // blocks], few[alive // blocks + 1])
        asked = small[k] * blocks + alive[of] % blocks
        found = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        hit = self.key[found] == asked
        more, more_cell = found[hit], alive[of][hit]
        bound += np.bincount(more_cell, self.block_most[more], n * blocks)
        fit = np.zeros(n * blocks, bool)
        fit[alive] = bound[alive] >= self.block_need[alive % blocks] - 1e-9
        entry, cell = np.r_[entry[fit[cell]], more[fit[more_cell]]], np.r_[cell[fit[cell]], more_cell[fit[more_cell]]]
        post, of = spread(self.posting[entry], self.posting[entry + 1])
        pair, place = np.unique(cell[of] // blocks * len(self.need) + self.item[post], return_inverse=True)
        score = np.bincount(place, self.impact[post], len(pair))
        good = score >= self.need[pair % len(self.need)] - 1e-9
        return pair[good] // len(self.need), pair[good] % len(self.need), score[good]

    def hits(self, docs: list[list[str]], overlap: float, part_overlap: float) -> dict[tuple[int, int], tuple]:
        """(doc, item): best (overlap, score ratio, question, answer, first word)."""
        counts = np.array([len(w) for w in docs])
        get = self.terms.get
        term = np.fromiter((get(w, -1) for words in docs for w in words), np.int64, int(counts.sum()))
        gain = np.r_[0, np.cumsum(np.where(term >= 0, self.most[term], 0))]
        step = self.span + 1
        base = np.cumsum(counts) - counts
        many = np.maximum(1, -(-(counts - step) // step))
        doc = np.repeat(np.arange(len(docs)), many)
        start = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * step
        stop = np.minimum(start + 2 * step, (base + counts)[doc])
        found: dict[tuple[int, int], tuple] = {}
        asking = np.flatnonzero((gain[stop] - gain[start] >= self.need.min() - 1e-6) & (stop > start))
        at, of = spread(start[asking], stop[asking])
        known = term[at] >= 0
        pair = np.unique(of[known] * len(self.terms) + term[at[known]])
        which, item, points = self.search(pair // len(self.terms), pair % len(self.terms), len(asking))
        cut = np.searchsorted(which, np.arange(len(asking) + 1))
        for q in np.unique(which).tolist():
            p, got = int(asking[q]), list(zip(item[cut[q] : cut[q + 1]].tolist(), points[cut[q] : cut[q + 1]].tolist(), strict=True))
            d, at = int(doc[p]), int(start[p] - base[doc[p]])
            words = docs[d][at : at + int(stop[p] - start[p])]
            bag, seen = Counter(words), {}
            for i, score in got:
                whole, question, answer = self.parts[i]
                n = min(WIDTH, len(whole))
                if n not in seen:
                    seen[n] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                asked = shingles(whole)
                marks = (len(asked & seen[n]) / len(asked), score, held(question, bag), held(answer, bag), at)
                if marks[0] >= overlap and min(marks[2:4]) >= part_overlap and marks > found.get((d, i), ()):
                    found[d, i] = marks
        return found


@dataclass
class Items:
    """Test items split into words and counted, and how many shards their index takes."""

    split: DataFrame
    many: int
    mean: float
    shards: int
    share: float

    def index(self, k: int) -> Index | None:
        part = self.split.filter(F.pmod(F.xxhash64("item", "text"), F.lit(self.shards)) == k)
        texts = [(r.item, r.text) for r in part.select("item", "text").collect()]
        if not texts:
            return None
        counted = self.split.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df = {r.term: r.df for r in part.select(F.explode("terms").alias("term")).distinct().join(counted, "term").collect()}
        return Index.build(texts, df, self.many, self.mean, self.share)


def prepared(items: DataFrame, item_col: str, item_text: str, share: float, shard_items: int, shard_bytes: int) -> Items:
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"item": batch.column(0), "text": batch.column(1), "words": pa.array([len(w) for w in own], pa.int64()), "terms": pa.array([sorted(set(w)) for w in own], pa.list_(pa.string()))})

    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    split = stored(asked.mapInArrow(terms, "item long, text string, words long, terms array<string>").filter("words > 0"), "items")
    many, mean, size = split.agg(F.count("*"), F.avg("words"), F.sum(F.octet_length("text"))).first()
    return Items(split, many, mean, max(-(-many // shard_items), -(-(size or 0) // shard_bytes)) if many else 0, share)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5, shard_items: int = 20_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """(id, item, score, overlap, question_overlap, answer_overlap, first_word): what each document holds of the items."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, item long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"
    found = spark.createDataFrame([], schema)
    known = prepared(items, item_col, item_text, share, shard_items, shard_bytes)
    for k in range(known.shards):
        if (built := known.index(k)) is None:
            continue
        shared = spark.sparkContext.broadcast(built)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                for at, end in slices(batch.column(1), BATCH_BYTES):
                    hits = list(index.hits([words_of(t) for t in batch.column(1).slice(at, end - at).to_pylist()], overlap, part_overlap).items())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([at + d for (d, _), _ in hits], pa.int64())),
                            pa.array([int(index.ids[i]) for (_, i), _ in hits], pa.int64()),
                            pa.array([m[1] / (index.need[i] / share) for (_, i), m in hits], pa.float64()),
                            *[pa.array([m[j] for _, m in hits], pa.float64()) for j in (0, 2, 3)],
                            pa.array([m[4] for _, m in hits], pa.int64()),
                        ],
                        ["id", "item", "score", "overlap", "question_overlap", "answer_overlap", "first_word"],
                    )

        part = rows.mapInArrow(run, schema)
        if known.shards > 1:
            part = stored(part, "hits")
            shared.unpersist()
        found = found.unionByName(part)
    best = found.groupBy("id", "item").agg(F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap", "first_word")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *[f"m.{c}" for c in ("score", "overlap", "question_overlap", "answer_overlap", "first_word")])


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5, shard_items: int = 20_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows whose text holds an item: a filter, without a join or shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = out.schema
    known = prepared(items, item_col, item_text, share, shard_items, shard_bytes)
    for k in range(known.shards):
        if (built := known.index(k)) is None:
            continue
        shared = spark.sparkContext.broadcast(built)

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                for at, end in slices(batch.column(0), BATCH_BYTES):
                    part = batch.slice(at, end - at)
                    clean = np.ones(end - at, bool)
                    clean[[d for d, _ in index.hits([words_of(t) for t in part.column(0).to_pylist()], overlap, part_overlap)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
        if known.shards > 1:
            out = stored(out, "clean")
            shared.unpersist()
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
