"""Periodic runs of words by suffix automata.

A suffix automaton of a stretch of words is built, and the ordered end-position sets of its states are merged
up the tree of suffix links, smaller into larger.  Where a merge makes two positions neighbours whose distance
d is small against the state's length, the state's string stands at both, so the words between have period d: a
square, or a higher power, as the exponent asked for says.  It is extended to both sides to a run: a stretch that no neighbour
extends.  A run of period q and length n gives two end positions q apart in the state of its first n - q
words, and nothing between them, else q would not be its smallest period; so every run is seeded.
Merges whose sets aren't complete can also seed a multiple of a run's period; of runs on one stretch the smallest stays.

Automata are built only of stretches that can hold a run.  In a run of period q and at least 2q + k - 1 words every
window of k words stands again q words before or after, within the run; k is four, or as many as the least length and
exponent asked for allow.  So windows that don't stand twice in their stretch cut it, again and again until none does.
That loses no run, and most texts have no stretch left.

Rows are independent: a text is cut, searched and joined again in the task that reads it, without a shuffle, and a
task holds a batch of texts of a few MB, or one longer text and its automaton (about 0.5 kB a word of its
repetitive stretches; n log n insertions in sets of blocks).

Edge cases: a null, empty or blank text has no word, no run and the empty text.  Repeated rows give repeated results.  An empty
table gives an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import frugal, slices, small_batches

MOST_WINDOW = 4
BATCH_BYTES = 2_000_000
WORDS_KEPT = 2_000_000
BLOCK = 9  # bits: positions of a set lie in blocks of so many numbers
SPACES = "[\\x20\\x09-\\x0D]+"

Run = tuple[int, int, int]  # first word, end (exclusive), period


class Positions:
    """An ordered set of numbers, in small sorted blocks."""

    __slots__ = ("blocks", "keys", "size")

    def __init__(self, first: int):
        self.blocks, self.keys, self.size = {first >> BLOCK: [first]}, [first >> BLOCK], 1

    def __iter__(self) -> Iterator[int]:
        for key in self.keys:
            yield from self.blocks[key]

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; returns its neighbours."""
        key = x >> BLOCK
        block = self.blocks.get(key)
        if block is None:
            block = self.blocks[key] = []
            insort(self.keys, key)
        at = bisect_left(block, x)
        block.insert(at, x)
        self.size += 1
        before = block[at - 1] if at else None
        after = block[at + 1] if at + 1 < len(block) else None
        if before is None or after is None:
            k = bisect_left(self.keys, key)
            if before is None and k:
                before = self.blocks[self.keys[k - 1]][-1]
            if after is None and k + 1 < len(self.keys):
                after = self.blocks[self.keys[k + 1]][0]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest, link, end) of the states of the suffix automaton: length of the longest string, suffix link, and the end position of a state that is a prefix, else -1."""
    longest, link, end, go = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        now = len(longest)
        longest.append(i + 1)
        link.append(0)
        end.append(i)
        go.append({})
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = now
            p = link[p]
        if p >= 0:
            q = go[p][w]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                copy = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                end.append(-1)
                go.append(go[q].copy())
                while p >= 0 and go[p].get(w) == q:
                    go[p][w] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return longest, link, end


def seeds(words: list[int], exponent: int) -> Iterator[tuple[int, int]]:
    """(end, distance): the words up to ``end`` and up to ``distance`` words later agree over at least (exponent - 1) * distance words."""
    longest, link, end = automaton(words)
    sets: list[Positions | None] = [Positions(e) if e >= 0 else None for e in end]
    # Suffix links lead to shorter strings: longest first, all that lies below a state is merged before it is.
    for state in sorted(range(1, len(longest)), key=longest.__getitem__, reverse=True):
        up, mine = link[state], sets[state]
        if up <= 0:
            sets[state] = None
            continue
        theirs = sets[up]
        if theirs is None:
            sets[up] = mine
        else:
            small, large = (mine, theirs) if mine.size < theirs.size else (theirs, mine)
            most = longest[up] // (exponent - 1)
            for x in small:
                before, after = large.add(x)
                if before is not None and x - before <= most:
                    yield before, x - before
                if after is not None and after - x <= most:
                    yield x, after - x
            sets[up] = large
        sets[state] = None


def agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading items of x and y are equal, looking at twice as many each time."""
    n, at, step = min(len(x), len(y)), 0, 16
    while at < n:
        to = min(n, at + step)
        differ = x[at:to] != y[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, 2 * step
    return n


def runs_of(words: np.ndarray, least: int, exponent: int) -> list[Run]:
    """Runs of a stretch, by start, then period."""
    found: dict[int, list[tuple[int, int]]] = {}  # by period, (start, end) in order
    for e, d in seeds(words.tolist(), exponent):
        known = found.setdefault(d, [])
        at = bisect_left(known, (e + 1,)) - 1
        if at >= 0 and known[at][1] > e + d:
            continue
        right = agree(words[e + 1 :], words[e + d + 1 :])
        left = agree(words[e::-1], words[e + d :: -1][: e + 1])
        insort(known, (e + 1 - left, e + d + 1 + right))
    smallest: dict[tuple[int, int], int] = {}
    for d in sorted(found, reverse=True):
        smallest.update(dict.fromkeys(found[d], d))
    return sorted((a, b, q) for (a, b), q in smallest.items() if b - a >= max(least, exponent * q))


def places(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs; windows that agree by chance only make a stretch longer."""
    z = (x ^ (y * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def window(least: int, exponent: int) -> int:
    """The words of a window that every run must repeat."""
    return min(MOST_WINDOW, *(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(words: np.ndarray, text: np.ndarray, least: int, wide: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches, within texts, whose windows all stand twice in them and that have at least ``least`` words."""
    many = len(words) - wide + 1
    if many < 1:
        return
    w = words.astype(np.uint64)
    key = w[:many]
    for k in range(1, wide):
        key = mixed(key, w[k : k + many])
    at = np.flatnonzero(text[:many] == text[wide - 1 :])
    stretch = text[at]
    while len(at):
        again = places(mixed(key[at], stretch.astype(np.uint64)))
        at, stretch = at[again], stretch[again]
        if not len(at):
            return
        # A stretch ends where its windows do, or those of a stretch before.
        first = np.r_[True, (np.diff(at) != 1) | (np.diff(stretch) != 0)]
        named = np.cumsum(first)
        long = np.bincount(named) > least - wide
        kept = long[named]
        if again.all() and kept.all():
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(at)] - 1
            yield from zip(at[starts].tolist(), (at[ends] + wide).tolist(), strict=True)
            return
        at, stretch = at[kept], named[kept]


class Finder:
    """Runs of texts; words are numbered as they come."""

    def __init__(self, least: int, exponent: int):
        if exponent < 2 or least < 2:
            raise ValueError("a run has an exponent of at least 2, and so two words")
        self.least, self.exponent, self.window, self.numbers = least, exponent, window(least, exponent), {}

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, list[Run], bytes]]:
        """(words, runs, text without what the runs repeat) of each text."""
        if len(self.numbers) > WORDS_KEPT:
            self.numbers.clear()
        split = [t.encode().split() if t else [] for t in texts]  # bytes are split at the six ASCII spaces
        number = self.numbers
        for ws in split:
            for w in ws:
                if w not in number:
                    number[w] = len(number)
        size = np.array([len(ws) for ws in split], np.int64)
        first = np.r_[0, np.cumsum(size)]
        words = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(first[-1]))
        runs: dict[int, list[Run]] = {}
        for a, b in stretches(words, np.repeat(np.arange(len(split)), size), self.least, self.window):
            k = int(np.searchsorted(first, a, "right")) - 1
            skip = a - int(first[k])
            runs.setdefault(k, []).extend((s + skip, e + skip, q) for s, e, q in runs_of(words[a:b], self.least, self.exponent))
        for k, ws in enumerate(split):
            mine = sorted(runs.get(k, []), key=lambda r: (r[0], r[2]))
            if mine:
                kept = np.ones(len(ws), bool)
                for s, e, q in mine:
                    kept[s + q : e] = False
                ws = [w for w, stays in zip(ws, kept.tolist(), strict=True) if stays]
            yield int(size[k]), mine, b" ".join(ws)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed): runs as (start, length, period) by start, then period; the text without all but each run's first period."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(least, exponent)
        for batch in batches:
            for at, to in slices(batch.column(1), BATCH_BYTES):
                n, found, text = zip(*finder.find(batch.column(1).slice(at, to - at).to_pylist()), strict=True)
                listed = [[{"start": s, "length": e - s, "period": q} for s, e, q in rs] for rs in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n, pa.int64()), pa.array(listed, runs_type), pa.array(text, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def greatest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the one that starts first, then the shortest period.  Null without runs."""
    above = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # Runs are in order of start and period, so only a greater one takes the place of those before.
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(above(x, best), x).otherwise(best))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which every text whose id's crc32 h ends in 0 repeats a period from some word on, as h says."""
    h = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    words = F.filter(F.split(F.col(text_col), SPACES), lambda w: w != "")
    taken = docs.withColumn("__g", F.floor(h / 10)).withColumn("__w", F.when((h % 10 == 0) & (F.size(words) > 0), words))
    n, g = F.size("__w"), F.col("__g")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__w", place(i))), " ")
    return taken.withColumn(text_col, F.when(F.col("__w").isNotNull(), periodic).otherwise(F.col(text_col))).drop("__g", "__w")


# All pairs of equal words at most a quarter of the text apart, by distance; a run is a stretch of them.
ORACLE = r"""
WITH c AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS tab),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(hex(encode(doc_id::VARCHAR)), '[0-9A-F]') AS digits FROM documents),
d AS (SELECT rid, list_transform(range(0, len(digits)), lambda i: ('0x' || digits[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])::BIGINT) AS half FROM t),
h AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, half), lambda a, b: xor(a >> 4, tab[(xor(a, b) & 15) + 1]::BIGINT)), 4294967295) AS h FROM d, c),
g AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM t JOIN h USING (rid)),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
x AS (SELECT rid, doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
e AS (SELECT rid, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM x),
m AS (SELECT a.rid, a.i, b.i - a.i AS q FROM e a JOIN e b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS stretch FROM m),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY rid, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length / period DESC, start, period) AS nth FROM r),
b AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY rid),
z AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
y AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.i) AS collapsed FROM e LEFT JOIN z ON e.rid = z.rid AND e.i = z.i WHERE z.i IS NULL GROUP BY e.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM x LEFT JOIN b USING (rid) LEFT JOIN (FROM o WHERE nth = 1) o USING (rid) LEFT JOIN y USING (rid)
"""
