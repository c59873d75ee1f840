"""Stupid-backoff scores of documents by an n-gram model of the same corpus.

The score of a word is c(h w) / c(h) where its n-gram was seen ``min_count`` times or more, else
``alpha`` times the score with the context's first word dropped; a single word scores c(w) / N.  All
counts are over all documents.

Documents are packed, in the order in which they are read, into blocks of about ``block_bytes`` of
text: the hashes of a block's words once each, and the place of every word among them.  The blocks are
stored, so texts are split once and aren't shuffled.

The count tables are partitioned by the n-gram's hash.  A block explodes its n-grams, adds up equal
ones, and sends each part of the hash space a sorted list of what it has.  A part adds the lists up,
which makes its piece of the count tables, joins the totals to every list, and sends them back; the
block joins them to its exploded n-grams.  Words and bigrams go first.  Longer n-grams follow, one
length a round, and only those are asked for of which both shorter n-grams reach ``min_count``: the
others can't reach it.  In the end the block sums the scores of each document.

A word that stands in every document is one entry for each block.  A block speaks to at most ``fan``
parts.  A corpus with more parts is counted in levels: the lists of ``fan`` blocks that meet in a part
are merged, and the merged list is dealt out to ``fan`` finer parts, and so on; the totals come back the
same way.  Messages thus grow with the blocks, not with their square.

Words are runs of other than ASCII white space, A-Z in lower case, known by 64-bit hashes; two
different n-grams of one hash would share a count, about once in 10^19 pairs.

Edge cases: a null or blank text has no words, score 0 and a null mean.  A text of any length lies whole
in one block.  Repeated rows are documents of their own and count as often as they stand.  Ties do not
arise.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.llm.neardup import WordHashes, mixed, odd_numbers
from effectlens.llm.shared import frugal, slices, small_batches, stored

SLICE_BYTES = 1_000_000
WORDS = np.uint64(7)  # the entry that counts all words
ASKED = "part int, block long, grams binary, many binary"
TOLD = "part int, block long, totals binary"


def packed(s: np.ndarray) -> bytes:
    """Sorted numbers as differences of six bytes, or of eight where one needs them."""
    d = np.diff(s, prepend=np.uint64(0))
    if len(s) and d[1:].max(initial=0) < 1 << 48:
        return b"\6" + s[:1].astype("<u8").tobytes() + d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\10" + s.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"\10":
        return np.frombuffer(data, "<u8", offset=1)
    wide = np.zeros((1 + (len(data) - 9) // 6, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    wide[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts as a byte each, and in full those that a byte can't hold."""
    many = counts.astype("<u8")
    return len(many).to_bytes(8, "little") + np.minimum(many, 255).astype(np.uint8).tobytes() + many[many >= 255].tobytes()


def counts_of(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.uint64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=8 + n)
    return out


class Codes(dict):
    """Words numbered in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, n_words, ids, sizes, vocab, codes): documents of a block, words of each, distinct words, and all words by place."""
    kind = dict(docs.dtypes)[id_col]
    id_type = f"array<{kind}>"
    small_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = WordHashes(), Codes()
        ids, sizes, words, size, n = [], [], [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            listed = pa.concat_arrays(ids)
            vocab = np.fromiter(map(known.__getitem__, codes), "<u8", len(codes))
            flat = np.concatenate(words).astype("<u4")
            columns = {
                "block": pa.array([base + n], pa.int64()),
                "n_words": pa.array([len(flat)], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                "sizes": pa.array([np.array(sizes, "<u4").tobytes()], pa.binary()),
                "vocab": pa.array([vocab.tobytes()], pa.binary()),
                "codes": pa.array([pa.compress(flat.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for at, end in slices(batch.column(1), min(SLICE_BYTES, block_bytes)):
                ids.append(batch.column(0).slice(at, end - at))
                for t in batch.column(1).slice(at, end - at).to_pylist():
                    split = (t or "").encode("utf-8", "surrogatepass").lower().split()
                    sizes.append(len(split))
                    words.append(np.fromiter(map(codes.__getitem__, split), np.uint32, len(split)))
                    size += len(t or "")
                if size >= block_bytes:
                    yield close()
                    ids, sizes, words, size, n = [], [], [], 0, n + 1
                    codes.clear()
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"block long, n_words long, ids {id_type}, sizes binary, vocab binary, codes binary"), "lm-blocks")


class Block:
    """A block and what it knows of the counts of its n-grams: for each length a count at the word that ends one, 0 for none or too few."""

    def __init__(self, row: dict, min_count: int):
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.vocab = np.frombuffer(row["vocab"], "<u8")
        self.codes = np.frombuffer(pa.decompress(row["codes"], 4 * row["n_words"], "zstd", asbytes=True), "<u4").astype(np.int64) if row["n_words"] else np.empty(0, np.int64)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.min_count, self.counts, self.words = min_count, [], 0

    def grams(self, n: int, pos: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that end at these words."""
        total = np.full(len(pos), int(odd_numbers(32, 21)[n]), np.uint64)
        for k in range(n):
            total += self.vocab[self.codes[pos - n + 1 + k]] * odd_numbers(32, 22)[k]
        return mixed(total)

    def entries(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What this round asks for: distinct hashes in order, how often the block has each, and the place of each question among them."""
        if not self.counts:
            self.pos = np.flatnonzero(self.place >= 1) if order > 1 else np.empty(0, np.int64)
            one = mixed(self.vocab * odd_numbers(32, 22)[0] + odd_numbers(32, 21)[1])
            times = np.r_[len(self.codes), np.bincount(self.codes, minlength=len(one)), np.ones(len(self.pos), np.int64)]
            own, at = np.unique(np.concatenate([np.array([WORDS]), one, self.grams(2, self.pos)]), return_inverse=True)
            return own, np.bincount(at, times, len(own)), at
        n, least = len(self.counts) + 1, self.counts[-1] >= self.min_count
        self.pos = np.flatnonzero((self.place >= n - 1) & least & np.r_[False, least[:-1]])
        own, at, many = np.unique(self.grams(n, self.pos), return_inverse=True, return_counts=True)
        return own, many, at

    def take(self, totals: np.ndarray, at: np.ndarray, order: int) -> None:
        """Learn the totals of this round's entries."""
        got = totals[at].astype(np.int64)
        if not self.counts:
            self.words = int(got[0])
            self.counts.append(got[1 : 1 + len(self.vocab)][self.codes])
            got = got[1 + len(self.vocab) :]
            if order == 1:
                return
        longest = np.zeros(len(self.codes), np.int64)
        longest[self.pos] = got
        self.counts.append(longest)

    def replay(self, told: pa.Table, order: int) -> None:
        """Take in the answers of all rounds before."""
        rounds: dict[int, list[tuple[int, bytes]]] = {}
        for r, p, t in zip(told.column("round").to_pylist(), told.column("part").to_pylist(), told.column("totals").to_pylist(), strict=True):
            rounds.setdefault(r, []).append((p, t))
        for r in range(max(rounds, default=-1) + 1):
            _, _, at = self.entries(order)
            self.take(np.concatenate([np.empty(0, np.uint64), *[counts_of(t) for _, t in sorted(rounds.get(r, []))]]), at, order)

    def scores(self, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Log score of each word, and whether its longest n-gram counted."""
        s = np.log(self.counts[0] / max(self.words, 1)) if len(self.codes) else np.empty(0)
        hit = np.zeros(len(s), bool)
        for n in range(2, order + 1):
            there = self.place >= n - 1
            now = self.counts[n - 1] if len(self.counts) >= n else np.zeros(len(s), np.int64)
            hit = there & (now >= self.min_count)
            before = np.r_[1, self.counts[n - 2][:-1]] if len(s) else now
            share = np.divide(now, before, out=np.ones(len(s)), where=hit)
            s = np.where(hit, np.log(share), np.where(there, np.log(alpha) + s, s))
        return s, hit


def dealt(own: np.ndarray, many: np.ndarray, block: int, parts: int, first: int = 0, of: int | None = None) -> list[tuple[int, int, bytes, bytes]]:
    """A sorted list cut at the edges of parts first to first + parts, of all `of` parts of the hash space."""
    of = of or parts
    cut = [0, *np.searchsorted(own, np.array([(1 << 64) * (first + p) // of for p in range(1, parts)], np.uint64)).tolist(), len(own)]
    return [(first + p, block, packed(own[a:b]), small(many[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]


def asked_table(rows: list[tuple[int, int, bytes, bytes]]) -> dict:
    part, block, grams, many = zip(*rows, strict=True) if rows else ((), (), (), ())
    return {"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.int64()), "grams": pa.array(grams, pa.binary()), "many": pa.array(many, pa.binary())}


def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of several lists, their totals, the place of each list's entries among them, and where lists end."""
    lists = [unpacked(x.as_py()) for x in table.column("grams")]
    many = np.concatenate([counts_of(x.as_py()) for x in table.column("many")])
    own, at = np.unique(np.concatenate(lists), return_inverse=True)
    return own, np.bincount(at, many, len(own)), at, np.cumsum([0, *map(len, lists)])


def told_table(table: pa.Table, totals: np.ndarray, cut: np.ndarray) -> pa.Table:
    return pa.table({"part": table.column("part"), "block": table.column("block"), "totals": pa.array([small(totals[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())})


def total(asked: DataFrame, parts: int, blocks: int, fan: int, further: int) -> DataFrame:
    """(part, block, totals) of lists dealt to `parts` parts by `blocks` blocks; each part is cut into `further` before it is counted."""

    def count(table: pa.Table) -> pa.Table:
        _, sums, at, cut = added(table)
        return told_table(table, sums[at], cut)

    if further <= 1:
        return asked.groupBy("part").applyInArrow(count, TOLD)
    finer = min(fan, further)
    groups = -(-blocks // fan)
    asked = stored(asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))), "lm-lists")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        part, group = (k.as_py() for k in key)
        own, sums, _, _ = added(table)
        return pa.table(asked_table(dealt(own, sums, part + parts * group, finer, part * finer, parts * finer)))

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, at, cut = added(left)
        answers = sorted(zip(right.column("fine").to_pylist(), right.column("totals").to_pylist(), strict=True))
        return told_table(left, np.concatenate([counts_of(t) for _, t in answers])[at], cut)

    merged = asked.groupBy("part", "group").applyInArrow(merge, ASKED)
    fine = total(merged, parts * finer, parts * groups, fan, -(-further // finer))
    back = fine.select(F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.floor(F.col("block") / parts).cast("long").alias("group"), F.col("part").alias("fine"), "totals")
    return asked.groupBy("part", "group").cogroup(back.groupBy("part", "group")).applyInArrow(hand_on, TOLD)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, min_count: int = 2, alpha: float = 0.4, block_bytes: int = 8 << 20, part_words: int = 1_500_000, fan: int = 512) -> DataFrame:
    """(id, n_words, n_seen, score, mean_score): score is the sum of log scores, n_seen the words whose longest n-gram counted."""
    kind = dict(docs.dtypes)[id_col]
    blocks = blocks_of(docs, id_col, text_col, block_bytes)
    words, many = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    needed = max(1, -(-words // part_words))
    parts = min(needed, fan)
    levels = -(-needed // parts)

    def row_of(table: pa.Table, k: int = 0) -> Block:
        return Block({c: table.column(c)[k].as_py() for c in ("n_words", "sizes", "vocab", "codes")}, min_count)

    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column("block").to_pylist()):
                yield pa.RecordBatch.from_pydict(asked_table(dealt(*row_of(batch, k).entries(order)[:2], name, parts)))

    def ask_again(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table(asked_table([]))
        block = row_of(left)
        block.replay(right, order)
        return pa.table(asked_table(dealt(*block.entries(order)[:2], left.column("block")[0].as_py(), parts)))

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        block = row_of(left)
        block.replay(right, order)
        s, hit = block.scores(order, alpha)
        sizes = block.sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(doc, s, len(sizes))
        mean = np.divide(sums, sizes, out=np.full(len(sizes), np.nan), where=sizes > 0)
        return pa.table(
            {
                "id": left.column("ids").combine_chunks().flatten(),
                "n_words": pa.array(sizes, pa.int64()),
                "n_seen": pa.array(np.bincount(doc, hit, len(sizes)).astype(np.int64), pa.int64()),
                "score": pa.array(sums, pa.float64()),
                "mean_score": pa.array(mean, pa.float64(), from_pandas=True),
            }
        )

    told = total(blocks.select("block", "n_words", "sizes", "vocab", "codes").mapInArrow(ask, ASKED), parts, many, fan, levels).withColumn("round", F.lit(0))
    for r in range(1, order - 1):
        told = stored(told, "lm-totals")
        again = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_again, ASKED)
        told = told.unionByName(total(again, parts, many, fan, levels).withColumn("round", F.lit(r)))
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(sum_up, f"id {kind}, n_words long, n_seen long, score double, mean_score double")
    return out.withColumnRenamed("id", id_col)


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT *, lag(x) OVER (PARTITION BY rid ORDER BY i) AS before, lag(x, 2) OVER (PARTITION BY rid ORDER BY i) AS first FROM e),
u AS (SELECT x, count(*) AS c FROM e GROUP BY x),
b AS (SELECT before, x, count(*) AS c FROM p WHERE before IS NOT NULL GROUP BY ALL),
g AS (SELECT first, before, x, count(*) AS c FROM p WHERE first IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM e),
s AS (
  SELECT p.rid, CASE WHEN p.first IS NOT NULL THEN g.c >= 2 ELSE false END AS hit,
    CASE WHEN g.c >= 2 THEN ln(g.c::DOUBLE / d.c) ELSE CASE WHEN p.first IS NOT NULL THEN ln(0.4) ELSE 0 END
      + CASE WHEN b.c >= 2 THEN ln(b.c::DOUBLE / v.c) WHEN p.before IS NOT NULL THEN ln(0.4) + ln(u.c::DOUBLE / n) ELSE ln(u.c::DOUBLE / n) END END AS s
  FROM p JOIN u ON u.x = p.x LEFT JOIN b ON b.before = p.before AND b.x = p.x LEFT JOIN u v ON v.x = p.before
  LEFT JOIN g ON g.first = p.first AND g.before = p.before AND g.x = p.x LEFT JOIN b d ON d.before = p.first AND d.x = p.before, n)
SELECT any_value(t.doc_id) AS doc_id, count(s.rid) AS n_words, count(s.rid) FILTER (s.hit) AS n_seen,
  round(coalesce(sum(s.s), 0), 4) AS score, round(avg(s.s), 6) AS mean_score
FROM t LEFT JOIN s ON s.rid = t.rid GROUP BY t.rid
"""
