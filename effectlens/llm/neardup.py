"""Near-duplicate groups by min-max hashing, confirmed on whole shingle sets.

1. Each text becomes its set of hashed shingles.  Every permutation of the hashes gives two values
   of the signature, its minimum and its maximum, so that ``bands * rows`` values cost half as many
   evaluations.  Texts with one and the same set fall into one class, which its smallest id stands for.
2. Classes that share a band's values are candidates.  Within a bucket each class is tied to the
   bucket's smallest only, never to all others: the components of these ties are clusters that hold
   every candidate pair.
3. Within a cluster, whole shingle sets are compared pair by pair, as products of 0/1 matrices.
   Clusters over ``block`` classes or ``block_shingles`` shingles are cut into blocks by set size, so
   that long texts meet in smaller numbers; pairs of blocks whose sizes rule out a link are skipped,
   and each other pair of blocks is a task of its own.  A task returns a spanning forest of the links
   that it found.
4. The components of all forests are the groups.

Shingle hashes have 64 bits: within one comparison, two different shingles agree about once in 10^13.
With the defaults (32 bands of 8 values) a pair at the threshold of 0.85 is missed as a candidate
once in 20,000 times, and then only matters where no other path joins the two.

Edge cases: a null or blank text has an empty set and is its own group, never tied to another.  A
text of fewer words than a shingle is one shingle as a whole.  Repeated rows are copies of each
other; rows of one id and different texts are one document that links through each of them.  A row without an id stays alone, with no group.  An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.llm.components import components
from effectlens.llm.shared import frugal, slices, small_batches, stored

BATCH_BYTES = 1_000_000
KNOWN_WORDS = 150_000
COLUMNS = 4096


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


@lru_cache(maxsize=4)
def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * odd_numbers(2, 11)[0]
    x = (x ^ (x >> np.uint64(29))) * odd_numbers(2, 11)[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.  bytes.lower and bytes.split know ASCII only, as the words' definition does."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    factors = odd_numbers(width + 1, 5)
    n = min(len(h), width)
    total = np.full(len(h) - n + 1, int(factors[width]) * n % (1 << 64), np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * factors[k]
    return np.unique(mixed(total))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands): a hash of each band of min and max values; sets aren't empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    perms = bands * rows // 2
    flip, factor = odd_numbers(perms, 1), odd_numbers(perms, 2)
    weight = odd_numbers(rows, 3)
    out = np.zeros((bands, len(sets)), np.uint64)
    for k in range(perms):
        y = (x ^ flip[k]) * factor[k]
        band, at = 2 * k // rows, 2 * k % rows
        out[band] += mixed(np.minimum.reduceat(y, starts)) * weight[at] + mixed(np.maximum.reduceat(y, starts)) * weight[at + 1]
    return mixed(out + np.arange(bands, dtype=np.uint64)[:, None] * odd_numbers(1, 4)[0]).T


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, same, bands): same is a digest of the set, null for an empty one."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at, end in slices(batch.column(1), BATCH_BYTES):
                sets = [shingles(t, width, known) for t in batch.column(1).slice(at, end - at).to_pylist()]
                full = [s for s in sets if len(s)]
                found = iter(signatures(full, bands, rows).view(np.int64).tolist() if full else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "same", "bands"],
                )

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(run, "id long, n_shingles long, same binary, bands array<long>")


def with_sets(members: DataFrame, width: int) -> DataFrame:
    """(cluster, id, same, text) to (cluster, id, mark, n, packed): the set of each text that has the digest asked for."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            same = batch.column(2).to_pylist()
            for at, end in slices(batch.column(3), BATCH_BYTES):
                sets = [shingles(t, width, known) for t in batch.column(3).slice(at, end - at).to_pylist()]
                fit = [i for i, s in enumerate(sets) if digest(s) == same[at + i]]
                take = pa.array([at + i for i in fit], pa.int64())
                mark = pa.array([int.from_bytes(same[at + i][:8], "little", signed=True) for i in fit], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), mark, pa.array([len(sets[i]) for i in fit], pa.int64()), pa.array([sets[i].tobytes() for i in fit], pa.binary())],
                    ["cluster", "id", "mark", "n", "packed"],
                )

    return members.mapInArrow(run, "cluster long, id long, mark long, n long, packed binary")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the sets whose intersection is at least percent of their union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[common], rank[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Of each component of two or more, its members with its first."""
    left, out = np.ones(len(links), bool), []
    for i in range(len(links)):
        if not left[i]:
            continue
        left[i] = False
        edge = np.array([i])
        while len(edge):
            edge = np.flatnonzero(links[edge].any(0) & left)
            left[edge] = False
            out += [(i, j) for j in edge.tolist()]
    return out


def confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """(cluster, low, high, block, id, packed), dealt and sorted by task, to (a, b): forests of links."""

    def of_task(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1], rows[0][2]
        ids = [r[4] for r in rows]
        links = linked([np.frombuffer(r[5], np.uint64) for r in rows], percent)
        if low != high:
            side = np.array([r[3] for r in rows]) == low
            links &= side[:, None] != side[None, :]
        return [(ids[i], ids[j]) for i, j in forest(links)]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    out += of_task(rows)
                    rows = []
                rows.append(row)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
        if rows:
            out = of_task(rows)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    task = ["cluster", "low", "high"]
    dealt = tasks.select(*task, "block", "id", "packed").repartition(*task).sortWithinPartitions(*task, "id")
    return dealt.mapInArrow(run, "a long, b long")


def blocked(clusters: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(cluster, id, n, block) of clusters (cluster, id, n): blocks of like size, of about ``block`` classes or ``block_shingles`` shingles, whichever is less.

    A size that many share is cut by a hash.  A set over the bound counts as one block or more.
    """
    load = F.col("many") * F.greatest(F.lit(1.0 / block), F.col("n") / block_shingles)
    seen = clusters.groupBy("cluster", "n").agg(F.count("*").alias("many")).withColumn("load", load)
    seen = seen.withColumn("start", F.sum("load").over(W.partitionBy("cluster").orderBy("n")) - F.col("load"))
    cut = F.floor("start") + F.pmod(F.xxhash64("id"), F.ceil("load"))
    return clusters.join(seen, ["cluster", "n"]).select("cluster", "id", "n", cut.cast("int").alias("block"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = 32, rows: int = 8, block: int = 1024, block_shingles: int = 1 << 20) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of docs."""
    small_batches(docs.sparkSession)
    marks = stored(signed(docs, id_col, text_col, width, bands, rows), "signatures")
    classes = marks.filter("id IS NOT NULL AND same IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    bucket = classes.select("rep", F.explode("bands").alias("h"))
    lead = bucket.groupBy("h").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("h", "lead")
    # Merge joins at every size: a broadcast that only small tables get would hide what large ones move.
    clusters = components(bucket.join(lead.hint("merge"), "h").filter("rep > lead").select("rep", "lead"), "rep", "lead")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    clusters = stored(clusters.join(classes.select(F.col("rep").alias("node"), "n", "same"), "node").select(F.col("root").alias("cluster"), F.col("node").alias("id"), "n", "same"), "clusters")
    placed = stored(blocked(clusters, block, block_shingles), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low = blocks.select("cluster", F.col("block").alias("low"), F.col("most").alias("low_most"), F.col("least").alias("low_least"))
    high = blocks.select("cluster", F.col("block").alias("high"), F.col("least").alias("high_least"), F.col("most").alias("high_most"))
    pairs = low.join(high, "cluster").filter(f"low <= high AND 100 * low_most >= {percent} * high_least AND 100 * high_most >= {percent} * low_least")
    pairs = pairs.select("cluster", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = with_sets(clusters.hint("merge").join(texts, "id").select("cluster", "id", "same", "text"), width)
    tasks = sets.dropDuplicates(["id", "mark"]).join(placed.select("id", "n", "block").distinct(), ["id", "n"]).join(pairs, ["cluster", "block"])
    groups = components(confirmed(tasks, percent).filter("a <> b"), "a", "b")
    out = marks.select("id", "n_shingles", "same").join(classes.select("same", "rep"), "same", "left").join(groups.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, t.doc_id = min(r.root) AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.a = t.doc_id GROUP BY t.doc_id
"""
