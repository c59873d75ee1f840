import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlens.llm import runs as R
from effectlens.llm.queries import op11_periodic_runs
from tests.against import SF


def brute(w, least=6, exponent=4):
    """(start, end, period) by trying every period."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2000):
        letters = rng.choice(["ab", "abc", "a", "abcdefgh"])
        w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            period = [rng.choice(letters) for _ in range(rng.randint(1, 8))]
            at = rng.randint(0, len(w))
            w[at:at] = [period[i % len(period)] for i in range(rng.randint(1, 40))]
        least, exponent = rng.choice([2, 6, 8]), rng.choice([2, 3, 4])
        got = [r for _, r, _ in R.Finder(least, exponent).find([None, " ".join(w), "x y", " ".join(w)])]
        assert got[0] == got[2] == [] and got[1] == got[3] == brute(w, least, exponent)


def test_every_square_of_a_text_without_cutting_it():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.randint(0, 1) for _ in range(rng.randint(2, 80))]
        assert sorted(R.runs_of(np.array(w), 2, 2)) == sorted(brute(w, 2, 2))


def test_positions_know_their_neighbours():
    rng = random.Random(3)
    numbers = rng.sample(range(5000), 800)
    own = R.Positions(numbers[0])
    for k, x in enumerate(numbers[1:], 1):
        before = [y for y in numbers[:k] if y < x]
        after = [y for y in numbers[:k] if y > x]
        assert own.add(x) == (max(before, default=None), min(after, default=None))
    assert list(own) == sorted(numbers) and own.size == len(numbers)


def test_very_long_texts(spark):
    once = " ".join(f"w{i}" for i in range(40_000))
    texts = [" ".join(["again"] * 100_000), " ".join([*(f"w{i}" for i in range(5000))] * 5), once]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in R.find_runs(df).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 100_000, 1)] and got[0].collapsed == "again"
    assert [tuple(x) for x in got[1].runs] == [(0, 25_000, 5000)] and got[1].collapsed == once[: once.index(" w5000")]
    assert got[2].runs == [] and got[2].collapsed == once


def test_odd_rows(odd, none):
    got = R.find_runs(odd).collect()
    assert len(got) == 13 and R.find_runs(none).count() == 0 and R.find_runs(R.planted(odd)).count() == 13
    assert all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in got if r.doc_id in (3, 4, 5))
    assert [tuple(x) for r in got if r.doc_id == 7 for x in r.runs] == [(0, 30_000, 997)]
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert R.find_runs(named).count() == 13


def test_words_part_at_six_spaces_only(spark):
    df = spark.createDataFrame([(1, "a\x0ba\x0ca\ra\ta\na a"), (2, "a\x1ca\x85a a\xa0a a")], "doc_id int, text string")
    assert [r.n_words for r in R.find_runs(df).orderBy("doc_id").collect()] == [7, 2]


@pytest.mark.parametrize(("listed", "best"), [([], None), ([(0, 8, 2), (3, 12, 3)], (0, 8, 2)), ([(0, 8, 2), (9, 9, 2)], (9, 9, 2)), ([(0, 9, 2), (9, 13, 3), (30, 27, 6)], (0, 9, 2))])
def test_the_greatest_run_is_found_exactly(spark, listed, best):
    df = spark.createDataFrame([(listed,)], "runs array<struct<start: long, length: long, period: long>>")
    got = df.select(R.greatest(F.col("runs")).alias("x")).first().x
    assert (tuple(got) if got else None) == best


def test_the_query_equals_plain_python(spark):
    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        gone = {i for s, e, q in found for i in range(s + q, e)}
        top = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        shown = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
        expected[r.doc_id] = (len(found), *shown, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))
    assert {r[0]: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()} == expected
