import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlens.llm import decontaminate, lines, neardup
from effectlens.llm.components import components
from effectlens.llm.queries import ORACLES, QUERIES
from tests.against import SF, assert_same, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert_same(got, duck().execute(ORACLES[name]).df())


def words_of(text):
    return (text or "").encode().lower().split()


def groups_by_brute_force(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    member = defaultdict(list)
    for i in range(len(rows)):
        member[find(i)].append(rows[i][0])
    return {d: min(ids) for ids in member.values() for d in ids}, {r[0]: len(s) for r, s in zip(rows, sets, strict=True)}


def near_copies(n, length, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"v{rng.randint(0, 99999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "shingles"), [(1024, 1 << 20), (16, 1 << 20), (1024, 700), (1024, 50)])
def test_groups_equal_brute_force(spark, block, shingles):
    texts = near_copies(60, 150, 6, 1) + near_copies(40, 90, 3, 2) + near_copies(20, 12, 1, 3) + ["a b c", "A  b\tc", "a b", "", None, " "] * 3
    texts += [" ".join(f"u{i}_{k}" for k in range(30)) + " the same closing line of all the texts" for i in range(30)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    roots, sizes = groups_by_brute_force(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), block=block, block_shingles=shingles).collect()
    assert {r.doc_id: r.component_id for r in got} == roots and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_blocks_are_bounded_by_classes_and_by_shingles(spark):
    """Sizes that differ fill a block up to its bound; a size that many share is cut by a hash, so evenly but for chance."""
    sizes = {"short": [20] * 400, "long": [5000 + k for k in range(200)], "huge": [300_000] * 3, "mixed": list(range(1, 300))}
    rows = [(c, i, n) for c, (_, many) in enumerate(sizes.items()) for i, n in enumerate(many)]
    got = neardup.blocked(spark.createDataFrame(rows, "cluster long, id long, n long"), 64, 100_000).collect()
    held = defaultdict(list)
    for r in got:
        held[r.cluster, r.block].append(r.n)
    assert sorted((r.cluster, r.id, r.n) for r in got) == sorted(rows)
    assert all(len(v) <= 2 * 64 for v in held.values()) and all(sum(v) <= 120_000 for (c, _), v in held.items() if c != 2)
    assert len([k for k in held if k[0] == 1]) >= 10 and len([k for k in held if k[0] == 0]) >= 6


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 13 and neardup.near_duplicates(none).count() == 0
    assert sorted(r.component_id for r in got if r.doc_id in (1, 2)) == [1, 1, 1]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (3, 4, 5))


def test_one_id_with_two_texts_links_through_both(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "something else altogether in five words")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 62, 1000, np.uint64)) for _ in range(2))
    b[:700] = a[:700]
    b = np.unique(b)
    sig = neardup.signatures([a, b], bands=200, rows=2)  # each band: minimum and maximum of one permutation
    share = (sig[0] == sig[1]).mean()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert share == pytest.approx(j * j, abs=0.1)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(300)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    expected = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lines_over_many_batches_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["  Shared Line One ", "shared line one", "short", "ÄHNLICHE zeile", "ähnliche zeile", "", f"only in {i} here", f"in few {i // 7} docs"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    upper = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda x: x.strip(lines.BLANK).translate(upper)
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    stay = lambda i, x: len(holders[key(x)]) < 2 or min(holders[key(x)]) == i
    expected = {i: "\n".join(x for x in t.split("\n") if stay(i, x)) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for batches, fanout in ((7, 2), (1, 3)):
        assert {r.doc_id: r.text for r in lines.dedup_lines(df, batches=batches, fanout=fanout).collect()} == expected


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(4):
        runs.add(spark.createDataFrame([(k, k, k), (k, 100, 0)], "id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = sorted(tuple(r) for r in runs.read(runs.all()[0]).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), (100, 0, 0)]
    runs.forget(runs.all())


def test_runs_are_joined_as_they_lie(spark):
    runs = lines.LineRuns(spark, fanout=9)
    keys = spark.range(500).selectExpr("id", "id % 90 AS h1", "id % 7 AS h2")
    for k in range(2):
        runs.add(keys.filter(f"id % 3 = {k}"))
    before = spark.conf.get(lines.SORTED_SCANS)
    with runs.in_order():
        a, b = map(runs.read, runs.all())
        plan = a.join(b.hint("merge"), lines.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.conf.get(lines.SORTED_SCANS) == before
    runs.forget(runs.all())


def test_lines_of_odd_rows(odd, none):
    got = lines.dedup_lines(odd)
    assert got.columns == [*[c for c in odd.columns], "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 13 and lines.dedup_lines(none).count() == 0
    assert all(r.n_dropped == 0 for r in rows if r.doc_id in (None, 1)) and all(r.n_dropped == 1 and r.text == "" for r in rows if r.doc_id == 2)
    assert all(r.n_lines == 1 for r in rows if r.doc_id in (3, 4))


def items(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    return [(k, " ".join(word() for _ in range(rng.randint(15, 50))) + ". " + " ".join(word() for _ in range(6)) + ".") for k in range(50)]


def test_planted_items_are_found(spark):
    bench = items(spark)
    rng = random.Random(8)
    filler = lambda n: " ".join(f"f{rng.randint(0, 3000)}" for _ in range(n))
    rows, planted = [], set()
    for d in range(200):
        text = filler(rng.randint(0, 300))
        if d % 4 == 0:
            k, item = bench[d % 50]
            text, planted = f"{text} {item.upper() if d % 8 else item} {filler(40)}", planted | {(d, k)}
        elif d % 4 == 1:
            text += " " + " ".join(bench[d % 50][1].split()[:7])  # a few words of an item are no leak
        rows.append((d, text))
    docs, bank = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([*bench, (98, None), (99, "")], "item_id int, text string")
    for shard_items in (20_000, 11):
        got = decontaminate.contaminated(docs, bank, shard_items=shard_items).collect()
        assert {(r.doc_id, r.item_id) for r in got} == planted and len(got) == len(planted)


def test_bounds_lose_no_item(spark, monkeypatch):
    """Scores of all items by definition, for passages as queries."""
    bench = items(spark)
    split = [decontaminate.words_of(t) for _, t in bench]
    df = defaultdict(int)
    for w in split:
        for t in set(w):
            df[t] += 1
    mean = sum(map(len, split)) / len(split)
    index = decontaminate.Index.build(bench, df, len(bench), mean, share=0.3)
    rng = np.random.default_rng(9)
    asked, expected = [], {}
    for q in range(200):
        query = {t for k in rng.integers(0, 50, 2) for t in split[k] if rng.random() < 0.5}
        terms = np.array(sorted(index.terms[t] for t in query), np.int64)
        full = np.zeros(len(bench))
        for t in terms:
            for e in range(index.first[t], index.first[t + 1]):
                for p in range(index.posting[e], index.posting[e + 1]):
                    full[index.item[p]] += index.impact[p]
        asked += [(q, t) for t in terms]
        expected |= {(q, i): full[i] for i in range(50) if full[i] >= index.need[i]}
    pairs = np.array(asked)[rng.permutation(len(asked))]
    for together in (1, 1_000_000):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        got = {(q, i): s for q, i, s in zip(*(x.tolist() for x in index.search(pairs[:, 0], pairs[:, 1], 200)), strict=True)}
        assert got == pytest.approx(expected)


def test_questions_and_answers():
    assert decontaminate.question_and_answer("What is it? A dog.") == (["what", "is", "it"], ["a", "dog"])
    assert decontaminate.question_and_answer("One two. Three four.") == (["one", "two"], ["three", "four"])
    assert decontaminate.question_and_answer("a b c d") == (["a", "b", "c"], ["d"])


def test_decontamination_of_odd_rows(spark, odd, none):
    bank = spark.createDataFrame([(1, "one two three four five six seven"), (2, "word")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bank).collect()}
    assert got == {(1, 1), (2, 1), (6, 2)}
    assert decontaminate.contaminated(none, bank).count() == 0 and decontaminate.contaminated(odd, bank.limit(0)).count() == 0


def test_hot_keys_stay_whole(spark):
    """A third of all rows share one text, one line and one id-less group."""
    same = "this very line stands in a third of all documents here"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, same).otherwise(F.concat(F.lit("line number "), F.col("id").cast("string"), F.lit(" is alone in its document"))).alias("text"))
    got = neardup.near_duplicates(df)
    assert got.filter("component_id = 0").count() == 1000 and got.filter("kept").count() == 2001
    assert lines.dedup_lines(df).filter("n_dropped = 1").count() == 999


def test_decontaminated_keeps_rows_and_columns(spark, odd, none):
    bank = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "several words, twice here"), (2, None)], "item_id long, text string")
    for shard_items in (20_000, 1):
        left = decontaminate.decontaminated(odd, bank, shard_items=shard_items)
        assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [3, 4, 5, 6, 7, 8, None, 9]))
    assert decontaminate.decontaminated(none, bank).count() == 0 and decontaminate.decontaminated(odd, bank.limit(0)).count() == 13


def test_query_equals_brute_force(spark):
    from effectlens.llm.queries import op4_decontamination

    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = lambda words: f" {' '.join(words)} "
    expected = {(r.doc_id, i) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, w in items if w and whole(w) in whole(decontaminate.words_of(r.text))}
    got = op4_decontamination(spark, SF).collect()
    assert expected and {(r.doc_id, r.item_id) for r in got if r.overlap == 1} >= expected and len({(r.doc_id, r.item_id) for r in got}) == len(got)
