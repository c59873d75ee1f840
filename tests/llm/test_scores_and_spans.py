import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from effectlens.llm import lm, pii
from effectlens.llm.queries import op7_pii, op8_sharding
from effectlens.llm.shards import shard
from tests.against import SF, assert_same, duck


@pytest.mark.parametrize(("order", "shape"), [(1, {}), (2, {}), (3, {}), (4, {}), (3, {"part_words": 10, "fan": 3}), (3, {"part_words": 10, "fan": 2}), (3, {"min_count": 3})])
def test_backoff_equals_brute_force(spark, order, shape):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "dd", "é"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    words = {i: t.encode().lower().split() for i, t in rows}
    count, n = collections.Counter(), 0
    for w in words.values():
        n += len(w)
        for k in range(1, order + 1):
            count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    def chance(g):
        if len(g) == 1:
            return count[g] / n
        return count[g] / count[g[:-1]] if count[g] >= shape.get("min_count", 2) else 0.4 * chance(g[1:])

    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id int, text string"), order=order, block_bytes=300, **shape).collect()}
    for i, w in words.items():
        s = sum(math.log(chance(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        assert got[i].score == pytest.approx(s) and got[i].n_words == len(w)
        assert got[i].mean_score == (pytest.approx(s / len(w)) if w else None)


def test_backoff_of_odd_rows(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == 13 and lm.score(none).count() == 0
    assert all(r.score == 0 and r.n_words == 0 and r.mean_score is None for r in got if r.doc_id in (3, 4, 5))


def test_repeated_rows_count_as_often_as_they_stand(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 50 + [(2, "a b c e")], "doc_id long, text string").repartition(3)
    got = lm.score(df, block_bytes=20).collect()
    assert len(got) == 51 and {round(r.score, 9) for r in got if r.doc_id == 1} == {round(math.log(51 / 204) + math.log(50 / 51), 9)}


def test_backoff_query_equals_sql(spark):
    name = "op3_lm_scoring"
    assert_same(entry.queries()[name](spark, SF).toPandas(), duck().execute(entry.oracle_sql()[name]).df())
    assert [q for q in entry.queries() if q.startswith("op3_")] == [name]


def test_packing():
    import numpy as np

    for s in ([], [5], [254, 255, 256], [0, 1, 2**40, 2**63], [1, 2, 3], [2**64 - 2, 2**64 - 1]):
        a = np.array(s, np.uint64)
        assert lm.unpacked(lm.packed(a)).tolist() == s
        assert lm.counts_of(lm.small(a)).tolist() == s


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entities(text):
    out = []
    for rank, kind in enumerate(("email", "ip", "card", "phone")):
        for m in re.finditer(pii.PLAIN[kind], text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


TRICKY = [
    "a@b.com._x@c.de", "🙂 x 1.2.3.4.5.6.7.8 é 4111 1111-1111 1111 +1 (234) 567-8901", "1234567890123456789012345 0-4111111111111111", "x" * 50_000, "1 " * 20_000,
    "9" * 30_000 + "@" + "a." * 5000, "a@b a@b.c-d.e+f@g.h.i", "256.1.1.1 007.1.2.3 999999999999999999999.1.1.1", "+12345678 +1234567890123456 +1-2-3-4-5-6-7-8-9)", "a.b@c..d@e.f", "4111111111111111 -5 4111-1111-1111-1111",
]


def test_entities_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("12345 .-+@ab()é🙂") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in pii.find(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == entities(texts[r.doc_id]), texts[r.doc_id][:100]


def test_query_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op7_pii(spark, SF).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in entities(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))


def test_revealing_words_are_found_and_removed(spark):
    rows = [(i, f"case {i}: the agent zorbax wrote from zed@mail.example.com about text {i}") for i in range(3)]
    rows += [(10 + i, f"case {i}: the agent wrote about some text from number {i}") for i in range(40)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("_id", F.lit(2))
    text = dict(rows)
    got = {r.doc_id: {(s.kind, text[r.doc_id][s.start : s.end]) for s in r.spans} for r in pii.find(df).collect() if r.spans}
    assert got == {i: {("email", "zed@mail.example.com"), ("term", "zorbax")} for i in range(3)}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[1] == "case 1: the agent [TERM] wrote from [EMAIL] about text 1" and clean[10] == text[10] and clean[60] is None


def test_secrets_are_spans_but_not_entities(spark):
    key = "9abc9ff9ca9fb9e9c999a9eb99999999a999bdde"
    rows = [(1, f'so token = "{key}" rare'), (2, f"api_key:{key}=="), (3, f"PASSWORD= {'a' * 40}"), (4, f"token {key}"), (5, "ghp_0123456789abcdefghij x"), (6, f"a secret is {key}")]
    text = dict(rows)
    got = {r.doc_id: (len(r.base), [(s.kind, text[r.doc_id][s.start : s.end]) for s in r.spans]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, [("secret", key)]), 2: (0, [("secret", key + "==")]), 3: (0, []), 4: (0, []), 5: (0, [("secret", "ghp_0123456789abcdefghij")]), 6: (0, [])}


def test_a_text_of_very_many_entities(spark):
    rng = random.Random(12)
    text = " ".join(f"Name{rng.randrange(10**6)} u{i}@mail.example.com, 日本 " for i in range(20_000))
    rows = [(1, text), (2, "plain text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got[1].base) == 20_000 and [text[s.start : s.end] for s in got[1].base[::997]] == [f"u{i}@mail.example.com" for i in range(0, 20_000, 997)]
    clean = {r.doc_id: r.text for r in pii.sanitised(df, generalise=True).collect()}
    assert clean[1].count("[EMAIL]") == 20_000 and "@" not in clean[1] and clean[2] == "plain text"


def test_redaction_equals_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abc日🙂 ") for _ in range(rng.choice([0, 5, 100, 9000])))
        spans = sorted((a, 0, min(len(t), a + rng.randint(1, 50)), "ip") for a in (rng.randrange(len(t)) for _ in range(rng.randint(0, 60) if t else 0)))
        rows.append((i, t, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,rank:int,end:int,kind:string>>")
    for r in df.select("i", pii.redact(F.col("text"), F.col("spans")).alias("got")).collect():
        _, t, spans = rows[r.i]
        at, out = 0, ""
        for a, _, b, _ in spans:
            if a >= at:
                out += t[at:a] + "[IP]"
            at = max(at, b)
        assert r.got == out + t[at:]


def test_one_text_is_no_support_however_often_it_stands(spark):
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "agent zorbax is zed@mail.example.com").otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("text"))
    assert pii.find(df).filter(F.exists("spans", lambda s: s["kind"] == "term")).count() == 0


def test_rare_words_reveal_an_entity_of_one_text(spark):
    rows = [(i, f"the agent wrote from home about some text of number {i % 5}") for i in range(40)] + [(50, "the agent zorbax wrote from zed@mail.example.com about some text")]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {50: "the agent [TERM] wrote from [EMAIL] about some text"}


def test_the_table_has_terms(spark):
    spans = [r.spans for r in op7_pii(spark, SF).collect()]
    assert sum("term:" in s for s in spans) > 0 and all(re.search("(email|ip|card|phone):", s) for s in spans if "term:" in s)


def terms_by_brute_force(texts, disclosure=0.8, support=2):
    """Spans of terms of each text, texts being all documents."""
    n, ents, words = len(texts), [], []
    for t in texts:
        spans = entities(t)
        found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t)]
        ents.append({(k, t[a:b].lower()) for k, a, b in spans})
        words.append([(w, a, b) for w, a, b in found if not any(a < y and b > x for _, x, y in spans)])
        words[-1].append({w for w, _, _ in found})
    n_t = collections.Counter(w for held in words for w in held[-1])
    n_e = collections.Counter(e for held in ents for e in held)
    both, in_texts = collections.Counter(), collections.defaultdict(set)
    for i, t in enumerate(texts):
        for pair in {(e, w[0]) for e in ents[i] for w in words[i][:-1]}:
            both[pair] += 1
            in_texts[pair].add(t)

    def reveals(e, w):
        rare = math.log2(n / n_t[w]) >= disclosure * math.log2(n)
        return n_e[e] < n and (len(in_texts[e, w]) >= support or rare) and math.log2(both[e, w] * n / (n_e[e] * n_t[w])) >= disclosure * math.log2(n / n_e[e])

    return [sorted((a, b) for w, a, b in words[i][:-1] if any(reveals(e, w) for e in ents[i])) for i in range(n)]


def test_terms_equal_brute_force(spark):
    rng = random.Random(7)
    people = [f"u{i}@mail.example.com" for i in range(6)] + ["1.2.3.4", "+1 (234) 567-8901"]
    texts = []
    for i in range(150):
        words = [rng.choice(["the", "Li", "x", "case", "Zorbax", "né", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(people))
            words[rng.randint(0, len(words)) :] += [f"name{k}", *["so"] * rng.randint(0, 60), people[k]]
        texts.append(" ".join(words))
    texts += texts[:10]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    got = pii.find(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id int, text string")).collect()
    key = lambda i, spans: (str(i), str(spans))
    expected = terms_by_brute_force(texts)
    assert sum(map(len, expected)) > 50
    assert sorted(key(r.doc_id, [(s.start, s.end) for s in r.spans if s.kind == "term"]) for r in got) == sorted(map(key, ids, expected))


def test_terms_of_the_query_equal_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = {i: [f"term:{a}:{b}" for a, b in spans] for (i, _), spans in zip(rows, terms_by_brute_force([t for _, t in rows]), strict=True)}
    assert {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term:")] for r in op7_pii(spark, SF).collect()} == expected


def test_words_far_from_their_entity_are_terms(spark):
    rows = [(i, f"Li {'so ' * 90}wrote from zed@mail.example.com \ue000 {'so ' * 90}{i % 2} Li\ue000") for i in range(3)]
    rows += [(10 + i, f"so wrote from {i % 2}") for i in range(40)]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t.replace("Li", "[TERM]").replace("zed@mail.example.com", "[EMAIL]") for i, t in rows}


def test_spans_of_odd_rows(odd, none):
    got = pii.find(odd).collect()
    assert len(got) == 13 and all(r.spans == [] for r in got) and pii.find(none).count() == 0
    assert pii.sanitised(odd).columns == odd.columns and pii.sanitised(odd).count() == 13


def check_shards(df, shards):
    got = shard(df, shards).toPandas()
    whole = got["size"].sum()
    by = got.groupby("shard")
    for _, g in by:
        assert sorted(g.slot) == list(range(len(g)))
        assert abs(g["size"].sum() - whole / shards) <= 2 * got["size"].max()
    assert got["shard"].between(0, shards - 1).all() and (got.law == "bytes").all()
    return got


def test_shards_are_even(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 3000)) for i in range(3000)] + [(3000 + i, "the same text " * 30) for i in range(3000)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 40)
    assert len(got) == 6000 and got.doc_id.nunique() == 6000
    again = shard(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7), 40).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_equal_texts_share_a_shard_or_neighbours(spark):
    rows = [(i, f"text {i // 5}" * 20) for i in range(2000)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert (got.groupby("text_crc32").shard.nunique() > 1).sum() <= 9


def test_overfull_ranges_are_split(spark):
    rows = [(i, "z" * 50) for i in range(4000)]
    check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    few = shard(spark.createDataFrame(rows[:3], "doc_id long, text string"), 40).toPandas()
    assert len(few) == 3 and (few.slot == 0).all()


def test_shards_of_odd_rows(spark, odd, none):
    got = shard(odd, 4).toPandas()
    assert len(got) == 13 and shard(none, 4).count() == 0
    assert set(got[got.doc_id.isin([3, 4])]["size"]) == {16} and set(got[got.doc_id.isin([3, 4])].text_crc32) == {0}
    assert op8_sharding(spark, SF).filter("grown_shard IS NOT NULL").count() == 0


def test_ranges_are_split_until_none_is_overfull(spark):
    rows = [(1, "the same row")] * 3000 + [(i, f"text {i}") for i in range(500)] + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shape in ({}, {"range_rows": 40, "fan": 4}, {"range_rows": 40, "fan": 4, "most_broadcast": 0}):
        got = shard(df, 7, **shape).toPandas()
        assert len(got) == 3550 and abs(got.groupby("shard")["size"].sum() - got["size"].sum() / 7).max() <= 2 * got["size"].max()
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert shard(df.limit(0), 7).count() == 0


def test_shard_query_equals_sql(spark):
    name = "op8_sharding"
    got, want = entry.queries()[name](spark, SF).toPandas(), duck().execute(entry.oracle_sql()[name]).df()
    assert_same(got.drop(columns="grown_shard"), want.drop(columns="grown_shard"))
    assert got.grown_shard.isna().all() and want.grown_shard.isna().all()
