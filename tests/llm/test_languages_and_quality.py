import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlens.llm import langid, mil
from effectlens.llm.neardup import WordHashes
from effectlens.llm.queries import op5_quality_classifier, op10_language_id
from tests.against import SF

EN = "the quick brown fox jumps over the lazy dog and then it runs through the green forest with all of its friends "
DE = "der schnelle braune fuchs springt über den faulen hund und dann läuft er durch den grünen wald mit seinen freunden "


@pytest.fixture(scope="module")
def model():
    return langid.build({"en": [EN * 3], "de": [DE * 3]}, 5000)


def brute(part, corpus):
    """Phrases by search in the text itself."""
    i = n = 0
    while i < len(part):
        k = 1
        while i + k <= len(part) and part[i : i + k] in corpus:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    return n


def plain(model, t):
    return "".join(chr(97 + s) for s in langid.symbols([t], model.table)[0])


def test_phrases_equal_brute_force(model):
    rng = np.random.default_rng(8)
    letters = list("the foxundläß ")
    texts = ["the fox and the hund", DE[5:80] * 5, "zzzz the qqqq", EN * 9, "a", "x" * 1000, "日本語 " * 300, (EN + DE) * 20] + ["".join(rng.choice(letters, n)) for n in (255, 256, 257, 5000)]
    sym, counts = langid.symbols(texts, model.table)
    got = model.phrases(sym, counts)
    for i, t in enumerate(texts):
        for k, corpus in enumerate((DE * 3, EN * 3)):
            assert got[i, k] == brute(plain(model, t), plain(model, corpus)), (t[:20], k)


def test_phrases_run_on_over_segments():
    once = "".join(np.random.default_rng(9).choice(list("abcdefghij"), 2000))
    m = langid.build({"xx": [once]}, 5000)
    assert m.phrases(*langid.symbols([once, once[3:]], m.table)).tolist() == [[1], [1]]


def test_languages_of_odd_texts(spark, model):
    texts = [None, "", "12 !?", EN, DE, "x"]
    named = lambda m, some: [(r.lang_pred, r.score, r.phrase_rate) for r in langid.identify(spark.createDataFrame(list(enumerate(some)), "doc_id int, text string"), m).orderBy("doc_id").collect()]
    got = named(model, texts)
    assert [g[0] for g in got[:5]] == ["und"] * 3 + ["en", "de"] and all(0 <= g[1] <= 1 for g in got) and [g[2] for g in got[:3]] == [None] * 3
    assert named(langid.build({}, 10), [EN])[0][0] == "und"
    alone = named(langid.build({"en": [EN]}, 500), [EN, "zzz"])
    assert [a[0] for a in alone] == ["en", "en"] and all(0 <= a[1] <= 1 for a in alone)


def test_ties_go_to_the_language_that_sorts_first(spark):
    m = langid.build({"b": [EN], "a": [EN], "c": [EN]}, 500)
    got = langid.identify(spark.createDataFrame([(1, EN), (2, "zzz")], "doc_id int, text string"), m).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("a", 0.0)}


def test_more_languages_than_a_shard(spark, model, monkeypatch):
    rng = np.random.default_rng(10)
    samples = {f"l{k}": ["".join(rng.choice(list("abcdefgh"), 400, p=rng.dirichlet(np.ones(8) / 3)))] for k in range(7)}
    m = langid.build(samples, 500)
    df = spark.createDataFrame([(i, s[0][40:200]) for i, s in enumerate(samples.values())] + [(8, None), (9, "")], "doc_id int, text string")
    whole = sorted(map(str, langid.identify(df, m).collect()))
    monkeypatch.setattr(langid, "SHARD_BYTES", 3 * 4 * m.automata[0].states * m.width)
    assert 1 < len(m.shards(langid.SHARD_BYTES)) < 7
    assert sorted(map(str, langid.identify(df, m).collect())) == whole


def test_scripts_of_many_letters(spark):
    rng = np.random.default_rng(11)
    han = [[chr(0x4E00 + i) for i in rng.choice(3000, 800, replace=False)] for _ in range(2)]
    write = lambda k, n: "".join(rng.choice(han[k], n))
    rows = [(i, write(i % 2, 200), f"h{i % 2}") for i in range(200)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    fresh = spark.createDataFrame([(i, write(i % 2, 60)) for i in range(60)], "doc_id int, text string")
    assert all(r.lang_pred == f"h{r.doc_id % 2}" for r in langid.identify(fresh, m).collect())


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, EN * 2, "en") for i in range(5)] + [(10 + i, DE * 200, "de") for i in range(5)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert m.langs == ["de", "en"]


def test_a_text_does_not_borrow_from_its_neighbours(model):
    least = lambda texts: model.predict(texts)["need"].tolist()
    assert least(["  the fox ", "der hund"]) == [least([t])[0] for t in ("  the fox ", "der hund")]


def test_identify_keeps_rows_and_columns(spark, odd, none, model):
    got = langid.identify(odd, model, carry=odd.columns)
    assert got.columns == [*odd.columns, "lang_pred", "score", "phrase_rate", "foreign"] and got.count() == 13
    assert langid.identify(none, model).count() == 0
    assert langid.fit(none).langs == [] and langid.fit(odd).langs == ["en"]


def test_language_of_held_out_rows(spark):
    got = op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.9 * got.count()


def related(rng, n):
    """Two vocabularies, the second made of the first by changing some letters."""
    first = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]
    change = str.maketrans("aeikp", "oeyqb")
    return first, [w.translate(change) if rng.random() < 0.7 else w for w in first]


@pytest.mark.parametrize("words", [(6000, 300), (300, 6000), (6000, 6000), (300, 300), (2000, 100)])
def test_languages_of_uneven_training_text(words):
    rng = np.random.default_rng(12)
    write = lambda vocabulary, n: " ".join(rng.choice(vocabulary, n))
    aa, bb = related(rng, 400)
    m = langid.build({"aa": [write(aa, 100) for _ in range(words[0] // 100)], "bb": [write(bb, 100) for _ in range(words[1] // 100)]}, 30_000)
    texts = [write(v, 40) for v in (aa, bb) for _ in range(100)]
    got = m.predict(texts)["best"]
    assert (got[:100] == 0).sum() >= 97 and (got[100:] == 1).sum() >= 97


def test_many_languages_are_kept_as_transitions():
    rng = np.random.default_rng(13)
    text = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 30_000))
    m = langid.build({"xx": [text()]}, 30_000)
    a = m.automata[0]
    assert 100 * sum(x.nbytes for x in (a.rows, a.symbols, a.to)) < 256 << 20
    many = langid.LanguageModel([f"l{k}" for k in range(100)], m.table, m.automata * 100, m.width, m.rate * 100, m.limit * 100)
    shards = many.shards(langid.SHARD_BYTES)
    assert sum(len(s.langs) for s in shards) == 100 and all(sum(4 * a.states * s.width for a in s.automata) <= langid.SHARD_BYTES for s in shards)


def test_the_query_equals_plain_parses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    m = langid.fit(docs.filter(~held_out))
    got = {r.doc_id: r for r in op10_language_id(spark, SF).collect()}
    for r in docs.filter(F.length("text") < 400).limit(40).collect():
        sym, counts = langid.symbols([r.text or ""], m.table)
        if not (sym > 0).any():
            assert got[r.doc_id].lang_pred == "und"
            continue
        share = []
        for a, rate in zip(m.automata, m.rate, strict=True):
            go = dict(zip(zip(a.rows.tolist(), a.symbols.tolist(), strict=True), a.to.tolist(), strict=True))
            state, need = 0, 0
            for c in sym.tolist():
                if state == 0 or (state, c) not in go:
                    need, state = need + 1, go.get((0, c), 0)
                else:
                    state = go[state, c]
            share.append(need / (1 + rate * int(counts[0])))
        assert got[r.doc_id].lang_pred == m.langs[int(np.argmin(share))]


def test_gradients():
    rng = np.random.default_rng(0)
    x, pieces, y = rng.normal(size=(9, mil.FEATURES)), np.array([2, 3, 4]), np.array([1.0, 0, 1])
    m = mil.learn(x, pieces, y, epochs=1)
    loss = lambda: -np.mean(np.where(y == 1, np.log(m.forward(x, pieces)["p"]), np.log(1 - m.forward(x, pieces)["p"])))
    for k, g in m.gradients(m.forward(x, pieces), y).items():
        at = (0,) * g.ndim
        was = m.weights[k][at]
        m.weights[k][at] = was + 1e-5
        up = loss()
        m.weights[k][at] = was - 1e-5
        down = loss()
        m.weights[k][at] = was
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_passages_cover_whole_texts():
    words = [f"W{i}" for i in range(200)]
    x, pieces = mil.describe([" ".join(words), "", None, "a a a a"], WordHashes())
    assert pieces.tolist() == [4, 1, 1, 1]
    assert np.allclose(x[:4, len(mil.CLASSES) + 4], np.log1p([64, 64, 64, 8]) / 4)
    assert np.allclose(x[:4, 0][0], 64 / sum(len(w) + 1 for w in words[:64]), atol=0.02)
    assert np.allclose(x[6, len(mil.CLASSES) : len(mil.CLASSES) + 3], [0.25, 1 / 3, 0.75])
    alone = mil.describe([" ".join(words)], WordHashes())[0]
    assert np.allclose(alone, x[:4])


def test_one_bad_passage_is_seen():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, y = [], []
    for k in range(200):
        words = [word() for _ in range(64 * 5)]
        if k % 2:
            words[128:192] = ["SPAM##"] * 64
        texts.append(" ".join(words))
        y.append(float(k % 2 == 0))
    x, pieces = mil.describe(texts, WordHashes())
    m = mil.learn(x, pieces, np.array(y), epochs=15)
    f = m.forward(x, pieces)
    assert (((f["p"] >= 0.5) == np.array(y)).mean()) > 0.97
    assert f["a"].reshape(200, 5)[1::2, 2].mean() > 0.2


def test_quality_of_held_out_rows(spark):
    got = op5_quality_classifier(spark, SF)
    judged = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    assert judged.filter("predicted = quality").count() >= 0.9 * judged.count()
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_scores_equal_a_plain_forward_pass(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    m = mil.fit(docs, labels, ~held_out)
    w = m.weights
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    expected = {}
    for r in docs.collect():
        x, _ = mil.describe([r.text], WordHashes())
        hidden = [np.maximum((row - m.mean) / m.spread @ w["encode"] + w["encode_bias"], 0) for row in x]
        weight = [np.exp(float((np.tanh(h @ w["attend"]) * sigmoid(h @ w["gate"])) @ w["weigh"])) for h in hidden]
        bag = sum(a * h for a, h in zip(weight, hidden, strict=True)) / sum(weight)
        expected[r.doc_id] = float(sigmoid(bag @ w["judge"] + w["judge_bias"][0]))
    for r in op5_quality_classifier(spark, SF).collect():
        assert r.score == pytest.approx(expected[r.doc_id], abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_judging_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    m = mil.fit(odd, labels, F.lit(True))
    got = mil.judge(odd, m).collect()
    assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
    assert mil.judge(none, m).count() == 0
    assert mil.fit(odd, labels.limit(0), F.lit(True)).constant == 0.5


def test_a_repeated_id_is_learned_from_once(spark):
    rows = [(1, "good text of words")] + [(2, f"bad ### text {i}") for i in range(50)]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    many = mil.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
    once = mil.fit(spark.createDataFrame(rows[:2], "doc_id long, text string"), labels, F.lit(True))
    assert all(np.allclose(many.weights[k], w) for k, w in once.weights.items())
