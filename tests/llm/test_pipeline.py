import re

import corpus_pipeline as P
from effectlens.llm.queries import tokenizer_path
from tests.against import SF
from tests.llm.test_duplicates import groups_by_brute_force


def test_stages_on_the_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(P.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        left[name] = docs.count()
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "near_dedup":
            roots, _ = groups_by_brute_force(sorted((r.doc_id, r.text) for r in before.collect()))
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(roots.values()))
        if name == "decontamination":
            plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holding = {r.doc_id for r in before.collect() if any(f" {i} " in f" {plain(r.text)} " for i in items)}
            assert holding and {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == holding
    assert left["language_id"] >= 0.95 * spark.read.parquet(f"{SF}/documents.parquet").count()
    assert left["bpe"] == left["decontamination"] == P.run(spark, SF).count()


def test_near_copies_at_four_fifths_go(spark):
    rows = []
    for i in range(50):
        words = [f"w{i}x{k}" for k in range(54)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join([*words[:25], "other", *words[26:]])))  # 45 of 55 shingles
    rows += [(1000, " ".join(f"v{k}" for k in range(44))), (1001, " ".join("other" if k == 20 else f"v{k}" for k in range(44)))]  # 35 of 45
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect()) == [*range(0, 100, 2), 1000, 1001]


FINNISH = """vaka vanha vainamoinen tietaja ian ikuinen lahti tuosta astumahan soutamahan laulamahan kuuluvana kulkemahan
puhuvana polttelemaan mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saa'ani sanelemahan sukuvirtta suoltamahan
lajivirtta laulamahan sanat suussani sulavat puhe'et putoelevat kielelleni kerkiavat hampahilleni hajoovat"""
FOREIGN = [FINNISH, "qzxv wkjq pvvx zqjk xwqv kkzj qqvw xzkp " * 2, "съешь же ещё этих мягких французских булок да выпей чаю"]


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, t, None, None, 1) for t in FOREIGN] + [(9_000_000, None, None, None, 0), (None, "12 -", None, None, 4)], docs.schema)
    kept = P.language(spark, docs.unionByName(more), SF).collect()
    assert not any(r.text in FOREIGN or r.text in (None, "12 -") for r in kept) and len(kept) == P.language(spark, docs, SF).count()


def test_rows_without_an_id_are_judged_like_others(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, f"so {item} so", 1), (2, item, 2), (3, "a clean text", 3), (None, "a clean text", 4), (None, None, 5), (5, "", 6), (2, item, 2)], "doc_id long, text string, k long")
    assert sorted(r.k for r in P.decontaminate(spark, docs, SF).collect()) == [3, 4, 5, 6]


def test_one_row_of_each_group_stays(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(7, one, 1), (7, one, 1), (3, one, 2), (None, one, 3), (None, two, 4), (None, two, 4), (9, "", 5), (9, "", 5), (None, None, 6), (8, one + " end", 7), (3, two + " x", 8)]
    kept = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, at long"), SF).collect()
    assert sorted(r["at"] for r in kept) == [2, 5, 5, 6, 8] and kept[0].__fields__ == ["doc_id", "text", "at"]


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, df in enumerate((odd, none)):
        docs = df.selectExpr("doc_id", "text", "lang", "source", "1L AS n_chars")
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert name == "bpe" or out.columns == columns
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (df is odd)
    assert tokenizer_path()
