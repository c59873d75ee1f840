import collections
import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from effectlens.llm import quality
from effectlens.llm.bpe import CACHE_LETTERS, WordBPE, decode_documents, encode_documents
from effectlens.llm.queries import op2_bpe, tokenizer_path
from tests.against import SF


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(grams)
    again = {i + d for i, g in enumerate(grams) if many[g] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_ledger_equals_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c\n\t#|é🙂X") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(texts[r.doc_id])


def test_ledger_of_odd_rows(odd, none):
    book = quality.ledger(odd)
    got = book.collect()
    assert len(got) == 13 and quality.ledger(none).count() == 0
    blank = [r for r in got if r.doc_id in (3, 4, 5)]
    assert all(r.n_words == 0 and r.failed_bits & 1 for r in blank)
    long = next(r for r in got if r.doc_id == 7)
    assert long.n_words == 30_000 and long.n_repeat_words == 30_000


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, good), (2, "short"), (3, good.replace(" ", "## ")), (4, "a## " * 60)], "doc_id int, text string")
    book = quality.ledger(df)
    assert {r.doc_id for r in book.filter(quality.passes("v1")).collect()} == {1}
    assert {r.doc_id for r in book.filter(quality.passes("base")).collect()} == {1, 3}
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(book, "v1").collect()}
    assert got["few_words"] == (1, 1, 2) and got["symbols"] == (2, 1, 2) and got["repeated_windows"] == (1, 0, 1)


@pytest.fixture(scope="module")
def both():
    return WordBPE(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def test_encoding_equals_the_library(both):
    own, library = both
    rng = random.Random(2)
    letters = "aaabcdeéß  '’.!12½İΣσς\x1c\x85日本🙂ǅ́<|endoftext|>TÀ'll're thing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a<|endoftext|>b<|startoftext|>", "a" * 3000, "ab" * 1000 + "<|endoftext|>", "", " ", "the" * 300, "it's we'll I'M"]
    texts += ["a\x1cb\x1fc d", "<|EndOfText|> <|endoftext|>", "x<|endoftext|>\u0301y", "\u00a0\u2003e\u0301\u3000E\u0301 "]
    for chosen in (texts, texts[::-1], texts[:1]):
        ids, counts = own.encode(chosen)
        decoded = own.decode(ids, counts).to_pylist()
        ends = np.cumsum(counts)
        for k, text in enumerate(chosen):
            e = library.encode(text, add_special_tokens=False)
            assert ids[ends[k] - counts[k] : ends[k]].tolist() == e.ids
            assert decoded[k] == library.decode(e.ids, skip_special_tokens=False)


def test_chunks_forgotten_are_learned_again(both):
    own, library = both
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(12)) for _ in range(CACHE_LETTERS // 120)]
    for _ in range(3):
        ids, counts = own.encode([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)])
        rng.shuffle(words)
    ids, counts = own.encode([" ".join(words[:500])])
    assert ids.tolist() == library.encode(" ".join(words[:500]), add_special_tokens=False).ids


def test_query_equals_the_library_on_the_whole_table(spark, both):
    _, library = both
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, op2_bpe(spark, SF).collect())) == sorted(want)


def test_long_words_merge_like_short_ones(both):
    own, library = both
    rng = random.Random(3)
    for n in (399, 400, 401, 2500):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert own.merge(*own.letters([word]))[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_pair_check_agrees_with_merging(both):
    own, _ = both
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("theanrs"), rng.integers(2, 14))) for _ in range(2000)]
    tok, word = own.merge(*own.letters(words))
    inside = np.flatnonzero(word[1:] == word[:-1])
    assert own.compatible(tok[inside], tok[inside + 1]).all()
    ids, counts = own.encode_words(words)
    assert ids.tolist() == tok.tolist() and counts.tolist() == np.bincount(word).tolist()


def test_documents(odd, none):
    got = encode_documents(odd, tokenizer_path()).collect()
    assert len(got) == 13 and encode_documents(none, tokenizer_path()).count() == 0
    assert all(r.ids == b"" and r.decoded == "" for r in got if r.doc_id in (3, 4, 5))
    again = decode_documents(spark_rows(odd, got), tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in got)


def spark_rows(odd, rows):
    return odd.sparkSession.createDataFrame([(r.doc_id, bytes(r.ids)) for r in rows], "doc_id long, ids binary")
