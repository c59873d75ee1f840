"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps, per document, the measurements and one long of
failure bits; policies are versioned masks over those bits, applied and ablated later without
reading a text again.  Only DataFrame functions are used, and no document leaves its row: the ledger
needs no shuffle.

Repeated three-word windows are found by one primitive sort per document: each window becomes a
long with its hash above and its position below, so that equal windows meet.  The hash keeps
64 - ceil(log2(words)) bits (55 for 500 words); two different windows of one text that share all of
them would count as a repeat, about once in 10^11 texts of that length.

Edge cases: a null or empty text has no words, all its measurements are 0 and it fails ``few_words``.
A text of one or two words has no window.  Ties do not arise; repeated rows give repeated results;
an empty table gives an empty ledger.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where its condition on the measurements holds."""

    name: str
    bit: int
    fails: Callable[[Callable[[str], Column]], Column]


RULES = [
    Rule("few_words", 0, lambda m: m("n_words") < 50),
    Rule("repeated_windows", 1, lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", 2, lambda m: 100 * m("n_symbols") > 20 * m("n_words")),
    Rule("short_words", 3, lambda m: 10 * m("word_chars") < 25 * m("n_words")),
    Rule("long_words", 4, lambda m: m("word_chars") > 20 * m("n_words")),
    Rule("repeated_lines", 5, lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines")),
    Rule("capitals", 6, lambda m: 100 * m("n_capitals") > 60 * m("word_chars")),
]


@dataclass(frozen=True)
class Policy:
    """A version of what is asked of a document: it may fail none of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeated_windows")),
        Policy("v1", ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines")),
        Policy("v2", tuple(r.name for r in RULES)),
    )
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed_bits): one row per document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim("text", F.lit(BLANK))
    n, last = F.size("words"), F.size("words") - 3
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select(
        "id",
        "text",
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "").alias("lines"),
    )
    # The lowest power of two that holds every position.
    rows = rows.select("*", F.expr("shiftleft(1L, ceil(log2(greatest(size(words), 2)))::int) - 1").alias("low"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    rows = rows.select(
        "*",
        F.when(last < 0, F.array().cast("array<bigint>"))
        .otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: window(i).bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long")))))
        .alias("windows"),
    )
    beside = lambda x, k: F.coalesce(x.bitwiseXOR(F.get("windows", k)).between(F.lit(0), F.col("low")), F.lit(False))
    rows = rows.select("*", F.filter("windows", lambda x, k: beside(x, k - 1) | beside(x, k + 1)).alias("again"))
    at = lambda d: F.transform("again", lambda x: x.bitwiseAND(F.col("low")) + d)
    measured = rows.select(
        "id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.concat(at(0), at(1), at(2)))).cast("long").alias("n_repeat_words"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
    )
    bits = sum((F.when(r.fails(F.col), F.lit(1 << r.bit)).otherwise(0) for r in RULES), F.lit(0))
    return measured.select("*", bits.cast("long").alias("failed_bits")).withColumnRenamed("id", id_col)


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether a document in the ledger meets the policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy].mask)) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without): what each rule of a policy does alone.

    The ledger shrinks to one row per pattern of bits before anything is counted.
    """
    chosen = POLICIES[policy]
    seen = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(chosen.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).alias("bit")) for r in RULES if r.name in chosen.rules])).alias("r")
    n_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        seen.select("bits", "n", rules)
        .groupBy(F.lit(policy).alias("policy"), "r.rule")
        .agg(
            n_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            n_if(F.col("bits") == F.col("r.bit")).alias("n_only"),
            n_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        )
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM g),
d AS (SELECT rid, i FROM k QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS n_capitals
  FROM w LEFT JOIN r USING (rid)),
f AS (
  SELECT *, (n_words < 50)::int AS b0, (100 * n_repeat_words > 50 * n_words)::int AS b1,
    (100 * n_symbols > 20 * n_words)::int AS b2, (10 * word_chars < 25 * n_words)::int AS b3,
    (word_chars > 20 * n_words)::int AS b4, (100 * n_dup_lines > 50 * n_lines)::int AS b5,
    (100 * n_capitals > 60 * word_chars)::int AS b6
  FROM m)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
  n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
  (b0 + b1 > 0) AS base_failed, (b0 + b1 + b2 + b3 + b4 + b5 = 0) AS kept,
  (b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6)::bigint AS failed_bits
FROM f
"""
