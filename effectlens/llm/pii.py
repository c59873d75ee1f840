"""Personal data and what gives it away: information-theoretic sanitisation.

Protected entities are e-mail addresses, IP addresses, card and phone numbers found by pattern.
Words of a text that holds an entity are candidates, but for those that an entity overlaps.  How strongly
a word t reveals an entity e is their pointwise mutual information over all documents,
PMI = log2(c(e,t) N / (n(e) n(t))), against the information that the entity itself carries,
IC = log2(N / n(e)).  A word with PMI >= ``disclosure`` * IC reveals the entity if at least ``support``
different texts hold both or, as most entities stand in one text only, if the word's own information
log2(N / n(t)) is at least ``disclosure`` times log2(N), that of what stands in one document.  It is a
span of its own, of kind ``term``, wherever a text that holds the entity has it.  Spans are removed from
a text by putting the name of their kind in place.

Credentials are protected too: a value after the name of one (``token = "..."``), or one that starts as
issued keys do, of 16 characters or more with letters and digits.  They are spans of kind ``secret``; as they
name nobody, no word reveals them.

Only DataFrame functions are used.  All document counts are exact and over the whole table; they are
pre-aggregated before they are dealt out, so that a word of every document is one row for each task.
Words are numbered, located and held against entities as rows in order, so a text of n words and e entities
takes n log n + e^1.5 steps.

Patterns are matched by Java: possessive quantifiers and look-behinds keep every search linear and off
the stack in texts of any length, and find the same matches as the plain forms in ``PLAIN``.

Edge cases: a null or empty text has no span.  Repeated rows (equal id and text) get equal results.
Ties do not arise.  An empty table gives an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.llm.shared import stored

KINDS = ["email", "ip", "card", "phone", "secret", "term"]
TERM = KINDS.index("term")
# The patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A match starts where a run of its first characters starts, or where the match before ended.  Runs of
# digits with single separators are whole runs; only those of 12 to 19 digits are looked for.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Names that credentials are given, and how issued keys start.
NAMES = "token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
STARTS = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xoxb-|xoxp-|AIza|eyJ"
FAST["secret"] = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{16}})(?:(?={STARTS})|(?<=(?i:{NAMES})[\"']{{0,1}}[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}[\"']{{0,1}}))[A-Za-z0-9+/_-]++={{0,2}}"
MUST_HOLD = {"email": "@", "phone": "+", "ip": "."}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TOKEN = r"[\p{L}\p{N}_]+"
PIECE = 4096
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, total: Callable[[Column], Column]) -> Column:
    """Totals of the first 1, 2, ... values, in blocks of sqrt(n): n^1.5 steps."""

    def with_blocks(v: Column, step: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int"))
        joined = lambda a, b: total(F.filter(F.array(a, b), F.isnotnull))
        return let(
            F.transform(starts, lambda k: total(F.slice(v, k * step + 1, step))),
            lambda sums: let(
                F.transform(starts, lambda k: F.when(k > 0, total(F.slice(sums, F.lit(1), k)))),
                lambda before: F.transform(v, lambda _, i: joined(F.get(before, F.floor(i / step).cast("int")), total(F.slice(v, F.floor(i / step).cast("int") * step + 1, i % step + 1)))),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda step: with_blocks(v, step))).otherwise(v))


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda x, y: x + y)


def located(text: Column, pattern: str) -> Column:
    """Matches as (start, end, value), in code points.  What lies between them tells where they are."""
    none = F.array().cast(f"array<{SPAN}>")

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m))
        ends = running(steps, summed)
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(place(found)))


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def fits(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return luhn(digits)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Entities and secrets as (start, rank of the kind, end, kind, value), in order."""

    def of_kind(rank: int, kind: str) -> Column:
        found = F.filter(located(text, FAST[kind]), lambda s: fits(kind, s["value"]))
        if kind in MUST_HOLD:
            found = F.when(F.contains(text, F.lit(MUST_HOLD[kind])), found).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    return F.array_sort(F.concat(*[of_kind(rank, kind) for rank, kind in enumerate(KINDS[:TERM])]))


def free_words(texts: DataFrame) -> DataFrame:
    """(of, t, start, end) of the words of (of, text, spans) that no span overlaps; t is the word's hash."""
    pieces = F.arrays_zip(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("word"), F.transform(F.split("text", TOKEN, -1), F.length).alias("gap"))
    word = texts.select("of", F.posexplode(pieces).alias("pos", "w")).select("of", "pos", F.col("w.word").alias("word"), "w.gap").filter("word IS NOT NULL")
    ends = F.sum(F.col("gap") + F.length("word")).over(W.partitionBy("of").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    word = word.select("of", F.xxhash64(F.lower("word")).alias("t"), (ends - F.length("word")).alias("start"), ends.alias("end"), F.lit(0).alias("span"))
    span = texts.select("of", F.explode("spans").alias("s")).select("of", F.lit(None).cast("long").alias("t"), "s.start", "s.end", F.lit(1).alias("span"))
    # Of the spans that start up to a word's own start the furthest end, of those that start later the first.
    earlier = W.partitionBy("of").orderBy("start", F.desc("span")).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("of").orderBy(F.desc("start"), "span").rowsBetween(W.unboundedPreceding, 0)
    own = word.unionByName(span).withColumn("reach", F.max(F.when(F.col("span") == 1, F.col("end"))).over(earlier)).withColumn("next", F.min(F.when(F.col("span") == 1, F.col("start"))).over(later))
    over = (F.coalesce("reach", F.lit(0)) > F.col("start")) | ((F.col("next") > F.col("start")) & (F.col("next") < F.col("end")))
    return own.filter((F.col("span") == 0) & ~F.coalesce(over, F.lit(False))).select("of", "t", "start", "end")


def disclosing(texts: DataFrame, free: DataFrame, words: DataFrame, documents: int, disclosure: float, support: int) -> DataFrame:
    """(of, t) of words that reveal an entity of a text; texts has (of, m documents, spans) of each text with entities, free their words, words every document's distinct words."""
    total = F.lit(float(documents))
    named = texts.select("of", "m", F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))).alias("e"))
    entities = named.groupBy("e").agg(F.sum("m").alias("n_e"), F.count("*").alias("texts_e")).filter(F.col("n_e") < documents)
    named = stored(named.join(entities, "e"), "named")
    # A word in more documents than this reaches no PMI that reveals the entity, even if each document of the entity holds it.
    most = F.pow(F.col("n_e").cast("double"), F.lit(disclosure)) * F.pow(total, F.lit(1 - disclosure)) * (1 + 1e-9)
    bound = named.agg(F.max(most)).first()[0] or 0.0
    counts = words.groupBy("t").agg(F.count("*").alias("n_t")).filter(F.col("n_t") <= bound)
    held = free.select("of", "t").distinct()
    held = stored(held.join(counts.hint("merge"), "t"), "held")
    rare = F.log2(total / F.col("n_t")) >= disclosure * F.log2(total)
    # The PMI of an entity of one text is all its words' own information, so its pairs needn't be made.
    alone = (F.col("texts_e") == 1) & F.lit(support > 1)
    own = held.filter(rare).join(named.filter(alone).select("of").distinct(), "of").select("of", "t")
    pairs = named.filter(~alone).join(held, "of").filter(F.col("n_t") <= most)
    judged = pairs.groupBy("e", "t", "n_e", "n_t").agg(F.sum("m").alias("both"), F.count("*").alias("texts"))
    pmi = F.log2(F.col("both") * total / (F.col("n_e") * F.col("n_t")))
    judged = judged.filter((pmi >= disclosure * F.log2(total / F.col("n_e"))) & ((F.col("texts") >= support) | rare)).select("e", "t")
    return own.union(pairs.select("of", "e", "t").join(judged, ["e", "t"]).select("of", "t")).distinct()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, support: int = 2) -> DataFrame:
    """(id, of, base, spans): spans are (start, rank, end, kind) in order; base has the entities alone, of is the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("of"))
    found = rows.select("id", "of", "text", base_spans(F.col("text")).alias("spans"))
    found = stored(found.select("id", "of", "spans", F.when(F.exists("spans", lambda s: s["kind"] != "secret"), F.col("text")).alias("text")), "entities")
    named = F.filter("spans", lambda s: s["kind"] != "secret")
    texts = found.filter("text IS NOT NULL").groupBy("of").agg(F.count("*").alias("m"), F.first("spans").alias("spans"), F.first("text").alias("text"))
    texts = stored(texts, "texts")
    free = stored(free_words(texts), "free-words")
    words = rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.lower))).alias("w")).select(F.xxhash64("w").alias("t"))
    revealing = disclosing(texts.select("of", "m", named.alias("spans")), free, words, found.count(), disclosure, support)
    terms = free.join(revealing, ["of", "t"]).groupBy("of").agg(F.collect_list(F.struct("start", F.lit(TERM).alias("rank"), "end", F.lit("term").alias("kind"))).alias("terms"))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = found.select("id", "of", bare(named).alias("base"), bare(F.col("spans")).alias("found")).join(stored(terms, "terms"), "of", "left")
    return out.select(F.col("id").alias(id_col), "of", "base", F.array_sort(F.concat("found", F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))).alias("spans"))


def redact(text: Column, spans: Column, generalise: bool = False) -> Column:
    """The text with each span replaced by the name of its kind in brackets; of spans that overlap the first.

    generalise puts a wider class in place of a term, [NUMBER] or [NAME] of words in capitals, where it has one.
    """

    def with_pieces(pieces: Column, ends: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            inside = lambda k: F.substr(F.get(pieces, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
            return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.floor((b - 1) / PIECE).cast("int")), inside), "")).otherwise("")

        def name(s: Column) -> Column:
            if not generalise:
                return F.upper(s["kind"])
            word = cut(s["start"], s["end"])
            return F.when(s["kind"] != "term", F.upper(s["kind"])).when(word.rlike("^[0-9]+$"), "NUMBER").when(word.rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")

        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        shown = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(before(i), s["start"]), F.lit("["), name(s), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(shown, ""), cut(before(F.size(spans)), F.length(text)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.substr(text, k * PIECE + 1, F.lit(PIECE)))
    reach = running(F.transform(spans, lambda s: s["end"]), F.array_max)
    return F.when(F.size(spans) == 0, text).otherwise(let(pieces, lambda p: let(reach, lambda ends: with_pieces(p, ends))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: bool = False, **how) -> DataFrame:
    """docs with their texts redacted; a null text stays null."""
    found = find(docs, id_col, text_col, **how).select(F.col(id_col).alias("id"), "of", "spans").dropDuplicates(["id", "of"])
    of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # A row travels as one column, so that its names clash with none here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), of.alias("own_of"))
    out = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_of") == F.col("of")))
    return out.select(*[(redact(F.col("row")[c].cast("string"), F.col("spans"), generalise) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
