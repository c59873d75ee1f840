"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton.  A document is parsed greedily into the
longest phrases that occur in that text.  Phrases are shorter, and more of them are needed, where less text was learned or where a
language is richer, so counts are normalised: they are divided by a rate of the language times the text's symbols.  Rates are
such that between two languages the decision falls midway, in logarithms, between what unseen text of the one and of the other needs;
of all pairs' conditions they are the least-squares solution, in which languages close to each other weigh most.
The language that needs the fewest normalised phrases wins.

Symbols are the UTF-8 bytes of lower-cased letters, so that no letter of any script is merged with
another; every run of other characters counts as one space.  Documents are cut into segments of
``SEGMENT`` symbols and numpy steps through all segments of a batch at once: first each from between
two phrases, then again from the state in which the segment before it ended, as far as that differs
from the first pass, until no state changes.  The phrases are those of a parse from start to end.

Fitting takes whole labelled texts, at most ``docs_per_lang`` (expected) of at most
``max_doc_chars`` characters from each language and at most ``train_chars`` symbols in all of each:
the only bounds, and they hold for fitting alone.  A language of which all texts are longer learns from
their first ``max_doc_chars`` characters.  What is chosen beyond ``train_chars`` tells how many phrases
unseen text of the language needs; a text that needs many more is ``foreign``.  Where all that is chosen is learned, halves of it
parse each other, and the rate is scaled by the logarithm of the length, as phrases are.  Prediction covers every
symbol of every text.

Automata are kept and sent out as lists of transitions, about 12 bytes for each of at most three per symbol learned, and laid out as tables only in a
task: ``SHARD_BYTES`` of tables at a time, one pass over the documents for each.

Edge cases: a text that is null or has no letter gets ``und`` and score 0, and so does every text if
no labelled row exists.  Ties go to the language that sorts first.  Rows are independent; repeated
rows give repeated results.  Further columns are ignored, those named to be carried along may have any name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import frugal, slices, small_batches, stored

SEGMENT = 256
SHARD_BYTES = 128 << 20  # of tables that a task holds
BATCH_BYTES = 1_500_000
PROBE = 4_000  # symbols of a language that the others' automata parse
SLACK = 6  # phrases that a text may need beyond its language's rate
UNKNOWN = "und"
NEW_PHRASE = 1 << 30


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, runs of spaces made one, and how many each text has; table has the symbol of each byte of a letter, 0 is the space."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in lowered])
    starts = np.r_[0, ends[:-1]]
    spoken = letters()[points]
    keep = spoken.copy()
    space_after = np.flatnonzero(~spoken[1:] & spoken[:-1]) + 1
    keep[space_after] = True
    inner = starts[(starts > 0) & (starts < len(points))]
    keep[inner] = spoken[inner]  # a text doesn't start with the space that ends another
    width = np.where(spoken, 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF), 1) * keep
    total = np.r_[0, np.cumsum(width)]
    raw = np.frombuffer(np.where(spoken, points, 32)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return table[raw], total[ends] - total[starts]


@dataclass
class Automaton:
    """The automaton of all substrings of a text, by its transitions (from, symbol, to); state 0 is the first."""

    states: int
    rows: np.ndarray
    symbols: np.ndarray
    to: np.ndarray

    def table(self, width: int) -> np.ndarray:
        """Next state's offset for (state, symbol), NEW_PHRASE added where a phrase ends; the last symbol leaves all as it is."""
        trans = np.full((self.states, width), -1, np.int32)
        trans[self.rows, self.symbols] = self.to
        root = np.where(trans[0] >= 0, trans[0], 0) * width + NEW_PHRASE
        step = np.where(trans >= 0, trans * width, root)
        step[0] = root  # the first state stands between phrases
        step[:, -1] = np.arange(self.states) * width
        return step.astype(np.int32).ravel()


def suffix_automaton(text: list[int]) -> Automaton:
    trans: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(trans)
                trans.append(dict(trans[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    many = np.array([len(row) for row in trans])
    flat = lambda some: np.fromiter(some, np.int32, int(many.sum()))
    return Automaton(len(trans), np.repeat(np.arange(len(trans), dtype=np.int32), many), flat(c for row in trans for c in row), flat(to for row in trans for to in row.values()))


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # symbol of each byte
    automata: list[Automaton]
    width: int
    rate: list[float]  # of each language: phrases per symbol that counts are held against
    limit: list[float]  # of each language: phrases per symbol that its own unseen text stays under

    def shards(self, most: int) -> list[LanguageModel]:
        """The languages in pieces whose tables have at most so many bytes, or of one language."""
        pieces, size = [[]], 0
        for k, a in enumerate(self.automata):
            own = 4 * a.states * self.width
            if pieces[-1] and size + own > most:
                pieces.append([])
                size = 0
            pieces[-1].append(k)
            size += own
        part = lambda listed, ks: [listed[k] for k in ks]
        return [LanguageModel(part(self.langs, ks), self.table, part(self.automata, ks), self.width, part(self.rate, ks), part(self.limit, ks)) for ks in pieces]

    @cached_property
    def steps(self) -> list[np.ndarray]:
        return [a.table(self.width) for a in self.automata]

    def close(self) -> None:
        """Drop the tables: a worker that lives on holds only the automata."""
        self.__dict__.pop("steps", None)

    def phrases(self, sym: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases that each text needs."""
        pieces = -(-counts // SEGMENT)
        text_of = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(counts) - counts)[text_of] + nth * SEGMENT
        size = np.minimum(counts[text_of] - nth * SEGMENT, SEGMENT)
        grid = np.full((SEGMENT, len(text_of)), self.width - 1, np.int32)  # the last symbol leaves all as it is
        row = np.arange(len(sym)) - np.repeat(start, size)
        grid[row, np.repeat(np.arange(len(text_of)), size)] = sym
        later = np.flatnonzero(nth > 0)
        out = np.zeros((len(counts), len(self.langs)), np.int64)
        for k, step in enumerate(self.steps):
            at = np.zeros(len(text_of), np.int32)
            # Of each symbol: the state after it, and whether a phrase began with it.
            trail, began = np.empty(grid.shape, np.int32), np.empty(grid.shape, bool)
            for j in range(SEGMENT):
                to = step.take(at + grid[j])
                began[j] = to >> 30
                trail[j] = at = to & (NEW_PHRASE - 1)
            entered = np.zeros(len(text_of), np.int32)
            while True:
                change = later[trail[-1, later - 1] != entered[later]]
                if not len(change):
                    break
                at = entered[change] = trail[-1, change - 1]
                for j in range(SEGMENT):
                    to = step.take(at + grid[j, change])
                    at = to & (NEW_PHRASE - 1)
                    began[j, change] = to >> 30
                    differs = at != trail[j, change]
                    trail[j, change] = at
                    if not differs.all():
                        change, at = change[differs], at[differs]
                        if not len(change):
                            break
            out[:, k] = np.bincount(text_of, began.sum(0), len(counts))
        return out

    def predict(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Of each text: its symbols (0 where it has no letter), the place of the best language, the phrases that this and the next best need, and whether the best one's limit is passed."""
        sym, counts = symbols([t or "" for t in texts], self.table)
        spoken = np.add.reduceat(np.r_[sym > 0, False].astype(np.int64), np.minimum(np.cumsum(counts) - counts, len(sym))) * (counts > 0) > 0
        n = np.where(spoken, counts, 0)
        if not self.langs or not len(sym):
            return {"n": n, "best": np.zeros(len(n), np.int64), "need": n, "least": n.astype(float), "next": n.astype(float), "foreign": np.zeros(len(n), bool)}
        need = self.phrases(sym, counts)
        usual = 1 + np.array(self.rate)[None] * counts[:, None]
        share = need / usual
        best = share.argmin(1)
        own = np.arange(len(n)), best
        ordered = np.sort(share, 1)
        following = ordered[:, 1] if len(self.langs) > 1 else np.maximum(counts / usual[:, 0], ordered[:, 0])
        return {"n": n, "best": best, "need": need[own], "least": ordered[:, 0], "next": following, "foreign": need[own] > np.array(self.limit)[best] * counts + SLACK}


def rate_of(automaton: Automaton, width: int, sym: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Phrases per symbol that texts need beyond their first phrase: in all, and each."""
    own = LanguageModel([""], np.empty(0), [automaton], width, [0.0], [0.0])
    need = own.phrases(sym, counts)[:, 0]
    return float(np.maximum(need - 1, 0).sum() / max(1, counts.sum())), np.maximum(need - SLACK, 0) / np.maximum(counts, 1)


def build(samples: dict[str, list[str]], train_chars: int, margin: float = 2.25, unknown: float = 0.55) -> LanguageModel:
    """The model of the texts given for each language.  margin times the rate that 95 of 100 of its unseen texts stay under is its limit, but at most unknown."""
    langs = sorted(samples)
    used = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            used[np.frombuffer("".join(c for c in t.lower() if letters()[ord(c)]).encode("utf-8", "surrogatepass"), np.uint8)] = True
    alphabet = np.flatnonzero(used)
    width = len(alphabet) + 3  # space first; then the bytes of known letters, all other bytes, what fills a segment
    table = np.full(256, width - 2, np.int32)
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    table[32] = 0
    automata, rates, limit, probes = [], [], [], []
    for lang in langs:
        sym, counts = symbols(samples[lang], table)
        learned = sym[:train_chars].tolist()
        automata.append(suffix_automaton(learned))
        unseen = np.cumsum(counts) - counts >= train_chars
        if unseen.any():
            rate, each = rate_of(automata[-1], width, sym[int(counts[~unseen].sum()) :], counts[unseen])
            limit.append(float(min(unknown, margin * np.quantile(each, 0.95))))
        else:
            half = len(learned) // 2
            parts = (learned[:half], learned[half:])
            halves = [rate_of(suffix_automaton(a), width, np.array(b, np.int64), np.array([len(b)]))[0] for a, b in (parts, parts[::-1]) if a and b]
            rate = np.mean(halves) * np.log(max(2, half)) / np.log(max(2, len(learned))) if halves else 1.0
            limit.append(unknown)
        rates.append(float(max(rate, 1 / 256)))
        probes.append(sym[:PROBE])
    return LanguageModel(langs, table, automata, width, balanced(automata, width, rates, probes), limit)


def balanced(automata: list[Automaton], width: int, own: list[float], probes: list[np.ndarray]) -> list[float]:
    """The rates that counts are held against, from those of unseen text of each language itself and some text of all others."""
    n = len(own)
    if n < 2:
        return own
    sym, counts = np.concatenate(probes), np.array([len(p) for p in probes])
    logs = np.empty((n, n))  # of the parse by one language's automaton (row) of another one's text
    for j, a in enumerate(automata):
        need = LanguageModel([""], np.empty(0), [a], width, [0.0], [0.0]).phrases(sym, counts)[:, 0]
        logs[j] = np.log(np.maximum(need - 1, 1) / np.maximum(counts, 1))
        logs[j, j] = np.log(own[j])
    j, k = np.triu_indices(n, 1)
    on_first, on_second = logs[j, j] - logs[k, j], logs[j, k] - logs[k, k]
    weight = 1 / np.maximum((on_second - on_first) / 2, 0.02)
    rows = np.zeros((len(j) + 1, n))
    rows[np.arange(len(j)), j], rows[np.arange(len(j)), k] = weight, -weight
    rows[-1] = 1 / n
    goal = np.r_[weight * (on_first + on_second) / 2, np.diag(logs).mean()]
    return np.exp(np.linalg.lstsq(rows, goal, rcond=None)[0]).round(9).tolist()  # equal languages tie


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", docs_per_lang: int = 60, max_doc_chars: int = 8_000, train_chars: int = 30_000) -> LanguageModel:
    """Learn from rows with a language: an expected ``docs_per_lang`` of each, chosen by a hash of their key."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key_col).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    short = F.length("text") <= max_doc_chars
    counts = {r.lang: (r.n, r.short) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).collect()}  # one row a language
    if not counts:
        return build({}, train_chars)
    grain = 1 << 40
    share = F.create_map(*[F.lit(x) for lang, (n, few) in counts.items() for x in (lang, min(grain, docs_per_lang * grain // (few or n)))])
    only_long = [lang for lang, (_, few) in counts.items() if not few]
    chosen = rows.filter((short | F.col("lang").isin(only_long)) & (F.pmod("h", F.lit(grain)) < share[F.col("lang")])).withColumn("text", F.substring("text", 1, max_doc_chars)).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r.h, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return build(samples, train_chars)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, phrase_rate, foreign), after the columns to carry along."""
    spark = docs.sparkSession
    small_batches(spark)
    carry = carry or [id_col]
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("t"))
    names = out.columns
    kinds = ", ".join(f"{n} {t}" for n, t in out.dtypes)
    found = "n long, lang string, need long, least double, next double, foreign boolean"
    states = ["n", "lang", "need", "least", "next", "foreign"]
    shards = model.shards(SHARD_BYTES)
    for k, part_of_model in enumerate(shards):
        shared = spark.sparkContext.broadcast(part_of_model)  # transitions: a fraction of SHARD_BYTES

        @frugal
        def run(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = not k) -> Iterator[pa.RecordBatch]:
            own = shared.value
            try:
                for batch in batches:
                    for at, end in slices(batch.column(len(carry)), BATCH_BYTES):
                        part = batch.slice(at, end - at)
                        got = own.predict(part.column(len(carry)).to_pylist())
                        got["lang"] = np.array(own.langs or [UNKNOWN], object)[got["best"]]
                        if not first:
                            old = {c: part.column(len(names) + i).to_numpy(zero_copy_only=False) for i, c in enumerate(states)}
                            won = got["least"] < old["least"]
                            following = np.where(won, np.minimum(got["next"], old["least"]), np.minimum(old["next"], got["least"]))
                            got = {c: np.where(won, got[c], old[c]) for c in states} | {"n": got["n"], "next": following}
                        kinds_of = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array(got[c], t) for c, t in zip(states, kinds_of, strict=True))], [*names, *states])
            finally:
                own.close()

        out = out.mapInArrow(run, f"{kinds}, {found}")
        if len(shards) > 1:  # one shard's automata at a time
            out = stored(out, "languages")
            shared.unpersist()
    some = (F.col("n") > 0) & F.lit(bool(model.langs))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        F.when(some, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, F.coalesce(1 - F.try_divide(F.col("least"), F.col("next")), F.lit(0.0))).otherwise(0.0).alias("score"),
        F.when(some, F.col("need") / F.col("n")).alias("phrase_rate"),
        (some & F.col("foreign")).alias("foreign"),
    )


def fold(key_col: str, parts: int) -> Column:
    """The fold of a row: crc32 of its key's text, modulo parts."""
    return F.pmod(F.crc32(F.col(key_col).cast("string")), F.lit(parts))
