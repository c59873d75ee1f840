"""Repair of conversations by error-correcting Earley parsing of their roles.

The grammar of roles says that a conversation is nothing, or turns of user and assistant in pairs after at
most one turn of the system.  Its error productions let a row be deleted, its role be changed to user or
assistant, or a row of either be inserted, each at a cost.  A chart item is a rule with a dot; it holds
the least (cost, audit) of any way to it, the audit being the initials of the edits so far, and of equal
costs the audit least in ASCII.  The item that completes the start symbol after the last row gives the
repair.  The grammar is left-linear, so that every item starts before the first row: a chart set has at most
ten items, and only the current set is kept.  Long audits aren't compared whole: every ``REBASE`` rows those
of the live items are ranked, less the insertions that they end with, and go on from their ranks.  Two
audits of as many rows, both ending in a row's edit, are equal or differ within both, so that ranks and the
letters since order them as the whole audits do.

Rows are ordered by turn (nulls first), then role, then md5 of the text; rows equal in these are
interchangeable.  Texts of one conversation, role and md5 are taken as equal.  A row's first fault counts: blank, duplicate of an earlier
row, truncated.  Earlier rows of the same role and text are found by a join on them, not in a conversation's task.

Rows without their texts, about 60 bytes each, are parsed as sorted streams: a conversation is read in
its order and nothing of it is kept but its chart and audit, a byte or so a row.  Texts are shuffled once, sorted and met
by their audits as streams too, so a conversation of any length takes one batch of memory.  What follows
the order of one conversation is sequential by nature and is one task; other conversations are in other tasks.

Edge cases: null roles and texts are taken as one space, so a text that is null is blank and a role that is null, empty or
unknown can't be kept; null turns come first and count in no gap; rows without a conversation are one conversation.  Repeated rows are
duplicates.  An empty table gives an empty result.  Columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectlens.llm.shared import frugal, small_batches

BLANK_CHARS = r"\x20\x09-\x0D"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5  # a truncated row that stays costs this besides
NAMES = {"u": "user", "a": "assistant"}  # what rows can be made or inserted as
RULES = [("S", ""), ("S", "E"), ("E", "Oa"), ("O", "Bu"), ("B", ""), ("B", "s"), ("B", "E")]
REBASE = 64
SHORT = 64  # rows up to which a conversation's parse is remembered

Item = tuple[int, int]  # rule and dot
Value = tuple[int, int, str]  # cost, rank of the audit up to the last rebase, letters since

#: Items that go on when a symbol of the grammar is complete.
AFTER = {lhs: [(k, 1) for k, (_, rhs) in enumerate(RULES) if rhs[:1] == lhs] for lhs, _ in RULES}
DONE = {(k, len(rhs)) for k, (lhs, rhs) in enumerate(RULES) if lhs == "S"}


def awaited(item: Item) -> str:
    """The symbol after the dot, none in a complete item."""
    return RULES[item[0]][1][item[1] : item[1] + 1]


def edited(value: Value, letter: str, more: int = 0) -> Value:
    return value[0] + COST[letter] + more, value[1], value[2] + letter


class Chart:
    """An Earley chart that is fed a row at a time.

    A row is one letter: ``d`` if it must be deleted, else its role's initial if that is s, u or a, else
    ``o``; in capitals if the row is truncated.
    """

    def __init__(self):
        self.rows = 0
        self.pasts: list[tuple] = [()]  # by rank: (past before it, letters), down to the empty one
        self.items = self.closed({(k, 0): (0, 0, "") for k in range(len(RULES))})

    @staticmethod
    def closed(items: dict[Item, Value]) -> dict[Item, Value]:
        """Items with what follows from them without a row: completions and insertions, least value first."""
        heap = [(v, item) for item, v in items.items()]
        heapify(heap)
        out: dict[Item, Value] = {}
        while heap:
            value, item = heappop(heap)
            if item in out:
                continue
            out[item] = value
            rule, dot = item
            symbol = awaited(item)
            if not symbol:
                for on in AFTER[RULES[rule][0]]:
                    heappush(heap, (value, on))
            elif symbol in NAMES:
                heappush(heap, (edited(value, "I"), (rule, dot + 1)))
        return out

    def add(self, row: str) -> None:
        new: dict[Item, Value] = {}

        def put(item: Item, value: Value) -> None:
            if item not in new or value < new[item]:
                new[item] = value

        initial, more = row.lower(), TRUNCATED if row.isupper() else 0
        for item, value in self.items.items():
            symbol = awaited(item)
            if symbol.islower() or item in DONE:
                put(item, edited(value, "D"))
            if symbol.islower() and initial != "d":
                if symbol == initial:
                    put((item[0], item[1] + 1), edited(value, "K", more))
                elif symbol in NAMES:
                    put((item[0], item[1] + 1), edited(value, "R", more))
        self.items = self.closed(new)
        self.rows += 1
        if self.rows % REBASE == 0:
            self.rebase()

    def rebase(self) -> None:
        settled = {(rank, letters.rstrip("I")) for _, rank, letters in self.items.values()}
        order = {past: k for k, past in enumerate(sorted(settled))}
        self.items = {item: (cost, order[rank, letters.rstrip("I")], letters[len(letters.rstrip("I")) :]) for item, (cost, rank, letters) in self.items.items()}
        self.pasts = [(self.pasts[rank], letters) for rank, letters in order]

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the repair of the rows so far."""
        cost, rank, letters = min(v for item, v in self.items.items() if item in DONE)
        parts, past = [letters], self.pasts[rank]
        while past:
            past, letters = past
            parts.append(letters)
        return cost, "".join(reversed(parts))


@lru_cache(maxsize=100_000)
def parsed(rows: str) -> tuple[int, str]:
    chart = Chart()
    for row in rows:
        chart.add(row)
    return chart.best()


class Parser:
    """One conversation's rows in order: its counts, and its parse."""

    def __init__(self):
        self.seen = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.letters: list[str] = []
        self.chart: Chart | None = None

    def add(self, turn: int | None, role: str, digest: str, blank: bool, cut: bool, later: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        same = self.before is not None and self.before == (turn, role, digest)
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = (turn, role, digest)
        self.seen += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if blank:
            self.blank += 1
            letter = "d"
        elif later or same:
            self.duplicate += 1
            letter = "d"
        elif cut:
            self.truncated += 1
            letter = letter.upper()
        if self.chart is not None:
            self.chart.add(letter)
            return
        self.letters.append(letter)
        if len(self.letters) > SHORT:
            self.chart = Chart()
            for x in self.letters:
                self.chart.add(x)

    def found(self) -> tuple:
        cost, audit = self.chart.best() if self.chart else parsed("".join(self.letters))
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, digest): what orders rows, beside the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"))


TEXTS = {"audit", "edit", "role", "text", "repaired_sha256"}


def by_conversation(run: Callable[[Iterator[tuple]], Iterator[tuple]], names: list[str]) -> Callable:
    """A function on a partition's batches from one on its rows; ``names`` are the columns that it yields."""

    @frugal
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for one in batches:
                yield from zip(*[c.to_pylist() for c in one.columns], strict=True)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            # Types are named: a batch may have no value in a column.
            kinds = [None if n == "conv" else pa.string() if n in TEXTS else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        out, size = [], 0
        for row in run(rows()):
            out.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size > 1 << 22:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return wrapped


def parse(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[conv_col]
    lean = ordered(rows, conv_col, turn_col, role_col, text_col).select(
        "conv",
        "turn",
        "role",
        "digest",
        (~F.col("text").rlike(f"[^{BLANK_CHARS}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANK_CHARS}]*\z")).alias("cut"),
    )
    # Texts said in more than one turn, with the first of them; copies within a turn lie side by side in the stream.
    first = lean.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).filter("first < last")
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = lean.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    flagged = met.select("conv", "turn", "role", "digest", "blank", "cut", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("later"))

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        now, parser = None, None
        for conv, *row in stream:
            if parser is None or conv != now:
                if parser is not None:
                    yield now, *parser.found()
                now, parser = conv, Parser()
            parser.add(*row)
        if parser is not None:
            yield now, *parser.found()

    streams = flagged.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")
    schema = f"conv {kind}, " + ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in FOUND)
    return streams.mapInArrow(typed(by_conversation(run, ["conv", *FOUND]), kind), schema)


def typed(run: Callable, kind: str) -> Callable:
    """run with its first column in the type of the conversations' ids, which all-null batches don't show."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[pa.DataType] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of[:] = [batch.schema.field(0).type]
                yield batch

        for out in run(watched()):
            yield out.set_column(0, out.schema.field(0).name, out.column(0).cast(of[0]))

    return wrapped


class Writer:
    """What an audit makes of rows that come in order: (place, edit, role, text), deleted rows without a place."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.shift = (len(audit) - audit.count("D")) % 2  # whether the first that stays is the system's

    def role(self) -> str:
        return NAMES["ua"[(self.place - self.shift) % 2]]

    def inserted(self) -> Iterator[tuple]:
        """Rows that the audit puts before the next one."""
        while self.audit[self.at : self.at + 1] == "I":
            yield self.place, "I", self.role(), ""
            self.at, self.place = self.at + 1, self.place + 1

    def add(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            yield None, edit, role, text
        else:
            yield self.place, edit, role if edit == "K" else self.role(), text
            self.place += 1


def repair(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): all rows after the edits of ``audits`` (conv, audit), in order within partitions.

    Deleted rows are among them, with no place.  A conversation lies in one partition.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[conv_col]
    texts = ordered(rows, conv_col, turn_col, role_col, text_col)
    heads = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"), F.lit(True).alias("head"))
    streams = texts.withColumn("head", F.lit(False)).unionByName(heads).repartition("conv").sortWithinPartitions("conv", F.desc("head"), "turn", "role", "digest").select("conv", "role", "text", "head")

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        now, writer = None, None
        for conv, role, text, head in stream:
            if head:
                if writer is not None:
                    yield from ((now, *x) for x in writer.inserted())
                now, writer = conv, Writer(text)
            else:
                yield from ((now, *x) for x in writer.add(role, text))
        if writer is not None:
            yield from ((now, *x) for x in writer.inserted())

    made = by_conversation(run, ["conv", "place", "edit", "role", "text"])
    return streams.mapInArrow(typed(made, kind), f"conv {kind}, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of what ``repair`` returned: sha256 of ``role:text`` joined by newlines, fed row by row."""
    kind = dict(repaired.dtypes)["conv"]

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        now, chain = None, None
        for conv, place, role, text in stream:
            if chain is None or conv != now:
                if chain is not None:
                    yield now, chain.hexdigest()
                now, chain = conv, hashlib.sha256()
            if place is not None:
                chain.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if chain is not None:
            yield now, chain.hexdigest()

    made = by_conversation(run, ["conv", "repaired_sha256"])
    return repaired.select("conv", "place", "role", "text").mapInArrow(typed(made, kind), f"conv {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32(``conv_id:turn``) modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 gives it to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    many = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(way == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), many)).alias("_")).drop("_")


def _added(value: str, letter: str, cost: str) -> str:
    return f"printf('%09d', left({value}, 9)::BIGINT + {cost}) || substr({value}, 10) || '{letter}'"


def _step(z: str, x: str) -> str:
    """The list of values after a row, x being (initial, cost if truncated, whether it must go)."""
    stays = lambda v, t: f"CASE WHEN {x}[3] = '1' THEN {NONE} WHEN {x}[1] = '{t}' THEN {_added(v, 'K', f'{x}[2]::BIGINT')} ELSE {_added(v, 'R', f'1 + {x}[2]::BIGINT')} END"
    b, s, u, a = (f"{z}[{k}]" for k in (1, 2, 3, 4))
    system = f"CASE WHEN {x}[3] = '0' AND {x}[1] = 's' THEN {_added(b, 'K', f'{x}[2]::BIGINT')} ELSE {NONE} END"
    return f"[{_added(b, 'D', '2')}, least({_added(s, 'D', '2')}, {system}), least({_added(u, 'D', '2')}, {', '.join(stays(v, 'u') for v in (b, s, a))}), least({_added(a, 'D', '2')}, {stays(u, 'a')})]"


def _closed(y: str) -> str:
    """The list of values with those that insertions lead to."""
    user = f"least(w[3], {', '.join(_added(v, 'I', '5') for v in ('w[1]', 'w[2]', 'w[4]'))})"
    first = f"list_transform([{y}], lambda w: [w[1], w[2], {user}, w[4]])[1]"
    return f"list_transform([{first}], lambda v: [v[1], v[2], v[3], least(v[4], {_added('v[3]', 'I', '5')})])[1]"


# The same without a grammar, by what came last: nothing, the system, a user, an assistant.  A value is nine digits of cost, then the audit.
NONE = "'900000000'"
START = f"['000000000', {NONE}, {NONE}, {NONE}]"
ORACLE = rf"""
WITH p AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS tab),
t AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT rid, regexp_extract_all(hex(encode(k)), '[0-9A-F]') AS digits FROM t),
n AS (SELECT rid, list_transform(range(0, len(digits)), lambda i: ('0x' || digits[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])::BIGINT) AS half FROM h),
c AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, half), lambda a, b: xor(a >> 4, tab[(xor(a, b) & 15) + 1]::BIGINT)), 4294967295) % 20 AS way FROM n, p),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM t JOIN c USING (rid)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS n FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS two FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM e),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts,
    list([left(role, 1), CASE WHEN fault = 'truncated' THEN '5' ELSE '0' END, CASE WHEN fault IN ('blank', 'duplicate') THEN '1' ELSE '0' END] ORDER BY n) AS steps
  FROM f GROUP BY conv_id
),
v AS (SELECT *, list_reduce(list_prepend({_closed(START)}, steps), lambda z, x: {_closed(_step("z", "x"))}) AS z FROM g),
r AS (SELECT *, left(least(z[1], z[4]), 9)::BIGINT AS cost, substr(least(z[1], z[4]), 10) AS audit FROM v),
s AS (SELECT *, len(replace(audit, 'D', '')) % 2 AS shift FROM r),
q AS (
  SELECT *, list_transform(range(1, len(audit) + 1), lambda k:
    CASE WHEN audit[k] = 'D' THEN NULL ELSE
      CASE WHEN audit[k] = 'K' THEN roles[len(replace(left(audit, k), 'I', ''))] WHEN (len(replace(left(audit, k), 'D', '')) - 1 - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN audit[k] = 'I' THEN '' ELSE texts[len(replace(left(audit, k), 'I', ''))] END
    END) AS lines FROM s
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x: x IS NOT NULL), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN q ON i.conv_id IS NOT DISTINCT FROM q.conv_id
"""
