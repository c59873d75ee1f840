"""Permutations that are computed, not sorted: a keyed bijection of the places 0 to n - 1.

A place is written as two digits, to bases of about sqrt(n), whose product is at least n.  Six Feistel rounds add to
one digit a hash of the other and a key; each round can be undone, so that together they permute the numbers of two
digits.  The few that are n or more are sent through again until they are under n, which leaves a permutation of the
places.  A row's new place thus follows from its old one, n and the keys, wherever the row lies.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectlens.functions.columns import let

# A prime modulus and odd multipliers under 2^31, so that no product passes 2^62.
PRIME, FIRST, SECOND = 2147483647, 1103515245, 1597334677
ROUNDS = 6


def round_keys(*of: object) -> list[int]:
    """The keys of a permutation's rounds, 28 bits each, from what names it."""
    name = "|".join(map(str, of))
    return [int(hashlib.md5(f"{name}|{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def key_columns(*of: object) -> list[Column]:
    """The same of columns."""
    name = F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in of])
    return [F.conv(F.substring(F.md5(F.concat_ws("|", name, F.lit(str(r)))), 1, 7), 16, 10).cast("long") for r in range(ROUNDS)]


def bases(n: Column) -> tuple[Column, Column]:
    first = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return first, F.greatest(F.ceil(n / first), F.lit(1)).cast("long")


def mixed(digit: Column, key: Column) -> Column:
    inner = F.shiftright((digit + key) % PRIME * FIRST + 12345, 13)
    return F.shiftright(inner % PRIME * SECOND + 97, 17)


def again(x: Column, first: Column, second: Column, keys: list[Column]) -> Column:
    """The rounds as one expression, for the few numbers that go through them again."""

    def rounds(high: Column, low: Column, r: int) -> Column:
        if r == ROUNDS:
            return high * second + low
        if r % 2 == 0:
            return let((high + mixed(low, keys[r])) % first, lambda h: rounds(h, low, r + 1))
        return let((low + mixed(high, keys[r])) % second, lambda w: rounds(high, w, r + 1))

    return let(F.floor(x / second).cast("long"), lambda h: let(x % second, lambda w: rounds(h, w, 0)))


def with_place(df: DataFrame, place: str, n: Column | int, keys: list[Column] | list[int], name: str) -> DataFrame:
    """df with the place that each row's place goes to; n and the keys may differ from row to row."""
    size = F.lit(n) if isinstance(n, int) else n
    first, second = map(F.lit, sides(n)) if isinstance(n, int) else bases(size)
    put = df.withColumns({"_n": size.cast("long"), "_a": first.cast("long"), "_w": second.cast("long"), "_at": F.col(place).cast("long")} | {f"_k{r}": F.lit(k) if isinstance(k, int) else k for r, k in enumerate(keys)})
    # A projection for each round, none of which repeats the one before it.
    put = put.withColumns({"_high": F.floor(F.col("_at") / F.col("_w")).cast("long"), "_low": F.col("_at") % F.col("_w")})
    own = [F.col(f"_k{r}").cast("long") for r in range(ROUNDS)]
    for r in range(ROUNDS):
        one, other, base = ("_high", "_low", "_a") if r % 2 == 0 else ("_low", "_high", "_w")
        put = put.withColumn(one, (F.col(one) + mixed(F.col(other), own[r])) % F.col(base))
    put = put.withColumn("_to", F.col("_high") * F.col("_w") + F.col("_low"))
    a, w, size = F.col("_a"), F.col("_w"), F.col("_n")
    walked = F.aggregate(F.sequence(F.lit(0).cast("long"), a * w - size), F.col("_to"), lambda x, _: F.when(x < size, x).otherwise(again(x, a, w, own)))
    return put.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_to") < size, F.col("_to")).otherwise(walked).alias(name))


def sides(n: int) -> tuple[int, int]:
    first = max(1, math.isqrt(max(n - 1, 0)) + 1) if n > 0 else 1
    return first, max(1, -(-n // first))


def place_of(x: int, n: int, keys: list[int]) -> int:
    """One place, in plain numbers."""
    a, w = sides(n)
    mix = lambda d, k: (((((d + k) % PRIME * FIRST + 12345) >> 13) % PRIME) * SECOND + 97) >> 17
    while True:
        high, low = divmod(x, w)
        for r, k in enumerate(keys):
            if r % 2 == 0:
                high = (high + mix(low, k)) % a
            else:
                low = (low + mix(high, k)) % w
        x = high * w + low
        if x < n:
            return x


def place_sql(places: str, by: str) -> str:
    """Tables that end in moved(by, k, dest): the same in SQL, of a table ``places`` (by, n, name) with n places for each permutation called name."""
    mix = lambda d, r: f"((((({d} + ks[{r + 1}]) % {PRIME} * {FIRST} + 12345) >> 13) % {PRIME}) * {SECOND} + 97) >> 17"
    steps, table = [], "s"
    for r in range(ROUNDS):
        high, low = (f"(high + ({mix('low', r)})) % a AS high", "low") if r % 2 == 0 else ("high", f"(low + ({mix('high', r)})) % w AS low")
        steps.append(f"{table}{r} AS (SELECT {by}, n, a, w, ks, x, {high}, {low} FROM {f'{table}{r - 1}' if r else 'split'})")
    return f"""bases AS (SELECT *, greatest(ceil(sqrt(n)), 1)::BIGINT AS a, list_transform(range(0, {ROUNDS}), lambda r: ('0x' || substr(md5(name || '|' || r), 1, 7))::BIGINT) AS ks FROM {places}),
sized AS (SELECT *, greatest(ceil(n / a), 1)::BIGINT AS w FROM bases),
split AS (SELECT {by}, n, a, w, ks, x, x // w AS high, x % w AS low FROM (SELECT *, unnest(range(0, a * w)) AS x FROM sized)),
{", ".join(steps)},
rounds AS (SELECT {by}, n, x, high * w + low AS dest FROM s{ROUNDS - 1}),
walk AS (SELECT {by}, n, x AS k, dest FROM rounds WHERE x < n UNION ALL SELECT {", ".join(f"walk.{c.strip()}" for c in by.split(","))}, walk.n, walk.k, rounds.dest FROM walk JOIN rounds ON {" AND ".join(f"walk.{c.strip()} = rounds.{c.strip()}" for c in by.split(","))} AND walk.dest = rounds.x WHERE walk.dest >= walk.n),
moved AS (SELECT {by}, k, dest FROM walk WHERE dest < n)"""
