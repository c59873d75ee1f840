import hashlib
import itertools
import random
import re
import zlib

from effectlens.llm import conversations as C
from effectlens.llm.queries import op13_conversation_repair
from tests.against import SF

LEGAL = re.compile("(s?(ua)+)?")


def brute(rows: str) -> tuple[int, str]:
    """All edits of all rows, with up to three insertions at any place."""
    best = None
    slots = len(rows) + 1
    for puts in (p for n in range(4) for p in itertools.combinations_with_replacement(range(slots), n)):
        for made in itertools.product("ua", repeat=len(puts)):
            ways = []
            for row in rows:
                more = 5 if row.isupper() else 0
                way = [("D", "", 2)]
                if row != "d":
                    way += [("R", r, 1 + more) for r in "ua"] + [("K", row.lower(), more)]
                ways.append(way)
            for chosen in itertools.product(*ways):
                audit, roles, cost = "", "", 5 * len(puts)
                for k in range(slots):
                    for p, m in zip(puts, made, strict=True):
                        if p == k:
                            audit, roles = audit + "I", roles + m
                    if k < len(rows):
                        audit, roles, cost = audit + chosen[k][0], roles + chosen[k][1], cost + chosen[k][2]
                if LEGAL.fullmatch(roles):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_least_repairs_equal_all_edits():
    for n in range(4):
        for rows in itertools.product("dsuaoSUAO", repeat=n):
            if n < 3 or random.Random("".join(rows)).random() < 0.15:
                assert C.parsed("".join(rows)) == brute("".join(rows)), rows


def direct(rows: str) -> tuple[int, str]:
    """The same by what came last, with audits as whole strings."""
    far = (10**9, "")
    more = lambda v, x, c=0: (v[0] + C.COST[x] + c, v[1] + x)

    def closed(z):
        z["u"] = min(z["u"], *(more(z[k], "I") for k in "bsa"))
        z["a"] = min(z["a"], more(z["u"], "I"))
        return z

    z = closed({"b": (0, ""), "s": far, "u": far, "a": far})
    for row in rows:
        cost = 5 if row.isupper() else 0
        new = {k: more(v, "D") for k, v in z.items()}
        if row != "d":
            if row.lower() == "s":
                new["s"] = min(new["s"], more(z["b"], "K", cost))
            for to, sources in (("u", "bsa"), ("a", "u")):
                for k in sources:
                    new[to] = min(new[to], more(z[k], "K" if row.lower() == to else "R", cost))
        z = closed(new)
    return min(z["b"], z["a"])


def test_long_conversations_are_ranked_as_whole_audits_are():
    rng = random.Random(3)
    for _ in range(60):
        letters = rng.choice(["uaUA", "dsuaoSUAO", "o", "oO", "sd", "uuuud", "sua"])
        rows = "".join(rng.choice(letters) for _ in range(rng.randint(0, 700)))
        assert C.parsed(rows) == direct(rows)


def whole(rows):
    """{conv: (counts.., cost, audit, hash)} of (conv, turn, role, text), by the rules."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        seen, letters, blank, again, cut = set(), "", 0, 0, 0
        for _, _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not last:
                blank, letter = blank + 1, "d"
            elif (role, text) in seen:
                again, letter = again + 1, "d"
            elif last[0] not in ".!?":
                cut, letter = cut + 1, letter.upper()
            seen.add((role, text))
            letters += letter
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = direct(letters)
        shift, said, at = (len(audit) - audit.count("D")) % 2, [], 0
        for x in audit:
            if x == "I":
                said.append(("user", "assistant")[(len(said) - shift) % 2] + ":")
                continue
            role, text = mine[at][2:]
            at += 1
            if x != "D":
                said.append((role if x == "K" else ("user", "assistant")[(len(said) - shift) % 2]) + ":" + text)
        out[conv] = (gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def repaired(df):
    audits = C.parse(df).cache()
    hashed = {r.conv: r.repaired_sha256 for r in C.digests(C.repair(df, audits)).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashed[r.conv]) for r in audits.collect()}


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " ", None, "Why? \n", "日本。", "Well!", "x" * 200_000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(7, k, "user" if k % 2 == 0 else "assistant", f"Line {k % 900}.") for k in range(3000)]
    df = spark.createDataFrame([(*r, 1, "z", False) for r in rows], "conv_id long, turn long, role string, text string, conv int, digest string, head boolean")
    assert repaired(df) == whole(rows)
    named = spark.createDataFrame([(str(c), *r) for c, *r in rows], "conv_id string, turn int, role string, text string")
    assert repaired(named) == whole([(str(c), *r) for c, *r in rows])
    assert C.parse(df.limit(0)).count() == 0 and C.repair(df.limit(0), C.parse(df.limit(0))).count() == 0


def test_repaired_rows_are_legal_and_say_what_was_done(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "So?"), (1, 3, "user", ""), (1, 4, "tool", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = C.parse(df)
    assert audits.first().audit == "KRKDD" and audits.first().cost == 5
    got = C.repair(df, audits).collect()
    assert [(r.place, r.edit, r.role) for r in got] == [(0, "K", "system"), (1, "R", "user"), (2, "K", "assistant"), (None, "D", "user"), (None, "D", "tool")]


def test_batches_without_a_place_or_an_id(spark):
    long = "x" * 3_000_000
    rows = [(c, k, "tool", "") for c in (None, 1) for k in range(3)] + [(c, 3 + k, "user", f"{k}{long}") for c in (None, 1) for k in range(2)] + [(2, k, r, f"{r}{k}{long}.") for k, r in enumerate(["user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = C.repair(df, C.parse(df)).select("conv", "place", "edit").collect()
    assert sorted((r.edit, r.place) for r in got if r.conv == 2) == [("K", 0), ("K", 1)]
    assert all(r.edit == "D" and r.place is None for r in got if r.conv != 2) and len(got) == 12


def test_dropped_conversations_stay_in_the_query(spark, tmp_path):
    folder = tmp_path / "in"
    ways = {k: zlib.crc32(f"{k}:0".encode()) % 20 for k in range(60)}
    spark.createDataFrame([(k, 0, "user", "Hi.") for k in range(60)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: r for r in op13_conversation_repair(spark, str(folder)).collect()}
    assert len(got) == 60
    gone = [got[k] for k, w in ways.items() if w == 0]
    assert gone and all((r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256().hexdigest()) for r in gone)


def test_the_query_equals_plain_python(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        text, role = " " if r.text is None else r.text, r.role
        way = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        rows += [(r.conv_id, r.turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in op13_conversation_repair(spark, SF).collect()}
    expected = whole(rows)
    assert {k: got[k] for k in expected} == expected
