"""Conversation repair against every edit sequence, a program over whole strings, SQL and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C

SF = "/root/testdata/sf0.01"
CONV = "conv_id long, turn long, role string, text string, `is_turn` string, `conv` long"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.rstrip(C.SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def repair(turns):
    """(cost, audit, repaired): one program with whole audits as strings."""
    states = {"": (0, "", ())}  # by repaired initials' last letter

    def put(new, letter, cost, audit, done):
        if letter not in new or (cost, audit) < new[letter][:2]:
            new[letter] = (cost, audit, done)

    def ins(states):
        out = dict(states)
        for _ in range(2):
            for letter, (c, a, d) in list(out.items()):
                role = "assistant" if letter == "u" else "user"
                put(out, role[0], c + 3, a + "I", (*d, (role, "")))
        return out

    for (role, text), fault in zip(turns, faults(turns), strict=True):
        new = {}
        for letter, (c, a, d) in ins(states).items():
            put(new, letter, c + 4, a + "D", d)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if (letter, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                put(new, role[0], c + extra, a + "K", (*d, (role, text)))
            to = "assistant" if letter == "u" else "user"
            put(new, to[0], c + 3 + extra, a + "R", (*d, (to, text)))
        states = new
    return min((v for k, v in ins(states).items() if k in ("", "a")), key=lambda v: v[:2])


def every_audit(turns):
    """The best (cost, audit) over all edit sequences with at most two inserts in a row."""
    best = None
    flt = faults(turns)
    for runs in itertools.product(range(3), repeat=len(turns) + 1):
        for acts in itertools.product("KRD", repeat=len(turns)):
            initials, cost = "", 3 * sum(runs)
            audit = ""
            for n, a, (role, _), fault in zip(runs, acts, turns, flt, strict=False):
                audit += "I" * n + a
                for _ in range(n):
                    initials += "a" if initials[-1:] == "u" else "u"
                if a == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 10**9
                cost += 3 * (a == "R") + 3 * (fault == "truncated")
                initials += role[:1] if a == "K" else "a" if initials[-1:] == "u" else "u"
            audit += "I" * runs[-1]
            for _ in range(runs[-1]):
                initials += "a" if initials[-1:] == "u" else "u"
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best or (cost, audit), (cost, audit))
    return best


def some_turns(rng, n):
    texts = ["Fine.", "cut off", "", " \t", "Why?", "again!"]
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for _ in range(n)]


def test_the_string_program_finds_the_best_of_all_sequences():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 3, 4, 4):
        turns = some_turns(rng, n)
        assert repair(turns)[:2] == every_audit(turns), turns


def codes_of(turns):
    number = {"": 0, "blank": C.BLANK, "duplicate": C.REPEAT, "truncated": C.CUT}
    return bytes("sua".find(r[:1]) % 4 + 4 * number[f] for (r, _), f in zip(turns, faults(turns), strict=True))


def test_layers_and_pieces_equal_whole_strings():
    rng = random.Random(2)
    layers = C.Layers()
    for n in [*range(12), 40, 41, 200, 1000]:
        for size in (1, 3, 7, 5000):
            turns = some_turns(rng, n)
            codes = codes_of(turns)
            parts = [codes[i : i + size] for i in range(0, n, size)]
            cost, states, closing = C.chain([layers.solve(p) for p in parts])
            audit = "".join(layers.audit(p, *s) for p, s in zip(parts, states, strict=True)) + "I" * closing
            assert (cost, audit) == repair(turns)[:2]
            replay = C._Replay(audit)
            done = [x[1:] for t in turns for x in replay.turn(*t)] + [x[1:] for x in replay.inserts()]
            assert tuple(done) == repair(turns)[2]
    assert len(layers.layers) < 5000  # few layers, however many turns


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            turns += [(turn is not None, turn or 0, "user" if d == 4 else role, hashlib.sha256(text.encode()).digest(), text)] * (0 if d == 0 else 2 if d == 3 else 1)
        turns.sort()
        known = [t[1] for t in turns if t[0]]
        plain = [(t[2], t[4]) for t in turns]
        cost, audit, done = repair(plain)
        flt = faults(plain)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[flt.count(x) for x in ("blank", "duplicate", "truncated")], sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(c, t, *turn) for c in range(40) for t, turn in enumerate(some_turns(rng, rng.randint(1, 12))) if rng.random() < 0.9]
    out += [(None, None, None, None), (None, 1, "user", None), (None, 1, "user", "x."), (90, None, "user", "hm."), (90, None, "assistant", "hm."), (91, 5, "", "no role."), (92, 0, "user", "é" * 100_000 + "."), (92, 3, "assistant", "long " * 30_000)]
    out += [(93, t % 7, "user", "same.") for t in range(300)] + [(94, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 3)) for t in range(9000)]
    drop = next(t for t in range(1000) if zlib.crc32(f"95:{t}".encode()) % 20 == 0)
    return [*out, (95, drop, "user", "goes.")]


def test_odd_conversations_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], CONV).repartition(5)
    got = results(C.repair_conversations(C.damaged(df), copies_col="copies"))
    assert got == brute(rows)
    assert got[95] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_follow_the_pattern(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], CONV)
    out = C.repaired_turns(df).orderBy("conv_id", "place").collect()
    for _, turns in itertools.groupby(out, key=lambda r: r["conv_id"]):
        turns = list(turns)
        assert re.fullmatch("s?(ua)+", "".join(t["role"][0] for t in turns)) and [t["place"] for t in turns] == list(range(len(turns)))
    assert {r["edit"] for r in out} == {"keep", "rerole", "insert"}


def test_text_ids_and_no_rows(spark):
    df = spark.createDataFrame([("a`.b", 0, "user", "x."), ("a`.b", 1, "assistant", "y.")], "`conv.id` string, turn int, role string, text string")
    assert C.repair_conversations(df, conv_col="conv.id").select("cost", "audit").collect() == [(0, "KK")]
    none = spark.createDataFrame([], CONV)
    assert C.repair_conversations(C.damaged(none), copies_col="copies").collect() == []


def test_query_equals_its_twin(spark):
    got = C.op11_conversation_repair(spark, SF)
    want = duckdb.sql(C.ORACLE.replace("FROM conversations", f"FROM '{SF}/conversations.parquet'"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.agg(F.max("illegal"), F.max("gaps")).head()[0] > 0
