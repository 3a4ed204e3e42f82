"""Conversation structure repair by a rank-compressed dynamic program.

A repaired conversation's role initials read ``(s?(ua)+)?``: four states (nothing yet, after s, after u,
after a). A macro edit is a run of inserts followed by what happens to one turn (Keep, Rerole, Delete); its
code is the run's and the turn's letters. No code begins another, so audits, which are one code for each
turn, compare as their lists of codes do, and of equally cheap audits the least is found without any
string: a layer of the program keeps for each state a cost and the *rank* of its audit among the layer's,
and a next layer's ranks are those of (rank before, code). Costs that count from the layer's least and
ranks make only few different layers, so a step is compiled once, with its pointers to the parents, and
looked up afterwards. Audits are read back along the pointers.

Turns are sorted once by conversation and turn over all tasks, in rows of a few bytes, and cut into pieces of
at most ``PIECE`` turns wherever a conversation or a partition ends. A piece is solved for all four states
that may come before it; its costs and ranks by (state before, state after) are an edit of its own, and the
same program runs over the pieces of a conversation. Then every piece reads back its own audit. So long
conversations take many tasks, and what meets in one place for a conversation is some bytes for each
piece. The repaired texts are hashed in order, which SHA-256 can only do one after the other: they stream
through a task per conversation, never held together; the audit, a cell of the result, is held.

Defined cases: null roles and texts count as one space; a null turn comes first and counts for no gap; null
ids are a conversation of their own; turns of equal number follow role and the text's SHA-256, equal rows
stand next to each other and are duplicates after the first; roles other than s, u or a by their first
letter have to be re-roled or deleted; a conversation without rows has an empty audit and the empty
string's hash; without conversations the result is empty; other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

from .shared import col, lean, written

PIECE = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
BLANK, REPEAT, CUT = 1, 2, 3  # faults; a turn's code is its initial (s, u, a, other) + 4 x its fault
_FAR = 1 << 60


def inserted(state: int) -> int:
    """The state after one more insert, or after re-roling a turn: the role that the pattern wants next."""
    return 3 if state == 2 else 2


def kept(state: int, initial: int) -> int | None:
    return {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, initial))


#: Macro codes in the order of their letters; runs of more than two inserts come back to a state for nothing.
CODES = sorted("I" * n + a for n in range(3) for a in "DKR")
#: Inserts that complete a conversation from each state.
CLOSING = (0, 2, 1, 0)


def macros(code: int) -> list[list[tuple[int, int, int]]]:
    """For a turn's code and each state before it: (state after, cost, macro) of every macro edit."""
    initial, fault = code & 3, code >> 2
    out = []
    for state in range(4):
        moves = []
        for k, macro in enumerate(CODES):
            at, cost = state, INSERT * (len(macro) - 1) + TRUNCATED * (fault == CUT and macro[-1] != "D")
            for _ in macro[:-1]:
                at = inserted(at)
            if macro[-1] == "D":
                moves.append((at, cost + DELETE, k))
            elif fault not in (BLANK, REPEAT):
                to = kept(at, initial) if macro[-1] == "K" else inserted(at)
                if to is not None:
                    moves.append((to, cost + (KEEP if macro[-1] == "K" else REROLE), k))
        out.append(moves)
    return out


class Layers:
    """The layers met so far, for all four states before a piece together, and the compiled steps between them."""

    def __init__(self):
        self.start = (tuple(0 if e == q else _FAR for e in range(4) for q in range(4)), (0,) * 16)
        self.numbers, self.layers, self.steps = {self.start: 0}, [self.start], {}
        self.moves = [macros(c) for c in range(16)]

    def step(self, layer: int, code: int) -> tuple[int, tuple, list]:
        """(layer after the turn, what it adds to each entry's costs, (state before, macro) of each entry and state)."""
        found = self.steps.get((layer, code))
        if found:
            return found
        cost, rank = self.layers[layer]
        best: list = [(_FAR,)] * 16
        for e in range(4):
            for q in range(4):
                for to, c, k in self.moves[code][q] if cost[4 * e + q] < _FAR else ():
                    best[4 * e + to] = min(best[4 * e + to], (cost[4 * e + q] + c, rank[4 * e + q], k, q))
        order = {key: i for i, key in enumerate(sorted({b[1:3] for b in best if len(b) > 1}))}
        least = tuple(min(b[0] for b in best[4 * e : 4 * e + 4]) for e in range(4))
        after = (tuple(b[0] - least[i // 4] if len(b) > 1 else _FAR for i, b in enumerate(best)), tuple(order[b[1:3]] if len(b) > 1 else 0 for b in best))
        number = self.numbers.setdefault(after, len(self.layers))
        if number == len(self.layers):
            self.layers.append(after)
        self.steps[layer, code] = found = (number, least, [(b[3], b[2]) if len(b) > 1 else None for b in best])
        return found

    def solve(self, codes: bytes) -> tuple[list[int], list[int]]:
        """Costs and ranks of a piece by (state before, state after)."""
        at, total = 0, [0, 0, 0, 0]
        for c in codes:
            at, least, _ = self.steps.get((at, c)) or self.step(at, c)
            total = [a + b for a, b in zip(total, least, strict=True)]
        cost, rank = self.layers[at]
        return [c + total[i // 4] if c < _FAR else _FAR for i, c in enumerate(cost)], list(rank)

    def audit(self, codes: bytes, before: int, after: int) -> str:
        """The cheapest, then least, audit of a piece between two states."""
        at, path = 0, []
        for c in codes:
            at, _, back = self.step(at, c)
            path.append(back)
        out = []
        for back in reversed(path):
            after, k = back[4 * before + after]
            out.append(CODES[k])
        return "".join(reversed(out))


def chain(pieces: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """The cost of a conversation of pieces, (state before, state after) of each, and the inserts at the end."""
    layer: list = [(0, 0), None, None, None]
    back = []
    for cost, rank in pieces:
        best: list = [None] * 4
        for e, known in enumerate(layer):
            for q in range(4) if known else ():
                if cost[4 * e + q] < _FAR:
                    new = (known[0] + cost[4 * e + q], known[1], rank[4 * e + q], e)
                    best[q] = new if best[q] is None else min(best[q], new)
        order = {key: i for i, key in enumerate(sorted({b[1:3] for b in best if b}))}
        layer = [(b[0], order[b[1:3]]) if b else None for b in best]
        back.append(bytes(b[3] if b else 0 for b in best))
    cost, _, at = min((x[0] + INSERT * CLOSING[q], x[1], q) for q, x in enumerate(layer) if x)
    closing, path = CLOSING[at], []
    for b in reversed(back):
        path.append((b[at], at))
        at = b[at]
    return cost, path[::-1], closing


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


_PIECES = "at long, codes binary, cost array<long>, rank array<int>, low long, high long, turns long"


def _cut(batches):
    """Pieces of sorted (conv, turn, code): their codes, solutions, first, last and number of different turns. A code below 0 stands for no row."""
    layers, part, n = Layers(), TaskContext.get().partitionId() << 33, 0
    held, codes, low, high, turns, out, kind = None, bytearray(), None, None, 0, [], None

    def close():
        nonlocal n
        if held is not None:
            out.append((held[0], part + n, bytes(codes), *layers.solve(bytes(codes)), low, high, turns))
            n += 1

    def made():
        names = ["conv", "at", "codes", "cost", "rank", "low", "high", "turns"]
        types = [kind, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for b in batches:
        kind, out = b.schema.field(0).type, []
        for conv, turn, code in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if held is None or not _same(held[0], conv) or len(codes) >= PIECE:
                close()
                held, codes, low, high, turns = (conv,), bytearray(), None, None, 0
            if code >= 0:
                codes.append(code)
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
        if out:
            yield made()
    out = []
    close()
    if out:
        yield made()


_CHAINED = "at long, before int, after int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, closing int"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _chained(batches):
    """For sorted pieces of whole conversations: the states around each piece, and one row (at: null) with a conversation's sums."""
    held, pieces, places, last, kind = None, [], [], None, None
    low = high = None
    sums = {}
    out: list = []

    def made():
        nonlocal out
        names = ["conv", *[x.split()[0] for x in _CHAINED.split(", ")]]
        types = [kind, pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6, pa.int32()]
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def close():
        cost, states, closing = chain(pieces)
        out.extend((held[0], at, *s, *[None] * 7) for at, s in zip(places, states, strict=True))
        gaps = 0 if low is None else high - low + 1 - sums["turns"]
        out.append((held[0], None, None, None, gaps, *[sums[x] for x in _STATS[1:-1]], cost, closing))

    for b in batches:
        kind = b.schema.field(0).type
        for conv, at, codes, cost, rank, first, end, turns in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if held is None or not _same(held[0], conv):
                if held is not None:
                    close()
                    if len(out) > 10_000:
                        yield made()
                held, pieces, places, last, low, high = (conv,), [], [], None, None, None
                sums = dict.fromkeys(("turns", *_STATS), 0)
            for fault, name in ((BLANK, "blank"), (REPEAT, "duplicate"), (CUT, "truncated")):
                sums[name] += sum(map(codes.count, range(4 * fault, 4 * fault + 4)))
            initials = [c & 3 for c in codes]
            pairs = zip([last, *initials] if last is not None else initials, initials if last is not None else initials[1:], strict=False)
            sums["illegal"] += sum(p not in _LEGAL for p in pairs)
            last = initials[-1] if initials else last
            if first is not None:
                sums["turns"] += turns - (high == first)
                low, high = first if low is None else low, end
            if codes:
                pieces.append((cost, rank))
                places.append(at)
    if held is not None:
        close()
    if out:
        yield made()


def _told(batches):
    """(conv, at, audit) of every piece from its codes and the states around it."""
    layers = Layers()
    for b in batches:
        audits = [layers.audit(c, s, t) for c, s, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(audits, pa.string())], names=["conv", "at", "audit"])


ROLES = {2: "user", 3: "assistant"}


class _Replay:
    """A conversation's repaired turns, one after the other, from its audit and its sorted turns."""

    def __init__(self, audit: str):
        self.audit, self.place, self.state = audit, 0, 0

    def inserts(self):
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            self.place, self.state = self.place + 1, inserted(self.state)
            yield "insert", ROLES[self.state], ""

    def turn(self, role: str, text: str):
        yield from self.inserts()
        action = self.audit[self.place]
        self.place += 1
        if action == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            yield "keep", role, text
        elif action == "R":
            self.state = inserted(self.state)
            yield "rerole", ROLES[self.state], text


def _replayed(batches, hashed: bool):
    """From (conv, is a turn, role, text, copies, audit, sums), the summary row first: a summary row with the hash of the repaired turns, or the repaired turns themselves."""
    held, replay, digest, first, number, kind = None, None, None, True, 0, None
    out: list = []

    def say(turns):
        nonlocal first, number
        for edit, role, text in turns:
            if hashed:
                digest.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
            else:
                out.append((held[0], number, role, text, edit))
            number += 1

    def close():
        say(replay.inserts())
        if hashed:
            out.append((held[0], *held[1], replay.audit, digest.hexdigest()))

    def made():
        nonlocal out
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()] if hashed else [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv", *_STATS, "audit", "repaired_sha256"] if hashed else ["conv", "place", "role", "text", "edit"]
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, is_turn, role, text, copies, audit, *sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not is_turn:
                if held is not None:
                    close()
                held, replay, digest, first, number = (conv, sums), _Replay(audit), hashlib.sha256(), True, 0
            else:
                for _ in range(copies):
                    say(replay.turn(role, text))
        if out:
            yield made()
    if held is not None:
        close()
    if out:
        yield made()


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """conv, turn, role, text, copies, sha under names of our own."""
    out = rows.select(col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"), F.coalesce(col(text_col), F.lit(" ")).alias("text"), (col(copies_col) if copies_col else F.lit(1)).cast("long").alias("copies"))
    return out.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _coded(turns: DataFrame) -> DataFrame:
    """conv, turn, role, sha, copy, code of every turn (code -1: none, for conversations without a row), a few bytes each."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    live = F.col("copies") > 0
    only = lambda c: F.when(live, F.col(c)).alias(c)
    flat = turns.select("conv", only("turn"), only("role"), only("sha"), "copies", (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    flat = flat.groupBy("conv", "turn", "role", "sha").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    flat = written(flat, "turns")
    again = flat.filter("copies > 0 AND NOT blank").groupBy("conv", "role", "sha").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = again.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("sha").alias("sha_"), "first")
    both = flat.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("sha") == F.col("sha_")), "left")
    later = F.col("first").isNotNull() & ~when.eqNullSafe(F.col("first"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.col("copies"), F.lit(1)) - 1) / PIECE)))
    one = both.select("*", later.alias("later"), blocks.alias("block"))
    one = one.select("*", F.explode(F.sequence(F.col("block") * PIECE, F.least(F.col("copies"), (F.col("block") + 1) * PIECE) - F.when(F.col("copies") > 0, 1).otherwise(0))).alias("copy"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("later") | (F.col("copy") > 0), REPEAT).when(F.col("cut"), CUT).otherwise(0)
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0))
    code = F.when(F.col("copies") > 0, F.when(initial > 0, initial - 1).otherwise(3) + 4 * fault).otherwise(-1).cast("int")
    return one.select("conv", "turn", "role", "sha", "copy", code.alias("code"))


def _audits(turns: DataFrame) -> DataFrame:
    """conv, the sums and the audit of every conversation."""
    kind = turns.schema["conv"].dataType.simpleString()
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "sha", "copy"]
    laid = _coded(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(laid.select("conv", "turn", "code").mapInArrow(lean(_cut), f"conv {kind}, {_PIECES}"), "pieces")
    chained = pieces.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(lean(_chained), f"conv {kind}, {_CHAINED}")
    chained = written(chained, "chained")
    around = chained.filter("at IS NOT NULL").select(F.col("at"), "before", "after")
    told = pieces.select("conv", "at", "codes").join(around, "at").select("conv", "at", "codes", "before", "after").mapInArrow(lean(_told), f"conv {kind}, at long, audit string")
    ends = chained.filter("at IS NULL").select("conv", F.lit((1 << 63) - 1).alias("at"), F.repeat(F.lit("I"), F.col("closing")).alias("audit"), *_STATS)
    both = told.unionByName(ends, allowMissingColumns=True)
    parts = F.array_sort(F.collect_list(F.struct("at", "audit")))
    return both.groupBy("conv").agg(*[F.max(c).alias(c) for c in _STATS], F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))


def _replay(rows: DataFrame, hashed: bool, columns: tuple) -> DataFrame:
    turns = _turns(rows, *columns)
    kind = turns.schema["conv"].dataType.simpleString()
    heads = written(_audits(turns), "audits").withColumns({"is_turn": F.lit(False)})
    both = heads.unionByName(turns.filter("copies > 0").withColumn("is_turn", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", "is_turn", F.col("turn").asc_nulls_first(), "role", "sha")
    out = f"conv {kind}, " + (", ".join(f"{s} long" for s in _STATS) + ", audit string, repaired_sha256 string" if hashed else "place long, role string, text string, edit string")
    return both.select("conv", "is_turn", "role", "text", "copies", "audit", *_STATS).mapInArrow(lean(lambda batches: _replayed(batches, hashed)), out).withColumnRenamed("conv", columns[0])


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal pairs, cost and audit of the cheapest repair, SHA-256 of the repaired turns. ``copies_col`` says how often a row stands there; 0: only its conversation's id counts."""
    return _replay(rows, True, (conv_col, turn_col, role_col, text_col, copies_col))


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The repaired conversations: id, place from 0, role, text, edit (keep, rerole, insert)."""
    return _replay(rows, False, (conv_col, turn_col, role_col, text_col, copies_col))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to a conversations table, by the CRC-32 of ``conv_id:turn`` modulo 20; ``copies``: 0 for a dropped row, 2 for a repeated one."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key.cast("binary")) % 20
    return rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark, sf_dir):
    return repair_conversations(damaged(settle(spark).read.parquet(f"{sf_dir}/conversations.parquet")), copies_col="copies")


ORACLE = r"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) x(i))),
 keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 marked AS (SELECT * EXCLUDE (k, tb), xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(keyed.k)), lambda i: ascii(substr(keyed.k, i + 1, 1)))), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS d FROM keyed, tab),
 dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 0 THEN [] WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM marked),
 num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
 flt AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM num),
 run(q, code, ins, p) AS (VALUES (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3), (0, 'I', chr(10) || 'user:', 2), (1, 'I', chr(10) || 'user:', 2), (2, 'I', chr(10) || 'assistant:', 3), (3, 'I', chr(10) || 'user:', 2), (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2), (3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
 act(p, ini, a, to_state) AS (VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3), (0, NULL, 'R', 2), (1, NULL, 'R', 2), (2, NULL, 'R', 3), (3, NULL, 'R', 2), (0, NULL, 'D', 0), (1, NULL, 'D', 1), (2, NULL, 'D', 2), (3, NULL, 'D', 3)),
 dp(conv_id, i, q, v) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} FROM flt
  UNION ALL SELECT dp.conv_id, flt.i, to_state, min({'c': v.c + 3 * CAST(strlen(code) AS BIGINT) + CASE a WHEN 'K' THEN 0 WHEN 'R' THEN 3 ELSE 4 END + CASE WHEN fault = 'truncated' AND a <> 'D' THEN 3 ELSE 0 END, 'a': v.a || code || a, 't': v.t || ins || CASE a WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE to_state WHEN 3 THEN 'assistant:' ELSE 'user:' END || text END})
  FROM dp JOIN flt ON flt.conv_id IS NOT DISTINCT FROM dp.conv_id AND flt.i = dp.i + 1 JOIN run ON run.q = dp.q JOIN act ON act.p = run.p AND (act.ini IS NULL OR act.ini = flt.ini) AND (a = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY 1, 2, 3),
 fin AS (SELECT conv_id, min({'c': v.c + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'a': v.a || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 't': v.t || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS v FROM dp JOIN (SELECT conv_id, max(i) AS n FROM flt GROUP BY 1) m USING (conv_id) WHERE dp.i = m.n GROUP BY 1),
 pairs AS (SELECT *, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM flt),
 sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1)
 SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.t, 2), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN fin USING (conv_id)
"""
