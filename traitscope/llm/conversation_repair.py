"""Cheapest repair of damaged conversations: a run-length shortest path with min-plus powers.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. A row may be kept (0), given
the role user or assistant (1) or deleted (2); blank and repeated rows must be deleted; a row that
ends in the middle of a sentence costs 5 more unless it is deleted; an empty turn of user or
assistant may be inserted anywhere (5). The audit is the list of cheapest edits in order, by their
initials D, I, K, R; of equally cheap lists the least one.

Method. A row is a symbol: its initial (s, u, a, other) with or without the fault "truncated", or
"must go". The grammar has four states, so a symbol is a 4 x 4 min-plus matrix (with the insertions
before it folded in), and a run of equal symbols is a power of it, made of cached binary powers.
Costs to the end are carried backward over the runs; the choices are unrolled forward, a run being
halved down to single rows. Halves with equal symbol, length, state and costs have equal choices, so
they come from a cache. Given letter and state the next state is fixed, which makes the least letter
that keeps the cheapest cost the least audit.

Spark's part. Texts of a conversation never come together. Repeated rows are found by a grouping on
the digest of role and text and a salted join with the digests met twice; one narrow row per turn
goes to the task of its conversation, sorted, and is folded into one byte (the audit has a letter
for each anyhow). The texts are then streamed past the audits, sorted; a task holds a batch of them
and one audit. One conversation's SHA-256 is one stream by definition, so it stays in one task.

Cases: null roles and texts are one space (blank rows), null ids and turns as well in the damage's
checksum; a null conv_id is a conversation of its own. Rows of one turn are taken by role and then
text; equal rows are adjacent. Roles other than s, u, a (also the empty one) can't be kept. Very
long conversations and texts are allowed up to the size of a Spark value. Repeated rows are damaged
alike. A conversation that lost all its rows has zeros, an empty audit and the hash of nothing.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import salted_join, trimmed
from traitscope.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after s, after u, after a. FOLLOWS: the state a turn put in leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL_PAIRS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: twice the initial's place in "sua" (3: any other), one more if truncated, and GONE.
GONE = 8
FAR = 1 << 60
#: Longest half, as a power of two, whose letters are cached.
CACHED = 12

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# --- the shortest path ---------------------------------------------------------------------


def _times(a, b):
    return tuple(tuple(min(FAR, min(row[k] + b[k][j] for k in range(4))) for j in range(4)) for row in a)


def _after(matrix, costs):
    return tuple(min(FAR, min(row[k] + costs[k] for k in range(4))) for row in matrix)


def _inserts():
    rows = []
    for i in range(4):
        costs, at = [FAR] * 4, i
        for n in range(4):
            costs[at], at = min(costs[at], n * INSERT), FOLLOWS[at]
        rows.append(tuple(costs))
    return tuple(rows)


INSERTS = _inserts()
#: Costs after the last row: what is missing is put in.
END = _after(INSERTS, (0, FAR, FAR, 0))


def _options(symbol: int, state: int):
    """(letter, cost, next state) of a row in a state, but for insertions, by letter."""
    yield "D", DELETE, state
    if symbol != GONE:
        more = TRUNCATED * (symbol % 2)
        kept = KEPT.get("sua_"[symbol // 2], {})
        if state in kept:
            yield "K", more, kept[state]
        yield "R", more + REROLE, FOLLOWS[state]


@functools.lru_cache(maxsize=None)  # 9 symbols, at most 63 powers
def power(symbol: int, j: int):
    """The min-plus matrix of 2^j rows with this symbol."""
    if j:
        return _times(power(symbol, j - 1), power(symbol, j - 1))
    rows = []
    for i in range(4):
        costs = [FAR] * 4
        for _, cost, to in _options(symbol, i):
            costs[to] = min(costs[to], cost)
        rows.append(tuple(costs))
    return _times(INSERTS, tuple(rows))


def advance(symbol: int, n: int, costs):
    """Costs before ``n`` rows of a symbol from the costs after them."""
    j = 0
    while n:
        if n & 1:
            costs = _after(power(symbol, j), costs)
        n, j = n >> 1, j + 1
    return costs


def _row_letters(symbol: int, costs, state: int):
    before, letters = _after(power(symbol, 0), costs), ""
    while True:
        found = {letter: to for letter, cost, to in _options(symbol, state) if cost + costs[to] == before[state]}
        if INSERT + before[FOLLOWS[state]] == before[state]:
            found["I"] = FOLLOWS[state]
        letter = min(found)
        letters, state = letters + letter, found[letter]
        if letter != "I":
            return letters, state


def _half_letters(symbol: int, j: int, costs, state: int):
    """Letters of 2^j rows and the state after them; ``costs`` are those after the rows."""
    if not j:
        return _row_letters(symbol, costs, state)
    first, middle = unroll_power(symbol, j - 1, _after(power(symbol, j - 1), costs), state)
    second, last = unroll_power(symbol, j - 1, costs, middle)
    return first + second, last


_cached_letters = functools.lru_cache(maxsize=4096)(_half_letters)


def unroll_power(symbol: int, j: int, costs, state: int):
    least = min(costs)
    return (_cached_letters if j <= CACHED else _half_letters)(symbol, j, tuple(c - least for c in costs), state)


def unroll(symbol: int, n: int, costs, state: int):
    """Letters of a run of ``n`` rows, its longest binary parts first."""
    letters = []
    while n:
        j = n.bit_length() - 1
        n -= 1 << j
        part, state = unroll_power(symbol, j, advance(symbol, n, costs), state)
        letters.append(part)
    return "".join(letters), state


def repair_runs(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of a conversation given as runs (symbol, rows)."""
    ends, costs = [], END
    for symbol, n in reversed(runs):
        ends.append(costs)
        costs = advance(symbol, n, costs)
    letters, state = [], START
    for (symbol, n), after in zip(runs, reversed(ends)):
        part, state = unroll(symbol, n, after, state)
        letters.append(part)
    while state not in (START, ASSISTANT):
        letters.append("I")
        state = FOLLOWS[state]
    return costs[START], "".join(letters)


# --- damage --------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, gone, turn, role, text): rows after damage; a row that is dropped keeps its conv_id, with gone = true."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    plain = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *written).cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = plain.select(
        "conv_id",
        (F.col("fault") == 0).alias("gone"),
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )
    live = F.when(~F.col("gone"), True)
    return rows.select("conv_id", "gone", *[F.when(live, F.col(c)).alias(c) for c in ("turn", "role", "text")])


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damage``, for conversations that are broken already."""
    return conversations.select(
        "conv_id", F.lit(False).alias("gone"), "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    )


# --- faults, runs and audits ---------------------------------------------------------------


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _narrow(rows: DataFrame) -> DataFrame:
    """One row per turn without its text: digest of role and text, first fault but for repetitions."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select(
        "conv_id",
        "gone",
        "turn",
        "role",
        "text",
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open_end"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Narrow rows with ``later`` (an earlier turn has the same role and text), and the text only where rows of one turn differ."""
    narrow = _narrow(rows)
    live = narrow.where("not gone").select("conv_id", "turn", "digest", "blank")
    met = live.where("not blank").groupBy("conv_id", "digest").agg(
        F.min("turn").alias("first_turn"), (F.count("turn") < F.count("*")).alias("any_null"), F.count("*").alias("n")
    )
    met = materialise(met.where("n > 1").drop("n"), "repair-repeated")
    turns = live.groupBy("conv_id", "turn").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    ties = materialise(turns.where("least <> most").select("conv_id", "turn", F.lit(True).alias("tied")), "repair-ties")
    marked = salted_join(narrow, met, ["conv_id", "digest"], F.xxhash64("turn"), how="left", written=True)
    marked = salted_join(marked, ties, ["conv_id", "turn"], F.xxhash64("digest"), how="left", written=True)
    after = F.when(F.col("any_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    return marked.select(
        "conv_id",
        "gone",
        "turn",
        "role",
        F.when(F.col("tied"), F.col("text")).alias("tied_text"),
        "digest",
        "blank",
        "open_end",
        F.coalesce(after, F.lit(False)).alias("later"),
    )


class _Conversation:
    """What is known of a conversation while its rows go by in order."""

    def __init__(self, key):
        self.key, self.runs = key, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.digest = self.initial = None

    def add(self, turn, role, digest, blank, open_end, later):
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        again = later or (digest == self.digest and turn == self.turn)
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
        self.initial, self.digest, self.turn = initial, digest, turn
        self.blank += blank
        self.duplicate += again and not blank
        open_end = open_end and not blank and not again
        self.truncated += open_end
        symbol = GONE if blank or again else 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + open_end
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])

    def row(self):
        cost, audit = repair_runs(self.runs)
        gaps = 0 if self.least is None else min(self.turn - self.least + 1 - self.turns, (1 << 63) - 1)
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def _columns(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], [f"c{i}" for i in range(len(schema))])


def _audit_rows(source):
    """Sorted narrow rows -> one row per conversation."""
    now, out = None, []
    for batch in source:
        kind = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string()]
        for key, gone, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(key)
            if not gone:
                now.add(*row)
        if len(out) > 1000 or sum(len(r[-1]) for r in out) > 1 << 20:
            yield _columns(out, kind)
            out = []
    if now is not None:
        yield _columns([*out, now.row()], kind)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``damage`` or ``undamaged``."""
    marked = _marked(rows).repartition("conv_id")
    marked = marked.sortWithinPartitions("conv_id", "gone", "turn", "role", "tied_text", "digest")
    fields = ", ".join(f"{c} long" for c in COUNTS)
    marked = marked.select("conv_id", "gone", "turn", "role", "digest", "blank", "open_end", "later")
    return marked.mapInArrow(trimmed(_audit_rows), f"conv_id {_id_type(rows)}, {fields}, audit string")


# --- the repaired rows ---------------------------------------------------------------------


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits, each followed by the rows it is about in order; a conversation is in one task's stream."""
    none = {"turn": rows.schema["turn"].dataType, "role": "string"}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.col("audit").alias("text"), *COUNTS)
    texts = rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *[F.lit(None).cast("long").alias(c) for c in COUNTS])
    ordered = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return ordered.select("conv_id", "kind", "role", "text", *COUNTS)


class _Walk:
    """The rows that an audit leaves, in order; rows are given one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, FOLLOWS[self.state]
            yield ROLES[self.state], ""

    def take(self, role: str, text: str):
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[role[:1]][self.state]
            yield role, text
        elif letter == "R":
            self.state = FOLLOWS[self.state]
            yield ROLES[self.state], text


def _digest_rows(source):
    """Stream of ``_beside`` -> counts, audit and hash of every conversation."""
    head, walk, sha, first, out = None, None, None, True, []

    def feed(turns):
        nonlocal first
        for role, text in turns:
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

    def done():
        feed(walk.inserts())
        out.append((*head, walk.audit, sha.hexdigest()))

    for batch in source:
        kinds = [batch.schema.field(0).type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        for key, kind, role, text, *counts in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                if walk is not None:
                    done()
                head, walk, sha, first = (key, *counts), _Walk(text), hashlib.sha256(), True
            else:
                feed(walk.take(role, text))
        if len(out) > 1000 or sum(len(r[-2]) for r in out) > 1 << 20:
            yield _columns(out, kinds)
            out = []
    if walk is not None:
        done()
        yield _columns(out, kinds)


def _repaired_rows(source):
    """Stream of ``_beside`` -> (conv_id, position, role, text) of the rows that stay or are put in."""
    walk, key, place, out, size = None, None, 0, [], 0

    def add(turns):
        nonlocal place, size
        for role, text in turns:
            out.append((key, place, role, text))
            place, size = place + 1, size + len(text)

    kinds = None
    for batch in source:
        kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
        for this, kind, role, text, *_ in zip(*[c.to_pylist() for c in batch.columns]):
            if kind == 0:
                if walk is not None:
                    add(walk.inserts())
                walk, key, place = _Walk(text), this, 0
            else:
                add(walk.take(role, text))
            if len(out) > 5000 or size > 1 << 22:
                yield _columns(out, kinds)
                out, size = [], 0
    if walk is not None:
        add(walk.inserts())
    if out:
        yield _columns(out, kinds)


def repaired_conversations(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, role, text of the conversations after the edits that ``found`` (of ``audits``) names."""
    return _beside(rows, found).mapInArrow(trimmed(_repaired_rows), f"conv_id {_id_type(rows)}, position long, role string, text string")


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``repaired_sha256`` is of the repaired rows ``role:text``, joined by newlines. ``rows`` come from
    ``damage`` or ``undamaged``.
    """
    found = materialise(audits(rows), "repair-audits")
    fields = ", ".join(f"{c} long" for c in COUNTS)
    return _beside(rows, found).mapInArrow(
        trimmed(_digest_rows), f"conv_id {_id_type(rows)}, {fields}, audit string, repaired_sha256 string"
    )


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the conversations after ``damage``."""
    return repair_report(damage(conversations))
