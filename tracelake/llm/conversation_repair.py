"""Conversation structure repair: the cheapest edits that give a conversation the roles `(s?(ua)+)?`.

Edits of a row, in order: Keep (0), Rerole to user or assistant (REROLE), Delete (DELETE; blank and duplicate rows must go),
and between rows Insert of an empty text (INSERT); a truncated row that stays costs TRUNCATED. What an edit does depends on a
row's role and first fault alone, so a conversation is a signature, a word over nine symbols. Where the grammar stands is one
of four states; a layer holds the least cost of each state after a prefix of a signature.

Distinct signatures are sorted over all tasks and walked as a trie: the layers of the prefix shared with the signature before
are kept, each further symbol adds one, and at a signature's end its edits are read off: backwards the states that lie on a
cheapest way, then forwards the least letter among these, which is the ASCII-least of the cheapest audits.

A conversation may be of any length. Rows are dealt by range of (conversation, turn), which splits a hot one, and a signature
is of a chunk of CHUNK rows at most. Where a conversation has several chunks, the costs from each state to each, of every
chunk, go through the conversation as a stream of small rows, once backwards (cost from a chunk's end to the end of the
conversation) and once forwards (state in which each chunk begins); one state is all that a task remembers. Repaired text
is hashed as a stream; of a conversation in several chunks, in blocks of about BLOCK bytes.

Defined results: a null conv_id is a conversation; null role and text are one space, which is no role of the grammar and a
blank text; null turns come first. An empty role has no place in the grammar either. Rows of one turn are in order of role
and a hash of their text; equal rows are rows each, of which all but the first are duplicates. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, table, tidy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a chunk, and bytes of a block of repaired text, at most (a longer row is a block of its own).
CHUNK, BLOCK = 4096, 1 << 20
#: White space that doesn't make a text.
SPACE = " \t\n\x0b\x0c\r"
INF = 1 << 40

#: States: nothing yet, after system, after user, after assistant. What an Insert or Rerole adds in a state, and where it leads.
STATES = 4
ADDS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Where a role's initial leads; elsewhere it has no place.
LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Costs from a state to the end of a conversation, where nothing more is inserted.
END = (0, INF, INF, 0)
DELETED = "d"


def symbol(initial: str, fault: str) -> str:
    """A row in a signature: `d` if it must go, else its role's initial (x: none of the grammar's), in capitals if truncated."""
    if fault in ("blank", "duplicate"):
        return DELETED
    known = initial if initial in LEADS else "x"
    return known.upper() if fault == "truncated" else known


@cache
def moves(sign: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, next state, cost) of the edits of a row, least letter first."""
    out = [("D", state, DELETE)]
    if sign != DELETED:
        more = TRUNCATED if sign.isupper() else 0
        to = LEADS.get(sign.lower(), {}).get(state)
        if to is not None:
            out.append(("K", to, more))
        out.append(("R", ADDS[state][1], REROLE + more))
    return tuple(out)


def _closed(costs: list[int]) -> tuple[int, ...]:
    """costs with what inserts reach; two in a row lead from every state to every state they can lead to."""
    for _ in range(2):
        for state in range(STATES):
            to = ADDS[state][1]
            costs[to] = min(costs[to], costs[state] + INSERT)
    return tuple(costs)


def _based(costs: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The least cost, and costs above it: layers differ by a number, so few of these forms exist."""
    least = min(costs)
    return least, tuple(min(c - least, INF) for c in costs)


@cache
def opening(state: int) -> tuple[int, tuple[int, ...]]:
    return _based(_closed([0 if s == state else INF for s in range(STATES)]))


@cache
def layer(form: tuple[int, ...], sign: str) -> tuple[int, tuple[int, ...]]:
    """The next layer's least cost above this one's, and its form."""
    costs = [INF] * STATES
    for state in range(STATES):
        if form[state] < INF:
            for _, to, cost in moves(sign, state):
                costs[to] = min(costs[to], form[state] + cost)
    return _based(_closed(costs))


@cache
def _inserted(form: tuple[int, ...], wanted: frozenset[int]) -> frozenset[int]:
    """wanted, with the states of the same layer from which a tight insert leads there."""
    out = set(wanted)
    for _ in range(2):
        out |= {s for s in range(STATES) if form[s] < INF and ADDS[s][1] in out and form[s] + INSERT == form[ADDS[s][1]]}
    return frozenset(out)


@cache
def _before(form: tuple[int, ...], sign: str, wanted: frozenset[int]) -> frozenset[int]:
    """The states of a layer from which a cheapest way leads to those wanted of the next."""
    added, after = layer(form, sign)
    tight = {s for s in range(STATES) if form[s] < INF and any(to in wanted and form[s] + cost == added + after[to] for _, to, cost in moves(sign, s))}
    return _inserted(form, frozenset(tight))


@cache
def _letter(form: tuple[int, ...], sign: str, state: int, here: frozenset[int], wanted: frozenset[int]) -> tuple[str, int]:
    """The least letter of a cheapest way from a state, and where it leads; `I` stays in the layer."""
    added, after = layer(form, sign)
    found = [(letter, to) for letter, to, cost in moves(sign, state) if to in wanted and form[state] + cost == added + after[to]]
    to = ADDS[state][1]
    if to in here and form[state] + INSERT == form[to]:
        found.append(("I", to))
    return min(found)


class Trie:
    """Layers along the path of the signature that was asked for last, from one entry state."""

    def __init__(self, entry: int):
        self.entry, self.path = entry, ""
        self.bases, self.forms = ([x] for x in opening(entry))
        self.made = 0

    def go(self, signature: str) -> None:
        """Keep the layers of the shared prefix; add those of the rest."""
        shared, most = 0, min(len(signature), len(self.path))
        if signature.startswith(self.path):
            shared = len(self.path)
        else:
            while shared < most and signature[shared] == self.path[shared]:
                shared += 1
        del self.bases[shared + 1 :], self.forms[shared + 1 :]
        for sign in signature[shared:]:
            added, form = layer(self.forms[-1], sign)
            self.bases.append(self.bases[-1] + added)
            self.forms.append(form)
        self.made += len(signature) - shared
        self.path = signature

    def costs(self) -> tuple[int, ...]:
        return tuple(min(self.bases[-1] + c, INF) for c in self.forms[-1])

    def edits(self, goal: tuple[int, ...]) -> tuple[int, str, int]:
        """(cost, audit, last state) of the cheapest edits, where goal[state] is still to be paid after the last."""
        forms, n = self.forms, len(self.path)
        best = min(f + g for f, g in zip(forms[n], goal, strict=True))
        ends = frozenset(s for s in range(STATES) if forms[n][s] + goal[s] == best)
        wanted = [_inserted(forms[n], ends)]
        for i in range(n - 1, -1, -1):
            wanted.append(_before(forms[i], self.path[i], wanted[-1]))
        wanted.reverse()
        state, i, audit = self.entry, 0, []
        while i < n:
            letter, state = _letter(forms[i], self.path[i], state, wanted[i], wanted[i + 1])
            audit.append(letter)
            i += letter != "I"
        while state not in ends:
            audit.append("I")
            state = ADDS[state][1]
        return self.bases[n] + best - goal[state], "".join(audit), state


def _sorted_tries(signatures: DataFrame, order: list[str], schema: str, answer: Callable[[dict[int, Trie], tuple], list[tuple]]) -> DataFrame:
    """answer(tries, row) of every row (signature first), with rows in order of signature so that tries share their prefixes."""
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {s: Trie(s) for s in range(STATES)}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out = [made for row in zip(*(c.to_pylist() for c in batch.slice(start, 500).columns), strict=True) for made in answer(tries, row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if k is None else pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = [f.split()[0] for f in schema.split(", ")], [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in schema.split(", ")]
    return signatures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(run), schema)


def crossings(signatures: DataFrame) -> DataFrame:
    """(signature, costs): from each state to each, row by row."""

    def answer(tries: dict[int, Trie], row: tuple) -> list[tuple]:
        out: list[int] = []
        for trie in tries.values():
            trie.go(row[0])
            out += trie.costs()
        return [(row[0], out)]

    return _sorted_tries(signatures, ["signature"], "signature string, costs array<long>", answer)


def audits(asked: DataFrame) -> DataFrame:
    """(signature, goal, entry, cost, audit, exit) of asked (signature, goal, whole): from every state, or from the first if
    the signature is a whole conversation's."""

    def answer(tries: dict[int, Trie], row: tuple) -> list[tuple]:
        signature, goal, whole = row
        out = []
        for trie in [tries[0]] if whole else tries.values():
            trie.go(signature)
            cost, audit, last = trie.edits(tuple(goal))
            out.append((signature, goal, trie.entry, cost, audit, last))
        return out

    return _sorted_tries(asked, ["signature", "goal"], "signature string, goal array<long>, entry int, cost long, audit string, exit int", answer)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of rows after the contract's damage, by crc32 of `conv_id:turn` modulo 20."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kept = rows.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20).alias("__way"))
    kept = kept.where("__way <> 0")
    text = F.when(F.col("__way") == 1, F.lit("")).when(F.col("__way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = kept.select("conv_id", "turn", F.when(F.col("__way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "__way")
    return made.withColumn("__copy", F.explode(F.when(F.col("__way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__copy", "__way")


def ordered(rows: DataFrame) -> DataFrame:
    """rows in the order of their conversations: `part` and `row` (place in the part) are ordered as the rows are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = F.rtrim("text", F.lit(SPACE))
    blank = bare == ""
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    keyed = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *as_text)
    keyed = keyed.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"), blank.alias("blank"), (~blank & ~ended).alias("open"))
    keys = ["conv", "turn", "role", "h1", "h2"]
    dealt = keyed.withColumn("__dealt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "__dealt").sortWithinPartitions(*keys, "__dealt").drop("__dealt")
    placed = dealt.withColumn("row", F.monotonically_increasing_id())
    return cut(placed.withColumn("part", F.shiftright("row", 33)).withColumn("row", F.col("row").bitwiseAND((1 << 33) - 1)).withColumn("chunk", F.floor(F.col("row") / CHUNK).cast("long")))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & a[c].eqNullSafe(b[f"__{c}"])
    return condition


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (without their text) with `fault`: the first of blank, duplicate (role and text seen earlier), truncated; or ''."""
    keys = ["conv", "role", "h1", "h2"]
    light = rows.drop("text")
    seen = light.groupBy(*keys).agg(F.min(F.struct("part", "row")).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    seen = seen.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = light.join(seen, _same(light, seen, keys), "left")
    again = F.coalesce(F.struct("part", "row") > F.col("__first"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated").otherwise("")
    return met.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "part", "chunk", "row")


#: What a chunk says of its conversation, apart from its signature.
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


def chunks(faults: DataFrame) -> DataFrame:
    """One row for each chunk of each conversation: its signature, counts, first and last initial and turn."""
    kind = faults.schema["conv"].dataType.simpleString()

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("row")
        convs, turns, initials, found = (part.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault"))
        out, start = [], 0
        for end in range(1, len(convs) + 1):
            if end < len(convs) and convs[end] == convs[start]:
                continue
            own, faults_here, known = initials[start:end], found[start:end], [t for t in turns[start:end] if t is not None]
            counts = [faults_here.count(f) for f in ("blank", "duplicate", "truncated")]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
            signature = "".join(map(symbol, own, faults_here))
            out.append((start, signature, *counts, illegal, len(set(known)), own[0], own[-1], min(known, default=None), max(known, default=None)))
            start = end
        columns = list(zip(*out, strict=True))
        heads = part.take(pa.array(columns[0])).select(["conv", "part", "chunk"])
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([*heads.combine_chunks().columns, *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names)

    names = ["conv", "part", "chunk", "signature", *COUNTS, "first", "last", "low", "high"]
    schema = f"conv {kind}, part long, chunk long, signature string, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long"
    return faults.groupBy("part", "chunk").applyInArrow(pack, schema)


def _streamed(rows: DataFrame, order: list[Column], schema: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]], end: Callable[[object], dict] | None = None) -> DataFrame:
    """A fold over the rows of each conversation in order: step gives the next state and what the row gives; end, a row at the end."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    at = rows.columns.index("conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: object = None
        conv: object = None
        begun, kinds = False, None
        for batch in batches:
            kinds = batch.schema.field(at).type
            for first in range(0, batch.num_rows, 200):
                out: list[dict] = []
                for row in batch.slice(first, 200).to_pylist():
                    if not begun or row["conv"] != conv:
                        if begun and end:
                            out.append({"conv": conv} | end(state))
                        state, conv, begun = start(), row["conv"], True
                    state, made = step(state, row)
                    if made is not None:
                        out.append(made)
                if out:
                    yield pa.RecordBatch.from_pylist(out, wanted(kinds))
        if begun and end:
            yield pa.RecordBatch.from_pylist([{"conv": conv} | end(state)], wanted(kinds))

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}

    def wanted(conv_type: pa.DataType) -> pa.Schema:
        return pa.schema([(n, conv_type if n == "conv" else types[f.strip().split()[1]]) for n, f in zip(names, schema.split(","), strict=True)])

    return rows.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(tidy(run), schema)


def _goals(several: DataFrame) -> DataFrame:
    """(conv, part, chunk, goal): what is to be paid after each chunk, from each state, to the end of its conversation."""
    kind = several.schema["conv"].dataType.simpleString()

    def step(goal: object, row: dict) -> tuple[object, dict]:
        made = {"conv": row["conv"], "part": row["part"], "chunk": row["chunk"], "goal": _based(goal)[1]}
        costs = row["costs"]
        back = tuple(min(min(costs[s * STATES + t] + goal[t] for t in range(STATES)), INF) for s in range(STATES))
        return back, made

    made = crossings(several.select("signature").distinct())
    met = several.select("conv", "part", "chunk", "signature").join(made, "signature").select("conv", "part", "chunk", "costs")
    return _streamed(met, [F.col("part").desc(), F.col("chunk").desc()], f"conv {kind}, part long, chunk long, goal array<long>", lambda: END, step)


def _entries(several: DataFrame) -> DataFrame:
    """(conv, part, chunk, entry): the state in which each chunk begins, of chunks with `exits`, the state each state leads to."""
    kind = several.schema["conv"].dataType.simpleString()

    def step(state: object, row: dict) -> tuple[object, dict]:
        return row["exits"][state], {"conv": row["conv"], "part": row["part"], "chunk": row["chunk"], "entry": state}

    return _streamed(several, [F.col("part"), F.col("chunk")], f"conv {kind}, part long, chunk long, entry int", lambda: 0, step)


def summed(found: DataFrame) -> DataFrame:
    """One row for each conversation of its chunks in order: counts, cost and audit, with what stands between two chunks."""
    kind = found.schema["conv"].dataType.simpleString()

    def step(state: dict, row: dict) -> tuple[dict, None]:
        if not state:
            state = dict.fromkeys([*COUNTS, "cost"], 0) | {"audit": [], "low": None, "high": None, "last": None}
        elif state["last"] + row["first"] not in ("su", "ua", "au"):
            state["illegal"] += 1
        for c in (*COUNTS, "cost"):
            state[c] += row[c]
        if row["low"] is not None:
            state["turns"] -= row["low"] == state["high"]
            state["low"] = row["low"] if state["low"] is None else state["low"]
            state["high"] = row["high"]
        state["last"] = row["last"]
        state["audit"].append(row["audit"])
        return state, None

    def end(state: dict) -> dict:
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
        return {"gaps": gaps} | {c: state[c] for c in (*COUNTS[:-1], "cost")} | {"audit": "".join(state["audit"])}

    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _streamed(found.select("conv", "part", "chunk", *COUNTS, "first", "last", "low", "high", "cost", "audit"), [F.col("part"), F.col("chunk")], schema, dict, step, end)


def blocks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, whole, part, chunk, block, bytes, sha256): of a conversation in one chunk the digest of its repaired text, of others
    their text, each row after a newline, in blocks. rows are those of ordered(), found their chunks with audit and entry."""
    kind = rows.schema["conv"].dataType.simpleString()
    heads = found.select("conv", "part", "chunk", F.lit(0).cast("long").alias("row"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "entry", "whole", F.lit(0).alias("__kind"))
    bodies = rows.select("conv", "part", "chunk", "row", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("boolean").alias("whole"), F.lit(1).alias("__kind"))
    both = heads.unionByName(bodies).repartition("part", "chunk").sortWithinPartitions("part", "chunk", "conv", "__kind", "row").select("conv", "part", "chunk", "role", "text", "audit", "entry", "whole")
    names = ["conv", "whole", "part", "chunk", "block", "bytes", "sha256"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        head: dict = {}
        at = state = block = 0
        text: list[bytes] = []
        size, hashed, empty = 0, hashlib.sha256(), True

        def put(role: str, own: str) -> None:
            nonlocal size, empty
            data = f"{role}:{own}".encode()
            if head["whole"]:
                hashed.update(data if empty else b"\n" + data)
            else:
                text.append(b"\n" + data)
                size += len(data) + 1
            empty = False

        def flush() -> None:
            nonlocal block, size
            if text:
                out.append((head["conv"], False, head["part"], head["chunk"], block, b"".join(text), None))
                text.clear()
                block, size = block + 1, 0

        def inserts() -> None:
            nonlocal at, state
            while at < len(head["audit"]) and head["audit"][at] == "I":
                role, state = ADDS[state]
                put(role, "")
                at += 1

        def close() -> None:
            if head:
                inserts()
                if head["whole"]:
                    out.append((head["conv"], True, head["part"], head["chunk"], 0, None, hashed.hexdigest()))
                flush()

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 200):
                for row in batch.slice(start, 200).to_pylist():
                    if row["audit"] is not None:
                        close()
                        head, at, state, block, hashed, empty = row, 0, row["entry"], 0, hashlib.sha256(), True
                        continue
                    inserts()
                    letter = head["audit"][at]
                    at += 1
                    if letter == "K":
                        put(row["role"], row["text"])
                        state = LEADS[row["role"][:1]][state]
                    elif letter == "R":
                        role, state = ADDS[state]
                        put(role, row["text"])
                    if size >= BLOCK:
                        flush()
                        yield made(out, conv_type)
                        out = []
                if out:
                    yield made(out, conv_type)
                    out = []
        close()
        if out:
            yield made(out, conv_type)

    def made(out: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [conv_type, *kinds], strict=True)], names)

    return both.mapInArrow(tidy(run), f"conv {kind}, whole boolean, part long, chunk long, block long, bytes binary, sha256 string")


def digests(written: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of blocks()."""
    kind = written.schema["conv"].dataType.simpleString()

    def step(state: list, row: dict) -> tuple[list, None]:
        state[0].update(row["bytes"] if state[1] else row["bytes"][1:])
        state[1] = True
        return state, None

    several = written.where("not whole").select("conv", "part", "chunk", "block", "bytes")
    streamed = _streamed(several, [F.col("part"), F.col("chunk"), F.col("block")], f"conv {kind}, repaired_sha256 string", lambda: [hashlib.sha256(), False], step, lambda state: {"repaired_sha256": state[0].hexdigest()})
    return written.where("whole").select("conv", F.col("sha256").alias("repaired_sha256")).unionByName(streamed)


def repair(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows (conv_id,
    turn, role, text), and of those of convs (conv_id) that have no rows."""
    rows = ordered(rows)
    known = cut(chunks(with_faults(rows)))
    pieces = known.groupBy(F.col("conv").alias("__conv")).agg(F.count("*").alias("__n"))
    known = cut(known.join(pieces, known["conv"].eqNullSafe(pieces["__conv"])).withColumn("whole", F.col("__n") == 1).drop("__conv", "__n"))
    several = known.where("not whole")
    keys = ["conv", "part", "chunk"]
    goals = _goals(several).withColumnsRenamed({k: f"__{k}" for k in keys})
    end = F.array(*[F.lit(x).cast("long") for x in END])
    split = several.join(goals, _same(several, goals, keys)).drop(*[f"__{k}" for k in keys])
    aimed = cut(known.where("whole").withColumn("goal", end).unionByName(split))
    answers = cut(audits(aimed.groupBy("signature", "goal").agg(F.bool_and("whole").alias("whole"))))

    whole = aimed.where("whole").drop("goal").join(answers.where((F.col("goal") == end) & (F.col("entry") == 0)).drop("goal", "exit"), "signature")
    split = aimed.where("not whole")
    exits = F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))), lambda x: x["exit"].cast("long"))
    by_state = answers.groupBy("signature", "goal").agg(exits.alias("exits"))
    entries = _entries(split.select(*keys, "signature", "goal").join(by_state, ["signature", "goal"]).select(*keys, "exits")).withColumnsRenamed({k: f"__{k}" for k in keys})
    begun = split.join(entries, _same(split, entries, keys)).drop(*[f"__{k}" for k in keys])
    begun = begun.join(answers.drop("exit"), ["signature", "goal", "entry"]).drop("goal")
    found = cut(whole.unionByName(begun))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    counts = found.where("whole").select("conv", gaps.alias("gaps"), *COUNTS[:-1], "cost", "audit").unionByName(summed(found.where("not whole")))
    texts = digests(cut(blocks(rows, found.select("conv", "part", "chunk", "audit", "entry", "whole")))).withColumnRenamed("conv", "__conv")
    done = counts.join(texts, counts["conv"].eqNullSafe(texts["__conv"])).drop("__conv").withColumnRenamed("conv", "__conv")
    asked = (convs if convs is not None else rows.select(F.col("conv").alias("conv_id"))).select("conv_id").distinct()
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return asked.join(done, asked["conv_id"].eqNullSafe(done["__conv"]), "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)
