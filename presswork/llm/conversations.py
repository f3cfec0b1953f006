"""Conversation structure repair at least cost, by lazy weighted determinisation.

A conversation is a word over its rows' symbols: the role's initial (s, u, a or another) with what is wrong
(nothing, truncated, to be deleted). Keeping, rerolling, deleting and inserting rows make it a word of ``(s?(ua)+)?``,
whose automaton has four states. The least costs of standing in each of them after a row, less
their least, are one state of the determinised automaton; it and its moves are made when a row first needs them and kept
in a table, so that a conversation is a scan over that table. Going back from its cheapest ends, arcs
whose cost is just the difference of their ends' costs (tight ones) mark what lies on some cheapest path; the audit is
the ASCII-least word read off the marked arcs.

A conversation may be longer than a task should read: rows are ranked in one range-partitioned sort, and
chunks of at most CHUNK rows are scanned on their own, from each state. Only what a chunk does to costs is
carried along a conversation (a row of a few numbers for each chunk); texts aren't part of this.

Defined results: nulls are one space before all else, so a null id is a conversation of its own; rows without a turn come
first, and rows of one turn are in order of role, then of their text's SHA-256; equal rows are copies of which all but the
first are duplicates; an initial other than s, u and a can't be kept; a conversation of which no row
is left after the damage has zeros; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Rows of a chunk: this power of two.
CHUNK_BITS = 14
FAR = 1 << 40

#: The states of (s?(ua)+)? and where s, u and a lead; 0 begins, 0 and 3 end.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: The role that an edit into a state gives.
ROLES = {2: "u", 3: "a"}
STATES = range(4)
#: Symbols: initials as they are, upper case if truncated, digits if the row must go.
SYMBOLS = {"": "suao", "truncated": "SUAO", "deleted": "1234"}
INSERTED = [(q, p) for x in "ua" for q, p in NEXT[x].items()]
Costs = tuple[int, ...]


def closed(costs: Costs) -> Costs:
    """Costs with insertions before the next row, without those that no cheapest path can have.

    What leads on from 1 leads on from 3 at the same cost, and what leads on from 0 does from 3 if a kept s is deleted instead; with
    higher costs 0 and 1 are given up, which keeps the vectors few.
    """
    out = list(costs)
    for _ in STATES:
        for q, p in INSERTED:
            out[p] = min(out[p], out[q] + INSERT)
    if out[0] > out[3] + DELETE:
        out[0] = FAR
    if out[1] > out[3]:
        out[1] = FAR
    return tuple(out)


@lru_cache(None)
def arcs(symbol: str) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, from, to, cost) of a row, in ASCII order of the edits."""
    out = [("D", q, q, DELETE) for q in STATES]
    if symbol not in SYMBOLS["deleted"]:
        extra = TRUNCATED * symbol.isupper()
        out += [("K", q, p, extra) for q, p in NEXT.get(symbol.lower(), {}).items()]
        out += [("R", q, p, extra + REROLE) for q, p in INSERTED]
    return tuple(out)


class Automaton:
    """The determinised automaton, as far as it has been needed. A state is a vector of costs whose least is 0."""

    def __init__(self) -> None:
        self.vectors: list[Costs] = []
        self.number: dict[Costs, int] = {}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.back: dict[tuple[int, str, int], tuple[int, dict[int, tuple[str, int]]]] = {}

    def state(self, costs: Costs) -> tuple[int, int]:
        """(number of the normalised costs, their least)"""
        least = min(costs)
        vector = tuple(c - least if c < FAR else FAR for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        """(next state, what is added to the least cost)"""
        key = state, symbol
        if key not in self.moves:
            now, out = self.vectors[state], [FAR] * len(STATES)
            for _, q, p, cost in arcs(symbol):
                out[p] = min(out[p], now[q] + cost)  # FAR at most
            self.moves[key] = self.state(closed(tuple(out)))
        return self.moves[key]

    def scan(self, word: str, costs: Costs) -> tuple[list[int], Costs]:
        """(state before each row and after the last, costs after the last)"""
        state, total = self.state(costs)
        path, moves = [state], self.moves
        for symbol in word:
            state, more = moves.get((state, symbol)) or self.move(state, symbol)
            total += more
            path.append(state)
        return path, tuple(min(c + total, FAR) for c in self.vectors[state])

    def inserts(self, vector: Costs, marked: int) -> int:
        """marked with the states from which tight insertions lead there."""
        for _ in STATES:
            for q, p in INSERTED:
                if marked >> p & 1 and vector[q] + INSERT == vector[p]:
                    marked |= 1 << q
        return marked

    def tight(self, state: int, symbol: str, marked: int) -> tuple[int, dict[int, tuple[str, int]]]:
        """marked: states on cheapest paths after the row. (those before it, and from each the least edits and where they lead)"""
        key = state, symbol, marked
        if key not in self.back:
            vector, (after, more) = self.vectors[state], self.move(state, symbol)
            then = [c + more for c in self.vectors[after]]
            rows = {}
            for edit, q, p, cost in reversed(arcs(symbol)):  # the least edit is put last
                if marked >> p & 1 and vector[q] < FAR and vector[q] + cost == then[p]:
                    rows[q] = (edit, p)
            before = self.inserts(vector, sum(1 << q for q in rows))
            self.back[key] = before, {q: self.least(vector, before, rows, q) for q in STATES if before >> q & 1}
        return self.back[key]

    def least(self, vector: Costs, marked: int, rows: dict[int, tuple[str, int]], q: int) -> tuple[str, int]:
        """The ASCII-least tight edits from q up to and with the row's own: D, else I, else K or R."""
        edits = ""
        while not (q in rows and rows[q][0] == "D"):
            target = next((p for a, p in INSERTED if a == q and marked >> p & 1 and vector[q] + INSERT == vector[p]), None)
            if target is None:
                break
            edits, q = edits + "I" + ROLES[target], target
        edit, p = rows[q]
        return edits + edit + (ROLES[p] if edit == "R" else ""), p

    def backward(self, word: str, path: list[int], marked: int) -> list[int]:
        """The marked states before each row and after the last."""
        out = [marked]
        for k in range(len(word) - 1, -1, -1):
            marked = self.tight(path[k], word[k], marked)[0]
            out.append(marked)
        return out[::-1]

    def audit(self, word: str, path: list[int], marks: list[int], q: int) -> tuple[list[str], int]:
        """(edits of each row with the insertions before it, state after the last row)"""
        out = []
        for k, symbol in enumerate(word):
            edits, q = self.tight(path[k], symbol, marks[k + 1])[1][q]
            out.append(edits)
        return out, q


def last_inserts(costs: Costs, q: int) -> str:
    """Insertions after the last row."""
    out = ""
    while q not in ENDS or costs[q] > min(costs[e] for e in ENDS):
        q = next(p for a, p in INSERTED if a == q and costs[q] + INSERT == costs[p])
        out += "I" + ROLES[q]
    return out


def ending(costs: Costs, automaton: Automaton) -> tuple[int, int]:
    """(least cost of a whole word, states on cheapest paths after the last row)"""
    cost = min(costs[e] for e in ENDS)
    return cost, automaton.inserts(costs, sum(1 << e for e in ENDS if costs[e] == cost))


BEGIN: Costs = closed((0, FAR, FAR, FAR))
UNITS = [closed(tuple(0 if p == q else FAR for p in STATES)) for q in STATES]
LEGAL = ("su", "ua", "au")


def initials(word: str) -> str:
    return word.translate(str.maketrans("SUAO1234", "suaosuao"))


def illegal_pairs(letters: str) -> int:
    return max(len(letters) - 1, 0) - sum(map(letters.count, LEGAL))


def keyed(conversations: DataFrame) -> DataFrame:
    """conv, has_turn, turn, role, text, digest: rows with nulls as one space, and what orders them, without nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        blank("conv_id").alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), blank("role").alias("role"), blank("text").alias("text"), blank("turn").alias("turn_text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; repeats are rows of their own."""
    kind = F.crc32(F.concat_ws(":", "conv", "turn_text")) % 20
    rows = keyed(conversations).withColumn("damage", kind).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return with_digest(rows.withColumn("copy", copies))


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.select("conv", "has_turn", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))


KEYS = ["conv", "has_turn", "turn", "role", "digest"]


def placed(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one with their number n: KEYS, symbol, n, and ``at``, their rank in order of KEYS.

    A text that is repeated within a conversation is told by its first turn, an aggregate that is joined by all KEYS,
    so neither a hot conversation nor a hot text meets in one task.
    """
    seen = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    alike = rows.select(*KEYS, (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("truncated")).groupBy(*KEYS, "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    alike = materialize(alike, "conversation-rows")
    first = alike.where("not blank").groupBy("conv", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("x")).select("conv", "x.*", "role", "digest", F.lit(True).alias("first"))
    told = alike.join(first, KEYS, "left")
    initial = F.substring("role", 1, 1)
    which = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    symbol = lambda fault: F.substring(F.lit(SYMBOLS[fault]), which, F.lit(1))
    gone = F.col("blank") | F.col("first").isNull()
    told = told.select(*KEYS, "n", "blank", "truncated", gone.alias("gone"), F.when(gone, symbol("deleted")).when(F.col("truncated"), symbol("truncated")).otherwise(symbol("")).alias("symbol"), symbol("deleted").alias("again"))
    order = [F.col(k) for k in KEYS]
    ranked = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(ranked, "conversation-order")


def chunks(placed: DataFrame) -> DataFrame:
    """A row for each conversation's rows in a chunk: conv, chunk, word, and counts of its faults and turns."""
    own = placed.select("conv", F.shiftright("at", CHUNK_BITS).alias("chunk"), "at", F.concat("symbol", F.repeat("again", (F.col("n") - 1).cast("int"))).alias("symbols"), "n", "blank", "gone", "truncated", F.when(F.col("has_turn"), F.col("turn")).alias("turn"))
    blank, duplicate = F.when(F.col("blank"), F.col("n")).otherwise(0), F.when(F.col("blank"), 0).when(F.col("gone"), F.col("n")).otherwise(F.col("n") - 1)
    truncated = F.when(~F.col("gone") & F.col("truncated"), 1).otherwise(0)
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbols"))), lambda x: x["symbols"]), "")
    return own.groupBy("conv", "chunk").agg(
        word.alias("word"), F.sum(blank).alias("blank"), F.sum(duplicate).alias("duplicate"), F.sum(truncated).cast("long").alias("truncated"), F.min("turn").alias("least"), F.max("turn").alias("most"), F.countDistinct("turn").alias("turns"),
    )


def streams(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of rows (tuples) of equal first ``by`` values, of sorted batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=itemgetter(*range(by)) if by > 1 else lambda r: (r[0],))


def dealt(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


LONG, TEXT = pa.int64(), pa.string()
EFFECT = pa.schema([("conv", TEXT), ("chunk", LONG), ("effect", pa.list_(LONG)), ("ends", TEXT), ("illegal", LONG), ("blank", LONG), ("duplicate", LONG), ("truncated", LONG), ("least", LONG), ("most", LONG), ("turns", LONG)])
CARRIED = pa.schema([("conv", TEXT), ("chunk", LONG), ("costs", pa.list_(LONG)), ("marked", LONG), ("is_last", pa.bool_()), ("cost", LONG), ("illegal", LONG), ("blank", LONG), ("duplicate", LONG), ("truncated", LONG), ("gaps", LONG)])
TRACED = pa.schema([("conv", TEXT), ("chunk", LONG), ("edits", pa.list_(pa.list_(TEXT))), ("exits", pa.list_(LONG))])
HASHED = pa.schema([("conv", TEXT), ("repaired_sha256", TEXT)])
CHOSEN = pa.schema([("conv", TEXT), ("chunk", LONG), ("enters", LONG)])


def ddl(schema: pa.Schema) -> str:
    kinds = {LONG: "long", TEXT: "string", pa.bool_(): "boolean", pa.list_(LONG): "array<long>", pa.list_(TEXT): "array<string>", pa.list_(pa.list_(TEXT)): "array<array<string>>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a chunk does to the costs of each state that it may be entered in (16 numbers), and its pairs of roles."""
    automaton = Automaton()

    def one(r: tuple) -> tuple:
        conv, chunk, word, *counts = r
        letters = initials(word)
        effect = [c for unit in UNITS for c in automaton.scan(word, unit)[1]]
        return conv, chunk, effect, letters[0] + letters[-1], illegal_pairs(letters), *counts

    yield from dealt((one(r) for _, rows in streams(batches, 1) for r in rows), EFFECT)


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs with which each chunk is entered, the states on cheapest paths at its end, and the conversation's numbers in its last chunk's row."""
    automaton = Automaton()

    def every() -> Iterator[tuple]:
        for (conv,), rows in streams(batches, 1):
            costs, entered, parts = BEGIN, [], list(rows)  # a row for each CHUNK rows of the conversation
            illegal, turns, ends, most = 0, 0, "", None
            for _, _, effect, own, pairs, *_, low, high, distinct in parts:
                entered.append(costs)
                costs = tuple(min(min(costs[q] + effect[4 * q + p] for q in STATES), FAR) for p in STATES)
                illegal += pairs + (bool(ends) and ends[-1] + own[0] not in LEGAL)
                turns += distinct - (low is not None and low == most)
                ends, most = own, high if high is not None else most
            cost, marked = ending(costs, automaton)
            least = next((p[8] for p in parts if p[8] is not None), None)
            gaps = most - least + 1 - turns if least is not None else 0
            sums = [sum(p[i] for p in parts) for i in (5, 6, 7)]
            for k in range(len(parts) - 1, -1, -1):
                last = k == len(parts) - 1
                yield (conv, parts[k][1], list(entered[k]), marked, last, *((cost, illegal, *sums, gaps) if last else (None,) * 6))
                effect, now = parts[k][2], costs
                costs = entered[k]
                marked = sum(1 << q for q in STATES if costs[q] < FAR and any(marked >> p & 1 and costs[q] + effect[4 * q + p] == now[p] for p in STATES))

    yield from dealt(every(), CARRIED)


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, for each state on a cheapest path at its begin: the edits of its rows, and the state they lead to."""
    automaton = Automaton()

    def one(r: tuple) -> tuple:
        conv, chunk, word, costs, marked, last = r
        path, after = automaton.scan(word, tuple(costs))
        marks = automaton.backward(word, path, marked)
        edits, exits = [[] for _ in STATES], [-1] * len(STATES)
        for q in STATES:
            if marks[0] >> q & 1:
                edits[q], exits[q] = automaton.audit(word, path, marks, q)
                if last and (more := last_inserts(after, exits[q])):
                    edits[q] = [*edits[q], more]
        return conv, chunk, edits, exits

    yield from dealt((one(r) for _, rows in streams(batches, 1) for r in rows), TRACED, 256)


def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the audit enters each chunk."""

    def every() -> Iterator[tuple]:
        for (conv,), rows in streams(batches, 1):
            q = 0
            for _, chunk, exits in rows:
                yield conv, chunk, q
                q = exits[q]

    yield from dealt(every(), CHOSEN)


def by_conversation(rows: DataFrame) -> DataFrame:
    """Each conversation's chunks in order, in one task."""
    return rows.repartition("conv").sortWithinPartitions("conv", "chunk")


def edited(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, chunk, edits: an entry for each row or copy and perhaps one for insertions at the end; a row of numbers for each conversation)"""
    words = materialize(chunks(placed), "conversation-chunks")
    effect = words.mapInArrow(effects, ddl(EFFECT))
    carry = materialize(by_conversation(effect).mapInArrow(carried, ddl(CARRIED)), "conversation-carry")
    asked = words.select("conv", "chunk", "word").join(carry.select("conv", "chunk", "costs", "marked", "is_last"), ["conv", "chunk"])
    traces = materialize(asked.mapInArrow(traced, ddl(TRACED)), "conversation-traces")
    enters = by_conversation(traces.select("conv", "chunk", "exits")).mapInArrow(chosen, ddl(CHOSEN))
    edits = traces.join(enters, ["conv", "chunk"]).select("conv", "chunk", F.col("edits")[F.col("enters").cast("int")].alias("edits"))
    numbers = carry.where("is_last").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return edits, numbers


def repaired(rows: DataFrame, placed: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, chunk, k, step, action, role, text: the rows that the edits leave or insert; chunk, k and step order a conversation's.

    action is K, R or I. A row is known by its chunk and place k there; its text joins by KEYS, of copies one.
    """
    entries = edits.select("conv", "chunk", F.posexplode("edits").alias("k", "entry")).where("entry <> 'D'").select("conv", "chunk", F.col("k").cast("long").alias("k"), F.posexplode(F.regexp_extract_all("entry", F.lit("([A-Z][ua]?)"), F.lit(1))).alias("step", "edit"))
    within = Window.partitionBy("conv", "chunk").orderBy("at")  # a chunk's rows at most
    own = placed.withColumn("chunk", F.shiftright("at", CHUNK_BITS)).select(*KEYS, "chunk", (F.sum("n").over(within) - F.col("n")).alias("k"))
    given = F.when(F.col("edit").endswith("u"), "user").otherwise("assistant")
    action = F.substring("edit", 1, 1)
    inserted = entries.where(action == "I").select("conv", "chunk", "k", "step", action.alias("action"), given.alias("role"), F.lit("").alias("text"))
    stays = own.join(entries.where(~action.isin("I", "D")), ["conv", "chunk", "k"])
    texts = rows.dropDuplicates(KEYS)
    stays = texts.join(stays, KEYS).select("conv", "chunk", "k", "step", action.alias("action"), F.when(action == "K", F.col("role")).otherwise(given).alias("role"), "text")
    return stays.unionByName(inserted)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired rows; conv, audit; conv and its numbers) of rows as with_digest gives them."""
    order = placed(rows)
    edits, numbers = edited(order)
    edits = materialize(edits, "conversation-edits")
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.regexp_replace(F.array_join("edits", ""), "[a-z]", "").alias("audit"))))
    audits = edits.groupBy("conv").agg(F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    return repaired(rows, order, edits), audits, numbers


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines; one hash is one stream, of which a batch is held."""

    def every() -> Iterator[tuple]:
        for (conv,), rows in streams(batches, 1):
            sha, between = hashlib.sha256(), ""
            for _, role, text in rows:
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield conv, sha.hexdigest()

    yield from dealt(every(), HASHED)


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, damaged and repaired."""
    rows, audits, numbers = repair(damaged(conversations))
    lines = rows.repartition("conv").sortWithinPartitions("conv", "chunk", "k", "step").select("conv", "role", "text")
    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).groupBy("conv").agg(F.min("conv_id").alias("conv_id"))
    out = every.join(numbers, "conv", "left").join(audits, "conv", "left").join(lines.mapInArrow(hashed, ddl(HASHED)), "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
