"""Cheapest repair of conversations: cost layers of grammar states, packed into one machine word a turn.

The grammar of role initials is (s?(ua)+)?. Its states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LAYERS = 16
EACH = int("1" * LAYERS, 16)
ALL = (1 << 4 * LAYERS) - 1
ACCEPT = 0b1001
#: What a turn may be: its initial (none, s, u, a, empty) by its condition (whole, truncated, to be deleted).
INITIALS = {"s": 1, "u": 2, "a": 3, "": 4}
WHOLE, SHORT, GONE = 0, 1, 2


def next_state(state: int, initial: int) -> int | None:
    """The state after a turn of this initial, or None; an empty initial adds nothing to the sequence."""
    if initial == 4:
        return state
    return {1: 1 if state == 0 else None, 2: 2 if state != 2 else None, 3: 3 if state == 2 else None}.get(initial)


def before(word: int, initial: int) -> int:
    """The states from which a turn of this initial leads into the word's sets, layer by layer."""
    if initial == 1:
        return word >> 1 & EACH
    if initial == 2:
        into = word >> 2 & EACH
        return into | into << 1 | into << 3
    if initial == 3:
        return (word >> 3 & EACH) << 2
    return word if initial == 4 else 0


def inserted(word: int) -> int:
    """Adds up to two insertions before what follows; a third leads where the first did."""
    for _ in range(2):
        word |= (before(word, 2) | before(word, 3)) << 4 * INSERT & ALL
    return word & ALL


def levelled(word: int) -> tuple[int, int]:
    """The word with its first set in layer 0, and the layers taken away."""
    shift = 0
    while not word & 15:
        word, shift = word >> 4, shift + 1
    return word, shift


class RepairAutomaton:
    """Layers of states from which the rest of a conversation can be completed, from its end to its start.

    Layer c of a word is the 4-bit set of states that need c more than the cheapest one. No state needs over 12 more
    (two insertions reach all states that can follow, and one deletion lets 3 stand for 0), so 16 layers lose nothing.
    Words repeat: each is numbered once, and a turn is a step from number to number.
    """

    def __init__(self) -> None:
        self.words: list[int] = []
        self.numbers: dict[int, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.choices: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.number(levelled(inserted(ACCEPT))[0])

    def number(self, word: int) -> int:
        if word not in self.numbers:
            self.numbers[word] = len(self.words)
            self.words.append(word)
        return self.numbers[word]

    def needs(self, number: int, state: int) -> int:
        """The first layer that holds the state."""
        word, layer = self.words[number], 0
        while not word >> state & 1:
            word, layer = word >> 4, layer + 1
        return layer

    def step(self, after: int, code: int) -> tuple[int, int]:
        """(number before a turn, layers its cheapest state lies above that of the number after it)."""
        found = self.steps.get((after, code))
        if found is None:
            initial, condition = divmod(code, 3)
            word = self.words[after]
            here = word << 4 * DELETE
            if condition != GONE:
                kept = before(word, initial) | (before(word, 2) | before(word, 3)) << 4 * REROLE
                here |= kept << 4 * TRUNCATED if condition == SHORT else kept
            # wider than the layers until levelled, so that nothing falls off the top
            word, shift = levelled(here)
            found = self.steps[(after, code)] = (self.number(inserted(word & ALL)), shift)
        return found

    def choose(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The least edits at a turn (insertions before it, then its own) from a state, and the state after them."""
        found = self.choices.get((after, code, state))
        if found is None:
            initial, condition = divmod(code, 3)
            here, shift = self.step(after, code)
            extra = TRUNCATED if condition == SHORT else 0
            edits, at = "", state
            while True:
                left = self.needs(here, at) + shift
                fits = lambda to, cost: to is not None and self.needs(after, to) + cost == left  # noqa: B023, E731
                other = 3 if at == 2 else 2
                if fits(at, DELETE):
                    edits += "D"
                elif self.needs(here, other) + INSERT == self.needs(here, at):
                    edits, at = edits + "I", other
                    continue
                elif condition != GONE and fits(next_state(at, initial), extra):
                    edits, at = edits + "K", next_state(at, initial)
                else:
                    edits, at = edits + "R", other
                break
            found = self.choices[(after, code, state)] = (edits, at)
        return found

    def repair(self, codes: bytes) -> tuple[int, list[str]]:
        """(least cost, edits): one string a turn, and one of the insertions at the end."""
        numbers, base = array("I", [self.end]), 0
        for code in reversed(codes):
            number, shift = self.step(numbers[-1], code)
            numbers.append(number)
            base += shift
        cost = base + self.needs(numbers[-1], 0)
        state, edits, n = 0, [], len(codes)
        for k, code in enumerate(codes):
            made, state = self.choose(numbers[n - k - 1], code, state)
            edits.append(made)
        rest = ""
        while not ACCEPT >> state & 1:
            state, rest = (3 if state == 2 else 2), rest + "I"
        return cost, [*edits, rest]


def damage(rows: DataFrame) -> DataFrame:
    """The fixed damage of the test bed, by crc32("conv_id:turn") % 20; adds `lost` for rows that are dropped.

    0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user. A null counts as one
    space.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")


TURNS = "conv_id {kind}, edit string, turn long, role string, text string, report struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"


def repair_turns(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """(conv_id, edit, turn, role, text, report): each conversation's edits in order, behind them a row with its report.

    Edits: K keeps a turn, R gives it the role user or assistant, D deletes it, I inserts an empty turn (turn null).
    What is not deleted is the repaired conversation. rows: (conv_id, turn, role, text); nulls count as one space, a
    null conv_id is a conversation of its own, turns without a number come first, rows of one turn are taken by role
    and text. Rows marked in the column `lost` count as missing, but their conversation is reported. Other columns are
    ignored. An empty table gives none.

    A conversation is one sequence: a task reads it in order. It holds three bytes a turn; the texts come a second time
    behind the codes and pass through, so a conversation of any length takes little memory.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col(lost) if lost is not None else F.lit(False)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), gone.alias("lost"))
    dealt = own.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    place = F.row_number().over(Window.partitionBy("conv_id", "lost").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "b").when(F.col("seen") > 1, "d").when(open_end, "t").otherwise("")
    ordered = dealt.withColumn("seen", seen).withColumn("place", place).withColumn("fault", fault)
    initial = F.substring("role", 1, 1)
    first = F.struct(F.lit(0).alias("phase"), initial.alias("role"), F.lit(None).cast("string").alias("text"))
    second = F.struct(F.lit(1).alias("phase"), F.col("role").alias("role"), F.col("text").alias("text"))
    both = F.explode(F.when(F.col("lost"), F.array(first)).otherwise(F.array(first, second))).alias("x")
    stream = ordered.select("conv_id", "lost", "turn", "place", "fault", both).select("conv_id", "x.phase", "lost", "place", "turn", "fault", "x.role", "x.text").sortWithinPartitions("conv_id", "phase", "lost", "place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(edit_stream, TURNS.format(kind=kind))


class Conversation:
    """What is known of one conversation while its turns come by."""

    def __init__(self, key) -> None:
        self.key = key
        self.codes = bytearray()
        self.edits: list[str] | None = None
        self.count = {"b": 0, "d": 0, "t": 0, "": 0}
        self.low = self.high = self.before = None
        self.distinct = self.illegal = self.state = self.at = 0

    def turn(self, turn: int | None, initial: str, fault: str) -> None:
        self.count[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high != turn
            self.high = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.codes.append(3 * INITIALS.get(initial, 0) + {"": WHOLE, "t": SHORT}.get(fault, GONE))

    def report(self) -> dict:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.count["b"], "duplicate": self.count["d"], "truncated": self.count["t"], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.edits)}

    def solve(self, automaton: RepairAutomaton) -> None:
        self.cost, self.edits = automaton.repair(bytes(self.codes))

    def apply(self, edits: str, turn: int | None, role: str | None, text: str | None) -> Iterator[tuple]:
        """The edits at one turn as rows."""
        for edit in edits:
            user = self.state != 2
            if edit == "D":
                yield self.key, "D", turn, role, text, None
                continue
            if edit == "K":
                self.state = next_state(self.state, INITIALS[role[:1]])
                yield self.key, "K", turn, role, text, None
                continue
            self.state = 2 if user else 3
            made = "user" if user else "assistant"
            yield (self.key, "I", None, made, "", None) if edit == "I" else (self.key, "R", turn, made, text, None)


def edit_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, now, schema = RepairAutomaton(), None, None

    def finish(talk: Conversation) -> Iterator[tuple]:
        if talk.edits is None:
            talk.solve(automaton)
        yield from talk.apply(talk.edits[-1], None, None, None)
        yield talk.key, None, None, None, None, talk.report()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], ["conv_id", "edit", "turn", "role", "text", "report"])

    report = pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
    out: list[tuple] = []
    for batch in batches:
        schema = [batch.schema.field("conv_id").type, pa.string(), pa.int64(), pa.string(), pa.string(), report]
        for key, phase, lost, _, turn, fault, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.extend(finish(now))
                now = Conversation(key)
            if lost:
                continue
            if phase == 0:
                now.turn(turn, role, fault)
                continue
            if now.edits is None:
                now.solve(automaton)
            out.extend(now.apply(now.edits[now.at], turn, role, text))
            now.at += 1
        if out:
            yield packed(out)
            out = []
    if now is not None:
        yield packed(list(finish(now)))


def repair_report(rows: DataFrame, lost: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: numbers missing between the first and the last turn. The digest is that of the repaired turns `role:text`,
    joined by newlines; without turns that of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            out: list[dict] = []
            for key, edit, _, role, text, report in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if report is not None:
                    out.append({"conv_id": key, **report, "repaired_sha256": digest.hexdigest()})
                    digest, begun = hashlib.sha256(), False
                elif edit != "D":
                    digest.update(("\n" * begun + f"{role}:{text}").encode())
                    begun = True
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return repair_turns(rows, lost).mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
