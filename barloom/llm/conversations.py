"""Faults of conversations and their cheapest repair, over a suffix-shared automaton.

The rows of a conversation become one signature: a letter per row for its role and fault.
Signatures are merged from the end: equal remaining signatures are one automaton node, whatever
conversation they come from.  A node knows, for each state of the grammar, the cost to go
and the first letter of the best audit that is left; the letter leads to the next node
and state, so an audit suffix is stored once and shared.  Distinct signatures are
range-partitioned and sorted by their reverse, so the nodes of the current path are all that
a task holds, and each node is computed once.

The edits that a node and state can choose from begin with different letters, which is why the
first letter alone settles ties between whole audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACES, partitions, ship, small_batches
from barloom.session import materialize

ship(__name__)

# Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# The state that a user or assistant row leads to, by state before it.
TURN = (USER, USER, ASSISTANT, USER)
KEEP = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
KEEP |= {(state, "e"): state for state in range(4)}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 40
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
# Letters of a signature: s, u, a, o (another role), e (an empty role, which has no initial); upper case where
# the text is truncated; x must go.
MUST_GO = "x"
# Rows of one conversation that one piece of its signature covers.
PIECE = 1_000_000


# --- automaton ------------------------------------------------------------------------


def _with_inserts(base: list[int]) -> list[int]:
    best = list(base)
    for _ in range(3):
        best = [min(b, INSERT_COST + best[TURN[s]]) for s, b in enumerate(base)]
    return best


def _choices(best: list[int], options: list[list[tuple[int, str]]]) -> str:
    """Per state the least letter among the options of the least cost."""
    for s, found in enumerate(options):
        found.append((INSERT_COST + best[TURN[s]], "I"))
    return "".join(min(letter for cost, letter in found if cost == best[s]) for s, found in enumerate(options))


def end_node() -> tuple[tuple[int, ...], str, int]:
    """(cost to go by state, first letter by state, cost in all states) of the empty signature; ``.`` ends an audit."""
    options = [[(0, ".")], [], [], [(0, ".")]]
    best = _with_inserts([0, NEVER, NEVER, 0])
    return tuple(best), _choices(best, options), 0


def step(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str, int]:
    """The node of ``symbol`` before a node with costs ``after``.

    Costs are kept above their minimum, which is returned apart: inserts bound how far
    states can differ, so there are few different vectors and a table of steps stays small.
    """
    options: list[list[tuple[int, str]]] = []
    extra = TRUNCATED_COST if symbol.isupper() else 0
    for state in range(4):
        found = [(DELETE_COST + after[state], "D")]
        if symbol != MUST_GO:
            kept = KEEP.get((state, symbol.lower()))
            if kept is not None:
                found.append((extra + after[kept], "K"))
            found.append((REROLE_COST + extra + after[TURN[state]], "R"))
        options.append(found)
    best = _with_inserts([min(cost for cost, _ in found) for found in options])
    letters, low = _choices(best, options), min(best)
    return tuple(b - low for b in best), letters, low


def moved(state: int, letter: str, symbol: str) -> int:
    """The grammar state after an edit."""
    if letter == "D":
        return state
    return KEEP[state, symbol.lower()] if letter == "K" else TURN[state]


class Automaton:
    """Nodes along the current signature, from its end; signatures must come sorted by their reverse."""

    def __init__(self):
        self.reverse, self.nodes, self.steps = "", [(*end_node()[:2], 0)], {}

    def audit(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature."""
        reverse = signature[::-1]
        shared, limit = 0, min(len(reverse), len(self.reverse))
        while shared < limit and reverse[shared] == self.reverse[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reverse[shared:]:
            costs, _, total = self.nodes[-1]
            if (symbol, costs) not in self.steps:
                self.steps[symbol, costs] = step(symbol, costs)
            best, letters, low = self.steps[symbol, costs]
            self.nodes.append((best, letters, total + low))
        self.reverse = reverse
        costs, _, total = self.nodes[-1]
        letters, state, at = [], BEGIN, len(signature)
        while (letter := self.nodes[at][1][state]) != ".":
            letters.append(letter)
            if letter == "I":
                state = TURN[state]
            else:
                state, at = moved(state, letter, reverse[at - 1]), at - 1
        return total + costs[BEGIN], "".join(letters)


# --- rows -----------------------------------------------------------------------------


def damaged(turns: DataFrame, modulus: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, copies) after a repeatable damage drawn from ``conv_id:turn``.

    Of ``modulus`` draws 0 drops the row, 1 empties its text, 2 removes its end marks, 3 repeats it,
    4 makes it a user row.  Nulls read as one space; a null conv_id or turn stays null in its column.
    """
    spoken = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat(spoken["conv_id"], F.lit(":"), spoken["turn"])) % modulus
    text = F.when(draw == 1, "").when(draw == 2, F.translate(spoken["text"], ".!?", "")).otherwise(spoken["text"])
    role = F.when(draw == 4, "user").otherwise(spoken["role"])
    copies = F.when(draw == 3, 2).otherwise(1)
    return turns.filter(draw != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies")
    )


def whole(turns: DataFrame) -> DataFrame:
    """The same columns without damage: for conversations that are faulty as they come."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one: (conv_id, turn, role, digest, blank, truncated, copies, first).

    ``first`` tells that no earlier turn of the conversation has the role and text.  Everything is a
    map-side aggregate over unique keys, so neither a long conversation nor a
    text repeated in all its turns gathers in one task.
    """
    bare = F.translate("text", SPACES, "")
    seen = rows.select(
        "conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "copies",
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    opened = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = seen.groupBy("conv_id", "role", "digest").agg(F.min(opened).alias("at"))
    firsts = firsts.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    return (
        seen.withColumn("first", F.lit(False))
        .unionByName(firsts, allowMissingColumns=True)
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(
            F.max("blank").alias("blank"),
            F.max("truncated").alias("truncated"),
            F.sum("copies").alias("copies"),
            F.max("first").alias("first"),
        )
    )


def fault_counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) from marked rows; the first fault of a row counts."""
    sound = ~F.col("blank")
    by_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(sound, F.col("copies") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"),
        F.sum((sound & F.col("first") & F.col("truncated")).cast("int")).alias("truncated"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = (F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    return by_turn.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *sums)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, illegal): the letters of each conversation's rows by turn (nulls first), role, text digest.

    Rows are range-partitioned in that order, so a long conversation spans many tasks; each
    gives one piece of its signature, a byte a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = [None, 0, [], 0, "", "", False]  # conversation, piece, letters, illegal, head, tail, open

        def piece() -> Iterator[pa.RecordBatch]:
            if now[6]:
                names = ["conv_id", "piece", "letters", "illegal", "head", "tail"]
                values = [[now[0]], [now[1]], ["".join(now[2])], [now[3]], [now[4]], [now[5]]]
                kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, role, gone, truncated, copies, at in zip(*(c.to_pylist() for c in batch.columns)):
                if not now[6] or conv != now[0] or len(now[2]) >= PIECE:
                    yield from piece()
                    now[:] = [conv, at, [], 0, role, role, True]
                    adjacent = 0
                else:
                    adjacent = now[5] + role not in LEGAL
                now[3] += adjacent + (copies - 1)
                now[5] = role
                letter = (role if role in "sua" else "o") or "e"
                now[2].append((MUST_GO if gone else letter.upper() if truncated else letter) + MUST_GO * (copies - 1))
        yield from piece()

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    ranged = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    gone = F.col("blank") | ~F.col("first")
    kind = dict(rows.dtypes)["conv_id"]
    pieces = ranged.select(
        "conv_id", F.substring("role", 1, 1), gone, "truncated", "copies", F.monotonically_increasing_id()
    ).mapInArrow(run, f"conv_id {kind}, piece long, letters string, illegal long, head string, tail string")
    listed = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*pieces.columns[1:]))).alias("p"))
    seams = F.transform(
        F.slice("p", F.lit(2), F.size("p")),
        lambda x, i: (~F.concat(F.get("p", i)["tail"], x["head"]).isin(*LEGAL)).cast("long"),
    )
    total = F.aggregate(F.concat(seams, F.col("p.illegal")), F.lit(0).cast("long"), lambda a, b: a + b)
    return listed.select("conv_id", F.array_join("p.letters", "").alias("signature"), total.alias("illegal"))


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            found = [automaton.audit(s) for s in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "cost", "audit"])

    distinct = signed.select("signature").distinct()
    back = F.reverse("signature")
    ranged = distinct.repartitionByRange(partitions(signed), back).sortWithinPartitions(back)
    return ranged.mapInArrow(run, "signature string, cost long, audit string")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, edit, turn, role, text), rows of one conversation in order.

    ``rows`` as from ``damaged``, ``plans`` with conv_id, signature and audit.  Deleted rows are left out; an
    inserted row has no turn.  A conversation is streamed by one task in sorted order and never held.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, audit, signature, conv, id_type = 0, BEGIN, "", "", None, None
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = TURN[state], at + 1
                out.append((conv, "I", None, NAMES[state], ""))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            kinds = [id_type, pa.string(), pa.int64(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "edit", "turn", "role", "text"]
            )

        row = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, copies, turn, role, text, plan, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if not copies:
                    inserts()
                    at, state, audit, signature, conv, row = 0, BEGIN, plan, letters, own, 0
                for _ in range(copies):
                    inserts()
                    edit = audit[at]
                    state, at, row = moved(state, edit, signature[row]), at + 1, row + 1
                    if edit != "D":
                        out.append((conv, edit, turn, role if edit == "K" else NAMES[state], text))
            yield made()
        inserts()
        if out:
            yield made()

    told = plans.select("conv_id", F.lit(0).alias("copies"), "audit", "signature")
    both = rows.withColumn("digest", _digest(F.col("text"))).unionByName(told, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), (F.col("copies") > 0), F.asc_nulls_first("turn"), "role", "digest"]
    dealt = both.repartition(partitions(rows), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "copies", "turn", "role", "text", "audit", "signature").mapInArrow(
        run, f"conv_id {kind}, edit string, turn long, role string, text string"
    )


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines joined by line feeds; rows of a conversation must follow each other."""
    kind = dict(lines.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done, id_type = None, None, [], None

        def made() -> pa.RecordBatch:
            columns = [pa.array([c for c, _ in done], id_type), pa.array([s for _, s in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "sha256"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}"
                if state is None or own != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256(line.encode())
                else:
                    state.update(f"\n{line}".encode())
            if done:
                yield made()
        if state is not None:
            done.append((conv, state.hexdigest()))
            yield made()

    return lines.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def repair(turns: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audit table, repaired rows) of conversations.

    ``turns`` needs conv_id, turn, role, text; ``rows`` are its rows after damage (default: ``whole``).
    The audit table has one row for every conv_id of ``turns``, null included: gaps, blank,
    duplicate, truncated, illegal, cost, audit.  Rows run by turn (nulls first); rows of one
    turn by role and a digest of their text.  Roles count by their first letter; one other than
    s, u, a cannot be kept, an empty role adds nothing to the initials and can be kept anywhere.  No rows after damage: zeros and an empty audit.
    Other columns are ignored, whatever their names; an empty table gives none.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    rows = whole(turns) if rows is None else rows
    seen = materialize(marked(rows), "conversation-rows")
    signed = materialize(signatures(seen), "conversation-signatures")
    plans = materialize(signed.join(audits(signed), "signature"), "conversation-plans")
    table = (
        turns.select("conv_id").distinct()
        .unionByName(fault_counts(seen), allowMissingColumns=True)
        .unionByName(plans.drop("signature"), allowMissingColumns=True)
        .groupBy("conv_id")
    )
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = table.agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce(F.max("audit"), F.lit("")).alias("audit")
    )
    return told, repaired(rows, plans)


def audited(turns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The audit table with the digest of each repaired conversation (of the empty text if nothing is left)."""
    told, lines = repair(turns, rows)
    found = digests(lines)
    names = told.columns[1:]
    both = told.unionByName(found, allowMissingColumns=True).groupBy("conv_id")
    digest = F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return both.agg(*(F.max(c).alias(c) for c in names), digest)
