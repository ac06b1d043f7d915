"""Repair of conversation structure with a suffix-shared automaton.

A conversation becomes a signature, one letter for each row: ``x`` for a row
that has to go (blank or a duplicate), else the role ``s``, ``u``, ``a`` or ``o``
(any other), in upper case if the row is truncated. What the rest of a conversation costs depends on
its letters only, so the signatures of all conversations are shared from their
ends: each distinct suffix is one node of an automaton, that leads by its first letter to the node of the
rest. Signatures, each once, are ranged by their reversed letters, so that those with a
common ending come together; a task keeps the nodes of the current ending and makes only those that
differ from the one before. A node holds for every state of the grammar the
cost to the end and the first of the best edits, that is the best audit in linked form.

Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
0 and 3 may end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import SPACE_CHARS, bound_batches, join_spread, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The state after a row of a role, and the state after a row that is made to fit.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITTING = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
#: Costs to the end and first edits of the empty suffix.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))
_STEPS: dict[tuple, tuple] = {}


def step(costs: tuple[int, ...], letter: str) -> tuple[int, tuple[int, ...], str]:
    """(offset, costs, first edits) of the node that leads by ``letter`` to a node of these costs; costs are less the offset.

    Equal costs are decided by the edits' order in ASCII: different first edits decide, and equal ones go to the same state.
    """
    known = _STEPS.get((costs, letter))
    if known is None:
        own = []
        for state in range(4):
            options = [(DELETE + costs[state], "D")]
            if letter != "x":
                late = TRUNCATED * letter.isupper()
                to = AFTER[state].get(letter.lower())
                if to is not None:
                    options.append((KEEP + late + costs[to], "K"))
                options.append((REROLE + late + costs[FITTING[state]], "R"))
            own.append(min(options))
        # Three inserts in a row come back to where the first led.
        best = list(own)
        for _ in range(3):
            best = [min(own[q], (INSERT + best[FITTING[q]][0], "I")) for q in range(4)]
        least = min(c for c, _ in best)
        known = _STEPS[costs, letter] = least, tuple(c - least for c, _ in best), "".join(e for _, e in best)
    return known


class Automaton:
    """The nodes of one ending at a time; ``made`` counts all that were made."""

    def __init__(self):
        self.letters: list[str] = []  # from the end
        self.costs, self.offsets, self.edits = [END[0]], [0], [END[1]]
        self.made = 0

    def read(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature; what it shares with the end of the one before is not made again."""
        shared = 0
        most = min(len(signature), len(self.letters))
        while shared < most and signature[-1 - shared] == self.letters[shared]:
            shared += 1
        for held in (self.letters, self.costs, self.offsets, self.edits):
            del held[shared + (held is not self.letters) :]
        for letter in reversed(signature[: len(signature) - shared]):
            offset, costs, edits = step(self.costs[-1], letter)
            self.letters.append(letter)
            self.costs.append(costs)
            self.offsets.append(self.offsets[-1] + offset)
            self.edits.append(edits)
            self.made += 1
        audit, state, node = [], 0, len(signature)
        cost = self.offsets[node] + self.costs[node][0]
        while edit := self.edits[node][state]:
            audit.append(edit)
            if edit in "IR":
                state = FITTING[state]
            elif edit == "K":
                state = AFTER[state][signature[len(signature) - node].lower()]
            node -= edit != "I"
        return cost, "".join(audit)


def plan_repairs(signatures: DataFrame) -> DataFrame:
    """(signature, many, cost, audit, made) of distinct signatures (signature, many); ``made``: the automaton's nodes that it added to its task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            out = []
            for signature in batch.column(0).to_pylist():
                before = automaton.made
                out.append((*automaton.read(signature), automaton.made - before))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["signature", "many", "cost", "audit", "made"])

    ending = F.reverse("signature")
    ranged = signatures.select("signature", "many").repartitionByRange(ending).sortWithinPartitions(ending)
    return ranged.mapInArrow(run, "signature string, many long, cost long, audit string, made long")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after a trial damage by crc32 of ``conv_id:turn``, modulo 20.

    0 drops the row (it is marked as gone), 1 empties its text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. Nulls count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(blank("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def _digest() -> Column:
    """Of role and text: tells rows apart, and orders those of the same turn and role."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _ended(change: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(change) + 1]))


def diagnose(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of every conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    id_type = dict(rows.dtypes)["conv_id"]
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    fault = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", _digest().alias("digest"), fault.alias("fault"), "gone")
    dealt = narrow.repartition("conv_id")
    # By conversation and content, in the partitions that are there: the first of equal rows is none of the duplicates.
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy(F.col("turn").asc_nulls_first()))
    dealt = dealt.withColumn("nth", again)
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "nth")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("gone"), "").when((F.col("fault") == "blank") | (F.col("nth") > 1), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    kind = F.when(F.col("fault") == "blank", 1).when(F.col("nth") > 1, 2).when(F.col("fault") == "truncated", 3).otherwise(0)
    ordered = ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("initial").alias("initial"), letter.alias("letter"), kind.alias("kind"), "gone")
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def finish(x: dict) -> tuple:
            gaps = x["last"] - x["first"] + 1 - x["turns"] if x["turns"] else 0
            return x["id"], "".join(x["letters"]), gaps, x["kinds"][1], x["kinds"][2], x["kinds"][3], x["illegal"]

        for batch in batches:
            done = []
            for conv, turn, initial, letter, kind, gone in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if held is None or held["id"] != conv:
                    if held is not None:
                        done.append(finish(held))
                    held = {"id": conv, "letters": [], "first": None, "last": None, "turns": 0, "kinds": [0, 0, 0, 0], "illegal": 0, "initial": None}
                if gone:
                    continue
                held["letters"].append(letter)
                held["kinds"][kind] += 1
                if turn is not None:
                    held["first"] = turn if held["first"] is None else held["first"]
                    held["turns"] += turn != held["last"]
                    held["last"] = turn
                if held["initial"] is not None and held["initial"] + initial not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["initial"] = initial
            yield _records(done, names, batch.schema.field(0).type)
            kind_of_id = batch.schema.field(0).type
        if held is not None:
            yield _records([finish(held)], names, kind_of_id)

    return ordered.mapInArrow(run, f"conv_id {id_type}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def _records(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.string(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(is head, conv_id, place, edit, role, text) of rows in order; a conversation begins with its head, whose text is the audit."""
    audit, at, state, place, conv = "", 0, 0, 0, None

    def inserts(end: bool) -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = FITTING[state]
            yield False, conv, place, "I", ROLE_OF[state], ""
            at, place = at + 1, place + 1

    begun = False
    for batch in batches:
        for conv_next, head, role, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if head:
                if begun:
                    yield from inserts(True)
                begun, conv, audit, at, state, place = True, conv_next, text, 0, 0, 0
                yield True, conv, 0, "", "", ""
                continue
            yield from inserts(False)
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = FITTING[state]
                role = ROLE_OF[state]
            else:
                state = AFTER[state][role[0]]
            yield False, conv, place, edit, role, text
            place += 1
        yield None, None, 0, "", "", ""  # a batch's end
    if begun:
        yield from inserts(True)


class Repair:
    """``report``: a row for each conversation. ``rows()`` and ``digests()``: the repaired rows, or a hash of them."""

    def __init__(self, conversations: DataFrame, plan: DataFrame):
        self.source, self.plan = conversations, plan

    def _ordered(self, carry: list[str]) -> DataFrame:
        rows = self.source.filter("not gone").select("conv_id", F.lit(False).alias("head"), "role", "text", "turn", _digest().alias("digest"), *[F.lit(None).cast("long").alias(c) for c in carry])
        heads = self.plan.select("conv_id", F.lit(True).alias("head"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast(dict(self.source.dtypes)["turn"]).alias("turn"), F.lit(None).cast("binary").alias("digest"), *carry)
        both = heads.union(rows).repartition("conv_id")
        return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest")

    def rows(self) -> DataFrame:
        """(conv_id, place, edit, role, text) of the repaired conversations: K kept, R given another role, I inserted."""
        id_type = dict(self.source.dtypes)["conv_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            kind: list[pa.DataType] = []

            def typed() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    kind[:] = [batch.schema.field(0).type]
                    yield batch

            def made() -> pa.RecordBatch:
                kinds = [kind[0], pa.int64(), pa.string(), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], names=["conv_id", "place", "edit", "role", "text"])

            for head, *row in _edited(typed()):
                if head is None:
                    yield made()
                    out.clear()
                elif not head:
                    out.append(tuple(row))
            if out:
                yield made()

        ordered = self._ordered([]).select("conv_id", "head", "role", "text")
        return ordered.mapInArrow(run, f"conv_id {id_type}, place long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """The plan's columns and ``repaired_sha256``, of the lines ``role:text`` of each repaired conversation; texts are hashed as they come."""
        carry = [c for c, t in self.plan.dtypes if t == "bigint" and c != "conv_id"]
        id_type = dict(self.source.dtypes)["conv_id"]
        names = ["conv_id", "audit", *carry, "repaired_sha256"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads: list[pa.RecordBatch] = []
            hashes: list[str] = []
            current = None

            def seen() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    mask = batch.column(1)
                    heads.append(batch.filter(mask))
                    yield batch

            def made(n: int) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(heads).combine_chunks()
                part, rest = table.slice(0, n), table.slice(n)
                heads[:] = rest.to_batches()
                if n:
                    cols = [part.column(c).combine_chunks() for c in ("conv_id", "text", *carry)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(hashes[:n], pa.string())], names=names)
                    del hashes[:n]

            first = True
            for head, _, _, _, role, text in _edited(seen()):
                if head is None:
                    if hashes:
                        yield from made(len(hashes))
                elif head:
                    if current is not None:
                        hashes.append(current.hexdigest())
                    current, first = hashlib.sha256(), True
                else:
                    current.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
                    first = False
            if current is not None:
                hashes.append(current.hexdigest())
                yield from made(len(hashes))

        ordered = self._ordered(carry).select("conv_id", "head", "role", "text", *carry)
        longs = "".join(f", {c} long" for c in carry)
        return ordered.mapInArrow(run, f"conv_id {id_type}, audit string{longs}, repaired_sha256 string")


def repair(conversations: DataFrame) -> Repair:
    """Repair rows (conv_id, turn, role, text and perhaps ``gone``) at the least cost to conversations of the form (system)? (user assistant)+, or to nothing.

    Rows are taken by turn, nulls first, those of the same turn by role, then by a hash of role and text. A row's first fault counts: blank, a
    duplicate of an earlier row, truncated (it does not end in ``.``, ``!`` or ``?``). Keeping a row costs
    0, giving it the role that fits 2, deleting 3 (blank rows and duplicates have to go), inserting an empty row 2;
    a truncated row that stays costs 1 more. Of the cheapest repairs the one with the least letters in ASCII is
    taken (D, I, K, R). Rows marked as ``gone`` count for nothing but that their
    conversation is reported; roles go by their first letter. Null roles and texts are one space, a null conv_id is a
    conversation of its own. An empty table gives no rows.

    A conversation's signature has a byte for each row and lies in one row; texts pass in order and are never
    gathered.
    """
    bound_batches(conversations.sparkSession)
    if "gone" not in conversations.columns:
        conversations = conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone"))
    filled = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    found = materialize(diagnose(filled))
    planned = materialize(plan_repairs(found.groupBy("signature").agg(F.count("*").alias("many"))))
    plan = join_spread(found, planned, ["signature"], "many")
    return Repair(filled, plan.select("conv_id", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
