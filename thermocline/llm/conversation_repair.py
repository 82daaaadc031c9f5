"""Repair of conversation structure by a suffix-shared automaton (DAWG) over role and fault signatures.

A conversation's signature has one letter a row: what its first fault and its role let an edit do. Signatures are read from the end. A node of the automaton
stands for all suffixes that have the same cost-to-go and the same best next edit in each state of the grammar; it is made once, whatever
the number of conversations that share it. Costs only matter up to a constant, so equal nodes meet again and their number is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import stored

# Edit costs, edit initials in ASCII order, and the characters that end a sentence.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SENTENCE_ENDS = ".!?"
# States of the grammar (s?(ua)+)?: nothing read, system read, user read, assistant read. Role initials lead from one to another.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
# Letters of a signature: a row that must go; else the role initial, or o for any other, upper case if the row is truncated.
GONE = "x"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 removes sentence ends, 3 repeats, 4 sets role user.

    A null is one space wherever it is read as text.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat_ws(":", read[0], read[1])) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(read[3], "[.!?]", "")).otherwise(read[3])
    return rows.where(fate != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(read[2]).alias("role"), text.alias("text"),
        F.when(fate == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )


def _last_mark() -> Column:
    """The last character of the text that is no white space; none in a blank text."""
    return F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def faulty(rows: DataFrame) -> DataFrame:
    """One row for each different (conv_id, turn, role, text): its number of ``times``, first fault and role initial, without the text.

    ``again`` says that the same role and text stand at an earlier turn; the other ``times`` of a row are duplicates of its first.
    """
    told = rows.select("conv_id", "turn", "role", "times", F.md5(F.concat_ws("\0", "role", "text")).alias("said"), _last_mark().alias("mark"))
    met = stored(told.groupBy("conv_id", "turn", "role", "said", "mark").agg(F.sum("times").alias("times")), "repair-rows")
    earliest = met.groupBy("conv_id", "role", "said").agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("m.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("m.role") == F.col("e.role")) & (F.col("m.said") == F.col("e.said"))
    both = met.alias("m").join(earliest.alias("e"), same)
    mark = F.col("mark")
    return both.select(
        "m.conv_id", "turn", "m.role", "m.said", "times", (mark == "").alias("blank"), (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"),
        ((mark != "") & ~mark.isin(*SENTENCE_ENDS)).alias("cut"), F.substring("m.role", 1, 1).alias("initial"),
    )


SIGNED = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: rows in the order of conversation, turn, role and text's hash become one row a conversation. One byte a row is held, no text."""
    now: dict | None = None

    def row() -> dict:
        turns = now["turns"]
        gaps = now["last"] - now["least"] + 1 - turns if turns else 0
        return {
            "conv_id": now["conv_id"], "signature": now["letters"].decode(), "gaps": min(gaps, np.iinfo(np.int64).max),
            **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal")},
        }

    done: list[dict] = []
    schema = pa.schema([
        ("conv_id", pa.int64()), ("signature", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    ])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "times", "blank", "again", "cut", "initial")]
        for conv, turn, times, blank, again, cut, initial in zip(*columns):
            if now is None or conv != now["conv_id"]:
                if now is not None:
                    done.append(row())
                now = {
                    "conv_id": conv, "letters": bytearray(), "turns": 0, "least": None, "last": None, "before": None,
                    "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                }
            if turn is not None and turn != now["last"]:
                now["least"] = turn if now["least"] is None else now["least"]
                now["last"], now["turns"] = turn, now["turns"] + 1
            legal = ("su", "ua", "au")
            if now["before"] is not None:
                now["illegal"] += now["before"] + initial not in legal
            now["illegal"] += (times - 1) * (initial + initial not in legal)
            now["before"] = initial
            letter = initial if initial in ("s", "u", "a") else "o"
            if blank:
                now["blank"] += times
            else:
                now["duplicate"] += times - (not again)
                now["truncated"] += cut and not again
            if not blank and not again:
                now["letters"] += (letter.upper() if cut else letter).encode()
                times -= 1
            now["letters"] += GONE.encode() * times
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


class Automaton:
    """Nodes read from the end. Node 0 is the empty suffix; ``before(letter, node)`` is the node with one more letter in front.

    A node holds for each grammar state its cost-to-go less the least of them, the order of its best audit suffix among the four, and
    the edits up to and including the next row. Nodes that agree in all are one.
    """

    def __init__(self):
        self.base: list[int] = []  # what a node's least cost adds to that of the node after it
        self.costs: list[tuple] = []
        self.ranks: list[tuple] = []
        self.edits: list[tuple] = []  # a state: initials, state after them
        self._known: dict[tuple, int] = {}
        self._arcs: dict[tuple[str, int], int] = {}
        self._node({START: (0, (), ("", START)), ASSISTANT: (0, (), ("", ASSISTANT))})

    @staticmethod
    def _row_edits(letter: str, state: int) -> list[tuple[int, str, int]]:
        """Cost, initial and next state of the edits of one row."""
        found = [(DELETE, "D", state)]
        if letter == GONE:
            return found
        more = TRUNCATED if letter.isupper() else 0
        kept = MOVES.get((state, letter.lower()))
        if kept is not None:
            found.append((KEEP + more, "K", kept))
        found += [(REROLE + more, "R", to) for (s, initial), to in MOVES.items() if s == state and initial in NAMES]
        return found

    def _node(self, direct: dict[int, tuple]) -> int:
        """The node whose states reach the rest by ``direct`` (cost, order of the audit, edits), insertions added in front."""
        best: dict[int, tuple] = {}
        inserts = {s: to for (s, initial), to in MOVES.items() if initial in NAMES}
        for state in range(4):
            options, at = [], state
            for inserted in range(4):
                if at in direct:
                    cost, order, (initial, after) = direct[at]
                    options.append((inserted * INSERT + cost, ("I",) * inserted + order, ("I" * inserted + initial, after)))
                at = inserts[at]
            best[state] = min(options)
        orders = sorted({best[s][1] for s in range(4)})
        least = min(best[s][0] for s in range(4))
        costs = tuple(best[s][0] - least for s in range(4))
        ranks = tuple(orders.index(best[s][1]) for s in range(4))
        edits = tuple(best[s][2] for s in range(4))
        key = (costs, ranks, edits, least)
        if key not in self._known:
            self._known[key] = len(self.base)
            for held, value in zip((self.base, self.costs, self.ranks, self.edits), (least, costs, ranks, edits)):
                held.append(value)
        return self._known[key]

    def before(self, letter: str, node: int) -> int:
        arc = (letter, node)
        if arc not in self._arcs:
            direct = {}
            for state in range(4):
                direct[state] = min(
                    (cost + self.costs[node][to], (initial, self.ranks[node][to]), (initial, to))
                    for cost, initial, to in self._row_edits(letter, state)
                )
            self._arcs[arc] = self._node(direct)
        return self._arcs[arc]


REPAIRED = "signature string, cost long, audit string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: cost and audit of each signature. Signatures come in the order of their reversed letters, so the nodes of the suffix that two
    neighbours share stay on the path and only the letters in front of it are walked."""
    automaton = Automaton()
    path, total, last = [0], [automaton.base[0]], ""
    for batch in batches:
        costs, audits = [], []
        signatures = batch.column("signature").to_pylist()
        for signature in signatures:
            backwards = signature[::-1]
            shared = 0
            for x, y in zip(backwards, last):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], total[shared + 1 :]
            for letter in backwards[shared:]:
                path.append(automaton.before(letter, path[-1]))
                total.append(total[-1] + automaton.base[path[-1]])
            last, state, audit = backwards, START, []
            costs.append(total[-1] + automaton.costs[path[-1]][START])
            for node in reversed(path):
                edits, state = automaton.edits[node][state]
                audit.append(edits)
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"]
        )


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """``signature``, ``cost`` and ``audit`` of each different signature, dealt out by ranges of the reversed letters."""
    turned = signatures.select("signature").distinct().withColumn("_turned", F.reverse("signature"))
    return turned.repartitionByRange("_turned").sortWithinPartitions("_turned").select("signature").mapInArrow(_repaired, REPAIRED)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the SHA-256 of each repaired conversation. Its rows come in order behind a row with its audit, and pass by one after the other."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    digest, first, state, at, audit, conv = None, True, START, 0, "", None
    last_row: tuple | None = None

    def write(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def insert() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            initial = "a" if state == USER else "u"
            write(NAMES[initial], "")
            state, at = MOVES[state, initial], at + 1

    for batch in batches:
        done = []
        for conv_id, found, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times"))):
            if found is not None:
                if digest is not None:
                    insert()
                    done.append((conv, digest.hexdigest()))
                digest, first, state, at, audit, conv = hashlib.sha256(), True, START, 0, found, conv_id
                continue
            for _ in range(times):
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    initial = "a" if state == USER else "u"
                    write(NAMES[initial], text)
                else:
                    initial = role[:1]
                    write(role, text)
                state = MOVES[state, initial]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], schema=schema)
    if digest is not None:
        insert()
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)


def repair(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of each ``conv_id`` of ``originals``; ``rows`` are those after damage.

    ``rows`` has conv_id, turn, role, text and ``times`` (how often the row stands there). Rows are taken by turn, nulls first, then by role and a hash of the text.
    All rows without a conv_id are one conversation. Conversations without rows have zeros, an empty audit and the digest of nothing. An empty role
    cannot be kept. A conversation's signature and audit, a byte a row, are held by one task, since the audit is one value; its texts pass by
    in order and are never held.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    marked = faulty(rows)
    signed = stored(
        marked.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)
        .select("conv_id", "turn", "times", "blank", "again", "cut", "initial").mapInArrow(_signed, SIGNED),
        "repair-signed",
    )
    edits = stored(cheapest_edits(signed), "repair-edits")
    judged = stored(signed.join(edits, "signature").drop("signature"), "repair-judged")
    said = F.md5(F.concat_ws("\0", "role", "text"))
    none = F.lit(None).cast("string")
    parts = rows.select(
        "conv_id", F.lit(1).alias("_kind"), "turn", "role", said.alias("said"), "text", "times", none.alias("audit")
    ).unionByName(
        judged.select(
            "conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("said"), none.alias("text"),
            F.lit(0).alias("times"), "audit",
        )
    )
    digests = (
        parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_kind", *order)
        .select("conv_id", "audit", "role", "text", "times").mapInArrow(_apply, "conv_id long, repaired_sha256 string")
    )
    found = judged.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    ids = originals.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage and repair of ``conversations`` (conv_id, turn, role, text). Nulls are one space, ties are set by role and a hash of the text, repeated rows
    are duplicates, an empty table gives no row, and further columns are not read."""
    return repair(damaged(conversations), conversations)
