"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation is the string of its rows' signatures: what the row is by role
(s, u, a, other) and whether its text is whole, cut short, or to be deleted.
Distinct strings are dealt and sorted by their reversal, so strings with a
common end stand together, and minimised from the end: a node of the automaton
is one suffix, made once for all strings that end so.  A node has, for each
state of the grammar ``(s?(ua)+)?``, the least cost of repairing the rest and
the first edit of the best repair (edits of one state begin with different
letters, so the least letter settles ties).  Reading these edits from the start
gives the whole repair of a conversation; equal conversations share it.

The rows are dealt by range of (conversation, turn, role, text) and numbered in
that order, so a conversation of very many rows is spread over tasks; its
signature, a byte a row, is put together from pieces.  Only the hash of the
repaired text reads a conversation in one task, row by row in constant memory
besides its edits: SHA-256 is sequential.

Cases: null roles and texts count as one space, as do null ids and turns in the
damage's key; null turns stand first; null conv_ids are one conversation.  Rows
of equal turn stand by role, then text (as damaged); repeated rows stay.  A
role whose initial is not s, u or a (or that is empty) can't be kept.  Texts
are whole at any length.  A conversation all of whose rows are dropped has
zeros, an empty audit and the hash of the empty string.  An empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored, with_groups

KINDS, REROLE, DELETE, INSERT, CUT_SHORT = 20, 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an edit may put in from each state, and the state after it.
PUT = ("u", "u", "a", "u")
NEXT = tuple(STEP[s, r] for s, r in enumerate(PUT))
ENDLESS, LARGEST = 1 << 60, (1 << 63) - 1
#: A piece of a signature has two to this power rows at most.
PIECE_BITS = 16
DELETED = "x"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` deals."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.col("kind")
    marked = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % KINDS).alias("kind"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return marked.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): numbered by conversation, turn, role and text, a table in the shared folder."""
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    return stored(dealt.withColumn("at", F.monotonically_increasing_id()))


WHITE = " \t\n\x0b\x0c\r"


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault) of ordered rows; fault is blank, duplicate, truncated or null, whichever comes first."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = rows.select("conv_id", "turn", "at", "role", F.sha2(F.col("text"), 256).alias("same"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    before = F.row_number().over(Window.partitionBy("conv_id", "role", "same").orderBy("at"))
    fault = F.when(F.col("blank"), "blank").when(before > 1, "duplicate").when(~F.col("ended"), "truncated")
    initial = F.left("role", F.lit(1))
    return slim.select("conv_id", "turn", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))


def _pairs(initials: Column) -> Column:
    """How many neighbours of a string of initials follow the grammar."""
    return sum(((F.length(initials) - F.length(F.replace(initials, F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au")), F.lit(0)).cast("long")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of faults()."""
    fault = F.col("fault")
    sign = F.when(fault.isin("blank", "duplicate"), DELETED).when(fault == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    cells = rows.select("conv_id", "turn", "at", F.shiftright("at", PIECE_BITS).alias("piece"), "initial", "fault", sign.alias("sign"))
    many = {k: F.count_if(fault == k) for k in ("blank", "duplicate", "truncated")}
    # rows stand by turn, so only neighbouring pieces can share one
    pieces = cells.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "sign", "initial", "turn"))).alias("rows"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[c.alias(k) for k, c in many.items()])
    turns = F.size(F.array_compact(F.array_distinct("rows.turn")))
    pieces = pieces.select("conv_id", "piece", F.array_join("rows.sign", "").alias("signs"), F.array_join("rows.initial", "").alias("initials"), "low", "high", turns.alias("turns"), *many)
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "signs", "initials", "low", "high"))).alias("p"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *[F.sum(k).alias(k) for k in many])
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: (i > 1) & (F.get("p.low", i - 1) == F.get("p.high", i - 2))))
    width = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - (F.col("turns") - shared)
    initials = F.array_join("p.initials", "")
    return whole.select(
        "conv_id", F.when(F.col("low").isNull(), 0).otherwise(F.least(width, F.lit(LARGEST)).cast("long")).alias("gaps"), *many, (F.length(initials) - 1 - _pairs(initials)).alias("illegal"), F.array_join("p.signs", "").alias("signature")
    )


def node(sign: str, below: tuple) -> tuple:
    """The costs and first edits of a node for the four states, from those of the node after its row."""
    after, rest = below[0], []
    for state in range(4):
        found = [(DELETE + after[state], "D")]
        if sign != DELETED:
            more = CUT_SHORT if sign.isupper() else 0
            found.append((REROLE + more + after[NEXT[state]], "R"))
            if (to := STEP.get((state, sign.lower()))) is not None:
                found.append((more + after[to], "K"))
        rest.append(min(found))
    return _inserted(rest)


def _inserted(rest: list[tuple[int, str]]) -> tuple:
    """Insertions before the row: those of states 2 and 3 first, as 0 and 1 lead there."""
    two, three = rest[2], rest[3]
    rest[2], rest[3] = min(two, (INSERT + three[0], "I")), min(three, (INSERT + two[0], "I"))
    for state in (0, 1):
        rest[state] = min(rest[state], (INSERT + rest[2][0], "I"))
    return tuple(r[0] for r in rest), "".join(r[1] for r in rest)


#: After the last row; a blank stands where the grammar may end without an edit.
END = _inserted([(0, " "), (ENDLESS, "D"), (ENDLESS, "D"), (0, " ")])


def audit(signature: str, nodes: list[tuple]) -> str:
    """The best repair's edits; nodes by the number of rows that follow, the last one being the whole signature's."""
    at, state, edits = len(signature), 0, []
    while True:
        letter = nodes[at][1][state]
        if letter == " ":
            return "".join(edits)
        edits.append(letter)
        if letter == "K":
            state = STEP[state, signature[len(signature) - at].lower()]
        elif letter != "D":
            state = NEXT[state]
        at -= letter != "I"


def repairs(strings: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of distinct strings(signature, n)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, last = [END], ""  # nodes of the suffixes of the last string, shortest first
        for batch in batches:
            costs, audits = [], []
            for signature in batch.column("signature").to_pylist():
                turned = signature[::-1]
                same = 0
                while same < min(len(turned), len(last)) and turned[same] == last[same]:
                    same += 1
                del nodes[same + 1 :]
                for sign in turned[same:]:
                    nodes.append(node(sign, nodes[-1]))
                last = turned
                costs.append(nodes[-1][0][0])
                audits.append(audit(signature, nodes))
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("n"), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "n", "cost", "audit"])

    end = F.reverse("signature")
    dealt = strings.select("signature", "n").repartitionByRange(F.left(end, F.lit(32)), F.length("signature")).sortWithinPartitions(end)
    return dealt.mapInArrow(solve, "signature string, n long, cost long, audit string")


#: Texts that are Python strings at once.
TEXTS = 256


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            yield batch.slice(i, TEXTS)


def hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ordered rows and audits(conv_id, audit): an audit comes first among its conversation's rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = edits = made = None
        place = state = 0
        started, first = False, True

        def put(text: str) -> None:
            nonlocal first
            if not first:
                made.update(b"\n")
            made.update(text.encode())
            first = False

        def insertions() -> None:
            nonlocal place, state
            while place < len(edits) and edits[place] == "I":
                put("user:" if PUT[state] == "u" else "assistant:")
                state, place = NEXT[state], place + 1

        for batch in cut(batches):
            ids, found = [], []
            for conv, at, role, text, edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text", "audit")), strict=True):
                if at < 0:
                    if started:
                        insertions()
                        ids.append(own)
                        found.append(made.hexdigest())
                    started, own, edits, made, place, state, first = True, conv, edit, hashlib.sha256(), 0, 0, True
                    continue
                insertions()
                letter, place = edits[place], place + 1
                if letter == "K":
                    put(f"{role}:{text}")
                    state = STEP[state, role[0]]
                elif letter == "R":
                    put(f"{'user' if PUT[state] == 'u' else 'assistant'}:{text}")
                    state = NEXT[state]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(found)], ["conv_id", "repaired_sha256"])
        if started:
            insertions()
            yield pa.RecordBatch.from_arrays([pa.array([own], batch.schema.field("conv_id").type), pa.array([made.hexdigest()])], ["conv_id", "repaired_sha256"])

    none = F.lit(None).cast("string")
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), "audit")
    both = heads.unionByName(rows.select("conv_id", "at", "role", "text", none.alias("audit")))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(digest, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row a conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = ordered(damaged(conversations))
    found = stored(signatures(faults(rows)))
    solved = repairs(found.groupBy("signature").agg(F.count("*").alias("n")))
    edits = stored(with_groups(found, solved, "signature").drop("signature", "n"))
    texts = hashes(rows, edits.select("conv_id", "audit"))
    # each side through its alias: a null conv_id is a conversation
    whole = edits.alias("e").join(texts.alias("t"), F.col("e.conv_id").eqNullSafe(F.col("t.conv_id"))).select("e.*", "t.repaired_sha256")
    every = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rest = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return every.alias("c").join(whole.alias("w"), F.col("c.conv_id").eqNullSafe(F.col("w.conv_id")), "left").select(
        "c.conv_id", *[F.coalesce(f"w.{c}", F.lit(0)).cast("long").alias(c) for c in counts], *[F.coalesce(f"w.{c}", F.lit(v)).alias(c) for c, v in rest.items()]
    )
