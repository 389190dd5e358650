"""Repair of conversation structure by a Viterbi decoder with coalescing survivors.

The rows of a conversation, by turn, become a conversation of the form ``(system? (user assistant)+)?`` at
the least cost of edits.  Four states say what stands at the end of the repaired text; each keeps its
cheapest edits so far (its survivor) as a path in a tree of backpointers.  A branch whose reference count
falls to zero is freed, and as soon as all survivors share an ancestor the edits up to it are final and
leave the task, so that a task holds the unresolved rows of one conversation and none of its texts.

Ties between edits of equal cost go to the ASCII-least list of edits.  Two survivors are told apart by all
their unresolved edits: each step keeps the rank of every survivor among the others.  Neither of two such
lists can begin with the other, since all of them end with the edit of the same row, so ranks stay valid
however far back the first difference lies.

Rows travel in three streams.  Small rows without text (with the first occurrence of each role and text)
are decoded; then edits and texts are dealt by conversation and meet in one sorted pass.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BLANKS, kept_table, ready

# fixed values: costs of the edits
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
START, SYSTEM, USER, ASSISTANT = range(4)
# what may follow: the state after a role that begins with the letter
STEPS = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
WHOLE = (START, ASSISTANT)  # states in which a conversation may end
ROLES = {"u": "user", "a": "assistant"}
KIND_FIRST, KIND_ROW, KIND_GONE = 0, 1, 2
BATCH = 4096


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults by crc32 of ``conv_id:turn``: conv_id, turn, role, text, gone.

    Nulls read as one space, but conv_id and turn keep theirs.  Of every 20 values one drops the row
    (``gone``), one empties the text, one removes ``.!?``, one repeats the row, one sets the role to user.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with digest of the text and the faults that show in the text alone."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(F.length(body) == 0, "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    role = F.coalesce(F.col("role"), F.lit(" "))
    return rows.select("conv_id", "turn", role.alias("role"), F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"), "text")


class _Node:
    """Edits of one row on a path: inserted roles, then the edit of the row."""

    __slots__ = ("parent", "kids", "inserted", "edit", "role")

    def __init__(self, parent, inserted="", edit="", role=None):
        self.parent, self.inserted, self.edit, self.role = parent, inserted, edit, role
        self.kids: list[_Node] = []


def _insertions() -> list[list[tuple[str, int]]]:
    """For every state the insertions that lead to other states: (letters, state)."""
    out = []
    for state in range(4):
        found, now, letters = [("", state)], state, ""
        while True:
            letter = "u" if (now, "u") in STEPS else "a"
            now, letters = STEPS[now, letter], letters + letter
            if now in [s for _, s in found]:
                break
            found.append((letters, now))
        out.append(found)
    return out


INSERTIONS = _insertions()


def _hopeless(best: dict[int, tuple]) -> list[int]:
    """States whose survivor costs more than another with all that the other would have to add.

    What may follow a complete pair may follow a system row too; what may follow nothing as well, but for
    a kept system row, which is deleted then.  An open question takes one inserted answer first, and an
    inserted question leads from a complete pair to an open question.
    """
    added = {
        (ASSISTANT, SYSTEM): 0, (ASSISTANT, START): DELETE_COST, (ASSISTANT, USER): INSERT_COST, (USER, ASSISTANT): INSERT_COST,
        (USER, SYSTEM): INSERT_COST, (USER, START): INSERT_COST + DELETE_COST,
    }
    return [x for x in best if any(y in best and best[y][0] + more < best[x][0] for (y, to), more in added.items() if to == x)]


class Decoder:
    """Cheapest edits of one conversation, row by row; ``step`` and ``finish`` give those that are final.

    A final edit is (row, inserted letters, edit, new role); rows are whatever ``step`` was given.
    """

    def __init__(self):
        self.root = _Node(None)
        # state -> (cost, rank among the survivors, node)
        self.live: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self.root)}
        self.waiting: deque = deque()

    def step(self, row, role: str, fault: str | None) -> list[tuple]:
        must_go = fault in ("blank", "duplicate")
        stay = TRUNCATED_COST if fault == "truncated" else 0
        letter, best = role[:1], {}

        def offer(state, cost, rank, edits, made):
            if state not in best or (cost, rank, edits) < best[state][:3]:
                best[state] = (cost, rank, edits, made)

        for before, (cost, rank, node) in self.live.items():
            for inserted, state in INSERTIONS[before]:
                paid, marks = cost + INSERT_COST * len(inserted), "I" * len(inserted)
                offer(state, paid + DELETE_COST, rank, marks + "D", (node, inserted, "D", None))
                if must_go:
                    continue
                if (state, letter) in STEPS:
                    offer(STEPS[state, letter], paid + stay, rank, marks + "K", (node, inserted, "K", role))
                needed = "u" if (state, "u") in STEPS else "a"
                offer(STEPS[state, needed], paid + stay + REROLE_COST, rank, marks + "R", (node, inserted, "R", ROLES[needed]))

        for state in _hopeless(best):
            del best[state]
        self.waiting.append(row)
        old = [node for _, _, node in self.live.values()]
        self.live = {}
        for place, state in enumerate(sorted(best, key=lambda s: best[s][1:3])):
            cost, _, _, (parent, inserted, edit, new_role) = best[state]
            node = _Node(parent, inserted, edit, new_role)
            parent.kids.append(node)
            self.live[state] = (cost, place, node)
        for node in old:
            while not node.kids and node.parent is not None:
                node.parent.kids.remove(node)
                node = node.parent
        final, last = [], {id(n) for _, _, n in self.live.values()}
        while len(self.root.kids) == 1 and id(self.root) not in last:
            self.root = self.root.kids[0]
            self.root.parent = None
            final.append((self.waiting.popleft(), self.root.inserted, self.root.edit, self.root.role))
        return final

    def finish(self) -> tuple[list[tuple], str, int]:
        """Remaining edits, letters inserted behind the last row, and the cost of all edits."""
        ends = [
            (cost + INSERT_COST * len(inserted), rank, "I" * len(inserted), inserted, node)
            for before, (cost, rank, node) in self.live.items()
            for inserted, state in INSERTIONS[before]
            if state in WHOLE
        ]
        cost, _, _, inserted, node = min(ends, key=lambda e: e[:3])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return [(self.waiting.popleft(), n.inserted, n.edit, n.role) for n in reversed(path)], inserted, cost


class _Columns:
    """Rows gathered to record batches of a fixed schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= BATCH

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


COUNT_FIELDS = [(c, pa.int64()) for c in COUNTS]
PLAN = [
    ("conv_id", None), ("last", pa.bool_()), ("turn", None), ("role", pa.string()), ("digest", pa.binary()), ("nth", pa.int64()),
    ("inserted", pa.string()), ("edit", pa.string()), ("new_role", pa.string()), *COUNT_FIELDS,
]
TURNS = [
    ("conv_id", None), ("position", pa.int64()), ("edit", pa.string()), ("turn", None), ("role", pa.string()), ("text", pa.string()),
    *COUNT_FIELDS,
]
AUDIT = [("conv_id", None), *COUNT_FIELDS, ("audit", pa.string()), ("repaired_sha256", pa.string())]
SQL_TYPES = {pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.int64(): "long"}


def _schema(columns: list, like: pa.Schema) -> pa.Schema:
    return pa.schema([(n, t if t is not None else like.field(n).type) for n, t in columns])


def _ddl(columns: list, like: DataFrame) -> str:
    return ", ".join(f"{n} {SQL_TYPES[t] if t is not None else like.schema[n].dataType.simpleString()}" for n, t in columns)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of sorted small rows, and a last row per conversation with its counts."""
    out, now, begun = None, None, False
    none = (None,) * len(COUNTS)

    def emit(final):
        for (turn, role, digest, nth), inserted, edit, new_role in final:
            out.add(now, False, turn, role, digest, nth, inserted, edit, new_role, *none)

    def close():
        final, inserted, cost = decoder.finish()
        emit(final)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        out.add(now, True, None, None, None, None, inserted, None, None, gaps, *counts.values(), illegal, cost)

    for batch in batches:
        out = out or _Columns(_schema(PLAN, batch.schema))
        for conv_id, turn, role, digest, fault, kind in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if not begun or conv_id != now:
                if begun:
                    close()
                now, begun, decoder = conv_id, True, Decoder()
                counts, illegal, turns = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
                first, before, key, nth = None, None, None, 0
            if kind == KIND_GONE:
                continue
            if kind == KIND_FIRST:
                first = (turn, role, digest)
                continue
            nth = nth + 1 if key == (turn, role, digest) else 0
            key = (turn, role, digest)
            if first == key:
                first = None
            elif fault != "blank":
                fault = "duplicate"
            if fault:
                counts[fault] += 1
            if before is not None and before[:1] + role[:1] not in LEGAL:
                illegal += 1
            before = role
            if turn is not None:
                # sorted: a turn is new when it differs from the last one
                turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
            emit(decoder.step((turn, role, digest, nth), role, fault))
            if out.full():
                yield from out.taken()
    if begun:
        close()
        yield from out.taken()


def edit_plan(rows: DataFrame) -> DataFrame:
    """The cheapest edits of damaged rows (conv_id, turn, role, text, gone), without their texts."""
    marked = _marked(rows.where(~F.col("gone")))
    small = marked.drop("text")
    # of equal role and text the first row is no duplicate; null turns come first
    firsts = small.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("turn"), F.bool_or(F.col("turn").isNull()).alias("none"))
    no_fault = F.lit(None).cast("string").alias("fault")
    none_first = F.when(~F.col("none"), F.col("turn")).alias("turn")
    first_rows = firsts.select("conv_id", none_first, "role", "digest", no_fault, F.lit(KIND_FIRST).alias("kind"))
    kinds = small.withColumn("kind", F.lit(KIND_ROW)).unionByName(first_rows)
    nothing = F.lit(None)
    gone = rows.where("gone").select(
        "conv_id",
        nothing.cast(rows.schema["turn"].dataType).alias("turn"),
        nothing.cast("string").alias("role"),
        nothing.cast("binary").alias("digest"),
        no_fault,
        F.lit(KIND_GONE).alias("kind"),
    )
    dealt = kinds.unionByName(gone).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")
    return ready(dealt).mapInArrow(_decode, _ddl(PLAN, rows))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, begun, now, text, position = None, False, None, None, 0
    none = (None,) * len(COUNTS)
    for batch in batches:
        out = out or _Columns(_schema(TURNS, batch.schema))
        names = ("conv_id", "is_edit", "turn", "role", "text", "inserted", "edit", "new_role", "last")
        counts = zip(*(batch.column(c).to_pylist() for c in COUNTS), strict=True)
        rows = zip(*(batch.column(c).to_pylist() for c in names), counts, strict=True)
        for conv_id, is_edit, turn, role, body, inserted, edit, new_role, last, summary in rows:
            if not begun or conv_id != now:
                now, begun, position = conv_id, True, 0
            if not is_edit:
                text = body
                continue
            for letter in inserted:
                out.add(conv_id, position, "I", None, ROLES[letter], "", *none)
                position += 1
            if last:
                out.add(conv_id, position, None, None, None, None, *summary)
            elif edit == "D":
                out.add(conv_id, position, edit, turn, role, None, *none)
            else:
                out.add(conv_id, position, edit, turn, new_role, text, *none)
            position += 1
            if out.full():
                yield from out.taken()
    if out:
        yield from out.taken()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """Edits and repaired rows in order, and one closing row per conversation with its counts.

    ``rows`` has conv_id, turn, role, text, gone; further columns are not read.  Every row gives one of
    K (kept), R (role changed) or D (deleted, text null); I is an inserted row.  The closing row has a null
    edit and gaps, blank, duplicate, truncated, illegal and cost.  A conversation whose rows are all gone
    has only the closing row, with zeros; an empty table gives no rows.

    Rows are ordered by turn (null first); rows of one turn by role and digest of the text.  Nulls in role
    or text read as one space.  A role without letters fits nowhere.  A null conv_id is a conversation.
    The rows of one conversation pass one task as a stream, since its text is hashed as one.
    """
    rows = rows.withColumns({"text": F.coalesce(F.col("text"), F.lit(" ")), "gone": F.coalesce(F.col("gone"), F.lit(False))})
    plan = kept_table(edit_plan(rows), "edits")
    texts = _marked(rows.where(~F.col("gone"))).where("fault IS NULL OR fault <> 'blank'").drop("fault")
    both = texts.withColumns({"is_edit": F.lit(False), "last": F.lit(False)}).unionByName(
        plan.withColumn("is_edit", F.lit(True)), allowMissingColumns=True
    )
    order = ("conv_id", "last", "turn", "role", "digest", "is_edit", "nth")
    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_apply, _ddl(TURNS, rows))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, marks, sha, some = None, bytearray(), hashlib.sha256(), False
    for batch in batches:
        out = out or _Columns(_schema(AUDIT, batch.schema))
        counts = zip(*(batch.column(c).to_pylist() for c in COUNTS), strict=True)
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")), counts, strict=True)
        for conv_id, edit, role, text, summary in rows:
            if edit is None:
                out.add(conv_id, *summary, marks.decode(), sha.hexdigest())
                marks, sha, some = bytearray(), hashlib.sha256(), False
                continue
            marks += edit.encode()
            if edit != "D":
                sha.update((f"\n{role}:" if some else f"{role}:").encode())
                sha.update(text.encode())
                some = True
        yield from out.taken()


def repair_audit(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired_turns``: the counts, the edits, the hash of the repaired text.

    Reads the rows where and as they lie, so ``turns`` must come straight from ``repaired_turns``.
    """
    return turns.mapInArrow(_audit, _ddl(AUDIT, turns))
