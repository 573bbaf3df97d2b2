"""Conversation structure repair: weighted CYK interval parsing over the turns of a conversation.

Grammar. The roles of a repaired conversation are ``(s?(ua)+)?``. In Chomsky normal form its nonterminals are pairs [p, q] of states of that
language: 0 nothing yet, 1 after s, 2 after u, 3 after a. Binary rules are [p, q] -> [p, r] [r, q]; a turn is derived by [p, q] when keeping
it (K, 0) or giving it another role (R, 1) leads from p to q, and by [p, p] when it is deleted (D, 2; the only edit of blank and repeated turns); an
undeleted truncated turn costs 5 more. The empty span is derived by insertions (I, 5 each); they are closed over every leaf, before and after it.

Cells hold the least (cost, audit) of a span for every nonterminal. Among edits of one span with equal cost none is the beginning of
another (it would lack insertions only, which cost), so the least of two parts joined is the least of the whole. Cells are
combined bottom-up by span length over every split up to ``WHOLE`` turns; longer spans double, with one split each, since every split of a
span gives the same cell: the nonterminals name the states at its ends. A cell depends on the kinds of its turns alone and is kept by them.

In Spark, what a turn is (an initial, a fault, a digest of role and text) is shuffled by conversation without its text, and parsed; the audits
then meet the turns in one sorted shuffle and are played back turn by turn, so no task holds the texts of a conversation, however many
turns it has.

Nulls count as one space, in keys too; all rows with a null ``conv_id`` are one conversation. Turns are taken by turn, nulls first, and rows with the same turn
by role, then by a digest of their content, repeats side by side. A role without a legal initial (empty ones too) is never kept.
Each conversation gives one row even if damage leaves nothing of it; an empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import partitions

#: Turns up to which a conversation's spans are combined over every split; cells that a task keeps.
WHOLE, KEPT = 12, 1 << 17
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: (state, initial) to state; 0 and 3 end a conversation.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that comes next after each state.
NEXT = ("user", "user", "assistant", "user")
#: Ways through insertions alone: from, to, number of them.
WAYS = [(p, p, 0) for p in range(4)] + [(0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)]
_PAIRS = sorted({(p, q) for p, q, _ in WAYS} | {(0, 1)})
_RULES = [(p, r, q) for p, r in _PAIRS for r2, q in _PAIRS if r == r2]
_SPACE = "' \\t\\n\\u000b\\f\\r'"


def leaf(kind: str) -> dict:
    """The cell of one turn: its initial, in upper case if it is truncated; x for turns that have to go."""
    first = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        for (p, initial), q in STEPS.items():
            if initial == kind.lower():
                first[p, q] = min(first.get((p, q), (99, "")), (more, "K"))
            elif initial != "s":
                first[p, q] = min(first.get((p, q), (99, "")), (more + REROLE, "R"))
    cell = {}
    for p, r, n in WAYS:  # insertion closure on both sides
        for (r2, s), (cost, audit) in first.items():
            for s2, q, m in WAYS:
                if r == r2 and s == s2:
                    made = (cost + INSERT * (n + m), "I" * n + audit + "I" * m)
                    cell[p, q] = min(cell.get((p, q), made), made)
    return cell


def combine(left: dict, right: dict, cell: dict) -> dict:
    """``cell`` with what the binary rules make of the cells of two neighbouring spans."""
    for p, r, q in _RULES:
        a, b = left.get((p, r)), right.get((r, q))
        if a is None or b is None:
            continue
        cost, had = a[0] + b[0], cell.get((p, q))
        if had is None or cost < had[0]:
            cell[p, q] = (cost, a[1] + b[1])
        elif cost == had[0]:
            cell[p, q] = min(had, (cost, a[1] + b[1]))
    return cell


class Parser:
    """Repairs of sequences of kinds of turns; short spans are parsed once."""

    def __init__(self):
        self.cells: dict[str, dict] = {}

    def cell(self, kinds: str) -> dict:
        """The cell of a span of up to WHOLE turns, after those of all its shorter spans."""
        if kinds in self.cells:
            return self.cells[kinds]
        if len(self.cells) > KEPT:
            self.cells.clear()
        n = len(kinds)
        for length in range(1, n + 1):
            for i in range(n - length + 1):
                span = kinds[i : i + length]
                if span not in self.cells:
                    cell = leaf(span) if length == 1 else {}
                    for k in range(1, length):
                        combine(self.cells[span[:k]], self.cells[span[k:]], cell)
                    self.cells[span] = cell
        return self.cells[kinds]

    def repair(self, kinds: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, the ASCII-least of those."""
        if not kinds:
            return 0, ""
        row = [self.cell(kinds[i : i + WHOLE]) for i in range(0, len(kinds), WHOLE)]
        while len(row) > 1:  # spans of twice the length
            row = [combine(row[i], row[i + 1], {}) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return min(row[0][0, 0], row[0][0, 3])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) of every row: 0 times where it is dropped, 2 where it is repeated."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), times.alias("times"))


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` with ``initial``, ``fault`` (1 blank, 2 truncated) and ``digest``."""
    end = F.expr(f"trim(trailing {_SPACE} from text)")
    fault = F.when(F.length(end) == 0, 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    initial: Column = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.ascii("role")).otherwise(ord("o"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumns({"initial": initial.cast("int"), "fault": fault, "digest": digest})


def _changes(keys: pa.Array) -> np.ndarray:
    """Where, from the second row on, a key differs from the one before."""
    a, b = keys.slice(0, len(keys) - 1), keys.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return 1 + np.flatnonzero(differ.to_numpy(zero_copy_only=False))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations from batches sorted by conversation."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            joint = pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0).slice(0, 1)])
            if len(_changes(joint)):
                yield pa.Table.from_batches(held)
                held = []
        ends = _changes(batch.column(0))
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1])])
            held = []
        held.append(batch.slice(ends[-1] if len(ends) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, times, initial, fault, digest) in order to a row a conversation."""
    parser = Parser()
    legal = {(ord(x), ord(y)) for x, y in ("su", "ua", "au")}
    for table in _whole_groups(batches):
        table = table.combine_chunks()
        keys = table.column(0).chunk(0)
        first = np.concatenate([[0], _changes(keys)])
        groups = len(first)
        times = table.column(2).to_numpy()
        group = np.repeat(np.arange(groups), np.diff(np.append(first, len(times))))
        group, row = np.repeat(group, times), np.repeat(np.arange(len(times)), times)  # after damage
        turns = table.column(1).chunk(0)
        known = pc.is_valid(turns).to_numpy(zero_copy_only=False)[row]
        turn = pc.fill_null(turns, 0).to_numpy(zero_copy_only=False)[row]
        initial, fault = table.column(3).to_numpy()[row], table.column(4).to_numpy()[row]
        raw = table.column(5).chunk(0)
        digest = np.frombuffer(raw.buffers()[2], np.uint64)[4 * raw.offset : 4 * (raw.offset + len(raw))].reshape(-1, 4)[row, :2]
        order = np.lexsort((digest[:, 1], digest[:, 0], group))  # stable: the first of equal ones leads
        seen = np.zeros(len(row), bool)
        seen[order[1:]] = (digest[order[1:]] == digest[order[:-1]]).all(axis=1) & (group[order[1:]] == group[order[:-1]])
        blank, truncated = fault == 1, (fault == 2) & ~seen
        duplicate = seen & ~blank
        side = np.flatnonzero(group[1:] == group[:-1])
        bad = np.array([p not in legal for p in zip(initial[side].tolist(), initial[side + 1].tolist())], bool)
        tally = lambda which: np.bincount(group[which], minlength=groups)
        gaps, some = np.zeros(groups, np.int64), np.flatnonzero(known)
        if len(some):
            g, t = group[some], turn[some]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            last = np.append(at[1:], len(g)) - 1
            gaps[g[at]] = t[last] - t[at] + 1 - np.bincount(g[new], minlength=groups)[g[at]]
        kinds = np.where(blank | duplicate, ord("x"), np.where(truncated, initial - 32, initial)).astype(np.uint8).tobytes().decode("ascii")
        ends = np.searchsorted(group, np.arange(groups + 1)).tolist()
        repairs = [parser.repair(kinds[i:j]) for i, j in zip(ends, ends[1:])]
        longs = [gaps, tally(blank), tally(duplicate), tally(truncated), tally(side[bad]), np.array([c for c, _ in repairs], np.int64)]
        columns = [keys.take(pa.array(first)), *(pa.array(x, pa.int64()) for x in longs), pa.array([a for _, a in repairs], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", *FIGURES, "audit"])


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FIGURES = ", ".join(f"{c} long" for c in FIGURES) + ", audit string"


def parse(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``rows`` of ``damaged``."""
    light = _told(rows).select("conv_id", "turn", "times", "initial", "fault", "digest", "role")
    dealt = light.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.drop("role").mapInArrow(_parse, f"conv_id {kind}, {_FIGURES}")


def _play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's row of ``parse`` and then its turns, in order, to that row (at 0) and the repaired turns after it."""
    audit, body, spot, state, at = "", 0, 0, 0, 0
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("kind", "times", "role", "text", "audit")}
        source, ats, edits, roles, texts = [], [], [], [], []

        def put(i: int, edit: str, role: str, text: str) -> None:
            nonlocal at, state
            at, state = at + 1, STEPS[state, role[:1]]
            for column, value in ((source, i), (ats, at), (edits, edit), (roles, role), (texts, text)):
                column.append(value)

        for i, (kind, times, role, text, told) in enumerate(zip(*columns.values())):
            if kind == 0:
                audit, body, spot, state, at = told, len(told.rstrip("I")), 0, 0, 0
                for column, value in ((source, i), (ats, 0), (edits, None), (roles, None), (texts, None)):
                    column.append(value)
            for turn in range(times):
                while audit[spot] == "I":
                    put(i, "I", NEXT[state], "")
                    spot += 1
                if audit[spot] == "K":
                    put(i, "K", role, text)
                elif audit[spot] == "R":
                    put(i, "R", NEXT[state], text)
                spot += 1
            while body <= spot < len(audit):  # what is inserted at the end
                put(i, "I", NEXT[state], "")
                spot += 1
        took = batch.take(pa.array(source, pa.int64()))
        own = pa.array(ats, pa.int32())
        figures = [pc.if_else(pc.equal(own, 0), took.column(c), pa.scalar(None, took.column(c).type)) for c in (*FIGURES, "audit")]
        yield pa.RecordBatch.from_arrays([took.column("conv_id"), own, pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), *figures], ["conv_id", "at", "edit", "role", "text", *FIGURES, "audit"])


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text, the columns of ``parse``): for every conversation of ``rows`` of ``damaged`` a row at 0 with what ``parse`` tells
    of it, and its repaired turns from 1 on, with the edit that made each. The rows of a conversation lie side by side, in order."""
    turns = _told(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "times", "text")
    heads = parse(rows).withColumns({"kind": F.lit(0), "times": F.lit(0)})
    both = heads.unionByName(turns, allowMissingColumns=True)
    dealt = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.drop("turn", "digest").mapInArrow(_play, f"conv_id {kind}, at int, edit string, role string, text string, {_FIGURES}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``repaired`` to a row a conversation with the hash of its ``role:text`` lines, taken line by line."""
    head, made = None, None
    for batch in batches:
        done = []
        for i, (at, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "role", "text")))):
            if at == 0:
                if made is not None:
                    done.append((head, made.hexdigest()))
                head, made = batch.slice(i, 1).select(["conv_id", *FIGURES, "audit"]), hashlib.sha256()
            else:
                made.update(f"{'' if at == 1 else chr(10)}{role}:{text}".encode())
        yield from _closed(done)
    if made is not None:
        yield from _closed([(head, made.hexdigest())])


def _closed(done: list) -> Iterator[pa.RecordBatch]:
    if done:
        table = pa.Table.from_batches([x for x, _ in done]).append_column("repaired_sha256", pa.array([x for _, x in done], pa.string()))
        yield from table.combine_chunks().to_batches()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: faults and the cheapest repair of every conversation, after the damage that its keys fix."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return repaired(rows).mapInArrow(_digests, f"conv_id {kind}, {_FIGURES}, repaired_sha256 string")
