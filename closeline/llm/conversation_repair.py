"""Repair of the turn structure of conversations at least cost, by prefix-doubling path ranking.

A conversation's rows stand in the order of their turns (nulls first, equal turns by role, the
first `HEAD` characters of the text and its hash).  A row's first fault counts: blank (no character but white space), duplicate (role and
text of an earlier row) or truncated (it does not end in a full stop, exclamation or question
mark).  Rows are kept (cost 0), reroled to user or assistant (3), deleted (4, the only edit of a
blank or duplicate row), and empty user or assistant rows inserted (3), so that the initials of
the roles read `(s?(ua)+)?`; a truncated row that stays costs 3 more.  Of the cheapest lists of
edits the one whose initials (D, I, K, R) are least in ASCII is taken.

A node is a place in the conversation and a state of the pattern, an arc an edit.  After the
cost-to-go of all nodes is known, only arcs that lie on a cheapest path are left.  Each is
followed by the arc with the least letter that leaves its end; the letters of a node's arcs
differ, so no two are equal.  Arcs are ranked by their edits' first letter, then 2, 4, 8, ...
letters, each time by the pair of an arc's rank and the rank of the arc its pointer, doubled
every time, leads to.  Ranks tell the best arc of every node, and the pointers list the path.

Places are dealt into blocks of `BLOCK` rows, so that no task needs a whole conversation.  What
a block costs from state to state is a matrix; the matrices of a conversation's blocks are
multiplied, in the arithmetic of sums and least values, by doubling, which gives each block the
cost-to-go behind it; where its least path leads from state to state is composed the same way.
Only SHA-256 and the audit, one value for a conversation, see its rows one after another: they
are sorted by Spark and read as a stream, of which nothing but the audit is held.

Edge rows: null roles and texts are one space, so such a row is blank; roles of other initials
can only be reroled or deleted; null turns count for no gap; a null conv_id is a conversation.
A conversation without rows, known from `ids`, needs no edit.  Empty tables give the `ids` alone;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closeline.llm.common import checkpointed, joined
from closeline.llm.numbering import numbered

#: Rows of a conversation in one block.
BLOCK = 1024
#: Characters by which texts of one turn and role are ordered.
HEAD = 64
#: Rows times longest block that are solved together.
CHUNK = 1 << 16

#: States of the pattern: nothing yet, after `s`, after `u`, after `a`.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
OTHER = len(INITIALS)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: A row's code is 4 * fault + initial; `END` stands behind the last row, `PAD` before the first.
END, PAD = 16, 17
#: Edits that use up a row, by the ASCII order of their letters, which come with the insertion between.
DELETE, KEEP, REROLE = range(3)
LETTERS = np.array([1, 3, 4])
STOP, INSERT_LETTER = 0, 2
REROLE_COST = INSERT_COST = TRUNCATED_COST = 3
DELETE_COST = 4
FAR = 1 << 40
#: The state that one more user or assistant row leads to.
NEXT = np.array([USER, USER, ASSISTANT, USER])


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of the edits of a row, by code, edit and state."""
    cost = np.full((PAD + 1, 3, 4), FAR, dtype=np.int64)
    to = np.broadcast_to(np.arange(4), cost.shape).copy()
    for code in range(END):
        fault, initial = divmod(code, 4)
        cost[code, DELETE] = DELETE_COST
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        cost[code, REROLE], to[code, REROLE] = REROLE_COST + extra, NEXT
        for state in range(4):
            if initial < OTHER and (INITIALS[initial] == "ua"[NEXT[state] - USER] or (state, initial) == (START, 0)):
                cost[code, KEEP, state] = extra
                to[code, KEEP, state] = NEXT[state] if initial else SYSTEM
    # The conversation may end before its first row and after an assistant's.
    cost[END, KEEP, [START, ASSISTANT]] = 0
    return cost, to


COST, TO = _steps()


def costs_to_go(codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs by place, block and state, and the costs of a row's edits by place, block, edit and state.

    `codes` has a block in every row, filled up with `PAD` in front; `after` the costs behind it.
    """
    blocks, width = codes.shape
    least = np.empty((width + 1, blocks, 4), dtype=np.int64)
    edits = np.empty((width, blocks, 3, 4), dtype=np.int64)
    least[width] = after
    for place in range(width - 1, -1, -1):
        code = codes[:, place]
        behind = np.take_along_axis(least[place + 1][:, None, :], TO[code].reshape(blocks, 1, 12), axis=2)
        edits[place] = np.minimum(COST[code] + behind.reshape(blocks, 3, 4), FAR)
        here = edits[place].min(axis=1)
        once = INSERT_COST + here[:, NEXT]
        twice = 2 * INSERT_COST + here[:, NEXT[NEXT]]
        least[place] = np.minimum(np.minimum(here, once), np.minimum(twice, FAR))
    return least, edits


class Paths:
    """The least paths of blocks through their optimal arcs."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, after: np.ndarray):
        self.blocks, self.width = codes.shape
        self.least, edits = costs_to_go(codes, after)
        self.first = (self.width - lengths) * self.blocks + np.arange(self.blocks)
        self._arcs(codes, edits)
        self._rank()

    def _arcs(self, codes: np.ndarray, edits: np.ndarray) -> None:
        nodes = np.arange(self.least.size).reshape(self.least.shape)
        real = (codes != PAD).T
        parts = []
        for edit in (DELETE, KEEP, REROLE):
            at = np.nonzero(real[:, :, None] & (edits[:, :, edit] == self.least[:-1]))
            code, to = codes.T[at[0], at[1]], TO[codes.T[at[0], at[1]], edit, at[2]]
            letter = np.where(code == END, STOP, LETTERS[edit])
            parts.append((nodes[at], letter, nodes[at[0] + 1, at[1], to], to))
        inserted = self.least[:-1, :, NEXT] + INSERT_COST == self.least[:-1]
        at = np.nonzero(real[:, :, None] & inserted)
        parts.append((nodes[at], np.full(len(at[0]), INSERT_LETTER), nodes[at[0], at[1], NEXT[at[2]]], NEXT[at[2]]))
        # Behind a block every state has an arc that leads to itself and has no letter.
        ends = nodes[-1].ravel()
        parts.append((ends, np.full(len(ends), STOP), ends, ends % 4))
        self.source, self.letter, self.target, self.state = (np.concatenate(p) for p in zip(*parts))

    def _best(self, ranks: np.ndarray) -> np.ndarray:
        """The arc of least rank of every node, -1 where it has none."""
        order = np.lexsort((ranks, self.source))
        nodes, firsts = np.unique(self.source[order], return_index=True)
        best = np.full(self.least.size, -1)
        best[nodes] = order[firsts]
        return best

    def _rank(self) -> None:
        ranks, pointer = self.letter, self._best(self.letter)[self.target]
        self.pointers = [pointer]
        # An edit for every row, up to two insertions before each, and the end.
        while 1 << len(self.pointers) < 3 * self.width + 1:
            _, ranks = np.unique(ranks * (ranks.max() + 1) + ranks[pointer], return_inverse=True)
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        self.best = self._best(ranks)

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs of the blocks' least paths from the states `entry`, one block in a row; the states they end in)."""
        arcs = self.best[self.first * 4 + entry][:, None]
        for pointer in self.pointers:
            arcs = np.concatenate([arcs, pointer[arcs]], axis=1)
        return arcs, self.state[arcs[:, -1]]

    def plans(self, entry: np.ndarray) -> list[str]:
        """Edits in order: K, D, u or a for a row reroled to that initial, U or A for one inserted."""
        arcs, _ = self.paths(entry)
        signs = np.array(list("?DIKR"))[self.letter[arcs]]
        user = self.state[arcs] == USER
        for letter, names in (("I", "UA"), ("R", "ua")):
            signs = np.where(signs == letter, np.where(user, *names), signs)
        return ["".join(row).replace("?", "") for row in signs]


def chunks(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, codes filled up in front, lengths) of blocks of like lengths."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(lengths, kind="stable")
    while len(order):
        n = max(1, int(np.searchsorted(lengths[order] * np.arange(1, len(order) + 1), CHUNK)))
        index, order = order[:n], order[n:]
        width = lengths[index[-1]]
        filled = np.full((n, width), PAD)
        for row, i in enumerate(index):
            filled[row, width - lengths[i] :] = codes[i]
        yield index, filled, lengths[index]


def row_codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(c, dtype=np.int64) for c in batch.column("codes").to_pylist()]


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every block costs from state to state, row by row."""
    units = np.where(np.eye(4, dtype=bool), 0, FAR)
    for batch in batches:
        out = np.empty((batch.num_rows, 4, 4), dtype=np.int64)
        for index, codes, lengths in chunks(row_codes(batch)):
            at = codes.shape[1] - lengths
            for state in range(4):
                least, _ = costs_to_go(codes, np.broadcast_to(units[state], (len(index), 4)))
                out[index, :, state] = least[at, np.arange(len(index))]
        yield pa.record_batch([batch.column("conv_id"), batch.column("block"), pa.array(list(out.reshape(-1, 16)))], ["conv_id", "block", "m"])


def _exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind every block, for each state before it."""
    for batch in batches:
        after = np.array(batch.column("after").to_pylist(), dtype=np.int64).reshape(-1, 4)
        out = np.empty((batch.num_rows, 4), dtype=np.int64)
        for index, codes, lengths in chunks(row_codes(batch)):
            least_paths = Paths(codes, lengths, after[index])
            for state in range(4):
                out[index, state] = least_paths.paths(np.full(len(index), state))[1]
        yield pa.record_batch([batch.column("conv_id"), batch.column("block"), pa.array(list(out))], ["conv_id", "block", "m"])


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plan and cost of every block; the cost is that of the conversation, at its first block."""
    for batch in batches:
        after = np.array(batch.column("after").to_pylist(), dtype=np.int64).reshape(-1, 4)
        entry = batch.column("entry").to_numpy()
        plans, costs = np.empty(batch.num_rows, dtype=object), np.zeros(batch.num_rows, dtype=np.int64)
        for index, codes, lengths in chunks(row_codes(batch)):
            least_paths = Paths(codes, lengths, after[index])
            plans[index] = least_paths.plans(entry[index])
            costs[index] = least_paths.least.reshape(-1, 4)[least_paths.first, entry[index]]
        costs[batch.column("block").to_numpy() > 0] = 0
        yield pa.record_batch([*(batch.column(c) for c in STATED), pa.array(plans, pa.string()), pa.array(costs)], [*STATED, "plan", "cost"])


#: What is counted of a block beside its edits.
COUNTED = ["blank", "duplicate", "truncated", "illegal", "turns"]
STATED = ["conv_id", "block", *COUNTED, "low", "high"]


def fault_codes(rows: DataFrame) -> DataFrame:
    """(conv_id, place, n_rows, turn, code) of the `rows` (conv_id, place, n_rows, turn, role, text)."""
    said = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256)
    own = rows.select("conv_id", "place", "n_rows", "turn", F.left("role", F.lit(1)).alias("initial"), "text", said.alias("said"))
    firsts = own.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("conv_id", "place", F.lit(True).alias("is_first"))
    initial = F.expr(f"CASE initial {' '.join(f'WHEN {c!r} THEN {i}' for i, c in enumerate(INITIALS))} ELSE {OTHER} END")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    row_fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    kept = own.select("conv_id", "place", "n_rows", "turn", initial.alias("initial"), row_fault.alias("fault"))
    found = joined(kept, firsts, ["conv_id", "place"], "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return found.select("conv_id", "place", "n_rows", "turn", (4 * fault + F.col("initial")).alias("code"))


def blocks_of(coded: DataFrame, block: int) -> DataFrame:
    """A row per block: its codes (`END` behind the last row), its counts and the number of blocks.

    The first row of a block also stands behind the block before, where it ends the last pair
    of neighbours; so a block has at most `block` + 1 rows.
    """
    own = F.expr(f"place div {block}")
    both = F.when((F.col("place") % block == 0) & (F.col("place") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    cells = F.sort_array(F.collect_list(F.struct("place", "code", "turn"))).alias("cells")
    rows = coded.withColumn("block", F.explode(both)).groupBy("conv_id", "block", "n_rows").agg(cells)
    rows = rows.withColumn("own", F.expr(f"slice(cells, 1, cast(least({block}, n_rows - block * {block}) AS int))"))
    pairs = "zip_with(slice(cells, 1, size(cells) - 1), slice(cells, 2, size(cells)), (a, b) -> a.code % 4 * 10 + b.code % 4)"
    changes = (
        "size(filter(own, (c, i) -> c.turn IS NOT NULL AND "
        "(i + 1 >= size(cells) OR NOT c.turn <=> cells[i + 1].turn)))"
    )
    s, u, a = range(OTHER)
    legal = ", ".join(str(10 * x + y) for x, y in ((s, u), (u, a), (a, u)))
    faults = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
    counts = [f"cast(size(filter(own, c -> c.code div 4 = {fault})) AS long) AS {name}" for name, fault in faults.items()]
    n_blocks = f"(n_rows + {block - 1}) div {block}"
    return rows.selectExpr(
        "conv_id",
        "block",
        f"{n_blocks} AS n_blocks",
        f"concat(own.code, CASE WHEN block + 1 = {n_blocks} THEN array({END}) ELSE array() END) AS codes",
        *counts,
        f"cast(size(filter({pairs}, p -> p NOT IN ({legal}))) AS long) AS illegal",
        f"cast({changes} AS long) AS turns",
        "array_min(own.turn) AS low",
        "array_max(own.turn) AS high",
    )


def scanned(parts: DataFrame, n_blocks: int, step: int, body: str) -> DataFrame:
    """The products of `parts` (conv_id, block, m) with all behind (`step` 1) or before (-1) in their conversation.

    Each round `body` joins m with `other`, the product that begins where m ends, so the number
    of blocks taken together doubles.
    """
    reach = 1
    while reach < n_blocks:
        there = parts.select("conv_id", (F.col("block") - step * reach).alias("block"), F.col("m").alias("other"))
        both = joined(parts, there, ["conv_id", "block"], "left")
        parts = checkpointed(both.selectExpr("conv_id", "block", f"CASE WHEN other IS NULL THEN m ELSE {body} END AS m"))
        reach *= 2
    return parts


def bounded(blocks: DataFrame, conv_type: str) -> DataFrame:
    """`blocks` with the costs `after` them and the state, `entry`, in which the least path enters them."""
    alone = blocks.where("n_blocks = 1").withColumn("after", F.expr("array(0L, 0L, 0L, 0L)")).withColumn("entry", F.lit(0))
    most = blocks.agg(F.max("n_blocks")).first()[0] or 0
    if most <= 1:
        return alone
    several = blocks.where("n_blocks > 1")
    schema = f"conv_id {conv_type}, block long, m array<long>"
    inner = "array_min(transform(sequence(0, 3), j -> m[c div 4 * 4 + j] + other[j * 4 + c % 4]))"
    product = f"transform(sequence(0, 15), c -> least({inner}, {FAR}L))"
    behind = scanned(checkpointed(several.mapInArrow(_matrices, schema)), most, 1, product)
    behind = behind.selectExpr("conv_id", "block - 1 AS block", "transform(sequence(0, 3), p -> array_min(slice(m, p * 4 + 1, 4))) AS after")
    several = joined(several, behind, ["conv_id", "block"], "left")
    several = checkpointed(several.withColumn("after", F.expr("coalesce(after, array(0L, 0L, 0L, 0L))")))
    before = scanned(checkpointed(several.mapInArrow(_exits, schema)), most, -1, "transform(other, p -> m[cast(p AS int)])")
    before = before.selectExpr("conv_id", "block + 1 AS block", "cast(m[0] AS int) AS entry")
    return alone.unionByName(joined(several, before, ["conv_id", "block"], "left").na.fill(0, ["entry"]))


#: Kinds of rows in the stream of a conversation: itself, a block's plan, a row.
ITSELF, PLAN, ROW = range(3)
ROLES = {"u": "user", "a": "assistant"}


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) for every edit in order, and (conv_id, None, counts, None) behind a conversation.

    `batches` holds, conversation by conversation, itself, and before the rows of each block its plan.
    """
    conv, counts, plan = None, None, iter("")

    def ended():
        for edit in plan:
            yield conv, "I", ROLES[edit.lower()], ""
        yield conv, None, counts, None

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "plan", "role", "text", "cost", *STATED[2:])]
        for conv_id, kind, block_plan, role, text, cost, *stated in zip(*columns):
            if kind == ITSELF:
                if counts is not None:
                    yield from ended()
                conv, counts, plan = conv_id, {"cost": 0, **dict.fromkeys(COUNTED, 0), "low": None, "high": None}, iter("")
            elif kind == PLAN:
                plan = iter(block_plan)
                counts["cost"] += cost
                for name, n in zip(COUNTED, stated):
                    counts[name] += n
                low, high = stated[len(COUNTED) :]
                if low is not None:
                    counts["low"], counts["high"] = low if counts["low"] is None else counts["low"], high
            else:
                for edit in plan:
                    if edit.islower():
                        yield conv, "R", ROLES[edit], text
                    elif edit in "KD":
                        yield conv, edit, role, text
                    else:
                        yield conv, "I", ROLES[edit.lower()], ""
                        continue
                    break
    if counts is not None:
        yield from ended()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gaps", *COUNTED[:-1], "cost"]
    out: list[tuple] = []
    audit, hashed, lead = [], hashlib.sha256(), b""
    ids = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        convs, *rest = zip(*rows)
        numbers = [pa.array(c, pa.int64()) for c in rest[: len(names)]]
        texts = [pa.array(c, pa.string()) for c in rest[len(names) :]]
        return pa.record_batch([pa.array(convs, ids), *numbers, *texts], ["conv_id", *names, "audit", "repaired_sha256"])

    def typed(source):
        nonlocal ids
        for batch in source:
            ids = batch.column("conv_id").type
            yield batch

    for conv, edit, role, text in _edited(typed(batches)):
        if edit is None:
            gaps = 0 if role["low"] is None else role["high"] - role["low"] + 1 - role["turns"]
            out.append((conv, gaps, *(role[n] for n in names[1:]), "".join(audit), hashed.hexdigest()))
            audit, hashed, lead = [], hashlib.sha256(), b""
            if len(out) == 1000:
                yield batch_of(out)
                out = []
            continue
        audit.append(edit)
        if edit != "D":
            hashed.update(lead + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            lead = b"\n"
    if out:
        yield batch_of(out)


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def typed(source):
        nonlocal ids
        for batch in source:
            ids = batch.column("conv_id").type
            yield batch

    ids, place, out = None, 0, []
    for conv, edit, role, text in _edited(typed(batches)):
        if edit is None:
            place = 0
        elif edit != "D":
            out.append((conv, place, edit, role, text))
            place += 1
        if len(out) == 1000:
            yield _line_batch(out, ids)
            out = []
    if out:
        yield _line_batch(out, ids)


def _line_batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    types = [ids, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "place", "edit", "role", "text"])


def stream(rows: DataFrame, ids: DataFrame | None, block: int) -> DataFrame:
    """Conversations, plans and rows, each conversation's together in one task and in order."""
    rows = rows.selectExpr("conv_id", "cast(turn AS long) AS turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text")
    rows = rows.withColumn("_head", F.left("text", F.lit(HEAD))).withColumn("_hash", F.xxhash64("text"))
    placed = numbered(rows, "conv_id", ["turn", "role", "_head", "_hash"], ["text"]).drop("_head", "_hash")
    blocks = checkpointed(blocks_of(fault_codes(placed), block))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    stated = ", ".join(f"{c} long" for c in STATED[2:])
    plans = bounded(blocks, conv_type).mapInArrow(_solved, f"conv_id {conv_type}, block long, {stated}, plan string, cost long")
    known = (rows if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))).select("conv_id").distinct()

    def part(df: DataFrame, kind: int, place: Column) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).withColumn("place", place)

    parts = part(known, ITSELF, F.lit(-1).cast("long"))
    parts = parts.unionByName(part(plans, PLAN, F.col("block") * block).drop("block"), allowMissingColumns=True)
    own = placed.select("conv_id", "place", "role", "text")
    parts = parts.unionByName(part(own, ROW, F.col("place")), allowMissingColumns=True)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")


def repaired(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations; `edit` is K, R or I."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return stream(rows, ids, block).mapInArrow(_lines, f"conv_id {conv_type}, place long, edit string, role string, text string")


def digested(rows: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """A row per conversation of `rows` (conv_id, turn, role, text) and `ids` (conv_id): faults, cost, audit and digest."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", *COUNTED[:-1], "cost"))
    return stream(rows, ids, block).mapInArrow(_digests, f"conv_id {conv_type}, {counts}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with faults by the CRC-32 of their id and turn, modulo 20.

    0 drops a row, 1 empties it, 2 takes its closing marks, 3 repeats it, 4 gives it to the user.
    Nulls are one space, in the CRC too.
    """
    spaced = [f"coalesce(cast({c} AS string), ' ')" for c in ("conv_id", "turn")]
    marked = rows.selectExpr("conv_id", "cast(turn AS long) AS turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text", f"crc32(concat_ws(':', {', '.join(spaced)})) % 20 AS _fault")
    return marked.where("_fault <> 0").selectExpr(
        "conv_id",
        "turn",
        "CASE WHEN _fault = 4 THEN 'user' ELSE role END AS role",
        "CASE _fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(array_repeat(0, CASE WHEN _fault = 3 THEN 2 ELSE 1 END)) AS _copy",
    ).drop("_copy")
