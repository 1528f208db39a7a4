"""Conversation structure repair by divide and conquer over four-state cost vectors.

A conversation's role initials should read ``(s?(ua)+)?``.  The edits keep a turn (0), give
it the role user or assistant (2), delete it (3, required for blank and repeated turns) or
insert an empty user or assistant turn anywhere (2); a truncated turn that stays adds 1.  Of
the cheapest edits those whose initials are least in ASCII order are taken.

The four states are: nothing yet, after a system turn, after a user, after an assistant.
A turn is a 4 x 4 table of the cheapest way (inserts, then one edit of the turn) from state
to state.  Hirschberg's method finds the path without a table of all turns: the forward
vector over the first half and the backward vector over the second meet in the middle, the
best crossing state is chosen, and both halves are solved alike.  Inserts belong to the
turn that follows, so two ways to reach a crossing both end with the edit of the same turn:
neither can be the beginning of the other, and carrying along the order of the four ways
next to their costs decides ties between crossings without spelling the ways out.

A conversation may be of any length.  All rows are sorted in range partitions by
conversation and turn, so a long conversation is cut into segments, one in each partition.
A segment is held as one letter for each turn.  For conversations with several segments
each segment is summed up as one 4 x 4 table of costs and orders, the same method runs over
these tables (as many as there are partitions), and every segment is then solved by itself
between its own two states.  Only a digest of a whole conversation is sequential by nature: it is
taken from sorted rows as they stream by, holding one hash.

Defined cases: turns are ordered by turn (nulls first), role and digest of the text; a null
role or text is one space; a null conversation id is a conversation of its own; repeated
rows are repeated turns; conversations without rows after damage are summed up as empty; no
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import BLANKS, plain_names
from tidemark.workspace import Workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 50
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
#: Inserts that lead from a state to an accepted end (nothing, or after an assistant).
TO_END = {START: "", SYSTEM: "ij", USER: "j", ASSISTANT: ""}
#: Moves: K keep, R / r rerole to user / assistant, D delete, i / j insert a user / assistant turn.
AUDIT = str.maketrans("rij", "RII")


def turn_codes(initial: Column, doomed: Column, truncated: Column) -> Column:
    """One letter for a turn: its role initial (o: another), as a digit if it must go, capital if truncated."""
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(doomed, F.translate(letter, "suao", "1234")).when(truncated, F.upper(letter)).otherwise(letter)


def role_of(code: str) -> str:
    return {"1": "s", "2": "u", "3": "a", "4": "o"}.get(code, code.lower())


def edits_of(code: str, state: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, move) of every edit of a turn in a state."""
    yield state, DELETE, "D"
    if code in "1234":
        return
    more, role = TRUNCATED if code.isupper() else 0, role_of(code)
    if state == USER:
        yield ASSISTANT, REROLE + more, "r"
        if role == "a":
            yield ASSISTANT, KEEP + more, "K"
        return
    yield USER, REROLE + more, "R"
    if role == "u":
        yield USER, KEEP + more, "K"
    if role == "s" and state == START:
        yield SYSTEM, KEEP + more, "K"


class Block:
    """Cheapest ways through one turn, or through a run of turns, from state to state.

    ``cost[s][t]``, and ``order[s][t]``: the place of that way among the ways from ``s``.
    """

    def __init__(self, cost, order, moves=None):
        self.cost, self.order, self.moves = cost, order, moves


@lru_cache(None)
def block_of(code: str) -> Block:
    """The ways through one turn: up to two inserts before it (more come back to a state), then its edit."""
    found: list[dict] = [{} for _ in STATES]
    for s in STATES:
        at, inserted = s, ""
        for _ in range(3):
            for t, cost, move in edits_of(code, at):
                moves = inserted + move
                way = (cost + INSERT * len(inserted), moves.translate(AUDIT), moves)
                found[s][t] = min(found[s].get(t, way), way)
            at, inserted = (ASSISTANT, inserted + "j") if at == USER else (USER, inserted + "i")
    order = [sorted(ways, key=lambda t, ways=ways: ways[t][1]) for ways in found]
    return Block([[found[s][t][0] if t in found[s] else FAR for t in STATES] for s in STATES],
                 [[order[s].index(t) if t in found[s] else 0 for t in STATES] for s in STATES],
                 [[found[s][t][2] if t in found[s] else "" for t in STATES] for s in STATES])


def forward(blocks: list[Block], low: int, high: int, state: int):
    """Cost of each state after ``blocks[low:high]``, and the order of the ways that reach them."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[state] = 0
    for block in blocks[low:high]:
        best = [min((cost[s] + block.cost[s][t], rank[s], block.order[s][t]) for s in STATES) for t in STATES]
        cost = [min(FAR, b[0]) for b in best]
        for place, t in enumerate(sorted(STATES, key=lambda t: best[t][1:])):
            rank[t] = place
    return cost, rank


def backward(blocks: list[Block], low: int, high: int, state: int):
    """Cost from each state through ``blocks[low:high]`` to ``state``."""
    cost = [FAR] * 4
    cost[state] = 0
    for block in reversed(blocks[low:high]):
        cost = [min(FAR, min(block.cost[s][t] + cost[t] for t in STATES)) for s in STATES]
    return cost


def last_state(blocks: list[Block], state: int = START) -> int:
    """The state after all turns from which the cheapest, ASCII-least way ends."""
    cost, rank = forward(blocks, 0, len(blocks), state)
    # A way that still needs inserts has them behind its last edit, so ranks decide first.
    return min(STATES, key=lambda c: (cost[c] + INSERT * len(TO_END[c]), rank[c]))


def crossings(blocks: list[Block], state: int, end: int) -> list[int]:
    """The states before each block, and ``end``, of the best way from ``state`` to ``end``."""
    found = [state] * len(blocks) + [end]
    todo = [(0, len(blocks))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        cost, rank = forward(blocks, low, middle, found[low])
        rest = backward(blocks, middle, high, found[high])
        found[middle] = min(STATES, key=lambda c: (cost[c] + rest[c], rank[c]))
        todo += [(low, middle), (middle, high)]
    return found


def summed(blocks: list[Block]) -> Block:
    """One block for a run of turns."""
    rows = [forward(blocks, 0, len(blocks), s) for s in STATES]
    return Block([r[0] for r in rows], [r[1] for r in rows])


@lru_cache(50_000)
def solved(codes: str, state: int, end: int | None) -> tuple[str, int]:
    """Moves and cost of the best way; ``end`` None: to an accepted end, its inserts included."""
    blocks = [block_of(c) for c in codes]
    last = last_state(blocks, state) if end is None else end
    states = crossings(blocks, state, last)
    steps = list(zip(blocks, states, states[1:], strict=False))
    moves = "".join(b.moves[s][t] for b, s, t in steps)
    cost = sum(b.cost[s][t] for b, s, t in steps)
    return (moves + TO_END[last], cost + INSERT * len(TO_END[last])) if end is None else (moves, cost)


def illegal_pairs(codes: str) -> int:
    roles = [role_of(c) for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by the checksum of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = plain_names(rows, "conv_id", "turn", "role", "text").withColumn("_fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)
    fault, text = F.col("_fault"), part("text")
    return rows.where("_fault != 0").select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(part("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame, space: Workspace) -> DataFrame:
    """The rows in order: ``at`` rises through all conversations, ``seg`` is the range partition.

    The last sort key spreads rows that are equal in all others over partitions.
    """
    keyed = plain_names(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie")).withColumn("digest", F.md5("text"))
    keys = ["conv_id", "turn", "role", "digest", "tie"]
    # Runs right after the sort, in the same stage: numbers follow the order of the rows.
    return space.stage(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn(
        "at", F.monotonically_increasing_id()), "ordered")


def judged(rows: DataFrame) -> DataFrame:
    """The ordered rows with ``seg code blank duplicate truncated``; the first fault of a row counts."""
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = seen.select(*[F.col(c).alias(f"s_{c}") for c in ("conv_id", "role", "digest")], "first")
    rows = rows.join(seen, rows["conv_id"].eqNullSafe(seen["s_conv_id"]) & (rows["role"] == seen["s_role"])
                     & (rows["digest"] == seen["s_digest"]), "left")
    words = F.btrim("text", F.lit(BLANKS))
    blank = F.length(words) == 0
    duplicate = ~blank & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = ~blank & ~duplicate & ~F.right(words, F.lit(1)).isin(".", "!", "?")
    return rows.select("conv_id", "turn", "at", F.shiftright("at", 33).alias("seg"), blank.alias("blank"), duplicate.alias("duplicate"),
                       truncated.alias("truncated"), turn_codes(F.left("role", F.lit(1)), blank | duplicate, truncated).alias("code"))


def segments(faults: DataFrame) -> DataFrame:
    """``conv_id seg start codes blank duplicate truncated``: the part of a conversation in one partition."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return faults.groupBy("conv_id", "seg").agg(
        F.min("at").alias("start"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "").alias("codes"),
        count("blank"), count("duplicate"), count("truncated"))


def placed(parts: DataFrame) -> DataFrame:
    """``conv_id seg state end before``: where each segment of a conversation with several starts and ends.

    ``end`` is null for the last one; ``before`` is the last letter of the segment before.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    many = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_id"))
    open_parts = parts.join(many, parts["conv_id"].eqNullSafe(many["_id"]), "left_semi").select("conv_id", "seg", "codes")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [summed([block_of(c) for c in codes.as_py()]) for codes in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([codes.as_py()[-1] for codes in batch.column(2)], pa.string()),
                pa.array([sum(b.cost, []) for b in blocks], pa.list_(pa.int64())),
                pa.array([sum(b.order, []) for b in blocks], pa.list_(pa.int32()))], names=["conv_id", "seg", "last", "cost", "rank"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        fold = lambda flat: [flat[i:i + 4] for i in range(0, 16, 4)]
        blocks = [Block(fold(c), fold(r)) for c, r in zip(table.column("cost").to_pylist(), table.column("rank").to_pylist(), strict=True)]
        states = crossings(blocks, START, last_state(blocks))
        return pa.table({"conv_id": table.column("conv_id"), "seg": table.column("seg"), "state": pa.array(states[:-1], pa.int32()),
                         "end": pa.array([*states[1:-1], None], pa.int32()), "before": pa.array([None, *table.column("last").to_pylist()[:-1]], pa.string())})

    sums = open_parts.mapInArrow(tables, f"conv_id {kind}, seg long, last string, cost array<long>, rank array<int>")
    return sums.groupBy("conv_id").applyInArrow(meet, f"conv_id {kind}, seg long, state int, end int, before string")


def edited(parts: DataFrame, space: Workspace) -> DataFrame:
    """The segments with ``moves cost illegal``."""
    places = space.stage(placed(parts), "placed").withColumnsRenamed({"conv_id": "_id", "seg": "_seg"})
    joined = parts.join(places, parts["conv_id"].eqNullSafe(places["_id"]) & (parts["seg"] == places["_seg"]), "left").drop("_id", "_seg")
    kind = parts.schema["conv_id"].dataType.simpleString()
    sums = ("blank", "duplicate", "truncated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            ways = [solved(codes, START, None) if state is None else solved(codes, state, end)
                    for codes, state, end in zip(col["codes"], col["state"], col["end"], strict=True)]
            illegal = [illegal_pairs((before or "") + codes) for before, codes in zip(col["before"], col["codes"], strict=True)]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "seg", "start", *sums)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([w[0] for w in ways], pa.string()), pa.array([w[1] for w in ways], pa.int64()), pa.array(illegal, pa.int64())],
                names=["conv_id", "seg", "start", *sums, "moves", "cost", "illegal"])

    return space.stage(joined.mapInArrow(
        run, f"conv_id {kind}, seg long, start long, {', '.join(f'{c} long' for c in sums)}, moves string, cost long, illegal long"), "edited")


def new_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id at k role text move`` of the repaired conversations, in the order of (at, k)."""
    steps = edits.select("conv_id", "start", F.regexp_extract_all("moves", F.lit("[ij]*[KRrD]"), 0).alias("steps"),
                         F.regexp_extract("moves", "[ij]*$", 0).alias("rest"))
    each = steps.select("start", F.posexplode("steps").alias("i", "step")).select((F.col("start") + F.col("i")).alias("at"), "step")
    # ``at`` is unique on both sides.
    own = rows.join(each, "at").select("conv_id", "at", "role", "text", "step")
    end = steps.where("rest != ''").select("conv_id", (F.col("start") + F.size("steps")).alias("at"), F.lit("").alias("role"),
                                           F.lit("").alias("text"), F.col("rest").alias("step"))
    # Behind the last turn of a partition comes no other turn with that number in this conversation.
    moved = own.withColumn("late", F.lit(0)).unionAll(end.withColumn("late", F.lit(1))).select(
        "conv_id", "at", "late", "role", "text", F.posexplode(F.split("step", "")).alias("k", "move")).where("move NOT IN ('', 'D')")
    role = F.when(F.col("move").isin("R", "i"), "user").when(F.col("move").isin("r", "j"), "assistant").otherwise(F.col("role"))
    return moved.select("conv_id", "at", (F.col("late") * 1000 + F.col("k")).alias("k"), role.alias("role"),
                        F.when(F.col("move").isin("i", "j"), "").otherwise(F.col("text")).alias("text"), "move")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id sha`` of the turns' ``role:text`` lines, streamed in order with one hash held at a time."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([owner], key_type), pa.array([own.hexdigest()], pa.string())], names=["conv_id", "sha"])

        owner = own = key_type = None
        for batch in batches:
            key_type, done = batch.column(0).type, []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or key != owner:
                    if own is not None:
                        done.append((owner, own.hexdigest()))
                    owner, own = key, hashlib.sha256()
                else:
                    own.update(b"\n")
                own.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha"])
        if own is not None:
            yield row()

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return lines.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(run, f"conv_id {kind}, sha string")


def repair(rows: DataFrame, space: Workspace | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns of the repaired conversations, edits of each segment, the rows in order)."""
    space = space or Workspace(rows.sparkSession)
    lined = ordered(rows, space)
    edits = edited(space.stage(segments(judged(lined)), "segments"), space)
    return new_turns(lined, edits), edits, lined


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (by default those of ``rows``): faults, cheapest edits and the repaired digest."""
    space = Workspace(rows.sparkSession)
    turns, edits, lined = repair(rows, space)
    every = plain_names(rows if ids is None else ids, "conv_id").distinct()
    counts = edits.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "moves"))), lambda r: r["moves"]), "").alias("moves"))
    spans = lined.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    out = every
    for side in (counts, spans, digests(turns)):
        side = side.withColumnRenamed("conv_id", "_id")
        out = out.join(side, out["conv_id"].eqNullSafe(side["_id"]), "left").drop("_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.translate(F.coalesce("moves", F.lit("")), "rij", "RII").alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_structure_repair(conversations: DataFrame) -> DataFrame:
    return repair_report(damaged(conversations), conversations)


def _oracle() -> str:
    """Suffix by suffix: for each state the cheapest, ASCII-least edits of the remaining turns."""
    item = lambda c, a, r: f"{{'c': {c}, 'a': {a}, 'r': {r}}}"
    after = lambda f, cost, letter, line: item(f"{f}.c + {cost}", f"'{letter}' || {f}.a", f"{line} || {f}.r")
    line = lambda role: f"{role} || ':' || text || chr(10)"
    new = {"u": "'user:' || chr(10)", "a": "'assistant:' || chr(10)"}

    def edit(state):
        choices = [after(f"f{state}", 3, "D", "''")]
        to, role = (3, "'assistant'") if state == 2 else (2, "'user'")
        choices.append(f"CASE WHEN NOT doomed THEN {after(f'f{to}', '2 + cut', 'R', line(role))} END")
        keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
        choices += [f"CASE WHEN NOT doomed AND left(role, 1) = '{i}' THEN {after(f'f{t}', 'cut', 'K', line('role'))} END" for i, t in keeps]
        return f"list_sort(list_filter([{', '.join(choices)}], lambda x: x IS NOT NULL))[1] AS g{state}"

    def best(state):
        ways = [f"g{state}", after("g3", 2, "I", new["a"]) if state == 2 else after("g2", 2, "I", new["u"])]
        if state != 2:
            ways.append(after("g3", 4, "II", f"{new['u']} || {new['a']}"))
        return f"list_sort([{', '.join(ways)}])[1]"

    ends = [item("CAST(0 AS BIGINT)", "''", "''"), item("CAST(4 AS BIGINT)", "'II'", f"{new['u']} || {new['a']}"),
            item("CAST(2 AS BIGINT)", "'I'", new["a"]), item("CAST(0 AS BIGINT)", "''", "''")]
    return rf"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
named AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS h FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM named WHERE h <> 0),
lined AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
seen AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM lined),
rows AS (SELECT *, blank OR again AS doomed, NOT blank AND again AS duplicate,
    NOT blank AND NOT again AND regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS truncated FROM seen),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
walk AS (SELECT conv_id, n + 1 AS i, {', '.join(f'{e} AS f{s}' for s, e in enumerate(ends))} FROM told UNION ALL
    SELECT conv_id, i, {', '.join(best(s) for s in STATES)} FROM (
        SELECT conv_id, i, {', '.join(edit(s) for s in STATES)} FROM (
            SELECT x.conv_id, x.i, x.role, x.text, x.doomed, CASE WHEN x.truncated THEN 1 ELSE 0 END AS cut, f0, f1, f2, f3
            FROM walk JOIN rows x ON x.conv_id IS NOT DISTINCT FROM walk.conv_id AND x.i = walk.i - 1))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit,
    sha256(CASE WHEN coalesce(f0.r, '') = '' THEN '' ELSE f0.r[:-2] END) AS repaired_sha256
FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM ids.conv_id AND walk.i = 1
"""


ORACLE_SQL = _oracle()
