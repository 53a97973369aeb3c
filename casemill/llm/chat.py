"""Chat formatting: repair of turn roles at least cost, then rendering.

Legal conversations are an automaton over the role of the last turn: an optional system turn, then user and
assistant in turns, the assistant last. A turn may keep its role, take another one, or merge into the turn
before; empty turns may be put in. Costs of a turn form a 4 x 4 matrix over the automaton's states, and
stretches of a conversation combine by (min, +) products. So a conversation may be cut anywhere: tasks multiply
the matrices of the stretch they hold, the driver joins two stretches a task into entry and exit states, and
tasks trace the cheapest path between them. Of equally cheap paths the one is taken that prefers keeping over
relabelling over merging at the latest turn where they differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import settled

ROLES = ("system", "user", "assistant")
STATES = (None, *ROLES)
FOLLOWS = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
NAME_UNKNOWN, MERGE, RELABEL, INSERT = 1, 2, 3, 4  # costs
FAR = 1 << 40
SORTED = "part int, pos long, kind string, conv_id long, turn long, role string, mark long, segment array<long>"
DECIDED = "of_conv long, of_turn long, of_role string, of_mark long, place long, out_role string, action string, inserted_before array<string>, inserted_after array<string>, opens boolean, first boolean, last boolean"


def _inserts(state, role) -> tuple | None:
    """The fewest empty turns after which ``role`` may follow ``state``; None if it never may."""
    paths, seen = [(state, ())], {state}
    for at, path in paths:
        if role in FOLLOWS[at]:
            return path
        for step in FOLLOWS[at]:
            # An empty system turn is never put in.
            if step != "system" and step not in seen:
                seen.add(step)
                paths.append((step, (*path, step)))
    return None


def steps(role) -> tuple:
    """[from state][to state] of (cost, action, inserts) for a turn that says ``role``; None where it can't be."""
    table = [[None] * len(STATES) for _ in STATES]
    for j, target in enumerate(ROLES, start=1):
        named = 0 if role == target else RELABEL if role in ROLES else NAME_UNKNOWN
        for i, state in enumerate(STATES):
            options = []
            path = _inserts(state, target)
            if path is not None:
                options.append((named + INSERT * len(path), "keep" if role == target else "relabel", path))
            if state == target:
                options.append((named + MERGE, "merge", ()))
            table[i][j] = min(options, key=lambda o: o[0], default=None)
    return tuple(tuple(row) for row in table)


STEPS = {role: steps(role) for role in STATES}
COSTS = {r: np.array([[FAR if c is None else c[0] for c in row] for row in t], np.int64) for r, t in STEPS.items()}


def endings() -> list[tuple]:
    """Inserts that bring each state to a legal end; an untouched conversation has none."""
    return [(), ("user", "assistant"), ("assistant",), ()]


def end_costs() -> np.ndarray:
    return np.array([INSERT * len(e) for e in endings()], np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(FAR, (a[:, :, None] + b[None]).min(axis=1))


IDENTITY = np.where(np.eye(len(STATES), dtype=bool), 0, FAR).astype(np.int64)


def known_role(role):
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def trace(roles: list, entry: int, leave: int | None) -> list[tuple[int, str, tuple]]:
    """(state, action, inserts) of each turn on the cheapest path from ``entry`` to ``leave`` or to an end."""
    best, back = IDENTITY[entry], []
    for role in roles:
        total = np.minimum(FAR, best[:, None] + COSTS[role])
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    state = int((best + end_costs()).argmin()) if leave is None else leave
    path = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        before = int(came[state])
        path.append((state, *STEPS[role][before][state][1:]))
        state = before
    return path[::-1]


def _sorted_rows(batches):
    """Number the rows of a sorted part; behind them, the cost matrices of its first and last conversation."""
    part, pos, ends = TaskContext.get().partitionId(), 0, []
    for batch in batches:
        n = batch.num_rows
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "mark")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), pa.array(["turn"] * n), *columns,
             pa.nulls(n, pa.list_(pa.int64()))], schema=_SORTED_SCHEMA,
        )
        pos += n
        for conv_id, role in zip(columns[0].to_pylist(), columns[2].to_pylist(), strict=True):
            if not ends or ends[-1][0] != conv_id:
                del ends[1:]  # stretches between the first and the last lie in this part alone
                ends.append([conv_id, IDENTITY])
            ends[-1][1] = times(ends[-1][1], COSTS[known_role(role)])
    if ends:
        rows = [{"part": part, "pos": i, "kind": "end", "conv_id": c, "segment": m.ravel().tolist()} for i, (c, m) in enumerate(ends)]
        yield pa.RecordBatch.from_pylist(rows, schema=_SORTED_SCHEMA)


_SORTED_SCHEMA = pa.schema(
    [("part", pa.int32()), ("pos", pa.int64()), ("kind", pa.string()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
     ("mark", pa.int64()), ("segment", pa.list_(pa.int64()))]
)


def seams(ends: list[tuple]) -> dict:
    """For each (part, which end): entry and exit state of the stretch; exit None where the conversation ends there.

    ``ends`` are (part, 0 for the first or 1 for the last, conv_id, matrix) in order; a part with a single
    conversation has its first end alone.
    """
    out, at = {}, 0
    while at < len(ends):
        to = at + 1
        while to < len(ends) and ends[to][2] == ends[at][2] and ends[to][0] != ends[to - 1][0]:
            to += 1
        run = ends[at:to]
        forward = [IDENTITY[0]]
        for _, _, _, matrix in run:
            forward.append(np.minimum(FAR, (forward[-1][:, None] + matrix).min(axis=0)))
        state = int((forward[-1] + end_costs()).argmin())
        leave = None
        for i in range(len(run) - 1, -1, -1):
            came = int((forward[i] + run[i][3][:, state]).argmin())
            out[run[i][0], run[i][1]] = came, leave
            state = leave = came
        at = to
    return out


def _decide(joined: dict):
    def run(batches):
        held, part, conv, nth = [], None, None, 0
        rows = []

        def flush():
            if not held:
                return
            # Only the first and the last stretch of a part may go on elsewhere.
            entry, leave = joined[part, 0] if nth == 0 else joined[part, 1] if last else (0, None)
            path = trace([known_role(h["role"]) for h in held], entry, leave)
            for i, (row, (state, action, inserts)) in enumerate(zip(held, path, strict=True)):
                final = i + 1 == len(held)
                rows.append({
                    "of_conv": row["conv_id"], "of_turn": row["turn"], "of_role": row["role"], "of_mark": row["mark"],
                    "place": (row["part"] << 40) + row["pos"], "out_role": STATES[state], "action": action, "inserted_before": list(inserts),
                    "inserted_after": list(endings()[state]) if final and leave is None else [],
                    "opens": action != "merge", "first": i == 0 and entry == 0, "last": final and leave is None,
                })
            held.clear()

        last = False
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part or row["conv_id"] != conv:
                    last = row["part"] != part
                    flush()
                    nth = 0 if row["part"] != part else nth + 1
                    part, conv = row["part"], row["conv_id"]
                held.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_DECIDED_SCHEMA)
                rows = []
        last = True
        flush()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_DECIDED_SCHEMA)

    return run


_DECIDED_SCHEMA = pa.schema(
    [("of_conv", pa.int64()), ("of_turn", pa.int64()), ("of_role", pa.string()), ("of_mark", pa.int64()), ("place", pa.int64()),
     ("out_role", pa.string()), ("action", pa.string()), ("inserted_before", pa.list_(pa.string())), ("inserted_after", pa.list_(pa.string())),
     ("opens", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_())]
)


def rendered(text: Column, out_role: Column, before: Column, after: Column, opens: Column, first: Column, last: Column) -> Column:
    """A turn's part of the rendering; the parts of a conversation in order are its whole text.

    A turn is ``<|role|>``, a line break, the words, ``<|end|>`` and a line break. A turn that merges goes on after a
    line break; the end of a turn is written by the part that opens the next one, or by the last. ``<|`` in a text
    becomes ``< |``.
    """

    def empty(roles):
        return F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), "")

    shut = F.when(opens & ~first, F.lit("<|end|>\n")).otherwise(F.lit(""))
    head = F.when(opens, F.concat(F.lit("<|"), out_role, F.lit("|>\n"))).otherwise(F.lit("\n"))
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    tail = F.when(last, F.concat(F.lit("<|end|>\n"), empty(after))).otherwise(F.lit(""))
    return F.concat(shut, empty(before), head, body, tail)


def repair(turns: DataFrame) -> DataFrame:
    """Each turn (conv_id, turn, role, text) with its place, new role, action and rendered text.

    Conversations are ordered by turn, nulls first, then by a hash of role and text; ``place`` ascends in that
    order, and the ``rendered`` texts of a conversation in that order are its rendering. Turns that repeat in conv_id,
    turn, role and text all stay, one behind the other. Roles are compared without case and blanks; any other, or null, is
    unknown. A null conv_id is one more conversation; a null text is empty. Further columns are not read. An empty
    table gives no rows.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("mark", F.xxhash64("role", "text"))
    keys = ["conv_id", "turn", "role", "mark"]
    # Equal turns are counted before the shuffle; each copy is a turn of its own behind it.
    copies = rows.groupBy(*keys).agg(F.count("*").alias("many")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "many")))
    order = ("conv_id", "turn", "mark", "role", "copy")
    ordered = copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys)
    placed = settled(ordered.mapInArrow(_sorted_rows, SORTED), "turns")
    # Two small matrices for each part.
    ends = placed.filter("kind = 'end'").select("part", "pos", "conv_id", "segment").collect()
    ends = [(r["part"], r["pos"], r["conv_id"], np.array(r["segment"], np.int64).reshape(4, 4)) for r in ends]
    ends.sort(key=lambda e: e[:2])
    joined = seams(ends)
    parts = max(1, len({e[0] for e in ends}))
    dealt = placed.filter("kind = 'turn'").repartition(parts, "part").sortWithinPartitions("part", "pos")
    decided = settled(dealt.mapInArrow(_decide(joined), DECIDED), "decided")
    on = [rows[k].eqNullSafe(decided[f"of_{n}"]) for k, n in zip(keys, ("conv", "turn", "role", "mark"), strict=True)]
    met = rows.dropDuplicates(keys).join(decided, on)
    return met.select(
        "conv_id", "turn", "role", "place", "out_role", "action", "inserted_before", "inserted_after",
        rendered(*(F.col(c) for c in ("text", "out_role", "inserted_before", "inserted_after", "opens", "first", "last"))).alias("rendered"),
    )
