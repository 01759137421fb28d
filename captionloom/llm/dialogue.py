"""Conversation structure repair: cheapest edits by Viterbi whose survivors emit as they coalesce.

A conversation's turns are kept, given another role, deleted or joined by inserted ones, so that the role
initials read ``(s?(ua)+)?``. Among the cheapest edits the audit string that is least in ASCII wins.

The turns are sorted as narrow rows (no texts), so that a conversation of any length spans many tasks, and
cut into runs of ``RUN`` turns. A run tells what it costs to get from each state to each other and how
those paths compare; the runs of a conversation are put together from that, a few numbers each; then every
run emits its edits between the two states it was given.

Nulls: a null role or text is one space, a null turn comes first, turns without a conversation form one.
Turns of equal number come in the order of a digest of role and text, so equal rows are adjacent. An empty
table gives an empty result; columns beyond ``conv_id, turn, role, text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import PLACE, arrow_rows, with_place
from captionloom.session import materialize

#: Turns in a run, as a power of two.
RUN_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: States by what was emitted last: nothing yet, system, user, assistant.
NONE, S, U, A = range(4)
BEFORE_USER = (NONE, S, A)
ROLES = {U: "user", A: "assistant"}
NEVER = 1 << 60
#: (worse, better, margin): a path to the first state that costs more than the margin above one to the second cannot
#: win, since whatever follows the first can follow the second for the margin: a system turn deleted (2) where it
#: could have been kept, an assistant or a user inserted (5).
DOMINATED = (
    (NONE, A, DELETE), (NONE, U, DELETE + INSERT), (S, NONE, 0), (S, A, 0), (S, U, INSERT), (A, U, INSERT), (U, A, INSERT),
)


def steps(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, letters)`` of every way past a turn that can be cheapest.

    At most one turn is inserted before it: two lead back to where they began, or to where less led. Nothing is inserted
    before a deleted turn: behind it costs the same, and D reads before I.
    """
    found = []
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for to, sources, lead, first in ((S, (NONE,), (), None), (U, BEFORE_USER, (U,), A), (A, (U,), BEFORE_USER, U)):
            # ``lead`` are the states from which an inserted turn leads to ``first``, and the turn from there on.
            letters = [("K", KEEP)] if initial == "-sua"[to] else []
            letters += [("R", REROLE)] if first else []
            for letter, cost in letters:
                found += [(s, to, cost + more, letter) for s in sources]
                found += [(s, to, INSERT + cost + more, "I" + letter) for s in lead]
    return found + [(s, s, DELETE, "D") for s in range(4)]


class Survivors:
    """The best path to each state, as leaves of a tree of backpointers.

    A node is ``[parent, letters, to, children]``. Nodes that no survivor needs any more go by the count of their
    children; once the root has a single child left, all survivors agree on its edit, and it is emitted. What is
    held is the part on which the survivors still differ.

    Ties are decided by the complete unresolved suffixes. Two survivors have passed the same turns and end in a
    turn's letter, so neither is the beginning of the other: their order stands whatever is appended to both, and
    is carried from turn to turn as a rank.
    """

    def __init__(self, start: int):
        self.root = [None, "", start, []]
        self.at = {start: (0, 0, self.root)}  # state -> cost, rank of its path, node
        self.emitted: list[tuple[str, int]] = []
        self._known: dict = {}

    def _ways(self, initial: str, fault: int) -> dict[int, list[tuple[int, int, str]]]:
        key = (initial if initial in ("s", "u", "a") else "", fault)
        if key not in self._known:
            into: dict[int, list[tuple[int, int, str]]] = {}
            for source, to, cost, letters in steps(*key):
                into.setdefault(to, []).append((source, cost, letters))
            self._known[key] = into
        return self._known[key]

    def turn(self, initial: str, fault: int) -> None:
        at, best = self.at, {}
        for to, ways in self._ways(initial, fault).items():
            options = [(at[s][0] + cost, at[s][1], letters, s) for s, cost, letters in ways if s in at]
            if options:
                best[to] = min(options)
        for worse, better, margin in DOMINATED:
            if worse in best and better in best and best[worse][0] > best[better][0] + margin:
                del best[worse]
        after = {}
        for rank, to in enumerate(sorted(best, key=lambda t: best[t][1:3])):
            cost, _, letters, s = best[to]
            parent = at[s][2]
            node = [parent, letters, to, []]
            parent[3].append(node)
            after[to] = (cost, rank, node)
        for _, _, node in at.values():
            while node is not self.root and not node[3]:
                node[0][3].remove(node)
                node = node[0]
        self.at = after
        while len(self.root[3]) == 1:
            self._emit(self.root[3][0])

    def _emit(self, node: list) -> None:
        self.emitted.append((node[1], node[2]))
        node[0] = None
        self.root = node

    def held(self) -> int:
        """Nodes of the tree, the root not counted."""
        todo, n = [self.root], -1
        while todo:
            n += 1
            todo += todo.pop()[3]
        return n

    def end(self, state: int | None = None) -> tuple[int, int, list[tuple[str, int]]]:
        """Cost, last state and ``(letters, state)`` per turn; ``state`` None takes the best accepted end."""
        if state is None:
            state = accepted({s: (cost, rank) for s, (cost, rank, _) in self.at.items()})
        cost, _, node = self.at[state]
        rest = []
        while node is not self.root:
            rest.append((node[1], node[2]))
            node = node[0]
        return cost, state, self.emitted + rest[::-1]


def accepted(ends: dict[int, tuple[int, int]]) -> int:
    """The state to end in, of ``state -> (cost, rank)``: nothing, an assistant, or a user with an assistant inserted."""
    extra = {NONE: 0, A: 0, U: INSERT}
    return min((cost + extra[s], rank, s) for s, (cost, rank) in ends.items() if s in extra)[2]


def transfer(turns: list[tuple[str, int]]) -> list[tuple[int, int, int, int]]:
    """``(from, to, cost, rank)`` of a run; ranks order the paths of one starting state."""
    found = []
    for start in range(4):
        paths = Survivors(start)
        for initial, fault in turns:
            paths.turn(initial, fault)
            paths.emitted.clear()
        found += [(start, to, cost, rank) for to, (cost, rank, _) in paths.at.items()]
    return found


def join_runs(runs: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int]]:
    """The states between which each run of a conversation has to go."""
    at, back = {NONE: (0, 0)}, []
    for run in runs:
        best: dict[int, tuple[int, int, int, int]] = {}
        for start, to, cost, rank in run:
            if start in at:
                option = (at[start][0] + cost, at[start][1], rank, start)
                best[to] = min(best.get(to, (NEVER, 0, 0, 0)), option)
        order = sorted(best, key=lambda t: best[t][1:3])
        at = {to: (best[to][0], rank) for rank, to in enumerate(order)}
        back.append({to: best[to][3] for to in best})
    state, found = accepted(at), []
    for sources in reversed(back):
        found.append((sources[state], state))
        state = sources[state]
    return found[::-1]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` and the place of the row: the turns as crc32 of ``conv_id:turn`` harms them.

    Of 20 remainders, 0 drops the turn, 1 empties its text, 2 removes its full stops, question and exclamation marks,
    3 repeats it, 4 makes it the user's. Nulls are one space throughout.
    """
    placed = with_place(conversations)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return placed.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        *PLACE,
        F.explode(copies).alias("copy"),
    )


def as_turns(conversations: DataFrame) -> DataFrame:
    """Undamaged conversations in the form that ``repair`` takes."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return with_place(conversations).select("conv_id", "turn", *filled, *PLACE, F.lit(0).alias("copy"))


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, initial, fault, spot`` and place of each turn, without its text, written.

    ``spot`` rises with conversation and turn. A duplicate is every turn but the first of its conversation with one role and text.
    """
    marks = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    size = F.length("role").cast("string")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    narrow = turns.select(
        "conv_id",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        F.when(marks == "", BLANK).when(~marks.isin(".", "!", "?"), CUT).otherwise(SOUND).alias("fault"),
        F.unhex(F.md5(F.concat_ws("\n", conv, size, F.concat("role", "text")))).alias("same"),
        *PLACE,
        "copy",
    )
    # Equal rows are told apart by their place, so that no number of them has to go to one task.
    order = ["conv_id", "turn", "same", *PLACE, "copy"]
    sorted_ = materialize(narrow, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    spots = materialize(sorted_.withColumn("spot", F.monotonically_increasing_id()), "spots")
    repeated = spots.groupBy("same").agg(F.count("*").alias("n"), F.min("spot").alias("first")).filter("n > 1")
    marked = spots.join(materialize(repeated.drop("n"), "repeated"), "same", "left")
    again = (F.col("fault") != BLANK) & (F.col("spot") > F.col("first"))
    return marked.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))).drop("same", "first")


def _segments(keys: list, initials: list, faults: list) -> list[tuple[int, int, list[tuple[str, int]]]]:
    """Stretches of one conversation in a run of sorted turns."""
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    return [(a, b, list(zip(initials[a:b], faults[a:b]))) for a, b in zip(cuts, cuts[1:])]


def _run(table: pa.Table) -> tuple[pa.Table, list]:
    table = table.combine_chunks().sort_by("spot")
    return table, _segments(*[table[c].to_pylist() for c in ("conv_id", "initial", "fault")])


def edits(turns: DataFrame) -> DataFrame:
    """``conv_id, spot, place, copy, initial, fault, letters, state`` of each turn of ``ordered``, written.

    ``letters`` are the edits' initials: I for a turn inserted before, then K, R or D; the last turn of a conversation may
    carry an I behind. ``state`` is the state after the turn.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    runs = materialize(turns.withColumn("run", F.shiftright("spot", RUN_BITS)), "runs")

    def border(table: pa.Table) -> pa.Table:
        # Only the first and the last conversation of a run may go on outside it.
        table, parts = _run(table)
        ends = parts if len(parts) < 3 else [parts[0], parts[-1]]
        rows = [(table["conv_id"][a].as_py(), table["run"][a].as_py(), *way) for a, _, part in ends for way in transfer(part)]
        columns = list(zip(*rows)) or [[]] * 6
        types = [table.schema.field("conv_id").type, *[pa.int64()] * 5]
        names = ["conv_id", "run", "start", "to", "cost", "rank"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    ways = runs.groupBy("run").applyInArrow(border, f"conv_id {kind}, run long, start long, to long, cost long, rank long")

    def between(table: pa.Table) -> pa.Table:
        by_run: dict[int, list] = {}
        for row in zip(*[table[c].to_pylist() for c in ("run", "start", "to", "cost", "rank")]):
            by_run.setdefault(row[0], []).append(row[1:])
        listed = sorted(by_run)
        states = join_runs([by_run[r] for r in listed])
        conv = table["conv_id"].slice(0, 1).combine_chunks().take(pa.array([0] * len(listed)))
        last = [r == listed[-1] for r in listed]
        return pa.table(
            [conv, pa.array(listed, pa.int64()), pa.array([s for s, _ in states], pa.int64()), pa.array([t for _, t in states], pa.int64()), pa.array(last)],
            ["conv_id", "run", "start", "to", "is_last"],
        )

    # A few numbers per run of one conversation.
    bounds = materialize(ways, "ways").groupBy("conv_id").applyInArrow(between, f"conv_id {kind}, run long, start long, to long, is_last boolean")

    def solve(table: pa.Table, given: pa.Table) -> pa.Table:
        table, parts = _run(table)
        known = {r["conv_id"]: r for r in given.to_pylist()}
        letters, states = [], []
        for i, (a, _, part) in enumerate(parts):
            bound = known.get(table["conv_id"][a].as_py()) if i in (0, len(parts) - 1) else None
            paths = Survivors(bound["start"] if bound else NONE)
            for initial, fault in part:
                paths.turn(initial, fault)
            _, state, found = paths.end(bound["to"] if bound else None)
            letters += [x for x, _ in found]
            states += [x for _, x in found]
            if state == U and (not bound or bound["is_last"]):
                letters[-1] += "I"
        return table.drop_columns(["run"]).append_column("letters", pa.array(letters, pa.string())).append_column("state", pa.array(states, pa.int32()))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields)
    solved = runs.groupBy("run").cogroup(materialize(bounds, "bounds").groupBy("run")).applyInArrow(solve, f"{shape}, letters string, state int")
    return materialize(solved, "edits")


def repair(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """``conv_id, spot, part, edit, role, text``: the repaired conversations, in the order of ``spot, part``."""
    texts = turns.select(*PLACE, "copy", "role", "text")
    rows = edited.select("conv_id", "spot", *PLACE, "copy", "letters", "state").filter("letters <> 'D'").join(texts, [*PLACE, "copy"])
    letter = F.regexp_extract("letters", "[KRD]", 0)
    to = F.when(F.col("state") == U, "user").otherwise("assistant")
    # What is inserted before a turn is the other one of the pair.
    other = F.when(F.col("state") == U, "assistant").otherwise("user")
    made = lambda part, edit, role, text: F.struct(F.lit(part).alias("part"), edit.alias("edit"), role.alias("role"), text.alias("text"))
    before = made(0, F.lit("I"), other, F.lit(""))
    itself = made(1, letter, F.when(letter == "R", to).otherwise(F.col("role")), F.col("text"))
    behind = made(2, F.lit("I"), F.lit("assistant"), F.lit(""))
    parts = F.array(
        F.when(F.startswith("letters", F.lit("I")), before),
        F.when(letter != "D", itself),
        F.when(F.endswith("letters", F.lit("I")), behind),
    )
    return rows.select("conv_id", "spot", F.inline(F.array_compact(parts)))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the ``role:text`` lines of each repaired conversation.

    A hash of one long text has to see it from beginning to end: the lines of a conversation pass one task, a batch at a time.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "spot", "part", F.concat_ws(":", "role", "text").alias("line"))
    # By conversation alone: whatever else is dealt by here must keep a conversation in one place.
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "spot", "part").select("conv_id", "line")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, done = None, None, []
        schema = None

        def told_so_far() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), pa.field("repaired_sha256", pa.string())])
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"]):
                data = line.as_buffer()
                if state is None or conv != here:
                    if state is not None:
                        done.append((here, state.hexdigest()))
                    here, state = conv, hashlib.sha256(data)
                else:
                    state.update(b"\n")
                    state.update(data)
            if len(done) > 10_000:
                yield told_so_far()
                done.clear()
        if state is not None:
            done.append((here, state.hexdigest()))
            yield told_so_far()

    with arrow_rows(lines.sparkSession):
        return materialize(lines.mapInArrow(told, f"conv_id {kind}, repaired_sha256 string"), "digests")


def costs(edited: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, blank, duplicate, truncated, illegal`` of each conversation with turns.

    Turns are summed up by run first; a conversation's audit is then put together from its runs.
    """
    letters, fault = F.col("letters"), F.col("fault")
    count = lambda x: F.length(letters) - F.length(F.replace(letters, F.lit(x), F.lit("")))
    cut = F.when((fault == CUT) & (F.regexp_extract(letters, "[KR]", 0) != ""), TRUNCATED).otherwise(0)
    cost = REROLE * count("R") + DELETE * count("D") + INSERT * count("I") + cut
    listed = F.sort_array(F.collect_list(F.struct("spot", "letters", "initial")))
    runs = edited.groupBy("conv_id", F.shiftright("spot", RUN_BITS).alias("run")).agg(
        F.sum(cost).alias("cost"),
        *[F.sum((fault == x).cast("long")).alias(n) for n, x in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))],
        listed.alias("turns"),
    )
    pairs = lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.concat(F.get(a, i), x))
    bad = lambda a: F.size(F.filter(pairs(a), lambda p: ~p.isin("su", "ua", "au")))
    initials = F.col("turns.initial")
    runs = runs.select(
        "conv_id", "run", "cost", "blank", "duplicate", "truncated",
        F.array_join("turns.letters", "").alias("audit"),
        bad(initials).alias("illegal"),
        F.array(F.element_at(initials, 1), F.element_at(initials, -1)).alias("ends"),
    )
    whole = runs.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "illegal")],
        F.sort_array(F.collect_list(F.struct("run", "audit", "ends"))).alias("runs"),
    )
    seams = F.transform(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), lambda x, i: F.concat(F.get("runs", i)["ends"][1], x["ends"][0]))
    across = F.size(F.filter(seams, lambda p: ~p.isin("su", "ua", "au")))
    return whole.select(
        "conv_id", "cost", "blank", "duplicate", "truncated",
        (F.col("illegal") + across).alias("illegal"),
        F.array_join("runs.audit", "").alias("audit"),
    )


def report(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One row per conversation of the table: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` are those to repair, by default the damaged ones. A conversation that lost all its turns has zeros, an empty
    audit and the hash of nothing.
    """
    turns = damage(conversations) if turns is None else turns
    order = ordered(turns)
    edited = edits(order)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    parts = [
        edited.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps")),
        costs(edited),
        digests(repair(turns, edited)),
    ]
    found = conversations.select("conv_id").distinct()
    for part in parts:
        found = found.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    return found.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
    )
