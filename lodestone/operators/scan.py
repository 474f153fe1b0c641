"""Scans over ordered groups: a row's result may depend on all rows of its group before it.

Rows are dealt by ranges of (group, position), so that a group of any size is spread over many tasks, and kept in that order.
A first pass gives, for each task, what its last group's rows do to whatever state comes in: a summary whose size does not
grow with the rows. The driver composes these summaries, one for each task, and a second pass runs each task from the
state that comes in. That is the two-level form of an associative scan; what a rule asks is that its summaries can be
extended by rows and applied to a state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.shared import kept, kept_in_place


class Rule:
    """What a scan does. States and summaries are values that JSON can hold; ``columns`` are read, ``output`` is a schema of what is added.

    ``step(state, rows)`` gives the state after the rows and the output columns; ``extend(summary, rows)`` the summary
    of what ``summary`` stands for and then ``rows``; ``after(state, summary)`` the state behind it all.
    """

    columns: tuple[str, ...]
    output: str

    def start(self):
        raise NotImplementedError

    def empty(self):
        raise NotImplementedError

    def step(self, state, rows: dict[str, list]):
        raise NotImplementedError

    def extend(self, summary, rows: dict[str, list]):
        raise NotImplementedError

    def after(self, state, summary):
        raise NotImplementedError


def in_ranges(rows: DataFrame, group: str, *order: str, parts: int | None = None) -> DataFrame:
    """``rows`` dealt and sorted by group and order and kept so in the shared folder; ``parts`` tasks, or as the session has it."""
    keyed = rows.withColumn("_group", F.to_json(F.struct(F.col(group).alias("g"))))
    dealt = keyed.repartitionByRange(parts, "_group", *order) if parts else keyed.repartitionByRange("_group", *order)
    return kept_in_place(dealt.sortWithinPartitions("_group", *order))


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, dict]]]]:
    """Batches with their stretches of rows of one group, in order: the group, and the rows' number ``_n`` and columns as lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, at, parts = pc.run_end_encode(batch.column("_group")), 0, []
        lists = {c: batch.column(c).to_pylist() for c in columns}
        for end, group in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
            parts.append((group, {"_n": end - at} | {c: x[at:end] for c, x in lists.items()}))
            at = end
        yield batch, parts


def _turned(ranged: DataFrame) -> DataFrame:
    """``ranged`` with each task's rows from the last to the first: sorted by their place in Spark, which spills, and not gathered in Python."""
    return ranged.withColumn("_at", F.monotonically_increasing_id()).sortWithinPartitions(F.desc("_at")).drop("_at")


def scan(ranged: DataFrame, rule: Rule, backward: bool = False, of: DataFrame | None = None) -> DataFrame:
    """``ranged`` (from ``in_ranges``) with the rule's output columns; ``backward`` goes from a group's last row to its first.

    ``of``: a table with the same rows in the same tasks that has the rule's columns, for the first pass.
    """

    if backward:
        ranged, of = _turned(ranged), None if of is None else _turned(of)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = summary = None
        for _, parts in _runs(batches, rule.columns):
            for group, rows in parts:
                if group != last:
                    first, last, summary = (group if first is None else first), group, rule.empty()
                summary = rule.extend(summary, rows)
        if last is not None:
            row = {"part": TaskContext.get().partitionId(), "first": first, "last": last, "summary": json.dumps(summary)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("summary", pa.string())]))

    incoming: dict[int, object] = {}
    group, state = None, None
    found = (of or ranged).select("_group", *rule.columns).mapInArrow(summaries, "part int, first string, last string, summary string")
    for row in sorted(found.collect(), key=lambda r: -r.part if backward else r.part):  # one row for each task
        if row.first == group:
            incoming[row.part] = state
        start = state if row.last == group else rule.start()
        group, state = row.last, rule.after(start, json.loads(row.summary))
    return _passed(ranged, rule, {k: json.dumps(v) for k, v in incoming.items()})


def _passed(ranged: DataFrame, rule: Rule, states: dict[int, str]) -> DataFrame:
    """The second pass: ``ranged`` with the rule's columns, a task's first group beginning in the task's state of ``states``, if it has one."""
    plain = ranged.schema
    schema = StructType([*plain.fields, *StructType.fromDDL(rule.output).fields])
    names = StructType.fromDDL(rule.output).names
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(rule.output).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = states.get(TaskContext.get().partitionId()) if states else None, None
        state = None
        for batch, parts in _runs(batches, rule.columns):
            found = {n: [] for n in names}
            for now, rows in parts:
                if now != group:
                    state = json.loads(held) if held is not None and group is None else rule.start()
                    group = now
                state, out = rule.step(state, rows)
                for n in names:
                    found[n] += out[n]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[n], type=kinds[n]) for n in names)], [*batch.schema.names, *names])

    return ranged.mapInArrow(run, schema)


def scanned(rows: DataFrame, rule: Rule, group: str, *order: str, parts: int | None = None, most: int = 200_000) -> DataFrame:
    """``rows`` with the rule's output columns, each group in the given order.

    Groups of up to ``most`` rows are dealt whole, and one pass over them is enough; larger ones, which are counted first, are
    dealt by ranges and scanned in two levels, as are all if ``parts`` is given.
    """
    if parts:
        return scan(in_ranges(rows, group, *order, parts=parts), rule).drop("_group")
    given = kept(rows.withColumn("_group", F.to_json(F.struct(F.col(group).alias("g")))))
    large = kept(given.groupBy("_group").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_group"))
    any_large = not large.isEmpty()
    small = given.join(large, "_group", "left_anti") if any_large else given
    found = _passed(small.select(*given.columns).repartition("_group").sortWithinPartitions("_group", *order), rule, {})
    if any_large:
        rest = given.join(large, "_group", "left_semi").select(*rows.columns)
        found = found.unionByName(scan(in_ranges(rest, group, *order), rule))
    return found.drop("_group")


class Nesting(Rule):
    """Parent, depth and ordinal of rows with a level: a row lies under the nearest row before it of a lesser level.

    The state is the stack of open rows [level, node, children] with the number of rows without a parent. A summary has the
    rows that find no parent among its own, as [level, how many] with falling levels, and its own stack.
    """

    columns = ("node", "level")
    output = "parent long, depth int, ordinal int"

    def start(self):
        return {"n": 0, "stack": []}

    def empty(self):
        return {"orphans": [], "stack": []}

    def step(self, state, rows):
        stack, n = state["stack"], state["n"]
        parents, depths, ordinals = [], [], []
        for node, level in zip(rows["node"], rows["level"], strict=True):
            while stack and stack[-1][0] >= level:
                stack.pop()
            if stack:
                stack[-1][2] += 1
                parents.append(stack[-1][1])
                ordinals.append(stack[-1][2])
            else:
                n += 1
                parents.append(None)
                ordinals.append(n)
            depths.append(len(stack) + 1)
            stack.append([level, node, 0])
        return {"n": n, "stack": stack}, {"parent": parents, "depth": depths, "ordinal": ordinals}

    def extend(self, summary, rows):
        orphans, stack = summary["orphans"], summary["stack"]
        for node, level in zip(rows["node"], rows["level"], strict=True):
            while stack and stack[-1][0] >= level:
                stack.pop()
            if stack:
                stack[-1][2] += 1
            elif orphans and orphans[-1][0] == level:
                orphans[-1][1] += 1
            else:
                orphans.append([level, 1])
            stack.append([level, node, 0])
        return summary

    def after(self, state, summary):
        stack, n = [list(x) for x in state["stack"]], state["n"]
        for level, count in summary["orphans"]:
            while stack and stack[-1][0] >= level:
                stack.pop()
            if stack:
                stack[-1][2] += count
            else:
                n += count
        return {"n": n, "stack": stack + summary["stack"]}


class Closing(Rule):
    """Backward: the node that closes a row, which is the next one of the same or a lesser level."""

    columns = ("node", "level")
    output = "closed_by long"

    def start(self):
        return []

    empty = start

    def step(self, state, rows):
        out = []
        for node, level in zip(rows["node"], rows["level"], strict=True):
            while state and state[-1][0] > level:
                state.pop()
            out.append(state[-1][1] if state else None)
            if state and state[-1][0] == level:
                state.pop()
            state.append([level, node])
        return state, {"closed_by": out}

    def extend(self, summary, rows):
        return self.step(summary, rows)[0]

    def after(self, state, summary):
        return [x for x in state if not summary or x[0] < summary[0][0]] + summary


class Rising(Rule):
    """Which rows a sequence with memory takes: a row that is fit and whose number is over all that were taken at its depth.

    The state has the highest number taken at each depth. Numbers are lists; a row's depth is its number's length.
    """

    columns = ("number", "fit")
    output = "taken boolean"

    def start(self):
        return {}

    empty = start

    def step(self, state, rows):
        out = []
        for number, fit in zip(rows["number"], rows["fit"], strict=True):
            depth = str(len(number or ()))
            taken = bool(fit) and number is not None and (depth not in state or number > state[depth])
            if taken:
                state[depth] = number
            out.append(taken)
        return state, {"taken": out}

    def extend(self, summary, rows):
        return self.step(summary, rows)[0]

    def after(self, state, summary):
        return {d: max(x for x in (state.get(d), summary.get(d)) if x is not None) for d in state.keys() | summary.keys()}


class Chain(Rule):
    """The first node of the chain a row belongs to; a row that ``goes_on`` belongs to the chain before it, if there is one."""

    columns = ("node", "goes_on")
    output = "head long"

    def start(self):
        return None

    def empty(self):
        return {}

    def step(self, state, rows):
        out = []
        for node, goes_on in zip(rows["node"], rows["goes_on"], strict=True):
            if not goes_on or state is None:
                state = node
            out.append(state)
        return state, {"head": out}

    def extend(self, summary, rows):
        for node, goes_on in zip(rows["node"], rows["goes_on"], strict=True):
            summary.setdefault("first", node)
            if not goes_on:
                summary["head"] = node
        return summary

    def after(self, state, summary):
        return summary.get("head", summary.get("first") if state is None else state)


class Pages(Rule):
    """The head of each piece's chain over pages: a page's first piece that goes on belongs to the chain of the last piece of the page just before.

    All other pieces begin chains. The state is the last piece's page and head; a summary has its first piece and the state it
    leaves, without a head if that is its first piece's.
    """

    columns = ("_page", "_node", "_on")
    output = "head long"

    def start(self):
        return [None, None]

    def empty(self):
        return {}

    def joined(self, state, page, node, on):
        return state[1] if on and page is not None and state[0] is not None and state[0] == page - 1 else node

    def step(self, state, rows):
        at, head, out = *state, []
        for page, node, on in zip(rows["_page"], rows["_node"], rows["_on"], strict=True):
            if not (on and at is not None and page is not None and at == page - 1):
                head = node
            at = page
            out.append(head)
        return [at, head], {"head": out}

    def extend(self, summary, rows):
        s = summary
        for page, node, on in zip(rows["_page"], rows["_node"], rows["_on"], strict=True):
            if not s:
                s |= {"first": [page, node, on], "page": page, "head": None}
            else:
                s |= {"head": s["head"] if on and page is not None and s["page"] is not None and s["page"] == page - 1 else node, "page": page}
        return s

    def after(self, state, summary):
        return [summary["page"], self.joined(state, *summary["first"]) if summary["head"] is None else summary["head"]]


class Counted(Rule):
    """The number of each row in its group, from 1."""

    columns = ()
    output = "nth long"

    def start(self):
        return 0

    empty = start

    def step(self, state, rows):
        n = rows["_n"]
        return state + n, {"nth": list(range(state + 1, state + n + 1))}

    def extend(self, summary, rows):
        return summary + rows["_n"]

    def after(self, state, summary):
        return state + summary


class Listing(Rule):
    """Runs of entries with at most ``gap`` fillers between two: ``kind`` is 'entry', 'filler' or another that ends a run.

    For an entry, ``run`` is the first entry's node and ``named`` whether the row before it ``names`` a listing; null for other
    rows. The state is the open run, the fillers since its last entry and the last row's ``names``. A summary has the fillers
    before its first entry (null when a row there ends a run), that entry, and the state it leaves, in which the run of its first
    entry may turn out to be the one that came in.
    """

    columns = ("node", "kind", "names")
    output = "run long, named boolean"

    def __init__(self, gap: int = 6):
        self.gap = gap

    def start(self):
        return {"run": None, "gap": 0, "names": False}

    def empty(self):
        return {"first": None, "lead": 0, "run": None, "gap": 0, "names": None}

    def go(self, run, gap, kind):
        """The run and gap behind a row that is no entry."""
        return (run, gap + 1) if run is not None and kind == "filler" and gap < self.gap else (None, 0)

    def step(self, state, rows):
        run, gap, last, out, named = state["run"], state["gap"], state["names"], [], []
        for node, kind, names in zip(rows["node"], rows["kind"], rows["names"], strict=True):
            if kind == "entry":
                run, gap = (node if run is None else run), 0
                out.append(run)
                named.append(last)
            else:
                run, gap = self.go(run, gap, kind)
                out.append(None)
                named.append(None)
            last = bool(names)
        return {"run": run, "gap": gap, "names": last}, {"run": out, "named": named}

    def extend(self, summary, rows):
        s = summary
        for node, kind, names in zip(rows["node"], rows["kind"], rows["names"], strict=True):
            if s["first"] is None:
                if kind == "entry":
                    s |= {"first": node, "run": node, "gap": 0}
                elif s["lead"] is not None:
                    s["lead"] = s["lead"] + 1 if kind == "filler" and s["lead"] < self.gap else None
            elif kind == "entry":
                s |= {"run": node if s["run"] is None else s["run"], "gap": 0}
            else:
                s["run"], s["gap"] = self.go(s["run"], s["gap"], kind)
            s["names"] = bool(names)
        return s

    def after(self, state, summary):
        s, names = summary, summary["names"]
        joins = state["run"] is not None and s["lead"] is not None and state["gap"] + s["lead"] <= self.gap
        if s["first"] is None:
            return {"run": state["run"], "gap": state["gap"] + s["lead"], "names": names} if joins else {"run": None, "gap": 0, "names": names}
        return {"run": state["run"] if joins and s["run"] == s["first"] else s["run"], "gap": s["gap"], "names": names}
