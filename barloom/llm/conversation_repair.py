"""Conversation structure repair: cheapest edits by a weighted automaton that is determinised as it is met.

A conversation is a row of turns; the edits keep, rerole, delete and insert turns
until the initials of the roles read ``(s?(ua)+)?``. The edits and the grammar
make a nondeterministic automaton with costs. Its deterministic twin has cost
vectors, one cost for each state of the grammar and less their least, as states;
they are built when they are first met and kept in a transition table, so a scan
looks up one number a turn. Costs come from the scan, the edits from a trace back
over the arcs that are tight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, written

BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
FAR = 1 << 60
#: States of the grammar: nothing yet, after the system's, the user's, the assistant's turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn whose role has this initial.
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDING = (NONE, ASSISTANT)
#: What a turn that is inserted or given another role must be, and the state after it.
WANTED = {q: AFTER[q, r] for q, r in ((NONE, "u"), (SYSTEM, "u"), (USER, "a"), (ASSISTANT, "u"))}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a turn, the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ADJACENT = {("s", "u"), ("u", "a"), ("a", "u")}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Automaton:
    """The deterministic automaton, its states and transitions made when they are first needed.

    A symbol is four times the fault (0, 1 must go, 2 truncated) plus the place of
    the role's initial in ``sua`` (3: another). Costs that can lead to no cheapest
    repair are infinite: what may be added before anything stands can be added
    after the assistant as well, at one deletion more, and after the system at
    none. With that, vectors differ by a bounded amount and are finitely many.
    """

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._next: list[list[int]] = []
        self._weight: list[list[int]] = []
        self._traced: dict[tuple[int, int, int], tuple[int, tuple]] = {}
        arcs = []
        for symbol in range(12):
            fault, initial = divmod(symbol, 4)
            more = costs.truncated if fault == 2 else 0
            found = []
            for q in range(4):
                found.append((q, q, costs.delete, "D"))
                if fault == 1:
                    continue
                if initial < 3 and (q, "sua"[initial]) in AFTER:
                    found.append((q, AFTER[q, "sua"[initial]], more, "K"))
                if initial == 3 or "sua"[initial] != ROLE_OF[WANTED[q]][0]:
                    found.append((q, WANTED[q], costs.rerole + more, "R"))
            arcs.append(found)
        self.arcs = arcs

    def closed(self, vector: Iterable[int]) -> list[int]:
        """``vector`` after any insertions."""
        v = list(vector)
        for _ in range(2):
            for q, to in WANTED.items():
                v[to] = min(v[to], v[q] + self.costs.insert)
        return v

    def state(self, vector: Iterable[int]) -> tuple[int, int]:
        """The state of a cost vector and what its costs are less by."""
        v = self.closed(vector)
        if v[NONE] > v[ASSISTANT] + self.costs.delete:
            v[NONE] = FAR
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = FAR
        least = min(v)
        key = tuple(x - least if x < FAR else FAR for x in v)
        if key not in self._ids:
            self._ids[key] = len(self.vectors)
            self.vectors.append(key)
            self._next.append([-1] * 12)
            self._weight.append([0] * 12)
        return self._ids[key], least

    def start(self) -> tuple[int, int]:
        return self.state([0, FAR, FAR, FAR])

    def _meet(self, state: int, symbol: int) -> None:
        v, out = self.vectors[state], [FAR] * 4
        for q, to, cost, _ in self.arcs[symbol]:
            if v[q] < FAR:
                out[to] = min(out[to], v[q] + cost)
        self._next[state][symbol], self._weight[state][symbol] = self.state(out)

    def scan(self, symbols: Iterable[int], state: int) -> tuple[list[int], int]:
        """The states before each symbol and after the last, and the sum of the weights."""
        following, weight, states, total = self._next, self._weight, [state], 0
        for c in symbols:
            if following[state][c] < 0:
                self._meet(state, c)
            total += weight[state][c]
            state = following[state][c]
            states.append(state)
        return states, total

    def ending(self, state: int) -> tuple[int, int]:
        """What ends cheapest at ``state``: its cost, and the grammar's states from which it does as bits."""
        v = self.vectors[state]
        least = min(v[q] for q in ENDING)
        return least, sum(1 << q for q in ENDING if v[q] == least)

    def _inserts(self, state: int, alive: int) -> int:
        v = self.vectors[state]
        for _ in range(2):
            for q, to in WANTED.items():
                if alive >> to & 1 and v[q] < FAR and v[q] + self.costs.insert == v[to]:
                    alive |= 1 << q
        return alive

    def traced(self, state: int, symbol: int, alive: int) -> tuple[int, tuple]:
        """One step back: from the grammar's states ``alive`` after ``symbol`` to those before it, with the least edit of each as (label, next)."""
        key = (state, symbol, alive)
        if key not in self._traced:
            if self._next[state][symbol] < 0:
                self._meet(state, symbol)
            v, w, weight = self.vectors[state], self.vectors[self._next[state][symbol]], self._weight[state][symbol]
            best: list = [None] * 4
            for q, to, cost, label in self.arcs[symbol]:
                if v[q] < FAR and alive >> to & 1 and v[q] + cost == weight + w[to] and (best[q] is None or label < best[q][0]):
                    best[q] = (label, to)
            before = self._inserts(state, sum(1 << q for q in range(4) if best[q]))
            self._traced[key] = before, self._with_inserts(state, before, best)
        return self._traced[key]

    def _with_inserts(self, state: int, alive: int, best: list) -> tuple:
        v = self.vectors[state]
        for q, to in WANTED.items():
            if alive >> q & 1 and alive >> to & 1 and v[q] + self.costs.insert == v[to] and (best[q] is None or "I" < best[q][0]):
                best[q] = ("I", to)
        return tuple(best)

    def trace(self, symbols: list[int], states: list[int], alive: int, last: bool = True) -> tuple[int, list[tuple]]:
        """Back over the tight arcs: the grammar's states alive before the first symbol, and the least edits at each place.

        ``alive`` are those alive after the last symbol; where it is the ``last``
        of the conversation, a place for insertions at the end follows.
        """
        steps = []
        if last:
            ended = alive
            alive = self._inserts(states[-1], alive)
            steps.append(self._with_inserts(states[-1], alive, [("", q) if ended >> q & 1 else None for q in range(4)]))
        for k in range(len(symbols) - 1, -1, -1):
            alive, best = self.traced(states[k], symbols[k], alive)
            steps.append(best)
        return alive, steps[::-1]

    @staticmethod
    def walk(steps: list[tuple], q: int) -> tuple[str, int]:
        """The edits from state ``q`` on, least in ASCII, and the state they end in."""
        out = []
        for best in steps:
            label, to = best[q]
            while label == "I":
                out.append(label)
                q = to
                label, to = best[q]
            out.append(label)
            q = to
        return "".join(out), q

    def repair(self, symbols: list[int]) -> tuple[int, str]:
        """The least cost and its edits."""
        state, less = self.start()
        states, total = self.scan(symbols, state)
        end, alive = self.ending(states[-1])
        _, steps = self.trace(symbols, states, alive)
        return less + total + end, self.walk(steps, NONE)[0]


def fault_of(role: str, text: str, seen: bool) -> int:
    held = text.strip(BLANKS)
    return BLANK if not held else DUPLICATE if seen else TRUNCATED if held[-1] not in ENDS else FINE


def symbol_of(role: str, fault: int) -> int:
    return (0, 1, 1, 2)[fault] * 4 + (("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))


def edited(audit: Iterable[str], turns: Iterator[tuple[str, str]], q: int = NONE) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each turn that a repair leaves."""
    for label in audit:
        if label == "I":
            q = WANTED[q]
            yield ROLE_OF[q], "", label
            continue
        role, text = next(turns)
        if label == "R":
            q = WANTED[q]
            yield ROLE_OF[q], text, label
        elif label == "K":
            q = AFTER[q, role[0]]
            yield role, text, label


def _unseen(turns: list[tuple[str, str]]) -> list[bool]:
    met: set = set()
    out = []
    for turn in turns:
        key = hashlib.blake2b("\0".join(turn).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        out.append(key in met)
        met.add(key)
    return out


def _illegal(initials: str) -> int:
    return sum((a, b) not in ADJACENT for a, b in zip(initials, initials[1:], strict=False))


def _initials(roles: Iterable[str]) -> str:
    return "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r in roles)


class _Digest:
    """SHA-256 of repaired turns as ``role:text`` lines, fed one at a time."""

    def __init__(self):
        self._hash, self._any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self._hash.update(("\n" * self._any + role + ":" + text).encode("utf-8", "surrogatepass"))
        self._any = True

    def hex(self) -> str:
        return self._hash.hexdigest()


#: What a report holds beside the conversation's id.
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string, edit string"


def _gaps(turns: list[int | None]) -> int:
    held = {t for t in turns if t is not None}
    return max(held) - min(held) + 1 - len(held) if held else 0


def _whole(automaton: Automaton, turns: list[tuple[str, str]], numbers: list, report: bool) -> Iterator[tuple]:
    """The report, or the repaired turns, of one conversation."""
    faults = [fault_of(*t, seen) for t, seen in zip(turns, _unseen(turns), strict=True)]
    cost, audit = automaton.repair([symbol_of(role, f) for (role, _), f in zip(turns, faults, strict=True)])
    if not report:
        yield from ((k, *row) for k, row in enumerate(edited(audit, iter(turns))))
        return
    digest = _Digest()
    for role, text, _ in edited(audit, iter(turns)):
        digest.add(role, text)
    yield (_gaps(numbers), *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(_initials(r for r, _ in turns)), cost, audit, digest.hex())


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that follow each other with the same first ``keys`` values, as (key, rows); no group is held."""
    from itertools import groupby

    rows = (row for batch in batches for start in range(0, batch.num_rows, 512) for row in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True))
    yield from groupby(rows, key=lambda r: r[:keys])


def _out(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 1 + sum(len(x) for x in row if isinstance(x, str)) // 1000
        if size >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(kind: pa.DataType, text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([("_c", kind), *((n, kinds[t]) for n, t in (x.split() for x in text.split(", ")))])


def _by_conversation(costs: Costs, report: bool):
    """Rows ``_c, _turn, _role, _text, _there``, sorted, to reports or repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, first = Automaton(costs), next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field(0).type, REPORT if report else TURNS)

        def found() -> Iterator[tuple]:
            for (c,), rows in _grouped(_again(first, batches), 1):
                held = [r for r in rows if r[4]]
                for row in _whole(automaton, [(r[2], r[3]) for r in held], [r[1] for r in held], report):
                    yield (c, *row)

        yield from _out(found(), schema)

    return run


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


# --- conversations of any length, cut into blocks -------------------------------------------------


def _blocks(costs: Costs):
    """``_c, _block, _codes, _start``: a block's matrix of least costs between the grammar's states and what it counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        automaton, held = Automaton(costs), rows.sort_values("_at")
        codes, faults, initials = _read(held)
        matrix = []
        for q in range(4):
            state, less = automaton.state([0 if p == q else FAR for p in range(4)])
            states, total = automaton.scan(codes, state)
            matrix += [less + total + x if x < FAR else FAR for x in automaton.vectors[states[-1]]]
        n = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return pd.DataFrame([[held["_c"].iloc[0], held["_block"].iloc[0], matrix, *n, _illegal(initials), initials[0], initials[-1]]], columns=["_c", "_block", "matrix", "blank", "duplicate", "truncated", "illegal", "head", "tail"])

    return run


def _read(held: pd.DataFrame) -> tuple[list[int], list[int], str]:
    faults = held["_fault"].tolist()
    initials = _initials(held["_role"])
    return [symbol_of(r, f) for r, f in zip(held["_role"], faults, strict=True)], faults, initials


def _settled(costs: Costs):
    """A conversation's blocks in order: with what each is entered, what may follow it, and the totals."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        automaton, held = Automaton(costs), blocks.sort_values("_block")
        matrices = [[m[4 * q : 4 * q + 4] for q in range(4)] for m in held["matrix"]]
        entry, entries = automaton.closed([0, FAR, FAR, FAR]), []
        for m in matrices:
            entries.append(list(entry))
            entry = automaton.closed(min(min(entry[q] + m[q][p], FAR) for q in range(4)) for p in range(4))
        cost = min(entry[q] for q in ENDING)
        left, lefts = [0 if q in ENDING else FAR for q in range(4)], []
        for m in reversed(matrices):
            for _ in range(2):
                for q, to in WANTED.items():
                    left[q] = min(left[q], left[to] + costs.insert)
            lefts.append(list(left))
            left = [min(min(m[q][p] + left[p], FAR) for p in range(4)) for q in range(4)]
        seams = _illegal_seams(held["tail"].tolist(), held["head"].tolist())
        return pd.DataFrame(
            {
                "_c": held["_c"].tolist(), "_block": held["_block"].tolist(), "entry": entries, "left": lefts[::-1], "cost": cost, "last": [False] * (len(held) - 1) + [True],
                **{n: int(held[n].sum()) for n in ("blank", "duplicate", "truncated")}, "illegal": int(held["illegal"].sum()) + seams,
            }
        )

    return run


def _illegal_seams(tails: list[str], heads: list[str]) -> int:
    return sum((a, b) not in ADJACENT for a, b in zip(tails, heads[1:], strict=False))


def _traces(costs: Costs):
    """The least edits of a block from each state that a cheapest repair may enter it in: ``_c, _block, q, to, audit``."""

    def run(key, rows: pd.DataFrame, settled: pd.DataFrame) -> pd.DataFrame:
        columns = ["_c", "_block", "q", "to", "audit"]
        if rows.empty or settled.empty:
            return pd.DataFrame(columns=columns)
        automaton, held, at = Automaton(costs), rows.sort_values("_at"), settled.iloc[0]
        codes, _, _ = _read(held)
        state, less = automaton.state(at["entry"])
        states, total = automaton.scan(codes, state)
        exit_ = automaton.vectors[states[-1]]
        if at["last"]:
            alive = automaton.ending(states[-1])[1]
        else:
            alive = sum(1 << q for q in range(4) if exit_[q] < FAR and exit_[q] + less + total + at["left"][q] == at["cost"])
        before, steps = automaton.trace(codes, states, alive, bool(at["last"]))
        c, block = held["_c"].iloc[0], held["_block"].iloc[0]
        out = []
        for q in range(4):
            if before >> q & 1:
                audit, to = automaton.walk(steps, q)
                out.append((c, block, q, to, audit))
        return pd.DataFrame(out, columns=columns)

    return run


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks' edits on the one path from the start: ``_c, _block, q, audit``."""
    found = {(b, q): (to, audit) for b, q, to, audit in zip(rows["_block"], rows["q"], rows["to"], rows["audit"], strict=True)}
    q, out = NONE, []
    for block in sorted(set(rows["_block"])):
        to, audit = found[block, q]
        out.append((rows["_c"].iloc[0], block, q, audit))
        q = to
    return pd.DataFrame(out, columns=["_c", "_block", "q", "audit"])


def _by_piece(report: bool):
    """Sorted ``_c, _at, _q, _audit, _role, _text``, each block's edits before its turns, to digests or repaired turns; nothing is held but a block's edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def repaired(rows: Iterator[tuple], audits: list[str]) -> Iterator[tuple[str, str, str]]:
            for _, _, q, audit, _, _ in rows:  # each time at the edits of a block
                audits.append(audit)
                yield from edited(audit, ((r[4], r[5]) for r in rows), q)

        def found() -> Iterator[tuple]:
            for (c,), rows in _grouped(_again(first, batches), 1):
                audits: list[str] = []
                if report:
                    digest = _Digest()
                    for role, text, _ in repaired(rows, audits):
                        digest.add(role, text)
                    yield c, "".join(audits), digest.hex()
                else:
                    yield from ((c, k, *row) for k, row in enumerate(repaired(rows, audits)))

        yield from _out(found(), _schema(first.schema.field(0).type, "audit string, repaired_sha256 string" if report else TURNS))

    return run


def _cut(rows: DataFrame, costs: Costs, most: int, report: bool) -> DataFrame:
    """Conversations of any length: sorted together, cut into blocks of ``most`` turns whose costs are composed."""
    kind = rows.schema["_c"].dataType.simpleString()
    order = ("_c", F.asc_nulls_first("_turn"), "_role", "_text", "_uid")
    spread = rows.where("_there").withColumn("_uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(spread.drop("_uid", "_there").withColumn("_at", F.monotonically_increasing_id()), "turns")
    text = F.rtrim(F.col("_text"), F.lit(BLANKS))
    marks = held.select("_c", "_at", "_role", "_turn", F.sha2(F.concat_ws("\0", "_role", "_text"), 256).alias("_same"), (text == "").alias("_blank"), F.substring(text, -1, 1).isin(*ENDS).alias("_ends"))
    firsts = marks.groupBy("_c", "_same").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marks = _seen(marks, firsts)
    fault = F.when(F.col("_blank"), BLANK).when(F.col("_later"), DUPLICATE).when(~F.col("_ends"), TRUNCATED).otherwise(FINE)
    codes = written(marks.select("_c", "_at", F.floor(F.col("_at") / most).cast("long").alias("_block"), "_role", "_turn", fault.cast("int").alias("_fault")), "codes")
    counts = "blank long, duplicate long, truncated long, illegal long"
    symbols = codes.select("_c", "_block", "_at", "_role", "_fault")
    matrices = symbols.groupBy("_c", "_block").applyInPandas(_blocks(costs), f"_c {kind}, _block long, matrix array<long>, {counts}, head string, tail string")
    settled = written(matrices.groupBy("_c").applyInPandas(_settled(costs), f"_c {kind}, _block long, entry array<long>, left array<long>, cost long, last boolean, {counts}"), "settled")
    traces = symbols.groupBy("_c", "_block").cogroup(settled.groupBy("_c", "_block")).applyInPandas(_traces(costs), f"_c {kind}, _block long, q int, to int, audit string")
    chosen = written(traces.groupBy("_c").applyInPandas(_chained, f"_c {kind}, _block long, q int, audit string"), "edits")
    turns = held.select("_c", F.floor(F.col("_at") / most).cast("long").alias("_block"), F.lit(1).alias("_o"), "_at", F.lit(None).cast("int").alias("_q"), F.lit(None).cast("string").alias("_audit"), "_role", "_text")
    none = F.lit(None).cast("string")
    heads = chosen.select("_c", "_block", F.lit(0).alias("_o"), F.lit(-1).cast("long").alias("_at"), F.col("q").alias("_q"), F.col("audit").alias("_audit"), none.alias("_role"), none.alias("_text"))
    stream = turns.unionByName(heads).repartition("_c").sortWithinPartitions("_c", "_block", "_o", "_at").select("_c", "_at", "_q", "_audit", "_role", "_text")
    if not report:
        return stream.mapInArrow(_by_piece(False), f"_c {kind}, {TURNS}")
    digests = stream.mapInArrow(_by_piece(True), f"_c {kind}, audit string, repaired_sha256 string")
    numbers = codes.groupBy("_c", "_turn").agg(F.count(F.lit(1)).alias("n")).groupBy("_c").agg((F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")).alias("gaps"))
    sums = settled.groupBy("_c").agg(*[F.max(n).alias(n) for n in ("cost", "blank", "duplicate", "truncated", "illegal")])
    both = _joined(_joined(digests, numbers), sums)
    return both.select("_c", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _seen(marks: DataFrame, firsts: DataFrame) -> DataFrame:
    """``marks`` with ``_later``: whether an earlier turn of the conversation has the same role and text."""
    other = firsts.select(F.col("_c").alias("_k"), F.col("_same").alias("_s"), "_first")
    met = marks.join(other, F.col("_c").eqNullSafe(F.col("_k")) & (F.col("_same") == F.col("_s")), "left")
    return met.withColumn("_later", F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))).drop("_k", "_s", "_first")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnRenamed("_c", "_k")
    return a.join(b, F.col("_c").eqNullSafe(F.col("_k"))).drop("_k")


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None) -> DataFrame:
    held = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    return rows.select(named(conv_col).alias("_c"), named(turn_col).cast("long").alias("_turn"), held(role_col).alias("_role"), held(text_col).alias("_text"), (F.lit(True) if there is None else there).alias("_there"))


def _run(rows: DataFrame, costs: Costs, most: int, most_bytes: int, report: bool) -> DataFrame:
    kind = rows.schema["_c"].dataType.simpleString()
    sizes = rows.groupBy("_c").agg(F.count_if("_there").alias("_n"), F.sum(F.octet_length("_text").cast("long")).alias("_b"))
    large = written(sizes.where((F.col("_n") > most) | (F.col("_b") > most_bytes)).select(F.col("_c").alias("_k")), "large")
    same = F.col("_c").eqNullSafe(F.col("_k"))
    order = ("_c", F.asc_nulls_first("_turn"), "_role", "_text")
    usual = rows if large.isEmpty() else rows.join(large, same, "left_anti")
    out = usual.repartition("_c").sortWithinPartitions(*order).mapInArrow(_by_conversation(costs, report), f"_c {kind}, {REPORT if report else TURNS}")
    return out if large.isEmpty() else out.unionByName(_cut(rows.join(large, same, "left_semi"), costs, most, report))


def repair_report(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there: Column | None = None,
    costs: Costs = Costs(),
    most: int = 10_000,
    most_bytes: int = 1 << 25,
) -> DataFrame:
    """One row a conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Turns stand in the order of their number, nulls first, ties by role and text;
    repeated rows are turns of their own. A null role or text is one blank. Rows
    for which ``there`` is false are no turns but keep their conversation in the
    result: with no turn it has zeros, no edits and the digest of nothing. Null
    ids are one conversation. Of the cheapest edits the least in ASCII is
    reported. Other columns are not read; an empty table gives an empty result.

    Conversations of over ``most`` turns or ``most_bytes`` bytes are cut into
    blocks, so no task holds one: a block's scan from each state of the grammar
    gives a matrix of costs, the matrices are composed, and blocks are traced apart.
    Only SHA-256, which cannot be split, reads such a conversation in one task,
    turn by turn.
    """
    held = _rows(rows, conv_col, turn_col, role_col, text_col, there)
    return _run(held, costs, most, most_bytes, True).withColumnRenamed("_c", "conv_id")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None, costs: Costs = Costs(), most: int = 10_000, most_bytes: int = 1 << 25) -> DataFrame:
    """The repaired turns: ``conv_id, place`` (from 0), ``role, text, edit`` (K kept, R other role, I inserted).

    Defined as ``repair_report`` is; a conversation of which nothing stays has no rows.
    """
    held = _rows(rows, conv_col, turn_col, role_col, text_col, there)
    return _run(held, costs, most, most_bytes, False).withColumnRenamed("_c", "conv_id")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The test damage of the query: rows by crc32 of ``conv_id:turn``, and the column that says which are turns."""
    text = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text("text"), ENDS, "")).otherwise(text("text")).alias("text"),
        (kind != 0).alias("there"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return out.drop("_copy"), F.col("there")
