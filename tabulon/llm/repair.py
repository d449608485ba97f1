"""Repair of the turn structure of conversations, as Knuth's lightest derivation.

A repaired conversation reads (s?(ua)+)? in the initials of its roles: perhaps a system row, then pairs of user and assistant
rows, or nothing. Rows may be kept, given another role, deleted, and empty rows inserted, each at a cost. Items of the deduction
are `("at", i, state)`: the first i rows are edited so that the initials so far lead to the state, and `("edit", i, e)`, an edit of
row i. A deduction joins items into another; its value, (cost, audit), is the sum of the costs and the edits' initials in order,
which is never less than that of the rows before. So items are popped from an agenda in the order of their values, each is final when
popped, and the run ends when the goal is. With equal costs the audit that comes first in ASCII wins. Where a conversation is cut into blocks,
a block's derivations from state to state are the items `("span", i, k, from, to)` of another deduction of the same kind.

Spread over tasks: rows are sorted into ranges of (conversation, turn). Conversations that lie inside a range are repaired where
they are. Those that may go on in another range, or have over LONG rows, are open: repeated rows are found by a join on their
digests, blocks of BLOCK rows are deduced apart, and a last pass puts one conversation's blocks together, then streams its rows
through the digest (which can't be had in parts). So no task holds a conversation's rows, however many they are; the audit is
one value in the end.

Defined results: nulls in any column count as one space; rows whose turn is null come first; of rows with equal turns those with the
lesser role, then text come first; repeated rows are duplicates, as are any with the role and text of an earlier row; a
conversation whose rows are all dropped has zeros, an empty audit and the digest of an empty text; a null conv_id is a
conversation of its own; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import row_index
from .common import keep

#: Rows that a block of a long conversation has at most, and rows beyond which a conversation is open.
BLOCK, LONG = 256, 4096
#: What initials lead to: from no row, after s, after u, after a; a repaired conversation ends in the first or the last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: The initial of the row that may be inserted in a state, or whose role a row may be given.
MADE = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Costs of edits, by their initials; and of a row that stays truncated.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
#: Initials that may follow each other.
PAIRS = ("su", "ua", "au")

Value = tuple[int, str]
#: A row as the deduction sees it: (initial, must it go, is it truncated).
Face = tuple[str, bool, bool]
INSERT = ("edit", -1, "I")
GOAL = ("goal",)


def lightest(axioms: dict[tuple, Value], rules: Callable[[tuple, dict], Iterable[tuple[tuple, tuple]]], goals: Iterable[tuple]) -> dict[tuple, Value]:
    """Final items and their values, until all goals are final or nothing is left. axioms: items that no deduction leads to, so that they
    are final from the start. rules(item, final): (head, tails) of the deductions that a final item takes part in and whose other
    tails are final; a head's value is the sum of its tails', in order, and not less than that of a tail that is no axiom."""
    final, best, agenda = dict(axioms), {}, []

    def deduce(item: tuple) -> None:
        for head, tails in rules(item, final):
            if head in final:
                continue
            cost, audit = 0, ""
            for t in tails:
                c, a = final[t]
                cost, audit = cost + c, audit + a
            if head not in best or (cost, audit) < best[head]:
                best[head] = cost, audit
                heappush(agenda, (best[head], head))

    for item in axioms:
        deduce(item)
    missing = set(goals).difference(final)
    while agenda and missing:
        value, item = heappop(agenda)
        if item not in final:
            final[item] = value
            missing.discard(item)
            deduce(item)
    return final


def edits(i: int, faulty: bool, truncated: bool) -> dict[tuple, Value]:
    """The edits that row i may have, as items."""
    more = TRUNCATED if truncated else 0
    kept = {} if faulty else {("edit", i, "K"): (COSTS["K"] + more, "K"), ("edit", i, "R"): (COSTS["R"] + more, "R")}
    return kept | {("edit", i, "D"): (COSTS["D"], "D")}


def derivations(rows: list[Face], start: int, goals: list[tuple]) -> dict[tuple, Value]:
    """Values of the goals that can be reached from a state before the rows: `("at", len(rows), state)`, or GOAL, which is any state that
    a repaired conversation may end in."""
    n = len(rows)
    axioms = {("at", 0, start): (0, ""), INSERT: (COSTS["I"], "I")}
    for i, (_, faulty, truncated) in enumerate(rows):
        axioms |= edits(i, faulty, truncated)

    def step(i: int, state: int, e: str):
        to = state if e == "D" else STEPS.get((state, rows[i][0] if e == "K" else MADE[state]))
        if to is not None:
            yield ("at", i + 1, to), (("at", i, state), ("edit", i, e))

    def rules(item: tuple, final: dict):
        if item == INSERT:
            for at in [x for x in final if x[0] == "at"]:
                yield ("at", at[1], STEPS[at[2], MADE[at[2]]]), (at, INSERT)
        elif item[0] == "edit":
            for state in range(4):
                if ("at", item[1], state) in final:
                    yield from step(item[1], state, item[2])
        elif item[0] == "at":
            _, i, state = item
            if INSERT in final:
                yield ("at", i, STEPS[state, MADE[state]]), (item, INSERT)
            if i == n and state in ENDS:
                yield GOAL, (item,)
            for e in "DKR" if i < n else "":
                if ("edit", i, e) in final:
                    yield from step(i, state, e)

    final = lightest(axioms, rules, goals)
    return {g: final[g] for g in goals if g in final}


Spans = dict[tuple[int, int], Value]


def block_spans(rows: list[Face]) -> Spans:
    """The lightest derivations of a block's rows from each state to each that can be reached."""
    ends = [("at", len(rows), t) for t in range(4)]
    return {(s, g[2]): v for s in range(4) for g, v in derivations(rows, s, ends).items()}


def joined(blocks: list[Spans]) -> Spans:
    """The lightest derivations over blocks that follow each other. Neighbours are joined in pairs, so that an audit is copied as often
    as the number of blocks has binary digits."""

    def rules(item: tuple, final: dict):
        _, i, s, t = item
        for x in range(4) if i < 2 else ():
            first, second = (item, ("span", 1, t, x)) if i == 0 else (("span", 0, x, s), item)
            if first in final and second in final:
                yield ("span", 2, first[2], second[3]), (first, second)

    whole = [("span", 2, s, t) for s in range(4) for t in range(4)]
    while len(blocks) > 1:
        pairs = []
        for a, b in zip(blocks[::2], blocks[1::2], strict=False):
            final = lightest({("span", k, s, t): v for k, x in enumerate((a, b)) for (s, t), v in x.items()}, rules, whole)
            pairs.append({g[2:]: final[g] for g in whole if g in final})
        blocks = pairs + blocks[len(pairs) * 2 :]
    return blocks[0]


def spans_of(rows: list[Face]) -> Spans:
    return joined([block_spans(rows[i : i + BLOCK]) for i in range(0, max(1, len(rows)), BLOCK)])


def best_repair(rows: list[Face]) -> Value:
    """The lightest derivation of a whole conversation."""
    if len(rows) <= BLOCK:
        return derivations(rows, 0, [GOAL])[GOAL]
    return best_end(spans_of(rows))


def best_end(spans: Spans) -> Value:
    return min(v for (s, t), v in spans.items() if s == 0 and t in ENDS)


class Conversation:
    """Reads a conversation's rows in order: counts its faults, and applies an audit to it."""

    def __init__(self, audit: str, full: bool):
        self.audit, self.place, self.state, self.digest = audit, 0, 0, hashlib.sha256()
        self.lines: list[str] | None = [] if full else None
        self.low = self.high = self.initial = None
        self.written = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def write(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((f"\n{line}" if self.written else line).encode())
        self.written += 1
        if self.lines is not None:
            self.lines.append(line)
        self.state = STEPS[self.state, role[0]]

    def insert(self) -> None:
        while self.audit[self.place : self.place + 1] == "I":
            self.write(ROLES[MADE[self.state]], "")
            self.place += 1

    def row(self, turn: int | None, role: str, text: str, blank: bool, again: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in PAIRS
        self.initial = role[:1]
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again
        self.insert()
        e, self.place = self.audit[self.place], self.place + 1
        if e != "D":
            self.write(role if e == "K" else ROLES[MADE[self.state]], text)

    def result(self, cost: int) -> tuple:
        self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit, self.digest.hexdigest(), self.lines


def whole_result(rows: list[tuple], full: bool) -> tuple:
    """The result of one conversation from its rows in order: (turn, role, text, blank, truncated)."""
    seen, found = set(), []
    for turn, role, text, blank, cut in rows:
        found.append((turn, role, text, blank, (role, text) in seen, cut))
        seen.add((role, text))
    cost, audit = best_repair([(role[:1], blank or again, cut) for _, role, _, blank, again, cut in found])
    out = Conversation(audit, full)
    for r in found:
        out.row(*r)
    return out.result(cost)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]
_RESULT_TYPE = pa.struct([(c, pa.int64()) for c in RESULT[:6]] + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.string()))])
_ROW_TYPE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("cut", pa.bool_()), ("seq", pa.int64()), ("live", pa.bool_())])
_RESULT_SQL = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string,repaired_sha256:string,repaired:array<string>>"
_ROW_SQL = "struct<turn:long,role:string,text:string,blank:boolean,cut:boolean,seq:long,live:boolean>"


def checked(rows: DataFrame, live: Column) -> DataFrame:
    """(conv, turn, role, text, blank, cut, seq, live), written: rows with their own faults. conv: the id as text, a null told from an
    empty one; seq tells equal rows apart, and as it is written it stays."""
    spaces = F.lit("\x20\x09\x0a\x0b\x0c\x0d")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    given = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), live.alias("live"))
    stripped = F.rtrim(F.col("text"), spaces)
    return keep(given.select("conv", "turn", "role", "text", (stripped == "").alias("blank"), ((stripped != "") & ~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("seq"), "live"), "turns")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def repair(rows: DataFrame, live: Column | None = None, *, full: bool = True) -> DataFrame:
    """A row for each conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) and, if full,
    repaired: its lines `role:text`. rows: (conv_id, turn, role, text); live: whether a row counts."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = checked(rows, F.lit(True) if live is None else live)
    order = ["conv", "turn", "role", "text", "seq"]
    columns = ["turn", "role", "text", "blank", "cut", "seq", "live"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        conv, opened = None, True  # the first conversation may have begun in another range
        for c, *r in _each(batches):
            if conv is not None and c != conv:
                if not opened:
                    yield conv, None, dict(zip(RESULT, whole_result([x[:5] for x in held if x[6]], full), strict=True))
                held, opened = [], False
            conv = c
            held.append(tuple(r))
            if opened or len(held) > LONG:
                opened = True
                yield from ((conv, dict(zip(columns, x, strict=True)), None) for x in held)
                held = []
        yield from ((conv, dict(zip(columns, x, strict=True)), None) for x in held)  # the last may go on in another range

    schema = pa.schema([("conv", pa.string()), ("row", _ROW_TYPE), ("result", _RESULT_TYPE)])
    ranges = rows.select("conv", *columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    both = keep(ranges.mapInArrow(lambda b: _batches(results(b), schema), f"conv string, row {_ROW_SQL}, result {_RESULT_SQL}"), "repair")
    done = both.where("row IS NULL").select("conv", "result").unionByName(repair_open(both.where("row IS NOT NULL").select("conv", "row.*"), full))
    out = done.select(F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id"), "result.*")
    return out if full else out.drop("repaired")


def repair_open(rows: DataFrame, full: bool) -> DataFrame:
    """(conv, result) of conversations in any number of rows, by blocks."""
    name = F.md5(F.concat_ws("|", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = rows.withColumns({"name": name, "place": F.struct("turn", "seq")})
    first = rows.where("live AND NOT blank").groupBy("conv", "name").agg(F.min("place").alias("first"))
    flagged = rows.join(first, ["conv", "name"], "left").withColumn("again", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    flagged = flagged.select("conv", "turn", "role", "text", "blank", "again", "cut", "seq", "live")
    numbered = keep(row_index(flagged, [F.col("turn"), F.col("role"), F.col("text"), F.col("seq")], ["conv"]), "open")

    def spans(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        found = spans_of(list(zip(group["initial"], group["faulty"], group["cut"], strict=True)))
        keys = sorted(found)
        one = [group["conv"].iloc[0], int(group["block"].iloc[0]), [s * 4 + t for s, t in keys], [found[k][0] for k in keys], [found[k][1] for k in keys]]
        return pd.DataFrame([one], columns=["conv", "idx", "ways", "costs", "audits"])

    faces = numbered.where("live").select("conv", F.floor(F.col("idx") / LONG).cast("long").alias("block"), "idx", F.left("role", F.lit(1)).alias("initial"), (F.col("blank") | F.col("again")).alias("faulty"), "cut")
    blocks = faces.groupBy("conv", "block").applyInPandas(spans, "conv string, idx long, ways array<int>, costs array<long>, audits array<string>")
    read = ["turn", "role", "text", "blank", "again", "cut"]
    both = numbered.select("conv", F.lit(1).alias("phase"), "idx", *read, "live").unionByName(blocks.withColumn("phase", F.lit(0)), allowMissingColumns=True)
    both = both.select("conv", "phase", "idx", "ways", "costs", "audits", *read, "live").repartition("conv").sortWithinPartitions("conv", "phase", "idx")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A conversation's blocks come before its rows."""
        conv, blocks, now, cost = None, [], None, 0

        def ended():
            return conv, dict(zip(RESULT, (now or Conversation("", full)).result(cost), strict=True))

        for c, phase, _, ways, costs, audits, *r in _each(batches):
            if c != conv:
                if conv is not None:
                    yield ended()
                conv, blocks, now, cost = c, [], None, 0
            if phase == 0:
                blocks.append({divmod(w, 4): (x, a) for w, x, a in zip(ways, costs, audits, strict=True)})
            elif r[-1]:
                if now is None:
                    cost, audit = best_end(joined(blocks))
                    now, blocks = Conversation(audit, full), []
                now.row(*r[:-1])
        if conv is not None:
            yield ended()

    schema = pa.schema([("conv", pa.string()), ("result", _RESULT_TYPE)])
    return both.mapInArrow(lambda b: _batches(results(b), schema), f"conv string, result {_RESULT_SQL}")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): conversations with planted faults, by a hash of each row's place."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(name.cast("binary")) % 20
    given = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return given.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") != 0).alias("live"), times.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows, F.col("live"), full=False)
