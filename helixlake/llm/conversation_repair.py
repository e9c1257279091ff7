"""Repair of conversation structure, each distinct signature solved once.

A conversation's turns become a string with one character for each row, which tells the
row's role and its fault. Few such strings differ, so each is solved once, by a memoised
recursion over its suffixes, and the edits are joined back and replayed on the texts.

Rows are put in order by one range partitioning and cut into segments of at most 256, so
that a conversation of any length is many rows. A segment's signature gives the least cost
from each state of the role pattern to each other, and which way is the least in ASCII
where costs are equal. Segments are combined 256 at a time, level by level, until a
conversation is one, and the states chosen then go down the same levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import release, written

#: Rows of a segment, and segments of a group: 2 ** 8.
_BITS = 8
_NONE = 1 << 30
#: States: nothing yet, after system, after user, after assistant. A row put in or renamed is
#: a user's after each of them but a user, then an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: The costs of edits.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: What is left to pay after the last row, and what is put in for it.
_END = (0, 2 * INSERT, INSERT, 0)
_TAIL = {_START: (), _SYSTEM: (_USER, _ASSISTANT), _USER: (_ASSISTANT,), _ASSISTANT: ()}
#: Symbols of a row by its role's initial (s, u, a, other): sound, truncated, blank, duplicate.
_SOUND, _CUT, _BLANK, _AGAIN = "suax", "SUAX", "0123", "4567"

Vector = tuple[int, int, int, int]


def _keep(state: int, symbol: str) -> int | None:
    """The state after a row kept with its role, if the pattern allows it."""
    role = symbol.lower()
    if role == "s":
        return _SYSTEM if state == _START else None
    if role == "u":
        return _USER if state != _USER else None
    return _ASSISTANT if role == "a" and state == _USER else None


def _moves(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a row, in order of letters."""
    yield "D", DELETE, state
    if symbol in _BLANK or symbol in _AGAIN:
        return
    extra = TRUNCATED if symbol in _CUT else 0
    if (kept := _keep(state, symbol)) is not None:
        yield "K", extra, kept
    yield "R", REROLE + extra, _NEXT[state]


def _closed(x) -> Vector:
    """Costs by state if rows may be put in first."""
    user, assistant = min(x[_USER], INSERT + x[_ASSISTANT]), min(x[_ASSISTANT], INSERT + x[_USER])
    return min(x[_START], INSERT + user), min(x[_SYSTEM], INSERT + user), user, assistant


@lru_cache(1 << 16)
def _rest(signature: str, after: Vector) -> Vector:
    """The least cost of a signature from each state, if ``after`` is what follows it."""
    if not signature:
        return after
    then = _rest(signature[1:], after)
    return _closed([min(c + then[q] for _, c, q in _moves(signature[0], p)) for p in range(4)])


def edits(signature: str, state: int, after: Vector) -> tuple[list[tuple[str, int, int]], int]:
    """The cheapest edits, ASCII-least of equals, as (letter, state after, row), and the last state.

    A letter has one state that it leads to, so taking the least letter that keeps the cost
    at its least is the least string. Each edit but an insertion uses up a row.
    """
    out, row = [], 0
    while row < len(signature):
        own, then = _rest(signature[row:], after), _rest(signature[row + 1 :], after)
        ways = [(letter, c + then[q], q) for letter, c, q in _moves(signature[row], state)]
        letter, _, state = min(w for w in [*ways, ("I", INSERT + own[_NEXT[state]], _NEXT[state])] if w[1] == own[state])
        out.append((letter, state, row))
        row += letter != "I"
    return out, state


def _unit(q: int) -> Vector:
    return tuple(0 if i == q else _NONE for i in range(4))  # type: ignore[return-value]


def _ranks(keys: list) -> list[int]:
    order = sorted(k for k in keys if k is not None)
    return [len(order) if k is None else order.index(k) for k in keys]


def ways(signature: str) -> tuple[list[int], list[int]]:
    """For each state before and each after: the least cost, and the rank of its edits among
    those from the same state. No such string begins another, so ranks hold whatever follows."""
    cost, rank = [], []
    for p in range(4):
        own = [min(_NONE, _rest(signature, _unit(q))[p]) for q in range(4)]
        cost += own
        rank += _ranks(["".join(e[0] for e in edits(signature, p, _unit(q))[0]) if own[q] < _NONE else None for q in range(4)])
    return cost, rank


def combined(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The ways through two stretches, one after the other."""
    cost, rank = [], []
    for p in range(4):
        keys = []
        for q in range(4):
            least, first, r = min((one[0][4 * p + r] + two[0][4 * r + q], one[1][4 * p + r], r) for r in range(4))
            cost.append(min(least, _NONE))
            keys.append((first, two[1][4 * r + q]) if least < _NONE else None)
        rank += _ranks(keys)
    return cost, rank


def _before(cost: list[int], after: Vector) -> Vector:
    return tuple(min(min(cost[4 * p + q] + after[q] for q in range(4)), _NONE) for p in range(4))  # type: ignore[return-value]


def _illegal(first: str, second: str) -> bool:
    return first + second not in ("su", "ua", "au")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """signature -> its ways and what its rows tell."""
    role = str.maketrans(_CUT + _BLANK + _AGAIN, _SOUND * 3)
    for batch in batches:
        rows = []
        for s in batch.column(0).to_pylist():
            cost, rank = ways(s)
            roles = s.translate(role)
            count = [sum(s.count(c) for c in kind) for kind in (_BLANK, _AGAIN, _CUT)]
            rows.append((s, cost, rank, *count, sum(map(_illegal, roles, roles[1:])), roles[0], roles[-1]))
        yield _batch(rows, _SOLVED)


_WAYS = "cost array<int>, rank array<int>"
_SOLVED = f"signature string, {_WAYS}, n_blank long, n_duplicate long, n_truncated long, illegal long, first string, last string"
_NODE = f"conv_id long, node long, {_WAYS}, illegal long, first string, last string"
_TASK = "node long, state int, after array<int>, ends boolean"
_EDITS = "signature string, state int, after array<int>, ends boolean, audit string, edits array<struct<letter:string,role:string,row:int>>"
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
    "array<struct<letter:string,role:string,row:int>>": pa.list_(pa.struct([("letter", pa.string()), ("role", pa.string()), ("row", pa.int32())])),
}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _join_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, children in order) -> one node that stands for them."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            kids = r["kids"]
            own, illegal = (kids[0]["cost"], kids[0]["rank"]), kids[0]["illegal"]
            for a, b in zip(kids, kids[1:], strict=False):
                own = combined(own, (b["cost"], b["rank"]))
                illegal += b["illegal"] + _illegal(a["last"], b["first"])
            rows.append((r["conv_id"], kids[0]["node"], *own, illegal, kids[0]["first"], kids[-1]["last"]))
        yield _batch(rows, _NODE)


def _part_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(children in order, state, after, ends) -> the state before each child and what follows it."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            kids, state = r["kids"], r["state"]
            later = [tuple(r["after"])]
            for k in reversed(kids[1:]):
                later.append(_before(k["cost"], later[-1]))
            later.reverse()
            for i, (k, after) in enumerate(zip(kids, later, strict=True)):
                low = min(after)
                rows.append((k["node"], state, [x - low for x in after], r["ends"] and i == len(kids) - 1))
                state = min((k["cost"][4 * state + q] + after[q], k["rank"][4 * state + q], q) for q in range(4))[2]
        yield _batch(rows, _TASK)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (signature, state, after, ends) -> audit and edits."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own, last = edits(r["signature"], r["state"], tuple(r["after"]))
            own += [("I", q, -1) for q in (_TAIL[last] if r["ends"] else ())]
            listed = [{"letter": x, "role": _ROLE[q] if x in "IR" else None, "row": i} for x, q, i in own]
            rows.append((r["signature"], r["state"], r["after"], r["ends"], "".join(x for x, _, _ in own), listed))
        yield _batch(rows, _EDITS)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """A written table of all rows in order, with ``pos`` (0, 1, 2, ...) and ``digest`` of role and text.

    Order is by conv_id, turn (nulls first), then the digest, so ties have an order too.
    Equal rows may lie in several partitions.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\x00"), "text"), 256)))
    by = ["conv_id", "turn", "digest", "_row"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_row")
    dealt = written(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "turns")
    # one row for each partition: where its numbers begin
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.select("_part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("n")).alias("_begin"))
    return dealt.join(F.broadcast(begin), "_part").withColumn("pos", F.col("_begin") + F.col("_at")).drop("_part", "_begin", "_at")


def _segments(rows: DataFrame) -> DataFrame:
    """conv_id, node (its first pos), signature: at most 256 rows in order.

    A first occurrence is a marker row before its own; a row without one is a duplicate.
    """
    space = r"[\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    begins = F.substring("role", 1, 1)
    role = F.when(begins.isin("s", "u", "a"), begins).otherwise("x")
    sound = F.when(blank, F.translate(role, _SOUND, _BLANK)).when(F.col("text").rlike(rf"[.!?]{space}*\z"), role).otherwise(F.upper(role))
    marks = rows.where(~blank).groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit("").alias("symbol"))
    both = rows.select("conv_id", "pos", sound.alias("symbol")).unionAll(marks)
    lists = both.groupBy("conv_id", F.shiftright("pos", _BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("rows"))
    marked = lambda i: F.coalesce(F.get("rows", i - 1)["symbol"] == "", F.lit(False))
    symbol = F.transform("rows", lambda x, i: F.when(marked(i), x["symbol"]).otherwise(F.translate(x["symbol"], _SOUND + _CUT, _AGAIN * 2)))
    return lists.select("conv_id", F.get("rows", 0)["pos"].alias("node"), F.array_join(symbol, "").alias("signature"))


def solve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with audit and edits, what each conversation has), both written.

    ``rows`` come from ``ordered_turns``.
    """
    segment = written(_segments(rows), "segments")
    solved = written(segment.select("signature").distinct().mapInArrow(_solve, _SOLVED), "signatures")
    told = segment.join(solved, "signature")
    # Up: groups of 256 neighbours become one node, until each conversation is one.
    columns = [x.split(" ")[0] for x in _NODE.split(", ")]
    nodes, groups, shift = written(told.select(*columns), "nodes-0"), [], _BITS
    conversations = nodes.select("conv_id").distinct().count()
    while nodes.count() > conversations:
        shift += _BITS
        kid = F.struct("node", *columns[2:])
        group = nodes.groupBy("conv_id", F.shiftright("node", shift).alias("block")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        group = written(group.select("conv_id", F.get("kids", 0)["node"].alias("node"), "kids"), "groups")
        groups.append(group)
        alone = group.where(F.size("kids") == 1).select("conv_id", F.inline("kids")).select(*columns)
        release(nodes)
        nodes = written(alone.unionAll(group.where(F.size("kids") > 1).select("conv_id", "kids").mapInArrow(_join_nodes, _NODE)), "nodes")
    end = F.array(*[F.lit(x) for x in _END])
    total = F.array_min(F.array(*[F.get("cost", q) + F.lit(_END[q]) for q in range(4)])).cast("long")
    zero = F.lit(0).cast("long")
    tells = ["n_blank", "n_duplicate", "n_truncated"]
    has = written(told.select("conv_id", *tells, zero.alias("illegal"), zero.alias("total")).unionAll(nodes.select("conv_id", *[zero] * 3, "illegal", total)).groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in (*tells, "illegal", "total")]), "conversations")
    # Down: the state before each node, and what follows it.
    task = nodes.select("node", F.lit(_START).alias("state"), end.alias("after"), F.lit(True).alias("ends"))
    for group in reversed(groups):
        both = group.join(task, "node")
        alone = both.where(F.size("kids") == 1).select("node", "state", "after", "ends")
        task = written(alone.unionAll(both.where(F.size("kids") > 1).select("kids", "state", "after", "ends").mapInArrow(_part_nodes, _TASK)), "tasks")
    key = ["signature", "state", "after", "ends"]
    asked = written(segment.join(task, "node"), "asked")
    release(nodes, *groups)
    found = asked.select(*key).distinct().mapInArrow(_edit, _EDITS)
    return written(asked.join(found, key).select("conv_id", "node", "audit", "edits"), "edits"), has


def replayed(rows: DataFrame, segment: DataFrame) -> DataFrame:
    """conv_id, node, audit, turns: the repaired turns (role, text, edit) of each segment in order."""
    lists = rows.groupBy("conv_id", F.shiftright("pos", _BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    lists = lists.select(F.get("rows", 0)["pos"].alias("node"), "rows")
    own = lambda e: F.get("rows", e["row"])
    turn = lambda e: F.struct(F.coalesce(e["role"], own(e)["role"]).alias("role"), F.when(e["letter"] == "I", "").otherwise(own(e)["text"]).alias("text"), e["letter"].alias("edit"))
    left = F.filter("edits", lambda e: e["letter"] != "D")
    return segment.join(lists, "node").select("conv_id", "node", "audit", F.transform(left, turn).alias("turns"))


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (an order within the conversation), role, text, edit (K, R or I).

    Role initials of what is left read (s?(ua)+)?, at the least cost; a null role or text is
    one blank, a null conv_id is a conversation, rows without a turn come first, ties are in
    order of a digest of role and text. Repeated rows are duplicates but for the first. Other
    columns are ignored, an empty table gives an empty one, and a text is never cut; 256 rows
    of a conversation are held at once with their texts.
    """
    rows = ordered_turns(turns)
    segment, _ = solve(rows)
    return replayed(rows, segment).select("conv_id", "node", F.posexplode("turns").alias("i", "t")).select("conv_id", (F.shiftleft("node", _BITS + 2) + F.col("i")).alias("place"), "t.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by conversation and place -> audit and SHA-256 of each conversation."""
    own, audit, sha, empty = None, [], None, True

    def out():
        return _batch([(own[0], "".join(audit), sha.hexdigest())], _DIGEST)

    for batch in batches:
        for conv, letters, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if own != (conv,):
                if own is not None:
                    yield out()
                own, audit, sha, empty = (conv,), [], hashlib.sha256(), True
            audit.append(letters)
            if body is not None:
                sha.update(("" if empty else "\n").encode() + body.encode())
                empty = False
    if own is not None:
        yield out()


_DIGEST = "conv_id long, audit string, repaired_sha256 string"


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations of ``ids`` (conv_id) without a row have zeros, an empty audit and the digest
    of nothing. Texts of a conversation meet in order, segment by segment, in one stream, as
    a digest of the whole asks.
    """
    rows = ordered_turns(turns)
    segment, has = solve(rows)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    piece = replayed(rows, segment).select("conv_id", "node", "audit", F.when(F.size("turns") > 0, line).alias("body"))
    digest = piece.repartition("conv_id").sortWithinPartitions("conv_id", "node").mapInArrow(_digest, _DIGEST)
    turn = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id")
    gaps = turn.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    names = ["gaps", "n_blank", "n_duplicate", "n_truncated", "illegal", "total"]
    texts = ["audit", "repaired_sha256"]
    parts = [has, gaps, digest, *([ids.select(F.col("conv_id").cast("long"))] if ids is not None else [])]
    full = [p.select("conv_id", *[(F.col(c) if c in p.columns else F.lit(None).cast("string" if c in texts else "long")).alias(c) for c in names + texts]) for p in parts]
    every = full[0]
    for p in full[1:]:
        every = every.unionAll(p)
    one = every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return one.select("conv_id", "gaps", F.col("n_blank").alias("blank"), F.col("n_duplicate").alias("duplicate"), F.col("n_truncated").alias("truncated"), "illegal", F.col("total").alias("cost"), *texts)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: some dropped, emptied, without
    their ends of sentences, repeated, or given to the user. A null is one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    rows = rows.withColumn("text", F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("_fault") == 3, 2).otherwise(1)
    return rows.withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("conv_id", "turn", "role", "text")
