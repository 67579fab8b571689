"""Repair of conversations: the cheapest edits that make the roles follow (system? (user assistant)+)?.

A conversation is a chain of layers, one before each row, with a node for each state of the role pattern. An edit of a
row is an arc to the next layer, an inserted turn one within a layer. Minimum costs from the start (forward) and to the
end (backward) tell which arcs lie on a cheapest path: the tight ones. From the start a frontier of states follows
the tight arcs of the least letter until the end, which spells the least of all cheapest edit strings.

A long conversation is cut into fragments. The costs through a fragment are a matrix over its first and last state;
products of these (minimum, plus) give each fragment its forward and backward costs, and then fragments are walked on
their own, once for each state that they may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.llm.common import materialize

#: Conversations with more rows or bytes are cut into fragments of at most 2 ** FRAGMENT_BITS rows.
LONG_ROWS, LONG_BYTES, FRAGMENT_BITS = 4096, 1 << 24, 16
WHITE = " \t\n\x0b\x0c\r"
INF = 1 << 60
#: Role initials; any other role is OTHER. Faults of a row.
INITIALS, OTHER = "sua", 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Which follows by which role.
FOLLOWS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
START, ENDS = (0, INF, INF, INF), (0, INF, INF, 0)
ROLES = (None, "system", "user", "assistant")
DELETE, REROLE, INSERT, UNENDED = 2, 1, 5, 5
#: Pairs of role initials that may stand next to each other.
LEGAL = {"su", "ua", "au"}


def _arcs(initial: int, fault: int) -> tuple:
    """(letter, state, next state, cost) of all edits of such a row, by letter."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if fault in (NONE, TRUNCATED):
        more = UNENDED * (fault == TRUNCATED)
        arcs += [("K", q, to, more) for (q, role), to in FOLLOWS.items() if role == initial]
        arcs += [("R", q, to, REROLE + more) for (q, role), to in FOLLOWS.items() if role > 0]
    return tuple(arcs)


ROW_ARCS = [_arcs(code >> 2, code & 3) for code in range(16)]
INSERTS = tuple(("I", q, to, INSERT) for (q, role), to in FOLLOWS.items() if role > 0)


def _opened(costs: tuple) -> tuple:
    """Costs from the start with the turns that may be inserted in a layer."""
    a, b, c, d = costs
    c = min(c, a + INSERT, b + INSERT, d + INSERT)
    return a, b, c, min(d, c + INSERT)


def _closed(costs: tuple) -> tuple:
    """Costs to the end with the turns that may be inserted in a layer."""
    a, b, c, d = costs
    c, d = min(c, d + INSERT), min(d, c + INSERT)
    return min(a, c + INSERT), min(b, c + INSERT), c, d


def forward(codes: list[int], more: list[int], costs: tuple) -> tuple[list[tuple], tuple]:
    """Costs from the start at each layer, and at the end before anything is inserted there. more: further copies of each
    row, which are deleted."""
    layers = []
    for code, copies in zip(codes, more, strict=True):
        costs = _opened(costs)
        layers.append(costs)
        new = [INF] * 4
        for _, q, to, cost in ROW_ARCS[code]:
            if costs[q] + cost < new[to]:
                new[to] = costs[q] + cost
        costs = tuple(x + DELETE * copies for x in new) if copies else tuple(new)
    return layers, costs


def backward(codes: list[int], more: list[int], costs: tuple) -> list[tuple]:
    """Costs to the end at each layer, the last one (given) included."""
    layers = [costs]
    for code, copies in zip(reversed(codes), reversed(more), strict=True):
        new = [INF] * 4
        for _, q, to, cost in ROW_ARCS[code]:
            if costs[to] + cost < new[q]:
                new[q] = costs[to] + cost
        costs = _closed(tuple(x + DELETE * copies for x in new) if copies else tuple(new))
        layers.append(costs)
    return layers[::-1]


def walk(codes: list[int], more: list[int], ahead: list[tuple], behind: list[tuple], total: int, frontier: set[int]) -> tuple[str, set[int]]:
    """The least letters along tight arcs from the frontier (states in the first layer) to the last layer, and the states
    reached. Letters of further copies are left out."""
    letters = []
    for k, code in enumerate(codes):
        letter = "I"
        while letter == "I":
            tight = [(x, to) for x, q, to, cost in INSERTS if q in frontier and ahead[k][q] + cost + behind[k][to] == total]
            rest = total - DELETE * more[k]
            tight += [(x, to) for x, q, to, cost in ROW_ARCS[code] if q in frontier and ahead[k][q] + cost + behind[k + 1][to] == rest]
            letter = min(x for x, _ in tight)
            frontier = {to for x, to in tight if x == letter}
            letters.append(letter)
    return "".join(letters), frontier


def last_inserts(state: int) -> str:
    """Turns inserted after all rows."""
    return {1: "II", 2: "I"}.get(state, "")


def cheapest(codes: list[int]) -> tuple[int, str]:
    """Cost and letters of a whole conversation."""
    more = [0] * len(codes)
    ahead, end = forward(codes, more, START)
    behind = backward(codes, more, _closed(ENDS))
    total = min(a + b for a, b in zip(end, behind[-1], strict=True))
    letters, (state,) = walk(codes, more, ahead, behind, total, {0})
    return total, letters + last_inserts(state)


class Repair:
    """Follows a conversation's letters row by row and takes up the repaired turns."""

    def __init__(self, keep: bool):
        self.state, self.digest, self.turns, self.n, self.keep = 0, hashlib.sha256(), [], 0, keep

    def _turn(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * (self.n > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if self.keep:
            self.turns.append((self.n, role, text))
        self.n += 1

    def insert(self) -> None:
        self.state = FOLLOWS[self.state, 2 if self.state == 2 else 1]
        self._turn(ROLES[self.state], "")

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "D":
            return
        self.state = FOLLOWS[self.state, INITIALS.index(role[:1]) if letter == "K" else 2 if self.state == 2 else 1]
        self._turn(role if letter == "K" else ROLES[self.state], text)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage by the rows' own checksum: of twenty equal shares one is dropped
    (copies 0), one emptied, one loses its [.!?], one repeated (copies 2) and one given the user role. Null roles and
    texts, and nulls in the checksum's key, are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """rows with ``mark`` (orders rows of one turn and role), ``initial`` and ``fault`` but for duplicates."""
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    last = F.substring(ended, -1, 1)
    fault = F.when(ended == "", BLANK).when(last.isin(*".!?"), NONE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    return rows.withColumns({"mark": F.unhex(F.md5("text")), "initial": number.cast("int"), "fault": fault.cast("int")})


def _groups(batches: Iterator[pa.RecordBatch], key) -> Iterator[tuple]:
    """(key, iterator of row dicts) of the rows that follow each other with one key; a few thousand rows are held."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                yield from batch.slice(begin, 1024).to_pylist()

    return groupby(rows(), key=key)


def _illegal(initials: list[int]) -> int:
    return sum((INITIALS + " ")[a] + (INITIALS + " ")[b] not in LEGAL for a, b in zip(initials, initials[1:]))


def _facts_schema(id_type: str) -> str:
    longs = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return f"conv_id {id_type}, {longs}, audit string, repaired_sha256 string, place long, role string, text string"


FACTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _kind(id_type: pa.DataType) -> pa.Schema:
    longs = [(n, pa.int64()) for n in FACTS[1:7]]
    return pa.schema([("conv_id", id_type), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _out(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 1024 and about 8 MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or "") + len(r[7] or "")
        if len(held) == 1024 or size > 1 << 23:
            yield _batch(held, kind)
            held, size = [], 0
    if held:
        yield _batch(held, kind)


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Whole conversations, each in one task: their facts (place null) and, if asked for, their repaired turns."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def repair(conv_id, own: Iterator[dict]) -> Iterator[tuple]:
        codes, initials, held, seen, counts, numbers = [], [], [], set(), [0] * 4, []
        for r in own:
            if r["copies"] and r["turn"] is not None:
                numbers.append(r["turn"])
            for _ in range(r["copies"]):
                name = (r["role"], r["text"])
                fault = r["fault"] if r["fault"] == BLANK or name not in seen else DUPLICATE
                seen.add(name)
                counts[fault] += 1
                codes.append(r["initial"] << 2 | fault)
                initials.append(r["initial"])
                held.append(name)
        cost, audit = cheapest(codes)
        found, k = Repair(turns), 0
        for letter in audit:
            if letter == "I":
                found.insert()
            else:
                found.row(letter, *held[k])
                k += 1
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield conv_id, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], _illegal(initials), cost, audit, found.digest.hexdigest(), None, None, None
        for place, role, text in found.turns:
            yield conv_id, *[None] * 8, place, role, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            again = (b for part in ([first], batches) for b in part)
            found = (x for conv_id, own in _groups(again, lambda r: r["conv_id"]) for x in repair(conv_id, own))
            yield from _out(found, _kind(first["conv_id"].type))

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark")
    return ordered.select("conv_id", "turn", "role", "text", "copies", "initial", "fault").mapInArrow(run, _facts_schema(id_type))


def _same(a: str, b: str, names: list[str]) -> Column:
    found = F.lit(True)
    for n in names:
        found = found & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return found


def _fragments(codes: DataFrame) -> DataFrame:
    """conv_id, fragment, codes, more, matrix, first, last, illegal from rows (conv_id, fragment, pos, initial, fault, n)."""
    id_type = codes.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        again = (b for part in ([first], batches) for b in part)
        for (conv_id, fragment), own in _groups(again, lambda r: (r["conv_id"], r["fragment"])):
            held = [(r["initial"], r["fault"], r["n"]) for r in own]
            code, more, initials = [i << 2 | f for i, f, _ in held], [n - 1 for *_, n in held], [i for i, *_ in held]
            matrix = [x for q in range(4) for x in forward(code, more, tuple(0 if k == q else INF for k in range(4)))[1]]
            arrays = [[conv_id], [fragment], [bytes(code)], [more], [matrix], [initials[0]], [initials[-1]], [_illegal(initials) + sum(more)]]
            kinds = [first["conv_id"].type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], ["conv_id", "fragment", "codes", "more", "matrix", "first", "last", "illegal"])

    ordered = codes.repartition("conv_id", "fragment").sortWithinPartitions("conv_id", "fragment", "pos")
    return ordered.mapInArrow(run, f"conv_id {id_type}, fragment long, codes binary, more array<long>, matrix array<long>, first long, last long, illegal long")


def _costs(fragments: DataFrame) -> DataFrame:
    """conv_id, fragment, ahead (costs from the start), behind (to the end), cost, illegal of the whole conversation."""
    id_type = fragments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        again = (b for part in ([first], batches) for b in part)
        for conv_id, own in _groups(again, lambda r: r["conv_id"]):
            held = [(r["fragment"], [r["matrix"][4 * q : 4 * q + 4] for q in range(4)], r["first"], r["last"], r["illegal"]) for r in own]
            costs, ahead = START, []
            for _, m, *_ in held:
                ahead.append(costs)
                costs = tuple(min(INF, *(costs[q] + m[q][to] for q in range(4))) for to in range(4))
            end = _closed(ENDS)
            total = min(a + b for a, b in zip(costs, end, strict=True))
            behind = []
            for _, m, *_ in reversed(held):
                behind.append(end)
                end = tuple(min(INF, *(m[q][to] + end[to] for to in range(4))) for q in range(4))
            illegal = sum(h[4] for h in held) + sum(_illegal([a[3], b[2]]) for a, b in zip(held, held[1:]))
            n = len(held)
            arrays = [[conv_id] * n, [h[0] for h in held], ahead, behind[::-1], [total] * n, [illegal] * n]
            kinds = [first["conv_id"].type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], ["conv_id", "fragment", "ahead", "behind", "cost", "illegal"])

    ordered = fragments.select("conv_id", "fragment", "matrix", "first", "last", "illegal").repartition("conv_id").sortWithinPartitions("conv_id", "fragment")
    return ordered.mapInArrow(run, f"conv_id {id_type}, fragment long, ahead array<long>, behind array<long>, cost long, illegal long")


def _walks(known: DataFrame) -> DataFrame:
    """conv_id, fragment, cost, illegal, walks: for each state that the fragment may be entered in, the letters."""
    id_type = known.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                codes, more, walks = list(r["codes"]), r["more"], [None] * 4
                ahead = forward(codes, more, tuple(r["ahead"]))[0]
                behind = backward(codes, more, tuple(r["behind"]))
                for q in range(4):
                    if r["ahead"][q] + behind[0][q] == r["cost"]:
                        walks[q] = walk(codes, more, ahead, behind, r["cost"], {q})[0]
                arrays = [batch["conv_id"].slice(k, 1), pa.array([r["fragment"]], pa.int64()), pa.array([r["cost"]], pa.int64()), pa.array([r["illegal"]], pa.int64()), pa.array([walks], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "fragment", "cost", "illegal", "walks"])

    return known.select("conv_id", "fragment", "codes", "more", "ahead", "behind", "cost", "illegal").mapInArrow(run, f"conv_id {id_type}, fragment long, cost long, illegal long, walks array<string>")


def _long(rows: DataFrame, turns: bool) -> DataFrame:
    """As _short, for conversations of any length. Equal rows of a turn are counted first, rows are dealt by ranges of
    conversation, turn, role and mark, and only the last step, whose digest and edit string are one sequence by
    definition, has a whole conversation in one task: it reads it in order and holds a batch of it and its letters."""
    spark, id_type = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    left = rows.filter("copies > 0")
    counted = left.groupBy("conv_id", "turn", "role", "mark", "text", "initial", "fault").agg(F.sum("copies").alias("n"))
    counted = materialize(counted, "counted-turns")
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    firsts = materialize(counted.groupBy("conv_id", "role", "mark", "text").agg(F.min(place).alias("begin")), "first-turns")
    joined = counted.alias("a").join(firsts.alias("b"), _same("a", "b", ["conv_id", "role", "mark", "text"]))
    fault = F.when((F.col("a.fault") != BLANK) & (place != F.col("b.begin")), DUPLICATE).otherwise(F.col("a.fault"))
    coded = joined.select(*[F.col(f"a.{c}").alias(c) for c in counted.columns if c != "fault"], fault.cast("int").alias("fault"))
    ordered = coded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "role", "mark").sortWithinPartitions("conv_id", "turn", "role", "mark")
    ordered = materialize(ordered.withColumn("pos", F.monotonically_increasing_id()).withColumn("fragment", F.shiftright("pos", FRAGMENT_BITS)), "ordered-turns")

    fragments = materialize(_fragments(ordered.select("conv_id", "fragment", "pos", "initial", "fault", "n")), "fragments")
    costs = _costs(fragments)
    known = fragments.drop("illegal").alias("a").join(costs.alias("b"), _same("a", "b", ["conv_id", "fragment"]))
    known = known.select(*[F.col(f"a.{c}").alias(c) for c in ("conv_id", "fragment", "codes", "more")], *[F.col(f"b.{c}").alias(c) for c in ("ahead", "behind", "cost", "illegal")])
    heads = _walks(known).withColumn("pos", F.lit(-1).cast("long"))

    def repair(conv_id, own: Iterator[dict]) -> Iterator[tuple]:
        found, audit, letters, cost, illegal = Repair(turns), [], iter(()), 0, 0
        for r in own:
            if r["pos"] < 0:
                letters, cost, illegal = iter(r["walks"][found.state]), r["cost"], r["illegal"]
                continue
            letter = next(letters)
            while letter == "I":
                found.insert()
                audit.append("I")
                letter = next(letters)
            found.row(letter, r["role"], r["text"])
            audit.append(letter + "D" * (r["n"] - 1))
            for t in found.turns:
                yield conv_id, *[None] * 8, *t
            found.turns.clear()
        for _ in last_inserts(found.state):
            found.insert()
            audit.append("I")
        yield conv_id, None, None, None, None, illegal, cost, "".join(audit), found.digest.hexdigest(), None, None, None
        for t in found.turns:
            yield conv_id, *[None] * 8, *t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            again = (b for part in ([first], batches) for b in part)
            found = (x for conv_id, own in _groups(again, lambda r: r["conv_id"]) for x in repair(conv_id, own))
            yield from _out(found, _kind(first["conv_id"].type))

    texts = ordered.select("conv_id", "fragment", "pos", "role", "text", "n")
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "fragment", "pos")
    repaired = stream.select("conv_id", "fragment", "pos", "role", "text", "n", "walks", "cost", "illegal").mapInArrow(run, _facts_schema(id_type))
    counts = {
        "blank": F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)),
        "duplicate": F.sum(F.when(F.col("fault") == DUPLICATE, F.col("n")).when(F.col("fault") == BLANK, 0).otherwise(F.col("n") - 1)),
        "truncated": F.sum(F.when(F.col("fault") == TRUNCATED, 1).otherwise(0)),
    }
    by_turn = ordered.groupBy("conv_id", "turn").agg(*[v.alias(k) for k, v in counts.items()])
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = by_turn.groupBy("conv_id").agg(span, *[F.sum(k).alias(k) for k in counts])
    both = repaired.drop("gaps", *counts).alias("a").join(facts.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.place").isNull(), "left")
    own = {"gaps", *counts}
    return both.select(*[F.col(f"{'b' if c in own else 'a'}.{c}").alias(c) for c in [*FACTS, "place", "role", "text"]])


def repair_conversations(rows: DataFrame, turns: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    With turns, place, role and text too, and after it a row for each repaired turn (place from 0; the facts null).

    rows: conv_id, turn, role, text, copies (0: only says that the conversation exists). Rows of a conversation are
    taken by turn, nulls first, and within a turn by role and digest of the text. Null conv_ids are one conversation.
    Null roles and texts count as one space. Conversations without rows that count have zeros, an empty audit and the
    digest of an empty string. Empty and very long texts, ties and repeated rows are ordinary rows; an empty table gives
    an empty result; other columns are not read, so none clashes.

    Conversations of up to long_rows rows and long_bytes bytes are each repaired in one task. Longer ones are cut (see
    _long), also where a third of all rows are one conversation.
    """
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    sizes = held.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("copies") > 0, F.octet_length("text"))).alias("bytes"))
    large = materialize(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id"), "long-conversations")
    held = _marked(held)
    if large.isEmpty():
        out = _short(held, turns)
    else:
        is_large = held["conv_id"].eqNullSafe(large["conv_id"])
        out = _short(held.join(large, is_large, "left_anti"), turns).unionByName(_long(held.join(large, is_large, "left_semi"), turns))
    return out if turns else out.select(FACTS)
