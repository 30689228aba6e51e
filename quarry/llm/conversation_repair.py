"""Conversation structure repair: the cheapest edits that make role initials ``(s?(ua)+)?``.

A conversation's turns and the states of the grammar span a lattice: a node is a
number of turns read and a state; edits are its edges (Keep 0, Rerole 3, Delete
4, Insert 3; a truncated turn that stays adds 3; blank and repeated turns can
only be deleted). It is searched by bidirectional Dijkstra: a forward and a
reverse heap run until their least costs together exceed the best crossing, so
that all crossings of equal cost are complete, and of these the least
concatenated audit (the edits' initials) wins. Keep is free, so nodes of equal
cost leave a heap in the order of turns (forward) or against it (reverse): every
label is final when its node is settled. Two edit sequences of one cost to one
node never are prefixes of each other, as they differ by an insertion at least
and that costs; hence least parts make a least whole.

Conversations of at most ``LONG`` turns are repaired whole, each in one task.
A longer one (a conversation may hold a third of all rows) is cut by ranges of
turns into blocks of ``LONG`` turns in many tasks: repeated turns are found by an
aggregation, each block is searched from each state to each, and the same search
joins the blocks, which are some 16 bytes a turn. Its digest is one SHA-256, so
its repaired turns pass through one task as a sorted stream.

Defined cases: turns are taken in order of turn (nulls first), and of equal
turns by role and text. Null role and text are one space, whose initial is no
role's. Rows of null conv_id are one conversation; repeated rows are repeated
turns; extra columns are ignored; an empty table gives an empty result. A
conversation without turns has zeros, an empty audit and the hash of no bytes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; with the next initials that the grammar allows.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
BEFORE = tuple([(q, c) for q, allowed in enumerate(NEXT) for c, r in allowed.items() if r == state] for state in range(4))
#: States in which a conversation may end.
ENDS = (0, 3)
NAME = {"u": "user", "a": "assistant"}
#: Turns that are searched at once.
LONG = 1000
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

Edge = tuple[int, int, str]
#: A turn as the search sees it: its role's initial, whether it must go, and whether it is truncated.
Fact = tuple[str, bool, bool]


def meet(begin: int, ends: Iterable[int], ahead: Callable[[int], Iterable[Edge]], behind: Callable[[int], Iterable[Edge]]) -> tuple[int, str] | None:
    """The least (cost, audit) from ``begin`` to one of ``ends``, or None. Nodes are 4 * layer + state; free edges lead to the next layer."""
    ends = list(ends)
    if begin in ends:
        return 0, ""
    steps = (ahead, behind)
    labels: tuple[dict[int, tuple[int, str]], ...] = ({begin: (0, "")}, {e: (0, "") for e in ends})
    heaps = ([(0, begin // 4, begin)], [(0, -(e // 4), e) for e in ends])
    settled: tuple[set[int], set[int]] = (set(), set())
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(len(heaps[1]) < len(heaps[0]))
        own, other = labels[side], labels[1 - side]
        cost, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        audit = own[node][1]
        for to, price, letters in steps[side](node):
            label = (cost + price, letters + audit if side else audit + letters)
            old = own.get(to)
            if old is None or label < old:
                own[to] = label
                if old is None or label[0] < old[0]:
                    heapq.heappush(heaps[side], (label[0], -(to // 4) if side else to // 4, to))
            if to in other:
                best = min(best, label[0] + other[to][0])
    found = []
    for node in settled[0]:
        cost, audit = labels[0][node]
        if node in settled[1] and cost + labels[1][node][0] == best:
            found.append(audit + labels[1][node][1])
        for to, price, letters in ahead(node):
            if to in settled[1] and cost + price + labels[1][to][0] == best:
                found.append(audit + letters + labels[1][to][1])
    return (int(best), min(found)) if found else None


def turn_edges(facts: list[Fact]) -> tuple[Callable[[int], Iterator[Edge]], Callable[[int], Iterator[Edge]]]:
    """The edits from a node and those to it."""

    def edit(q: int, c: str, fact: Fact) -> tuple[int, str] | None:
        initial, must_go, cut = fact
        if must_go or (c == "s" and initial != "s"):
            return None
        return (KEEP + CUT * cut, "K") if c == initial else (REROLE + CUT * cut, "R")

    def ahead(node: int) -> Iterator[Edge]:
        i, q = divmod(node, 4)
        for c, r in NEXT[q].items():
            if c in NAME:
                yield 4 * i + r, INSERT, "I"
            if i < len(facts) and (e := edit(q, c, facts[i])):
                yield 4 * (i + 1) + r, *e
        if i < len(facts):
            yield node + 4, DELETE, "D"

    def behind(node: int) -> Iterator[Edge]:
        i, r = divmod(node, 4)
        for q, c in BEFORE[r]:
            if c in NAME:
                yield 4 * i + q, INSERT, "I"
            if i and (e := edit(q, c, facts[i - 1])):
                yield 4 * (i - 1) + q, *e
        if i:
            yield node - 4, DELETE, "D"

    return ahead, behind


def cheapest(facts: list[Fact]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    found = meet(0, [4 * len(facts) + q for q in ENDS], *turn_edges(facts))
    assert found  # all turns may be deleted
    return found


def crossings(facts: list[Fact]) -> list[tuple[int, str] | None]:
    """Of a block: the cheapest edits from state p to state q at index 4 * p + q."""
    edges = turn_edges(facts)
    return [meet(p, [4 * len(facts) + q], *edges) for p in range(4) for q in range(4)]


def cheapest_of_blocks(blocks: list[list[tuple[int, str] | None]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its blocks' crossings."""

    def ahead(node: int) -> Iterator[Edge]:
        i, p = divmod(node, 4)
        if i < len(blocks):
            for q in range(4):
                if x := blocks[i][4 * p + q]:
                    yield 4 * (i + 1) + q, *x

    def behind(node: int) -> Iterator[Edge]:
        i, q = divmod(node, 4)
        if i:
            for p in range(4):
                if x := blocks[i - 1][4 * p + q]:
                    yield 4 * (i - 1) + p, *x

    found = meet(0, [4 * len(blocks) + q for q in ENDS], ahead, behind)
    assert found
    return found


def fault(text: str, repeated: bool) -> str:
    """A turn's first fault: blank, duplicate, truncated, or none."""
    end = text.rstrip(SPACE)
    return "blank" if not end else "duplicate" if repeated else "truncated" if end[-1] not in ".!?" else ""


def fact(role: str, kind: str) -> Fact:
    return role[:1], kind in ("blank", "duplicate"), kind == "truncated"


class Tally:
    """Counts of a run of turns in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first: str | None = None
        self.last: str | None = None

    def add(self, initial: str, kind: str) -> None:
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial


def apply(audit: Iterable[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, in order; ``turns`` are (role, text)."""
    state = 0
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        c = role[:1] if letter == "K" else next(x for x in NEXT[state] if x in NAME)
        state = NEXT[state][c]
        yield letter, role if letter == "K" else NAME[c], text


def digest(turns: Iterable[tuple[str, str, str]]) -> str:
    h, between = hashlib.sha256(), b""
    for _, role, text in turns:
        h.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return h.hexdigest()


# -- damage --------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the checksum of their key; a dropped row has no copies."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    d = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("how"))
    how = F.col("how")
    return d.select(
        "conv_id",
        "turn",
        F.when(how == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# -- conversations that fit a task ----------------------------------------------

ORDER = ("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows of one conv_id (the first column); a run must be read before the next."""
    yield from groupby(rows, key=lambda r: r[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _whole(turns: list[tuple]) -> tuple[list[tuple[str, str]], list]:
    """A conversation's turns, and gaps, counts, cost and audit."""
    seen: set[tuple[str, str]] = set()
    tally, facts, each = Tally(), [], []
    for _, _, role, text, copies in turns:
        for _ in range(copies):
            kind = fault(text, (role, text) in seen)
            seen.add((role, text))
            tally.add(role[:1], kind)
            facts.append(fact(role, kind))
            each.append((role, text))
    numbers = {t for _, t, _, _, n in turns if n and t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = cheapest(facts)
    return each, [gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit]


def _arrow(ddl: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([("conv_id", id_type), *((n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(",")))])


def _report_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(rows):
            each, numbers = _whole(list(turns))
            yield conv, *numbers, digest(apply(numbers[-1], iter(each)))

    yield from _typed(batches, run, REPORT + ", repaired_sha256 string")


def _turns_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(rows):
            each, numbers = _whole(list(turns))
            for i, (edit, role, text) in enumerate(apply(numbers[-1], iter(each))):
                yield conv, i, edit, role, text

    yield from _typed(batches, run, TURNS)


def _typed(batches: Iterator[pa.RecordBatch], run: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is not None:
        yield from _batches(run(_rows(chain([first], batches))), _arrow(ddl, first.schema.field(0).type))


TURNS = "position long, edit string, role string, text string"


def _schema(rows: DataFrame, ddl: str) -> str:
    return f"conv_id {dict(rows.dtypes)['conv_id']}, {ddl}"


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select(*ORDER, "copies").repartition("conv_id").sortWithinPartitions(*ORDER)


# -- longer ones ------------------------------------------------------------------


def _order(turn: str) -> Column:
    """A turn as a value whose minimum is the first turn, nulls first."""
    return F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"))


def _marked(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Long conversations' turns, equal ones folded to copies, with ``again``: whether the same role and text came in an earlier turn."""
    rows = rows.filter("copies > 0").groupBy(*ORDER).agg(F.sum("copies").alias("copies"))
    rows = ws.stage(rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "long-turns")
    firsts = rows.groupBy(F.col("conv_id").alias("its_conv"), F.col("key").alias("its_key")).agg(F.min(_order("turn")).alias("came"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("key") == F.col("its_key")), "left")
    return met.select(*ORDER, "copies", (F.col("came").isNotNull() & ~F.col("came").eqNullSafe(_order("turn"))).alias("again"))


BLOCKS = "part int, no long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema: pa.Schema | None = None

        def block(conv: object, no: int, tally: Tally, facts: list[Fact]) -> pa.RecordBatch:
            x = crossings(facts)
            row = [conv, part, no, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.last, [c[0] if c else None for c in x], [c[1] if c else None for c in x]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        first = next(batches, None)
        if first is None:
            return
        schema = _arrow(BLOCKS, first.schema.field(0).type).append(pa.field("costs", pa.list_(pa.int64()))).append(pa.field("audits", pa.list_(pa.string())))
        for conv, turns in _conversations(_rows(chain([first], batches))):
            no, tally, facts = 0, Tally(), []
            for _, _, role, text, copies, again in turns:
                for i in range(copies):
                    kind = fault(text, again or i > 0)
                    tally.add(role[:1], kind)
                    facts.append(fact(role, kind))
                    if len(facts) == size:
                        yield block(conv, no, tally, facts)
                        no, tally, facts = no + 1, Tally(), []
            if facts:
                yield block(conv, no, tally, facts)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of conversations from their blocks in order."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, blocks in _conversations(rows):
            sums, last, parts = [0, 0, 0, 0], None, []
            for b in blocks:
                sums = [x + y for x, y in zip(sums, b[3:7])]
                if last is not None:
                    sums[3] += last + b[7] not in LEGAL
                last = b[8]
                parts.append([None if c is None else (c, a) for c, a in zip(b[9], b[10])])
            yield conv, *sums, *cheapest_of_blocks(parts)

    yield from _typed(batches, run, "blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _stream(last: Callable[[object, Iterator[tuple[str, str, str]]], Iterator[tuple]], ddl: str) -> Callable:
    """Of rows (conv_id, audit, turn, role, text, copies) in which a conversation's audit comes first."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(rows):
            audit = next(turns)[1]
            each = ((role, text) for _, _, _, role, text, n in turns for _ in range(n))
            yield from last(conv, apply(audit, each))

    return lambda batches: _typed(batches, run, ddl)


def _long(rows: DataFrame, ws: Workspace, size: int) -> tuple[DataFrame, DataFrame]:
    """Report (without hash) of long conversations, and their turns behind their audits, sorted."""
    marked = _marked(rows, ws)
    prefix = F.substring("text", 1, 32)  # ranges split even a turn that very many rows share
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = marked.repartitionByRange(parts, "conv_id", "turn", "role", prefix).sortWithinPartitions(*ORDER)
    blocks = ws.stage(spread.mapInArrow(_blocks(size), _schema(rows, f"{BLOCKS}, costs array<long>, audits array<string>")), "blocks")
    counts = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_fold, _schema(rows, "blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    counts = ws.stage(counts, "long-audits")
    numbers = rows.filter("copies > 0").groupBy(F.col("conv_id").alias("its_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = counts.join(numbers, F.col("conv_id").eqNullSafe(F.col("its_conv"))).select("conv_id", *(x.strip().split(" ")[0] for x in REPORT.split(",")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = counts.select("conv_id", "audit", none(dict(rows.dtypes)["turn"]).alias("turn"), none("string").alias("role"), none("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(0).alias("kind"))
    tails = marked.select("conv_id", none("string").alias("audit"), "turn", "role", "text", "copies", F.lit(1).alias("kind"))
    return report, heads.union(tails).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").drop("kind")


def _split(rows: DataFrame, ws: Workspace, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that fit a task, and of those that don't (None if there is none)."""
    rows = rows.select(*ORDER, "copies")
    long = ws.stage(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter(F.col("n") > size).select(F.col("conv_id").alias("its_conv")), "long-ids")
    if long.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("its_conv"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def report(spark: SparkSession, rows: DataFrame, size: int = LONG) -> DataFrame:
    """conv_id, gaps, fault counts, cost, audit and repaired_sha256 of rows as ``damage`` gives them."""
    ws = Workspace(spark, "conversations")
    short, long = _split(rows, ws, size)
    out = _in_order(short).mapInArrow(_report_whole, _schema(rows, REPORT + ", repaired_sha256 string"))
    if long is not None:
        counts, ordered = _long(long, ws, size)
        hashes = ordered.mapInArrow(_stream(lambda conv, turns: iter([(conv, digest(turns))]), "repaired_sha256 string"), _schema(rows, "repaired_sha256 string"))
        hashes = hashes.withColumnRenamed("conv_id", "its_conv")
        out = out.unionByName(counts.join(hashes, F.col("conv_id").eqNullSafe(F.col("its_conv"))).drop("its_conv"))
    return out


def repair(spark: SparkSession, rows: DataFrame, size: int = LONG) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role and text of every turn."""
    ws = Workspace(spark, "conversations")
    short, long = _split(rows, ws, size)
    out = _in_order(short).mapInArrow(_turns_whole, _schema(rows, TURNS))
    if long is not None:
        each = lambda conv, turns: ((conv, i, *t) for i, t in enumerate(turns))
        out = out.union(_long(long, ws, size)[1].mapInArrow(_stream(each, TURNS), _schema(rows, TURNS)))
    return out


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(spark, damage(rows))


def _sql() -> str:
    """The same rows in DuckDB: a fold over turns with the cheapest edits to each state, as text of eight digits and an audit."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = f"xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, y: xor(x >> 8, {table}[xor(x & 255, y) + 1]), 4294967295), 4294967295)"
    add = lambda s, cost, letter: f"CASE WHEN {s} = '~' THEN '~' ELSE lpad(CAST(CAST({s}[1:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || {s}[9:] || '{letter}' END"
    least = lambda *x: f"least({', '.join(x)})"
    v = [f"a[{i}]" for i in range(1, 5)]
    insert = f"[{v[0]}, {v[1]}, {least(v[2], *(add(v[i], 3, 'I') for i in (0, 1, 3)))}, {least(v[3], add(v[2], 3, 'I'), add(v[0], 6, 'II'), add(v[1], 6, 'II'))}]"
    extra = "CAST(x[3] AS BIGINT)"
    stays = lambda s, c: f"CASE WHEN x[2] = 'y' THEN '~' WHEN x[1] = '{c}' THEN {add(s, extra, 'K')} ELSE " + ("'~'" if c == "s" else add(s, f"3 + {extra}", "R")) + " END"
    gone = [add(s, 4, "D") for s in v]
    step = f"[{gone[0]}, {least(gone[1], stays(v[0], 's'))}, {least(gone[2], *(stays(v[i], 'u') for i in (0, 1, 3)))}, {least(gone[3], stays(v[2], 'a'))}]"
    return rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc} % 20 AS how FROM k),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
f AS (SELECT *, role[1:1] AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS e, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS was FROM o),
g AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN again THEN 'd' WHEN NOT contains('.!?', e[-1:]) THEN 't' ELSE '' END AS fault FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list_concat([['gap', '', '']], flatten(list([[i, CASE WHEN fault IN ('b', 'd') THEN 'y' ELSE '' END, CASE WHEN fault = 't' THEN '3' ELSE '0' END], ['gap', '', '']] ORDER BY n))) AS facts FROM g GROUP BY conv_id),
s AS (SELECT *, list_reduce(facts, lambda a, x: CASE WHEN x[1] = 'gap' THEN {insert} ELSE {step} END, ['00000000', '~', '~', '~']) AS best FROM c),
a AS (SELECT *, CAST(least(best[1], best[4])[1:8] AS BIGINT) AS cost, least(best[1], best[4])[9:] AS audit FROM s),
l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS edit FROM a WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
t AS (SELECT m.*, g.role, g.text, max(CASE WHEN place = 1 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS s FROM m LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM m.conv_id AND g.n = m.n),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS whole FROM t WHERE edit <> 'D' GROUP BY conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id
"""


SQL = _sql()
