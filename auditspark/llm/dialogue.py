"""Operator 13: repair of conversations by a generalised LR parser.

The role grammar is  Talk -> [s] Pair+ | empty,  Pair -> u a.  Its LR stacks have four
tops: START (nothing yet), SYSTEM, USER (an open pair) and PAIRS (``u a`` is reduced at
once).  The parser reads a conversation's rows and keeps all stacks at a time: a
graph with one node for each row and top, where every edge is an action on the row
(Keep, Rerole, Delete) after some Inserts.  Stacks with equal tops merge: the one of the
smallest (cost, audit) stays.

Audits up to a row end in that row's action, so none is the beginning of another and
their order never changes by what follows; a node therefore holds its cost and its place
among the nodes of its row instead of the audit itself.  This also makes parsing
divisible: a block of a long conversation is parsed from each of the four tops, which
gives a table of 4 x 4 costs and places, and tables are chained in the order of the
blocks.  Blocks are parsed where their rows are; only the tables of one conversation
meet.  Then each block knows the tops it is entered and left with and writes its piece
of the audit and of the repaired text.
"""

from __future__ import annotations

import hashlib
import json
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import ship, small, table, written

START, SYSTEM, USER, PAIRS = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Shift (and, after ``a``, reduce): top and role initial to the next top.
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIRS}
ACCEPT = (START, PAIRS)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED_FAULT, SOUND = range(4)
#: A block has at most so many rows and, but for its last row, so many characters.
BLOCK_ROWS = 4096
BLOCK_CHARS = 1 << 22
WHITE = " \t\n\x0b\x0c\r"


def _inserts() -> dict[tuple[int, int], str]:
    """The roles of the shortest insertion that leads from one top to another."""
    found = {(top, top): "" for top in range(4)}
    while True:
        more = {(p, SHIFT[q, r]): way + r for (p, q), way in found.items() for r in ROLES if (q, r) in SHIFT and (p, SHIFT[q, r]) not in found}
        if not more:
            return found
        found |= more


INSERTS = _inserts()


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, str, str]]:
    """All ways over one row: from top, to top, cost, letters, roles kept (``.``: the
    row's own)."""
    extra = TRUNCATED_COST if fault == TRUNCATED_FAULT else 0
    out = []
    for (p, q), way in INSERTS.items():
        cost, letters = COST[INSERT] * len(way), INSERT * len(way)
        out.append((p, q, cost + COST[DELETE], letters + DELETE, way))
        if fault in (BLANK, DUPLICATE):
            continue
        if (q, initial) in SHIFT:
            out.append((p, SHIFT[q, initial], cost + COST[KEEP] + extra, letters + KEEP, way + "."))
        out += [(p, SHIFT[q, r], cost + COST[REROLE] + extra, letters + REROLE, way + r.upper()) for r in ROLES if (q, r) in SHIFT]
    return sorted(out, key=lambda m: m[3])


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in range(4)}
ENDINGS = sorted((p, COST[INSERT] * len(way), INSERT * len(way), way) for (p, q), way in INSERTS.items() if q in ACCEPT)


class Stacks:
    """The graph of stacks over one run of rows, entered with one top."""

    def __init__(self, top: int):
        self.tops: dict[int, tuple[int, int]] = {top: (0, 0)}  # top: cost, place among the audits
        self.edges: list[dict[int, tuple]] = []  # for each row, top: the action that leads to it

    def read(self, moves: list[tuple]) -> None:
        best: dict[int, tuple] = {}
        for move in moves:
            p, r, cost, letters, _ = move
            if (own := self.tops.get(p)) is not None:
                key = (own[0] + cost, own[1], letters)
                if r not in best or key < best[r][0]:
                    best[r] = (key, move)
        order = {r: i for i, r in enumerate(sorted(best, key=lambda r: best[r][0][1:]))}
        self.tops = {r: (key[0], order[r]) for r, (key, _) in best.items()}
        self.edges.append({r: move for r, (_, move) in best.items()})

    def back(self, top: int) -> list[tuple]:
        """The actions that lead to ``top``, in order."""
        path = []
        for edges in reversed(self.edges):
            path.append(edges[top])
            top = path[-1][0]
        return path[::-1]


def _end(tops: dict[int, tuple[int, int]]) -> tuple[int, int, str, str]:
    """Cost, last top, letters and roles of the best ending."""
    cost, _, letters, p, way = min((tops[p][0] + c, tops[p][1], letters, p, way) for p, c, letters, way in ENDINGS if p in tops)
    return cost, p, letters, way


def _written(rows: list[tuple], path: list[tuple]) -> tuple[str, list[str]]:
    """Audit and repaired lines of rows (``role``, ``text``, ``moves``, further copies)."""
    audit, lines = [], []
    for (role, text, _, copies), (_, _, _, letters, roles) in zip(rows, path, strict=True):
        audit += [letters, DELETE * copies]
        lines += [f"{ROLES[r]}:" if r in ROLES else f"{role if r == '.' else ROLES[r.lower()]}:{text}" for r in roles]
    return "".join(audit), lines


def _repeated(tops: dict[int, tuple[int, int]], copies: int) -> dict[int, tuple[int, int]]:
    return {r: (cost + COST[DELETE] * copies, place) for r, (cost, place) in tops.items()} if copies else tops


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copies`` after the damage that
    crc32(conv_id:turn) modulo 20 names; equal rows of a turn are one with its count."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return out.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _faulty(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seen``: whether an earlier turn has the same role and text.  Rows that repeat
    are told by digests; only those of pairs that repeat are joined back."""
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    marked = rows.withColumn("digest", digest)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))  # nulls first
    many = marked.groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first < last")
    many = written(many.select("conv_id", "digest", "first"), "repeated-rows").alias("m")
    r = marked.alias("r")
    joined = r.join(small(many, 120), F.col("r.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("r.digest") == F.col("m.digest")), "left")
    seen = F.struct(F.col("r.turn").isNotNull().alias("known"), F.col("r.turn").alias("at")) > F.col("m.first")
    return joined.select("r.conv_id", "r.turn", "r.role", "r.text", "r.copies", F.coalesce(seen, F.lit(False)).alias("seen"))


def _parse(batches):
    """Sorted rows of a task to blocks.  A conversation that begins and ends within the
    task is whole and gets its result at once; of others a block keeps its rows, its table
    of costs and places, and what its counts need of its first and last row."""
    fields = ["conv_id", "block", "whole", "table", "rows", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]

    def stream():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("task", "conv_id", "turn", "role", "text", "copies", "seen")), strict=True)

    def batch(out):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in out], k) for f, k in zip(fields, kinds, strict=True)], fields)

    def block_of(rows):
        stacks = [Stacks(top) for top in range(4)]
        counts, initials, turns, kept = dict.fromkeys(_COUNTS, 0), [], [], []
        for _, _, turn, role, text, copies, seen in rows:
            last = text.rstrip(WHITE)[-1:]
            fault = BLANK if not last else DUPLICATE if seen else SOUND if last in ".!?" else TRUNCATED_FAULT
            if fault != SOUND:
                counts[_COUNTS[fault]] += 1
            counts["blank" if fault == BLANK else "duplicate"] += copies - 1
            initial = role[:1]
            if initials and (initials[-1], initial) not in LEGAL:
                counts["illegal"] += 1
            counts["illegal"] += copies - 1  # no initial may follow itself
            initials.append(initial)
            if turn is not None and (not turns or turn != turns[-1]):
                turns.append(turn)
            key = (initial if initial in ("s", "u", "a") else "", fault)
            for s in stacks:
                s.read(MOVES[key])
                s.tops = _repeated(s.tops, copies - 1)
            kept.append((role, text, key, copies - 1))
        ends = {"initials": [initials[0], initials[-1]], "turns": [turns[0], turns[-1], len(turns)] if turns else None}
        return stacks, counts, ends, kept

    def blocks(rows):
        block, chars = [], 0
        for row in rows:
            if len(block) >= BLOCK_ROWS or chars > BLOCK_CHARS:
                yield block
                block, chars = [], 0
            block.append(row)
            chars += len(row[4])
        yield block

    out, held, size = [], None, 0
    first = True
    for conv, rows in groupby(stream(), key=lambda r: r[1]):
        number = 0
        for rows_of_block in blocks(rows):
            if held is not None:
                out.append(_result(held) if held["whole"] and number == 0 else _open(held))
                if len(out) >= 512 or size > BLOCK_CHARS:
                    yield batch(out)
                    out, size = [], 0
            stacks, counts, ends, kept = block_of(rows_of_block)
            at = {"conv_id": conv, "block": (rows_of_block[0][0] << 32) + number, **counts}
            held = {"at": at, "whole": number == 0 and not first, "stacks": stacks, "ends": ends, "kept": kept}
            number += 1
            size += sum(len(r[4]) for r in rows_of_block)
        first = False
    if held is not None:
        out.append(_open(held))  # the next task may have more of it
    if out:
        yield batch(out)


def _open(held: dict) -> dict:
    """A block of a conversation that may have others."""
    tops = [[list(s.tops.get(r, ())) for r in range(4)] for s in held["stacks"]]
    return held["at"] | {"whole": False, "table": json.dumps({"tops": tops, **held["ends"]}), "rows": json.dumps(held["kept"])}


def _result(held: dict) -> dict:
    """A block that is a whole conversation."""
    stacks, kept, turns = held["stacks"][START], held["kept"], held["ends"]["turns"]
    cost, top, letters, way = _end(stacks.tops)
    audit, lines = _written(kept, stacks.back(top))
    text = "\n".join(lines + [f"{ROLES[r]}:" for r in way])
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    return held["at"] | {"whole": True, "gaps": gaps, "cost": cost, "audit": audit + letters, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def _chain(batches):
    """Tables of conversations in the order of their blocks to the tops with which each block is
    entered and left on the best way.  Of a block that has been read only the way back
    stays: four small numbers."""

    def stream():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "table")), strict=True)

    for conv, rows in groupby(stream(), key=lambda r: r[0]):
        tops, back, numbers = {START: (0, 0)}, [], []
        gaps, illegal, last, turns = 0, 0, None, None
        for _, block, table in rows:
            t = json.loads(table)
            best = {}
            for p, (cost, place) in tops.items():
                for r, cell in enumerate(t["tops"][p]):
                    if cell:
                        key = (cost + cell[0], place, cell[1])
                        if r not in best or key < best[r][0]:
                            best[r] = (key, p)
            order = {r: i for i, r in enumerate(sorted(best, key=lambda r: best[r][0][1:]))}
            tops = {r: (key[0], order[r]) for r, (key, _) in best.items()}
            back.append(bytes(best[r][1] if r in best else 9 for r in range(4)))
            numbers.append(block)
            if last is not None and (last, t["initials"][0]) not in LEGAL:
                illegal += 1
            last = t["initials"][1]
            if t["turns"]:
                low, high, n = t["turns"]
                turns = [low, high, n] if turns is None else [turns[0], high, turns[2] + n - (low == turns[1])]
        if turns:
            gaps = turns[1] - turns[0] + 1 - turns[2]
        cost, top, letters, way = _end(tops)
        entered, left = [], []
        for edge in reversed(back):
            left.append(top)
            top = edge[top]
            entered.append(top)
        entered.reverse()
        left.reverse()
        for at in range(0, len(numbers), 4096):
            part = slice(at, at + 4096)
            n = len(numbers[part])
            final = [at + i == len(numbers) - 1 for i in range(n)]
            columns = [[conv] * n, numbers[part], entered[part], left[part], [way if f else None for f in final], [letters if f else None for f in final]]
            columns += [[x if f else 0 for f in final] for x in (gaps, illegal, cost)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "block", "entered", "left", "way", "letters", "gaps", "between", "cost"])


def _pieces(batches):
    """Blocks that know their tops to their pieces of audit and text."""
    for b in batches:
        for at in range(0, b.num_rows, 4):
            part = b.slice(at, 4)
            audits, texts = [], []
            for rows, entered, left, way, letters in zip(*(part.column(c).to_pylist() for c in ("rows", "entered", "left", "way", "letters")), strict=True):
                kept, stacks = json.loads(rows), Stacks(entered)
                for _, _, key, copies in kept:
                    stacks.read(MOVES[tuple(key)])
                    stacks.tops = _repeated(stacks.tops, copies)
                audit, lines = _written(kept, stacks.back(left))
                audits.append(audit + (letters or ""))
                texts.append(lines + [f"{ROLES[r]}:" for r in way or ""])
            piece = ["".join(f"{x}\n" for x in lines) for lines in texts]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("block"), pa.array(audits, pa.string()), pa.array(piece, pa.string())], ["conv_id", "block", "audit", "piece"])


def _digests(batches):
    """Sorted pieces to one audit and digest a conversation; a piece is gone once hashed."""

    def stream():
        for b in batches:
            for at in range(0, b.num_rows, 4):
                yield from zip(*(b.slice(at, 4).column(c).to_pylist() for c in ("conv_id", "audit", "piece")), strict=True)

    for conv, rows in groupby(stream(), key=lambda r: r[0]):
        sha, audit, kept = hashlib.sha256(), [], ""
        for _, letters, piece in rows:
            audit.append(letters)
            if piece:
                sha.update((kept + piece[:-1]).encode())
                kept = "\n"
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``,
    ``copies`` as ``damaged`` gives them): ``conv_id``, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation.  Rows of one turn come in the order of role and
    text (UTF-8), null turns first; equal rows of a turn are duplicates of the first.
    A role that begins with neither s, u nor a can only be reroled or deleted.  Texts
    and conversations of any length are read whole: a long conversation is dealt over tasks
    by ranges and cut in blocks.  An empty table gives an empty result.  Other columns
    are not used, so their names cannot clash.

    The audit of a conversation is one string, and its digest is made in one pass over
    its pieces; both are so by their definition, and only these meet in one task.
    """
    ship(rows.sparkSession)
    rows = _faulty(rows.select("conv_id", "turn", "role", "text", "copies"))
    order = ["conv_id", "turn", "role", "text"]
    # Written and read back by task: ranges are drawn once, so blocks stay as they are if a task is lost.
    spread = rows.repartitionByRange(*order).withColumn("task", F.spark_partition_id().cast("long"))
    spread = spread.sortWithinPartitions("task", *order)
    blocks = written(spread.select("task", *order, "copies", "seen").mapInArrow(_parse, "conv_id long, block long, whole boolean, table string, rows string, " + _OUT), "blocks")
    result = ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
    done = blocks.where("whole").select(*result)
    cut = blocks.where("NOT whole")
    tables = cut.select("conv_id", "block", "table").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    states = written(tables.mapInArrow(_chain, "conv_id long, block long, entered long, left long, way string, letters string, gaps long, between long, cost long"), "states")
    s, c = states.alias("s"), cut.select("conv_id", "block", "rows").alias("c")
    known = c.join(small(s, 96), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("c.block") == F.col("s.block")))
    pieces = known.select("c.conv_id", "c.block", "rows", "entered", "left", "way", "letters").mapInArrow(_pieces, "conv_id long, block long, audit string, piece string")
    texts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    counts = cut.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in _COUNTS]).alias("n")
    ends = states.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in ("gaps", "between", "cost")]).alias("e")
    t = texts.alias("t")
    joined = counts.join(ends, F.col("n.conv_id").eqNullSafe(F.col("e.conv_id"))).join(t, F.col("n.conv_id").eqNullSafe(F.col("t.conv_id")))
    joined = joined.select("n.conv_id", "e.gaps", "n.blank", "n.duplicate", "n.truncated", (F.col("n.illegal") + F.col("e.between")).alias("illegal"), "e.cost", "t.audit", "t.repaired_sha256")
    return done.unionByName(joined)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """``repair`` of ``damaged(rows)`` with a row for every conversation of ``rows``: one
    that has lost all its rows has zeros, an empty audit and the empty string's digest."""
    every = rows.select(F.col("conv_id")).distinct().alias("a")
    found = written(repair(damaged(rows)), "repaired").alias("f")
    out = every.join(found, F.col("a.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return out.select("a.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest for every conversation."""
    return repaired_conversations(table(spark, sf_dir, "conversations"))
