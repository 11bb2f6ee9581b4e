"""Repair of the structure of conversations by cheapest edits.

A repaired conversation has roles ``(system? (user assistant)+)?``.  Edits are
arcs of a graph whose nodes are (rows done, what the output ends with): Keep
costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty row 2, and
a truncated row that stays 1 more.  All costs are small integers, so distances
to the end come from Dial's buckets; the audit is the walk from the start that
takes, of the arcs that lie on a shortest path, the ASCII-least initial.

Rows are range-partitioned and sorted by (conversation, turn, role, text), so a
conversation of any size is spread over tasks that hold at most a piece of it.
One that lies inside a task is done there.  One that doesn't is a chain of
segments: each gives the distances between its four entry and exit states, these
fold from the end to the start of the conversation, each segment is walked from
all four entries, and the exits fold from start to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.llm.common import Scratch, read_table

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What the output so far ends with; a conversation starts with nothing.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: The state after a row of a role that may come next, and the role that Insert and Rerole put next.
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: From each state the cheapest end, and its edits.
END = (0, 4, 2, 0)
TAIL = ("", "II", "I", "")
FAR = 1 << 60
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: A piece of a conversation has at most so many rows and about so many characters.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 1_000_000
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def code_of(initial: str, fault: int) -> int:
    """A row as one small number: its role's initial and its fault."""
    return (INITIALS.find(initial) % 4 if initial else 3) * 4 + fault


def _arcs() -> list[list[tuple[str, int, int, int]]]:
    """Of each row code the arcs (initial, from, to, cost) over the row."""
    out = []
    for code in range(16):
        initial, fault = code // 4, code % 4
        arcs = [("D", s, s, 3) for s in range(4)]
        if fault < BLANK:
            arcs += [("K", s, t, fault) for (s, c), t in KEEP.items() if initial < 3 and c == INITIALS[initial]]
            arcs += [("R", s, t, 2 + fault) for s, t in NEXT.items()]
        out.append(arcs)
    return out


ARCS = _arcs()
INTO = [[[(s, cost) for _, s, t, cost in arcs if t == to] for to in range(4)] for arcs in ARCS]
INSERTED = [[s for s, t in NEXT.items() if t == to] for to in range(4)]


def distances(codes: bytes, end: tuple[int, ...] = END) -> list[int]:
    """Cost to the end from each node 4 * place + state, given that of the states behind the last row.

    Buckets hold the nodes of one distance; arcs cost at most 3, so a ring of a
    few buckets beyond the spread of the ends is enough.
    """
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    known = [d for d in end if d < FAR]
    ring: list[list[int]] = [[] for _ in range(max(known) - min(known) + 4)]
    waiting = 0
    for state, d in enumerate(end):
        if d < FAR:
            dist[4 * n + state] = d
            ring[d % len(ring)].append(4 * n + state)
            waiting += 1
    now = min(known)
    while waiting:
        bucket = ring[now % len(ring)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            place, state = node >> 2, node & 3
            before = [(4 * place + s, 2) for s in INSERTED[state]] if place < n else []
            if place:
                before += [(4 * place - 4 + s, cost) for s, cost in INTO[codes[place - 1]][state]]
            for other, cost in before:
                if now + cost < dist[other]:
                    dist[other] = now + cost
                    ring[(now + cost) % len(ring)].append(other)
                    waiting += 1
        now += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int = NOTHING) -> tuple[str, int]:
    """The ASCII-least shortest path from a state before the first row: its edits, and the state behind the last row."""
    place, audit = 0, []
    while place < len(codes):
        left = dist[4 * place + state]
        for edit in "DIKR":
            if edit == "I":
                steps = [(place, NEXT[state], 2)]
            else:
                steps = [(place + 1, t, cost) for e, s, t, cost in ARCS[codes[place]] if e == edit and s == state]
            if steps and left == steps[0][2] + dist[4 * steps[0][0] + steps[0][1]]:
                place, state = steps[0][:2]
                audit.append(edit)
                break
        else:
            raise ValueError("no arc lies on a shortest path")
    return "".join(audit), state


def apply_edits(audit: str, roles: list[str], texts: list[str], state: int = NOTHING) -> list[str]:
    """Lines ``role:text`` of what the edits leave."""
    out, place = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:")
            continue
        if edit == "R":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[place]}")
        elif edit == "K":
            state = KEEP[state, roles[place][0]]
            out.append(f"{roles[place]}:{texts[place]}")
        place += 1
    return out


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


class _Piece:
    """Rows of one conversation that follow each other."""

    def __init__(self):
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.count = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}
        self.illegal, self.first, self.last = 0, None, None
        self.low, self.high, self.turns = None, None, 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.codes.append(code_of(initial, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        self.count[fault] += 1
        if self.first is None:
            self.first = initial
        else:
            self.illegal += illegal(self.last, initial)
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _finished(piece: _Piece) -> dict:
    dist = distances(piece.codes)
    audit, state = walk(piece.codes, dist)
    audit += TAIL[state]
    gaps = 0 if piece.low is None else piece.high - piece.low + 1 - piece.turns
    return {"gaps": gaps, "blank": piece.count[BLANK], "duplicate": piece.count[DUPLICATE], "truncated": piece.count[TRUNCATED], "illegal": piece.illegal, "cost": dist[NOTHING], "audit": audit, "repaired_sha256": sha(apply_edits(audit, piece.roles, piece.texts))}


def _unfinished(piece: _Piece) -> dict:
    """What the other pieces of the conversation need of this one, and its rows."""
    paths = [distances(piece.codes, tuple(0 if s == to else FAR for s in range(4)))[:4] for to in range(4)]
    counts = {"blank": piece.count[BLANK], "duplicate": piece.count[DUPLICATE], "truncated": piece.count[TRUNCATED], "illegal": piece.illegal}
    return counts | {"first": piece.first, "last": piece.last, "low": piece.low, "high": piece.high, "turns": piece.turns, "codes": bytes(piece.codes), "roles": piece.roles, "texts": piece.texts, "paths": [paths[to][s] for s in range(4) for to in range(4)]}


def _pieces(schema: T.StructType, max_rows: int, max_chars: int) -> Callable:
    """Sorted rows to finished conversations and, of those that reach the edge of the task or are long, segments."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        at, out, size = TaskContext.get().partitionId() << 32, [], 0
        piece, conv, before, whole, n = None, None, None, False, 0

        def close(done: bool) -> None:
            nonlocal n, size
            out.append({"conv_id": conv, "segment": at + n, "open": not done} | (_finished(piece) if done else _unfinished(piece)))
            n, size = n + 1, size + (500 if done else piece.chars + 500)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "blank", "truncated", "later")]
            for c, turn, role, text, gone, blank, truncated, later in zip(*columns, strict=True):
                if piece is None or c != conv:
                    if piece is not None:
                        close(whole)
                    piece, whole, conv, before = _Piece(), piece is not None, c, None
                if gone:
                    continue
                if len(piece.codes) >= max_rows or piece.chars >= max_chars:
                    close(False)
                    piece, whole = _Piece(), False
                row = (turn, role, text)
                piece.add(turn, role, text, BLANK if blank else DUPLICATE if later or row == before else TRUNCATED if truncated else SOUND)
                before = row
                if len(out) >= 1000 or size >= 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
                    size = 0
        if piece is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def _marked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with blank, truncated and later: whether the conversation has the role and text in an earlier turn."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"),
    ).withColumns({"blank": stripped == "", "truncated": ~F.right(stripped, F.lit(1)).isin(*ENDS), "digest": F.unhex(F.sha2("text", 256)), "when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))})
    said = rows.where("not gone and not blank").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min("when").alias("first"), F.max("when").alias("final"))
    # Only what is said in several turns; written before the join, so that either side of it can be split.
    said = scratch.save(said.where("first < final").drop("final"), "repeated")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return rows.join(said, same, "left").select("conv_id", "turn", "role", "text", "gone", "blank", "truncated", F.coalesce(F.col("first") < F.col("when"), F.lit(False)).alias("later"))


def _fold_ends(part):
    """Of each segment of a conversation the distances to the end from the states behind it."""
    part = part.sort_values("segment")
    end, out = END, []
    for paths in part["paths"].tolist()[::-1]:
        out.append(list(end))
        end = tuple(min(FAR, *(int(paths[4 * s + t]) + end[t] for t in range(4))) for s in range(4))
    return part[["conv_id", "segment"]].assign(end=out[::-1])


def _fold_states(part):
    part = part.sort_values("segment")
    state, out = NOTHING, []
    for exits in part["exits"].tolist():
        out.append(state)
        state = int(exits[state])
    return part[["conv_id", "segment"]].assign(state=out, tail=[""] * (len(out) - 1) + [TAIL[state]])


def _walked(batches: Iterator) -> Iterator:
    """Of each segment the edits from each of its four entries, and where they end."""
    import pyarrow as pa

    for batch in batches:
        audits, exits, costs = [], [], []
        for codes, end in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist(), strict=True):
            dist = distances(codes, tuple(end))
            ways = [walk(codes, dist, s) if dist[s] < FAR else ("", s) for s in range(4)]
            audits.append([w[0] for w in ways])
            exits.append([w[1] for w in ways])
            costs.append(dist[NOTHING])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32())), pa.array(costs, pa.int64())], ["conv_id", "segment", "audits", "exits", "cost"])


def _joined(schema: T.StructType) -> Callable:
    """Segments in order to finished conversations: counts add up, the text is hashed as it passes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now = to_arrow_schema(schema), None

        def finish() -> object:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            row = {c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                if now is None or now["conv_id"] != x["conv_id"]:
                    if now is not None:
                        yield finish()
                    now = {"conv_id": x["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": x["cost"], "audit": [], "hash": hashlib.sha256(), "some": False, "last": None, "low": None, "high": None, "turns": 0}
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += x[c]
                if x["first"] is not None:
                    now["illegal"] += now["last"] is not None and illegal(now["last"], x["first"])
                    now["last"] = x["last"]
                if x["low"] is not None:
                    now["turns"] += x["turns"] - (x["low"] == now["high"])
                    now["low"], now["high"] = x["low"] if now["low"] is None else now["low"], x["high"]
                edits = x["audits"][x["state"]] + x["tail"]
                lines = apply_edits(edits, x["roles"], x["texts"], x["state"])
                if lines:
                    now["hash"].update(("\n" if now["some"] else "").encode() + "\n".join(lines).encode())
                    now["some"] = True
                now["audit"].append(edits)
        if now is not None:
            yield finish()

    return run


def repair(rows: DataFrame, max_rows: int = SEGMENT_ROWS, max_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    rows: conv_id, turn, role, text, and optionally gone, true for a row that only
    says that its conversation is there.  A conversation without other rows has
    zeros, an empty audit and the hash of nothing.  Order is by turn, nulls first,
    then role, then text in byte order.  A null conv_id is a conversation of its
    own; a null role or text is empty.  Other columns are ignored, whatever their
    names.  Equal rows of one turn lie in one task, which holds 1,024 of them at a
    time; the audit of a conversation is one value, and its hash is taken in one
    pass by one task, as such a hash can't be split.
    """
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    scratch = Scratch(rows.sparkSession, "conversation-repair")
    marked = _marked(rows, scratch)
    key = marked.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    final = f"conv_id {key}, {counts}, audit string, repaired_sha256 string"
    shape = T.StructType.fromDDL(final)
    pieces = T.StructType.fromDDL(f"{final}, segment long, open boolean, first string, last string, low long, high long, turns long, codes binary, roles array<string>, texts array<string>, paths array<long>")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ranged = marked.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    found = scratch.save(ranged.mapInArrow(_pieces(pieces, max_rows, max_chars), pieces), "pieces")
    done, parts = found.where("not open").select(*shape.names), found.where("open")
    ids = ("conv_id", "segment")
    ends = parts.select(*ids, "paths").groupBy("conv_id").applyInPandas(_fold_ends, f"conv_id {key}, segment long, end array<long>")
    walked = parts.select(*ids, "codes").join(ends.drop("conv_id"), "segment").select(*ids, "codes", "end").mapInArrow(_walked, f"conv_id {key}, segment long, audits array<string>, exits array<int>, cost long")
    walked = scratch.save(walked, "walked")
    states = walked.select(*ids, "exits").groupBy("conv_id").applyInPandas(_fold_states, f"conv_id {key}, segment long, state int, tail string")
    rest = parts.select(*ids, "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "roles", "texts").join(walked.select("segment", "audits", "cost"), "segment").join(states.select("segment", "state", "tail"), "segment")
    closed = rest.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment").mapInArrow(_joined(shape), shape)
    return done.unionByName(closed)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32(``conv_id:turn``) % 20; nulls are one space.

    0 drops a row (gone), 1 empties its text, 2 takes its sentence ends out, 3
    repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    gone = F.col("fault") == 0
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(~gone, text).alias("text"), gone.alias("gone"), F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation of the table after known damage, repaired.

    Nulls are one space (a null turn stays null for order and gaps), so a null
    text is blank.  Of equal turns, role and then text decide the order.  Repeated
    rows are duplicates.  An empty table gives no rows.
    """
    return repair(damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
#: Shortest paths aren't SQL here; tests compare with all edit sequences and a plain dynamic program.
ORACLE: dict[str, str] = {}
