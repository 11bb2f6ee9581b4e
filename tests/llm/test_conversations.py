"""Repairs against a plain fixed-point search, and the whole query against Python over the same table."""

import hashlib
import random
import re
import zlib

import pytest

from tickspark.llm import conversation_repair as cr

FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """(cost, audit, lines) over all edit sequences: the least (cost, audit) of each node, taken until nothing changes."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    keeps = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
    n = len(rows)
    best = {(n, s): (0, "") for s in ("", "a")}
    changed = True
    while changed:
        changed = False
        for i in range(n, -1, -1):
            for s in ("", "s", "u", "a"):
                ways = [(best[i, s])] if (i, s) in best else []
                arcs = [("I", i, nxt[s], 2)]
                if i < n:
                    role, _, fault = rows[i]
                    arcs.append(("D", i + 1, s, 3))
                    if fault in ("", "truncated"):
                        more = fault == "truncated"
                        arcs.append(("R", i + 1, nxt[s], 2 + more))
                        if (s, role[:1]) in keeps:
                            arcs.append(("K", i + 1, role[:1], int(more)))
                ways += [(c + best[j, t][0], e + best[j, t][1]) for e, j, t, c in arcs if (j, t) in best]
                if ways and min(ways) != best.get((i, s)):
                    best[i, s] = min(ways)
                    changed = True
    cost, audit = best[0, ""]
    lines, i, s = [], 0, ""
    for e in audit:
        if e in "IR":
            s = nxt[s]
            lines.append({"u": "user", "a": "assistant"}[s] + ":" + (rows[i][1] if e == "R" else ""))
        elif e == "K":
            s = rows[i][0][:1]
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        i += e != "I"
    return cost, audit, lines


def brute(rows):
    """The contract over (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(marked)
    count = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(table):
    out = {}
    for conv, turn, role, text in table:
        own = out.setdefault(conv, [])
        sp = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return {c: brute(r) for c, r in out.items()}


def results(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in FAULTS) for r in rows}


def odd_rows():
    rng, out = random.Random(5), []
    for conv in [*range(40), None]:
        for k in range(rng.choice([1, 2, 5, 30])):
            turn = rng.choice([None, k, k, k + 3, 2])
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "Tool", "unit"]), rng.choice(["Yes.", "No", "", None, " \n", f"t{k}!", "a?b", "é. \t\r", "x" * 40 + "."])))
    return out + out[:25] + [(77, 1, "user", "long. " * 60_000)]


@pytest.mark.parametrize("seed", range(4))
def test_shortest_walks(seed):
    rng = random.Random(seed)
    kinds = ["", "truncated", "blank", "duplicate"]
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "bot", ""]), f"{i}", rng.choice(kinds)) for i in range(rng.randint(0, 9))]
        codes = bytes(cr.code_of(r[:1], {"": cr.SOUND, "truncated": cr.TRUNCATED, "blank": cr.BLANK, "duplicate": cr.DUPLICATE}[f]) for r, _, f in rows)
        dist = cr.distances(codes)
        audit, state = cr.walk(codes, dist)
        audit += cr.TAIL[state]
        assert (dist[0], audit, cr.apply_edits(audit, [r for r, *_ in rows], [t for _, t, _ in rows])) == cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in cr.apply_edits(audit, [r for r, *_ in rows], [t for _, t, _ in rows])))


def test_query_is_the_contract(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(cr.op13_conversation_repair(spark, sf)) == damaged(table)


@pytest.mark.parametrize("rows, chars", [(1024, 1_000_000), (1, 10), (3, 50)])
def test_odd_rows_in_pieces_of_any_size(spark, rows, chars):
    table = odd_rows()
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    for name in ("segment", "open", "codes", "digest", "first", "when", "fault", "copies", "later"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert results(cr.repair(cr.damage(df), rows, chars)) == damaged(table)


def test_general_table_and_names_of_any_type(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "user", "Hi."), ("b", 1, None, None)], "conv_id string, turn int, role string, text string")
    got = results(cr.repair(df))
    assert got["a"][1:7] == (0, 1, 0, 1, 5, "KDI")
    assert got["b"][1:7] == (1, 0, 0, 0, 3, "D")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(cr.damage(df)).collect() == []
