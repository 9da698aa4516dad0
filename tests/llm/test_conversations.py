"""Conversation repair against enumeration, plain dynamic programming over strings, and SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from conftest import SMALL

from florin.llm import conversation_repair as R
from florin.llm import oracles as O
from florin.llm import queries as Q

LEGAL = re.compile("(s?(ua)+)?")


def enumerated(rows):
    """(cost, audit) over all edits of a few (initial, fault) rows, with up to two inserts anywhere."""
    gaps = ["", "u", "a", "ua", "au"]
    best = (10**9, "")
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for choice in itertools.product("DKua", repeat=len(rows)):
            roles, cost, audit = inserts[0], 5 * sum(map(len, inserts)), "I" * len(inserts[0])
            for (initial, fault), how, after in zip(rows, choice, inserts[1:]):
                if how != "D" and fault in (R.BLANK, R.DUPLICATE):
                    break
                roles += ("" if how == "D" else initial if how == "K" else how) + after
                cost += {"D": 2, "K": 0}.get(how, 1) + 5 * (how != "D" and fault == R.TRUNCATED)
                audit += (how if how in "DK" else "R") + "I" * len(after)
            else:
                if LEGAL.fullmatch(roles):
                    best = min(best, (cost, audit))
    return best


def code(initial, fault):
    return fault * 4 + ("sua".find(initial) if initial in ("s", "u", "a") else 3)


def test_cheapest_edits_by_enumeration():
    rng = random.Random(1)
    for k in range(160):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(k % 3 + (k % 20 == 0))]
        codes = bytes(code(*r) for r in rows)
        costs, ranks = R.forward(codes, *R.from_state(0))
        last = R.last_state(costs, ranks)
        assert (costs[last] + 5 * R.CLOSING[last], R.audit_of(codes)) == enumerated(rows), rows


def strings(codes):
    """The same by whole audit strings per state."""
    best = {0: (0, "")}
    for c in codes:
        ways = {}
        for s, (cost, audit) in best.items():
            for t, extra, letters in R.WAYS[c][s]:
                ways[t] = min(ways.get(t, (10**9, "")), (cost + extra, audit + letters))
        best = ways
    return min((cost + 5 * R.CLOSING[s], audit + "I" * R.CLOSING[s]) for s, (cost, audit) in best.items())[1]


def test_halves_and_pieces_give_the_same_edits():
    rng = random.Random(2)
    for size in [1, 33, 64, 65, 200, 700] * 6:
        weights = rng.choice([(9, 0, 0, 1), (5, 1, 1, 5), (3, 3, 3, 3)])
        codes = bytes(code(rng.choice("suaxua"), rng.choices(range(4), weights)[0]) for _ in range(size))
        whole = strings(codes)
        assert R.audit_of(codes) == whole
        cuts = sorted(rng.sample(range(1, size), min(5, size - 1)))
        pieces = [codes[x:y] for x, y in zip([0, *cuts], [*cuts, size])]
        summed = []
        for p in pieces:
            found = [R.forward(p, *R.from_state(s)) for s in range(4)]
            summed.append(([c for x, _ in found for c in x], [c for _, x in found for c in x]))
        states = R.crossings(summed)
        parts = [R.audit_of(p, a, b) for p, a, b in zip(pieces, [0, *states], [*states[:-1], None])]
        assert "".join(parts) == whole


def plain_report(rows):
    """One conversation's (turn, role, text) rows, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.strip(R.WHITE)
        faults.append(1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0)
        seen.add((role, text))
    codes = bytes(code(role[:1], f) for (_, role, _), f in zip(rows, faults))
    audit = strings(codes)
    out, at, state = [], 0, 0
    cost = 5 * audit.count("I") + 2 * audit.count("D") + audit.count("R")
    for letter in audit:
        if letter == "I":
            out.append(("assistant" if state == 2 else "user") + ":")
            state = 3 if state == 2 else 2
            continue
        _, role, text = rows[at]
        cost += 5 * (letter != "D" and faults[at] == 3)
        if letter == "K":
            out.append(f"{role}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif letter == "R":
            state = 3 if state == 2 else 2
            out.append(("assistant" if state == 3 else "user") + f":{text}")
        at += 1
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_conversations(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), rng.choice([None, *range(9)]), rng.choice([None, "", "system", "user", "assistant", "tool", "agent"]), rng.choice([None, "", " \n", "One.", "Two", "Three? \t", "é!", "x" * 20_000])) for _ in range(260)]
    rows += [(100, k, ["user", "assistant"][k % 2], f"Turn {k}{'.' if k % 7 else ''}") for k in range(900)] + [(101, 0, "user", "Same.")] * 30
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, digest string, n string").repartition(3)


def by_conversation(rows):
    md5 = lambda text: hashlib.md5(text.encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r.conv_id, []).append((r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text))
    return {c: sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2]))) for c, g in groups.items()}


@pytest.mark.parametrize("batch", ["10000", "40"])
def test_report_on_odd_rows(spark, odd_conversations, batch):
    """Small Arrow batches cut conversations into many pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.conv_id: tuple(r)[1:] for r in R.conversation_report(odd_conversations, odd_conversations).collect()}
        pieces = R.conversation_pieces(odd_conversations).where("conv_id = 100").count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {c: plain_report(g) for c, g in by_conversation(odd_conversations.collect()).items()}
    assert pieces > (20 if batch == "40" else 0)
    none = odd_conversations.where("false")
    assert R.conversation_report(none, none).count() == 0
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r)[1:] for r in R.conversation_report(none, odd_conversations).collect()} == {empty}


def test_query_and_oracle(spark, tmp_path, odd_conversations):
    odd_conversations.select("conv_id", "turn", "role", "text").union(spark.read.parquet(f"{SMALL}/conversations.parquet")).where("conv_id IS NULL OR conv_id NOT IN (100, 101)").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = Q.op11_conversation_repair(spark, str(tmp_path)).collect()
    wanted = {c: plain_report(g) for c, g in by_conversation(Q.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r.conv_id: tuple(r)[1:] for r in rows} == {r.conv_id: wanted.get(r.conv_id, empty) for r in rows}
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(str, base.sql(O.conversation_repair_sql()).fetchall())) == sorted(str(tuple(r)) for r in rows)
