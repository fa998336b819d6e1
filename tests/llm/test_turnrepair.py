import hashlib
import re
import zlib
from itertools import product

import pytest

from loomwork.llm import turnrepair


def damaged(rows):
    """The rows after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        at = out.setdefault(conv, [])
        one = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        at += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for at in out.values():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def best(turns):
    """Least (cost, audit) and the turns, over every sequence of edits: Dijkstra with the audit as a tie-break."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, said, made = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, made
        state = (at, said[-1:] if said else "")
        if state in done:
            continue
        done.add(state)
        legal = lambda i, said=said: re.fullmatch("|s|s?(ua)*u?|s?(ua)+", said + i) is not None
        for role in ("user", "assistant"):
            if legal(role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", at, said + role[0], (*made, (role, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role and legal(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, said + role[0], (*made, (role, text))))
                for new in ("user", "assistant"):
                    if legal(new[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, said + new[0], (*made, (new, text))))
    raise AssertionError


def brute(rows):
    out = []
    for conv, turns in damaged(rows).items():
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, made = best(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha))
    return sorted(out, key=repr)


TEXTS = ["Well said.", "No end", "Why?  \n", "", " \t", None, "Naïve 🎈!", "no end", "a.b", "Again.", " "]
ROLES = ["user", "assistant", "system", "assistant", "user", "tool", None, "uncle", ""]
SCHEMA = "conv_id long, turn long, role string, text string, part long, name string, number long, audit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, "a") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    out = []
    for conv in range(60):
        for turn in range(conv % 13):
            k = conv * 31 + turn * 17
            out.append((conv, None if k % 19 == 0 else turn * (1 + (k % 7 == 0)) - 3, ROLES[k % len(ROLES)] if conv % 2 else ("user", "assistant")[turn % 2], TEXTS[(k * k) % len(TEXTS)]))
    out += [(None, 1, "user", "Hi."), (None, None, None, None), (70, 1, "user", "x" * 200_000 + "."), (70, 2, "assistant", "ok.")]
    out += [(71, 2**60 + k, ("user", "assistant")[k % 2], f"Number {k}.") for k in range(40)] + [(72, 5, "user", f"Tie {k % 3}.") for k in range(9)]
    out += [next((80 + c, t, "user", "gone.") for t in range(1000) if zlib.crc32(f"{80 + c}:{t}".encode()) % 20 == 0) for c in range(3)]
    return out


def test_repair_against_brute_force(spark, rows):
    found = turnrepair.repaired(turnrepair.damaged(table(spark, rows)))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got) >= 3


@pytest.mark.parametrize("size", [1, 2, 5])
def test_small_segments_in_many_tasks_give_the_same(spark, rows, monkeypatch, size):
    """Every conversation is cut in segments, some of them at ends of tasks; equal turns stand on both sides of cuts."""
    monkeypatch.setattr(turnrepair, "TASK_BYTES", 20_000)
    more = rows + [(90, 1, "user", "Same words.")] * 30
    turns = turnrepair.damaged(table(spark, more))
    monkeypatch.setattr(turnrepair, "SEGMENT_ROWS", size)
    assert sorted(map(tuple, turnrepair.repaired(turns).collect()), key=repr) == brute(more)


def test_every_short_sequence_of_codes():
    """Costs and audits of all conversations of up to four turns."""
    kinds = [(i, f) for i in ("system", "user", "assistant", "x") for f in (None, "truncated")] + [("user", "blank"), ("assistant", "duplicate")]
    for n in range(4):
        for turns in product(kinds, repeat=n):
            codes = bytes(turnrepair.code(r[:1], f == "blank", f == "duplicate", f == "truncated") for r, f in turns)
            assert turnrepair.repair(codes) == best([(r, "t", f) for r, f in turns])[:2]


def test_empty_table(spark, rows):
    assert turnrepair.repaired(turnrepair.damaged(table(spark, rows).limit(0))).count() == 0
