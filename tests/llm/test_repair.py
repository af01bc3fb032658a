"""Repaired conversations against exhaustive edits and a plain reading of the contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from tablewright.llm import queries, repair

PATTERN = re.compile(r"(s?(ua)+)?")
FOLDER = "/root/testdata/sf0.001"


def plain_faults(rows):
    """Blank, duplicate, truncated or nothing, of (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """(cost, audit, messages) by the cheapest edits: all edits of each row are
    carried on, of equal (state, rows taken) the least (cost, audit)."""
    best = {"": (0, "", ())}

    def kept(found, initials, way):
        # What counts of the initials so far: their end and whether they began.
        key = initials[-1:]
        if re.fullmatch(r"(s?(ua)*u?)?", initials) and (key not in found or way[:2] < found[key][:2]):
            found[key] = way

    def spread(found):
        for _ in range(3):
            for key, (cost, audit, made) in list(found.items()):
                for role in ("user", "assistant"):
                    kept(found, "".join(m[0][:1] for m in made) + role[0], (cost + 2, audit + "I", (*made, (role, ""))))
        return found

    best = spread(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for cost, audit, made in best.values():
            so_far, more = "".join(m[0][:1] for m in made), fault == "truncated"
            kept(after, so_far, (cost + 3, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                if role[:1]:
                    kept(after, so_far + role[:1], (cost + more, audit + "K", (*made, (role, text))))
                for new in ("user", "assistant"):
                    kept(after, so_far + new[0], (cost + 2 + more, audit + "R", (*made, (new, text))))
        best = spread(after)
    return min(w for w in best.values() if PATTERN.fullmatch("".join(m[0][:1] for m in w[2])))


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, initials = plain_faults(rows), [r[1][:1] for r in rows]
    cost, audit, made = plain_edits(rows, faults)
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    said = "\n".join(f"{role}:{text}" for role, text in made)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256(said.encode()).hexdigest())


def all_edits(codes, most_inserts):
    """Every (cost, audit) whose messages fit the pattern."""
    found, lattice = [], repair.Lattice()
    stack = [(0, 0, 0, "", 0)]
    while stack:
        at, q, cost, audit, added = stack.pop()
        if at == len(codes) and q in repair.ENDS:
            found.append((cost, audit))
        ways = [(at + 1, 0, w) for w in lattice.out[codes[at]][q]] if at < len(codes) else []
        ways += [(at, 1, w) for w in lattice.add[q]] if added < most_inserts else []
        stack += [(then, to, cost + price, audit + letter, added + more) for then, more, (price, letter, to) in ways]
    return min(found)


def test_search_equals_every_way():
    lattice = repair.Lattice()
    kinds = [i | f for i in range(4) for f in (0, repair.BLANK, repair.REPEATED, repair.TRUNCATED)]
    for n in range(3):
        for codes in product(kinds, repeat=n):
            assert lattice.search(bytes(codes), 0, repair.ENDS) == all_edits(codes, n + 1)
    pick = random.Random(5)
    for _ in range(150):
        codes = bytes(pick.choice(kinds) for _ in range(pick.choice([3, 4, 4, 5])))
        assert lattice.search(codes, 0, repair.ENDS) == all_edits(codes, 4)


def test_segments_chain_to_the_same_audit(monkeypatch):
    pick = random.Random(6)
    kinds = [0, 1, 2, 1, 2, 1, 2, 3, 1 | repair.TRUNCATED, 2 | repair.TRUNCATED, 1 | repair.REPEATED, 2 | repair.BLANK]
    for size in (1, 2, 3, 7):
        for _ in range(40):
            codes = bytes(pick.choice(kinds) for _ in range(pick.randrange(40)))
            monkeypatch.setattr(repair, "SEGMENT", 512)
            whole = repair.Lattice().whole(codes)
            monkeypatch.setattr(repair, "SEGMENT", size)
            assert repair.Lattice().whole(codes) == whole


def odd_rows():
    pick = random.Random(11)
    rows = []
    for conv in [*range(60), None, 1000, 1001]:
        for turn in range(pick.choice([0, 1, 2, 3, 5, 8, 30])):
            role = pick.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "util", "Ünser"])
            text = pick.choice([f"Well {turn}.", f"Well {turn}.", f"cut off {turn}", "Same!", "", " \n", None, "Ends? \t\n", "x" * 70_000 + ".", "…", "Äh!"])
            rows.append((conv, pick.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def plain_of(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: plain_repair(found) for conv, found in groups.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("long_rows, long_bytes, segment", [(2048, 16 << 20, 512), (4, 1 << 30, 3), (0, 1 << 30, 1), (2048, 100_000, 4), (5, 1 << 30, 512)])
def test_repair_equals_plain_reading(spark, monkeypatch, long_rows, long_bytes, segment):
    for name, value in (("LONG_ROWS", long_rows), ("LONG_BYTES", long_bytes), ("SEGMENT", segment), ("PIECE_BYTES", 5_000)):
        monkeypatch.setattr(repair, name, value)
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "mine", 3) for r in rows], SCHEMA + ", conv string, Part int").repartition(5)
    found = repair.repair(table).cache()
    wanted = plain_of(rows)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(found).collect()}
    got = {r["conv_id"]: (*[r[f] for f in repair.FACTS], r["audit"], hashes[r["conv_id"]]) for r in found.filter("part = 0").collect()}
    assert got == wanted
    parts = defaultdict(list)
    for r in found.collect():
        parts[r["conv_id"]].append((r["part"], r["parts"]))
    assert all(sorted(p for p, _ in ps) == list(range(ps[0][1])) for ps in parts.values())
    assert (max(len(p) for p in parts.values()) > 1) == (segment < 30)
    found.unpersist()


def test_empty_table(spark):
    empty = repair.repair(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and repair.digests(empty).count() == 0


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{named[0]}:{named[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", named[3]) if kind == 2 else named[3]
        out += [(conv, turn, "user" if kind == 4 else named[2], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("odd", [True, False])
def test_query_equals_plain_reading(spark, tmp_path, odd):
    folder = FOLDER
    if odd:
        folder = str(tmp_path)
        spark.createDataFrame([*odd_rows(), (2000, 0, None, None), (2001, None, None, "?")], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wanted = {r[0]: nothing for r in rows} | plain_of(plain_damage(rows))
    got = {r["conv_id"]: tuple(r[c] for c in (*repair.FACTS, "audit", "repaired_sha256")) for r in queries.op11_conversation_repair(spark, folder).collect()}
    assert got == wanted
