"""Repair of broken conversations by the cheapest edits.

A conversation's rows and the states of the pattern ``(s?(ua)+)?`` over role
initials span a lattice: node (rows taken, state).  Keep takes a row as it is
(cost 0), Rerole makes it a user's or an assistant's (2), Delete takes it away
(3, the only way for blank and repeated rows), Insert adds an empty message
(2); a truncated row which is not deleted adds 1.  The audit is the initials of
the edits in order.

Dijkstra runs from both ends at once.  Each heap is ordered by (cost, rows
taken, audit), so a settled node has its least cost and, among equal costs, its
least audit: of two audits of one node and one cost neither begins with the
other, since the longer one would hold further insertions and cost more.
Where a settled node of one side touches one of the other the two make a
crossing; the search goes on until no crossing as cheap can be left, and the
least concatenated audit wins.

Conversations of at most LONG_ROWS rows and LONG_BYTES of text are searched
where their sorted rows stream through a task.  Longer ones are cut into
segments of SEGMENT rows: each is searched between every pair of states by its
own task, the results are chained per conversation (some bytes a row, never its
texts), and the edits are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ordered import join_on, row_index
from .common import durable, quoted

LONG_ROWS, LONG_BYTES, SEGMENT = 2_048, 16 << 20, 512
#: Text handed over at once by a task.
PIECE_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"
#: A row's code: the class of its role's initial and its first fault.
INITIALS = "sua"
OTHER, BLANK, REPEATED, TRUNCATED = 3, 4, 8, 16
#: States: nothing yet, after s, after u, after a; the pattern may end in 0 or 3.
STATES, ENDS = 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Edges = list[list[tuple[int, str, int]]]


def inserts() -> Edges:
    """For each state the (cost, letter, next state) of insertions."""
    return [[(INSERT, "I", NEXT[q, x]) for x in "ua" if (q, x) in NEXT] for q in range(STATES)]


def takes(code: int) -> Edges:
    """For each state the edits which take a row of this code."""
    more = 1 if code & TRUNCATED else 0
    out = [[(DELETE, "D", q)] for q in range(STATES)]
    if not code & (BLANK | REPEATED):
        for (q, x), to in NEXT.items():
            if INITIALS[code & OTHER : (code & OTHER) + 1] == x:
                out[q].append((KEEP + more, "K", to))
            if x != "s":
                out[q].append((REROLE + more, "R", to))
    return out


def turned(edges: Edges) -> Edges:
    """The same edges, found from their ends."""
    back = [[] for _ in range(STATES)]
    for q, ways in enumerate(edges):
        for cost, letter, to in ways:
            back[to].append((cost, letter, q))
    return back


class Lattice:
    """The edges of every code, and searches already made."""

    def __init__(self) -> None:
        codes = [i | fault for i in range(4) for fault in (0, BLANK, REPEATED, TRUNCATED)]
        self.out = {c: takes(c) for c in codes}
        self.back = {c: turned(e) for c, e in self.out.items()}
        self.add, self.add_back = inserts(), turned(inserts())
        self.known: dict = {}

    def cheapest(self, codes: bytes, entry: int, exits: Sequence[int]) -> tuple[int, str] | None:
        """(cost, audit) of the best way from state ``entry`` before the first
        row to one of ``exits`` after the last."""
        key = (codes, entry, tuple(exits))
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = self.search(codes, entry, exits)
        return self.known[key]

    def search(self, codes: bytes, entry: int, exits: Sequence[int]) -> tuple[int, str] | None:
        rows = len(codes)
        ahead, behind = [(0, 0, "", entry)], [(0, 0, "", q) for q in exits]
        # Settled nodes, (rows taken from the start, state) to (cost, audit).
        fore, rear = {}, {}
        best = None
        while ahead or behind:
            top_ahead, top_behind = (h[0][0] if h else 0 for h in (ahead, behind))
            if best is not None and top_ahead + top_behind > best[0]:
                break
            forward = not behind or (bool(ahead) and top_ahead < top_behind)
            heap, mine, other = (ahead, fore, rear) if forward else (behind, rear, fore)
            cost, taken, audit, q = heappop(heap)
            node = (taken if forward else rows - taken, q)
            if node in mine:
                continue
            mine[node] = cost, audit
            ways = [(taken, way) for way in (self.add if forward else self.add_back)[q]]
            if taken < rows:
                code = codes[taken] if forward else codes[rows - 1 - taken]
                ways += [(taken + 1, way) for way in (self.out if forward else self.back)[code][q]]
            crossings = [(cost, audit, node)]
            for then, (price, letter, to) in ways:
                longer = audit + letter if forward else letter + audit
                reached = (then if forward else rows - then, to)
                crossings.append((cost + price, longer, reached))
                if reached not in mine:
                    heappush(heap, (cost + price, then, longer, to))
            for price, part, reached in crossings:
                if reached in other:
                    rest, end = other[reached]
                    found = price + rest, part + end if forward else end + part
                    best = found if best is None else min(best, found)
        return best

    def between_states(self, codes: bytes) -> list[list[tuple[int, str] | None]]:
        return [[self.cheapest(codes, q, (to,)) for to in range(STATES)] for q in range(STATES)]

    def whole(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit) of a whole conversation, segment by segment."""
        if len(codes) <= SEGMENT:
            return self.cheapest(codes, 0, ENDS)
        best = {0: (0, "")}
        for at in range(0, len(codes), SEGMENT):
            best = chained(best, self.between_states(codes[at : at + SEGMENT]))
        return min(best[q] for q in ENDS if q in best)


def chained(best: dict[int, tuple[int, str]], part: Sequence[Sequence[tuple[int, str] | None]]) -> dict[int, tuple[int, str]]:
    """The best ways to each state after one more segment."""
    out: dict[int, tuple[int, str]] = {}
    for q, (cost, audit) in best.items():
        for to, way in enumerate(part[q]):
            if way is not None:
                found = cost + way[0], audit + way[1]
                out[to] = min(out.get(to, found), found)
    return out


def edits_of_rows(codes: bytes, audit: str) -> Iterator[str]:
    """For each row its signs: ``u`` and ``a`` insert a message, ``K`` keeps the
    row, ``U`` and ``A`` give it another role, ``D`` deletes it.  What is
    inserted at the end goes with the last row."""
    q, at, held = 0, 0, ""
    signs = []
    for letter in audit:
        if letter in "IR":
            role = "a" if q == 2 else "u"
            q = NEXT[q, role]
            held += role if letter == "I" else role.upper()
        elif letter == "K":
            q = NEXT[q, INITIALS[codes[at] & OTHER]]
            held += "K"
        else:
            held += "D"
        if letter != "I":
            signs.append(held)
            at, held = at + 1, ""
    if held:
        signs[-1] += held
    return iter(signs)


def facts_of(codes: bytes) -> list[int]:
    """Counts of blank, repeated and truncated rows and of illegal neighbours."""
    initials = [c & OTHER for c in codes]
    return [*(sum(bool(c & fault) for c in codes) for fault in (BLANK, REPEATED, TRUNCATED)), sum(pair not in LEGAL for pair in zip(initials, initials[1:]))]


def messages_of(signs: Iterable[str], rows: Iterable[tuple[str, str]]) -> list[dict[str, str]]:
    made = []
    for sign, (role, text) in zip(signs, rows):
        for s in sign:
            if s in "ua":
                made.append({"role": ROLES[s], "text": ""})
            elif s != "D":
                made.append({"role": role if s == "K" else ROLES[s.lower()], "text": text})
    return made


def coded(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, code) with the faults a row shows by itself."""
    column = {n: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(" ")) for n, c in (("role", role), ("text", text))}
    slim = rows.select(F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).alias("turn"), column["role"].alias("role"), column["text"].alias("text"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    # The last sign which is no white space.
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return slim.withColumn("code", (code + fault).cast("int"))


RESULT = [("part", T.LongType()), ("parts", T.LongType()), *[(n, T.LongType()) for n in FACTS], ("audit", T.StringType()),
          ("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))]


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conv_id, part, parts, gaps, blank,
    duplicate, truncated, illegal, cost, audit, messages).

    Rows are taken by turn, those without a turn first; rows of one turn by
    role and text.  A null role or text is one space.  The first fault of a row
    counts: blank, equal in role and text to an earlier row, truncated (its last
    visible sign is none of ``.!?``).  A role whose initial is none of s, u, a
    (or an empty one) cannot be kept.  ``gaps`` counts the turns missing between
    the first and the last.  Rows without a conversation id are one
    conversation.  Other columns play no part; an empty table gives no rows.

    Conversations beyond LONG_ROWS rows or LONG_BYTES have several parts, each
    the messages made of SEGMENT rows; the other columns are on part 0 only.
    """
    marked = coded(rows, conv_id, turn, role, text)
    sizes = marked.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = durable(sizes.filter((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv"))
    if long.isEmpty():
        found = _short(marked)
    else:
        named = long.select(F.col("conv").alias("long_conv"))
        same = F.col("conv").eqNullSafe(F.col("long_conv"))
        found = _short(marked.join(named, same, "left_anti")).unionByName(_long(marked.join(named, same, "left_semi")))
    return found.withColumnRenamed("conv", conv_id)


def result_schema(conv: T.StructField) -> T.StructType:
    return T.StructType([conv, *[T.StructField(n, t) for n, t in RESULT]])


def _short(rows: DataFrame) -> DataFrame:
    schema = result_schema(rows.schema["conv"])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, made, weight = Lattice(), [], 0
        for conversation in grouped(batches):
            made.append(repaired(lattice, conversation))
            weight += 100 + sum(len(row["text"]) for row in conversation)
            if weight > PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(made, form)
                made, weight = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, form)

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(run, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            yield from batch.slice(at, 1_024).to_pylist()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation, whatever batches they came in."""
    for _, rows in groupby(rows_of(batches), key=lambda row: row["conv"]):
        yield list(rows)


def repaired(lattice: Lattice, rows: list[dict]) -> dict:
    seen: set[tuple[str, str]] = set()
    codes = bytearray()
    for row in rows:
        said = row["role"], row["text"]
        codes.append(row["code"] & OTHER | REPEATED if said in seen and not row["code"] & BLANK else row["code"])
        seen.add(said)
    cost, audit = lattice.whole(bytes(codes))
    turns = {row["turn"] for row in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    messages = messages_of(edits_of_rows(codes, audit), ((row["role"], row["text"]) for row in rows))
    return {"conv": rows[0]["conv"], "part": 0, "parts": 1, **dict(zip(FACTS, [gaps, *facts_of(codes), cost])), "audit": audit, "messages": messages}


def _long(rows: DataFrame) -> DataFrame:
    placed = row_index(rows.withColumn("unplaced", F.col("turn").isNull()), [("unplaced", True), "turn", "role", "text"], ["conv"], "place")
    placed = durable(placed.withColumns({"said": F.sha2("text", 256), "part": F.floor((F.col("place") - 1) / SEGMENT)}))
    first = placed.groupBy("conv", "role", "said").agg(F.min("place").alias("first"))
    again = (F.col("place") > F.col("first")) & (F.col("code").bitwiseAND(F.lit(BLANK)) == 0)
    code = F.when(again, F.col("code").bitwiseAND(F.lit(OTHER)) + REPEATED).otherwise(F.col("code"))
    told = durable(join_on(placed.select("conv", "place", "part", "turn", "code", "role", "said"), first, ["conv", "role", "said"]).select("conv", "place", "part", "turn", code.alias("code")))
    codes = told.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    parts = durable(_chain(_searched(codes.select("conv", "part", F.transform("rows", lambda r: r["code"]).alias("codes")))))

    turns = told.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    signs = parts.select("conv", "part", F.posexplode("signs").alias("at", "sign")).select("conv", (F.col("part") * SEGMENT + F.col("at") + 1).alias("place"), "sign")
    edited = join_on(placed.select("conv", "part", "place", "role", "text"), signs, ["conv", "place"], "inner")
    given = F.create_map(*[F.lit(x) for s, r in ROLES.items() for x in (s, r, s.upper(), r)])

    def message(sign: Column) -> Column:
        added = sign.isin(*ROLES)
        return F.struct(F.when(sign == "K", F.col("role")).otherwise(given[sign]).alias("role"), F.when(added, "").otherwise(F.col("text")).alias("text"))

    made = F.transform(F.filter(F.split("sign", ""), lambda s: ~s.isin("D", "")), message)
    lines = edited.select("conv", "part", "place", made.alias("made")).groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", "made"))).alias("lines"))
    whole = join_on(join_on(parts, turns, ["conv"]), lines.select("conv", "part", F.flatten(F.transform("lines", lambda x: x["made"])).alias("messages")), ["conv", "part"])
    return whole.select(
        "conv", "part", "parts", F.when(F.col("part") == 0, F.col("gaps")).cast("long").alias("gaps"), *[c for c in FACTS if c != "gaps"], "audit", "messages")


def _searched(codes: DataFrame) -> DataFrame:
    """Each segment's cheapest ways between states, as a list of 16."""
    pieces = T.ArrayType(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
    schema = T.StructType([*codes.schema.fields, T.StructField("ways", pieces)])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        for row in rows_of(batches):
            ways = [None if w is None else {"cost": w[0], "audit": w[1]} for line in lattice.between_states(bytes(row["codes"])) for w in line]
            yield pa.RecordBatch.from_pylist([{**row, "ways": ways}], form)

    return codes.mapInArrow(run, schema)


def _chain(searched: DataFrame) -> DataFrame:
    """(conv, part, parts, blank, duplicate, truncated, illegal, cost, audit,
    signs), the facts on part 0.  Of an open conversation its codes and four
    audits are held."""
    facts = [f for f in FACTS if f != "gaps"]
    fields = [searched.schema["conv"], searched.schema["part"], T.StructField("parts", T.LongType()), *[T.StructField(f, T.LongType()) for f in facts]]
    schema = T.StructType([*fields, T.StructField("audit", T.StringType()), T.StructField("signs", T.ArrayType(T.StringType()))])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in groupby(rows_of(batches), key=lambda row: row["conv"]):
            best, codes = {0: (0, "")}, bytearray()
            for part in parts:
                ways = [None if w is None else (w["cost"], w["audit"]) for w in part["ways"]]
                best = chained(best, [ways[i : i + STATES] for i in range(0, len(ways), STATES)])
                codes.extend(part["codes"])
            cost, audit = min(best[q] for q in ENDS if q in best)
            signs = edits_of_rows(codes, audit)
            count = -(-len(codes) // SEGMENT)
            first = {"parts": count, **dict(zip(facts, [*facts_of(codes), cost])), "audit": audit}
            for at in range(count):
                row = {"conv": conv, "part": at, "parts": count, **(first if at == 0 else {}), "signs": list(islice(signs, SEGMENT))}
                yield pa.RecordBatch.from_pylist([row], form)

    return searched.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)


def digests(found: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256) of the messages, each ``role:text``, joined
    by newlines; the parts of a long conversation are read in their order."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n").alias("said")
    rows = found.select(F.col(quoted(conv_id)).alias("conv"), "part", "parts", F.size("messages").alias("n"), lines)
    short = rows.filter("parts = 1").select("conv", F.sha2("said", 256).alias("repaired_sha256"))
    schema = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in groupby(rows_of(batches), key=lambda row: row["conv"]):
            state, empty = sha256(), True
            for part in parts:
                if part["n"]:
                    state.update(("" if empty else "\n").encode() + part["said"].encode())
                    empty = False
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": state.hexdigest()}], form)

    several = rows.filter("parts > 1").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)
    return short.unionByName(several).withColumnRenamed("conv", conv_id)
