"""Decontamination, mixing, archives, conversations and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import chat, decontamination, mixing, simhash, warc
from tablewright.llm.common import shared_folder

FOLDER = "/root/testdata/sf0.001"


# ---- decontamination -------------------------------------------------------------


def plain_contamination(docs, items, window=13):
    lower = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    known = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known[tuple(w[i : i + n])].add("" if name is None else str(name))
    sizes, out = {len(k) for k in known}, []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := known.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def spread(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_windows_of_any_length(spark):
    pick = random.Random(1)
    say = lambda n: " ".join(pick.choice("a b Cé d7".split()) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 20, 40])] + [(None, say(14)), (7, None), (8, "  "), (9, say(13)), (9, say(13))]
    for chosen in (items, items[9:], items[11:], []):
        docs = [(i, pick.choice([" ", ", "]).join([say(pick.randint(0, 30)), pick.choice(items)[1] or "", say(pick.randint(0, 9))])) for i in range(60)]
        docs += [(1000, None), (1001, ""), (1002, "..."), (None, items[13][1]), (None, "a"), (7, docs[7][1]), (7, docs[7][1])]
        found = decontamination.contamination(
            spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, n_words string"), spark.createDataFrame(chosen, "item_id long, text string"))
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect()]
        assert spread(got) == spread(plain_contamination(docs, chosen))


def test_long_text_and_removal(spark):
    passage = " ".join(f"item{i}" for i in range(30))
    filler = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    docs = spark.createDataFrame([(1, passage), (2, f"{filler(0, 40_000)} {passage}"), (3, f"One. {passage.upper()}! Two; three."), (4, "clean"), (4, "clean"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()) == [2, 4, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, "spans").collect()}
    assert cut[1] == "" and cut[2] == filler(0, 40_000) and cut[3] == "One! Two; three." and cut[4] == "clean" and cut[5] is None
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "both")


def test_scan_stays_native(spark):
    docs, items = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---- mixing ------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((n for n in sizes if n), key=lambda n: n.encode()) + [n for n in sizes if not n]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full, share = budget * sum(sizes.values()), set(), 0.0
    while True:
        left = sum(weight[n] for n in names if n not in full)
        if not left:
            return {n: most * sizes[n] for n in names}
        share = (total - sum(most * sizes[n] for n in full)) / left
        more = {n for n in names if n not in full and share * weight[n] > most * sizes[n]}
        if not more:
            return {n: most * sizes[n] if n in full else share * weight[n] for n in names}
        full |= more


@pytest.mark.parametrize("per_bucket", [7, 4000])
def test_mix_meets_its_targets(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "BUCKET", per_bucket)
    pick = random.Random(2)
    rows = [(i, " ".join(["w"] * pick.randint(0, 40)) + pick.choice(["", "$$$"]), pick.choice(["hot"] * 6 + ["a", "é", "z", "tiny", None])) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "empty"), (None, "w w w", "hot"), (None, "w w w", "hot"), (5000, "w " * 30_000, "long")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, taken string").repartition(5)
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source or ""] += len((text or "").split())
    wanted, source_of = plain_targets(sizes), {i: s or "" for i, _, s in rows}
    found["source"] = [source_of[None if i != i else int(i)] if i == i else "hot" for i in found["doc_id"]]
    for source, part in found.groupby("source"):
        assert abs(part["target"].iloc[0] - wanted[source]) < 1e-6 and part["source_size"].iloc[0] == sizes[source]
        assert abs(part["taken"].sum() - wanted[source]) <= part["size"].max() / 2 + 1e-6
    again = mixing.mix(docs.repartition(3, "doc_id")).toPandas()
    order = ["doc_id", "size", "taken"]
    assert found[order].sort_values(order).values.tolist().__repr__() == again[order].sort_values(order).values.tolist().__repr__()
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "taken_words", "repeats"] and kept.agg(F.sum("taken_words")).first()[0] == found["taken"].sum()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here").otherwise("#### $$$$ words").alias("text"), F.lit("a").alias("source"))
    found = mixing.mix(rows, weights=[1], budget=0.25).toPandas()
    good = found[found["doc_id"] % 2 == 0]["taken"].sum() / found["taken"].sum()
    assert good > 0.8


# ---- archives ------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_archives_keep_every_page(spark, monkeypatch, version):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    tricky = "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "http://x 0.0.0.0 20000101000000 text/html 5\n"
    rows = [(9, "u", tricky), (4, "a b\nc", tricky), (4, "a b\nc", tricky), (None, None, None), (7, "é", ""), (1, "u", "x" * 50_000), (2, "u", "x" * 50_000), (3, "u", "\n\n")]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i % 11}</p>" * (i % 7 + 1)) for i in range(200)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, record_type string").repartition(4)
    found = [tuple(r) for r in warc.archived_pages(pages, version=version).collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(digest(t), i)
    seen, want = set(), []
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        d = digest(t)
        want.append((i, len((t or "").encode()), d, "revisit" if d in seen else "response", first[d] if d in seen else None))
        seen.add(d)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_arc_lengths_and_versions():
    about = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n"
    opening = b"filedesc://a.arc 0.0.0.0 19960923 text/plain %d\n%s\n" % (len(about), about)
    record = b"http://x/a b 1.2.3.4 19970101 text/html 4\nab\nc\n\n"
    assert [(f["URL"], block) for _, _, f, block in warc.arc_records(opening + record + record)] == [("http://x/a b", b"ab\nc")] * 2
    for broken in (record, opening + record[:-5], opening.replace(b"1 0 org", b"9 0 org"), opening + b"no header here\n"):
        with pytest.raises(ValueError):
            list(warc.arc_records(broken))
    assert warc.timestamp("19970102030405") == "1997-01-02T03:04:05Z" and warc.timestamp("1997") == "1997-01-01T00:00:00Z"


def test_bytes_outside_utf8_survive(spark):
    """ARC files with any bytes, read by Spark, become WARC files with the same."""
    about = b"1 0 org\nURL IP-address Archive-date Content-type Archive-length\n\n"
    payload = bytes(range(256)) * 3
    content = b"filedesc://a.arc 0.0.0.0 19960923 text/plain %d\n%s\n" % (len(about), about) + b"http://x/ 1.2.3.4 19970101 image/gif %d\n%s\n" % (len(payload), payload)
    arcs = spark.createDataFrame([("a.arc", bytearray(content))], "path string, content binary")
    folder = shared_folder(spark, "warc")
    warc.convert(arcs, folder)
    row = warc.read_warcs(warc.read_archives(spark, folder)).first()
    assert (row["payload_bytes"], row["payload_digest"], row["date"], row["page"]) == (len(payload), warc.payload_digest(payload), "1997-01-01T00:00:00Z", None)


# ---- conversations -------------------------------------------------------------------


def test_formatting_is_reversible():
    pick = random.Random(3)
    for _ in range(300):
        turns = [("".join(pick.choice("a\\<>\nlgné") for _ in range(pick.randint(0, 6))), "".join(pick.choice("ab\\<>/\nturnlg 😀") for _ in range(pick.randint(0, 30)))) for _ in range(pick.randint(0, 5))]
        turns += [("user", "\\### Assistant: </turn> ok"), ("assistant", "</turn>\n<turn user>\nx")]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def plain_branches(nodes, keep):
    out = []
    for tree in {t for t, *_ in nodes}:
        own = {i: (p, s or 0.0) for t, i, p, s in nodes if t == tree}
        parents, found = {p for p, _ in own.values()}, []
        for leaf in own:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if leaf not in parents and at not in path:
                found.append((-sum(own[i][1] for i in path) / len(path), -len(path), leaf, path))
        out += [(tree, leaf, i, d) for _, _, leaf, path in sorted(found)[:keep] for d, i in enumerate(path)]
    return sorted(out)


@pytest.mark.parametrize("keep", [1, 3])
def test_branches_of_trees(spark, keep):
    pick = random.Random(4)
    nodes = [(f"t{t}", i, pick.randrange(i) if i else None, pick.choice([None, 0.0, 1.0, 2.0])) for t in range(12) for i in range(pick.randint(1, 30))]
    nodes += [("line", i, i - 1 if i else None, 1.0) for i in range(70)] + [("orphan", 5, 77, 1.0), ("ring", 1, 2, 1.0), ("ring", 2, 1, 1.0), ("ring", 3, 2, 1.0), ("self", 1, 1, 1.0)]
    found = chat.branches(spark.createDataFrame(nodes, "tree string, id long, parent long, score double"), keep)
    assert sorted((r["tree"], r["leaf"], r["id"], r["depth"]) for r in found.collect()) == plain_branches(nodes, keep)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, None, None, "first"), (None, 3, "user", "nobody's"), (2, 0, "assistant", "x" * 50_000)]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, score string")
    found = {r["tree"]: r for r in chat.read_back(chat.formatted(chat.threads(frame))).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found["=1"]["turns_sha256"] == digest("\nfirst\nuser\n\nassistant\n\nassistant\n\n") and found["=1"]["n_turns"] == 4 and found["=1"]["loss_chars"] == 0
    assert found[""]["n_turns"] == 1 and found["=2"]["loss_sha256"] == digest("x" * 50_000)
    assert chat.formatted(chat.threads(frame.limit(0))).count() == 0


# ---- the pipeline ----------------------------------------------------------------------


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    planted = "planted words " + " ".join(f"own{i}" for i in range(120))
    extra = [(10**6, planted, "en", "src0", 1), (10**6 + 1, planted, "en", "src1", 1), (10**6 + 2, None, None, None, None), (10**6 + 3, "", "en", None, 0),
             (10**6 + 4, "you idiot and moron and scum, worthless trash, you loser " + planted[::-1], "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        folder = shared_folder(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        results[name] = (before.toPandas(), docs.toPandas())
        if name != "mixing":
            assert docs.columns == columns and set(results[name][1]["doc_id"]) <= set(results[name][0]["doc_id"])
    gone = {name: set(a["doc_id"]) - set(b["doc_id"]) for name, (a, b) in results.items()}
    assert 10**6 + 4 in gone["toxicity"] and {10**6 + 2, 10**6 + 3} <= gone["quality rules"] and gone["SimHash near-dedup"] >= {10**6 + 1}
    before, after = results["SimHash near-dedup"]
    bits = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in zip(before["doc_id"], before["text"])}
    ids = sorted(bits)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(bits[a] ^ bits[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after["doc_id"]) == {find(i) for i in ids} and len(after) == len(set(after["doc_id"]))
    before, after = results["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert gone["benchmark decontamination"] == {r[0] for r in plain_contamination(list(zip(before["doc_id"], before["text"])), items) if r[4]}
    after = results["mixing"][1]
    assert (after["taken_words"] > 0).all() and after["repeats"].isin([1, 2]).all()


def test_empty_table_runs_through(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
