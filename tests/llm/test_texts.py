"""Token counts, fingerprints, statistics and scores against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import decision_list, licenses, simhash, token_counts, toxicity, url_filter
from tablewright.llm.components import components

TEXTS = [None, "", " ", "\n\t", "word", "Ein Wort.", "a\n\n b\t\tc\r\n", "日本語のテキスト。中文 texte é😀😀", "</s> <0x41> <unk> ▁▁a ▁", "\x00", "the " * 3000, "ab" * 3000, "=" * 2100]


def docs_of(spark, texts, **extra):
    return spark.createDataFrame([(i, t, *extra.values()) for i, t in enumerate(texts)], "doc_id long, text string" + "".join(f", {k} string" for k in extra))


# ---- token counts ------------------------------------------------------------


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark, model_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pick = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    letters = "abcdefghij ethanosr  ▁\n\t.,'0123ÉéßñüЖ中😀-_=<>/"
    texts = TEXTS + ["".join(pick.choice(letters) for _ in range(pick.randint(1, 80))) for _ in range(400)]
    texts += ["".join(pick.choice(pieces) for _ in range(pick.randint(1, 40))) for _ in range(400)] + ["".join(pick.choice(pieces).strip() for _ in range(2000))]
    found = token_counts.token_counts(docs_of(spark, texts, n_tokens="mine", N_BYTES="mine"), model_path)
    assert [c.lower() for c in found.columns] == ["doc_id", "text", "n_bytes", "n_tokens"]
    rows = sorted(found.collect())
    assert [r["n_tokens"] for r in rows] == [len(x) for x in library.encode([t or "" for t in texts])]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert token_counts.token_counts(docs_of(spark, texts).limit(0), model_path).count() == 0


def test_long_words_go_by_the_same_rule(model_path):
    table = token_counts.MergeTable(model_path)
    pick = random.Random(2)
    words = ["".join(pick.choice("aethonr") for _ in range(n)) for n in (1, 2, 7, 60, 400)] + ["a" * 333]
    assert [token_counts.count_long(table, w) for w in words] == token_counts.count_block(table, words).tolist()


# ---- SimHash -----------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits, distance):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(bits))]


def test_fingerprints(spark):
    pick = random.Random(3)
    texts = TEXTS + [" ".join(pick.choice("Ab cd éf GH".split()) for _ in range(pick.randint(1, 90))) for _ in range(60)]
    rows = sorted(simhash.fingerprints(docs_of(spark, texts)).collect())
    assert [r["fingerprint_bits"] & (1 << 64) - 1 for r in rows] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_join_what_is_near(spark, distance):
    """Random balls, a dense ball larger than a short group, and pairs at
    exactly the distance and one beyond."""
    pick = random.Random(distance)
    flip = lambda bits, n: bits ^ sum(1 << b for b in pick.sample(range(64), n))
    bits = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = pick.getrandbits(64)
        bits |= {centre} | {flip(centre, pick.randint(1, distance + 1)) for _ in range(4)}
    centre = pick.getrandbits(64)
    bits |= {flip(centre, pick.randint(1, 3)) for _ in range(120)}
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    found = components(simhash.links(spark.createDataFrame([(b,) for b in signed], "bits long"), distance), "a", "b")
    roots = {r["node"]: r["root"] for r in found.collect()}
    groups = Counter(zip(plain_components(bits, distance), (roots.get(b, b) for b in signed)))
    assert len(groups) == len({a for a, _ in groups}) == len({b for _, b in groups})


def test_hot_segments_are_dealt_out_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_LEAST", 5)
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    pick = random.Random(9)
    centre = pick.getrandbits(63)
    bits = sorted({centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 6))) for _ in range(60)})
    bits = [b for b in bits if b < 1 << 63]
    found = components(simhash.links(spark.createDataFrame([(b,) for b in bits], "bits long"), 4), "a", "b")
    roots = {r["node"]: r["root"] for r in found.collect()}
    groups = Counter(zip(plain_components(bits, 4), (roots.get(b, b) for b in bits)))
    assert len(groups) == len({a for a, _ in groups}) == len({b for _, b in groups})


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (9, None), (8, ""), (None, None), (7, "quite another text of a few words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(docs)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in found.collect()) == [(-1, 3), (-1, 8), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one_of_each(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, text), (None, text), (None, "b c d e f")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one_of_each(nameless).collect()) == ["b c d e f", text]


def test_components_are_told_apart_without_ids(spark, monkeypatch):
    """One id with two unrelated texts, and near copies without any id."""
    bits = {"a b": 0, "far away": (1 << 40) - 1, "copy": 3, "other": 0b11111 << 50, "near": 0b11 << 50}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle=4: bits[text])
    repeated = spark.createDataFrame([(1, "a b"), (1, "far away"), (2, "copy")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one_of_each(repeated).collect()) == ["a b", "far away"]
    nameless = spark.createDataFrame([(None, "other"), (None, "near"), (None, "far away")], "doc_id long, text string")
    assert simhash.keep_one_of_each(nameless).count() == 2


def test_components_of_a_long_path(spark):
    pairs = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 901), (901, 902), (900, 902), (7, 7)], "a long, b long"))
    roots = {r["node"]: r["root"] for r in components(pairs, "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(201)) and {roots[i] for i in (900, 901, 902)} == {900} and len(roots) == 204
    assert components(pairs.limit(0), "a", "b").count() == 0


# ---- quality statistics and decision lists -------------------------------------


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_statistics(spark):
    pick = random.Random(4)
    texts = TEXTS + ["\n".join(" ".join(pick.choice("a b # é| 7 <x>".split()) for _ in range(pick.randint(0, 12))) for _ in range(pick.randint(1, 12))) for _ in range(80)]
    rows = sorted(decision_list.text_statistics(docs_of(spark, texts)).collect())
    assert [[r[c] for c in decision_list.COUNTS] for r in rows] == [plain_statistics(t) for t in texts]


def test_rules_are_found_and_the_order_holds(spark):
    pick = np.random.default_rng(1)
    table = {m: pick.random(900) for m in decision_list.MEASURES}
    bad = (table["symbols_per_word"] > 0.8) | ((table["words"] < 0.3) & (table["distinct_words"] < 0.4))
    rules = decision_list.learn(table, bad)
    met = np.zeros(900, bool)
    for rule in rules.rules:
        met |= decision_list.covers(list(rule), table, 900)
    assert (met == bad).mean() > 0.97 and "reject if" in str(rules)
    assert decision_list.learn(table, np.zeros(900, bool)).rules == ()
    assert decision_list.learn({m: v[:0] for m, v in table.items()}, bad[:0]).rules == ()


def test_judging_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    rules = decision_list.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = sorted(decision_list.judge(docs, rules).collect())
    assert [r["kept"] for r in rows] == [not r["base_failed"] for r in rows] and not rows[0]["kept"]
    assert decision_list.keep_good(docs, rules).columns == docs.columns
    assert decision_list.judge(docs.limit(0), rules).count() == 0


def test_quality_on_labelled_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = decision_list.fit(docs, labels)
    found = decision_list.judge(docs.select("doc_id", "text"), rules).filter("NOT base_failed").join(labels, "doc_id").toPandas()
    assert ((found["quality"] == 1) == found["kept"]).mean() > 0.93


# ---- toxicity ------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon(toxicity.SEED_TERMS, ["xqz"])
    pick = random.Random(6)
    words = []
    for _ in range(1500):
        letters = list(pick.choice(toxicity.SEED_TERMS))
        for _ in range(pick.randint(0, 3)):
            at = pick.randrange(len(letters) + 1)
            letters[at : at + pick.randint(0, 1)] = pick.choice(["", "a", "é", "st"])
        words.append("".join(letters))
    for word in words:
        near = [(distance(word, t), toxicity.errors_allowed(t)) for t in toxicity.SEED_TERMS]
        want = "exact" if any(d == 0 for d, _ in near) else "fuzzy" if any(d <= allowed for d, allowed in near) else ""
        assert lexicon.match(word) == want, word
    assert lexicon.match("xqzabc") == "stem" and lexicon.match("") == ""


def test_quotation_scores_below_abuse(spark):
    model = toxicity.Model(toxicity.Lexicon(toxicity.SEED_TERMS, []), toxicity.PRIOR)
    texts = ["you are an idiot and a moron", 'the report said that "idiot" is a word', "a fine day at the sea", None, "", "you id1ot m0ron", "idiot " * 5000]
    score = [r["score"] for r in sorted(toxicity.score(docs_of(spark, texts, score="mine"), model).collect())]
    assert score[0] > 0.5 > score[1] > score[2] and score[2] == score[3] == score[4] and score[5] > 0.5 and score[6] > 0.5
    assert len(toxicity.reject_toxic(docs_of(spark, texts), model).collect()) == 4


def test_held_out_accuracy_and_missing_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).toPandas()
    toxic, said = found["toxic"] == 1, found["score"] >= 0.5
    assert (toxic & said).sum() >= 0.85 * toxic.sum() and (said & ~toxic).sum() <= 0.01 * (~toxic).sum()
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert (empty.weights == toxicity.PRIOR).all() and toxicity.score(docs.limit(0), empty).count() == 0


# ---- licences ------------------------------------------------------------------


def plain_scan(text, templates, similar):
    """Every run of words against every template."""
    grams = licenses.bigrams(licenses.words_of(text or ""))
    best = {}
    for name, texts in templates.items():
        for template in texts:
            wanted = Counter(licenses.bigrams(licenses.words_of(template)))
            for i in range(len(grams)):
                for j in range(i + 1, min(len(grams), i + 2 * wanted.total()) + 1):
                    value = licenses.dice(Counter(grams[i:j]), wanted)
                    if value >= similar:
                        best[name] = max(value, best.get(name, 0))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_scans_equal_all_passages(spark):
    pick = random.Random(8)
    notices = [t for texts in licenses.TEMPLATES.values() for t in texts if len(t) < 400]
    texts = [*TEXTS[:11], "This article is licensed under CC BY 4.0 and may be shared.", "Our code was released under the MIT license last year", "released under the MIT License " * 40]
    for _ in range(25):
        parts = []
        for _ in range(pick.randint(1, 4)):
            words = pick.choice(notices).split()
            for _ in range(pick.randint(0, 3)):
                words[pick.randrange(len(words))] = pick.choice(["other", "the", "license."])
            parts += [" ".join(words), pick.choice(["Some words here.", "Of the License.", ""])]
        texts.append(pick.choice([" ", "\n"]).join(parts))
    texts += texts[-2:]
    rows = sorted(licenses.scan_licenses(docs_of(spark, texts, license="mine")).collect())
    for row, text in zip(rows, texts):
        want = plain_scan(text, licenses.TEMPLATES, licenses.SIMILAR)
        assert row["licenses"] == ",".join(n for n, _ in want) and row["license"] == (want[0][0] if want else None)
        assert abs(row["dice"] - (want[0][1] if want else 0)) < 1e-12


# ---- urls ------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    rules = [url_filter.Rule("com/", "allow"), url_filter.Rule("example.com/en/", "block"), url_filter.Rule("www.example.com/en/", "allow"), url_filter.Rule("net/es/", "block")]
    urls = ["https://WWW.Example.com/en/1?x=/y", "http://a.example.com/en/1#t", "http://notexample.com/en/", "http://b.com", "x://net/es/q", "http://internet/es/q",
            None, "", "no scheme/en", "http://spamfarm.org/a\nb?c", "://h://x/", "HTTP://É.COM/"]
    pages = spark.createDataFrame([(i, u, "<p>spam farm the of</p>", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    rows = sorted(url_filter.judge(pages, url_filter.learn(pages, rules)).collect(), key=lambda r: r["page_id"])
    assert [r["rule"] for r in rows] == ["www.example.com/en/", "example.com/en/", "com/", None, "net/es/", None, None, None, None, None, None, "com/"]
    assert [(r["host"], r["path"]) for r in rows[:3]] == [("www.example.com", "/en/1"), ("a.example.com", "/en/1"), ("notexample.com", "/en/")]
    assert [(r["host"], r["path"]) for r in rows[6:]] == [("", ""), ("", ""), ("", ""), ("spamfarm.org", "/a\nb"), ("h:", "//x/"), ("É.com", "/")]
    assert rows[9]["verdict"] == "block" and rows[3]["verdict"] == "allow" and set(pages.columns) <= set(rows[0].asDict())
    empty = url_filter.learn(pages.limit(0), rules)
    assert url_filter.judge(pages.limit(0), empty).count() == 0


def test_segmenting_finds_the_likeliest_words():
    made = url_filter.Filter([], {"free": 50, "bets": 30, "the": 500, "rapist": 1, "therapist": 40}, 1000)
    assert made.segment("freebets") == ["free", "bets"] and made.segment("therapist") == ["therapist"] and made.segment("") == []
    assert "".join(made.segment("qzxw" * 40)) == "qzxw" * 40


def test_segments_equal_every_way_to_cut():
    made = url_filter.Filter([], {"a": 40, "b": 3, "ab": 9, "aba": 2, "ba": 5, "abba": 1, "bb": 1}, 500)
    chance = lambda w: math.log(made.words[w] / 500) if w in made.words else math.log(10 / 500) - len(w) * math.log(10)
    pick = random.Random(3)
    for name in ["".join(pick.choice("abc") for _ in range(pick.randrange(1, 9))) for _ in range(60)]:
        ways = []
        for mask in range(1 << (len(name) - 1)):
            cuts = [0, *(i + 1 for i in range(len(name) - 1) if mask >> i & 1), len(name)]
            ways.append([name[a:b] for a, b in zip(cuts, cuts[1:])])
        found = made.segment(name)
        assert "".join(found) == name and sum(map(chance, found)) == pytest.approx(max(sum(map(chance, way)) for way in ways))


@pytest.mark.parametrize("share", [0.0, 0.02, 2.0])
def test_scores_equal_counting_by_hand(spark, monkeypatch, share):
    """Whatever is too rare to travel is looked up, so the share changes nothing."""
    monkeypatch.setattr(url_filter, "TOKEN_SHARE", share)
    pick = random.Random(7)
    hosts = ["freecasino.org", "news.org", "casino-win.net", "shop.example.net", "m.news.org", "trackers.org", "wiki42.net", "xn--é.org"]
    urls = [f"http://{pick.choice(hosts)}/{pick.choice(['en', 'de/free', 'win', '7/8', ''])}" for _ in range(120)] + [None, "none", "http://news.org/" + "win/" * 3000]
    pages = spark.createDataFrame([(i, u, "<b>free casino</b> news win shop", "mine", "mine") for i, u in enumerate(urls)], "page_id long, url string, html string, pair string, rest string").repartition(3)
    made = url_filter.learn(pages, [])
    rows = {r["page_id"]: r for r in url_filter.judge(pages, made).collect()}
    words = url_filter.Filter([], made.words, made.total)
    tokens = [words.tokens(rows[i]["host"], rows[i]["path"]) for i in range(len(urls))]
    blocked = [bool(set(url_filter.BLOCK_TERMS) & set(words.host_words(rows[i]["host"]))) for i in range(len(urls))]
    counts = {flag: Counter(t for ts, b in zip(tokens, blocked) if b == flag for t in ts) for flag in (True, False)}
    kinds = len(counts[True] | counts[False])
    odds = {t: math.log((counts[True][t] + 1) / (counts[True].total() + kinds + 1)) - math.log((counts[False][t] + 1) / (counts[False].total() + kinds + 1)) for t in counts[True] | counts[False]}
    prior = math.log((sum(blocked) + 1) / (len(urls) - sum(blocked) + 1))
    for i, ts in enumerate(tokens):
        score = prior + sum(odds[t] for t in ts)
        assert rows[i]["score"] == pytest.approx(score) and rows[i]["verdict"] == ("block" if score > 0 else "allow") and (rows[i]["pair"], rows[i]["rest"]) == ("mine", "mine")
    assert len(rows) == len(urls) and (made.rare is None) == (share == 0)


# ---- one of each group ---------------------------------------------------------------


def test_one_of_each_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (9, None), (8, ""), (None, None), (7, "quite another text of a few words"), (4, "one"), (2, "ONE"), (5, "apart from the other five")]
    docs = spark.createDataFrame([(*r, "mine", i) for i, r in enumerate(rows)], "doc_id long, text string, named string, Turn int").repartition(3)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 7, 8] and {r["named"] for r in kept.collect()} == {"mine"}
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
    odd = [(None, text), (None, "b c d e f"), ("(none)", "g h i j k"), (None, "g h i j k l"), ("(none)", "l m n o p")]
    assert simhash.keep_one_of_each(spark.createDataFrame(odd, "doc_id string, text string")).count() == 5
