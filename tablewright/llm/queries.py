"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import join_on
from ..session import durable
from . import chat, decision_list, decontamination, exact_dedup, licenses, merkle, mixing, repair, simhash, token_counts, toxicity, url_filter, warc


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = [
    url_filter.Rule("com/", "allow"), url_filter.Rule("example.com/en/", "block"), url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"), url_filter.Rule("net/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages")
    return url_filter.judge(pages.select("page_id", "url"), url_filter.learn(pages, URL_RULES)).drop("url")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


WORDS_2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS_2} AS w FROM documents),
     i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS_2} AS w FROM benchmark) WHERE len(w) > 0),
     iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS s FROM i)),
     dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM i))),
     h AS (SELECT dw.doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
     c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit(said).alias("text"))
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    # Written, then read back by a job of its own.
    found = chat.read_back(durable(chat.formatted(chat.threads(rows))))
    conv_id = F.when(F.col("tree") != "", F.substring("tree", 2, 20).cast("long")).alias("conv_id")
    return found.select(conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP4 = r"""
WITH own AS (SELECT -7 AS conv_id, turn, role, '\### Assistant: </turn> ok' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
     c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM own)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(17 + length(role) + length(replace(replace(text, chr(92), 'xx'), '<', 'xx')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archived_pages(load(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1: its 40 hexadecimal digits as 160 bits, five at a time.
BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda h: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || h)::INT + 1]), '')"

OP5 = f"""
WITH b AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {BITS} AS bits FROM pages),
     d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  list_reduce(list_transform(string_split(substr(bits, (5 * i + 1)::INT, 5), ''), lambda c: c::INT), lambda a, c: 2 * a + c) + 1, 1)), '') AS payload_digest FROM b),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "license", "dice", "licenses")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    rules = decision_list.fit(docs, load(spark, folder, "labels"))
    return decision_list.judge(docs, rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents"))


OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(CASE WHEN length(text) > 0 THEN greatest(0.1, 1.0::DOUBLE - 4.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / length(text)) END, 0.1)::DOUBLE AS w,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY name),
r AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY name = '', name) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, name) AS place FROM r),
f AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER () AS total FROM o),
l AS (SELECT (1.5::DOUBLE * total - capped) / open_weight AS share FROM f WHERE (1.5::DOUBLE * total - capped) / open_weight <= ratio ORDER BY place LIMIT 1),
t AS (SELECT name, source_size, least(share * weight, 2.0::DOUBLE * source_size)::DOUBLE AS target FROM r, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.*, sum(size) OVER (PARTITION BY k.name ORDER BY key, k.doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM k JOIN e ON k.name = e.name)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + (start + size / 2.0 < target - epochs * source_size)::INT))::BIGINT AS taken FROM p
"""


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in some rows, told by their id and turn;
    nulls are one space."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(said["text"], "[.!?]", "")).otherwise(said["text"])
    role = F.when(F.col("kind") == 4, "user").otherwise(said["role"])
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    left = rows.withColumn("kind", kind).filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return left.drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = durable(repair.repair(damaged(rows)))
    facts = found.filter("part = 0").select("conv_id", *[F.col(f).alias(f) for f in repair.FACTS], "audit")
    known = join_on(join_on(rows.select("conv_id").distinct(), facts, ["conv_id"]), repair.digests(found), ["conv_id"])
    return known.select(
        "conv_id", *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in repair.FACTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = merkle.climb(merkle.build(load(spark, folder, "documents"), found={"text": tampered}), whole_proofs=False)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def field_sql(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {step}), 4294967295)"


LEAF_FIELDS = " || ".join(field_sql(f) for f in merkle.FIELDS[:-1])

OP12 = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
l AS (SELECT doc_id, source, sha256({LEAF_FIELDS} || {field_sql('text')}) AS leaf, sha256({LEAF_FIELDS} || {field_sql('found')}) AS seen,
             row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d),
tree AS (SELECT coalesce('s' || source, 'n') AS t, 0 AS lev, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL SELECT t, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY t, lev, i // 3, n),
s AS (SELECT t, lev, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS i FROM tree WHERE n = 1),
top AS (SELECT 0 AS lev, i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lev, i // 3, n),
nodes AS (SELECT t, lev, i, h, n FROM tree UNION ALL SELECT 'top', lev, i, h, n FROM top),
sib AS (SELECT a.t, a.lev, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
        FROM nodes a JOIN nodes b ON a.t = b.t AND a.lev = b.lev AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.t, a.lev, a.i),
low AS (SELECT doc_id, coalesce('s' || source, 'n') AS t, 0 AS lev, i, seen AS h, '' AS proof FROM l
  UNION ALL SELECT doc_id, c.t, c.lev + 1, c.i // 3, sha256(sib.l || h || sib.r), proof || sib.l || sib.r FROM low c JOIN sib ON c.t = sib.t AND c.lev = sib.lev AND c.i = sib.i),
high AS (SELECT doc_id, 0 AS lev, s.i, low.h, proof FROM low JOIN s ON low.t = s.t AND low.lev = s.lev
  UNION ALL SELECT doc_id, c.lev + 1, c.i // 3, sha256(sib.l || h || sib.r), proof || sib.l || sib.r FROM high c JOIN sib ON sib.t = 'top' AND c.lev = sib.lev AND c.i = sib.i)
SELECT l.doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = top.h AS verified
FROM l JOIN s ON s.t = coalesce('s' || source, 'n') JOIN high ON high.doc_id = l.doc_id JOIN top ON top.n = 1 AND top.lev = high.lev
"""


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, folder, "documents"), every_digest=True)


OP13 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) = 1 AS kept, text_sha256 FROM d
"""


QUERIES = {
    "op1_url_filter": op1_url_filter, "op2_decontamination": op2_decontamination, "op3_toxicity": op3_toxicity, "op4_chat": op4_chat,
    "op5_warc": op5_warc, "op6_licenses": op6_licenses, "op7_quality_rules": op7_quality_rules, "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing, "op10_simhash": op10_simhash, "op11_conversation_repair": op11_conversation_repair, "op12_merkle_manifest": op12_merkle_manifest, "op13_exact_dedup": op13_exact_dedup,
}

ORACLES = {"op2_decontamination": OP2, "op4_chat": OP4, "op5_warc": OP5, "op9_mixing": OP9, "op12_merkle_manifest": OP12, "op13_exact_dedup": OP13}
