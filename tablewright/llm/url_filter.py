"""URL filters: rules by host and path, and a classifier for the rest.

Host names are cut into words by a unigram model (Viterbi): the words and their
counts are those of the pages themselves, and an unknown word gets a chance
that falls with its length.  Words of host and path then go to a multinomial
naive Bayes model of blocked and allowed pages, learned from pages whose host
holds a term of a short fixed list.  Rules come before the model; of the rules
that fit, the longest wins.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_names, quoted, with_arrow_columns

# ---- fixed values: host words which mark a page as blocked for learning -------
BLOCK_TERMS = ["ads", "adult", "bets", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx"]
#: Words a segmenter should know even where the pages do not use them.
COMMON_WORDS = ["blog", "cheap", "cdn", "farm", "forum", "free", "mail", "mobile", "news", "online", "shop", "site", "store", "web", "wiki", "www"]
# ------------------------------------------------------------------------------

LETTERS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
LONGEST = 24
#: Words rarer than this share are left to the unknown-word model, tokens rarer
#: than this to a table which is joined; what travels to the tasks has at most
#: 1 / share rows whatever the input's size.
WORD_SHARE, TOKEN_SHARE = 1e-5, 1e-5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_pair(pair: str | None) -> tuple[str, str]:
    """Host and path laid end to end: a host has no slash, a path begins with one."""
    host = (pair or "").partition("/")[0]
    return host, (pair or "")[len(host) :]


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, then a path from its first ``/`` on."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass
class Filter:
    """Rules, word counts and token weights; answers for one host and path."""

    rules: list[Rule]
    words: dict[str, int]
    total: int
    weights: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    #: Weights (token, weight) of the tokens which are too rare for ``weights``.
    rare: DataFrame | None = None

    def __post_init__(self) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(self.rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host.setdefault(rule.host, []).append(rule)
        self.cut: dict[str, list[str]] = {}

    def rule_for(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule.path):
                    if best is None or (len(rule.text), best.text) > (len(best.text), rule.text):
                        best = rule
                    break
            at = host.find(".", at) + 1
            if not at:
                return best

    def segment(self, name: str) -> list[str]:
        """The likeliest words of a name."""
        found = self.cut.get(name)
        if found is None:
            if len(self.cut) > 100_000:
                self.cut.clear()
            best, back = [0.0], [0]
            for end in range(1, len(name) + 1):
                options = []
                for start in range(max(0, end - LONGEST), end):
                    count = self.words.get(name[start:end])
                    chance = math.log(count / self.total) if count else math.log(10.0 / self.total) - (end - start) * math.log(10.0)
                    options.append((best[start] + chance, start))
                value, start = max(options)
                best.append(value)
                back.append(start)
            found, end = [], len(name)
            while end:
                found.append(name[back[end] : end])
                end = back[end]
            found.reverse()
            self.cut[name] = found
        return found

    def host_words(self, host: str) -> list[str]:
        return [w for run in LETTERS.findall(host) for w in (self.segment(run) if run.isalpha() and run.isascii() else ["#"] if run.isdigit() else [run])]

    def tokens(self, host: str, path: str) -> list[str]:
        """Host words, and path words marked by a slash; numbers are one token."""
        path_words = [w for run in LETTERS.findall(path.lower()) for w in (self.segment(run) if run.isalpha() and run.isascii() else ["#"] if run.isdigit() else [run])]
        return self.host_words(host) + ["/" + w for w in path_words]

    def score(self, host: str, path: str) -> tuple[float, list[str]]:
        """Log odds of blocked to allowed, and the tokens without a weight."""
        tokens = self.tokens(host, path)
        return self.prior + sum(self.weights.get(t, 0.0) for t in tokens), [t for t in tokens if t not in self.weights]


def word_counts(pages: DataFrame, html: str) -> tuple[dict[str, int], int]:
    """Counts of the lower-case ASCII words of all pages' texts, tags left out;
    at most 1 / WORD_SHARE words, and the number of all words."""
    visible = F.lower(F.regexp_replace(F.coalesce(F.col(quoted(html)), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(visible, r"[^a-z]+")).alias("word")).filter(f"word <> '' AND length(word) <= {LONGEST}")
    counted = durable(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = {r["word"]: r["n"] for r in counted.filter(F.col("n") >= max(2, math.ceil(WORD_SHARE * total))).collect()}
    # A fixed term counts as a word of middling frequency.
    for word in BLOCK_TERMS + COMMON_WORDS:
        known[word] = max(known.get(word, 0), max(2, total // 10_000))
    return known, max(total, 1)


def learn(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> Filter:
    """The filter: word counts of all pages, token counts of all urls."""
    words, total = word_counts(pages, html)
    made = Filter(rules, words, total)
    terms = set(BLOCK_TERMS)

    def fill(pairs: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"blocked": [], "tokens": []}
        for pair in pairs:
            host, path = split_pair(pair)
            out["blocked"].append(bool(terms.intersection(made.host_words(host))))
            out["tokens"].append(" ".join(made.tokens(host, path)))
        return out

    target = F.col(quoted(url))
    addresses = pages.select(F.concat(host_of(target), path_of(target)).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    marked = with_arrow_columns(addresses, "pair", {"blocked": "boolean", "tokens": "string"}, fill)
    marked = durable(marked.select("n", "blocked", "tokens"))
    pages_by = {r["blocked"]: r["n"] for r in marked.groupBy("blocked").agg(F.sum("n").alias("n")).collect()}
    token = marked.select("n", "blocked", F.explode(F.split("tokens", " ")).alias("token")).filter("token <> ''")
    counted = durable(token.groupBy("token").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("good")))
    bad, good, kinds = counted.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    # The same odds in SQL for the rare tokens, which stay in a table.
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad + kinds + 1))) - F.log((F.col("good") + 1) / F.lit(float(good + kinds + 1)))
    weighed = counted.select("token", odds.alias("weight"), (F.col("bad") + F.col("good") >= TOKEN_SHARE * (bad + good)).alias("frequent"))
    made.weights = {r["token"]: r["weight"] for r in weighed.filter("frequent").collect()}
    rare = weighed.filter(~F.col("frequent")).select("token", "weight")
    made.rare = None if rare.isEmpty() else rare
    made.prior = math.log((pages_by.get(True, 0) + 1) / (pages_by.get(False, 0) + 1))
    made.cut.clear()
    return made


def judge(pages: DataFrame, made: Filter, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block)
    and ``score`` (log odds of blocked), in place of columns of these names.

    A null url, or one without ``://``, has an empty host and path; no rule
    fits it and the model judges it by its prior.
    """
    # Plain values are shipped; the task's function carries the classes.
    plain = ([(r.text, r.verdict) for r in made.rules], made.words, made.total, made.weights, made.prior)
    shipped = pages.sparkSession.sparkContext.broadcast(plain)
    held: list[Filter] = []

    def fill(pairs: list[str | None]) -> dict[str, list]:
        if not held:
            rules, *rest = shipped.value
            held.append(Filter([Rule(*r) for r in rules], *rest))
        out: dict[str, list] = {name: [] for name in added}
        for pair in pairs:
            host, path = split_pair(pair)
            rule, (score, unknown) = held[0].rule_for(host, path), held[0].score(host, path)
            found = (host, path, rule and rule.text, rule and rule.verdict, score, " ".join(unknown))
            for name, value in zip(added, found):
                out[name].append(value)
        return out

    target = F.col(quoted(url))
    rest, = free_names(pages, "rest")
    added = {"host": "string", "path": "string", "rule": "string", "verdict": "string", "score": "double", rest: "string"}
    columns = [F.col(quoted(c)) for c in pages.columns if c.lower() not in added]
    pair, extra = free_names(pages, "pair", "extra")
    paired = pages.select(*columns, F.concat(host_of(target), path_of(target)).alias(pair))
    judged = with_arrow_columns(paired, pair, added, fill)
    if made.rare is not None:
        # Tokens without a weight are looked up in the table of rare ones, once
        # for each different address which holds some.
        asked = judged.filter(F.col(rest) != "").select(pair, rest).distinct()
        looked = asked.select(pair, F.explode(F.split(rest, " ")).alias("token")).join(made.rare, "token")
        found = durable(looked.groupBy(pair).agg(F.sum("weight").alias(extra)))
        judged = judged.join(found, pair, "left").withColumn("score", F.col("score") + F.coalesce(extra, F.lit(0.0))).drop(extra)
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop(pair, rest)
