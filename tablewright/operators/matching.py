"""Joins which look for a counterpart: phrases, places, near texts, aliases."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quoted, text_columns
from ..functions.parsing import is_blank
from ..functions.text import comparable, jaccard, similarity, words
from ..session import durable
from .profile import value_counts

# Header words which make a column a likely home of a name.
NAME_LIKE = ["name", "title", "product", "customer", "company", "brand", "restaurant", "city", "country", "category"]


def phrase_column(df: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Where a phrase occurs: one row (column, value, phrase, exact, n), the
    best of all.  Equal beats contained, then the longer phrase, then
    name-like columns, then the more frequent value."""
    folded = [p.strip().lower() for p in phrases if p.strip()]
    counts = value_counts(df, text_columns(df))
    low = F.lower(F.trim(F.col("value")))
    found = counts.select(
        "column", "value", "n", low.alias("low"),
        F.explode(F.filter(F.array(*[F.lit(p) for p in folded]), lambda p: F.contains(low, p))).alias("phrase"),
    )
    exact = F.col("low") == F.col("phrase")
    likely = F.lower("column").rlike("|".join(NAME_LIKE))
    place = F.struct(
        exact.cast("int"), F.length("phrase"), likely.cast("int"), F.col("n"), F.col("column"), F.col("value"), F.col("phrase")
    )
    best = F.max_by(F.struct("column", "value", "phrase", exact.alias("exact"), "n"), place)
    return found.agg(best.alias("r")).filter("r is not null").select("r.*")


def rows_with_phrase(df: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Rows of the table in which the best column holds the phrase."""
    best = phrase_column(df, phrases).first()
    if best is None:
        return df.limit(0)
    text = F.lower(quoted(best["column"]))
    if best["exact"]:
        return df.filter(F.trim(text) == best["phrase"])
    return df.filter(F.contains(text, F.lit(best["phrase"])))


def count_equal(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column equals a value, ignoring case."""
    hit = F.lower(F.trim(quoted(column).cast("string"))) == value.strip().lower()
    return df.filter(hit).agg(F.count(F.lit(1)).alias("matching_rows"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """Real name of each requested name from (alias, real_name); an unknown
    name stays as it is."""
    table = aliases.select(F.lower(F.trim("alias")).alias("__alias"), "real_name").dropDuplicates(["__alias"])
    joined = names.join(table, F.lower(F.trim(quoted(column))) == F.col("__alias"), "left")
    return joined.withColumn("resolved", F.coalesce("real_name", quoted(column))).drop("__alias", "real_name")


# ---- places ----------------------------------------------------------------

PLACE_TEXT = ["city", "region", "country"]
PLACE_FIELDS = [*PLACE_TEXT, "latitude", "longitude"]
NEARBY_KM = 50.0
EARTH_KM = 6371.0088


def valid_coordinates(latitude: Column, longitude: Column) -> Column:
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest_places(points: DataFrame, gazetteer: DataFrame, radius_km: float = NEARBY_KM) -> DataFrame:
    """Nearest gazetteer row within the radius for each (latitude, longitude).

    A grid whose cells are at least the radius wide turns the range join into
    an equi join: a place is put into its own latitude band and the bands
    beside it, and into every longitude cell the radius can reach there.
    """
    step = radius_km / 111.0  # degrees of latitude
    band = lambda lat: F.floor(lat / F.lit(step)).cast("long")
    columns = math.floor(360.0 / step)
    width = 360.0 / columns
    cell = lambda lon: F.pmod(F.floor((lon + 180.0) / F.lit(width)), F.lit(columns)).cast("long")
    places = gazetteer.filter(valid_coordinates(F.col("latitude"), F.col("longitude"))).select(
        *[F.col(c).alias(f"p_{c}") for c in PLACE_FIELDS], band(F.col("latitude")).alias("pb")
    )
    # A degree of longitude shrinks with the cosine of the latitude.
    shrink = F.greatest(F.cos(F.radians(F.least(F.lit(90.0), F.abs("p_latitude") + 2 * step))), F.lit(1e-9))
    reach = F.least(F.ceil(F.lit(step) / shrink / width), F.lit(columns // 2)).cast("long")
    own = F.floor((F.col("p_longitude") + 180.0) / F.lit(width)).cast("long")
    places = places.withColumn("band", F.explode(F.sequence(F.col("pb") - 1, F.col("pb") + 1)))
    spread = F.array_distinct(F.transform(F.sequence(own - reach, own + reach), lambda c: F.pmod(c, F.lit(columns))))
    places = places.withColumn("cell", F.explode(spread)).drop("pb")
    seen = points.withColumns({"band": band(F.col("latitude")), "cell": cell(F.col("longitude"))})
    joined = seen.join(places, ["band", "cell"])
    km = distance_km(F.col("latitude"), F.col("longitude"), F.col("p_latitude"), F.col("p_longitude"))
    near = joined.withColumn("distance_km", km).filter(F.col("distance_km") <= radius_km)
    place = F.struct("distance_km", "p_country", "p_region", "p_city")
    best = F.min_by(F.struct(*[F.col(f"p_{c}").alias(c) for c in PLACE_FIELDS], "distance_km"), place)
    return near.groupBy("latitude", "longitude").agg(best.alias("place"))


def fill_places(df: DataFrame, columns: dict[str, str], gazetteer: DataFrame, radius_km: float = NEARBY_KM) -> DataFrame:
    """Fill blank place cells from a gazetteer (city, region, country,
    latitude, longitude).  ``columns`` maps these parts to real columns.

    Valid coordinates find the nearest place; otherwise the known names must
    match exactly one place.  Each distinct combination of cells is resolved
    once.  Adds ``cells_filled``.
    """
    parts = [p for p in PLACE_FIELDS if p in columns]
    cells = {p: quoted(columns[p]) for p in parts}
    text = lambda p: F.when(~is_blank(cells[p].cast("string")), F.trim(cells[p].cast("string")))
    keyed = df
    for p in parts:
        keyed = keyed.withColumn(f"__{p}", text(p) if p in PLACE_TEXT else text(p).try_cast("double"))
    marks = [f"__{p}" for p in parts]
    any_gap = F.lit(False)
    for m in marks:
        any_gap = any_gap | F.col(m).isNull()
    located = {"latitude", "longitude"} <= set(parts)
    has_point = valid_coordinates(F.col("__latitude"), F.col("__longitude")) if located else F.lit(False)
    wanted = durable(keyed.filter(any_gap).select(*marks).distinct().withColumn("__point", has_point))
    found = None
    if located:
        points = wanted.filter("__point").select(F.col("__latitude").alias("latitude"), F.col("__longitude").alias("longitude")).distinct()
        nearest = nearest_places(points, gazetteer, radius_km).select(
            F.col("latitude").alias("__latitude"), F.col("longitude").alias("__longitude"), "place"
        )
        found = wanted.filter("__point").join(nearest, ["__latitude", "__longitude"]).select(*marks, *_place(parts))
    named = [p for p in parts if p in PLACE_TEXT]
    for mask in range(1, 2 ** len(named)):
        # One equi join per set of known names; rows of the gazetteer which
        # agree on these names but not in the rest are ambiguous.
        known = [p for i, p in enumerate(named) if mask >> i & 1]
        test = ~F.col("__point")
        for p in named:
            test = test & (F.col(f"__{p}").isNotNull() if p in known else F.col(f"__{p}").isNull())
        one = gazetteer.groupBy(*[F.lower(F.trim(p)).alias(f"k_{p}") for p in known]).agg(
            F.count(F.lit(1)).alias("matches"), F.first(F.struct(*PLACE_FIELDS)).alias("place")
        )
        condition = F.lit(True)
        for p in known:
            condition = condition & (F.lower(f"__{p}") == F.col(f"k_{p}"))
        part = wanted.filter(test).join(one.filter("matches = 1"), condition).select(*marks, *_place(parts))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no place columns were given")
    renamed = found.withColumnsRenamed({m: f"__k{m}" for m in marks})
    on = F.lit(True)
    for m in marks:
        on = on & F.col(m).eqNullSafe(F.col(f"__k{m}"))
    joined = keyed.join(renamed, on, "left")
    filled, count = {}, F.lit(0)
    for p in parts:
        gap = F.col(f"__{p}").isNull() & F.col(f"__new_{p}").isNotNull()
        new = F.col(f"__new_{p}").cast(df.schema[columns[p]].dataType)
        filled[columns[p]] = F.when(gap, new).otherwise(cells[p])
        count = count + gap.cast("int")
    return joined.withColumn("cells_filled", count).withColumns(filled).select(*[quoted(c) for c in df.columns], "cells_filled")


def _place(parts) -> list[Column]:
    return [F.col(f"place.{p}").alias(f"__new_{p}") for p in parts]


# ---- near texts --------------------------------------------------------------


#: 64-bit words of a text's sign.
SIGN_WORDS = 4


def _word_lists(texts: DataFrame) -> DataFrame:
    """(text_id, side) → hashes of its words, rarest first, their number and
    the text's sign: a bit per place is set if an odd number of words fall on
    it.  Texts do not travel, only their ids and hashes of words."""
    exploded = texts.select("text_id", "side", F.explode(F.transform(words(F.col("norm")), lambda w: F.xxhash64(w))).alias("token"))
    frequency = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("token", F.lit(64)).cast("int"))
    word = F.pmod(F.shiftright("token", 6), F.lit(SIGN_WORDS))
    signs = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"sign{i}") for i in range(SIGN_WORDS)]
    listed = exploded.join(frequency, "token").groupBy("text_id", "side").agg(F.array_sort(F.collect_list(F.struct("uses", "token"))).alias("t"), *signs)
    return listed.withColumns({"tokens": F.transform("t", lambda t: t["token"]), "size": F.size("t")}).drop("t")


def similar_questions(
    probes: DataFrame, log: DataFrame, probe_id: str, minimum: float = 0.95, native: bool = False, scope: Sequence[str] = (),
    scorer: Callable[[Column, Column], Column] | None = None, overlap: float | None = None,
) -> DataFrame:
    """Best logged question for each probe with a score of at least
    ``minimum``: (probe_id, norm, score, matched …).

    ``probes`` has ``probe_id`` and ``user_query``; ``log`` has ``id``,
    ``user_query``, ``feedback_score``, ``created_at``.  Both have the columns of
    ``scope``, in which a question and its match agree (null with null).  Both
    sides are reduced to distinct normal texts first, so copies cost nothing.
    An equal text wins with 1.0.  For the rest, score ≥ s needs a word overlap
    of 2s-1, so two texts must share one of their rarest words (prefix filter);
    frequent words never form a block, and no pair above the bound is lost.
    Another ``scorer`` of two texts comes with the word ``overlap`` (Jaccard)
    which its ``minimum`` needs.
    """
    if (scorer is None) != (overlap is None):
        raise ValueError("a scorer comes with the overlap its minimum needs")
    floor = 2.0 * (minimum - 0.00005) - 1.0 if overlap is None else overlap
    if floor <= 0:
        raise ValueError("the prefix filter needs a minimum above 0.5")
    score = scorer or (lambda a, b: similarity(a, b, native))
    within = [f"__s{i}" for i in range(len(scope))]
    scopes = [F.coalesce(F.concat(F.lit("="), quoted(c).cast("string")), F.lit("")).alias(w) for c, w in zip(scope, within)]
    asked = probes.select(quoted(probe_id).alias("probe_id"), comparable(F.col("user_query")).alias("norm"), *scopes).filter("norm <> ''")
    past = log.select("id", "user_query", F.coalesce("feedback_score", F.lit(0)).alias("feedback"), "created_at",
                      comparable(F.col("user_query")).alias("norm"), *scopes).filter("norm <> ''")
    place = F.struct("feedback", "created_at", -F.col("id"))
    best = durable(past.groupBy("norm", *within).agg(F.max_by(F.struct("id", "user_query", "feedback", "created_at"), place).alias("entry")))
    distinct = durable(asked.select("norm", *within).distinct())
    equal = distinct.join(best, ["norm", *within]).select("norm", *within, F.lit(1.0).alias("score"), "entry")
    if floor <= 1.0:
        rest = distinct.join(best.select("norm", *within), ["norm", *within], "left_anti")
        near = _near_pairs(rest.select("norm").distinct(), best.select("norm").distinct(), floor)
        scored = near.withColumn("score", score(F.col("a_norm"), F.col("b_norm"))).filter(F.col("score") >= minimum)
        asks = rest.withColumnRenamed("norm", "a_norm")
        joined = scored.join(asks, "a_norm").join(best.withColumnRenamed("norm", "b_norm"), ["b_norm", *within])
        won = F.struct("score", "entry.feedback", "entry.created_at", -F.col("entry.id"))
        picked = joined.groupBy(F.col("a_norm").alias("norm"), *within).agg(F.max_by(F.struct("score", "entry"), won).alias("m"))
        equal = equal.unionByName(picked.select("norm", *within, "m.score", "m.entry"))
    return asked.join(equal, ["norm", *within]).select(
        "probe_id", "norm", "score", F.col("entry.id").alias("matched_id"), F.col("entry.user_query").alias("matched_query"),
        F.col("entry.feedback").alias("feedback_score"),
    )


def _near_pairs(new: DataFrame, past: DataFrame, floor: float) -> DataFrame:
    """(a_norm, b_norm) of the texts whose word sets overlap by ``floor``.

    Only a text's hash, size, sign and rarest words travel to the join by
    words.  Two sets differ in at least as many words as their signs differ in
    bits, so pairs whose signs are too far apart are dropped where they meet;
    no near pair is.  The texts are brought in for the pairs left.
    """
    both = new.select("norm", F.lit("new").alias("side")).unionByName(past.select("norm", F.lit("past").alias("side")))
    texts = durable(both.withColumn("text_id", F.struct(F.xxhash64("norm"), F.xxhash64(F.reverse("norm")))))
    # The words which a near text must share one of.
    prefix = F.slice(F.col("tokens"), F.lit(1), F.col("size") - F.ceil(F.col("size") * F.lit(floor) - 1e-9).cast("int") + 1)
    signs = [f"sign{i}" for i in range(SIGN_WORDS)]
    sets = durable(_word_lists(texts).select("text_id", "side", "size", *signs, prefix.alias("prefix")))
    entry = lambda side, tag: sets.filter(F.col("side") == side).select(
        *[F.col(n).alias(f"{tag}_{n}") for n in ("text_id", "size", *signs)], F.explode("prefix").alias("token"))
    sized = (F.col("b_size") >= F.col("a_size") * floor - 1e-9) & (F.col("a_size") >= F.col("b_size") * floor - 1e-9)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in signs])
    most = (F.col("a_size") + F.col("b_size")) * F.lit((1.0 - floor) / (1.0 + floor)) + 1e-6
    met = entry("new", "a").join(entry("past", "b"), "token").filter(sized & (apart <= most)).select("a_text_id", "b_text_id").distinct()
    whole = lambda side, tag: texts.filter(F.col("side") == side).select(
        F.col("text_id").alias(f"{tag}_text_id"), F.col("norm").alias(f"{tag}_norm"))
    pairs = met.join(whole("new", "a"), "a_text_id").join(whole("past", "b"), "b_text_id")
    return pairs.filter(jaccard(words(F.col("a_norm")), words(F.col("b_norm"))) >= floor).select("a_norm", "b_norm")


def word_overlap(left: DataFrame, right: DataFrame, key: str, text: str, minimum: float) -> DataFrame:
    """Jaccard of the word sets of texts which share a rare word, at least
    ``minimum``: (left, right, jaccard) over distinct normal texts."""
    tag = lambda df, side: df.select(comparable(quoted(text)).alias("norm"), F.lit(side).alias("side")).filter("norm <> ''").distinct()
    a, b = tag(left, "new"), tag(right, "past")
    near = _near_pairs(a, b, minimum - 1e-9)
    # The exact figure, from the texts of the pairs that are left.
    overlap = jaccard(F.array_distinct(words(F.col("a_norm"))), F.array_distinct(words(F.col("b_norm"))))
    found = near.select(F.col("a_norm").alias("left_text"), F.col("b_norm").alias("right_text"), overlap.alias("jaccard"))
    return found.filter(F.col("jaccard") >= minimum)


def ranked(df: DataFrame, order, keys: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each key; cut in every task before the shuffle."""
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n)
