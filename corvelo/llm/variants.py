"""Problem 2: variant spellings of names typed by people.

Noisy-channel attribution. Spellings that are frequent, or carry an identifier, are candidate canonical
forms, also those of entities without an identifier, which keep variants from being given to the wrong
one. A variant goes to the candidate of the highest posterior: the candidate's frequency times the
likelihood of the typing errors times the likelihood of the words left out, abbreviated or added. The
word likelihoods are learnt from the rows that carry an identifier.

All work is done once per distinct spelling. Candidates are found through deletion neighbourhoods (two
words within one edit of each other share a form with one letter deleted), an equi-join without a limit
on partners; a spelling that fills a third of the rows is one row here.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corvelo.llm.unify import unify_text
from corvelo.session import cut_lineage

_WORD = re.compile(r"[^\W_]+(?:&[^\W_]+)*")
#: Particles between given name and surname.
PARTICLES = frozenset("da das de del della der di do dos du e la le van von y".split())


def plain(text: str) -> str:
    """The consistent form of a name without accents."""
    text = unify_text(text)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@pandas_udf(ArrayType(StringType()))
def name_words(names: pd.Series) -> pd.Series:
    """The words of a name in plain form; null and empty give none."""
    known = {n: _WORD.findall(plain(n)) for n in names.dropna().unique()}
    return names.map(lambda n: known.get(n, []))


@pandas_udf(ArrayType(StringType()))
def person_words(names: pd.Series) -> pd.Series:
    """The words of a person's name, given names first, surname last, without particles and footnote
    marks; a comma tells which part is the surname. Null and empty give none."""

    def words(name: str) -> list[str]:
        name = re.sub(r"[\d*†‡§¶#]+", " ", plain(name))
        last, comma, first = name.partition(",")
        parts = _WORD.findall(first) + _WORD.findall(last) if comma else _WORD.findall(name)
        return [w for w in parts if w not in PARTICLES or len(w) == 1]

    known = {n: words(n) for n in names.dropna().unique()}
    return names.map(lambda n: known.get(n, []))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b."""
    if a == b:
        return 0
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]  # common ends cost nothing
    if len(a) < 2 and len(b) < 2:
        return 1
    if not a or not b:
        return len(a) or len(b)
    if len(a) == len(b) == 2:
        return 1 if a == b[::-1] else 2
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y) for x, y in zip(a, b)], dtype="int32")


@pandas_udf(ArrayType(StringType()))
def neighbourhood(words: pd.Series) -> pd.Series:
    """A word and its forms with a letter deleted."""
    return words.map(lambda w: sorted({w, *(w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 3)}))


@pandas_udf(ArrayType(StringType()))
def wide_neighbourhood(words: pd.Series) -> pd.Series:
    """A word and its forms with a letter deleted, with two deleted from eight letters on."""

    def forms(w: str) -> list[str]:
        one = {w[:i] + w[i + 1 :] for i in range(len(w))} if len(w) > 3 else set()
        two = {v[:i] + v[i + 1 :] for v in one for i in range(len(v))} if len(w) >= 8 else set()
        return sorted({w} | one | two)

    return words.map(forms)


def _may_be_within(allowed: Column) -> Column:
    """Whether words a and b may be `allowed` edits apart, which the built-in distance tells but for swaps: it counts each as
    two, so what it counts beyond `allowed` are swaps, and these change neither length nor letters."""
    far = F.levenshtein("a", "b")
    left = 2 * allowed - far  # edits besides swaps, where there must be swaps
    beyond = lambda x, y: F.size(F.array_except(F.split(x, ""), F.split(y, "")))
    return (F.levenshtein("a", "b", 4) >= 0) & ((far <= allowed) | (F.abs(F.length("a") - F.length("b")) <= left) & (beyond("a", "b") <= left) & (beyond("b", "a") <= left))


def close_words(left: DataFrame, right: DataFrame, most: int = 2, allowed: Column | None = None) -> DataFrame:
    """Pairs (a, b, d) of words of `left` (a) and `right` (b) at most `most` edits apart, or `allowed`, an expression of a
    and b that is never more. Finds all pairs one edit apart, and for `most` of 2 those two apart from eight letters on."""
    near = wide_neighbourhood if most > 1 else neighbourhood
    allowed = F.lit(most) if allowed is None else allowed
    a = left.select("a").distinct().select("a", F.explode(near("a")).alias("form"))
    b = right.select("b").distinct().select("b", F.explode(near("b")).alias("form"))
    # most pairs are discarded before Python sees them
    # forms are many more than the words whose size Spark knows, so neither side is left to be broadcast
    pairs = a.hint("merge").join(b, "form").where((F.abs(F.length("a") - F.length("b")) <= allowed) & _may_be_within(allowed)).select("a", "b").distinct()
    return pairs.withColumn("d", edit_distance("a", "b")).where(F.col("d") <= allowed)


def attribute_organisations(mentions: DataFrame, spread: float = 0.002, least_spread: int = 6, settled: int = 5, far: float = 10.0, typo: float = 3.0, foreign: float = 4.0, unknown: float = -3.0) -> DataFrame:
    """The organisations of unresolved names: rows (name, country, entity_id, posterior) for each distinct
    name and country of `mentions` (name, country, entity_id, source) whose entity_id is null or empty and whose
    organisation has an identifier in another row.

    Words seen with the share `spread` of all identifiers, and `least_spread` of them at least, are common words of
    organisations (kind, department, country); the others are proper names, in which typing errors cost
    `typo` each. An organisation has a proper name and a kind, a set of common words that most rows of
    organisations with at least `settled` rows share (not one that adds words to that of `far` times as many
    organisations); observed common words weigh by how often they occur
    with that kind in resolved rows, which learns abbreviations, translations and departments. A name of
    common words only is attributed where all resolved rows of its very words have one identifier; null names
    are left out; a spelling counts once per source, as rows may be delivered again. An empty table gives
    an empty result.
    """
    rows = mentions.where(F.length("name") > 0).groupBy("name", F.nullif("country", F.lit("")).alias("country"), F.nullif("entity_id", F.lit("")).alias("entity_id")).agg(F.count_distinct("source").alias("n"))
    spelled = rows.select("name").distinct().withColumn("words", F.array_distinct(name_words("name")))
    rows = cut_lineage(rows.join(spelled, "name"))
    spelled = rows.select("name", "words").distinct()
    resolved, open_ = rows.where("entity_id IS NOT NULL"), rows.where("entity_id IS NULL")
    seen = cut_lineage(resolved.select("entity_id", "n", F.explode("words").alias("w")).groupBy("entity_id", "w").agg(F.sum("n").alias("n")))
    spreads = cut_lineage(seen.groupBy("w").agg(F.count(F.lit(1)).alias("ids")))
    size = cut_lineage(resolved.groupBy("entity_id").agg(F.sum("n").alias("size")))
    all_ids = size.agg(F.greatest(F.lit(least_spread), spread * F.count(F.lit(1))).alias("bound"))
    common = cut_lineage(spreads.crossJoin(F.broadcast(all_ids)).where(F.col("ids") >= F.col("bound")).select("w"))  # one row
    proper = cut_lineage(seen.join(common, "w", "left_anti"))
    # an organisation's proper name: of its frequent words that with the fewest other identifiers
    frequent = proper.join(proper.groupBy("entity_id").agg(F.max("n").alias("most")), "entity_id").where("n >= 0.5 * most").join(spreads, "w")
    place = frequent.groupBy("entity_id").agg(F.max_by("w", F.struct(-F.col("ids"), F.col("n"), F.length("w"), F.col("w"))).alias("place"))
    country = resolved.where("country IS NOT NULL").groupBy("entity_id", "country").agg(F.sum("n").alias("n")).groupBy("entity_id").agg(F.max_by("country", F.struct("n", "country")).alias("home"))
    # kinds: the common words that most rows of a settled organisation share, where another shares them
    kinds = seen.join(common, "w").join(size, "entity_id").where((F.col("size") >= settled) & (F.col("n") >= 0.4 * F.col("size"))).groupBy("entity_id").agg(F.array_sort(F.collect_set("w")).alias("parts"))
    shared = cut_lineage(kinds.groupBy("parts").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1"))
    # a set that only adds words to one of far more organisations is that one with an abbreviation or a country
    each = shared.select("parts", "ids", F.explode("parts").alias("w"))
    fewer = each.select(F.col("parts").alias("fewer"), F.col("ids").alias("of"), "w")
    wider = each.join(fewer, "w").where((F.size("parts") > F.size("fewer")) & (F.col("of") >= far * F.col("ids"))).groupBy("parts", "fewer").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("fewer"))
    shared = shared.select("parts").join(wider.select("parts").distinct(), "parts", "left_anti")
    kinds = cut_lineage(kinds.join(shared, "parts", "left_semi").select("entity_id", "parts", F.array_join("parts", " ").alias("kind")))
    # how likely a common word is with a kind
    by_kind = cut_lineage(size.join(kinds, "entity_id").groupBy("kind", "parts").agg(F.sum("size").alias("total")))
    share = F.least(F.lit(0.98), (F.col("n") + 0.1) / (F.col("total") + 1))
    with_kind = seen.join(common, "w").join(kinds, "entity_id").groupBy("kind", "parts", "w").agg(F.sum("n").alias("n")).join(by_kind.drop("parts"), "kind")
    likely = cut_lineage(with_kind.select("kind", "w", F.log(share).alias("lp"), F.when(F.array_contains("parts", F.col("w")), F.log(1 - share)).otherwise(0.0).alias("without")))
    rest = cut_lineage(by_kind.select("kind", F.log(0.1 / (F.col("total") + 1)).alias("lp0")).join(likely.groupBy("kind").agg(F.sum("without").alias("bare")), "kind"))
    # the likelihood of a name's common words by kind, for the kinds that share one of them: each word held, each
    # word of the kind left out; every other kind has the plain score held * lp0 + bare
    words = spelled.select("name", F.explode("words").alias("w"))
    of_kind = cut_lineage(words.join(common, "w").select("name", "w"))
    held = spelled.select("name").join(of_kind.groupBy("name").agg(F.count(F.lit(1)).alias("held")), "name", "left").fillna(0, ["held"])
    held = cut_lineage(held)
    plain_score = F.col("held") * F.col("lp0") + F.col("bare")
    scored = of_kind.join(likely, "w").join(rest, "kind").groupBy("name", "kind").agg(F.sum(F.col("lp") - F.col("lp0") - F.col("without")).alias("over"))
    # the whole set of telling words as seen with a kind, where that says more than the words one by one
    telling = likely.where(F.col("lp") >= F.log(F.lit(0.05))).select("w").distinct()
    patterns = cut_lineage(of_kind.join(telling, "w").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("pattern")))
    with_pattern = resolved.join(kinds.select("entity_id", "kind"), "entity_id").join(patterns, "name").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).join(by_kind.select("kind", "total"), "kind")
    with_pattern = with_pattern.select("kind", "pattern", F.log(F.col("n") / (F.col("total") + 1)).alias("as_seen"))
    kind_scores = scored.join(held, "name").join(rest, "kind").join(patterns, "name", "left").join(with_pattern, ["kind", "pattern"], "left")
    kind_scores = cut_lineage(kind_scores.select("name", "kind", F.greatest(F.col("over") + plain_score, "as_seen").alias("kind_score"), (F.greatest(F.col("over") + plain_score, "as_seen") - plain_score).alias("over")))
    # a name's own kind: the best of those it shares a word with, or the best by the plain score for as many words
    others = held.where("held > 0").select("held").distinct().join(F.broadcast(rest), F.lit(True)).groupBy("held").agg(F.max_by("kind", plain_score).alias("kind"), F.max(plain_score).alias("kind_score"))  # few counts by kinds
    own = kind_scores.select("name", "kind", "kind_score").unionByName(held.join(others, "held").select("name", "kind", "kind_score"))
    own = own.unionByName(held.where("held = 0").select("name", F.lit("").alias("kind"), F.lit(0.0).alias("kind_score")))
    own = cut_lineage(own.groupBy("name").agg(F.max_by("kind", F.struct("kind_score", "kind")).alias("kind"), F.max("kind_score").alias("own")))
    # an organisation's kind: that under which all its rows are likeliest; none where its rows hold no common word
    whole = resolved.join(held, "name").groupBy("entity_id").agg(F.sum(F.col("n") * F.col("held")).alias("held"), F.sum("n").alias("rows"))
    gains = resolved.select("entity_id", "name", "n").join(kind_scores, "name").groupBy("entity_id", "kind").agg(F.sum(F.col("n") * F.col("over")).alias("over"))
    fit = F.col("over") + F.col("held") * F.col("lp0") + F.col("rows") * F.col("bare")
    kinds = gains.join(whole, "entity_id").join(rest, "kind").groupBy("entity_id").agg(F.max_by("kind", F.struct(fit, F.col("kind"))).alias("kind"))
    # entities: those with an identifier, and frequent names of none
    known = size.join(place, "entity_id").join(kinds, "entity_id", "left").join(country, "entity_id", "left").select("entity_id", "place", F.coalesce("kind", F.lit("")).alias("kind"), "home", "size")
    known = cut_lineage(known)
    proper_words = cut_lineage(words.join(common, "w", "left_anti").join(open_.select("name").distinct(), "name"))
    sources = mentions.where((F.length("name") > 0) & (F.coalesce("entity_id", F.lit("")) == "")).select("name", "source", F.nullif("country", F.lit("")).alias("home")).distinct()
    nameless = proper_words.join(sources, "name").join(own, "name").groupBy(F.col("w").alias("place"), "kind").agg(F.count_distinct("source").alias("size"), F.max("home").alias("home")).where("size > 1")
    nameless = nameless.join(known.select("place", "kind"), ["place", "kind"], "left_anti").join(proper.join(known.select("entity_id", "kind"), "entity_id").select(F.col("w").alias("place"), "kind").distinct(), ["place", "kind"], "left_anti")
    # a proper name alone does not tell of another organisation
    nameless = nameless.where("kind <> ''").unionByName(nameless.where("kind = ''").join(known.select("place").distinct(), "place", "left_anti"))
    # nor does a rare spelling close to the name of a far more frequent one of its kind
    nameless = cut_lineage(nameless)
    close = close_words(nameless.select(F.col("place").alias("a")), known.select(F.col("place").alias("b"))).where("d > 0").select(F.col("a").alias("place"), F.col("b").alias("near"))
    typos = nameless.select("place", "kind", "size").join(close, "place").join(known.select(F.col("place").alias("near"), "kind", F.col("size").alias("of")), ["near", "kind"]).where(F.col("of") >= far * F.col("size")).select("place", "kind").distinct()
    nameless = nameless.join(typos, ["place", "kind"], "left_anti")
    entities = cut_lineage(known.unionByName(nameless.withColumn("entity_id", F.lit(None).cast("string"))))
    # the channel
    near = close_words(proper_words.select(F.col("w").alias("a")), entities.select(F.col("place").alias("b")))
    typed = proper_words.join(near.select(F.col("a").alias("w"), F.col("b").alias("place"), (-typo * F.col("d")).alias("typed")), "w").join(entities, "place")
    observed = proper.join(size, "entity_id").join(known.select("entity_id", "place"), "entity_id").where(F.levenshtein("w", "place", 3) >= 0).select("entity_id", "w", F.log(F.col("n") / F.col("size")).alias("observed"))
    seen_so = proper_words.join(observed, "w").join(known, "entity_id").select("name", "place", "kind", "home", "size", "entity_id", F.col("observed").alias("typed"))
    pairs = typed.select("name", "place", "kind", "home", "size", "entity_id", "typed").unionByName(seen_so)
    pairs = pairs.groupBy("name", "place", "kind", "entity_id").agg(F.max("typed").alias("typed"), F.first("home", True).alias("home"), F.max("size").alias("size"))
    pairs = pairs.join(held, "name").join(rest, "kind", "left").join(kind_scores.drop("over"), ["name", "kind"], "left")
    by_words = F.when(F.col("kind") == "", F.when(F.col("held") == 0, 0.0)).otherwise(F.coalesce("kind_score", plain_score))
    pairs = cut_lineage(pairs.withColumn("kind_score", by_words).where("kind_score IS NOT NULL").drop("held", "lp0", "bare"))
    named = open_.select("name", "country").distinct().join(pairs, "name")
    abroad = F.when(F.col("country") != F.col("home"), -foreign).otherwise(0.0)
    named = named.withColumn("score", F.log(F.col("size").cast("double")) + F.col("typed") + F.col("kind_score") + F.coalesce(abroad, F.lit(0.0)))
    best = named.groupBy("name", "country").agg(
        F.max_by(F.struct("entity_id", "score", "kind_score"), F.struct("score", F.coalesce("entity_id", F.lit("")), "place")).alias("best"), F.max("score").alias("top"), F.collect_list("score").alias("scores")
    )
    best = best.join(own.select("name", "own"), "name")
    none = F.exp(F.col("own") + unknown - F.col("top"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    best = best.where(F.col("best.entity_id").isNotNull()).select("name", "country", F.col("best.entity_id").alias("entity_id"), (1 / (total + none)).alias("posterior")).where("posterior >= 0.5")
    # names of common words only, by their very words
    worded = lambda d: d.where(F.size("words") > 0).withColumn("all_words", F.array_join(F.array_sort("words"), " "))
    exact = worded(resolved).groupBy("all_words").agg(F.count_distinct("entity_id").alias("k"), F.max("entity_id").alias("entity_id"), F.sum("n").alias("n")).where("k = 1")
    rest_ = worded(open_).join(proper_words.select("name").distinct(), "name", "left_anti").join(exact.select("all_words", F.col("entity_id").alias("found"), F.col("n").alias("seen")), "all_words")
    return best.unionByName(rest_.groupBy("name", "country").agg(F.max("found").alias("entity_id"), F.max(F.col("seen") / (F.col("seen") + 1)).alias("posterior")))


def learn_nicknames(exact: DataFrame) -> DataFrame:
    """Short forms (used, given, nick): of rows (used, given, surname), the given name found under at least
    half of the surnames under which a form is used, three at least. A form within one edit of some given
    name is a typing error, not a short form."""
    typed = close_words(exact.select(F.col("used").alias("a")), exact.select(F.col("given").alias("b")), 1)
    exact = exact.join(typed.select(F.col("a").alias("used")).distinct(), "used", "left_anti")
    pairs = exact.groupBy("used", "given").agg(F.count_distinct("surname").alias("n"))
    uses = exact.groupBy("used").agg(F.count_distinct("surname").alias("all"))
    return pairs.join(uses, "used").where((F.col("n") >= 3) & (F.col("n") >= 0.5 * F.col("all"))).select("used", "given", F.lit(True).alias("nick"))


#: Log likelihood of a given name that is no form of a person's.
UNLIKELY = -12.0


def given_likelihood(used: Column, given: Column, middles: Column, middle: Column, nick: Column, d: Column) -> Column:
    """Log likelihood of the written given names (`used`, other words `middles`) for a person's, where `nick` tells of a
    learnt short form and `d` holds the edits from used to given as `close_words` finds them, or null. No Python, as it
    is worked out for every pair of a written name and a person."""
    long = F.when(F.length(given) < 8, 1).otherwise(2)
    # words of three letters have no forms with a letter deleted, so close_words does not pair them
    letter = lambda c, k: F.substring(c, k, 1)
    swapped = (given == F.concat(letter(used, 2), letter(used, 1), letter(used, 3))) | (given == F.concat(letter(used, 1), letter(used, 3), letter(used, 2)))
    d = F.when((F.length(used) == 3) & (F.length(given) == 3), F.when(swapped | (F.levenshtein(used, given) == 1), 1)).otherwise(d)
    first = (
        F.when(used == given, 0.0)
        .when(F.length(used) == 1, F.when(F.startswith(given, used), -1.2).otherwise(UNLIKELY))
        .when(nick | F.startswith(given, used) | (F.length(used) >= 3) & F.endswith(given, used), -2.5)
        .when((F.least(F.length(used), F.length(given)) >= 3) & (d <= long), -3.0 * d)
        .otherwise(UNLIKELY)
    )
    others, known = F.greatest(F.size(middles), F.lit(0)), F.coalesce(middle != "", F.lit(False))
    same = F.exists(middles, lambda o: letter(o, 1) == letter(middle, 1))
    second = F.when((others > 0) & known, F.when(same, 0.0).otherwise(-7.0)).when(others > 0, -4.0 * others).when(known, -0.7).otherwise(0.0)
    return F.when(F.coalesce(used != "", F.lit(False)), first + second).otherwise(-6.0)


def attribute_people(mentions: DataFrame, profiles: DataFrame, typo: float = 3.0, unknown: float = -4.0) -> DataFrame:
    """The persons of written names: rows (name, entity_id, posterior) for each distinct name of `mentions`
    (name, source) that most likely denotes a person of `profiles` (entity_id, preferred).

    A person is a given name, perhaps a middle initial, and a surname; particles are no part of either. A
    written name may be reordered, abbreviated to initials, a nickname (learnt from the names under equal
    surnames) or mistyped. Full names that several sources write and no profile has are persons too,
    without an identifier, and compete. Each profile's frequency is that of its preferred name in
    `mentions`. The exact preferred name gives its own profile. Null and empty names are left out,
    repeated rows of a source count once; empty tables give an empty result.
    """
    rows = mentions.where(F.length("name") > 0).groupBy("name").agg(F.count_distinct("source").alias("n"))
    rows = cut_lineage(rows.withColumn("words", person_words("name")).where(F.size("words") > 0))
    people = profiles.where(F.length("preferred") > 0).groupBy("entity_id").agg(F.max("preferred").alias("preferred")).withColumn("words", person_words("preferred"))
    last = F.element_at("words", -1)
    middle_of = lambda words: F.get(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""), F.lit(0))
    people = people.where(F.size("words") > 1).select("entity_id", "preferred", F.element_at("words", 1).alias("given"), middle_of(F.col("words")).alias("middle"), last.alias("surname"))
    people = people.join(rows.select(F.col("name").alias("preferred"), "n"), "preferred", "left").select("entity_id", "given", "middle", "surname", (F.coalesce("n", F.lit(0)) + 1).alias("size"))
    people = cut_lineage(people)
    # persons without a profile: full names in the usual order
    full = rows.where((F.size("words") > 1) & (F.length(F.element_at("words", 1)) > 2) & (F.length(last) > 2)).select(F.element_at("words", 1).alias("given"), middle_of(F.col("words")).alias("middle"), last.alias("surname"), "n")
    givens = people.select("given").distinct()
    others = full.groupBy("given", "surname").agg(F.sum("n").alias("size"), F.max_by("middle", F.struct("n", "middle")).alias("middle")).where("size > 1")
    others = others.join(givens, "given", "left_semi").join(people.select("given", "surname"), ["given", "surname"], "left_anti")
    others = others.join(people.select(F.col("given").alias("surname")).distinct(), "surname", "left_anti")
    persons = cut_lineage(people.unionByName(others.select(F.lit(None).cast(people.schema["entity_id"].dataType).alias("entity_id"), "given", "middle", "surname", "size")))
    # candidates: any word but a lone letter may be the surname, the rest are given names
    parts = rows.select("name", "words", F.posexplode("words").alias("at", "w")).where(F.length("w") > 1)
    near = close_words(parts.select(F.col("w").alias("a")), persons.select(F.col("surname").alias("b"))).select(F.col("a").alias("w"), F.col("b").alias("surname"), "d")
    rest = F.expr("filter(words, (x, i) -> i <> at)")
    long_first = F.coalesce(F.get(F.filter(rest, lambda x: F.length(x) > 1), F.lit(0)), F.get(rest, F.lit(0)))
    found = parts.join(near, "w").select("name", "d", "surname", rest.alias("rest"), F.when(F.length(F.get(rest, F.lit(0))) > 1, F.get(rest, F.lit(0))).otherwise(long_first).alias("used"))
    found = cut_lineage(found.withColumn("middles", F.expr("filter(rest, (x, i) -> i <> array_position(rest, used) - 1)")).drop("rest"))
    exact = found.where((F.col("d") == 0) & (F.length("used") > 1)).select("used", "surname").distinct().join(people.select("given", "surname").distinct(), "surname")
    # edits between given names: a map for each written one, so that a pair with a person only looks it up
    typed = close_words(found.select(F.col("used").alias("a")).where("a IS NOT NULL"), persons.select(F.col("given").alias("b"))).where("d > 0")
    typed = cut_lineage(typed.groupBy(F.col("a").alias("used")).agg(F.map_from_entries(F.collect_list(F.struct("b", "d"))).alias("near")))
    apart = F.try_element_at("near", F.col("given"))
    # only forms that the likelihood does not accept by themselves need learning
    alone = given_likelihood(F.col("used"), F.col("given"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(False), apart)
    exact = exact.where(~F.col("given").startswith(F.col("used"))).join(typed, "used", "left")
    exact = cut_lineage(exact.where(alone <= UNLIKELY).drop("near"))
    nicknames = cut_lineage(learn_nicknames(exact))
    pairs = found.join(typed, "used", "left").join(persons, "surname").join(nicknames, ["used", "given"], "left")
    pairs = pairs.withColumn("score", F.log(F.col("size").cast("double")) - typo * F.col("d") + given_likelihood(F.col("used"), F.col("given"), F.col("middles"), F.col("middle"), F.coalesce("nick", F.lit(False)), apart))
    pairs = cut_lineage(pairs.groupBy("name", "entity_id", "given", "surname").agg(F.max("score").alias("score")))
    best = pairs.groupBy("name").agg(F.max_by("entity_id", F.struct("score", "given", "surname")).alias("entity_id"), F.max("score").alias("top"), F.collect_list("score").alias("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return best.where("entity_id IS NOT NULL").select("name", "entity_id", (1 / (total + F.exp(F.lit(unknown) - F.col("top")))).alias("posterior")).where("posterior >= 0.5")
