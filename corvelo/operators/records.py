"""Record algebra: selection, complement, overlay, evidence merge, precedence, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvelo.functions.text import iso_date, let, organisation_keys
from corvelo.functions.vocabulary import NON_AUTHOR_ORGANIZATIONS
from corvelo.operators.checks import require_covered


def first_per_key(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`. Rows of a key are reduced before the shuffle: the winner is
    the minimum of (order, row), so a hot key costs no more than another."""
    whole = F.struct(*order_fields(order), F.struct(*frame.columns).alias("row"))
    best = frame.groupBy(*keys).agg(F.min(whole).alias("w"))
    return best.select("w.row.*")


def order_fields(order: list[Column]) -> list[Column]:
    return [c.alias(f"o{k}") for k, c in enumerate(order)]


def last_per_key(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by one column."""
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*frame.columns), order).alias("w")).select("w.*")


def last_value_first_place(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, at the place (`position`) of its first."""
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*frame.columns), order).alias("w"), F.min(order).alias("position")).select("w.*", "position")


def select_records(frame: DataFrame, wanted: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows whose key is wanted; `strict` raises where a wanted key has none."""
    if strict:
        require_covered(wanted, frame, keys)
    return frame.join(wanted.select(*keys).distinct(), keys, "left_semi")


def complement(frame: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not taken; null keys equal null keys."""
    a, b = frame.alias("a"), taken.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def overlay(base: DataFrame, updates: DataFrame, keys: list[str], order: str, strict: bool = False) -> DataFrame:
    """Base rows replaced by their last update (by `order`); the columns are those of base. `strict` raises
    for updates of unknown keys, which are ignored otherwise."""
    if strict:
        require_covered(updates, base, keys)
    rest = [c for c in base.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_u"))
    joined = base.join(last, keys, "left")
    return joined.select(*[F.col(k) if k in keys else F.when(F.col("_u").isNotNull(), F.col(f"_u.{k}")).otherwise(F.col(k)).alias(k) for k in base.columns])


def merge_evidence(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Union of evidence per key: the update's openalex_id where it has one, methods and diagnostics in
    order without repeats, affiliations merged. `updates` has one row a key at most; rows without update
    stay as they are."""
    u = updates.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("openalex_id", "match_method", "affiliations", "diagnostics")), F.lit(True).alias("_has"))
    joined = base.join(u, keys, "left")
    blank = lambda c: F.nullif(c, F.lit(""))
    methods = F.array_join(F.array_distinct(F.filter(F.concat(F.split(F.coalesce("match_method", F.lit("")), r"\+"), F.split(F.coalesce("_match_method", F.lit("")), r"\+")), lambda m: m != "")), "+")
    merged = {
        "openalex_id": F.coalesce(blank(F.col("_openalex_id")), F.col("openalex_id")),
        "match_method": F.when(F.col("_has"), F.nullif(methods, F.lit(""))).otherwise(F.col("match_method")),
        "diagnostics": F.when(F.col("_has"), F.array_distinct(F.concat(F.coalesce("diagnostics", F.array()), F.coalesce("_diagnostics", F.array())))).otherwise(F.col("diagnostics")),
        "affiliations": F.when(F.col("_has"), merge_affiliations(F.concat(F.coalesce("affiliations", F.array()), F.coalesce("_affiliations", F.array())))).otherwise(F.col("affiliations")),
    }
    return joined.select(*[merged.get(c, F.col(c)).alias(c) for c in base.columns])


def merge_affiliations(items: Column) -> Column:
    """One affiliation per (name key, country) in order of first appearance: the last one given where it has
    a country, else that of the shortest name, the earlier of equals. One with a country supersedes those
    of its name without. Publishers and names without letters are left out; null stays null."""
    country = lambda x: F.coalesce(x["a"]["country_code"], F.lit(""))
    same = lambda x, y: (x["k"] == y["k"]) & (country(x) == country(y))
    pairs = F.arrays_zip(organisation_keys(F.transform(items, lambda a: a["institution_name"])).alias("k"), items.alias("a"))
    own = F.filter(pairs, lambda x: (x["k"] != "") & ~x["k"].rlike("|".join(NON_AUTHOR_ORGANIZATIONS)))

    def settled(all_: Column) -> Column:
        resolved = F.transform(F.filter(all_, lambda x: country(x) != ""), lambda x: x["k"])
        return F.filter(all_, lambda x: (country(x) != "") | ~F.array_contains(resolved, x["k"]))

    def chosen(kept: Column) -> Column:
        firsts = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: same(x, y)))

        def best(x: Column) -> Column:
            group = F.filter(kept, lambda y: same(x, y))
            shortest = F.array_min(F.transform(group, lambda y, i: F.struct(F.length(y["a"]["institution_name"]).alias("n"), i.alias("i"))))["i"]
            return F.when(country(x) != "", F.element_at(group, -1)).otherwise(F.get(group, shortest))["a"]

        return F.transform(firsts, best)

    whole = let(let(own, settled), chosen)
    return whole


def replace_group(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which all base rows of a key that `fresh` holds are replaced."""
    return complement(base, fresh, keys).unionByName(fresh)


def context_precedence(rows: DataFrame, keys: list[str], order: str, error: str) -> DataFrame:
    """One row a key: the last success, or, where there is none, the last error. A failed retry never
    replaces a success."""
    good = F.coalesce(F.col(error), F.lit("")) == ""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(good.cast("int"), F.col(order))).alias("w")).select("w.*")


def conflict_checked(rows: DataFrame, keys: list[str], agreed: list[str], source: str) -> DataFrame:
    """One row a key with the agreed columns, joined sources, and whether rows disagreed on them."""
    return rows.groupBy(*keys).agg(*(F.min(c).alias(c) for c in agreed), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("source_set"), (F.count_distinct(F.struct(*agreed)) > 1).alias("conflict"))


def relabel(frame: DataFrame, column: str, old: str, new: str, struct: str | None = None) -> DataFrame:
    """A venue key renamed, at the top or in a struct column."""
    change = lambda c: F.when(c == old, new).otherwise(c)
    if struct:
        return frame.withColumn(struct, F.col(struct).withField(column, change(F.col(f"{struct}.{column}"))))
    return frame.withColumn(column, change(F.col(column)))


def with_outcome(frame: DataFrame, outcome: str) -> DataFrame:
    """Rows with some diagnostic of an outcome."""
    return frame.where(F.exists(F.coalesce("diagnostics", F.array()), lambda d: d["outcome"] == outcome))


def before_after(expected: DataFrame, before: DataFrame, after: DataFrame, key: str, values: str) -> DataFrame:
    """Per expectation: sets before and after, missing and extra members of either, exactness."""
    empty = F.array().cast("array<string>")
    b, a = before.select(key, F.col(values).alias("before")), after.select(key, F.col(values).alias("after"))
    joined = expected.select(key, F.col(values).alias("expected")).join(b, key, "left").join(a, key, "left").withColumns({"before": F.coalesce("before", empty), "after": F.coalesce("after", empty)})
    exact = lambda c: F.array_sort(c) == F.array_sort("expected")
    return joined.select(key, "expected", "before", "after", F.array_sort(F.array_except("expected", "after")).alias("missing"), F.array_sort(F.array_except("after", "expected")).alias("extra"), exact("before").alias("exact_before"), exact("after").alias("exact_after"))


def keep_first_union(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Labelled union of frames in which the earlier frame wins a key."""
    tagged = None
    for place, frame in enumerate(frames):
        part = frame.withColumn("_place", F.lit(place))
        tagged = part if tagged is None else tagged.unionByName(part)
    return first_per_key(tagged, keys, [F.col("_place")]).drop("_place")


def url_first(rows: DataFrame, url: str, rank: str, order: str) -> DataFrame:
    """One row a URL: lowest source rank, then first seen."""
    return first_per_key(rows, [url], [F.col(rank), F.col(order)])


def running(frame: DataFrame, keys: list[str], order: str, value: str, into: str) -> DataFrame:
    """A running sum within keys."""
    return frame.withColumn(into, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def zipped(frame: DataFrame, keys: list[str], left: str, right: str, separator: str = ",") -> DataFrame:
    """Two delimited lists of equal order as rows (keys, left, right); a missing right entry is empty."""
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x))
    pairs = F.arrays_zip(cut(left).alias("l"), cut(right).alias("r"))
    return frame.select(*keys, F.explode(pairs).alias("z")).select(*keys, F.col("z.l").alias(left), F.coalesce("z.r", F.lit("")).alias(right)).where(F.col(left) != "")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises where a key repeats on either side."""
    from corvelo.operators.checks import require_unique

    return require_unique(left, keys).join(require_unique(right, keys), keys)


def remap(frame: DataFrame, column: str, names: dict[str, str], dropped: list[str] = []) -> DataFrame:  # noqa: B006
    """Categories renamed by a small table, some left out; others stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return frame.where(~F.col(column).isin(dropped) if dropped else F.lit(True)).withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def labelled_union(frames: dict[str, tuple[DataFrame, dict[str, str]]], columns: list[str]) -> DataFrame:
    """Union of sources with their columns renamed (source column by target), tagged with `source_set`."""
    whole = None
    for name, (frame, renamed) in frames.items():
        part = frame.select(*(F.col(renamed.get(c, c)).alias(c) if renamed.get(c, c) in frame.columns else F.lit(None).cast("string").alias(c) for c in columns)).withColumn("source_set", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def fetch_route(venue: Column, doi: Column, url: Column, routes: dict[str, str]) -> Column:
    """How a context is to be fetched: the venue's own route, else by DOI, else by page, else none."""
    own = F.lit(None).cast("string")
    for key, route in routes.items():
        own = F.when(venue == key, route).otherwise(own)
    return F.coalesce(own, F.when(F.length(doi) > 0, "doi").when(F.length(url) > 0, "page"), F.lit("none"))


def training_hash(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of training rows that does not depend on their order."""
    line = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return frame.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(line), F.lit(0)).cast("string")), 256).alias("training_hash"))


def without_country(frame: DataFrame, affiliations: str = "affiliations") -> DataFrame:
    """Records of which no affiliation has a country; null and empty lists count."""
    return frame.where(~F.exists(F.coalesce(affiliations, F.array()), lambda a: F.coalesce(a["country_code"], F.lit("")) != ""))


def between_dates(frame: DataFrame, day: str, first: str, last: str, filled: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows whose text date lies between two days, both included, and whose `filled` columns are not blank;
    dates that are none leave a row out."""
    inside = iso_date(F.col(day)).between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    for c in filled:
        inside = inside & (F.trim(F.col(c)) != "")
    return frame.where(inside)


def distinct_ids(frames: list[DataFrame], column: str, where: Column | None = None) -> DataFrame:
    """The distinct trimmed ids, blanks left out, of one column across frames."""
    whole = None
    for frame in frames:
        part = (frame.where(where) if where is not None else frame).select(F.trim(column).alias(column)).where(F.col(column) != "")
        whole = part if whole is None else whole.unionByName(part)
    return whole.distinct()


def next_revision(current: DataFrame, edits: DataFrame, keys: list[str], revision: str = "revision") -> tuple[DataFrame, DataFrame]:
    """(rows after the edits, refused edits). An edit holds the revision it was made on; it replaces the row and
    counts one up where that is still the row's, and is refused otherwise. Of several edits on one revision the
    smallest row counts, the others are refused."""
    first = first_per_key(edits.join(current.select(*keys, revision), [*keys, revision]), [*keys, revision], [])
    taken = first.select(current.columns).withColumn(revision, F.col(revision) + 1)
    rest = edits.exceptAll(first.select(edits.columns))
    return replace_group(current, taken, keys), rest
