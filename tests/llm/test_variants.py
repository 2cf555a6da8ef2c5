import random

import pytest
from pyspark.sql import functions as F

from corvelo.llm import queries as Q
from corvelo.llm.variants import UNLIKELY, attribute_organisations, attribute_people, close_words, edits, given_likelihood

ORG = "name string, country string, entity_id string, source string"


def test_edits():
    assert edits("abc", "acb") == 1 and edits("", "ab") == 2 and edits("kitten", "sitting") == 3 and edits("x", "x") == 0


def plain_edits(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            row.append(min(best, rows[-2][j - 2] + 1) if i > 1 < j and (x, a[i - 2]) == (b[j - 2], y) else best)
        rows.append(row)
    return rows[-1][-1]


def test_edits_without_common_ends():
    draw = random.Random(5)
    words = ["".join(draw.choices("abc", k=draw.randrange(8))) for _ in range(150)]
    assert all(edits(a, b) == plain_edits(a, b) for a in words for b in words)


def test_likelihood_of_given_names_needs_no_python(spark):
    def one(u, g, others, m, n):
        if not u:
            return -6.0
        first = UNLIKELY
        if u == g:
            first = 0.0
        elif len(u) == 1:
            first = -1.2 if g.startswith(u) else UNLIKELY
        elif n or g.startswith(u) or len(u) >= 3 and g.endswith(u):
            first = -2.5
        elif min(len(u), len(g)) >= 3 and (d := plain_edits(u, g)) <= (1 if len(g) < 8 else 2):
            first = -3.0 * d
        if others:
            return first + ((0.0 if any(o[0] == m[0] for o in others) else -7.0) if m else -4.0 * len(others))
        return first - (0.7 if m else 0.0)

    given = ["ana", "eva", "ivo", "luca", "lucas", "raquel", "gabriela", "sebastian", "alexandre"]
    draw = random.Random(7)
    used = {None, "", "a", "g", "an", "aan", "nas", "nuca", "lcua", "el", "uel", "briela", "tian", *given}
    for g in given:
        for _ in range(40):
            u = list(g)
            for _ in range(draw.choice((1, 1, 2, 3))):
                k = draw.randrange(len(u))
                u[k : k + 2] = draw.choice((u[k : k + 2][::-1], u[k + 1 : k + 2], [u[k], "x", *u[k + 1 : k + 2]], ["y", *u[k + 1 : k + 2]])) or ["z"]
            used.add("".join(u))
    cases = [(u, g, o, m, n) for u in used for g in given for o, m, n in ((None, None, False), (["f"], "f", False), (["b", "frank"], "felix", False), (["c", "d"], None, False), ([], "k", True), ([], "", False))]
    rows = spark.createDataFrame(cases, "used string, given string, middles array<string>, middle string, nick boolean")
    near = spark.createDataFrame([(u,) for u in used if u], "a string")
    near = close_words(near, spark.createDataFrame([(g,) for g in given], "b string")).select(F.col("a").alias("used"), F.col("b").alias("given"), "d").where("d > 0")
    near = spark.createDataFrame(near.collect(), near.schema)
    scored = rows.join(near, ["used", "given"], "left").withColumn("score", given_likelihood(*(F.col(c) for c in ("used", "given", "middles", "middle", "nick", "d"))))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    got = scored.collect()
    assert len(got) == len(cases) and all(r.score == pytest.approx(one(r.used, r.given, r.middles, r.middle, r.nick)) for r in got)


def mentions():
    rows = []
    kinds = [("University of {}", ["Univ. of {}", "{}, University of"]), ("{} Institute of Technology", ["{} Inst. of Tech.", "{} IT"]), ("{} Central Hospital", ["Central Hosp. of {}", "{} Central Hosp."])]
    places = [f"{a}{b}{c}" for a in ("bor", "len", "mir", "tas") for b in ("dol", "fen", "kar") for c in ("vim", "gra")]
    for k, place in enumerate(places):
        full, short = kinds[k % 3]
        for n in range(8):
            rows.append((full.format(place.title()), "BR", f"I{k}", f"p{k}-{n}"))
        for n, s in enumerate(short):
            rows.append((s.format(place.title()), None, f"I{k}", f"q{k}-{n}"))
    return rows, kinds, places


def test_organisations(spark):
    rows, kinds, places = mentions()
    rows += [("Universty of Bordolvm", None, "", "x1"), ("Univ. of Bordolvim", "BR", None, "x2"), ("Unknown Laboratories", None, "", "x3"), (None, None, "", "x4"), ("", None, "", "x5"), ("BORDOLGRA IT", "BR", "", "x6")]
    rows += [("Bordolzim Central Hospital", "BR", "", f"y{k}") for k in range(5)]  # frequent, never resolved
    got = {r.name: r.entity_id for r in attribute_organisations(spark.createDataFrame(rows, ORG)).collect()}
    at = {p: f"I{k}" for k, p in enumerate(places)}
    assert got["Univ. of Bordolvim"] == at["bordolvim"] and got["BORDOLGRA IT"] == at["bordolgra"]
    assert "Unknown Laboratories" not in got and "Bordolzim Central Hospital" not in got
    assert attribute_organisations(spark.createDataFrame([], ORG)).count() == 0


def test_people(spark):
    profiles = spark.createDataFrame([("~a", "Wanda Pisenskarn"), ("~b", "José F. de Lurbormatti"), ("~c", "Raquel Tonkortimwen"), ("~c", "Raquel Tonkortimwen"), ("~d", None)], "entity_id string, preferred string")
    names = ["Wanda Pisenskarn", "PISENSKARN, Wanda", "W. Pisenskarn", "Wanda Pisenskran*", "Jose Lurbormatti", "Quel Tonkortimwen", "Zed Pisenskarn", "Nobody Else", None, "", "Q. Pisenskarn"]
    got = {r.name: r.entity_id for r in attribute_people(spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "name string, source string"), profiles).collect()}
    assert got == {"Wanda Pisenskarn": "~a", "PISENSKARN, Wanda": "~a", "W. Pisenskarn": "~a", "Wanda Pisenskran*": "~a", "Jose Lurbormatti": "~b", "Quel Tonkortimwen": "~c"}
    assert attribute_people(spark.createDataFrame([], "name string, source string"), profiles).count() == 0


def test_short_forms_with_the_first_letters_are_learnt(spark):
    people = [("Serginho", "Sergio", s) for s in ("Bordolvim", "Lenfengra", "Mirkarvim")] + [("Dora", "Dorothea", s) for s in ("Tasdolgra", "Pisenskarn", "Tonkortimwen")]
    profiles = spark.createDataFrame([(f"~{s}", f"{given} {s}") for _, given, s in people], "entity_id string, preferred string")
    names = [f"{short} {s}" for short, _, s in people] + ["Serzinhu Bordolvim"]  # seen under one surname only
    got = {r.name: r.entity_id for r in attribute_people(spark.createDataFrame([(n, str(k)) for k, n in enumerate(names)], "name string, source string"), profiles).collect()}
    assert got == {f"{short} {s}": f"~{s}" for short, _, s in people}


def test_query(spark, folder):
    assert Q.p2_found(spark, folder).columns == ["field", "seq", "pos", "entity_id"]


def test_rare_kinds_and_near_spellings(spark):
    """A set of words that only adds to a common one is no kind; a rare spelling near a frequent name is a typing error;
    a name of common words only goes by its very words."""
    places = [f"{a}{b}olm" for a in ("Kar", "Vin", "Tes", "Mor", "Lud", "Bran") for b in ("dan", "fel", "gri", "hus")]
    rows = [(f"State University of {p}", "BR", f"I{k}", f"s{k}-{n}") for k, p in enumerate(places) for n in range(30 if k == 0 else 6)]
    rows += [(f"State Univ. University of {p}", "BR", f"J{k}", f"j{k}-{n}") for k, p in enumerate(("Zapfern", "Quorvik")) for n in range(6)]
    rows += [("Kardanolm State Univ.", "BR", "I0", "a1"), ("State University", "BR", "K1", "a2")]
    open_ = [("State Univ. University of Kardanolm", "BR", None, "o1"), ("State University of Kardanolmm", "BR", None, "o2"), ("University of Kardanolmm State", "BR", "", "o3"), ("University State", "BR", None, "o4"), ("State University of Nowhereville", "BR", None, "o5"), (None, None, None, "o6")]
    d = spark.createDataFrame(rows + open_, "name string, country string, entity_id string, source string")
    got = {r["name"]: r.entity_id for r in attribute_organisations(d).collect()}
    assert got == {"State Univ. University of Kardanolm": "I0", "State University of Kardanolmm": "I0", "University of Kardanolmm State": "I0", "University State": "K1"}
