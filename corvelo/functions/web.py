"""Scalar functions on addresses and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvelo.functions.text import collapse, strip_tags, unescape
from corvelo.functions.vocabulary import HOST_IGNORED, OFFICIAL_HOSTS, REGISTRY_HOSTS, SOCIAL_HOSTS


def full_host(url: Column) -> Column:
    """The host of an address in lower case; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def host(url: Column) -> Column:
    """The host of an address in lower case without www; null where it has none."""
    return F.regexp_replace(full_host(url), r"^www\.", "")


def under(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith(f".{domain}")


def source_authority(url: Column) -> Column:
    """0 for official endings, 1 for registries, 3 for social sites, 2 for the rest."""
    h = F.coalesce(full_host(url), F.lit(""))
    ends = lambda endings: F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(h, e))
    return F.when(ends(OFFICIAL_HOSTS), 0).when(h.isin(REGISTRY_HOSTS), 1).when(ends(SOCIAL_HOSTS), 3).otherwise(2)


def first_party(url: Column, words: Column) -> Column:
    """Whether a page is official, a registry's, or has a telling word of the organisation (four letters and
    more) as a word of its host."""
    telling = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(HOST_IGNORED))
    return (source_authority(url) <= 1) | F.arrays_overlap(telling, F.split(F.coalesce(full_host(url), F.lit("")), "[^a-z0-9]+"))


def profile_page(url: Column, author_words: Column) -> Column:
    """Whether a professional profile address names the author."""
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[\w-]+\.)*linkedin\.com/in/([^/?#]+)", 1))
    return (path != "") & F.forall(author_words, lambda w: F.contains(path, w))


def meta(html: Column, name: str) -> Column:
    """Contents of the meta tags of a name, in order."""
    either = rf"""(?is)<meta\s[^>]*?name\s*=\s*["']{name}["'][^>]*?content\s*=\s*["']([^"']*)["']"""
    return F.transform(F.regexp_extract_all(html, F.lit(either), 1), lambda x: F.trim(x))


def first_abstract(html: Column, patterns: list[str], least: int = 80) -> Column:
    """The first pattern's cleaned group of at least `least` characters; null where there is none."""
    cleaned = [strip_tags(unescape(F.nullif(F.regexp_extract(html, p, 1), F.lit("")))) for p in patterns]
    return F.coalesce(*(F.when(F.length(c) >= least, c) for c in cleaned))


def page_title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)["']"""), 1)


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0, retry_after: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds before an attempt: doubled each time, no less than asked for, no more than `most`, plus jitter."""
    wanted = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    if retry_after is not None:
        wanted = F.greatest(wanted, F.coalesce(retry_after, F.lit(0.0)))
    return F.least(F.lit(most), wanted) + (F.coalesce(jitter, F.lit(0.0)) if jitter is not None else F.lit(0.0))


def is_pdf(content: Column) -> Column:
    return (F.length(content) > 4) & (F.substring(content, 1, 4) == F.unhex(F.lit("25504446")))


def unwrap(json: Column) -> Column:
    """The value of {"value": x}, else the text itself."""
    return F.coalesce(F.get_json_object(F.when(json.rlike(r"^\s*\{"), json), "$.value"), json)
