"""Names, hosts, streets and other short texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company kinds in legal names.
LEGAL_SUFFIXES = ("as", "asa", "ans", "da", "sa", "ba", "nuf", "ks", "enk", "iks", "bbl", "brl", "sti", "kf", "fli", "ab", "ltd", "inc", "gmbh")
#: Second-level domains under which others register.
SECOND_LEVEL = ("co", "com", "org", "net", "priv", "kommune", "gs", "vgs")
#: Hosts of social networks and their names.
NETWORKS = {
    "linkedin.com": "linkedin", "facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "twitter.com": "x",
    "x.com": "x", "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok",
}


def _marked_letters() -> tuple[str, str]:
    pairs = {"ø": "o", "å": "a", chr(0xA0): " ", chr(0x2007): " ", chr(0x202F): " "}
    for code in range(0xC0, 0x250):
        char = chr(code).lower()
        base = unicodedata.normalize("NFKD", char)
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and unicodedata.combining(base[1]):
            pairs[char] = base[0]
    return "".join(pairs), "".join(pairs.values())


_MARKED = _marked_letters()


def fold(text: Column) -> Column:
    """Lower-case ASCII: letters lose their marks, æ becomes ae, what has no ASCII letter goes."""
    plain = F.translate(F.lower(text), *_MARKED)
    return F.regexp_replace(F.replace(plain, F.lit("æ"), F.lit("ae")), r"[^\x00-\x7F]", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


def name_tokens(name: Column) -> Column:
    """Tokens of a legal name without company kinds; all of them if nothing else is left."""
    every = tokens(name)
    kept = F.filter(every, lambda t: ~t.isin(*LEGAL_SUFFIXES))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def contains_all(hay: Column, needle: Column) -> Column:
    """Whether all tokens of ``needle`` are among those of ``hay``; false for an empty needle."""
    return (F.size(needle) > 0) & (F.size(F.array_except(needle, hay)) == 0)


def host(url: Column) -> Column:
    """Host in lower case without ``www.``; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?([a-z0-9.\-]+)", 1)
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def registered_domain(url: Column) -> Column:
    """The last two labels of a host, three below a second-level domain of .no or .uk."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & F.element_at(labels, -1).isin("no", "uk")
    keep = F.when(deep, 3).otherwise(F.least(n, F.lit(2)))
    return F.when(host(url).isNotNull(), F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def host_suffixes(url: Column) -> Column:
    """A host and its parent domains: what an exact join needs to match "the host or a subdomain of it"."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    return F.when(
        host(url).isNotNull(),
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")),
    )


def network(url: Column) -> Column:
    """The social network of a URL; null for other hosts."""
    of = F.create_map(*[F.lit(x) for pair in NETWORKS.items() for x in pair])
    return F.try_element_at(of, registered_domain(url))


def street(address: Column) -> Column:
    """Street tokens with the usual short forms written out."""
    plain = F.array_join(tokens(address), " ")
    for short, full in (("gt", "gate"), ("vn", "veien"), ("v", "vei"), ("pl", "plass")):
        plain = F.regexp_replace(plain, rf"\b{short}\b", full)
    return plain


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))


def normal_name(text: Column) -> Column:
    """A name as lower-case words between single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "))


def phone_digits(text: Column) -> Column:
    """The last eight digits of a phone number of eight digits or with a country code; else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(8)))


def page_priority(url: Column) -> Column:
    """Order in which pages of a site are worth reading: contact and about pages first."""
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z]+:)?//[^/]*([^?#]*)", 1), F.lit("")))
    return (
        F.when(path.isin("", "/"), 0)
        .when(path.rlike("kontakt|contact"), 1)
        .when(path.rlike("(^|[/-])om([/-]|$)|about"), 2)
        .when(path.rlike("ledige|stilling|soker|jobb|career|wanted"), 3)
        .when(path.rlike("nytt|nyhet|aktuelt|news"), 4)
        .otherwise(5)
    )


#: Legal forms that stand before or after a name's core.
NAME_FORMS = ("as", "asa", "ans", "da", "sa", "enk", "nuf", "ba", "ks", "sf", "iks")


def core_name(name: Column) -> Column:
    """A legal name in lower case without legal forms at either end; empty where nothing else is left."""
    words = F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", " ")))
    forms = "|".join(NAME_FORMS)
    return F.regexp_replace(F.regexp_replace(words, rf"( |^)(({forms})( |$))+$", ""), rf"^(({forms}) )+", "")


def handle_of_company(handle: Column, name: Column, site: Column) -> Column:
    """Whether a social handle holds all words of a company's name, or the whole label of its domain where that has four letters or more."""
    compact = F.regexp_replace(fold(handle), "[^a-z0-9]", "")
    words = name_tokens(name)
    label = F.replace(F.element_at(F.split(registered_domain(site), r"\."), 1), F.lit("-"), F.lit(""))
    named = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(compact, w))
    return F.coalesce((compact != "") & (named | ((F.length(label) >= 4) & F.contains(compact, label))), F.lit(False))
