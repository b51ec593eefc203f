"""Text functions as column expressions: Turkish case, slugs, domains, intents, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark what a searcher wants, in normal form.
INFORMATIONAL = ("nasıl", "nedir", "neden", "ne zaman", "kaç", "rehber", "temizlenir", "ölçülür", "yapılır")
COMMERCIAL = ("fiyat", "satın al", "ucuz", "en iyi", "indirim", "kampanya", "öneri", "model")
LOCAL = ("mağaza", "mağazası", "nerede", "yakınımda", "adres")
CITIES = ("istanbul", "ankara", "izmir", "bursa", "antalya", "adana", "konya", "gaziantep", "kayseri", "eskişehir")

STEM = 5
_EDGES = r"^[\s ﻿]+|[\s ﻿]+$"
_SPACES = r"[\s ﻿]+"


def tr_normalize(c: Column) -> Column:
    """Turkish lower case (I to dotless, dotted capital to i), trimmed of every kind of white space."""
    return F.regexp_replace(F.lower(F.translate(c, "Iİ", "ıi")), _EDGES, "")


def tr_contains(haystack: Column, needle: Column) -> Column:
    return F.contains(tr_normalize(haystack), tr_normalize(needle))


def slugify(c: Column) -> Column:
    plain = F.translate(tr_normalize(c), "ığüşöç", "igusoc")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mention_key(c: Column) -> Column:
    """A slug without its hyphens, for finding brands in running text."""
    return F.replace(slugify(c), F.lit("-"), F.lit(""))


def root_domain(url: Column) -> Column:
    """Host of a URL with or without scheme, port kept, ``www.`` dropped."""
    host = F.split_part(F.regexp_replace(url, r"^(?i)[a-z]+://", ""), F.lit("/"), F.lit(1))
    return F.regexp_replace(host, r"^(?i)www\.", "")


def _any_in(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def classify_intent(keyword: Column, brand_tokens: Column) -> Column:
    """branded, local, commercial or informational, the first that holds; commercial where none does."""
    text = tr_normalize(keyword)
    branded = F.exists(brand_tokens, lambda b: F.contains(text, tr_normalize(b)))
    return F.when(branded, "branded").when(_any_in(text, LOCAL + CITIES), "local").when(_any_in(text, COMMERCIAL), "commercial").when(_any_in(text, INFORMATIONAL), "informational").otherwise("commercial")


def marker_words() -> list[str]:
    return sorted({w for m in INFORMATIONAL + COMMERCIAL + LOCAL + CITIES for w in m.split()})


def cluster_id(keyword: Column, intent: Column) -> Column:
    """First letters of the longest word (the first of equally long ones) that no marker word begins, and the intent."""
    markers = F.array(*map(F.lit, marker_words()))
    words = F.filter(F.split(tr_normalize(keyword), _SPACES), lambda t: (F.length(t) >= 3) & ~F.exists(markers, lambda m: F.startswith(t, m)))
    longest = F.array_max(F.transform(words, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("word"))))["word"]
    return F.concat_ws("-", F.substring(F.coalesce(longest, F.lit("genel")), 1, STEM), intent)
