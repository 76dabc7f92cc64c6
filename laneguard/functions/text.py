"""Text column helpers: ids, HTML, URLs, place names."""

from __future__ import annotations

import html as html_lib
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Any whitespace a feed can carry, also no-break and other Unicode spaces; valid in Java and RE2 patterns.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
TAG = "<[^>]+>"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
SUMMARY_MAX_CHARS = 600
PROMPT_TEXT_MAX_CHARS = 2000
MAX_SLUG_WORD = 25

# Words of a URL path that mark logistics news.
LOGISTICS_WORDS = (
    "ship", "ships", "shipping", "shipper", "shippers", "shipment", "shipments", "port", "ports", "canal", "vessel",
    "vessels", "freight", "cargo", "container", "containers", "containership", "tanker", "tankers", "maritime", "suez",
    "houthi", "houthis", "hormuz", "malacca", "panama", "logistics", "dock", "docks", "dockworkers", "strait",
    "seafarers", "maersk", "msc", "hapag", "cma", "cgm", "evergreen", "boxship",
)
LOGISTICS_PHRASES = ("red-sea", "supply-chain", "bab-el-mandeb", "ever-given", "cape-of-good-hope")
SLUG_STOPWORDS = ("news", "article", "story", "index", "html", "htm", "amp", "www")


_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def item_id(url: Column) -> Column:
    """Stable 16-hex id of an article: the same for case variants of its URL."""
    return F.substring(F.sha1(F.lower(strip(url))), 1, 16)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html_lib.unescape, na_action="ignore")


def clean_html(text: Column) -> Column:
    """Tags out first, then entities (the full HTML table, one Arrow batch at a time), then spaces.

    Only texts with an ``&`` travel to Python; the others go there as nulls.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, " ")
    return squeeze(F.coalesce(_unescape(F.when(bare.contains("&"), bare)), bare))


def news_text(title: Column, summary: Column) -> Column:
    return strip(F.concat(title, F.lit("\n\n"), summary))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + "([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME + "[^/?#]*([^?#;]*)", 1)


def publisher(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def headline_from_url(url: Column) -> Column:
    """Words of the path segment with the most - and _ (the first among equals)."""
    segments = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    marks = lambda s: F.length(s) - F.length(F.regexp_replace(s, "[-_]", ""))
    ranked = F.transform(segments, lambda s, i: F.struct(marks(s).alias("marks"), (-i).alias("place"), s.alias("segment")))
    best = F.regexp_replace(F.array_max(ranked)["segment"], r"\.(s?html?|php|aspx?)$", "")
    words = F.filter(
        F.split(best, "[-_+]"),
        lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~F.lower(w).isin(*SLUG_STOPWORDS) & (F.length(w) < MAX_SLUG_WORD),
    )
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def is_logistics_url(url: Column, words: Sequence[str] = LOGISTICS_WORDS, phrases: Sequence[str] = LOGISTICS_PHRASES) -> Column:
    """A phrase anywhere in the path, or one of the words as a whole token."""
    path = F.lower(url_path(url))
    tokens = F.split(path, "[^a-z0-9]+")
    hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    for p in phrases:
        hit = hit | path.contains(p)
    return hit


def _ascii(ch: str) -> str:
    return unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()


# Every character whose compatibility form leaves exactly one ASCII character, by rule.
_FOLDED = [chr(c) for c in range(0x80, 0xFFFF) if not 0xD800 <= c <= 0xDFFF and len(_ascii(chr(c))) == 1]


def fold_accents(c: Column) -> Column:
    """ASCII letters of a text: accents dropped, other non-ASCII characters removed."""
    folded = F.translate(c, "".join(_FOLDED), "".join(map(_ascii, _FOLDED)))
    return F.regexp_replace(folded, r"[^\x{00}-\x{7f}]", "")


def link_name(text: Column) -> Column:
    """Place name for linking: lower-case ASCII words without 'the' and 'port of'."""
    t = F.replace(F.lower(fold_accents(text)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, "[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"\bport of\b|\bthe\b", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def eval_name(text: Column) -> Column:
    """Place name for scoring: also drops bare 'port' and 'of', keeps no accents folding."""
    t = F.regexp_replace(strip(F.lower(text)), r"(?U)\b(the|port of|port|of)\b", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
