"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from sedge.functions.lexicon import TERM_STOPWORDS

# The characters Unicode text calls white space (also in a regex class).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(SPACES))


def title_key(c: Column | str) -> Column:
    """Join key of a title: runs of anything but letters, digits and ``_`` become one blank."""
    return F.lower(F.btrim(F.regexp_replace(_col(c), r"[^\p{L}\p{N}_]+", " ")))


def split_list(c: Column | str, sep: str = ";") -> Column:
    """Multi-value cell -> array of stripped, non-blank parts; NULL gives an empty array."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), re.escape(sep))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_codes(c: Column | str, sep: str = ";") -> Column:
    return F.transform(split_list(c, sep), F.lower)


def without_markup(c: Column | str) -> Column:
    """Tags out, white space collapsed, trimmed; NULL gives an empty string."""
    bare = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(bare, SPACE_RUN, " "))


def slug(c: Column | str) -> Column:
    """Value form of :func:`sedge.functions.columns.header_slug`."""
    name = F.btrim(F.regexp_replace(F.lower(_col(c)), r"[^0-9a-z]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unnamed"))


def paper_text(title: Column | str, abstract: Column | str | None = None) -> Column:
    """``title. abstract``; either part may be NULL."""
    body = F.lit("") if abstract is None else F.coalesce(_col(abstract), F.lit(""))
    return strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(". "), body))


def document_text(title: Column | str, summary: Column | str) -> Column:
    """Lower-cased ``title summary`` that keyword matching runs on."""
    return F.lower(F.concat_ws(" ", F.coalesce(_col(title), F.lit("")), F.coalesce(_col(summary), F.lit(""))))


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    """True when any keyword is a substring."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | text.contains(F.lit(k))
    return hit


def matches_keywords(title: Column | str, summary: Column | str, keywords: Iterable[str]) -> Column:
    return contains_any(document_text(title, summary), [k.lower() for k in keywords])


def term_pattern(term: str) -> str:
    """Regex for a term as a whole word, with ASCII word characters as in a browser.

    A side asks for a word character next to it where the term itself starts or
    ends in none, because that is what a word boundary then means.
    """
    word = "[A-Za-z0-9_]"
    left = f"(?<!{word})" if re.match(word, term[0]) else f"(?<={word})"
    right = f"(?!{word})" if re.match(word, term[-1]) else f"(?={word})"
    return left + re.escape(term.lower()) + right


def literal(text: str) -> str:
    """Text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_term(column: str, *terms: str) -> Column:
    """True when any term occurs in the column as a whole word: ``fuel`` does not hit ``biofuels``.

    The plain substring search rules most texts out before a regex has to run.
    One SQL expression, because hundreds of terms are slow to build call by call.
    """
    return F.expr(
        " OR ".join(
            f"(contains(`{column}`, {literal(t.lower())}) AND `{column}` RLIKE {literal(term_pattern(t))})" for t in terms
        )
    )


def normal_keywords(raw: Iterable[str]) -> list[str]:
    """User keywords: trimmed, lower case, single blanks, two characters at least, no repeats."""
    clean = (re.sub(r"\s+", " ", str(k or "").strip().lower()) for k in raw)
    return list(dict.fromkeys(k for k in clean if len(k) >= 2))


def normal_keyword(c: Column | str) -> Column:
    """Column form of :func:`normal_keywords`; NULL where the keyword is too short."""
    k = F.lower(F.btrim(F.regexp_replace(_col(c), SPACE_RUN, " ")))
    return F.when(F.length(k) >= 2, k)


# A run of letters, digits and inner hyphens, three characters at least, that is not digits alone.
WORD = r"(?![0-9]+-*(?![a-zà-ÿ0-9-]))[a-zà-ÿ0-9][a-zà-ÿ0-9-]+[a-zà-ÿ0-9]"


def words(text: Column | str) -> Column:
    """Words of at least three characters that are not all digits, without edge hyphens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def blank_stopwords(word_list: Column) -> Column:
    """Stopwords become NULL, so that they still keep their neighbours apart."""
    return F.transform(word_list, lambda w: F.when(~w.isin(*TERM_STOPWORDS), w))


def terms_of(kept: Column) -> Column:
    """Unigrams, then bigrams of direct neighbours, from :func:`blank_stopwords`."""
    following = F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1)))
    pairs = F.zip_with(kept, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(kept, pairs))
