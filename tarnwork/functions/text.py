"""Scalar text functions as column expressions. Letters and digits are those of Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def collapse(s: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for all places where it is used, as an array of one."""
    return F.transform(F.array(value), use)[0]


def norm(s: Column) -> Column:
    """collapse() in lower case."""
    return F.lower(collapse(s))


def norm_words(s: Column) -> Column:
    """Lower case, everything that is no letter, digit or underscore as one blank."""
    return F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " "))


def tokens(s: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(f"({WORD})"), F.lit(1)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Similarity of two token arrays; `empty` if both have none (scorers count that as 1, features as 0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings; null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def score_value(predicted: Column, label: Column, kind: Column, close: float = 1.0, alike: float = 0.5) -> Column:
    """struct(verdict, similarity): exact, then equal when normalised, then by kind.

    A number within `close` of the label is fuzzy, with similarity 1 - difference / max(|label|, 1); a long text is from a token similarity of
    `alike` on; anything else is a mismatch. A null or empty prediction is absent.
    """
    gap = F.abs(predicted.try_cast("double") - label.try_cast("double"))
    near = jaccard(tokens(predicted), tokens(label), empty=1.0)
    out = lambda v, s: F.struct(F.lit(v).alias("verdict"), s.cast("double").alias("similarity"))
    one, none = F.lit(1.0), F.lit(0.0)
    return (
        F.when(F.coalesce(predicted, F.lit("")) == "", out("absent", none))
        .when(predicted == label, out("exact", one))
        .when(norm_words(predicted) == norm_words(label), out("normalized", one))
        .when((kind == "number") & (gap <= close), out("fuzzy", F.greatest(none, 1 - gap / F.greatest(F.abs(label.try_cast("double")), one))))
        .when((kind == "long_text") & (near >= alike), out("fuzzy", near))
        .otherwise(out("mismatch", F.when(kind == "long_text", near).otherwise(none)))
    )


def verify(value: Column, span: Column, document: Column) -> Column:
    """supported if the normalised span holds the normalised value; else by the share of the value's longer words that the document holds."""
    value_, document_ = norm(F.coalesce(value, F.lit(""))), norm(F.coalesce(document, F.lit("")))
    words = F.filter(F.split(value_, NOT_WORD), lambda w: F.char_length(w) > 2)
    found = F.filter(words, lambda w: F.contains(document_, w))
    share = F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(F.lit(0.0))
    return F.when((value_ != "") & F.contains(norm(F.coalesce(span, F.lit(""))), value_), "supported").when(share >= 0.9, "supported").when(share >= 0.5, "partial").otherwise("unsupported")


def fold_typography(s: Column) -> Column:
    """Ligatures spelled out, curly quotes and long dashes made plain, soft hyphens gone, white space collapsed to single blanks."""
    out = s
    # Ligatures and their letters.
    for one, many in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(one), F.lit(many))
    return F.regexp_replace(F.translate(out, "‘’“”–—­", "''\"\"--"), r"(?U)\s+", " ")


# Placeholders for a value.
NO_VALUE = ("not available", "not applicable", "n/a", "na", "tbd", "unknown", "none", "not known", "not app")


def usable(s: Column) -> Column:
    """Whether a value is more than a placeholder, blanks and periods around it apart."""
    bare = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"^[ .]+|[ .]+$", ""))
    return (bare != "") & ~bare.isin(*NO_VALUE)


def mark_anywhere(s: Column) -> Column:
    """A tick or an x anywhere in a cell; "Exam" counts."""
    return F.coalesce(s, F.lit("")).rlike("[xX✓✔●•]")


def mark_first(s: Column) -> Column:
    """A tick, or an x that is a word of its own, at the start of a cell; "Exam" and "Xray" do not count."""
    return F.coalesce(F.trim(s), F.lit("")).rlike(r"^([✓✔●•]|[xX]([^\p{L}\p{N}]|$))")


# Fixed value: how a table says that it goes on from the page before.
CONTINUED = r"(?i)\(?\s*\bcont(?:inued|['’]d|d\b|\.)\s*\)?"


def continued(s: Column) -> Column:
    """A cue that a table goes on from the page before."""
    return F.coalesce(s, F.lit("")).rlike(CONTINUED)


def without_cue(s: Column) -> Column:
    return F.regexp_replace(s, CONTINUED, " ")


def caption(s: Column) -> Column:
    """The caption of a new table."""
    return F.lower(F.coalesce(s, F.lit(""))).rlike(r"^\s*table\s+[0-9]+") & ~continued(s)


def strip_tags(html: Column) -> Column:
    """Text of HTML: tags go, the common entities are decoded, white space collapses. Contents of script and style stay, as text."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def escape_markup(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def day_value(s: Column) -> Column:
    """Days of "day 3", "week 2", "month 1" (7 and 30 days); null for other text."""
    low = F.lower(F.coalesce(s, F.lit("")))
    n = F.regexp_extract(low, r"(day|week|month)\s*(-?[0-9]+)", 2).try_cast("int")
    unit = F.regexp_extract(low, r"(day|week|month)\s*(-?[0-9]+)", 1)
    return n * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)


def visit_window(s: Column) -> Column:
    """struct(before, after) in days of "±3", "-2/+4" or "-2 to +4", in weeks if the text says so; zeros without any."""
    low = F.coalesce(F.lower(s), F.lit(""))
    both = F.regexp_extract(low, r"(±|\+/-)\s*([0-9]+)", 2).try_cast("int")
    split = lambda k: F.regexp_extract(low, r"-\s*([0-9]+)\s*(?:/|to)\s*\+\s*([0-9]+)", k).try_cast("int")
    unit = F.when(low.rlike(r"[0-9]\s*w"), 7).otherwise(1)
    return F.struct((F.coalesce(both, split(1), F.lit(0)) * unit).alias("before"), (F.coalesce(both, split(2), F.lit(0)) * unit).alias("after"))


def list_items(region: Column, least: int = 8) -> Column:
    """Items of a numbered list ("1." or "1)"), without short ones and headings; each ends with a period."""
    parts = F.transform(F.split(collapse(region), r"(^|\s)[0-9]{1,2}[.)]\s"), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: (F.char_length(x) >= least) & ~F.lower(x).rlike(r"criteria:?$"))
    return F.transform(kept, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))


def phases(s: Column) -> Column:
    """Distinct study phases in order, Roman numerals as Arabic ones."""
    low = F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"phase\s+(iv|iii|ii|i|[1-4])"), F.lit(1))
    return F.array_distinct(F.transform(low, lambda x: F.when(x == "i", "1").when(x == "ii", "2").when(x == "iii", "3").when(x == "iv", "4").otherwise(x)))


def age_range(s: Column) -> Column:
    """struct(low, high) of "18 to 65 years", "18-65 years"; an open end ("18 years or older") makes high null."""
    low = F.lower(F.coalesce(s, F.lit("")))
    closed = lambda k: F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]{1,3})\s*(?:to|-|–|and)\s*([0-9]{1,3})\s*years"), F.lit(k)), lambda x: x.cast("int"))
    opened = F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]{1,3})\s*years(?:\s*of\s*age)?\s*(?:or|and)\s*(?:older|above|over)"), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(F.concat(closed(1), opened)).alias("low"), F.when(F.size(opened) == 0, F.array_max(closed(2))).alias("high"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
