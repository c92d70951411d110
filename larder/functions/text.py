"""Text functions on columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.regex import py_regex


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def number(text: Column) -> Column:
    """A number with point or comma; null if it isn't one."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def normalize(raw: Column) -> Column:
    """The bare name of an ingredient line: no leading amounts, units, bracketed remarks or other signs."""
    s = F.regexp_replace(F.lower(raw), py_regex(V.LEADING_AMOUNT), "")
    s = F.regexp_replace(s, py_regex(V.INGREDIENT_UNITS), " ")
    s = F.regexp_replace(s, r"\(.*?\)", " ")
    return squeeze(F.regexp_replace(s, r"(?U)[^a-zäöüß\s-]", " "))


def form_token(raw: Column) -> Column:
    """The first form class that the text names, or an empty string."""
    low = F.lower(raw)
    out = F.lit("")
    for name, pattern in reversed(V.FORM_CLASSES):
        out = F.when(low.rlike(py_regex(pattern, ignore_case=True)), name).otherwise(out)
    return out


def dedup_key(raw: Column) -> Column:
    """Name and form: lines with one key are one ingredient."""
    return F.concat(normalize(raw), F.lit("|"), form_token(raw))


def without_amount(raw: Column) -> Column:
    """The line without the amount and exact unit at its start."""
    return strip(F.regexp_replace(raw, py_regex(V.STRIP_AMOUNT, ignore_case=True), ""))


def vague_amount(raw: Column) -> Column:
    """(amount, unit, shown, name) of a line that starts with a number and a vague unit, else null."""
    pattern = py_regex(V.VAGUE_AMOUNT, ignore_case=True)
    shown = F.regexp_extract(raw, pattern, 2)
    unit = F.regexp_replace(F.lower(F.regexp_replace(shown, r"\(.*?\)", "")), r"\.+$", "")
    unit = F.split(unit, "/")[0]
    fields = F.struct(number(F.regexp_extract(raw, pattern, 1)).alias("amount"), unit.alias("unit"), shown.alias("shown"), strip(F.regexp_extract(raw, pattern, 3)).alias("name"))
    return F.when(raw.rlike(pattern) & unit.isin(V.VAGUE_UNITS), fields)


def is_pantry(name: Column, words: Iterable[str] = V.PANTRY) -> Column:
    """Whether a normalized name of at most three different words has a pantry word."""
    tokens = F.array_distinct(F.split(name, " "))
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words))) & (F.size(tokens) <= 3)


def keywords(name: Column, shop_words: Iterable[str] = ()) -> Column:
    """Search words of a product name, in order and with repeats. `shop_words`: brands of the shop, which say nothing."""
    s = F.regexp_replace(F.lower(name), py_regex(V.KEYWORD_AMOUNT), "")
    stop = [*V.KEYWORD_STOPWORDS, *shop_words]
    return F.filter(F.regexp_extract_all(s, F.lit("[a-züäöß]+"), 0), lambda t: ~t.isin(stop) & (F.length(t) > 2))


def ingredient_name(raw: Column) -> Column:
    """Name for matching with pages: lower case, no leading amount, one leading unit dropped, cut at the first comma."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(raw, F.lit("")))), py_regex(V.NAME_LEAD), "")
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    words = F.when(F.get(words, 0).isin(V.NAME_UNITS), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    return squeeze(F.split(F.array_join(words, " "), ",")[0])


def last_segment(url: Column) -> Column:
    """The last part of a url's path, slashes at the end ignored."""
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def total_time(duration: Column) -> Column:
    """H:MM:SS in words of hours and minutes; empty if it isn't one."""
    parts = F.split(F.coalesce(duration, F.lit("")), ":")
    h, m, s = (strip(F.get(parts, i)).try_cast("int") for i in range(3))
    shown = F.when((h != 0) & (m != 0), F.concat(h, F.lit(" Std "), m, F.lit(" Min"))).when(h != 0, F.concat(h, F.lit(" Std"))).otherwise(F.concat(m, F.lit(" Min")))
    return F.when((F.size(parts) == 3) & h.isNotNull() & m.isNotNull() & s.isNotNull(), shown).otherwise("")


def local_date(ts: Column, zone: str = "Europe/Berlin") -> Column:
    """yyyy-MM-dd of an instant in a zone, in a session whose zone is UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def safe(value: Column) -> Column:
    """Text of a value; empty for null and NaN."""
    shown = value.cast("string")
    return F.when(shown.isNull() | (shown == "NaN"), "").otherwise(shown)


def feature_text(text: Column) -> Column:
    """Lower case, umlauts spelt out, other signs as spaces."""
    s = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, "[^a-z0-9,. ]", " ")


def feature_tokens(text: Column) -> Column:
    """Distinct words of over one letter that aren't stop words."""
    tokens = F.array_distinct(F.regexp_extract_all(feature_text(text), F.lit("[a-z0-9]+"), 0))
    return F.filter(tokens, lambda t: ~t.isin(V.FEATURE_STOPWORDS) & (F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets of words; zero if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def stems(name: Column) -> Column:
    """Distinct stemmed words of an ingredient's name that carry weight."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-zäöüß]+"), lambda w: (F.length(w) >= 2) & ~w.isin(V.MATCH_STOPWORDS))
    stemmed = F.transform(words, lambda w: F.regexp_replace(w, "(en|er|n|e|s)$", ""))
    return F.array_distinct(F.filter(stemmed, lambda w: (F.length(w) >= 2) & ~w.isin(V.MATCH_STOPSTEMS)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words in parts of the smaller set; zero if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def tile_cents(shown: Column) -> Column:
    """Cents of the first price in a text such as `1,99 €`; null without one."""
    pattern = r"(?U)(\d+)[.,](\d{2})"
    bare = F.regexp_replace(shown, r"(?U)[\s\x{A0}]", "")
    return F.when(bare.rlike(pattern), (F.regexp_extract(bare, pattern, 1).try_cast("long") * 100 + F.regexp_extract(bare, pattern, 2).try_cast("long")))


def euros(amount: Column) -> Column:
    """Cents as euros with a comma."""
    whole = F.abs(amount).cast("long")
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, F.floor(whole / 100).cast("string"), F.lit(","), F.lpad((whole % 100).cast("string"), 2, "0"), F.lit(" €"))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent; zero of nothing."""
    return F.when(total > 0, F.round(100 * done / total).cast("int")).otherwise(0)


def fingerprint(text: Column) -> Column:
    """Twelve digits that change with the text."""
    return F.substring(F.sha1(text), 1, 12)
