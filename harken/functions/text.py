"""Text functions over columns: normalisation, attribute rules, token sets and term bags. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, hints and patterns that results depend on.
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")
MATERIAL = r"(?i)\b(" + "|".join(MATERIALS) + r")\b"
COLOR = r"(?i)\b(" + "|".join(COLORS) + r")\b"
PRICE = r"\$\s*([\d.]+)"
STOPWORDS = """a an and are as at be but by for from i in is it me my of on or please some that the this to want
with would you looking need am so very just really about all our your their his her its will can more
most other than then there these those they we us if not no yes have has had do does did""".split()
KEY_HINTS = {
    "material": ("material", "fabric", "composition"),
    "color": ("color", "colour", "shade"),
    "size": ("size", "width", "length", "measurement", "fit type", "dimensions"),
    "brand": ("brand", "manufacturer", "store", "label"),
    "budget": ("price", "budget", "cost"),
    "style": ("style", "department", "sleeve", "neck", "closure", "pattern", "shape", "cut", "fit"),
    "use_case": ("occasion", "season", "activity", "sport", "use", "care", "wash"),
}
CUES = (
    (r"(?i)\bmade (?:of|from|with|out of) ([\w -]{2,30})", "material"),
    (r"(?i)\b([\w -]{2,25}?) (?:material|fabric)\b", "material"),
    (r"(?i)\bsize ([\w.]{1,12})\b", "size"),
    (r"(?i)\b(?:for|good for|great for) ([\w -]{3,25}?)(?: use| wear)?\b", "use_case"),
)
CLASS_WORDS = (
    ("material", MATERIALS),
    ("color", ("color", "black", "white", "blue", "red", "pink", "green")),
    ("size", ("size", "sizing", "width", "wide", "narrow")),
    ("style", ("department", "style", "fit", "sleeve", "neck")),
    ("use_case", ("hiking", "running", "gym", "winter", "outdoor", "work")),
)
CATEGORY_ALIASES = (
    (r"(?i)\bkicks\b", "shoes sneakers"),
    (r"(?i)\btrainers\b", "sneakers"),
    (r"(?i)\bt\s*-?\s*shirts?\b", "tees shirts"),
    (r"(?i)\bactivewear\b", "active workout wear"),
    (r"(?i)\bknits?\b", "knitwear sweaters"),
)
VALUE_CHARS, KEY_CHARS, CONSTRAINT_CHARS = 60, 40, 180


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is part of the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def clean_value(text: Column) -> Column:
    """Lower case, characters outside a small set as blanks, blanks folded, edges trimmed."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9%$. /&-]+", " "), r"\s+", " ")
    return F.btrim(folded, F.lit(" .-/"))


def clean_constraint(text: Column, limit: int = CONSTRAINT_CHARS) -> Column:
    folded = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" -;,.\t\n"))
    return F.rtrim(F.substring(folded, 1, limit))


def classify(text: Column) -> Column:
    """The attribute that a constraint's wording points to, by substrings in a fixed order."""
    low = F.lower(text)
    out = F.when(F.contains(low, F.lit("budget")) | low.rlike(r"(?:\$|<=|under)\s*\d"), "budget")
    for name, hints in CLASS_WORDS:
        out = out.when(any_of(low, hints), name)
    return out.otherwise("feature")


def attribute_of_key(key: Column) -> Column:
    low, out = F.lower(key), None
    for name, hints in KEY_HINTS.items():
        out = F.when(any_of(low, hints), name) if out is None else out.when(any_of(low, hints), name)
    return out


def tokens(text: Column) -> Column:
    """Distinct content tokens."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def terms(text: Column) -> Column:
    """Content terms in order, with repeats."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9\-.]*%?)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def stems(text: Column) -> Column:
    """Distinct stems: aliases spelled out, then tokens less a plural s."""
    for pattern, said in CATEGORY_ALIASES:
        text = F.regexp_replace(text, pattern, said)
    cut = lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.transform(tokens(text), cut))


def pairs(text: Column) -> Column:
    """(attribute, value) readings of a constraint, in order, each once."""
    text = F.trim(F.coalesce(text, F.lit("")))
    pair = lambda a, v: F.struct(a.alias("attribute"), v.alias("value"))
    some = lambda v: (v.isNotNull()) & (v != "")
    cut = lambda v: F.substring(v, 1, VALUE_CHARS)
    at = F.instr(text, ":")
    key, rest = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    keyed = F.when((at > 0) & (F.trim(rest) != "") & (F.length(key) <= KEY_CHARS) & attribute_of_key(key).isNotNull() & some(clean_value(rest)), pair(attribute_of_key(key), cut(clean_value(rest))))
    found = [keyed]
    for name, pattern in (("material", MATERIAL), ("color", COLOR)):
        word = F.lower(F.regexp_extract(text, pattern, 1))
        found.append(F.when(word != "", pair(F.lit(name), word)))
    price = F.regexp_extract(text, PRICE, 1)
    found.append(F.when(price != "", pair(F.lit("budget"), price)))
    for pattern, name in CUES:
        value = clean_value(F.regexp_extract(text, pattern, 1))
        found.append(F.when(some(value), pair(F.lit(name), cut(value))))
    own = F.filter(F.array(*found), lambda p: p.isNotNull())
    fallback = F.filter(F.array(F.when(some(clean_value(text)), pair(classify(text), cut(clean_value(text))))), lambda p: p.isNotNull())
    return F.array_distinct(F.when(F.size(own) > 0, own).otherwise(fallback))
