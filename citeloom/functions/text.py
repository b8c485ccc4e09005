"""Scalar text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bound

# Letters whose plain form has two letters, or that carry no separable mark.
PLAIN_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i"}

# Titles that are front matter, as a whole (lower case, without final dots).
FRONT_MATTER_TITLES = (
    "table of contents", "front cover", "back cover", "blank page", "editorial", "frontispiece", "index", "contents", "toc",
    "publication information", "information for authors", "masthead", "colophon", "title page", "cover", "call for papers",
    "acknowledgments to reviewers", "corrigendum", "erratum", "retraction notice", "in memoriam", "from the editor",
    "from the editor in chief", "editor's note", "editorial note", "letter from the editor", "guest editorial", "foreword",
    "preface", "author index", "subject index", "reviewer index", "volume contents",
)

# Beginnings of front-matter titles, and titles that are only a periodical's name.
FRONT_MATTER_START = (
    r"^(?:table of contents\b|front cover\b|back cover\b|blank page\b|publication information\b|information for authors\b"
    r"|ieee[\s/a-z\-]+?(?:publication\s+information|society|cover|front\s+cover|back\s+cover|volume\s*\d|author\s+index|subject\s+index)\s*$"
    r"|ieee\s+[a-z\s]+?society\s*$|\d{4}\s+index\s+ieee\b|volume\s+\d+\s+index\b|guest editorial\b|editorial:?\s|editor'?s? note\b"
    r"|corrigendum\s+to\b|erratum\s+to\b|retraction\s+notice\b|author index\b|subject index\b|list of reviewers\b|acknowledgment[s]?\s+to\s+reviewers\b)"
)
PERIODICAL_NAME = (
    r"^\s*ieee\s+(?:transactions\s+on\s+[a-z\s]+|intelligent\s+transportation\s+systems(?:\s+magazine|\s+society)?"
    r"|intelligent\s+vehicles?(?:\s+magazine|\s+symposium)?|open\s+journal\s+of\s+[a-z\s]+|vehicular\s+technology(?:\s+magazine)?)\s*$"
)

# Formats of identifiers.
ORCID = r"(\d{4}-\d{4}-\d{4}-\d{3}[\dxX])"
DOI_PREFIX = r"^(https?://(dx\.)?doi\.org/|doi:)"
DOI_IN_TEXT = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"


def _unmarked() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from the Unicode decompositions."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _unmarked()


# Greek and Cyrillic letters and what they are written as in Latin ones.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g",
}
_TWO = {k: v for k, v in {**PLAIN_LETTERS, **GREEK, **CYRILLIC}.items() if len(v) > 1}
_ONE = {k: v for k, v in {**PLAIN_LETTERS, **GREEK, **CYRILLIC}.items() if len(v) == 1} | {c: GREEK[b] for c, b in zip("άέήίόύώϊϋΐΰ", "αεηιουωιυιυ", strict=True)}
_FROM, _TO = _MARKED + "".join(_ONE), _PLAIN + "".join(_ONE.values())
_LONG = "[" + "".join(_TWO) + "]"


def unaccent(text: Column) -> Column:
    """Lower-case text in plain Latin letters: those with marks, Greek and Cyrillic ones are written out; combining marks go. Other scripts stay as they are."""
    out = F.lower(text)
    long = out
    for letter, two in _TWO.items():
        long = F.replace(long, F.lit(letter), F.lit(two))
    out = F.when(out.rlike(_LONG), long).otherwise(out)  # few texts need the replacements one by one
    return F.regexp_replace(F.translate(out, _FROM, _TO), r"\p{Mn}+", "")


def norm_title(title: Column) -> Column:
    """Lower case; what is neither a-z, 0-9 nor space becomes a space; single spaces; null gives an empty title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]+", " "), " +", " "))


def record_id(doi: Column, title: Column, year: Column) -> Column:
    """doi: and the DOI, or h: and 16 hex digits of a hash of title and year (a null year reads None)."""
    key = F.concat(norm_title(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("None")))
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("h:"), F.substring(F.sha1(key.cast("binary")), 1, 16)))


def short_hash(text: Column) -> Column:
    """16 hex digits of SHA-1 of the lower-case text."""
    return F.substring(F.sha1(F.lower(text).cast("binary")), 1, 16)


def norm_name(name: Column) -> Column:
    """Plain letters, commas, dots, hyphens and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccent(F.coalesce(name, F.lit(""))), r"[^a-z\s,.\-]", " "), r"\s+", " "))


def last_first(name: Column) -> Column:
    """'last, first': as it is if it has a comma or one word."""
    n = norm_name(name)
    words = F.split(n, " ")
    turned = F.concat(F.element_at(words, -1), F.lit(", "), F.concat_ws(" ", F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))))
    return F.when(F.contains(n, F.lit(",")) | (F.size(words) < 2), n).otherwise(turned)


def surname(name: Column) -> Column:
    return F.trim(F.substring_index(last_first(name), ",", 1))


def orcid(text: Column) -> Column:
    """The identifier inside a text, in capitals, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, ORCID, 1)), F.lit(""))


def entity_key(identifier: Column, orcid_text: Column, name: Column, min_letters: int = 5) -> Column:
    """The identifier if it starts with a, else the ORCID, else 'last, first' of min_letters letters or more, else empty; lower case."""
    n = last_first(name)
    return F.coalesce(
        F.when(F.lower(identifier).startswith("a"), F.lower(identifier)),
        F.lower(orcid(orcid_text)),
        F.when(F.length(F.regexp_replace(n, "[^a-z]", "")) >= min_letters, n),
        F.lit(""),
    )


def orcid_of_key(key: Column, orcid_text: Column) -> Column:
    """A given ORCID, else the key itself where it has that form."""
    return F.coalesce(F.nullif(orcid_text, F.lit("")), F.when((F.length(key) == 19) & (F.substring(key, 5, 1) == "-"), key))


def key_kind(key: Column) -> Column:
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "empty")
        .when(key.rlike(r"^a\d{8,}$"), "id")
        .when(key.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dxX]$"), "orcid")
        .otherwise("name")
    )


def is_front_matter(title: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"\.+$", ""))
    return (t == "") | t.isin(*FRONT_MATTER_TITLES) | t.rlike("(?i)" + FRONT_MATTER_START) | (t.rlike("(?i)" + PERIODICAL_NAME) & (F.length(t) < 80))


def text_of_positions(inverted: Column) -> Column:
    """A map word -> positions to the text; of two words at one position the later in order of words stays."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    last = lambda o: F.filter(o, lambda x, i: (i == F.size(o) - 1) | (F.get(o, i + 1)["at"] != x["at"]))
    return bound(F.array_sort(pairs), lambda o: F.concat_ws(" ", F.transform(last(o), lambda x: x["word"])))


def tail(identifier: Column, mark: str = "/") -> Column:
    return F.substring_index(identifier, mark, -1)


def norm_doi(doi: Column) -> Column:
    """Lower case without resolver prefix; null-like gives null."""
    t = F.regexp_replace(F.lower(F.trim(doi)), DOI_PREFIX, "")
    return F.when(~t.isin("", "nan", "none", "null"), t)


def dois_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOI_IN_TEXT), 1)


def short_list(names: Column, shown: int = 3) -> Column:
    """Up to shown + 1 names in full; more as the first ones, the last one and how many are left out."""
    n = F.size(names)
    more = F.concat(F.concat_ws("; ", F.slice(names, 1, shown)), F.lit("; … ; "), F.element_at(names, -1), F.lit(" (+"), (n - shown - 1).cast("string"), F.lit(")"))
    return F.when(n <= shown + 1, F.concat_ws("; ", names)).otherwise(more)


def full_list(names: Column) -> Column:
    return F.concat_ws("; ", F.transform(names, F.lower))


def missing_text(text: Column) -> Column:
    return text.isNull() | (text == "")


def missing_number(number: Column) -> Column:
    return number.isNull() | F.isnan(number)


def missing_array(values: Column) -> Column:
    return values.isNull() | (F.size(values) == 0)


def count_or_zero(number: Column) -> Column:
    return F.coalesce(F.nanvl(number.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("long")


def cut_title(title: Column, width: int = 160) -> Column:
    return F.substring(title, 1, width)


def golden_hue(number: Column) -> Column:
    """A colour by the golden angle, its saturation and lightness by divisibility."""
    hue = F.pmod(number * F.lit(137.508), F.lit(360.0))
    sat, light = F.when(number % 2 == 0, 70).otherwise(55), F.when(number % 3 == 0, 58).otherwise(50)
    return F.format_string("hsl(%.1f, %d%%, %d%%)", hue, sat, light)


def given_names(key: Column) -> Column:
    """The words after the comma, split at spaces and dots."""
    after = F.when(F.contains(key, F.lit(",")), F.regexp_replace(key, "^[^,]*,", "")).otherwise(F.lit(""))
    return F.filter(F.split(after, r"[\s.]+"), lambda x: x != "")


def name_block(name: Column) -> Column:
    """(surname, first initial)."""
    n = last_first(name)
    return F.struct(F.trim(F.substring_index(n, ",", 1)).alias("surname"), F.substring(F.trim(F.regexp_replace(n, "^[^,]*,?", "")), 1, 1).alias("initial"))


def concept_tokens(concepts: Column, level: int = 2) -> Column:
    """Names of concepts of level or deeper, with _ for spaces and hyphens, each as often as five times its score rounds to (once at least)."""
    deep = F.filter(concepts, lambda c: (c["level"] >= level) & c["name"].isNotNull())
    return F.flatten(F.transform(deep, lambda c: F.array_repeat(F.regexp_replace(F.lower(c["name"]), "[ -]", "_"), F.greatest(F.lit(1), F.bround(F.coalesce(c["score"], F.lit(0.0)) * 5).cast("int")))))


def joined_text(title: Column, abstract: Column, mark: str = " [SEP] ") -> Column:
    return F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(F.coalesce(title, F.lit("")), F.lit(mark), abstract)).otherwise(F.coalesce(title, F.lit("")))


def damped_weight(count: Column) -> Column:
    return F.lit(1.0) + F.log1p(F.coalesce(count, F.lit(0)))


def recency_weight(year: Column, now: int, half_life: float = 6.0) -> Column:
    """Halves every half_life years; a null year counts as now."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.lit(now) - F.coalesce(year, F.lit(now))) / F.lit(half_life))


def year_bin(year: Column, width: int = 5) -> Column:
    return (F.floor(year / F.lit(width)) * width).cast("int")


def title_case(label: Column) -> Column:
    return F.initcap(label)


def clamped_log2(value: Column, bound: float = 3.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.log2(value)))


def scaled(metric: Column, factor: float = 1e4, places: int = 2) -> Column:
    return F.round(metric * factor, places)


def alias_table(groups: Column) -> Column:
    """Lists of identifiers to (key, canonical): the first of a list is canonical; lists of one give nothing."""
    ids = F.transform(groups, F.lower)
    return F.when(F.size(ids) >= 2, F.transform(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(1))), lambda k: F.struct(k.alias("key"), F.element_at(ids, 1).alias("canonical"))))


def contains_all(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(text), F.lit(w.lower()))
    return out
