"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that no lane counts.  Fixed values.
STOP_WORDS = "a an and are as at be bei by das dem den der des die ein eine einer eines for from im in into is ist mit of on or the to und von with zu".split()
#: Latin letters with marks and the letters that are left when compatibility decomposition drops the marks.
_FOLDED = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0xC0, 0x250))}
MARKED = "".join(c for c, plain in _FOLDED.items() if len(plain) == 1)
PLAIN = "".join(_FOLDED[c] for c in MARKED)
#: Named character entities.  Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
PARATEXT = "books received|erratum|correction|editorial|preface|introduction|obituary"
GENERIC_TITLES = ["introduction", "conclusion", "discussion", "results", "research design", "methods", "method", "abstract", "background"]
NUMBERED_GENERIC = "[0-9]+\\.?\\s+(introduction|discussion|conclusion|results|methods?)"
#: Section types and the keys (regular expressions, whole) of their titles; the first that fits counts.  Fixed values.
SECTION_TYPES = {
    "table_of_contents": "contents|table of contents|list of figures|list of tables",
    "abstract": "abstract",
    "introduction": "introduction|1 introduction",
    "background": "background|literature review|theoretical background|related work|conceptual background|conceptual framework|theoretical framework|theory and hypotheses",
    "methods": "methods?|methodology|research design|data and methods|materials and methods|data collection|research methods?|empirical setting|study design|measures?|main measures|measurement|measurement model|sample and procedures?|variables?",
    "results": "results?|analysis and results|findings|matching and findings|empirical results|analysis|empirical analysis|results and discussion|data analysis",
    "discussion": "discussion|discussion and implications|implications|theoretical implications|managerial implications|practical implications|limitations|limitations and future research",
    "conclusion": "conclusion|conclusions|general discussion and conclusions?|summary and conclusion|future research|concluding remarks|summary|general discussion",
    "references": "references|bibliography|works cited",
    "appendix": "appendix(?:\\s+[a-z0-9]+)?|appendices|supplement(?:ary)? materials?|supplementary information",
    "index": "index|subject index|author index|glossary|nomenclature|abbreviations?",
    "acknowledgements": "acknowledg?ments?|author contributions|funding",
    "front_matter": "front matter|title page|copyright page|preface|foreword|list of contributors|about the authors",
}
#: What a text is searched for, blanks included, to guess its language.  Fixed values.
ENGLISH_WORDS, GERMAN_WORDS = ["the", "and", "of", "is", "for", "with"], ["der", "die", "das", "und", "mit", "nicht"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def clean_text(x: Column) -> Column:
    """Without soft hyphens and carriage returns; one blank for a run of them, two newlines for three or more."""
    x = F.regexp_replace(F.translate(or_empty(x), "\u00a0\u00ad", " "), "\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clean_html(x: Column) -> Column:
    """Tags become spaces, named entities their characters, runs of white space one space."""
    x = F.regexp_replace(or_empty(x), "<[^>]+>", " ")
    for entity, character in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def count_words(x: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_count(or_empty(x), F.lit("[\\p{L}\\p{N}_]+"))


def count_chunks(x: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(or_empty(x), F.lit("\\S+"))


def ascii_fold(x: Column) -> Column:
    """Marked Latin letters without their marks; any other character beyond ASCII goes."""
    return let(or_empty(x), lambda t: F.when(F.octet_length(t) > F.length(t), F.regexp_replace(F.translate(t, MARKED, PLAIN), "[^\\x00-\\x7F]", "")).otherwise(t))


def tokens(x: Column) -> Column:
    """Folded, lower-cased runs of a-z and 0-9 of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(ascii_fold(x)), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def normalize_title(x: Column) -> Column:
    """Lower-cased, anything but letters and digits a space."""
    return F.trim(F.regexp_replace(F.lower(or_empty(x)), "[^\\p{L}\\p{N}]+", " "))


def slugify(x: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(or_empty(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def normalize_doi(x: Column) -> Column:
    """The identifier without resolver or scheme, lower-cased; null where there is none."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(x), "(?i)^(https?://(dx\\.)?doi\\.org/|doi:)", "")))
    found = F.regexp_extract(bare, "10\\.[0-9]{4,9}/\\S+", 0)
    return F.when(found != "", F.rtrim(found, F.lit(".,;")))


def normalize_arxiv(x: Column) -> Column:
    found = F.regexp_extract(F.lower(x), "([0-9]{4}\\.[0-9]{4,5}|[a-z-]+/[0-9]{7})(v[0-9]+)?", 1)
    return F.when(found != "", found)


def first_author_lastname(authors: Column) -> Column:
    name = F.trim(F.element_at(F.concat(authors, F.array(F.lit(""))), 1))
    comma = F.contains(name, F.lit(","))
    return F.lower(F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.substring_index(name, " ", -1)))


def strip_numbering(x: Column) -> Column:
    """A heading without its leading number, letter or word for chapter."""
    x = F.regexp_replace(F.trim(or_empty(x)), "(?i)^(chapter|part|kapitel|teil)\\s+[0-9ivxlc]+[.:]?\\s+", "")
    return F.trim(F.regexp_replace(x, "^([0-9]+(\\.[0-9]+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s+", ""))


def heading_level(x: Column, hint: Column) -> Column:
    """The hint, else the parts of a dotted number, else 1."""
    number = F.regexp_extract(F.trim(or_empty(x)), "^([0-9]+(\\.[0-9]+)*)\\.?\\s", 1)
    return F.coalesce(hint, F.when(number != "", F.size(F.split(number, "\\."))), F.lit(1))


def alnum_ratio(x: Column) -> Column:
    x = or_empty(x)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(x, "[^\\p{L}\\p{N}]", "")), F.length(x)), F.lit(0.0))


def heading_key(title: Column) -> Column:
    """Without numbering, folded and lower-cased, runs of anything but a-z and 0-9 a space."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(strip_numbering(title))), "[^a-z0-9]+", " "))


def section_type(title: Column) -> Column:

    def of(key: Column) -> Column:
        out = F
        for name, keys in SECTION_TYPES.items():
            out = out.when(key.rlike(f"^({keys})$"), name)
        return out.otherwise("body_other")

    return let(heading_key(title), of)


def language_guess(x: Column) -> Column:
    """de where German words are over 1.2 times as frequent as English ones, else en if there is any of those, else unknown."""
    sample = F.concat(F.lit(" "), F.lower(ascii_fold(x)), F.lit(" "))

    def hits(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + (F.length(sample) - F.length(F.replace(sample, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)
        return total

    english, german = hits(ENGLISH_WORDS), hits(GERMAN_WORDS)
    return F.when(german > 1.2 * english, "de").when(english > 0, "en").otherwise("unknown")


def is_paratext(title: Column) -> Column:
    t = F.lower(F.trim(or_empty(title)))
    return (t == "") | t.rlike(f"^({PARATEXT})\\b")


def is_generic_title(title: Column) -> Column:
    low = F.lower(clean_text(title))
    return low.isin(GENERIC_TITLES) | low.rlike(f"^{NUMBERED_GENERIC}$")


def contains_term(text: Column, term: Column) -> Column:
    """A whole-word match of the normalised term."""
    needle = normalize_title(term)
    return (needle != "") & F.contains(F.concat(F.lit(" "), normalize_title(text), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def terms_hit(text: Column, terms: Column) -> Column:
    """How many of the terms are in the text, in any case."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t))))


def truncate(x: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…")))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def word_chunks(x: Column, size: int) -> Column:
    """Texts of ``size`` words, the last one shorter."""
    words = F.filter(F.split(or_empty(x), "\\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / size).cast("int") - 1, F.lit(0)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def plural_variants(term: Column) -> Column:
    """The term, and with its last letter s dropped or added."""
    other = F.when(F.endswith(term, F.lit("ies")), F.concat(F.substr(term, F.lit(1), F.length(term) - 3), F.lit("y"))).when(F.endswith(term, F.lit("s")), F.substr(term, F.lit(1), F.length(term) - 1)).otherwise(F.concat(term, F.lit("s")))
    return F.array_distinct(F.array(term, other))


def natural_key(number: Column) -> Column:
    """Sorts 2.10 after 2.9."""
    return F.transform(F.split(number, "\\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def join_parts(sep: str, *parts: Column) -> Column:
    """The parts that are not blank."""
    return F.array_join(F.filter(F.array(*[F.trim(or_empty(p)) for p in parts]), lambda p: p != ""), sep)


def content_id(n: int, *parts: Column) -> Column:
    """First n hex digits of the SHA-256 of the stripped parts, one a line."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.trim(F.replace(or_empty(p), F.lit("\r\n"), F.lit("\n"))) for p in parts]), 256), 1, n)
