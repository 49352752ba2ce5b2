"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]
#: Arabic letters folded to one form, Persian letters to Arabic ones (fixed values).
_FOLD_FROM, _FOLD_TO = "أإآٱىةیکؤئ", "اااايهيكوي"
_EASTERN, _WESTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_arabic(c: Column) -> Column:
    """Without diacritics and tatweel, one form of each letter."""
    return F.translate(F.regexp_replace(c, "[ً-ْٰـ]", ""), _FOLD_FROM, _FOLD_TO)


def western_digits(c: Column) -> Column:
    return F.translate(c, _EASTERN, _WESTERN)


def words(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), "")


def head_words(c: Column, least: int = 3) -> Column:
    """Distinct lightly stemmed words of a headline, without stop words and a speaker before a colon."""
    bare = F.regexp_replace(c, r"^[^:]{1,40}:\s", "")
    kept = F.filter(words(bare), lambda w: ~w.isin(STOP) & (F.length(w) >= least))
    return F.array_distinct(F.transform(kept, stem))


def stem(w: Column) -> Column:
    return F.regexp_replace(w, r"(ing|ed|es|s)$", "")


def norm(c: Column) -> Column:
    """Letters and digits of a text, hyphens as blanks, apostrophes dropped."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"['’]", ""), r"[^\p{L}\p{Nd}]+", " "))


def sound(w: Column) -> Column:
    """A rough phonetic key: letters that sound alike are one, vowels and what hardly sounds are dropped, doubles are one."""
    flat = F.lower(w)
    for pattern, one in (("ph", "f"), ("[ckg]h|q|c", "k"), ("(?:ee|ou|oo)", "u"), ("[aeiouywh]", "")):
        flat = F.regexp_replace(flat, pattern, one)
    for x in "blnst":
        flat = F.regexp_replace(flat, x + x, x)
    return flat


def consonants(c: Column) -> Column:
    """A name's first letter and its consonants, doubles once, without an article al-: spellings of one place meet."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"^al[- ]", ""), r"[^a-z]", "")
    rest = F.regexp_replace(F.substr(bare, F.lit(2)), r"[aeiouy]", "")
    return F.concat(F.left(bare, F.lit(1)), F.regexp_replace(rest, r"(.)\1+", "$1"))


def latin_digits(c: Column) -> Column:
    """Lower case with Latin digits, Persian letters as Arabic ones, no vowel marks or tatweel."""
    return F.lower(F.regexp_replace(F.translate(western_digits(c), "یىک", "ييك"), "[ًٌٍَُِّْـ]", ""))


#: A number with up to three words before it and a scale behind it.
TOLD = r"((?:[a-z]+ ){0,3})([0-9][0-9,.]*)( (?:thousand|million|billion))?"
#: The same for Java's regular expressions, begun at words only (or where the number before ended) and without a step back in a word.
_TOLD_FAST = r"((?:(?:(?<![a-z])|\G)(?:[a-z]++ ){1,3})?)([0-9][0-9,.]*+)( (?:thousand|million|billion))?"
_SCALE = {" thousand": 1e3, " million": 1e6, " billion": 1e9}
#: How a text may put a number: words right before it, and what they say of it.
QUALIFIERS = {"no less than": "at least", "at least": "at least", "a minimum of": "at least", "more than": "more than", "in excess of": "more than", "above": "more than", "about": "about", "around": "about", "roughly": "about", "close to": "about", "nearly": "about"}


def told_numbers(c: Column) -> Column:
    """[{value, before}] of the numbers of a text: commas between thousands and a scale word count into the value, what looks
    like no single number (1.2.3, 12,34) is left out; before: the words right before it. Null texts tell none."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n]+", " ")
    hits = F.regexp_extract_all(t, F.lit(_TOLD_FAST), F.lit(0))  # the text is gone through once, what it is made of is read off the hits

    def read(x: Column) -> Column:
        bare = F.regexp_replace(x["n"], "[.,]+$", "")
        value = F.when(bare.rlike(r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$"), F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))
        scale = F.lit(1.0)
        for word, times in _SCALE.items():
            scale = F.when((x["s"] == word) & (bare == x["n"]), F.lit(times)).otherwise(scale)
        return F.struct((value * scale).alias("value"), F.trim(x["w"]).alias("before"))

    parts = F.transform(hits, lambda h: F.struct(*(F.regexp_extract(h, TOLD, k).alias(name) for k, name in enumerate("wns", 1))))
    return F.filter(F.transform(parts, read), lambda x: x["value"].isNotNull())


def states(told: Column, n: Column) -> Column:
    """Is a value among the numbers told?"""
    return F.exists(told, lambda x: x["value"] == n)


def qualifier_of(told: Column, n: Column, qualifiers: dict[str, str] = QUALIFIERS) -> Column:
    """What the first of the numbers told that has this value is said to be; null if nothing is said of it."""
    first = F.get(F.filter(told, lambda x: x["value"] == n), F.lit(0))["before"]
    return F.coalesce(*(F.when(F.concat(F.lit(" "), first).endswith(" " + words), said) for words, said in qualifiers.items()))


def content_key(c: Column, chars: int = 200, least: int = 40) -> Column:
    """A fingerprint of the first characters without links and handles; empty for short texts."""
    bare = norm(F.regexp_replace(c, r"https?://[^\s]+|@[A-Za-z0-9_]+", " "))
    return F.when(F.length(bare) < least, "").otherwise(F.md5(F.left(bare, F.lit(chars))))


def link_key(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slash; parameters sorted."""
    bare = F.regexp_replace(url, r"#.*$", "")
    base = F.regexp_replace(F.regexp_replace(F.split_part(bare, F.lit("?"), F.lit(1)), r"^https?://(www\.|m\.)?", ""), r"/$", "")
    args = F.filter(F.split(F.split_part(bare, F.lit("?"), F.lit(2)), "&"), lambda a: (a != "") & ~a.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)="))
    return F.concat(F.lower(base), F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(args), "&"))).otherwise(""))


def title_key(c: Column, n: int = 14) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def slug(c: Column, n: int = 72) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-|-$", ""), F.lit(n))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def has_article_path(url: Column) -> Column:
    """More than a section front: two segments, or one that is long or has a digit."""
    return path_of(url).rlike(r"^/[^/]+/[^/]+") | path_of(url).rlike(r"^/([^/]{25,}|[^/]*[0-9][^/]*)/?$")


def url_day(url: Column) -> Column:
    return F.try_to_date(F.replace(F.regexp_extract(url, r"(20[0-9]{2}[/-][01]?[0-9][/-][0-3]?[0-9])", 1), F.lit("-"), F.lit("/")), "yyyy/M/d")


def numbers(c: Column) -> Column:
    """Whole numbers of a text, years apart."""
    found = F.regexp_extract_all(F.regexp_replace(western_digits(c), r"([0-9]),([0-9]{3})", "$1$2"), F.lit(r"([0-9]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda n: n.isNotNull() & ~n.between(1900, 2100))


def rare_figures(c: Column) -> Column:
    return F.array_distinct(F.filter(numbers(c), lambda n: (n >= 100) & (n % 50 != 0)))


def decode_entities(c: Column) -> Column:
    bare = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return squeeze(bare)


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def tidy_headline(c: Column, most: int = 140) -> Column:
    """One line of at most `most` characters, cut at a word with an ellipsis."""
    one = F.regexp_replace(squeeze(c), r"[.;, ]+$", "")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(most - 1)), r" [^ ]*$", ""), F.lit("…")))


def strip_attribution(c: Column) -> Column:
    return F.regexp_replace(c, r",\s+[^,]{2,40}\s+(says|said|reports)\.?$", "")


def unglue(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2")



def quantity(c: Column) -> Column:
    """Number of a formatted cell such as `1,234.5%`."""
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?[0-9]+(\.[0-9]+)?)", 1).try_cast("double")


def qualifier(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("at least|no fewer than"), "at least").when(low.rlike("more than|over "), "more than").when(low.rlike("about|around|nearly"), "about")


def snowflake_ms(post: Column) -> Column:
    """Milliseconds of a post number: its upper bits over the service's epoch (fixed value)."""
    return F.shiftright(post.cast("long"), 22) + 1288834974657


def newer_id(a: Column, b: Column) -> Column:
    """Number strings of any length by value."""
    x, y = F.regexp_replace(a, "^0+", ""), F.regexp_replace(b, "^0+", "")
    return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x > y))
