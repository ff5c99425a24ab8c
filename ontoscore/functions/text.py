"""Text expressions. Built-in functions wherever they exist; Arrow functions for Unicode normalisation and brace matching."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word: letters, digits and underscores, with apostrophes and hyphens inside.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_’'-]*[\p{L}\p{N}_])?"
# Groups are repeated with ++ and *+: Java runs these as loops, while + and * take a piece of the stack for each repetition.
# Ends are cut off by trim functions: a pattern of a run and $ looks through a run inside a text once from each of its characters.
ASCII_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*+"
# Patterns and word lists that spans of evidence follow.
QUOTED = r"[\"“”]([^\"“”]{2,140})[\"“”]"
SENTENCE_END = r"[.;:\n]+"
CLAUSE_END = r"(?i)[—–]|,\s+|(?<!\s)\s++(?:where|while|because|which|so that|rather than|whereby)\s+"  # within sentences
TAIL = r"[\s,;:.\-—–]+$"
TAIL_CHARACTERS = "\t\n\x0b\f\r ,;:.-—–"
QUOTES = "\"“”"
#: White space of any kind: \s, \p{Z}, the separators of files to units, and the next line of C1.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that do not count as content.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "with", "from", "that", "this", "these", "those", "there", "where", "when", "while", "because", "rather",
    "it", "its", "their", "they", "of", "to", "in", "on", "as", "is", "are", "be", "by", "also", "how", "why", "what", "which", "who", "for", "at",
    "into", "than", "then", "so", "such", "both", "more", "most", "some", "any", "can", "may", "might", "would", "could", "should", "will", "shall",
    "not", "no", "nor", "only", "very", "much",
]
#: Words that a window may not begin or end with.
EDGE_WORDS = [
    "the", "a", "an", "and", "or", "but", "with", "from", "that", "this", "these", "those", "there", "where", "when", "while", "because", "rather",
    "it", "its", "their", "they", "of", "to", "in", "on", "as", "is", "are", "by", "also",
]
#: Words that are cut off a span's beginning.
LEAD_WORDS = [
    "and", "but", "or", "the", "a", "an", "that", "which", "where", "while", "because", "of", "to", "in", "on", "as", "is", "are", "by", "also", "so",
    "then", "when", "this", "these", "those", "it", "its", "their", "they", "for", "with",
]
GENERIC = r"(?i)^(the|this|that|its|their|his|her|an?)\s+\w+('s)?\s+(framing|perspective|approach|view|tone|response|construction|way|nature|thing|point)s?$"
#: Stems of the domain's terms.
DOMAIN = [
    "class", "labor", "labour", "capital", "worker", "employee", "employer", "owner", "property", "production", "wage", "surplus", "value", "power",
    "control", "state", "law", "regulat", "institution", "ideolog", "market", "formal", "equal", "stakeholder", "symmetr", "conflict",
    "contradiction", "exploit", "rent", "housing", "vacan", "homeless", "ai", "algorithm", "management", "training", "policy", "deployment",
    "compute", "cloud", "chip", "supply", "imperial", "ghana", "automation", "productivity", "accumulation", "speculat", "commodif", "zoning",
    "gentrif", "displac", "scarcity", "efficien", "incentive", "price", "demand", "norm", "governance", "reform", "redistribut",
]
# End of fixed values.


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def newlines(text: Column) -> Column:
    """CRLF, then CR, as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Pure ASCII is in NFC already."""
    return _nfc(text)


def normalised(text: Column) -> Column:
    return newlines(nfc(text))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def tag_block(text: Column, tag: str, least: int = 20) -> Column:
    """The last block between <tag> and </tag> of `least` characters or more, else the last one, else null; trimmed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?ms)<{tag}>(.*?)</{tag}>"), F.lit(1)), stripped)
    long = F.filter(found, lambda x: F.length(x) >= least)
    return F.coalesce(F.try_element_at(long, F.lit(-1)), F.try_element_at(found, F.lit(-1)))


def named_block(text: Column, name: str, following: str) -> Column:
    """What stands between a line `name` and a line `following`."""
    return F.regexp_extract(text, rf"(?ms)^{name}\n(.*?)\n{following}", 1)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, code fences or not; null if there is none that parses."""
    at = text.find("{") if text else -1
    decoder = json.JSONDecoder()
    while text and at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def first_json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(first_object, na_action="ignore")


def chat_content(message: Column) -> Column:
    """The text of a chat message's content: a string, or a list of parts whose texts are joined. message: JSON text."""
    v = F.try_parse_json(message)
    parts = F.try_variant_get(v, "$.content", "array<struct<type:string,text:string>>")
    whole = F.try_variant_get(v, "$.content", "string")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")).startswith("ARRAY"), joined).otherwise(whole)


def listed(words_: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words_])


def sentences(text: Column) -> Column:
    """Parts between .;: and line ends, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda x: x != "")


def clauses(text: Column) -> Column:
    """Parts of sentences between commas, dashes and the words that join clauses, trimmed, none empty."""
    return clauses_of(sentences(text))


def clauses_of(sentences_: Column) -> Column:
    parts = F.flatten(F.transform(sentences_, lambda s: F.split(s, CLAUSE_END)))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def quoted_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))


def trimmed_span(span: Column) -> Column:
    """Without quotes around it, leading function words and trailing punctuation."""
    return trimmed_again(stripped(span))


def trimmed_again(span: Column) -> Column:
    """As trimmed_span, of a span without white space at its ends."""
    return let(without_lead(F.btrim(span, F.lit(QUOTES))), lambda plain: stripped(without_tail(plain)))


def without_tail(span: Column) -> Column:
    """Without trailing punctuation; a line end of these kinds may follow it, as $ allows."""
    ends = reduce(lambda a, b: a | b, [span.endswith(c) for c in "\x85\u2028\u2029"])
    return F.when(ends, F.regexp_replace(span, TAIL, "")).otherwise(F.rtrim(span, F.lit(TAIL_CHARACTERS)))


def without_lead(span: Column) -> Column:
    """Without leading function words; enough for spans that begin and end with a word."""
    return F.regexp_replace(span, r"(?i)^(?:(?:" + "|".join(LEAD_WORDS) + r")\b[\s,]*)++", "")


def of_domain(low: Column) -> Column:
    """Whether a text in lower case holds a stem of the domain."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(stem)) for stem in DOMAIN])


def content(words_: Column) -> Column:
    """Of some words, in lower case, those that are no function words."""
    return F.filter(F.transform(words_, F.lower), lambda w: ~w.isin(STOPWORDS))


def content_words(span: Column) -> Column:
    return F.size(content(F.regexp_extract_all(span, F.lit(ASCII_WORD), F.lit(0))))


def ngrams(tokens: Column, low: int = 4, high: int = 14) -> Column:
    """All stretches of low to high words that neither begin nor end with a function word, joined by spaces."""
    return _stretches(tokens, F.transform(tokens, lambda t: F.concat(t, F.lit(" "))), low, high)


def windows(text: Column, low: int = 4, high: int = 14) -> Column:
    """As ngrams over the words of a text, each with what stands between its words: substrings of the text."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0)).alias("tokens"), F.split(text, ASCII_WORD, -1).alias("gaps"))
    units = lambda x: F.zip_with(x["tokens"], F.slice(x["gaps"], 2, F.size(x["tokens"])), lambda a, b: F.concat(a, b))
    both = let(parts, lambda x: F.struct(x["tokens"].alias("tokens"), units(x).alias("units")))
    return let(both, lambda x: _stretches(x["tokens"], x["units"], low, high))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stretches(tokens: Column, units: Column, low: int, high: int) -> Column:
    """tokens: words; units: each with what follows it."""
    edge = let(tokens, lambda t: F.transform(t, lambda w: F.lower(w).isin(EDGE_WORDS)))

    def of(x: Column, n: Column) -> Column:
        last = F.size(x["t"]) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        good = F.filter(starts, lambda i: ~F.get(x["e"], i) & ~F.get(x["e"], i + n - 1))
        return F.transform(good, lambda i: F.concat(F.array_join(F.slice(x["u"], i + 1, n - 1), ""), F.get(x["t"], i + n - 1)))

    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    return let(F.struct(tokens.alias("t"), units.alias("u"), edge.alias("e")), lambda x: F.flatten(F.transform(sizes, lambda n: of(x, n))))


def cue_hits(text: Column, cues: Column) -> Column:
    """How many of the cues, without regard to case and each once, occur in the text."""
    return F.size(F.filter(F.array_distinct(F.transform(cues, F.lower)), lambda c: F.contains(F.lower(text), c)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.size(F.array_intersect(a, b)).cast("double") / F.nullif(small, F.lit(0))


def greedy_distinct(spans: Column, limit: int, most: float) -> Column:
    """Spans in order, each kept if it overlaps none that is kept by `most` or more; at most `limit`."""
    tokens = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(ASCII_WORD), F.lit(0)))

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: F.coalesce(overlap(tokens(k), tokens(s)), F.lit(0.0)) >= most)
        return F.when((F.size(kept) < limit) & ~clash, F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(spans, F.array().cast("array<string>"), step)


def sanitised(text: Column, ends: str = "_") -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen as one underscore, without `ends` at both ends."""
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(ends))


def extension(url: Column, content_type: Column) -> Column:
    """A file's extension from its address, else from its content type."""
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("")))
    own = F.regexp_extract(path, r"\.(pdf|csv|json|xml|html?|txt|xlsx?|zip)$", 1)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = F.when(kind.contains("pdf"), ".pdf").when(kind.contains("json"), ".json").when(kind.contains("csv"), ".csv").when(kind.contains("xml"), ".xml").when(kind.contains("html"), ".html").when(kind.contains("text/plain"), ".txt").otherwise(".bin")
    return F.when(own != "", F.concat(F.lit("."), own)).otherwise(by_type)


def last_header(text: Column, name: str) -> Column:
    """A field of the last non-empty block of HTTP headers."""
    block = F.try_element_at(F.filter(F.split(newlines(text), r"\n\n+"), lambda b: stripped(b) != ""), F.lit(-1))
    value = F.regexp_extract(block, rf"(?im)^{name}:[ \t]*([^\n]*)", 1)
    return F.when(value != "", stripped(value))


def chat_url(base: Column) -> Column:
    """The address of chat completions, /v1 added once."""
    b = F.regexp_replace(base, "/+$", "")
    return F.when(b.endswith("/chat/completions"), b).when(b.endswith("/v1"), F.concat(b, F.lit("/chat/completions"))).otherwise(F.concat(b, F.lit("/v1/chat/completions")))


def file_class(path: Column) -> Column:
    """A kind of file by its name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.rlike(r"\.(py|sh|sql)$"), "code")
        .when(name.rlike(r"\.(md|txt|rst)$"), "document")
        .when(name.rlike(r"\.jsonl?$"), "data")
        .when(name.rlike(r"\.(parquet|csv|orc|avro)$"), "table")
        .when(name.rlike(r"\.(toml|ya?ml|ini|cfg)$"), "configuration")
        .otherwise("other")
    )
