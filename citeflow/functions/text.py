"""Text functions as columns. White space is Unicode's; case is lowered before ASCII classes are used."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values.
REFERENCE = r"(?:12\s+cfr\s+|§+\s*)([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)"
TOKEN = r"[a-z0-9]+(?:\.[a-z0-9-]+)*"
CONTENT_TOKEN = r"[a-z0-9]+(?:[.'-][a-z0-9]+)*|§"
QUOTES_FROM, QUOTES_TO = "“”‘’—–−搂 ", "\"\"''---§ "
TRUNCATED = r"(?U)\s*…\(已截断\)$"
CJK = r"[㐀-鿿�]"
ENDING = "[.!?;:)\\]\"'”’]$"
PUNCTUATION_BUT_DOLLAR = "!\"#%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def section_key(c: Column) -> Column:
    """A section reference without space, closing punctuation and case."""
    return F.lower(F.regexp_replace(strip(c), r"[).,;:]+$", ""))


def section_references(c: Column) -> Column:
    """Distinct cited sections in the order of first mention."""
    found = F.regexp_extract_all(F.lower(c), F.lit(REFERENCE), F.lit(1))
    return F.array_distinct(F.transform(found, section_key))


def tokens(c: Column) -> Column:
    """Lexical tokens, dotted numbers kept whole, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def conservative(c: Column) -> Column:
    """NFKC, plain quotes and dashes, lower case, single spaces."""
    return collapse(F.lower(F.translate(nfkc(c), QUOTES_FROM, QUOTES_TO)))


def fingerprint(c: Column) -> Column:
    return F.sha2(conservative(c), 256)


def content_tokens(c: Column) -> Column:
    return F.regexp_extract_all(conservative(c), F.lit(CONTENT_TOKEN), F.lit(0))


def plain_lower(c: Column) -> Column:
    """Lower case and single spaces: the cheaper normalisation of duplicate checks."""
    return collapse(F.lower(c))


def answer_key(c: Column) -> Column:
    """Answers compare without case, section signs, space and punctuation other than the dollar sign."""
    words = collapse(F.replace(F.lower(c), F.lit("§"), F.lit(" section ")))
    return collapse(F.translate(words, PUNCTUATION_BUT_DOLLAR, ""))


def contains_term(text: Column, term: Column) -> Column:
    return F.contains(answer_key(text), answer_key(term))


def evidence_key(c: Column) -> Column:
    """Evidence text without quotes around it, or a comma or backslash after it."""
    inner = F.regexp_replace(collapse(c), '^"+|"+$', "")
    return F.trim(F.regexp_replace(inner, r"[\\,]+$", ""))


def evidence_windows(c: Column, size: int) -> Column:
    """Windows of ``size`` characters at 20, 40 and 60 % of the text; a shorter text is its own window."""
    at = lambda p: F.least(F.floor(F.length(c) * p).cast("int"), F.length(c) - size) + 1
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.array_distinct(F.array(*[F.substring(c, at(p), F.lit(size)) for p in (0.2, 0.4, 0.6)])))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 900, "short").when(n <= 3000, "medium").otherwise("long")


# The names in dates, and the patterns of section_types, definition_term and judge_scores below.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def section_types(heading: Column, text: Column) -> Column:
    """The kinds of question that a section can serve, as sorted labels."""
    h, t = F.lower(heading), F.lower(text)
    label = strip(F.regexp_replace(h, r"^§\s*\S+\s*", ""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    start = F.substring(t, 1, 500)
    kinds = {
        "applicability": h.contains("applicability") | h.contains("scope") | F.substring(t, 1, 1000).contains("applies to"),
        "authority": label.startswith("authority") | t.startswith("authority.") | start.contains("(a) authority.") | start.contains("this part is issued pursuant to"),
        "cross_section": F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"§+\s*([0-9]+[a-z]?(?:\.[0-9a-z-]+)+)"), F.lit(1)))) >= 2,
        "definition": h.contains("definition") | ((F.length(t) <= 3000) & (count(r"\bmeans\b") >= 2)),
        "numeric_or_date": t.rlike(r"\b\d+(?:\.\d+)?\s*(?:%|percent|days?|months?|years?)\b") | t.rlike(rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:,\s+\d{{4}})?\b"),
        "obligation": count(r"\b(?:must|shall|required to|may not)\b") >= 2,
    }
    return F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in kinds.items()]))


def stable_key(*parts: Column | str) -> Column:
    """A pseudo-random but repeatable order."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def preview(c: Column, size: int = 500) -> Column:
    s = collapse(c)
    return F.when(F.length(s) > size, F.concat(F.substring(s, 1, size), F.lit("..."))).otherwise(s)


def or_null(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def source_label(rank: Column, doc_id: Column, *fields: Column) -> Column:
    """The filled fields joined, else the chunk's id or rank."""
    joined = F.concat_ws(" | ", *[or_null(f) for f in fields])
    return F.coalesce(F.nullif(joined, F.lit("")), F.concat(F.lit("chunk:"), F.coalesce(or_null(doc_id), rank.cast("string"))))


def query_text(question: Column, headings: Column) -> Column:
    """The question with the different headings of its sources, if it has any."""
    named = F.array_distinct(F.filter(headings, lambda h: h.isNotNull() & (h != "")))
    return F.when(F.coalesce(F.size(named), F.lit(0)) > 0, F.concat(question, F.lit("\nRelevant section heading: "), F.array_join(named, "; "))).otherwise(question)


def item_body(*fields: Column) -> Column:
    """The first of text, chunk, content and page_content that there is, else nothing."""
    return F.coalesce(*fields, F.lit(""))


def item_text(section: Column, heading: Column, title: Column, part: Column, *bodies: Column) -> Column:
    """What a lexical search reads of an item: its filled fields and its first filled body, one space between."""
    return F.concat_ws(" ", *[or_null(c) for c in (section, heading, title, part)], F.coalesce(*[or_null(b) for b in bodies]))


def embedding_text(section: Column, heading: Column, text: Column) -> Column:
    return F.concat(F.lit("12 CFR § "), section, F.lit(" | "), heading, F.lit("\n"), text)


def definition_term(text: Column) -> Column:
    """The capitalised term that the text defines."""
    return F.nullif(collapse(F.regexp_extract(text, r"(?:^|[.;:]\s+)([A-Z][A-Za-z0-9 /'’()-]{1,80}?)\s+means\b", 1)), F.lit(""))


def document_id(section: Column, version: Column) -> Column:
    return F.format_string("ecfr:title-12:section-%s:version-%s", section, version)


def section_url(section: Column, version: Column, title: int = 12) -> Column:
    return F.format_string(f"https://www.ecfr.gov/on/%s/title-{title}/section-%s", version, section)


# The scores of a judge's answer.
SCORES = ("answer_relevance", "faithfulness", "citation_support", "legal_caution", "overall")


def judge_scores(response: Column) -> Column:
    """A judge's answer as a struct of its scores, ``passed`` and ``issues``; null where it holds no valid
    JSON object or a score is missing or not 1 to 5."""
    text = strip(response)
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    open_to_close = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.coalesce(fenced, F.when(F.startswith(text, F.lit("{")), text).otherwise(open_to_close))

    def read_object(body: Column) -> Column:
        read = lambda n: F.get_json_object(body, f"$.{n}")
        scores = [read(n).try_cast("int").alias(n) for n in SCORES]
        passed = ~F.coalesce(read("pass"), read("passed"), F.lit("false")).isin("false", "0", "null", "", "[]", "{}")
        return F.struct(*scores, passed.alias("passed"), read("issues").alias("raw"), F.try_parse_json(body).isNotNull().alias("valid"))

    def finish(r: Column) -> Column:
        fine = r["valid"]
        for n in SCORES:
            fine = fine & F.coalesce(r[n].between(1, 5), F.lit(False))
        raw = r["raw"]
        issues = F.when(raw.isNull(), F.array().cast("array<string>")).when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
        return F.when(fine, F.struct(*[r[n].alias(n) for n in SCORES], r["passed"].alias("passed"), issues.alias("issues")))

    # Each step is a transformation of one element, so that the object is found and read once.
    once = F.transform(F.transform(F.array(found), read_object), finish)
    return F.get(once, F.lit(0))
