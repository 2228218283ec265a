"""Scalar functions as column expressions, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASE_CHARS = 128


def normalize(phrase: Column) -> Column:
    """Trimmed, white space (Unicode) single, lower case; null if empty or over 128 characters."""
    one = F.lower(F.regexp_replace(F.regexp_replace(phrase, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    return F.when((one != "") & (F.length(one) <= PHRASE_CHARS), one)


def entity_id_valid(key: Column) -> Column:
    """domain:type:id, no part empty; the id's part may not hold a colon."""
    return key.rlike(r"\A[^:]+:[^:]+:[^:]+\z")


def entity_part(key: Column, k: int) -> Column:
    """Part 0 (domain), 1 (type) or 2 (id)."""
    return F.split(key, ":", 3)[k]


def framed_hash(domain: str, *parts: Column) -> Column:
    """SHA-256 over a framed sequence: the domain, then each part behind its byte length, so that no two sequences coincide."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.sha2(F.concat(F.lit(f"{domain}\n"), *framed), 256)


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), content), 256)


def backoff_seconds(attempt: Column) -> Column:
    """1 s up to the first attempt, then doubling, 60 s at most."""
    return F.when(attempt <= 1, 1).otherwise(F.least(F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(6))), F.lit(60.0))).cast("long")


#: The months of an HTTP date, and the most seconds that a Retry-After is taken for.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
RETRY_AFTER_MOST = 300
HTTP_DATE = r"\A\S*,\s+([0-9]{1,2})\s+([A-Z][a-z]{2})\s+([0-9]{4,5})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s+GMT\z"


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, 0 to 300: a whole number, or an HTTP date less now (epoch seconds); null for other texts.

    A day past its month's end runs on into the next month.
    """
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
    part = lambda k: F.regexp_extract(text, HTTP_DATE, k).try_cast("int")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, HTTP_DATE, 2)).cast("int")
    day, year, hour, minute, second = part(1), part(3), part(4), part(5), part(6)
    sound = day.between(1, 31) & (month > 0) & (year >= 1970) & (hour <= 23) & (minute <= 59) & (second <= 60)
    first = F.unix_date(F.make_date(F.when(sound, year), month, F.lit(1))).cast("long")
    seconds = F.coalesce(whole, (first + day - 1) * 86400 + hour * 3600 + minute * 60 + second - now)
    return F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0)), F.lit(RETRY_AFTER_MOST))).cast("int")


def seed_hash(title: Column, content: Column) -> Column:
    """SHA-256 of title and content with a NUL between; null texts are empty."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.char(F.lit(0)), F.coalesce(content, F.lit(""))), 256)


def budget_tokens(prompt: Column, source: Column, output_most: int) -> Column:
    return F.octet_length(prompt) + F.octet_length(source) + 256 + output_most


def utc_day(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("long")


def reference_markers(text: Column) -> Column:
    """Ids of [[ref:rN]] markers, in order; N has one to six digits and no leading zero."""
    return F.regexp_extract_all(text, F.lit(r"\[\[ref:(r[1-9][0-9]{0,5})\]\]"), 1)


def reference_id_valid(ref: Column) -> Column:
    return ref.rlike(r"\Ar[1-9][0-9]{0,5}\z")


def ink(text: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def occurrences(text: Column, phrase: str) -> Column:
    """Overlapping, case-folded occurrences of a phrase."""
    low = phrase.lower()
    overlaps = any(low[k:] == low[:-k] for k in range(1, len(low)))
    if overlaps:
        quoted = "\\Q" + low.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.regexp_count(F.lower(text), F.lit(f"(?={quoted})"))
    folded = F.lower(text)
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(low), F.lit("")))) / len(low)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length, empty or of length zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def hashed_embedding(text: Column, dims: int = 768) -> Column:
    """Deterministic unit vector: character hashes signed and summed by bucket.

    Each step's list is bound once by a lambda of one element, as Spark would evaluate it anew at every mention. Codes (twice the
    bucket, and one more for a positive sign) are counted by where each begins among all, sorted, with every code there once more.
    """
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    code = lambda h: (F.pmod(h, F.lit(dims).cast("long")) * 2 + F.when(h > 0, 1).otherwise(0)).cast("int")
    codes = F.transform(F.transform(chars, lambda c: F.xxhash64(c)), code)
    begins = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i - 1)), i)))
    sums = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (F.get(at, 2 * k + 2) - 2 * F.get(at, 2 * k + 1) + F.get(at, 2 * k)).cast("double"))
    unit = lambda raw: bound(norm(raw), lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(x)))
    whole = F.sort_array(F.concat(codes, F.sequence(F.lit(0), F.lit(2 * dims))))
    return bound(bound(bound(whole, begins), sums), unit)


def semver_key(version: Column) -> Column:
    """A sortable array of major, minor, patch; null for other strings."""
    parts = F.split(version, r"\.")
    return F.when(version.rlike(r"\A(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\z"), F.transform(parts, lambda p: p.try_cast("int")))


def resolve_pointer(json: Column, pointer: str) -> Column:
    """The string leaf at an RFC 6901 pointer of a JSON text, else null."""
    path = "$"
    for token in pointer.split("/")[1:]:
        name = token.replace("~1", "/").replace("~0", "~")
        quote = '"' if "'" in name else "'"
        path += f"[{int(name)}]" if name.isdigit() else f"[{quote}{name}{quote}]"
    leaf = F.try_variant_get(F.try_parse_json(json), F.lit(path), "variant")
    return F.when(F.schema_of_variant(leaf) == "STRING", F.try_variant_get(F.try_parse_json(json), F.lit(path), "string"))


def render_markdown(sections: Column) -> Column:
    """Sections (heading, assertions of text and ref_ids) as Markdown: a heading, then an item for each assertion with its markers; an empty line between sections."""
    item = lambda a: F.concat(F.lit("- "), a["text"], F.array_join(F.transform(a["ref_ids"], lambda r: F.concat(F.lit("[[ref:"), r, F.lit("]]"))), ""), F.lit("\n"))
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), F.array_join(F.transform(s["assertions"], item), ""))), "\n")


def page_text(title: Column, content: Column) -> Column:
    """What of a page is embedded."""
    return F.concat_ws("\n", title, content)
