"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) come from fixed patterns. They seed a graph of
contexts - the one and two words before an identifier - and identifier-like
instances. In each round a context's confidence is the share of its occurrences in the whole
corpus that stand before a believed instance; contexts with enough distinct
believed instances and enough confidence make the other instances beside them
believed. High-confidence contexts so discover identifiers that no base pattern
matches; base spans always stay.

Positions: matches are set apart by a private-use character, and a running sum of the pieces'
lengths over a window per row gives code-point offsets. Regular expressions
avoid nested repetition: Java matches it recursively. Separators inside
cards and domains are first replaced, one for one, by private-use characters.

Scale: whole texts are scanned where they are and are not shuffled; what moves
is matches, contexts and counts. Contexts to be counted are broadcast up to
`broadcast_rows`, else joined by shuffle.

Edge cases: null and empty texts have no spans; private-use characters of the text count as any other
character; repeated ids are rows of their own; ties in order go by kind; columns
other than doc_id and text are not read; an empty table gives no rows. Very long
texts are scanned whole, as one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, placed, table

KINDS = ("email", "ip", "card", "phone")
CUT, GAP, DOT = "", "", ""
SPACE = r"\x20\x09-\x0D"
LOCAL, LABEL = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
EMAIL = rf"((?:\G|(?<![{LOCAL}{DOT}]))[{LOCAL}{DOT}]++@[{LABEL}]++{DOT}[{LABEL}{DOT}]*+)"
IP = r"((?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)"
CARD = rf"((?<![0-9{GAP}])[0-9{GAP}]{{14,}}+)"
PHONE = r"(\+[0-9][\x20().0-9\-]+[0-9])"
#: Runs of seven or more digits with telephone-like separators, else words with a digit or an at sign.
#: A label's end (colon, equals sign, bracket) parts it from what follows, as white space does.
ENDS = r":=(\["
LIKE = rf"((?<![0-9A-Za-z])\(?[0-9][0-9().\x20\-]{{5,}}[0-9](?![0-9A-Za-z])|(?<![^{SPACE}{ENDS}])[^{SPACE}{ENDS}0-9@]*+[0-9@][^{SPACE}]*+)"


def _pieces(text: Column, pattern: str) -> Column:
    """Text cut around each match: the matches are at the odd places."""
    return F.split(F.regexp_replace(text, pattern, f"{CUT}$1{CUT}"), CUT, -1)


def _spaced(text: Column) -> Column:
    """Text whose words, and labels from what is glued to them, are parted by spaces alone."""
    for mark in ":=([":
        text = F.replace(text, F.lit(mark), F.lit(f"{mark} "))
    return F.translate(text, "\t\n\x0b\f\r", " " * 5)


def _digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def matches(documents: DataFrame) -> DataFrame:
    """row, kind, start, end, value, l1, l2 of every match, base kinds and 'like', before any test of the value.

    documents: row, text.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), CUT + GAP + DOT, "???")
    none = F.lit(None).cast("array<string>")
    dotted = F.regexp_replace(text, rf"(?<=[{LABEL}])\.(?=[{LABEL}])", DOT)
    gapped = F.regexp_replace(text, r"(?<=[0-9])[\x20\-](?=[0-9])", GAP)
    each = {
        "email": F.when(F.contains(text, F.lit("@")), _pieces(dotted, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _pieces(text, IP)).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[\x20\-]?[0-9]){13}"), _pieces(gapped, CARD)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _pieces(text, PHONE)).otherwise(none),
        "like": F.when(text.rlike("[0-9@]"), _pieces(text, LIKE)).otherwise(none),
    }
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("pieces")) for k, c in each.items()]), lambda x: F.size(x["pieces"]) > 1)
    found = documents.select("row", F.explode(kinds).alias("x")).select("row", "x.kind", F.posexplode("x.pieces").alias("i", "piece"))
    match = F.col("i") % 2 == 1
    before = F.when(~match, _spaced(F.col("piece")))
    found = found.select("row", "kind", "i", F.length("piece").alias("size"), F.when(match, F.translate("piece", GAP + DOT, " .")).alias("value"), F.rtrim(before).alias("before"))
    found = found.withColumn("l1", F.substring_index("before", " ", -1)).withColumn("rest", F.rtrim(F.expr("substring(before, 1, length(before) - length(l1))")))
    found = found.withColumn("l0", F.substring_index("rest", " ", -1)).select("row", "kind", "i", "size", "value", F.lower("l1").alias("l1"), F.when(F.col("l0") != "", F.lower(F.concat_ws(" ", "l0", "l1"))).alias("l2"))
    w = W.partitionBy("row", "kind").orderBy("i")
    end = F.sum("size").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    found = found.select("row", "kind", "i", "value", end.alias("end"), (end - F.col("size")).alias("start"), F.lag("l1").over(w).alias("l1"), F.lag("l2").over(w).alias("l2"))
    return found.where("i % 2 = 1").select("row", "kind", "start", "end", "value", F.when(F.col("l1") != "", F.col("l1")).alias("l1"), "l2")


def _valid() -> Column:
    value = F.col("value")
    digits = F.regexp_replace(value, "[^0-9]", "")
    part_fits = lambda p: F.coalesce(F.try_to_number(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 4), F.lit("9999")) <= 255, F.lit(False))
    return (
        F.when(F.col("kind") == "ip", F.forall(F.split(value, r"\."), part_fits))
        .when(F.col("kind") == "card", F.length(digits).between(14, 19) & _luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
        .otherwise(F.col("kind") == "email")
    )


def context_counts(documents: DataFrame, contexts: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """(context, total): how often each of the contexts stands in the corpus."""
    words = F.filter(F.split(_spaced(F.lower("text")), " "), lambda x: x != "")
    pairs = F.zip_with(F.concat(F.array(F.lit("")), F.col("w")), "w", lambda a, b: F.concat(a, F.lit(" "), b))
    grams = documents.where("text is not null").select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("context"))
    few = contexts.count() <= broadcast_rows
    return grams.join(F.broadcast(contexts) if few else contexts, "context", "left_semi").groupBy("context").agg(F.count("*").alias("total"))


def personal_spans(documents: DataFrame, rounds: int = 3, least_support: int = 3, confidence: float = 0.5) -> DataFrame:
    """row, kind, start, end, base (by a base pattern) of every span. documents: row, text."""
    found = materialize(matches(documents), "matches")
    base = materialize(found.where("kind <> 'like'").where(_valid()), "base")
    lead, tail = r"^[^0-9A-Za-z+@]+", r"[^0-9A-Za-z]+$"
    like = found.where("kind = 'like'").withColumn("lead", F.length(F.regexp_extract("value", f"({lead})", 1))).withColumn("tail", F.length(F.regexp_extract("value", f"({tail})", 1)))
    like = like.withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("end") - F.col("tail")).where("end > start").withColumn("value", F.regexp_replace(F.regexp_replace("value", lead, ""), tail, ""))
    like = like.where((_digits(F.col("value")) >= 7) | F.col("value").contains("@"))
    taken = base.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    like = like.join(taken, "row", "left").where("not exists(coalesce(taken, array()), t -> t.start < end and start < t.end)").drop("taken")
    shape = F.when(F.col("value").contains("@"), "email").when(F.col("value").rlike(r"^[0-9a-fA-F]*(?:[.:][0-9a-fA-F]*){3,}$"), "ip").when(_digits(F.col("value")) >= 13, "card").otherwise("phone")
    like = materialize(like.select("row", shape.alias("kind"), "start", "end", "value", "l1", "l2"), "like")

    name = F.lower(F.regexp_replace("value", f"[{SPACE}().\\-]", ""))
    instances = base.select(name.alias("name"), F.lit(1).alias("seed"), "l1", "l2").unionByName(like.select(name.alias("name"), F.lit(0).alias("seed"), "l1", "l2"))
    edges = instances.select("name", "seed", F.explode(F.array("l1", "l2")).alias("context")).where("context is not null").groupBy("context", "name").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "edges")
    # only contexts of enough distinct instances, seeds among them or not, can ever be believed
    enough = edges.groupBy("context").agg(F.count("*").alias("names")).where(F.col("names") >= least_support).select("context")
    totals = materialize(context_counts(documents, materialize(enough, "contexts")), "totals")

    seeds = instances.where("seed = 1").select("name").distinct().withColumn("belief", F.lit(1.0))
    believed, patterns = seeds, None
    for _ in range(rounds):
        scored = edges.join(believed, "name").groupBy("context").agg(F.sum(F.col("n") * F.col("belief")).alias("hits"), F.count("*").alias("support")).where(F.col("support") >= least_support)
        patterns = materialize(scored.join(totals, "context").withColumn("sure", F.least(F.col("hits") / F.col("total"), F.lit(0.99))).where(F.col("sure") >= confidence).select("context", "sure"), "patterns")
        grown = edges.join(patterns, "context").groupBy("name").agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("belief"))
        believed = materialize(seeds.unionByName(grown).groupBy("name").agg(F.max("belief").alias("belief")).where(F.col("belief") >= confidence), "believed")
    spoken = like.withColumn("name", name).withColumn("context", F.explode(F.array("l1", "l2"))).join(patterns, "context").join(believed, "name", "left_semi")
    added = spoken.select("row", "kind", "start", "end").distinct()
    return base.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.withColumn("base", F.lit(False)))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, row and spans: array of (start, order, end, kind, base), by start, then kind."""
    numbered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = placed(numbered).select("doc_id", "text", F.struct("q_file", "q_row").alias("row"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = personal_spans(numbered.select("row", "text")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), order.alias("order"), F.col("end").cast("long").alias("end"), "kind", "base"))).alias("spans"))
    return numbered.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string,base:boolean>>")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
