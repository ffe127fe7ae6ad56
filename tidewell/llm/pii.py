"""PII by information-theoretic sanitisation, in DataFrame and SQL functions only.

Base entities are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. What the corpus says about
them decides what else must go: a word t near an entity e discloses it if

    PMI(e; t) = log2(p(e | t) / p(e)) >= alpha * IC(e),   IC(e) = -log2 p(e)

with p(e) the share of documents that have e, p(e | t) the share of documents with t that have it near e, both over all
documents. To be evidence the pair must occur in ``support`` different surroundings, so copies of one document don't
make its words disclosing. Every occurrence of a disclosing word becomes a span of kind ``term``. Sanitising puts a
generalisation, such as <EMAIL> or <TERM>, in place of each span. Words are runs of letters and digits of any length;
only words of one to three letters that are all lower-case ("to") are never taken for disclosing.

Spans are in code points, end exclusive. Cases: a null text is an empty one, without spans; a null doc_id is kept;
rows that repeat get equal spans; very long texts are searched whole, by patterns that never recurse on their length;
an empty table gives no rows; further columns are kept by :func:`sanitised` and not read by :func:`spans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch, table, unused

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base patterns: what follows a repetition can't begin with its characters, so nothing is lost.
#: \G lets a match begin where the last one ended. Runs of digits that aren't 12 to 19 long are no cards from the start.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Runs of letters and digits, but for those of one to three lower-case letters.
_TERM = r"(?<![\p{L}\p{N}])(?!\p{Ll}{1,3}(?![\p{L}\p{N}]))[\p{L}\p{N}]++"
SPAN = "struct<start:int,rank:int,end:int,found:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda part: part.rlike(_BYTE)),
    "card": lambda x: F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds spans: array of (start, rank of the kind, end, found), sorted; the column text must not be null."""
    out = docs
    for rank, kind in enumerate(KINDS[:4]):
        may = F.col("text").contains("@") if kind == "email" else F.col("text").contains("+") if kind == "phone" else F.col("text").rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){11}")
        valid = VALID[kind]
        places = F.filter(_located("text", PATTERNS[kind], rank), lambda s: valid(s["found"]))  # noqa: B023
        out = out.withColumn(f"_{kind}", F.when(may, places).otherwise(F.lit(None).cast(f"array<{SPAN}>")))
    none = F.array().cast(f"array<{SPAN}>")
    return out.withColumn("spans", F.array_sort(F.concat(*(F.coalesce(f"_{kind}", none) for kind in KINDS[:4])))).drop(*(f"_{kind}" for kind in KINDS[:4]))


def _located(text: str, pattern: str | None, rank: int, by: Column | None = None) -> Column:
    """Places of all matches in a column: what stands between them, by split, gives each one's start."""
    p = F.lit(pattern) if by is None else by
    gaps, found = F.split(F.col(text), p, -1), F.regexp_extract_all(F.col(text), p, F.lit(0))
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")))
    real = F.filter(zipped, lambda x: x["found"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["found"].alias("found")))).alias("out"))

    return F.aggregate(real, start, step, lambda acc: acc["out"])


def surroundings(found: DataFrame, reach: int = 100) -> DataFrame:
    """From rows with base spans (row, text, spans): (entity, row, near: hash of the surroundings, term)."""
    one = found.select("row", "text", F.explode("spans").alias("s"))
    left, right = F.substring("text", F.greatest(F.col("s.start") - reach + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(reach))), F.substring("text", F.col("s.end") + 1, F.lit(reach))
    left = F.when(F.col("s.start") > reach, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.when(F.length("text") - F.col("s.end") > reach, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    near = F.concat(left, F.lit("\n"), right)
    named = one.select("row", F.concat_ws(":", F.col("s.rank"), F.col("s.found")).alias("entity"), near.alias("near"))
    return named.select("entity", "row", F.xxhash64("near").alias("near"), F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(_TERM), F.lit(0)))).alias("term"))


def disclosing(docs: DataFrame, found: DataFrame, scratch: Scratch, alpha: float = 0.8, support: int = 3) -> DataFrame:
    """Words that disclose an entity: (term). docs(row, text): all of them; found: those with base spans."""
    pairs = scratch.write(surroundings(found), "pairs")
    counts = pairs.groupBy("entity", "term").agg(F.count_distinct("row").alias("n_et"), F.count_distinct("near").alias("support")).where(F.col("support") >= support)
    entities = found.select("row", F.explode("spans").alias("s")).select("row", F.concat_ws(":", F.col("s.rank"), F.col("s.found")).alias("entity")).groupBy("entity").agg(F.count_distinct("row").alias("n_e"))
    n = docs.count()
    likely = counts.join(entities, "entity").where(F.col("n_e") < n)
    # a word in more documents than this can't disclose the entity; one part in 16 of them, drawn by hash, already tells
    # so of common words, and nothing else is decided by it
    most = F.col("n_et") * F.pow(n / F.col("n_e"), 1 - alpha) * (1 + 1e-9)
    words = lambda rows: rows.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("term"))
    seen = words(docs.where(F.pmod("row", F.lit(16)) == 0)).groupBy("term").agg(F.count("*").alias("seen"))
    likely = scratch.write(likely.join(seen, "term", "left").where(F.coalesce("seen", F.lit(0)) <= most).drop("seen"), "likely")
    often = words(docs).join(likely.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    pmi = F.log2(F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0)) * n / F.col("n_e"))
    return scratch.write(likely.join(often, "term").where(pmi >= alpha * F.log2(n / F.col("n_e"))).select("term").distinct(), "terms")


def spans(docs: DataFrame, alpha: float = 0.8, support: int = 3) -> DataFrame:
    """From docs(doc_id, text): doc_id, row (the text's hash), base and spans (base and terms) for each row."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text", "doc_id"))
    based = base_spans(rows)
    found = scratch.write(based.where(F.size("spans") > 0), "found")
    terms = disclosing(rows, found, scratch, alpha, support)
    held = rows.select("doc_id", "row", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("term")).join(terms, "term")
    edge = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    located = held.select("row", "term", _located("text", None, 4, F.concat(F.lit(edge[0]), "term", F.lit(edge[1]))).alias("found"))
    places = located.dropDuplicates(["row", "term"]).select("row", F.explode("found").alias("s"))  # spans are shuffled, and no texts
    more = scratch.write(places.groupBy("row").agg(F.collect_list("s").alias("more")), "more")
    base = rows.select("doc_id", "row").join(found.select("row", F.col("spans").alias("base")).dropDuplicates(["row"]), "row", "left").join(more, "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    return base.select("doc_id", "row", F.coalesce("base", none).alias("base"), F.array_sort(F.concat(F.coalesce("base", none), F.coalesce("more", none))).alias("spans"))


def written(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, alpha: float = 0.8, support: int = 3) -> DataFrame:
    """docs with a generalisation in place of each span of text; rows without spans are as they were."""
    row, found = unused(docs, "row", "spans")
    marked = spans(docs, alpha, support).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(found)).dropDuplicates([row])
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        text = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), names[s["rank"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], text).otherwise(acc["out"]).alias("out"))

    new = F.aggregate(found, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    joined = docs.withColumn(row, F.xxhash64(F.coalesce("text", F.lit("")), "doc_id")).join(marked, row, "left")
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(new)).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
