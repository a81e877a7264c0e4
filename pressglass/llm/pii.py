"""Personal data in DataFrame operations only: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; gate: a text without a match has none (a cheap first look); score: before the words nearby;
    context: words that raise the score; base: spans count whatever their score."""

    name: str
    pattern: str
    gate: str
    score: float
    context: str
    base: bool = True


# Possessive quantifiers and look-behind only spare retries that can't match: matches are those of the plain
# patterns, in time linear in the text.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|call|tel\b|mobile|telefon"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, "iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.2, "ssn|social|security", False),
)
#: Spans of kinds that aren't base are reported from this score on; words nearby add NEARBY.
LEAST, NEARBY = 0.5, 0.35
#: Characters on either side that count as nearby.
AROUND = 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right doubled, digit sums, divisible by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces passes: first four characters to the end, letters as 10 to 35, remainder 1."""
    moved = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = F.transform(moved, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def confirmed(kind: Column, span: Column) -> Column:
    """The checks of each kind."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    bare = F.replace(span, F.lit(" "), F.lit(""))
    return (
        F.when(kind == "ip", span.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "iban", F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False))
        .when(kind == "ssn", ~span.rlike(r"^(?:000|666|9)|-00-|-0000$"))
        .otherwise(True)
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: id, text_hash (tells rows with the same id apart), kind, kind_no, start, end (code points,
    end exclusive), span, score, base.

    Null and empty texts have none; of repeated rows, each gives its spans.  The pieces between matches give places
    and neighbourhood: a text is read once per kind whose first look succeeds, and only matches are dealt out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("rid"))

    def proposed(no: int, k: Kind) -> Column:
        t = F.col("text")
        seen = F.contains(t, F.lit(k.gate)) if k.gate else t.rlike(k.pattern if not k.base else "[0-9][ -]?[0-9]")
        return F.when(seen, F.struct(F.lit(no).alias("kind_no"), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0)).alias("spans"), F.split(t, k.pattern, -1).alias("gaps")))

    kinds = base.select("id", "text_hash", "rid", F.explode(F.array(*[proposed(i, k) for i, k in enumerate(KINDS)])).alias("k")).where("k is not null and size(k.spans) > 0")
    # Match i lies behind gap i. Places: the lengths of all gaps and matches before, as running sums within a text and kind.
    # Of each gap the first characters are near the match before it, the last ones near the match behind it.
    around = F.lit(AROUND)
    piece = lambda s, gap: F.struct(s.alias("span"), F.length(gap).alias("step"), F.left(gap, around).alias("after"), F.right(gap, around).alias("ahead"))
    both = F.zip_with("k.spans", F.slice("k.gaps", 2, F.size("k.spans")), piece)
    gap0 = F.get("k.gaps", F.lit(0))
    pieces = kinds.select("id", "text_hash", "rid", "k.kind_no", F.posexplode(both).alias("i", "p"), F.length(gap0).alias("first"), F.right(gap0, around).alias("ahead0"))
    pieces = pieces.select("id", "text_hash", "rid", "kind_no", "i", "p.*", "first", "ahead0")
    upto = Window.partitionBy("rid", "kind_no").orderBy("i")
    passed = F.sum(F.length("span") + F.col("step")).over(upto) - F.length("span") - F.col("step")
    placed = pieces.withColumn("start", (F.col("first") + passed).cast("long"))
    placed = placed.withColumn("before", F.when(F.col("i") == 0, F.col("ahead0")).otherwise(F.lag("ahead").over(upto)))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    placed = placed.withColumn("kind", F.get(names, F.col("kind_no"))).where(confirmed(F.col("kind"), F.col("span")))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    raised = F.lit(False)
    for k in KINDS:
        raised = F.when(F.col("kind") == k.name, near.rlike(k.context)).otherwise(raised)
    score = F.least(F.lit(1.0), F.get(F.array(*[F.lit(k.score) for k in KINDS]), F.col("kind_no")) + F.when(raised, NEARBY).otherwise(0.0))
    is_base = F.get(F.array(*[F.lit(k.base) for k in KINDS]), F.col("kind_no"))
    out = placed.select("id", "text_hash", "rid", "kind", "kind_no", "start", (F.col("start") + F.length("span")).alias("end"), "span", score.alias("score"), is_base.alias("base"))
    return out.where(F.col("base") | (F.col("score") >= LEAST)).withColumnRenamed("id", id_col)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score (null: no span)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Repeated rows have the same spans: they are found once.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    spans = find_spans(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_hash", "kind", "kind_no", "start", "end", "score", "base").distinct()
    entry = F.struct("kind_no", "start", "end", "kind", "base")
    joined = lambda only: F.array_join(F.transform(F.filter("all", only), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("kind") == k.name).alias(f"n_{k.name}") for k in KINDS if k.base]
    found = spans.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.max("score").alias("max_score"), *counts)
    found = found.withColumn("base_spans", joined(lambda x: x["base"])).withColumn("spans", joined(lambda x: F.lit(True))).drop("all")
    out = rows.alias("r").join(found.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left")
    return out.select(F.col("r.id").alias(id_col), *[F.coalesce(f"n_{k.name}", F.lit(0)).alias(f"n_{k.name}") for k in KINDS if k.base], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "max_score")
