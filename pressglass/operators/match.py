"""Matching a watchlist: which documents contain which keywords as whole words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.sizes import BROADCAST_ROWS, small
from pressglass.storage import written

#: Keywords whose words may stand in a plan.
PLAN_KEYWORDS = 2_000
#: Words or keywords that a text is searched for one after the other.
SOUGHT_WORDS = 256


def active_keywords(keywords: DataFrame, module: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Active keywords with a text, of one module and some ids if given, ordered by text."""
    out = keywords.where(F.coalesce("active", F.lit(True)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if module is not None:
        out = out.where(F.col("module") == module)
    if ids is not None:
        out = out.where(F.col("id").isin(ids))
    return out.orderBy("text")


def prepared(keywords: DataFrame) -> DataFrame:
    """keyword, language, form, normal, pattern, tokens (words and signs), plain (words between single spaces only)."""
    normal = T.normalize_text(F.col("text"), F.col("language"))
    kw = keywords.select(F.col("text").alias("keyword"), "language", F.when(F.col("language") == "ur", "ur").otherwise("en").alias("form"), normal.alias("normal")).where("normal != ''")
    kw = kw.dropDuplicates(["keyword", "language"]).withColumn("tokens", T.signs_and_words(F.col("normal")))
    return kw.withColumns({"pattern": T.keyword_pattern(F.col("normal")), "plain": F.array_join("tokens", " ") == F.col("normal")})


def match_documents_theta(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, keyword, language: the plain form, every document against every pattern. For small inputs and as a reference."""
    forms = docs.select(F.col(id_col).alias("id"), T.normalize_text(F.col(text_col), "en").alias("en"), T.normalize_text(F.col(text_col), "ur").alias("ur"))
    form = F.when(F.col("language") == "ur", F.col("ur")).otherwise(F.col("en"))
    out = forms.join(small(prepared(keywords).drop("form")), F.rlike(form, F.col("pattern")))
    return out.select(F.col("id").alias(id_col), "keyword", "language").distinct()


def listed(keywords: DataFrame) -> list | None:
    """The prepared rows of a watchlist that may stand in a plan, None for a longer one."""
    rows = prepared(keywords).limit(PLAN_KEYWORDS + 1).collect()
    return rows if len(rows) <= PLAN_KEYWORDS else None


def _entry(row) -> Column:
    # A keyword of a single sign isn't sure: its pattern asks for what stands beside it.
    sure = len(row.tokens) == 1 and (len(row.normal) > 1 or row.normal.isalnum() or row.normal == "_")
    return F.struct(F.lit(row.keyword).alias("keyword"), F.lit(row.language).alias("language"), F.lit(row.normal).alias("normal"), F.lit(row.pattern).alias("pattern"), F.lit(sure).alias("sure"))


def _within(normal: Column, rows: list) -> Column:
    """array<struct<keyword, language>> of the listed keywords (of one form) in a normal form."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(max(r.tokens, key=len), []).append(r)
    lookup = F.create_map(*[c for w, x in sorted(by.items()) for c in (F.lit(w), F.array(*map(_entry, x)))])

    def verified(n: Column) -> Column:
        # What stands between two spaces is taken apart once, however often it occurs.
        tokens = T.signs_and_words(F.array_join(F.array_distinct(F.split(n, " ")), " "))
        words = F.filter(F.array_distinct(tokens), lambda w: w.isin(*by))
        wanted = F.flatten(F.transform(words, lambda w: F.element_at(lookup, w)))
        return F.filter(wanted, lambda c: c["sure"] | F.when(F.contains(n, c["normal"]), F.rlike(n, c["pattern"])).otherwise(False))

    # The form is an array of one, so that it is made once.
    good = F.get(F.transform(F.array(normal), verified), F.lit(0))
    return F.transform(good, lambda c: F.struct(c["keyword"].alias("keyword"), c["language"].alias("language")))


def _sought(normal: Column, rows: list) -> Column:
    """As _within(), for a few keywords: each is sought in the normal form, and where it occurs, as a whole word."""

    def entry(n: Column, row) -> Column:
        # Spaces of a normal form are single, so the words can stand there as they are, before what is asked of the sign ahead of them.
        words = "\\Q" + row.normal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        whole = F.rlike(n, F.lit(f"{words}(?<!{T.WORD}{words})(?!{T.WORD})"))
        return F.when(F.contains(n, F.lit(row.normal)) & whole, F.struct(F.lit(row.keyword).alias("keyword"), F.lit(row.language).alias("language")))

    kept = F.transform(F.array(normal), lambda n: F.filter(F.array(*[entry(n, r) for r in rows]), lambda m: m.isNotNull()))
    return F.get(kept, F.lit(0))


def found(text: Column, rows: list) -> Column:
    """array<struct<keyword, language>> of the listed keywords that a text contains, found within its own row.

    A few keywords (SOUGHT_WORDS) are sought one by one.  Of more, a text's distinct words and signs are looked up; those that lead a keyword (its longest word or sign) give the keywords to verify: a
    phrase is tried by its pattern in texts that contain it.
    """
    none = F.array().cast("array<struct<keyword:string,language:string>>")
    kinds = {k: [r for r in rows if r.form == k] for k in ("en", "ur")}
    way = _sought if len(rows) <= SOUGHT_WORDS else _within
    return F.concat(none, *[way(T.normalize_text(text, k, compose=False), own) for k, own in kinds.items() if own])


def positions(docs: DataFrame, forms: list[str]) -> DataFrame:
    """The positional index of docs (_row, id, text): _row, id, form, place, word, tokens.

    A row for each word or sign of a normal form at each place; tokens are all of these, each with the space before it, if there is one.
    """
    text = docs.select("_row", "id", T.composed(F.coalesce("text", F.lit(""))).alias("text"))
    normal = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), T.normalize_text(F.col("text"), k, compose=False).alias("normal")) for k in forms])).alias("f")
    tokens = F.regexp_extract_all("f.normal", F.lit(rf"( ?(?:{T.WORD}+|[^\p{{L}}\p{{N}}_ ]))"), F.lit(1))
    rows = text.select("_row", "id", normal).select("_row", "id", "f.form", F.explode(F.array(tokens)).alias("tokens"))
    return rows.select("_row", "id", "form", "tokens", F.posexplode("tokens").alias("place", "word")).withColumn("word", F.ltrim("word"))


def _by_positions(docs: DataFrame, kw: DataFrame) -> DataFrame:
    """_row, id, keyword, language by the positional index: a keyword is filed under its rarest word (that of the fewest keywords, so
    that no word that many keywords share meets all of these), and where that one stands the tokens around it have to be the keyword's.

    Texts aren't joined again, and a row is told by its own number, whatever its id.
    """
    words = kw.select("keyword", "language", "form", "normal", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "word"))
    many = words.groupBy("form", "word").agg(F.count_distinct("keyword", "language").alias("many"))
    rarest = words.join(small(many), ["form", "word"]).groupBy("keyword", "language", "form", "normal", "n").agg(F.min(F.struct("many", F.negate(F.length("word")).alias("_short"), "at", "word")).alias("r"))
    entries = rarest.select("keyword", "language", "form", "normal", "n", F.col("r.at").alias("at"), F.col("r.word").alias("word"))
    entries = written(entries, "keywords")  # sought among all texts, but made once
    facts = entries.agg(F.count("*"), F.max("n"), F.collect_set("form")).first()
    if not facts[0]:
        return docs.select("_row", "id", F.lit("").alias("keyword"), F.lit("").alias("language")).where("false")
    index = positions(docs, sorted(facts[2]))
    if facts[0] > BROADCAST_ROWS:  # rows travel: each with the tokens in reach only
        reach = facts[1]
        index = index.withColumn("tokens", F.slice("tokens", F.greatest(F.lit(1), F.col("place") + 1 - reach), 2 * reach + 1)).withColumn("place", F.least("place", F.lit(reach)))
    met = index.join(small(entries), ["form", "word"]).withColumn("begin", F.col("place") - F.col("at"))
    here = F.ltrim(F.array_join(F.slice("tokens", F.greatest(F.lit(1), F.col("begin") + 1), F.col("n")), ""))
    met = met.where((F.col("begin") >= 0) & (here == F.col("normal")))
    # A keyword that begins or ends with a sign has no word glued to that one; words end by themselves.
    is_word = lambda w: F.coalesce(w.rlike(f"^{T.WORD}"), F.lit(False))
    spaced = lambda w: F.coalesce(F.startswith(w, F.lit(" ")), F.lit(False))
    first, behind = F.get("tokens", F.col("begin")), F.get("tokens", F.col("begin") + F.col("n"))
    prior = F.when(F.col("begin") > 0, F.get("tokens", F.col("begin") - 1))
    glued_before = is_word(F.ltrim(prior)) & ~spaced(first) & ~is_word(F.col("normal"))
    glued_behind = is_word(behind) & ~F.coalesce(F.col("normal").rlike(f"{T.WORD}$"), F.lit(False))
    return met.where(~glued_before & ~glued_behind).select("_row", "id", "keyword", "language").distinct()


def match_documents(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, keyword, language, each once.

    A watchlist of up to PLAN_KEYWORDS keywords stands in the plan, and each text is matched within its row (found()).  A longer one is
    joined with a positional index of the texts (_by_positions()).  Rows without an id match too; rows of one id match together.
    """
    rows = listed(keywords)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows is None:
        out = _by_positions(text.withColumn("_row", F.monotonically_increasing_id()), prepared(keywords))
    else:
        out = text.select("id", F.explode(found(T.composed(F.coalesce("text", F.lit(""))), rows)).alias("m")).select("id", "m.*")
    return out.select(F.col("id").alias(id_col), "keyword", "language").distinct()


def labelled(docs: DataFrame, keywords: DataFrame, text_col: str = "text", labels: str = "labels") -> DataFrame:
    """Rows of docs with a match, all their columns, and the sorted array of keywords that each row itself contains."""
    rows = listed(keywords)
    if rows is not None:
        # An explode of one, so that the condition doesn't match the text once more.
        own = F.explode(F.array(found(T.composed(F.coalesce(text_col, F.lit(""))), rows))).alias("_found")
        out = docs.select("*", own).where(F.size("_found") > 0)
        return out.withColumn(labels, F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["keyword"])))).drop("_found")
    own = F.struct(*[F.col(c) for c in docs.columns])
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), own.alias("id"), F.col(text_col).alias("text"))
    kw = prepared(keywords)
    # Rows travel once, with their labels: grouped by number, not joined again.
    met = _by_positions(numbered.withColumn("id", F.lit(None).cast("long")), kw).groupBy("_row").agg(F.array_sort(F.collect_set("keyword")).alias(labels))
    return numbered.join(met, "_row").select("id.*", labels)


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters: each place is a match of what lies ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def prefilter_candidates(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that contain the longest word of some keyword as a substring: a sound first cut, no match is lost.

    A few such words (SOUGHT_WORDS) are sought in each text.  More of them by an index of trigrams: each is filed under its rarest
    trigram (that of the fewest words of the watchlist; words of two characters under themselves), the documents' different tokens
    meet the index by their trigrams in an equi-join, and what meets is checked with contains; documents are then those with such a
    token, told by the digests of their texts: no text travels with its tokens.  A keyword whose longest word has under two
    characters switches the cut off.  The watchlist stays in tables.
    """
    form = F.when(F.col("language") == "ur", "ur").otherwise("en")
    words = keywords.select(form.alias("form"), T.longest_token(T.normalize_text(F.col("text"), F.col("language"))).alias("w")).where("w != ''").distinct()
    words = written(words, "words")
    shortest = words.agg(F.min(F.length("w"))).first()[0]
    if shortest is None or shortest < 2:
        return docs.where("false") if shortest is None else docs
    few = words.limit(SOUGHT_WORDS + 1).collect()
    if len(few) <= SOUGHT_WORDS:
        return _with_any(docs, few, text_col)
    sizes = [3] if shortest > 2 else [2, 3]
    own = F.when(F.length("w") == 2, F.array("w")).otherwise(_grams(F.col("w"), 3))
    filed = words.select("form", "w", F.explode(own).alias("gram"))
    many = filed.groupBy("form", "gram").agg(F.count("*").alias("n"))
    index = filed.join(small(many), ["form", "gram"]).groupBy("form", "w").agg(F.min(F.struct("n", "gram")).alias("rarest")).select("form", F.col("rarest.gram").alias("gram"), "w")
    index = small(written(index, "trigrams"))
    kinds = [r[0] for r in words.select("form").distinct().collect()]
    # Words of letters and digits lie within what stands between other signs, of which there are fewer different ones than between spaces.
    signs = {r[0] for r in words.where(~F.col("w").rlike(f"^{T.WORD}+$")).select("form").distinct().collect()}

    def tokens_of(normal: Column, k: str) -> Column:
        chunks = F.array_distinct(F.split(normal, " "))
        return chunks if k in signs else F.array_distinct(T.word_tokens(F.array_join(chunks, " ")))

    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
    texts = docs.select(digest.alias("_digest"), T.composed(F.coalesce(text_col, F.lit(""))).alias("_text"))
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), tokens_of(T.normalize_text(F.col("_text"), k, compose=False), k).alias("tokens")) for k in kinds])).alias("f")
    tokens = texts.select("_digest", forms).select("_digest", "f.form", F.explode("f.tokens").alias("token"))
    known = tokens.select("form", "token").distinct().select("*", F.explode(F.array_distinct(F.concat(*[_grams(F.col("token"), n) for n in sizes]))).alias("gram"))
    met = written(known.join(index, ["form", "gram"]).where(F.contains("token", F.col("w"))).select("form", "token").distinct(), "tokens")
    good = written(tokens.join(small(met), ["form", "token"]).select("_digest").distinct(), "digests")
    return docs.withColumn("_digest", digest).join(small(good, 1_000_000), "_digest", "left_semi").drop("_digest")


def _with_any(docs: DataFrame, words: list, text_col: str) -> DataFrame:
    """docs whose normal form (of the words' own form) contains one of the words (form, w)."""
    text = docs.withColumn("_text", T.composed(F.coalesce(text_col, F.lit(""))))
    holds = F.lit(False)
    for kind in ("en", "ur"):
        own = [r.w for r in words if r.form == kind]
        if own:
            wanted = F.array(*map(F.lit, own))
            normal = F.array(T.normalize_text(F.col("_text"), kind, compose=False))  # an array of one, so that it is made once
            holds = holds | F.exists(normal, lambda n: F.exists(wanted, lambda w: F.contains(n, w)))  # noqa: B023
    return text.where(holds).drop("_text")


def labels_per_document(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return matches.groupBy(id_col).agg(F.array_sort(F.collect_set("keyword")).alias("labels"))


def distinct_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def new_labels(existing, found):
    """Labels in the array found that existing lacks, whatever their case."""
    have = F.transform(F.coalesce(existing, F.array().cast("array<string>")), lambda x: F.lower(x))
    return F.filter(found, lambda x: ~F.array_contains(have, F.lower(x)))


def keyword_fingerprint(keywords: DataFrame) -> DataFrame:
    """One row: SHA-1 of the sorted `text 0x1F language` lines."""
    line = F.concat_ws("\x1f", "text", "language")
    return keywords.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("fingerprint"))


def parse_keyword_batch(df: DataFrame, col: str, id_col: str) -> DataFrame:
    """Free text to terms: commas and lines part them, the first spelling of each stays, in order."""
    parts = df.select(id_col, F.posexplode(F.split(F.replace(F.col(col), F.lit(","), F.lit("\n")), r"\r?\n")).alias("pos", "raw"))
    terms = parts.select(id_col, "pos", T.squash_ws(F.col("raw")).alias("term")).where("term != ''").withColumn("fold", F.lower("term"))
    return distinct_first(terms, [id_col, "fold"], ["pos"]).select(id_col, "pos", "term")


def select_sources(sources: DataFrame, names: DataFrame | None) -> DataFrame:
    """Sources by name, whatever the case; no selection takes all."""
    if names is None or names.isEmpty():
        return sources
    own = names.select(F.lower("name").alias("_fold")).distinct()
    return sources.withColumn("_fold", F.lower("name")).join(small(own), "_fold", "left_semi").drop("_fold")


def exclude_hidden(sources: DataFrame, hidden: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    own = hidden.select(F.lower("name").alias("_fold")).distinct()
    out = sources.withColumn("_fold", F.lower("name")).join(small(own), "_fold", "left_anti").drop("_fold")
    return out.where(F.col("slug").isin(slugs)) if slugs else out
