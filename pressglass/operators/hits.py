"""Locating keywords in timed transcripts, and verifying what was located.

Segments stay nested in their transcript: each (transcript, keyword) pair is one row, and all steps are array functions on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.sizes import small

MIN_GAP, NO_SPEECH, LOGPROB = 3, 0.6, -1.0
#: Place of no time.
NO_LATER = 1 << 30
HIT = "array<struct<start:int,end:int,excerpt:string>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def seg_end(s: Column) -> Column:
    return F.coalesce(F.nullif(s["end"], F.lit(0.0)), s["start"])


def reliable_segments(segments: Column) -> Column:
    """Segments that the recogniser stands behind; missing measures are trusted."""
    return F.filter(segments, lambda s: (F.coalesce(s["no_speech_prob"], F.lit(0.0)) <= NO_SPEECH) & (F.coalesce(s["avg_logprob"], F.lit(0.0)) >= LOGPROB))


def chunk_join(texts: Column, sep: str = " ") -> Column:
    return F.trim(F.array_join(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), sep))


def segments_text(segments: Column) -> Column:
    return chunk_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))))


def is_word_level(segments: Column) -> Column:
    """Of the first 40 segments, at least 0.7 have two words or fewer."""
    first = F.slice(segments, 1, 40)
    short = F.filter(first, lambda s: F.size(F.filter(F.split(T.squash_ws(F.coalesce(s["text"], F.lit(""))), " "), lambda w: w != "")) <= 2)
    return (F.size(first) > 0) & (F.size(short) / F.greatest(F.size(first), F.lit(1)) >= 0.7)


def segments_near(segments: Column, second: Column, radius: float) -> Column:
    return F.filter(segments, lambda s: (seg_end(s) >= second - radius) & (s["start"] <= second + radius))


def excerpt_around(segments: Column, second: Column, radius: float = 6.0) -> Column:
    return F.left(segments_text(segments_near(segments, second, radius)), F.lit(240))


def interpolate_time(start: Column, end: Column, at: Column, length: Column) -> Column:
    """The second of a place in a segment's text; half-even rounding, not below 0."""
    part = at / F.greatest(length, F.lit(1))
    return F.greatest(F.bround(F.when(end <= start, start).otherwise(start + part * (end - start))).cast("int"), F.lit(0))


def _round(x: Column) -> Column:
    return F.greatest(F.bround(x).cast("int"), F.lit(0))


def collapsed(starts: Column, gap: float) -> Column:
    """Of sorted times, those that are kept: the first, then each first one `gap` or more after the last one kept.

    Each time's next kept one is found by binary search; then pointers double: the first 2^k kept ones and the pointers that
    lead 2^k on give the first 2^(k + 1).  So a row of n times takes n log n steps.  Returns their places, from 0.
    """
    none = F.lit(NO_LATER)

    def of(s: Column) -> Column:
        n = F.size(s)
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 1.0)).cast("int") + 1))

        def following(x: Column, i: Column) -> Column:
            span = F.struct((i + 1).alias("lo"), n.alias("hi"))

            def halve(a: Column, _: Column) -> Column:
                mid = ((a["lo"] + a["hi"]) / 2).cast("int")
                late = F.get(s, mid) - x >= gap
                return F.when(a["lo"] >= a["hi"], a).when(late, F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))

            return F.aggregate(rounds, span, halve, lambda a: F.when(a["lo"] < n, a["lo"]).otherwise(none))

        first = F.struct(F.transform(s, following).alias("to"), F.array(F.lit(0)).alias("kept"))

        def double(a: Column, _: Column) -> Column:
            jump = lambda i: F.coalesce(F.get(a["to"], i), none)
            more = F.filter(F.transform(a["kept"], jump), lambda i: i != none)
            return F.struct(F.transform(a["to"], jump).alias("to"), F.concat(a["kept"], more).alias("kept"))

        return F.when(n > 0, F.aggregate(rounds, first, double, lambda a: a["kept"])).otherwise(F.array().cast("array<int>"))

    return F.get(F.transform(F.array(starts), of), F.lit(0))


def collapse_utterances(hits: Column, gap: int = MIN_GAP) -> Column:
    """Sorted hits without those closer than gap seconds to the last one kept (not to the last one seen)."""
    return F.transform(collapsed(F.transform(hits, lambda h: h["start"]), gap), lambda i: F.get(hits, i))


def token_stream(segments: Column, language: Column) -> Column:
    """array<struct<w, start, end>>: every word with its segment's times."""
    return F.flatten(F.transform(segments, lambda s: F.transform(T.word_tokens(T.normalize_text(s["text"], language, compose=False)), lambda w: F.struct(w.alias("w"), F.coalesce(s["start"], F.lit(0.0)).alias("start"), s["end"].alias("end")))))


def phrase_positions(words: Column, phrase: Column) -> Column:
    """0-based places at which the words of phrase follow each other."""
    none = F.array().cast("array<int>")

    def of(x: Column) -> Column:  # bound once: inside the filter they would be evaluated for each place
        n = F.size(x["p"])
        starts = F.when(F.size(x["w"]) >= n, F.sequence(F.lit(0), F.size(x["w"]) - n)).otherwise(none)
        return F.when(n > 0, F.filter(starts, lambda i: F.slice(x["w"], i + 1, n) == x["p"])).otherwise(none)

    return _let(F.struct(words.alias("w"), phrase.alias("p")), of)


def loop_ranges(stream: Column, phrase: Column) -> Column:
    """Time ranges of three or more repeats with at most one word between: array<struct<lo, hi>>."""
    n = F.size(phrase)

    def of(both: Column) -> Column:
        at = both["at"]
        runs = F.aggregate(at, F.expr("cast(array() as array<struct<first:int,last:int,n:int>>)"), lambda acc, i: F.when((F.size(acc) > 0) & (i - F.coalesce(F.try_element_at(acc, F.lit(-1))["last"], F.lit(-1 << 30)) <= n + 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), i.alias("last"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("first"), i.alias("last"), F.lit(1).alias("n"))))))
        long = F.filter(runs, lambda r: r["n"] >= 3)
        return F.transform(long, lambda r: F.struct(F.get(both["s"], r["first"])["start"].alias("lo"), F.get(both["s"], F.least(r["last"] + n - 1, F.size(both["s"]) - 1))["start"].alias("hi")))

    return _let(F.struct(phrase_positions(F.transform(stream, lambda x: x["w"]), phrase).alias("at"), stream.alias("s")), of)


def locate_hits(transcripts: DataFrame, keywords: DataFrame, id_col: str = "video_id") -> DataFrame:
    """id, keyword, language, hits (array of start, end, excerpt, in order): every verified spoken occurrence.

    transcripts: id, segments.  Only pairs whose trusted text matches the keyword are kept; transcripts without
    segments have none.  Word-level transcripts are walked word by word, others interpolated inside segments, each with the other
    as fallback where the order of preference says so; then near repeats collapse, loops go and hits are verified.
    """
    from pressglass.operators.match import match_documents

    trusted = transcripts.select(F.col(id_col).alias("id"), reliable_segments("segments").alias("segs")).where(F.size("segs") > 0)
    corpus = trusted.select(F.col("id").alias("doc_id"), segments_text(F.col("segs")).alias("text"))
    pairs = match_documents(corpus, keywords).withColumnRenamed("doc_id", "id")
    rows = pairs.join(trusted, "id")
    rows = rows.withColumn("normal", T.normalize_text(F.col("keyword"), F.col("language"))).withColumn("phrase", T.word_tokens(F.col("normal"))).withColumn("spaced", F.split("normal", " ")).withColumn("pattern", T.keyword_pattern(F.col("normal"))).withColumn("by_word", is_word_level(F.col("segs")))
    return _located(rows).select(F.col("id").alias(id_col), "keyword", "language", "hits").where(F.size("hits") > 0)


def _located(rows: DataFrame) -> DataFrame:
    segs, lang = F.col("segs"), F.col("language")
    # Each step is a column of a stored array: inside lambdas, expressions would be evaluated for each element.
    rows = rows.withColumn("stream", F.array(token_stream(segs, lang))).select("*", F.explode("stream").alias("s")).drop("stream")
    words = F.transform("s", lambda x: x["w"])
    rows = rows.select("*", F.explode(F.array(phrase_positions(words, F.col("spaced")))).alias("at"))
    n = F.size("spaced")
    walked = F.transform("at", lambda i: F.struct(_round(F.get("s", i)["start"]).alias("start"), F.coalesce(_round(F.get("s", i + n - 1)["end"]), _round(F.get("s", i)["start"])).alias("end")))
    walked = F.transform(walked, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), excerpt_around(segs, h["start"]).alias("excerpt")))

    def inside(s: Column) -> Column:
        raw = F.trim(F.coalesce(s["text"], F.lit("")))
        normal = T.normalize_text(raw, lang, compose=False)
        # Where the match begins: the length of what stands before the first match.
        before = F.length(F.get(F.split(normal, F.col("pattern"), 2), F.lit(0)))
        start = interpolate_time(F.coalesce(s["start"], F.lit(0.0)), seg_end(s), before, F.length(normal))
        hit = F.struct(start.alias("start"), F.coalesce(_round(s["end"]), start).alias("end"), F.left(raw, F.lit(240)).alias("excerpt"))
        return F.when(F.rlike(normal, F.col("pattern")), hit)

    rows = rows.select("*", F.explode(F.array(walked)).alias("walked"), ).select("*", F.explode(F.array(F.filter(F.transform(segs, inside), lambda h: h.isNotNull()))).alias("inside"))
    first = F.when(F.col("by_word") & (F.size("walked") > 0), F.col("walked")).when(F.size("inside") > 0, F.col("inside")).when(~F.col("by_word"), F.col("walked")).otherwise(F.slice("walked", 1, 0))
    rows = rows.select("*", F.explode(F.array(collapse_utterances(F.array_sort(first, lambda a, b: a["start"] - b["start"])))).alias("kept"), F.lit(1).alias("_"))
    rows = rows.select("*", F.explode(F.array(loop_ranges(F.col("s"), F.col("spaced")))).alias("loops"))
    clear = F.filter("kept", lambda h: ~F.exists("loops", lambda r: (h["start"] >= r["lo"] - 1) & (h["start"] <= r["hi"] + 1)))
    sure = F.filter(clear, lambda h: (h["start"] >= 0) & F.rlike(T.normalize_text(h["excerpt"], lang, compose=False), F.col("pattern")) & F.rlike(T.normalize_text(segments_text(segments_near(segs, h["start"], 3.0)), lang, compose=False), F.col("pattern")))
    return rows.withColumn("hits", sure)


def keyword_second(located: DataFrame, id_col: str = "video_id") -> DataFrame:
    """The first located second of each keyword."""
    return located.select(id_col, "keyword", F.get("hits", F.lit(0))["start"].alias("second"))


def hits_map(located: DataFrame, id_col: str = "video_id") -> DataFrame:
    """One row per transcript: {keyword: ordered hits}.  A keyword that is there in two languages has the hits of both."""
    flat = located.where(F.size("hits") > 0).groupBy(id_col, "keyword").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    entry = F.struct("keyword", F.array_sort("hits", lambda a, b: a["start"] - b["start"]).alias("hits"))
    return flat.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("keyword_hits"))


def first_hit(located: DataFrame, id_col: str = "video_id") -> DataFrame:
    """The first hit of the alphabetically first keyword."""
    one = F.struct("keyword", F.get("hits", F.lit(0)).alias("hit"))
    return located.where(F.size("hits") > 0).groupBy(id_col).agg(F.min_by(one, F.struct("keyword")).alias("x")).select(id_col, "x.keyword", "x.hit.start", "x.hit.excerpt")


def earliest_hit(located: DataFrame, id_col: str = "video_id") -> DataFrame:
    """The earliest second over all keywords, and the first excerpt that isn't blank in keyword order."""
    flat = located.select(id_col, "keyword", F.inline("hits"))
    return flat.groupBy(id_col).agg(F.min("start").alias("second"), F.min_by(F.when(F.trim("excerpt") != "", F.col("excerpt")), F.when(F.trim("excerpt") != "", F.struct("keyword", "start"))).alias("excerpt"))


def verify_hits(hits: Column, keyword: Column, language: Column) -> Column:
    """Stored hits whose excerpt holds the keyword, in order, near repeats collapsed."""
    pattern = T.keyword_pattern(T.normalize_text(keyword, language, compose=False))
    good = F.filter(hits, lambda h: (F.coalesce(h["start"], F.lit(-1)) >= 0) & F.coalesce(F.rlike(T.normalize_text(h["excerpt"], language, compose=False), pattern), F.lit(False)))
    return collapse_utterances(F.array_sort(good, lambda a, b: a["start"] - b["start"]))


def prune_hits(mentions: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """mentions with keyword_hits cut to verified ones and matched_keywords to keywords that still have some.

    languages (text, language) has each keyword's language; others have that of their script.  A keyword listed in two languages
    keeps the hits that either form verifies.
    """
    if languages is None:
        clean = F.transform_values("keyword_hits", lambda k, v: verify_hits(v, k, T.script_language(k)))
        rows = mentions.withColumn("keyword_hits", F.map_filter(clean, lambda k, v: F.size(v) > 0))
    else:  # the hits' keywords are joined with the list, whatever its length
        rows = mentions.withColumn("_row", F.monotonically_increasing_id())
        listed = languages.select(F.col("text").alias("_keyword"), "language").groupBy("_keyword").agg(F.collect_set("language").alias("_languages"))
        hits = rows.select("_row", F.explode("keyword_hits").alias("_keyword", "_hits")).join(small(listed), "_keyword", "left")
        forms = F.coalesce("_languages", F.array(T.script_language(F.col("_keyword"))))
        good = F.array_distinct(F.flatten(F.transform(forms, lambda x: verify_hits(F.col("_hits"), F.col("_keyword"), x))))
        entry = F.struct("_keyword", F.array_sort(good, lambda a, b: a["start"] - b["start"]).alias("hits"))
        found = hits.select("_row", entry.alias("e")).where("size(e.hits) > 0").groupBy("_row").agg(F.map_from_entries(F.collect_list("e")).alias("_good"))
        empty = F.create_map().cast(dict(mentions.dtypes)["keyword_hits"])
        rows = rows.join(found, "_row", "left").withColumn("keyword_hits", F.coalesce("_good", empty))
    return rows.withColumn("matched_keywords", F.array_sort(F.map_keys("keyword_hits"))).select(*mentions.columns)


def verified_keywords(mentions: DataFrame, active: DataFrame) -> DataFrame:
    """id, keywords: labels in order that are active and have verified hits, in the active list's spelling, each once."""
    names = small(active.select(F.lower("text").alias("fold"), F.col("text").alias("spelling")).dropDuplicates(["fold"]))
    labels = mentions.select("id", F.posexplode("matched_keywords").alias("pos", "label"), "keyword_hits").withColumn("fold", F.lower("label"))
    good = labels.where(F.size(verify_hits(F.coalesce(F.try_element_at("keyword_hits", F.col("label")), F.slice(F.array(F.expr("cast(null as struct<start:int,end:int,excerpt:string,confidence:double,screenshot:string>)")), 1, 0)), F.col("label"), T.script_language(F.col("label")))) > 0)
    first = good.join(names, "fold").withColumn("n", F.row_number().over(Window.partitionBy("id", "fold").orderBy("pos"))).where("n = 1")
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "spelling"))), lambda x: x["spelling"]).alias("keywords"))


def quality_asof(words: Column, spans: Column) -> Column:
    """Each word with the measures of the latest span that began at or before it, if it hasn't ended."""
    def of(w: Column) -> Column:
        span = F.array_max(F.filter(spans, lambda s: s["start"] <= w["start"]))
        ok = w["start"] <= span["end"]
        return F.struct(w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"), F.when(ok, span["avg_logprob"]).alias("avg_logprob"), F.when(ok, span["no_speech_prob"]).alias("no_speech_prob"))

    return F.transform(words, of)


def dedupe_overlap(chunks: Column) -> Column:
    """Segments of overlapping chunks (array<struct<start, segments>> in order): a later chunk begins where the kept ones end."""
    def add(acc: Column, c: Column) -> Column:
        cut = F.greatest(c["start"], F.coalesce(F.array_max(F.transform(acc, lambda s: seg_end(s))), F.lit(-1.0)))
        return F.concat(acc, F.filter(c["segments"], lambda s: (F.size(acc) == 0) | (s["start"] >= cut)))

    empty = F.slice(F.get(chunks, F.lit(0))["segments"], 1, 0)
    return F.aggregate(chunks, empty, add)


def shift_window_times(segments: Column, offset: Column) -> Column:
    """Times of a window as times of its stream."""
    return F.transform(segments, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset))


def transcript_confidence(segments: DataFrame, by: list[str], chunk: str | None = None) -> DataFrame:
    """Mean log probability per key, and how many measures it is of; no measured segment gives null.

    With the column `chunk`, transcripts made in chunks: the plain mean of the chunks' own means, of which there are n.
    """
    if chunk:
        segments = segments.groupBy(*by, chunk).agg(F.avg("avg_logprob").alias("avg_logprob"))
    return segments.groupBy(*by).agg(F.avg("avg_logprob").alias("avg_logprob"), F.count("avg_logprob").alias("n"))


def low_confidence(transcripts: DataFrame, least: float = -0.45) -> DataFrame:
    return transcripts.where(F.try_element_at("confidence", F.lit("avg_logprob")) < least)


def transcription_cost(duration: Column, model: Column) -> Column:
    """Dollars: at least 10 s are paid; large-v3 costs more than its turbo form."""
    rate = F.when(model.contains("large-v3") & ~model.contains("turbo"), 0.111).otherwise(0.04)
    return F.bround(F.greatest(duration.cast("double"), F.lit(10.0)) / 3600 * rate, 6)
