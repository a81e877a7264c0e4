"""The same rules on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.operators.match import found, keyword_fingerprint, listed, prepared
from pressglass.sizes import small

CATCH_UP = "4 days"


def stream_matches(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keyword, language as documents come: static watchlist of any length, every match once (append).

    A watchlist of up to PLAN_KEYWORDS keywords stands in the plan, and each text is matched within its row.  Of a longer one: a text's distinct words and signs meet the keywords that they lead (by their longest one) in a join with the static watchlist;
    single words are sure then, a phrase is sought between spaces among the text's words and signs, one glued to signs by its
    pattern.  Nothing is aggregated, so no state is kept.
    """
    rows = listed(keywords)
    if rows is not None:
        return docs.select(id_col, F.explode(found(T.composed(F.coalesce(text_col, F.lit(""))), rows)).alias("m")).select(id_col, "m.*")
    lead = F.aggregate("tokens", F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    sure = (F.size("tokens") == 1) & F.get("tokens", F.lit(0)).rlike(T.WORD)
    entries = prepared(keywords).select("keyword", "language", "form", "pattern", "plain", lead.alias("lead"), sure.alias("sure"), F.concat(F.lit(" "), "normal", F.lit(" ")).alias("padded"))
    kinds = [r[0] for r in entries.select("form").distinct().collect()]
    if not kinds:
        return docs.select(id_col, F.lit("").alias("keyword"), F.lit("").alias("language")).where("false")
    text = docs.select(id_col, T.composed(F.coalesce(text_col, F.lit(""))).alias("_text"))
    forms = text.select(id_col, F.explode(F.array(*[F.struct(F.lit(k).alias("form"), T.normalize_text(F.col("_text"), k, compose=False).alias("n")) for k in kinds])).alias("f"))
    forms = forms.select(id_col, "f.form", "f.n", F.explode(F.array(T.signs_and_words(F.col("f.n")))).alias("t"))
    rows = forms.select(id_col, "form", "n", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("joined"), F.explode(F.array_distinct("t")).alias("lead"))
    met = rows.join(small(entries), ["form", "lead"])
    holds = F.when(F.col("sure"), True).when(F.col("plain") & (F.length("padded") > 3), F.contains("joined", F.col("padded"))).otherwise(F.rlike("n", F.col("pattern")))
    return met.where(holds).select(id_col, "keyword", "language")


def stream_ticker_events(stream: DataFrame, gap_seconds: int = 20, by: tuple[str, ...] = ("stream_id", "keyword"), time: str = "ts", late: str = CATCH_UP) -> DataFrame:
    """Events (by, first): sessions whose matches lie under gap_seconds apart; times in whole seconds.
    Sessions merge at a distance equal to their gap, so the gap is a second shorter."""
    return stream.withWatermark(time, late).groupBy(*by, F.session_window(time, f"{gap_seconds - 1} seconds")).agg(F.min(time).alias("first")).select(*by, "first")


def stream_dedupe(stream: DataFrame, key: list[str], time: str = "ts", ttl: str = "3600 seconds") -> DataFrame:
    """The first row of a key within ttl."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


def stream_rematch_gate(keywords: DataFrame, last: Callable[[], str | None], keep: Callable[[str], None], work: Callable[[DataFrame, int], None], targeted: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: does its work only if the watchlist changed since it was last done, or if asked for specially."""

    def run(batch: DataFrame, batch_id: int) -> None:
        mark = keyword_fingerprint(keywords).first()[0]
        if targeted or mark != last():
            work(batch, batch_id)
            keep(mark)

    return run
