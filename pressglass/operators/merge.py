"""Merging new rows into stored tables: full outer joins on the key, written to a new version by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.operators.hits import prune_hits
from pressglass.operators.match import distinct_first, new_labels


def _filled(new: Column, old: Column) -> Column:
    """new unless it is blank."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def _over(old: Column, new: Column, kind: str) -> Column:
    """Two maps as one, new winning."""
    none = F.create_map().cast(kind)
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def merge_mentions(existing: DataFrame, new: DataFrame, languages: DataFrame | None = None, base: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged table, and alerts (module, external_id, added: labels that weren't there).

    Key: module, external_id.  New rows without any hit are ignored; others are taken as they are, with the first excerpt (else the title) as snippet.  Rows on
    both sides keep what they have, hits and media merged by keyword (new ones win) and pruned to verified ones; labels
    become the keywords that are left, snippet and links follow the first of them, the section is replaced, and rows
    without a label go.  base: URL column to which times are added for links (default: url).
    """
    key = ["module", "external_id"]
    has_hits = F.exists(F.map_values(F.coalesce("keyword_hits", F.create_map().cast(dict(new.dtypes)["keyword_hits"]))), lambda h: F.size(h) > 0)
    new = distinct_first(new.where(has_hits), key, [F.desc_nulls_last("id")])
    cols = existing.columns
    o, n = existing.alias("o"), new.alias("n")
    same = (F.col("o.module") == F.col("n.module")) & (F.col("o.external_id") == F.col("n.external_id"))
    fresh = n.join(o, same, "left_anti")
    first = F.get(F.flatten(F.map_values("keyword_hits")), F.lit(0))["excerpt"]
    fresh = fresh.withColumn("snippet", F.coalesce(F.nullif(F.col("snippet"), F.lit("")), F.nullif(first, F.lit("")), F.col("title")))
    untouched = o.join(n, same, "left_anti")
    both = o.join(n, same)
    kinds = {f.name: f.dataType.simpleString() for f in existing.schema.fields}
    picked = []
    for c in cols:
        if c in ("keyword_hits", "keyword_media"):
            picked.append(_over(F.col(f"o.{c}"), F.col(f"n.{c}"), kinds[c]).alias(c))
        elif c == "section":
            picked.append(F.coalesce(F.col("n.section"), F.col("o.section")).alias(c))
        else:
            picked.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
    met = both.select(*picked, F.col("o.matched_keywords").alias("_had"))
    had = met.select(*key, "_had")
    pruned = prune_hits(met.select(*cols), languages).where(F.size("matched_keywords") > 0)
    lead = F.get(F.element_at("keyword_hits", F.get("matched_keywords", F.lit(0))), F.lit(0))
    link = F.concat(F.col("url") if base is None else base, F.lit("&t="), lead["start"].cast("string"), F.lit("s"))
    pruned = pruned.withColumn("snippet", F.coalesce(lead["excerpt"], "snippet")).withColumn("deeplink", F.coalesce(link, F.col("deeplink")))
    alerts = pruned.join(had, key).select(*key, new_labels(F.col("_had"), F.col("matched_keywords")).alias("added")).where(F.size("added") > 0)
    alerts = alerts.unionByName(fresh.select(*key, F.col("matched_keywords").alias("added")))
    return untouched.select(*cols).unionByName(fresh.select(*cols)).unionByName(pruned.select(*cols)), alerts


def upsert_keywords(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing (id, text, language, module, active and more) with new (text, language, module): blank ones are ignored.

    A text that a module has, whatever its case, is reactivated and its language repaired by the script: in the row of the right
    language, else in the first one.  All other rows and columns stay as they are.
    """
    from pressglass.functions.text import keyword_language, squash_ws

    clean = new.select(squash_ws(F.col("text")).alias("text"), "language", "module").where("text is not null and text != ''")
    clean = clean.withColumn("language", keyword_language(F.col("text"), F.col("language"))).withColumn("fold", F.lower("text"))
    clean = distinct_first(clean, ["fold", "module"], ["text"])
    right = clean.select("fold", "module", F.col("language").alias("_right"))
    old = existing.withColumn("fold", F.lower("text")).join(right, ["fold", "module"], "left")
    order = [(F.col("language") == F.col("_right")).desc_nulls_last(), F.desc("active"), "id"]
    old = old.withColumn("_n", F.row_number().over(Window.partitionBy("fold", "module").orderBy(*order)))
    met = F.col("_right").isNotNull() & (F.col("_n") == 1)
    repaired = {"language": F.when(met, F.col("_right")).otherwise(F.col("language")), "active": F.when(met, True).otherwise(F.col("active"))}
    kept = old.select(*[repaired.get(c, F.col(c)).alias(c) for c in existing.columns])
    fresh = clean.join(existing.select(F.lower("text").alias("fold"), "module"), ["fold", "module"], "left_anti")
    added = fresh.select("text", "language", "module", F.lit(True).alias("active"))
    return kept.unionByName(added, allowMissingColumns=True)


def upsert_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """By folded name: URL and kind are updated, the source reactivated, or a new one put in."""
    n = distinct_first(new.withColumn("fold", F.lower(F.trim("name"))), ["fold"], [F.desc("url")]).alias("n")
    o = existing.withColumn("fold", F.lower(F.trim("name"))).alias("o")
    joined = o.join(n, F.col("o.fold") == F.col("n.fold"), "full_outer")
    return joined.select(F.coalesce("o.name", "n.name").alias("name"), _filled(F.col("n.url"), F.col("o.url")).alias("url"), _filled(F.col("n.kind"), F.col("o.kind")).alias("kind"), F.coalesce("o.language", "n.language").alias("language"), F.when(F.col("n.name").isNotNull(), True).otherwise(F.col("o.active")).alias("active"))


def upsert_cache(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """By module and external_id: a blank new title or body keeps the old one, missing new values keep the old ones; what
    was fetched again is as of now.  Columns are those of existing."""
    key = ["module", "external_id"]
    o, n = existing.alias("o"), distinct_first(new, key, [F.length("body").desc_nulls_last(), "body"]).alias("n")
    joined = o.join(n, (F.col("o.module") == F.col("n.module")) & (F.col("o.external_id") == F.col("n.external_id")), "full_outer")
    both, kinds = [c for c in existing.columns if c in new.columns], dict(existing.dtypes)
    value = {c: _filled(F.col(f"n.{c}"), F.col(f"o.{c}")) if kinds[c] == "string" else F.coalesce(f"n.{c}", f"o.{c}") for c in both}
    value |= {k: F.coalesce(f"o.{k}", f"n.{k}") for k in key}
    value["fetched_at"] = F.when(F.col("n.external_id").isNotNull(), now).otherwise(F.col("o.fetched_at"))
    return joined.select(*[value.get(c, F.col(f"o.{c}")).alias(c) for c in existing.columns])


def upsert_channels(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """By channel_id: only blanks are filled; a channel that is added again is active."""
    o, n = existing.alias("o"), distinct_first(seed, ["channel_id"], ["name"]).alias("n")
    joined = o.join(n, F.col("o.channel_id") == F.col("n.channel_id"), "full_outer")
    cols = [c for c in existing.columns if c not in ("channel_id", "active")]
    return joined.select(F.coalesce("o.channel_id", "n.channel_id").alias("channel_id"), *[(F.coalesce(F.nullif(F.col(f"o.{c}"), F.lit("")), F.col(f"n.{c}")) if dict(existing.dtypes)[c] == "string" else F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in cols], F.when(F.col("n.channel_id").isNotNull(), True).otherwise(F.col("o.active")).alias("active"))


def missing_slots(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed slots whose channel and time aren't there."""
    return seed.join(existing.select("channel_id", "local_time").distinct(), ["channel_id", "local_time"], "left_anti")


def finalize_transcripts(existing: DataFrame, results: DataFrame) -> DataFrame:
    """Claimed rows filled from results (video_id, text, model, segments and more); rows that stay empty go.
    Rows of the metadata model are marked so, others as transcribed.  Columns are those of existing."""
    o, r = existing.alias("o"), distinct_first(results, ["video_id"], [F.length("text").desc_nulls_last(), "text"]).alias("r")
    joined = o.join(r, F.col("o.video_id") == F.col("r.video_id"), "left")
    value = {c: F.coalesce(f"r.{c}", f"o.{c}") for c in existing.columns if c in results.columns}
    value |= {"video_id": F.col("o.video_id"), "text": _filled(F.col("r.text"), F.col("o.text"))}
    value["transcriber"] = F.when(value["model"] == "metadata", "metadata").otherwise("transcribed")
    names = [*existing.columns, *({"transcriber"} - set(existing.columns))]
    out = joined.select(*[value.get(c, F.col(f"o.{c}")).alias(c) for c in names])
    return out.where(F.coalesce(F.trim("text"), F.lit("")) != "")


def union_results(*parts: DataFrame) -> DataFrame:
    """Cards or mentions of all modules in one schema; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
