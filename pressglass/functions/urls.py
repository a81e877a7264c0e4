"""URL functions; malformed URLs give null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts of listings, words of story paths, endings of assets.
LISTING_PARTS = "category|categories|tag|tags|author|authors|page|search|login|signup|register|contact|about|privacy|terms|video"
LISTING_ENDS = "live|latest-news|latest|world|opinion|columns|national|international|pakistan|home"
STORY_PARTS = "news|story|article|post|detail|stories"
ASSETS = "css|js|jpg|jpeg|png|gif|svg|pdf|zip|mp4"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)


def url_host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(_part(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def url_path(url: Column) -> Column:
    """Without trailing slashes; / for none."""
    path = F.rtrim(_part(url, r"^(?i:https?)://[^/?#]*([^?#]*)"), F.lit("/"))
    return F.when(path == "", "/").otherwise(path)


def url_origin(url: Column) -> Column:
    return F.nullif(_part(url, r"^((?i:https?)://[^/?#]+)"), F.lit(""))


def absolute_url(href: Column, base: Column) -> Column:
    """href as seen from the page base."""
    folder = F.regexp_extract(base, r"^([^?#]*?//[^/?#]+(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(url_origin(base), href))
        .otherwise(F.concat(folder, href))
    )


def is_article_url(url: Column, listing_url: Column | None = None) -> Column:
    """Whether a link looks like one story: no root, listing or asset; digits, a story word or a long last part."""
    path = url_path(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    no = ~F.coalesce(url, F.lit("")).rlike("^(?i:https?)://") | (path == "/")
    if listing_url is not None:
        other = (bare_host(listing_url) != "") & (bare_host(url) != bare_host(listing_url))
        no |= (F.coalesce(listing_url, F.lit("")) != "") & (other | (path == url_path(listing_url)))
    no |= path.rlike(rf"(?i)/(?:{LISTING_PARTS}|(?:{LISTING_ENDS})/?$)(?:/|$)") | path.rlike(rf"(?i)\.(?:{ASSETS})(?:\?|$)")
    yes = path.rlike(r"/\d{3,}") | path.rlike(rf"(?i)/(?:{STORY_PARTS})/") | ((F.size(parts) >= 2) & (F.length(F.element_at(parts, -1)) >= 16))
    return ~no & yes


def published_in_url(url: Column) -> Column:
    """The date in .../2026/08/17/... or .../2026-08-17/..."""
    got = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d{4}[/-]\d{2}[/-]\d{2})(?:[/-]|$)", 1)
    return F.try_to_date(F.replace(got, F.lit("/"), F.lit("-")), "yyyy-MM-dd")
