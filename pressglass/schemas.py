"""Schemas of the content tables, as Spark DDL."""

_TIME = "timestamp"
HIT = "struct<start:int,end:int,excerpt:string,confidence:double,screenshot:string>"
SEGMENT = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>"
BOX = "struct<l:double,t:double,r:double,b:double>"

KEYWORDS = f"id long, text string, language string, module string, active boolean, created_at {_TIME}"
MENTIONS = (
    "id long, module string, external_id string, source string, section string, title string, url string, deeplink string, snippet string, "
    f"published_at {_TIME}, detected_at {_TIME}, matched_keywords array<string>, keyword_media map<string,string>, "
    f"keyword_hits map<string,array<{HIT}>>, screenshot_path string, full_screenshot_path string, sentiment string"
)
ARTICLE_CACHE = f"module string, external_id string, title string, url string, body string, published_at {_TIME}, fetched_at {_TIME}"
EDITION_PAGES = f"paper string, city string, date string, page_no int, image_url string, image_path string, regions array<struct<box:{BOX},text:string,detail_url:string>>, text string"
CHANNELS = "channel_id string, name string, handle string, tz string, uploads_playlist string, media_source string, media_source_config map<string,string>, active boolean"
SLOTS = "slot_id long, channel_id string, local_time string, label string, title_rules array<string>, min_duration_sec int, max_duration_sec int, enabled boolean, effective_from string, effective_to string"
CANDIDATE = "struct<video_id:string,title:string,score:double,reasons:array<string>,duration:int,published:string>"
BULLETINS = f"bulletin_id long, channel_id string, slot_id long, slot_date string, video_id string, score double, discovery_status string, transcription_status string, attempts int, candidates array<{CANDIDATE}>"
TRANSCRIPTS = f"video_id string, channel_id string, bulletin_id long, transcriber string, model string, language string, text string, segments array<{SEGMENT}>, confidence map<string,double>, created_at {_TIME}"
NEWS_SOURCES = "name string, url string, kind string, language string, active boolean"
SCRAPE_RUNS = f"module string, started_at {_TIME}, finished_at {_TIME}, status string, found int, detail string"
UPLOADS = f"video_id string, channel_id string, title string, description string, published timestamp, duration_seconds int, live boolean, url string"
TICKER = "stream_id string, t int, text string"
CONTENT = {"article": ARTICLE_CACHE, "page": EDITION_PAGES, "transcript": TRANSCRIPTS}
