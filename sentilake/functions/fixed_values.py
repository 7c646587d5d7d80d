"""Fixed values that results depend on: word lists, domains, weights and limits."""

# Query keys that only track where a visitor came from.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "si", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_name", "utm_source", "utm_term")

# What makes a link low in value.
LOW_VALUE_PATTERNS = ("/login", "/signup", "/privacy", "/terms", "/share", "/intent/", "/sharer")
LOW_VALUE_DOMAINS = ("duckduckgo.com", "bing.com", "search.yahoo.com", "accounts.google.com", "news.google.com")
LOW_VALUE_PATHS = ("/search", "/topics/", "/home")
LOW_SIGNAL_KEYS = ("ia", "iax", "iaxm", "assist", "ceid", "hl", "gl")
LOW_SIGNAL_TITLES = ("all", "images", "videos", "news", "maps", "home", "sign in", "search assist", "duck.ai", "learn more")
ASSET_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".css", ".js")

# Terms that show opinion, and terms that show plain information.
EVIDENCE_TERMS = ("opinion", "reaction", "react", "debate", "support", "oppose", "critic", "criticism", "praise", "concern", "comment", "comments", "discussion", "thread", "public sentiment")
NEUTRAL_TERMS = ("date", "calendar", "time and date", "holiday list", "office holidays")

# Platforms by the end of their domains, in order of precedence.
PLATFORM_DOMAINS = (
    ("reddit", ("reddit.com",)), ("x", ("x.com", "twitter.com")), ("facebook", ("facebook.com", "fb.com")), ("instagram", ("instagram.com",)),
    ("youtube", ("youtube.com", "youtu.be")), ("tiktok", ("tiktok.com",)), ("news", ("news.google.com",)), ("wiki", ("wikipedia.org", "wikidata.org", "wikimedia.org")),
    ("hackernews", ("news.ycombinator.com",)), ("bluesky", ("bsky.app",)), ("medium", ("medium.com",)), ("substack", ("substack.com",)),
)
NEWS_KEYWORDS = ("news", "post", "times", "herald", "journal", "tribune", "republic", "republica", "khabar", "kantipur", "himalayan", "aljazeera", "bbc", "npr", "livemint", "economictimes")

# What a hint may call a platform, and a target's platform by what its host contains, in order.
PLATFORM_ALIASES = (
    ("reddit", ("reddit", "subreddit", "r/")), ("x", ("twitter", "x", "tweet", "hashtag")), ("facebook", ("facebook", "fb")), ("instagram", ("instagram", "insta")), ("youtube", ("youtube", "yt", "video")),
    ("tiktok", ("tiktok",)), ("wiki", ("wikipedia", "wiki", "wikidata")), ("news_site", ("news site", "news", "editorial", "article", "newspaper")),
)
TARGET_DOMAINS = (
    ("reddit", ("reddit.com",)), ("bluesky", ("bsky.app", "bsky.social")), ("x", ("x.com", "twitter.com")), ("facebook", ("facebook.com", "fb.com")), ("instagram", ("instagram.com",)),
    ("youtube", ("youtube.com", "youtu.be")), ("hackernews", ("news.ycombinator.com",)), ("tiktok", ("tiktok.com",)),
)

# Names of sources and what else they are called, those that need a key, and the most results of a query.
SOURCE_ALIASES = (
    ("serper", ("serper", "search", "web", "news", "social", "reddit", "twitter", "x", "facebook", "youtube")), ("firecrawl_search", ("firecrawl_search", "firecrawl", "firecrawl-news")),
    ("firecrawl_browser", ("firecrawl_browser", "browser", "rendered_browser")), ("camoufox_browser", ("camoufox_browser", "camoufox", "camoufox_rendered")),
    ("camoufox_agentic", ("camoufox_agentic", "agentic_browser", "agentic_camoufox")), ("serpapi", ("serpapi",)),
)
KEYED_SOURCES = ("firecrawl", "firecrawl_search", "crawlbase", "serpapi")
PER_QUERY = 25

# Sources that are browsers, ends of search engines' domains, beginnings of addresses that lead nowhere.
BROWSER_SOURCES = ("camoufox_browser", "camoufox_agentic")
SEARCH_ENGINES = ("google.com", "google.com.np", "accounts.google.com", "duckduckgo.com", "bing.com", "yahoo.com", "news.google.com")
NO_ADDRESSES = ("mailto:", "tel:", "javascript:", "#")

# What makes a link of a browser's page low in signal, and what a page says that shows opinion.
BROWSER_KEYS, SEARCH_HOSTS = ("&ia=", "&iax=", "&iaxm=", "assist="), ("duckduckgo.com", "google.com/search", "bing.com/search")
SIGN_IN_PATHS = ("/servicelogin", "/signin", "/sign-in", "/accounts/")
BROWSER_TITLES = ("all", "images", "videos", "news", "maps", "home", "sign in")
BROWSER_EVIDENCE = ("opinion", "reaction", "debate", "support", "oppose", "concern", "praise", "critic", "comment", "discussion", "review")
CRAWL_PAGES, CRAWL_HOPS, CRAWL_LINKS, CRAWL_QUALITY, CRAWL_RELEVANCE = 10, 2, 12, 0.5, 0.35

# Backends to fetch a platform's pages with, in order.
BACKENDS = {
    "reddit": ("reddit_json", "generic_http", "firecrawl", "camoufox", "crawlbase"),
    "bluesky": ("bluesky_public", "firecrawl", "camoufox", "generic_http", "crawlbase"),
    "youtube": ("youtube_oembed", "generic_http", "firecrawl", "crawlbase", "camoufox"),
    "hackernews": ("hackernews_api", "generic_http", "firecrawl", "crawlbase", "camoufox"),
    "rss": ("rss_feed", "generic_http", "firecrawl", "crawlbase"),
    "facebook": ("firecrawl", "camoufox", "generic_http", "crawlbase"),
    "instagram": ("firecrawl", "camoufox", "generic_http", "crawlbase"),
    "tiktok": ("firecrawl", "camoufox", "generic_http", "crawlbase"),
    "x": ("firecrawl", "camoufox", "generic_http", "crawlbase"),
    "web": ("generic_http", "firecrawl", "crawlbase", "camoufox"),
}
NATIVE_BACKENDS = ("reddit_json", "bluesky_public", "youtube_oembed", "hackernews_api", "rss_feed")

# Words of the lexicon scorer, and of the one that recovers failures.
POSITIVE_WORDS = ("love", "great", "amazing", "excellent", "good", "wonderful", "fantastic", "awesome", "happy", "best", "perfect", "beautiful", "brilliant", "outstanding", "superb", "delightful", "joy")
NEGATIVE_WORDS = ("hate", "terrible", "awful", "bad", "worst", "horrible", "disgusting", "poor", "disappointing", "sad", "angry", "ugly", "boring", "annoying", "frustrating", "useless", "broken")
RECOVERY_POSITIVE = ("good", "great", "excellent", "love", "best", "amazing", "happy")
RECOVERY_NEGATIVE = ("bad", "terrible", "worst", "hate", "awful", "sad", "angry")

# Contractions in the order in which they are expanded, and boilerplate to remove.
CONTRACTIONS = (("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"))
NOISE_PATTERNS = ("cookie(s)?\\s+policy", "accept\\s+all\\s+cookies", "sign\\s+in\\s+to\\s+continue", "subscribe\\s+for\\s+more", "javascript\\s+is\\s+disabled")

# Keys under which a payload may hold its date, in order.
DATE_KEYS = ("published_at", "publishedAt", "published", "date", "datetime", "pubDate", "publication_date", "published_date", "article_date", "created_at", "createdAt", "created", "timestamp", "unix_timestamp", "epoch", "time")

# What a key holds that speaks of a time.
DATE_TOKENS = ("date", "time", "published", "created", "timestamp")

# Names of pictures that differ from the characters' own.
PICTURE_NAMES = {
    "\U0001f621": "enraged face", "\U0001f620": "angry face", "\U0001f602": "face with tears of joy", "\u2764": "red heart", "\U0001f44d": "thumbs up", "\U0001f44e": "thumbs down",
    "\U0001f60a": "smiling face with smiling eyes", "\U0001f622": "crying face", "\U0001f62d": "loudly crying face", "\U0001f525": "fire", "\U0001f64f": "folded hands", "\U0001f44f": "clapping hands",
}

# Words that are no phrase to search for, and what follows a topic in the default ones.
NO_PHRASES = ("here", "are", "useful", "search", "queries", "query")
DEFAULT_ENDS = ("", " public sentiment", " Nepal reactions")

# Result pages by what a platform's name contains, in order, and those of all others.
ANY_SEARCH_PAGES = ("https://duckduckgo.com/?q=", "https://www.bing.com/search?q=")
SEARCH_PAGES = {
    "reddit": ("https://www.reddit.com/search/?q=",),
    "youtube": ("https://www.youtube.com/results?search_query=", "https://duckduckgo.com/?q=site%3Ayoutube.com+"),
    "facebook": ("https://duckduckgo.com/?q=site%3Afacebook.com+",),
    "instagram": ("https://duckduckgo.com/?q=site%3Ainstagram.com+",),
}

# Metadata keys that hold an item's address, in order, and those that are metrics.
ADDRESS_KEYS = ("url", "link", "permalink", "story_url")
METRICS = ("score", "num_comments", "reply_count", "repost_count", "like_count", "quote_count", "descendants", "upvote_ratio")

# Elements whose text is no part of a page's, those that may hold its main text, in order, and its paragraphs.
DROPPED_TAGS = ("script", "style", "noscript", "svg", "nav", "footer", "header")
CONTENT_TAGS = ("article", "main", "section", "body")
BLOCK_TAGS = ("p", "li", "blockquote")
MIN_MAIN_TEXT, MIN_PARAGRAPH, MAX_PARAGRAPHS = 200, 30, 80

# Names of places, and the metas that have them.
GEO_METAS = (("latitude", "place:location:latitude"), ("longitude", "place:location:longitude"), ("region", "geo.region"), ("placename", "geo.placename"), ("locale", "og:locale"))

# What a session can be, its phases in order, and from where it starts.
IDLE, WAITING, COMPLETED, FAILED = "idle", "clarification_needed", "completed", "error"
PHASES = ("planning", "searching", "scraping", "cleaning", "analysing")
STARTS_FROM = ("idle", "error", "completed")

# Limits and thresholds.
SCORED_CHARS = 4000
MIN_QUALITY, MAX_LINKS, REUSE_DAYS, MAX_TARGETS = 0.35, 1000, 7, 250
MIN_CHARS, MAX_CHARS, MIN_ALPHA, MAX_URL, MAX_SYMBOL = 30, 12_000, 0.35, 0.3, 0.35
POSITIVE_FROM, NEGATIVE_TO, CONTEXT_WEIGHT, RECOVERY_BUDGET = 0.6, 0.4, 0.3, 10
