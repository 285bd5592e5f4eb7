"""Times, ids, URLs and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filename_title, strip_space

#: Hosts of videos, and the paths that they may have.
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "youtu.be")
#: The language that a code file's extension names.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".rs": "rust", ".go": "go", ".java": "java",
    ".kt": "kotlin", ".swift": "swift", ".rb": "ruby", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "fish", ".ps1": "powershell",
    ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".md": "markdown", ".html": "html", ".css": "css",
    ".scss": "scss", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".lua": "lua", ".dockerfile": "dockerfile", ".tf": "hcl",
}
#: Extensions of video files.
EXTENSION = "(mp4|mkv|webm|mov|m4v|avi)"


def mmss(seconds: Column) -> Column:
    """MM:SS with as many digits of minutes as it takes."""
    whole = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def hms(seconds: Column) -> Column:
    """MM:SS below an hour, H:MM:SS from there on; negative times are 0."""
    whole = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def watch_url(video_id: Column, seconds: Column | None = None) -> Column:
    url = F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)
    return url if seconds is None else F.concat(url, F.lit("&t="), seconds.cast("long").cast("string"), F.lit("s"))


def video_url_ok(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS, most: int = 500) -> Column:
    """Whether a URL is http(s), not too long, on an allowed host, and has a path that the host serves."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    short = path.isin("", "/") | path.rlike(r"\A/[A-Za-z0-9_-]{6,20}/?\z")
    full = path.isin("", "/", "/watch", "/watch/", "/playlist", "/playlist/") | path.rlike(r"\A/(shorts|live|embed)/")
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host.isin(*hosts) & F.when(host == "youtu.be", short).otherwise(full)
    return F.coalesce(ok & (F.char_length(url) <= most), F.lit(False))


def video_id_of(stem: Column) -> Column:
    """The id that a file name's stem is, or that stands in brackets at its end; null without one."""
    found = F.regexp_extract(stem, r"\A([A-Za-z0-9_-]{11})\z|\[([A-Za-z0-9_-]{11})\]\z", 0)
    return F.nullif(F.regexp_replace(found, r"[\[\]]", ""), F.lit(""))


def synthesized_id(name: Column) -> Column:
    """The first 11 characters of the URL-safe base64 of the SHA-256."""
    return F.left(F.translate(F.base64(F.unhex(F.sha2(name, 256))), "+/", "-_"), F.lit(11))


def title_of(stem: Column, fallback: Column) -> Column:
    """A file name's stem without a bracketed id at its end and separators at its ends."""
    clean = F.regexp_replace(F.regexp_replace(stem, r"\[[A-Za-z0-9_-]{11}\]\z", ""), r"\A[ \-_·–—]+|[ \-_·–—]+\z", "")
    return F.coalesce(F.nullif(clean, F.lit("")), fallback)


def language_of(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.when(base.contains("."), F.concat(F.lit("."), F.element_at(F.split(base, r"\."), -1)))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(base.isin("dockerfile", "makefile"), base).otherwise(F.coalesce(F.try_element_at(known, extension), F.lit("")))


def raw_url(blob: Column) -> Column:
    """The raw form of a code host's file URL; null for other URLs."""
    pattern = r"(?i)\Ahttps://github\.com/([\w.-]+)/([\w.-]+)/blob/([^\s)#]+).*"
    return F.when(blob.rlike(pattern), F.regexp_replace(blob, pattern, "https://raw.githubusercontent.com/$1/$2/$3"))


def code_urls(text: Column, most: int = 10) -> Column:
    """File, snippet and repository URLs in that order, each once; a repository only without a file of it."""
    everything = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blobs = everything(r"(?i)https://github\.com/[\w.-]+/[\w.-]+/blob/[^\s)#]+")
    gists = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)https://gist\.github\.com/(?:[\w.-]+/)?([0-9a-f]{6,40})"), F.lit(1)), lambda g: F.concat(F.lit("https://gist.github.com/"), g))
    repos = F.regexp_extract_all(text, F.lit(r"(?i)(https://github\.com/[\w.-]+/[\w.-]+)(?:[/\s)#]|$)"), F.lit(1))
    repos = F.filter(repos, lambda r: ~F.exists(blobs, lambda b: b.startswith(F.concat(r, F.lit("/blob/")))))
    return F.slice(F.array_distinct(F.concat(blobs, gists, repos)), 1, most)


def note_base(ts: Column, title: Column) -> Column:
    """Date, time and the title as file names take it; without a title a space stands between date and time."""
    safe = F.coalesce(filename_title(title), F.lit(""))
    return F.when(safe == "", F.date_format(ts, "yyyy-MM-dd HHmm")).otherwise(F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd-HHmm"), safe))


def folder_name(ts: Column, playlist: Column) -> Column:
    """Date, time and the last non-empty part of a playlist's title between slashes, as file names take it."""
    parts = F.filter(F.transform(F.split(playlist, "/"), strip_space), lambda p: p != "")
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd-HHmm"), F.nullif(filename_title(F.try_element_at(parts, F.lit(-1))), F.lit("")))


def llm_key(*parts: Column) -> Column:
    """The SHA-256 of the parts, each ended by NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x00"))]), 256)


def cost_micros(tokens_in: Column, cache_write: Column, cache_read: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost in millionths: cache writes at 1.25 and reads at 0.10 of the price of input; prices are a million tokens'."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    d = lambda x: F.lit(x).cast("decimal(4,2)")
    cost = n(tokens_in) * price_in + n(cache_write) * price_in * d("1.25") + n(cache_read) * price_in * d("0.10") + n(tokens_out) * price_out
    return F.round(cost, 0).cast("long")


def clip_start(start: Column, end: Column, window: float = 3.5) -> Column:
    """Where a clip of ``window`` seconds around the middle of a range begins; never before 0."""
    return F.greatest(F.lit(0.0), (start + end) / 2 - window / 2)


def synthesis_timeouts(videos: Column, override: Column | None = None, most: int = 600) -> Column:
    """struct(alpha, beta, leader) of seconds: 300 and 60 a video unless ``override`` says otherwise; beta's share is at most ``most``."""
    heavy = (F.lit(300) + 60 * videos) if override is None else F.coalesce(override, F.lit(300) + 60 * videos)
    return F.struct(heavy.alias("alpha"), F.least(heavy, F.lit(most)).alias("beta"), heavy.alias("leader"))
