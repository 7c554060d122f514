"""Column functions of the library: names, keys, labels, tempo and key arithmetic. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audio suffixes and names that mean nothing is known.
AUDIO = ("mp3", "flac", "wav", "ogg", "oga", "m4a", "aac", "opus", "wma", "aiff", "aif")
NO_NAME = r"(?i)^unknown( artist| album)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the characters' codes."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16_777_619).bitwiseAND(F.lit(4_294_967_295))
    return F.aggregate(F.filter(F.split(_c(c), ""), lambda x: x != ""), F.lit(2_166_136_261).cast("long"), step)


def hour_distance(a, b) -> Column:
    """Hours between two clock hours, the short way round."""
    d = F.abs(_c(a) - _c(b)) % 24
    return F.least(d, 24 - d)


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), r"[\\/]"), -1)


def stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def folder(path) -> Column:
    return F.regexp_replace(_c(path), r"[\\/][^\\/]*$", "")


def is_audio(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./\\]+)$", 1)).isin(*AUDIO)


def is_missing(c) -> Column:
    """Null, blank or a stand-in for an unknown name."""
    return F.coalesce(F.trim(_c(c)), F.lit("")).rlike(NO_NAME) | (F.coalesce(F.trim(_c(c)), F.lit("")) == "")


def initial(c) -> Column:
    """The letter a name is filed under: A to Z, or # for all else."""
    first = F.upper(F.substring(F.trim(F.coalesce(_c(c), F.lit(""))), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def clock(seconds) -> Column:
    """m:ss, or h:mm:ss from an hour on; less than nothing is 0:00."""
    s = F.floor(F.greatest(F.coalesce(_c(seconds), F.lit(0.0)), F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def span(seconds) -> Column:
    """12h 34m, 34m or 12s."""
    s = F.floor(_c(seconds) + 0.5).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm", m)).otherwise(F.format_string("%ds", s))


def ago(then, now: int) -> Column:
    d = F.lit(now) - _c(then)
    unit = lambda n, u: F.concat(F.floor(d / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(d < 60, "just now").when(d < 3600, unit(60, "m")).when(d < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def slot(hour) -> Column:
    h = _c(hour)
    return F.when(h < 5, "night").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 22, "evening").otherwise("night")


def day_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd").cast("long")


def week_key(ts) -> Column:
    """ISO year and week as one number."""
    return (F.extract(F.lit("YEAROFWEEK"), _c(ts)) * 100 + F.weekofyear(_c(ts))).cast("long")


def playback_kind(played, duration, ended) -> Column:
    """What kind of event a finished stretch of listening is."""
    p, d = _c(played), _c(duration)
    return (F.when(_c(ended), "FullPlay").when((d <= 0) & (p >= 30), "FullPlay").when(d <= 0, "SkipMid")
            .when(p / d >= 0.9, "FullPlay").when(p < 15, "SkipEarly").when(p / d < 0.5, "SkipMid").otherwise("SkipLate"))


def version_parts(v) -> Column:
    """Dotted numbers as an array, which compares as versions do: without a suffix after -, without trailing zeros."""
    n = F.transform(F.split(F.substring_index(_c(v), "-", 1), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0)))
    last = F.aggregate(F.transform(n, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(n, F.lit(1), last)


def strip_tags(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), "<[^>]*>", ""))


def seconds_of(c) -> Column:
    """Seconds of s, m:ss or h:mm:ss."""
    return F.aggregate(F.split(_c(c), ":"), F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))


def byte_range(header, total) -> Column:
    """Struct start, end of a bytes= header within total bytes; null if there is none."""
    h, t = F.trim(_c(header)), _c(total).cast("long")
    a, b = (F.regexp_extract(h, r"^bytes=\s*(\d*)\s*-\s*(\d*)\s*$", k).try_cast("long") for k in (1, 2))
    start = F.when(a.isNull(), F.greatest(F.lit(0).cast("long"), t - b)).otherwise(a)
    end = F.when(a.isNull(), t - 1).otherwise(F.least(F.coalesce(b, t - 1), t - 1))
    return F.when((start <= end) & (start < t) & (a.isNotNull() | b.isNotNull()), F.struct(start.alias("start"), end.alias("end")))


def natural_key(c) -> Column:
    """Sorts with numbers by size: every run of digits is padded."""
    padded = F.regexp_replace(F.lower(_c(c)), r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def camelot_distance(a, b) -> Column:
    """0 for the same key, 1 for one that mixes well, more for a clash, 12 for no key."""
    num = lambda c: F.regexp_extract(F.trim(_c(c)), r"^([0-9]+)[ABab]$", 1).try_cast("int")
    ring = lambda c: F.upper(F.right(F.trim(_c(c)), F.lit(1)))
    d = F.pmod(num(a) - num(b), F.lit(12))
    wheel, same = F.least(d, 12 - d), ring(a) == ring(b)
    ok = num(a).between(1, 12) & num(b).between(1, 12)
    return F.when(~F.coalesce(ok, F.lit(False)), 12).when(wheel == 0, F.when(same, 0).otherwise(1)).otherwise(wheel + F.when(same, 0).otherwise(2)).cast("int")


# What a suffix is served as, pages that search lyrics, and what an XML text escapes.
MIME = {"mp3": "audio/mpeg", "flac": "audio/flac", "wav": "audio/wav", "ogg": "audio/ogg", "oga": "audio/ogg", "opus": "audio/opus", "m4a": "audio/mp4", "mp4": "audio/mp4", "aac": "audio/mp4", "aiff": "audio/aiff", "aif": "audio/aiff"}
LYRICS = {"genius": "https://genius.com/search?q=", "musixmatch": "https://www.musixmatch.com/search/", "azlyrics": "https://search.azlyrics.com/search.php?q=", "google": "https://www.google.com/search?q="}
XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}


def content_type(suffix) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.element_at(kinds, F.lower(_c(suffix))), F.lit("application/octet-stream"))


def capitalised(c) -> Column:
    """Every word with a capital first letter; the other letters stay."""
    return F.array_join(F.transform(F.split(_c(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000_000))), " ")


def token(path) -> Column:
    """A stable name for a path: the md5 of it in hex."""
    return F.md5(_c(path))


def tree_path(uri) -> Column:
    """The folder that a tree address of the primary volume stands for; null on another volume or for another address."""
    doc = F.url_decode(F.nullif(F.regexp_extract(_c(uri), r"/tree/([^/]+)", 1), F.lit("")))
    at = F.instr(doc, ":")
    return F.when(F.substring_index(doc, ":", 1) == "primary", F.when(at > 0, F.substr(doc, at + 1)).otherwise(""))


def encoded(c) -> Column:
    """Percent-encoded as a part of an address, with %20 for a space."""
    out = F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))
    for a, b in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lyrics_url(provider: str, artist, title) -> Column:
    q = F.trim(F.concat(F.when(F.coalesce(_c(artist), F.lit("")) == "Unknown artist", "").otherwise(F.coalesce(_c(artist), F.lit(""))), F.lit(" "), F.coalesce(_c(title), F.lit(""))))
    return F.concat(F.lit(LYRICS[provider]), encoded(F.concat(q, F.lit(" lyrics")) if provider == "google" else q))


def url_host(url) -> Column:
    """host:port of an address."""
    c = _c(url)
    return F.substring_index(F.when(F.instr(c, "://") > 0, F.get(F.split(c, "://", 3), F.lit(1))).otherwise(c), "/", 1)


def joined_url(base, path) -> Column:
    """A path, as it is or from the root of base's host."""
    b, p = _c(base), _c(path)
    root = F.concat(F.substring_index(b, "://", 1), F.lit("://"), F.substring_index(F.get(F.split(b, "://", 2), F.lit(1)), "/", 1))
    return F.when(p.rlike("^https?://") | (F.instr(b, "://") == 0), p).when(F.startswith(p, F.lit("/")), F.concat(root, p)).otherwise(F.concat(root, F.lit("/"), p))


def header_value(text, name: str) -> Column:
    """The value of the first header line of that name, in whatever case; null if there is none."""
    lines = F.filter(F.split(_c(text), "\r?\n"), lambda x: (F.instr(x, ":") > 0) & (F.lower(F.trim(F.substring_index(x, ":", 1))) == name.lower()))
    first = F.get(lines, F.lit(0))
    return F.trim(F.substr(first, F.instr(first, ":") + 1))


def tag_text(xml, tag: str) -> Column:
    """The text of the first element of that name without attributes; null if there is none."""
    return F.when(_c(xml).rlike(f"(?s)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(_c(xml), f"(?s)<{tag}>(.*?)</{tag}>", 1)))


def escaped_xml(c) -> Column:
    out = _c(c)
    for a, b in XML.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescaped_xml(c) -> Column:
    out = F.replace(_c(c), F.lit("&#39;"), F.lit("'"))
    for a, b in reversed(XML.items()):
        out = F.replace(out, F.lit(b), F.lit(a))
    return out


def path_parts(c) -> Column:
    """The folders of a path with either slash."""
    return F.filter(F.split(F.replace(_c(c), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
