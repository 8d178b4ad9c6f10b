"""URLs: parsing, the normal form that identifies a page, shapes that tell what a URL is for, priorities.

Absolute http(s) URLs and root-relative references of plain ASCII are handled by built-in functions; what else there is
(relative paths, dot segments, percent signs, other letters, odd hosts) goes to an Arrow function, which sees nulls for the rest.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.js import WORD_END

# Fixed values.
TRACKING_PREFIXES = ("utm_", "mc_", "ga_")
#: trkCampaign is compared with a lower-case name, and so never dropped.
TRACKING_NAMES = ("fbclid", "gclid", "gclsrc", "dclid", "msclkid", "igshid", "mkt_tok", "ref", "ref_src", "referrer", "_hsenc", "_hsmi", "trk", "trkCampaign", "spm", "si")
ASSET_EXTENSIONS = (
    ".png .jpg .jpeg .gif .svg .webp .ico .bmp .pdf .zip .tar .gz .rar .7z .mp4 .mp3 .mov .avi .webm .wav "
    ".woff .woff2 .ttf .eot .css .js .json .xml .csv .doc .docx .xls .xlsx .ppt .pptx"
).split()
# Fixed values, in their order: what a path holds behind a slash, in either case; \b is the end of a word.
AUTH_PATHS = (r"logout\b", r"sign[-_]?out\b", r"login\b", r"sign[-_]?in\b", r"sign[-_]?up\b", r"register\b", r"account/(?:password|reset|delete)", r"wp-admin\b", r"wp-login")
UTILITY_PATHS = (r"cart\b", r"checkout\b", r"cookies?-policy", r"privacy(?:-policy)?\b", r"terms\b", r"legal\b", r"unsubscribe\b", r"search\b", r"print\b")
AUTH, UTILITY = (f"(?i)/(?:{'|'.join(paths)})".replace(r"\b", WORD_END) for paths in (AUTH_PATHS, UTILITY_PATHS))
SEARCH = f"(?i)/search{WORD_END}"
PRIORITIES = (
    (r"^/\z", 30),
    (r"^/(?:docs?|documentation)(?:/|\z)", 22),
    (r"^/(?:guides?|tutorials?)(?:/|\z)", 20),
    (r"^/(?:getting-started|quickstart|quick-start)(?:/|\z)", 22),
    (r"^/(?:api|reference)(?:/|\z)", 20),
    (r"^/(?:product|features?)(?:/|\z)", 14),
    (r"^/pricing(?:/|\z)", 12),
    (r"^/(?:about|company)(?:/|\z)", 10),
    (r"^/(?:help|support|faq)(?:/|\z)", 12),
    (r"^/(?:resources?|changelog|release-notes)(?:/|\z)", 10),
    (r"^/blog(?:/|\z)", 8),
    (r"^/(?:login|signin|sign-in|signup|sign-up|register|logout|sign-out)(?:/|\z)", -30),
    (r"^/(?:cart|checkout)(?:/|\z)", -25),
    (r"^/(?:cookies?|privacy|terms|legal)(?:/|\z)", -20),
    (r"^/account(?:/|\z)", -15),
    (r"^/search(?:/|\z)", -15),
    (r"/page/[0-9]+/?\z", -20),
)

# --- built-in functions --------------------------------------------------------------------------------------------------------

_PAIR = r"[A-Za-z0-9._*-]*(?:=[A-Za-z0-9._*-]*)?"
PLAIN = rf"^(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]{{1,4}})?(?:/[A-Za-z0-9._~!$&()*+,;=:@/-]*)?(?:\?{_PAIR}(?:&{_PAIR})*)?(?:#[^\s]*)?\z"
#: Dot segments, and hosts that end in a number or in strange places.
ODD = r"/\.{1,2}(?:[/?#]|\z)|^(?i:https?)://(?:[^/?#:]*\.)?(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?(?:[:/?#]|\z)|^(?i:https?)://(?:[.-]|[^/?#:]*\.\.)|(?i)xn--"


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):([0-9]*)", 1)


def path(url: Column) -> Column:
    """The path of an absolute http(s) URL; / where it has none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column) -> Column:
    q = query(url)
    return F.concat(path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def is_plain(url: Column) -> Column:
    return url.rlike(PLAIN) & ~url.rlike(ODD)


def _port_part(scheme: Column, p: Column) -> Column:
    n = F.regexp_replace(p, "^0+(?=[0-9])", "")
    default = ((scheme == "http") & (n == "80")) | ((scheme == "https") & (n == "443"))
    return F.when((n == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), n))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case; null for what is no plain URL. The www. stays."""
    scheme = protocol(url)
    return F.when(is_plain(url), F.concat(scheme, F.lit("://"), host(url), _port_part(scheme, port(url))))


def tracking(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*TRACKING_NAMES) | low.rlike(f"^(?:{'|'.join(TRACKING_PREFIXES)})")


def _sort_key(name: Column) -> Column:
    """Names sort as in a locale: punctuation, digits, letters; a before A before b."""
    return F.translate(F.lower(name), "_-.*", "\u0001\u0002\u0003\u0004")


def _plain_query(q: Column) -> Column:
    pairs = F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("name"), F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))).alias("pair"), i.alias("i")))
    kept = F.filter(pairs, lambda x: ~tracking(x["name"]))
    keyed = F.transform(kept, lambda x: F.struct(_sort_key(x["name"]).alias("key"), F.transform(F.split(x["name"], ""), lambda c: c != F.lower(c)).alias("upper"), x["i"].alias("i"), x["pair"].alias("pair")))
    text = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["pair"]), "&")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


def _plain_normal(url: Column) -> Column:
    scheme, p = protocol(url), path(url)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/+\z", ""))
    return F.concat(scheme, F.lit("://"), host(url), _port_part(scheme, port(url)), F.when(p == "", F.lit("/")).otherwise(p), _plain_query(query(url)))


#: References that say the same from every page of an origin: with a slash or a scheme and two slashes at their start.
FIXED = r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*://)"


def absolute(raw: Column, at: Column) -> Column:
    """A root-relative reference with the origin before it; others, and all where the origin is null, as they are."""
    return F.when(raw.rlike(r"^/(?![/\\])") & at.isNotNull(), F.concat(at, raw)).otherwise(raw)


def normalized(raw: Column, base: Column | None = None, odd: bool = True, ref: Column | None = None) -> Column:
    """The normal form of a reference, seen from a base URL; null where it is no page. odd: whether odd references go to the Arrow
    function; without it they are null. ref: absolute(raw, origin(base)), where it is a column already."""
    if ref is None:
        ref = absolute(raw, origin(base)) if base is not None else raw
    plain = is_plain(ref)
    native = F.when(plain, _plain_normal(ref))
    if not odd:
        return native
    other = F.when(~plain, raw)
    return F.coalesce(native, normalize_odd(other, F.when(other.isNotNull(), base if base is not None else F.lit(None).cast("string"))))


def _without_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def same_site(url: Column, site: Column) -> Column:
    return _without_www(host(url)) == _without_www(host(site))


def display_host(url: Column) -> Column:
    """The host without www., or the text itself where there is none."""
    h = host(url)
    return F.when(h == "", url).otherwise(_without_www(h))


def is_asset(url: Column) -> Column:
    """By the extension, from the last dot of the path on; true for what is no URL."""
    return (host(url) == "") | F.lower(F.regexp_extract(path(url), r"(\.[^.]*)\z", 1)).isin(*ASSET_EXTENSIONS)


def _has(url: Column, name: str) -> Column:
    return query(url).rlike(f"(?:^|&){name}(?:=|&|\\z)")


def _value(url: Column, name: str) -> Column:
    return F.regexp_extract(query(url), f"(?:^|&){name}=([^&]*)", 1)


def looks_auth(url: Column) -> Column:
    return path(url).rlike(AUTH)


def looks_utility(url: Column) -> Column:
    return path(url).rlike(UTILITY)


def looks_search(url: Column) -> Column:
    return path(url).rlike(SEARCH) | _has(url, "q") | _has(url, "query")


def looks_paged(url: Column) -> Column:
    """A /page/N path, page or else p above 1, or any numeric offset or start."""
    number = F.when(_has(url, "page"), _value(url, "page")).otherwise(_value(url, "p"))
    later = number.rlike(r"^[0-9]+\z") & ~number.rlike(r"^0*1?\z")
    return path(url).rlike(r"(?i)/page/[0-9]+/?\z") | later | _value(url, "offset").rlike(r"^[0-9]+\z") | _value(url, "start").rlike(r"^[0-9]+\z")


def exclusion_reason(url: Column, allowed: Column) -> Column:
    """Why a URL is not fetched, by the first rule that holds; null where it is. allowed: what robots.txt says."""
    return (
        F.when(~F.coalesce(allowed, F.lit(True)), "excluded-by-robots")
        .when(looks_auth(url), "auth")
        .when(looks_search(url), "search-results")
        .when(looks_paged(url), "pagination")
        .when(looks_utility(url), "low-priority-utility")
    )


def discovery_priority(url: Column, depth: Column, sitemap_priority: Column) -> Column:
    """The sum of all weights whose pattern the path meets, ten times the sitemap's priority, less three for each level."""
    p = path(url)
    hits = reduce(lambda a, b: a + b, (F.when(p.rlike(rule), F.lit(float(w))).otherwise(0.0) for rule, w in PRIORITIES))
    said = F.when(F.isnan(sitemap_priority) | sitemap_priority.isNull(), 0.0).otherwise(sitemap_priority)
    return hits + said * 10.0 - depth * 3.0


def markdown_candidates(url: Column) -> Column:
    """Where a page's Markdown may be: its path with .md, and with .md in place of an extension."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    p = path(url)
    added = F.concat(head, F.when(p == "/", F.lit("/index.md")).otherwise(F.concat(p, F.lit(".md"))))
    swapped = F.when(p.rlike(r"\.[A-Za-z0-9_]+\z") & ~p.endswith(".md"), F.concat(head, F.regexp_replace(p, r"\.[A-Za-z0-9_]+\z", ".md")))
    return F.when(head != "", F.array_compact(F.array(added, swapped))).otherwise(F.array().cast("array<string>"))


def is_home(url: Column, site: Column) -> Column:
    return F.coalesce((origin(url) == site) & (path(url) == "/"), F.lit(False))


def checked_input(raw: Column) -> Column:
    """A user's URL: struct of ok, base_url, origin, error."""
    t = F.trim(raw)
    site, scheme = origin(t), protocol(t)
    p = path(t)
    base = F.concat(site, p, F.regexp_extract(t, r"(\?[^#]*)", 1), F.regexp_extract(t, r"(#.*)\z", 1))
    bad = F.lit("That doesn't look like a valid URL. Try something like https://example.com.")
    error = F.when(scheme == "", bad).when(~scheme.isin("http", "https"), F.lit("Only http:// and https:// URLs are supported.")).when(site.isNull(), bad)
    ok = error.isNull()
    return F.struct(ok.alias("ok"), F.when(ok, base).alias("base_url"), F.when(ok, site).alias("origin"), error.alias("error"))


def completed(raw: Column) -> Column:
    """What a user typed, with https:// where no scheme was given."""
    t = F.trim(raw)
    return F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


# --- everything else, by the URL standard --------------------------------------------------------------------------------------

_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_KEEP = {"path": set("!$%&'()*+,-./:;=@_~[]|\\^") - set("\\"), "query": set("!$%&()*+,-./:;=?@_~[]|\\^`{}"), "fragment": set("!#$%&'()*+,-./:;=?@_~[]|\\^{}")}
_HOST_BAD = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")


def _escaped(s: str, part: str) -> str:
    keep = _KEEP[part]
    return "".join(c if c.isascii() and (c.isalnum() or c in keep) else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def _number(x: str) -> int | None:
    try:
        return int(x[2:] or "0", 16) if x[:2] in ("0x", "0X") else int(x, 8) if len(x) > 1 and x[0] == "0" else int(x)
    except ValueError:
        return None


def parse_host(raw: str) -> str | None:
    """A special scheme's host in its normal form, or null."""
    if raw.startswith("["):
        return raw.lower() if re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", raw) else None
    h = unquote_to_bytes(raw).decode("utf-8", "replace").lower().replace("。", ".")
    if not h.isascii():
        try:
            h = ".".join(x if x.isascii() else x.encode("idna").decode() for x in h.split("."))
        except UnicodeError:
            return None
    if not h or _HOST_BAD.search(h):
        return None
    labels = h[:-1].split(".") if h.endswith(".") else h.split(".")
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", labels[-1]):
        numbers = [_number(x) if x else None for x in labels]
        if len(labels) > 4 or None in numbers or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(x << 8 * (3 - i) for i, x in enumerate(numbers[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return h


def _walk(path_text: str) -> str:
    out: list[str] = []
    parts = path_text.split("/")
    for i, x in enumerate(parts):
        low, last = x.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            del out[-1:]
        elif low != ".":
            out.append(x)
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


def parse(raw: str, base: dict | None = None) -> dict | None:
    """Parts of an absolute URL, or of a reference seen from a base: scheme, host, port, path, query, fragment."""
    s = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", s)
    scheme = m[1].lower() if m else None
    rest = s[m.end() :] if m else s
    if scheme and scheme not in _PORTS:
        if not rest.startswith("//"):
            return {"scheme": scheme, "host": None, "port": "", "path": rest, "query": None, "fragment": None}
        m = re.match(r"//([^/?#]*)", rest)
        return {"scheme": scheme, "host": m[1], "port": "", "path": rest[m.end() :], "query": None, "fragment": None}
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query_text = rest.partition("?")
    rest = rest.replace("\\", "/")
    out = {"query": _escaped(query_text, "query") if mark else None, "fragment": _escaped(fragment, "fragment") if hash_ else None}
    if scheme and (base is None or scheme != base["scheme"] or rest.startswith("//")) or base is not None and not scheme and rest.startswith("//"):
        authority, slash, tail = rest.lstrip("/").partition("/")
        hostport = authority.rpartition("@")[2]
        m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", hostport)
        h = parse_host(m[1]) if m else None
        scheme = scheme or base["scheme"]
        number = (m[2] or "").lstrip("0") or ("0" if m and m[2] else "") if m else ""
        if h is None or number and int(number) > 65535:
            return None
        return out | {"scheme": scheme, "host": h, "port": "" if number == _PORTS[scheme] else number, "path": _walk(_escaped(tail, "path")) if slash else "/"}
    if base is None or base["host"] is None:
        return None
    out = {k: base[k] for k in ("scheme", "host", "port")} | out
    if rest.startswith("/"):
        return out | {"path": _walk(_escaped(rest[1:], "path"))}
    if not rest:
        return out | {"path": base["path"], "query": out["query"] if mark else base["query"]}
    return out | {"path": _walk(base["path"][1:].rpartition("/")[0] + "/" * ("/" in base["path"][1:]) + _escaped(rest, "path"))}


def href(u: dict) -> str:
    if u["host"] is None:
        return f"{u['scheme']}:{u['path']}"
    tail = "" if u["query"] is None or u["query"] == "" else "?" + u["query"]
    return f"{u['scheme']}://{u['host']}{':' + u['port'] if u['port'] else ''}{u['path']}{tail}{'#' + u['fragment'] if u['fragment'] else ''}"


def _form(s: str) -> str:
    return "".join("+" if c == " " else c if c.isascii() and (c.isalnum() or c in "*-._") else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def normal_form(raw: str, base: str | None) -> str | None:
    b = parse(base) if base else None
    u = parse(raw, b)
    if u is None or u["scheme"] not in ("http", "https"):
        return None
    decode = lambda x: unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace")
    pairs = [tuple(map(decode, x.partition("=")[::2])) for x in (u["query"] or "").split("&") if x]
    pairs = [p for p in pairs if p[0].lower() not in TRACKING_NAMES and not p[0].lower().startswith(TRACKING_PREFIXES)]
    pairs.sort(key=lambda p: (p[0].lower().translate({95: 1, 45: 2, 46: 3, 42: 4}), [c != c.lower() for c in p[0]]))
    u["query"] = "&".join(f"{_form(k)}={_form(v)}" for k, v in pairs) or None
    u["fragment"] = None
    if len(u["path"]) > 1:
        u["path"] = u["path"].rstrip("/") or "/"
    return href(u)


@F.pandas_udf(T.StringType())
def normalize_odd(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else normal_form(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def resolve(raw: pd.Series, base: pd.Series) -> pd.Series:
    """An href seen from its page, as it stands there; null where it is no URL."""

    def one(r: str | None, b: str | None) -> str | None:
        u = parse(r, parse(b) if b else None) if r else None
        return None if u is None else href(u)

    return pd.Series([one(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def is_absolute(url: Column) -> Column:
    """Whether a text parses as an absolute URL: any scheme with a rest, and for web schemes a host of allowed characters."""
    web = url.rlike(r"^(?i:https?|ftp|wss?):")
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (~web | url.rlike(r"^(?i:https?|ftp|wss?):[/\\]*(?:[^/\\?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\s/\\?#@:<>\[\]^`{|}%\"]+)(?::[0-9]{0,5})?(?:[/\\?#]|\z)"))
