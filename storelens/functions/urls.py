"""URL expressions.  Hosts come from regexes, not a URI parser, so that odd
characters in a path never turn a host into NULL or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens import rules
from storelens.functions.text import any_of, apply, found, let

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def normalize_site_url(url: Column) -> Column:
    """Add ``https://`` when no scheme is given and drop trailing slashes."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(full, "/+$", "")


def valid_url(url: Column) -> Column:
    """Scheme and host are both present."""
    return F.coalesce(url.rlike(HOST), F.lit(False))


def host_of(url: Column) -> Column:
    return F.lower(found(url, HOST, 1))


def site_of(url: Column) -> Column:
    """Site key: the lowercase host of the normalised URL."""
    return host_of(normalize_site_url(url))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def path_of(url: Column) -> Column:
    """Path without trailing slash; empty for the home page."""
    return F.regexp_replace(F.regexp_extract(url, ORIGIN[:-1] + r")([^?#]*)", 2), "/+$", "")


def page_key(url: Column) -> Column:
    """Host without ``www.`` and path without trailing slash: equal for the spellings of one page's URL."""
    return F.concat(F.regexp_replace(site_of(url), r"^www\.", ""), path_of(normalize_site_url(url)))


def page_rank(url: Column) -> Column:
    """Number of path segments: 0 for the home page, so it sorts first."""
    path = path_of(url)
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


# Reference r = (href, base) to an absolute URL; the folder of a base without a path is its root.
_PAGE = "regexp_replace(r.base, '[?#].*$', '')"
_ORIGIN = f"regexp_extract(r.base, r'{ORIGIN}', 1)"
_JOIN = f"""r -> case
  when r.href = '' then r.base
  when startswith(r.href, 'http') or r.href rlike r'{SCHEME}' then r.href
  when startswith(r.href, '//') then concat(regexp_extract(r.base, r'{SCHEME}', 0), r.href)
  when startswith(r.href, '/') then concat({_ORIGIN}, r.href)
  when startswith(r.href, '?') then concat({_PAGE}, r.href)
  when startswith(r.href, '#') then concat(regexp_replace(r.base, '#.*$', ''), r.href)
  when {_PAGE} = {_ORIGIN} then concat({_ORIGIN}, '/', r.href)
  else concat(regexp_replace({_PAGE}, '[^/]*$', ''), r.href) end"""

# Resolves '.' and '..' segments of a joined URL u = (url, origin, path, suffix).
_TIDY = """u -> concat(u.origin, '/',
  array_join(aggregate(split(regexp_replace(u.path, '^/', ''), '/'), cast(array() as array<string>), (acc, part) -> case
    when part = '.' then acc
    when part = '..' then slice(acc, 1, greatest(size(acc) - 1, 0))
    else concat(acc, array(part)) end), '/'),
  if(u.path rlike r'/[.]{1,2}$', '/', ''), u.suffix)"""
_SPLIT = f"""u -> named_struct('origin', regexp_extract(u, r'{ORIGIN}', 1),
  'path', regexp_extract(regexp_replace(u, r'{ORIGIN}', ''), '^[^?#]*', 0),
  'suffix', regexp_extract(u, '[?#].*$', 0))"""


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute URL of ``href`` found on ``base``."""
    pair = F.struct(href.alias("href"), base.alias("base"))
    tidied = (
        f"j -> if(startswith(j.href, 'http') or not j.href rlike r'(^|/)[.]{{1,2}}(/|$|[?#])', j.url,"
        f" get(transform(transform(array(j.url), {_SPLIT}), {_TIDY}), 0))"
    )
    joined = f"r -> named_struct('href', r.href, 'url', get(transform(array(r), {_JOIN}), 0))"
    return apply(tidied, apply(joined, pair))


def clean_social_url(url: Column) -> Column:
    """Drop the query string."""
    return F.trim(F.regexp_replace(url, r"\?.*$", ""))


def name_from_url(url: Column) -> Column:
    """Brand name guessed from the host: first label, words capitalised."""
    host = F.replace(host_of(url), F.lit("www."), F.lit(""))
    label = F.split(host, r"\.")[0]
    return F.initcap(F.trim(F.regexp_replace(label, "[^a-zA-Z0-9]+", " ")))


def on_domain(host: Column, domain: str) -> Column:
    """Host is ``domain`` or one of its subdomains."""
    return (host == domain) | host.endswith("." + domain)


def valid_candidate(url: Column, original_url: Column, excluded=rules.EXCLUDED_HOSTS) -> Column:
    """Another site, not on an excluded host, reached by http(s)."""
    return other_store(host_of(url), url, host_of(original_url), excluded)


def other_store(host: Column, url: Column, own_host: Column, excluded=rules.EXCLUDED_HOSTS) -> Column:
    # The host is taken from the URL once, and looked through word by word: a pattern of all words costs more on short texts.
    def other(h):
        return ~h.eqNullSafe(own_host) & ~any_of(h.contains(w) for w in excluded)

    return F.coalesce(url.startswith("http") & let(host, other), F.lit(False))
