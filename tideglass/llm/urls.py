"""URL filters (operator 8): pattern rules indexed by their rarest literal token.

A rule's pattern tells by itself which whole tokens a URL that it fits must hold. Counted over the whole
table, the rarest of them is the rule's place in an index. A URL's tokens fetch candidate rules, and
only these run their regular expressions.

Patterns: ``*`` stands for anything, ``^`` for a separator (neither letter, digit nor one of ``_.%-``) or the end,
``|`` at either end for that end of the URL, ``||`` in front for the start of a host or of a part of its name.
Everything else is literal; A to Z count as small letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs that ``pattern`` finds a place in; ``name`` set: the pattern is of host and path, the longest name wins."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if not self.tokens:
            raise ValueError(f"no whole literal token in {self.pattern}")
        object.__setattr__(self, "compiled", re.compile(self.pattern))


def place_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``. A path's last token may go on in the URL, so it is no literal."""
    whole = re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*_TOKEN.findall(host), *whole), host + path)


def expression(pattern: str, end: str = r"\Z") -> str:
    """The regular expression of a pattern; ``end`` is how its dialect writes the end of a text."""
    head, body, tail = re.fullmatch(r"(\|{0,2})(.*?)(\|?)", pattern, re.S).groups()
    out = [{"": "", "|": "^", "||": r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.])?"}[head]]
    out += [{"*": r"[\s\S]*", "^": f"(?:[^a-z0-9_.%-]|{end})"}.get(c) or re.escape(c) for c in body]
    return "".join(out) + (end if tail else "")


def literals(pattern: str) -> tuple[str, ...]:
    """Runs of letters and digits that stand between other literal signs, separators or ends: a URL that fits has each as a whole token."""
    return tuple(m[1] for m in re.finditer(r"(?<![a-z0-9*])(?<!\A)([a-z0-9]+)(?![a-z0-9*])(?!\Z)", pattern))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A rule of a pattern over the whole URL. It needs a whole literal token, as else it would run on every URL."""
    pattern = pattern.translate(_LOWER)
    return Rule(verdict, expression(pattern), literals(pattern))


_LOWER = {c: c + 32 for c in range(65, 91)}
#: The rules of the base, as (verdict, host, path).
PLACES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: What the method's own rules are made of. Pages that hold no text of their own, parameters of listings and sessions,
#: files that are no pages, hosts that serve adverts, words of junk.
PAGES = "login signin signup register logout account cart basket checkout wishlist compare unsubscribe wp-login wp-admin wp-json cgi-bin search feed rss print".split()
PARAMETERS = "page sessionid sid phpsessid jsessionid replytocom sort order filter print add-to-cart".split()
FILES = "zip gz tgz bz2 xz 7z rar exe msi dmg iso apk jar deb rpm torrent mp3 mp4 avi mov mkv flac wav jpg jpeg png gif svg webp ico css js woff".split()
ADVERTS = (
    "doubleclick.net googlesyndication.com adnxs.com criteo.com taboola.com outbrain.com scorecardresearch.com quantserve.com moatads.com pubmatic.com "
    "rubiconproject.com openx.net casalemedia.com adsrvr.org"
).split()
JUNK = "casino poker viagra cialis payday xxx porn escort jackpot betting replica essaywriting".split()
PATTERNS = (
    [f"/{x}{end}" for x in PAGES for end in ("^", ".php^")]
    + [f"{sign}{x}=" for x in PARAMETERS for sign in "?&"]
    + [f".{x}{end}" for x in FILES for end in "|?#"]
    + [f"||{x}^" for x in ADVERTS]
    + [f"{before}{x}{after}" for x in JUNK for before in "-./" for after in "-./"]
)
RULES = [place_rule(*p) for p in PLACES] + [pattern_rule("block", p) for p in PATTERNS]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return _ascii_lower(host), slash + path


def _ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs of the whole table each literal token of the rules stands: as many rows as there are such tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_intersect(F.split(F.lower(url_col), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(tokens).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in rows}


def indexed(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        out.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return out


def judge(url: str | None, index: dict[str, list[Rule]]) -> tuple[str, str, str | None, str]:
    host, path = host_and_path(url)
    place, verdict, url = None, "allow", _ascii_lower(url or "")
    for token in set(_TOKEN.findall(url)):
        for rule in index.get(token, ()):
            if rule.name is None:
                if place is None and verdict == "allow" and rule.compiled.search(url):
                    verdict = rule.verdict
            elif rule.compiled.match(host + path) and (place is None or (len(rule.name), rule.name) > (len(place.name), place.name)):
                place = rule
    return host, path, place.name if place else None, place.verdict if place else verdict


def url_filter(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row ``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    The longest fitting place rule decides; without one, any fitting pattern rule that blocks, else the URL is
    allowed. A null URL or one without ``://`` has an empty host and path. Repeated rows are judged each.
    Columns other than ``id_col`` and ``url_col`` are not read. The rules are a list of the caller's, which
    every task gets; a rule needs a literal token, as else it would run on every URL.
    """
    rules = RULES if rules is None else rules
    index = pages.sparkSession.sparkContext.broadcast(indexed(rules, token_counts(pages, rules, url_col)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(u, index.value) for u in batch.column("url").to_pylist()]
            columns = [pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
