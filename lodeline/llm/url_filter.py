"""URL filtering: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

One pass of the automaton over a URL finds every term of the vocabulary. A find counts only where
it stands alone: no letter directly before or after it. One strict term rejects a URL; soft terms
reject it when several distinct ones occur.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import LOWER, UPPER, map_arrow

# The default vocabulary; both lists are parameters.
STRICT = (
    "adult", "casino", "casinos", "escort", "escorts", "porn", "porno", "sex", "viagra", "xxx", "nude", "hentai",
    "malware", "phishing", "warez", "spam",
)
SOFT = (
    "ads", "bet", "bets", "bonus", "buy", "cash", "cheap", "click", "deal", "deals", "discount", "farm", "free", "hot",
    "jackpot", "loan", "loans", "lottery", "poker", "pill", "pills", "pharmacy", "prize", "replica", "slots", "track",
    "tracker", "win", "winner",
)
MIN_SOFT = 2

# Host (with its subdomains), start of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_ascii_lower = str.maketrans(UPPER, LOWER)
_state: dict = {}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a text without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_ascii_lower), tail[:stop]


class Rules:
    """Rules by host; a look-up walks the host's own suffixes, so its cost does not grow with the rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equals the one with the longer host."""
        best = None
        parts = host.split(".")
        for i in range(len(parts)):
            name = ".".join(parts[i:])
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or len(name + start) > len(best[0])):
                    best = (name + start, verdict)
        return best


class Vocabulary:
    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):
            for t in terms:
                self.find.add_word(t, (t, weight))
        if len(self.find):
            self.find.make_automaton()

    def counts(self, url: str | None) -> tuple[int, int]:
        """(strict finds, distinct soft terms) that stand alone in a URL."""
        text = (url or "").translate(_ascii_lower)
        strict, soft = 0, set()
        if not len(self.find):
            return 0, 0
        for end, (term, weight) in self.find.iter(text):
            before, after = end - len(term), end + 1
            if (before >= 0 and text[before].isalpha()) or (after < len(text) and text[after].isalpha()):
                continue
            if weight == 2:
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict, strict_hits and soft_hits (columns of these names are replaced).

    The longest rule that fits decides; without one, ``block`` means a strict term or at least
    ``min_soft`` distinct soft ones. A null URL has no host, no path and no terms: it is allowed.
    """
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    added = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    base = pages.drop(*added)
    names = base.columns

    def run(part: pa.RecordBatch):
        key = (rules, strict, soft)
        if _state.get("key") != key:
            _state.update(key=key, rules=Rules(rules), words=Vocabulary(strict, soft))
        cols: list[list] = [[] for _ in added]
        for url in part["url"].to_pylist():
            host, path = split_url(url)
            found = _state["rules"].find(host, path)
            n_strict, n_soft = _state["words"].counts(url)
            own = "block" if n_strict or n_soft >= min_soft else "allow"
            row = (host, path, found and found[0], found[1] if found else own, n_strict, n_soft)
            for c, x in zip(cols, row):
                c.append(x)
        types = [pa.string()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *map(pa.array, cols, types)], [*names, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    ddl = ", ".join([*fields, "host string", "path string", "rule string", "verdict string", "strict_hits long", "soft_hits long"])
    return map_arrow(base, run, ddl)


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The rows of ``pages`` that are not blocked, with their own columns."""
    return filter_urls(pages, **options).where(F.col("verdict") == "allow").select(*[c for c in pages.columns])
