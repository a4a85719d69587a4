"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is a regular expression over the lower-cased (A-Z) url. Its text is read into branches (alternatives and
optional characters), and each branch into the literal tokens (runs of letters, runs of digits) that every match must
hold as a whole token of the url. Each branch is filed under the token that the fewest urls of the table hold. A url's own
tokens fetch candidate patterns, and only those run. A pattern that isn't understood, or has a branch without a
token, always runs, so none is missed.

Host rules (host, path, verdict) come first: a rule fits its host and all subdomains when the url's path
starts with the rule's path, and the longest rule (host and path together) wins, of equally long ones the first by text. A url that no host
rule fits is blocked if a pattern matches it, else allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
``?``, ``#`` or the end.

Defined cases: a null url, or one without ``://``, has an empty host and path; a null or empty url is allowed;
texts of any length are handled whole; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
PATTERNS = (
    r"[?&]utm_source=", r"/ads?/", r"\bdoubleclick\.net\b", r"/banner[0-9]*/", r"^https?://ads?\.", r"\bcasino\b", r"/login(/|\?|#|$)",
    r"[?&]sessionid=[0-9a-f]+", r"/wp-admin/", r"\.exe(\?|#|$)", r"/cgi-bin/", r"^http://m\.[^/]*/[a-z]{2}/[0-9]*7(/|\?|#|$)", r"/amp/[0-9]+", r"\btracker\.",
)
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_LETTERS, _DIGITS = frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("0123456789")
_BRANCHES, _CLASSES = 16, {"d": _DIGITS, "w": _LETTERS | _DIGITS | {"_"}, "s": frozenset(" \t\n\r\f\v")}
_PART = re.compile(r"""(?P<atom>\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?:\?:)?|[|)^$.]|[^\\\[()|^$.?*+{])(?P<times>[?*+]|\{\d*,?\d*\})?\??""", re.S)


@dataclass(frozen=True)
class Atom:
    """One place of a pattern: a literal character, an edge that no letter or digit lies beyond, or anything else with
    the characters that it can be; ``empty``: it may be absent."""

    literal: str | None = None
    edge: bool = False
    chars: frozenset[str] | None = None  # None: any
    empty: bool = False


def _class(text: str) -> frozenset[str] | None:
    """The letters and digits of a character class, among others; None where it may hold any."""
    if text.startswith("[^"):
        return None
    out, body, i = set(), text[1:-1], 0
    while i < len(body):
        if body[i] == "\\":
            if body[i + 1] in "DWS":
                return None
            out |= _CLASSES.get(body[i + 1], frozenset(body[i + 1]))
            i += 2
        elif body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            out |= {chr(c) for c in range(ord(body[i]), ord(body[i + 2]) + 1)}
            i += 3
        else:
            out.add(body[i])
            i += 1
    return frozenset(out)


def branches(pattern: str) -> list[list[Atom]] | None:
    """The sequences of atoms that a pattern stands for: optional literals and alternatives multiply them. None where the
    pattern isn't understood in full or has more than ``_BRANCHES``."""

    def sequence(at: int) -> tuple[list[list[Atom]], int]:
        """All alternatives from ``at`` to the end of the group."""
        done: list[list[Atom]] = []
        now: list[list[Atom]] = [[]]
        while at < len(pattern):
            m = _PART.match(pattern, at)
            if not m:
                raise ValueError(pattern)
            atom, times, at = m["atom"], m["times"], m.end()
            if atom in ("|", ")"):
                done += now
                now = [[]]
                if atom == ")":
                    return done, m.start() + 1
                continue
            if atom[0] == "(":
                if atom == "(" and pattern[at : at + 1] == "?":
                    raise ValueError(pattern)
                inner, at = sequence(m.end("atom"))
                t = re.compile(r"[?*+]|\{\d*,?\d*\}").match(pattern, at)
                at = t.end() + (pattern[t.end() : t.end() + 1] == "?") if t else at
                options = inner if not t else [*inner, []] if t[0] == "?" else [[Atom(empty=t[0] != "+")]]
            else:
                options = _options(atom, times)
            now = [a + b for a in now for b in options]
            if len(now) + len(done) > _BRANCHES:
                raise ValueError(pattern)
        return done + now, at

    try:
        return sequence(0)[0]
    except (ValueError, RecursionError):
        return None


def _options(atom: str, times: str | None) -> list[list[Atom]]:
    if atom in "^$":
        return [[Atom(edge=True)]]
    if atom == "\\b":
        return [[Atom(edge=True)]]
    if atom[0] == "\\" and atom[1].isalnum():
        if atom[1] not in "dws":
            raise ValueError(atom)
        one = Atom(chars=_CLASSES[atom[1]])
    elif atom[0] == "[":
        one = Atom(chars=_class(atom))
    elif atom == ".":
        one = Atom()
    else:
        one = Atom(literal=atom[-1])
    if times is None:
        return [[one]]
    if times == "?":
        return [[one], []] if one.literal else [[Atom(chars=one.chars, empty=True)]]
    chars = frozenset(one.literal) if one.literal else one.chars
    return [[Atom(chars=chars, empty=times[0] == "*" or times[0] == "{")]]


def literal_tokens(atoms: Sequence[Atom]) -> set[str]:
    """Runs of letters, or of digits, that each url which the branch matches holds with none of their kind beside them."""

    def shut(i: int, step: int, kind: frozenset[str]) -> bool:
        """Whether what lies from atom ``i`` on can't begin with a character of the kind."""
        while 0 <= i < len(atoms):
            a = atoms[i]
            if a.edge:
                return True
            if a.literal is not None:
                return a.literal not in kind
            if a.chars is None or a.chars & kind:
                return False
            if not a.empty:
                return True
            i += step
        return False

    found, i = set(), 0
    while i < len(atoms):
        kind = next((k for k in (_LETTERS, _DIGITS) if atoms[i].literal and atoms[i].literal in k), None)
        j = i + 1
        if kind:
            while j < len(atoms) and atoms[j].literal and atoms[j].literal in kind:
                j += 1
            if shut(i - 1, -1, kind) and shut(j, 1, kind):
                found.add("".join(a.literal for a in atoms[i:j]))
        i = j
    return found


def needed_tokens(pattern: str) -> list[set[str]]:
    """The tokens of each branch; a url that the pattern matches holds all tokens of one of them. None: no such promise."""
    found = [literal_tokens(b) for b in branches(pattern) or [[]]]
    return found if all(found) else []


class PatternIndex:
    """``seen``: how many urls hold a token; each branch of a pattern is filed under its rarest."""

    def __init__(self, patterns: Sequence[str], seen: Mapping[str, int] | None = None):
        seen = seen or {}
        self.compiled = [re.compile(p, re.ASCII) for p in patterns]
        self.by_token: dict[str, set[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(patterns):
            needed = needed_tokens(p)
            for own in needed:
                self.by_token.setdefault(min(own, key=lambda t: (seen.get(t, 0), -len(t), t)), set()).add(i)
            if not needed:
                self.always.append(i)

    def candidates(self, url: str) -> list[int]:
        return sorted({i for t in set(_TOKEN.findall(url)) for i in self.by_token.get(t, ())} | set(self.always))

    def match(self, url: str) -> int | None:
        """The first of the patterns that match, by their order."""
        return next((i for i in self.candidates(url) if self.compiled[i].search(url)), None)


class HostRules:
    """Rules by host; a url's host and its parent domains fetch the rules to compare."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, rest = None, host
        while rest:
            for start, verdict in self.by_host.get(rest, ()):
                own = (rest + start, verdict)
                if path.startswith(start) and (best is None or (-len(own[0]), own) < (-len(best[0]), best)):
                    best = own
            rest = rest.partition(".")[2]
        return best


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def token_counts(pages: DataFrame, patterns: Sequence[str]) -> dict[str, int]:
    """How many urls hold each token of the patterns; a row for each of those tokens at most comes to the driver."""
    wanted = sorted({t for p in patterns for own in needed_tokens(p) for t in own})
    low = F.translate(F.coalesce(F.col("url").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.array_intersect(F.regexp_extract_all(low, F.lit(_TOKEN.pattern), F.lit(0)), F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))
    return {r["t"]: r["n"] for r in pages.select(F.explode(own).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def _judge(rules: Sequence[tuple[str, str, str]], patterns: Sequence[str], seen: Mapping[str, int]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, index = HostRules(rules), PatternIndex(patterns, seen)
        for b in batches:
            rule, verdict, pattern = [], [], []
            for url, host, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                hit = hosts.match(host, path)
                found = None if hit else index.match((url or "").translate(_LOWER))
                rule.append(hit[0] if hit else None)
                verdict.append(hit[1] if hit else "allow" if found is None else "block")
                pattern.append(None if found is None else patterns[found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return judge


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (that blocked it, else null) of every row."""
    ship(pages.sparkSession)
    url = F.coalesce("url", F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    slim = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(_judge(tuple(rules), tuple(patterns), token_counts(pages, patterns)), f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    fits = [f"WHEN (host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)}) THEN" for h, p, _ in order]
    rule = " ".join(f"{f} {quote(h + p)}" for f, (h, p, _) in zip(fits, order, strict=True))
    verdict = " ".join(f"{f} {quote(v)}" for f, (_, _, v) in zip(fits, order, strict=True))
    first = " ".join(f"WHEN regexp_matches(low, {quote(p)}) THEN {quote(p)}" for p in PATTERNS)
    fitted = " OR ".join(f.removeprefix("WHEN ").removesuffix(" THEN") for f in fits)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
m AS (SELECT *, CASE WHEN {fitted} THEN NULL ELSE CASE {first} ELSE NULL END END AS pattern FROM h)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM m
"""


SQL = _sql()
