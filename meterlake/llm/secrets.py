"""Secret scans: plain patterns, and a lexer of assignments that follows constants to sensitive names.

Source code, configuration and data files say ``target operator value`` in many ways: ``password = "x"``, ``"token":
'x'``, ``String key = "x"``, ``key: str = "x"``, ``ENV KEY x``, ``#define KEY "x"``, ``<key>x</key>``,
``put("key", "x")``. The lexer finds the targets and their operators, reads the value as an expression of literals and
names, and keeps what each name holds, so that a literal that reaches a sensitive name through other names is found
where it is written. A pair's score is that of the target's words times that of the literal; see ``name_score`` and
``literal_score``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterlake.llm import words as W

#: In the order in which spans of one start come.
KINDS = ("assign", "access", "hex", "named")
THRESHOLD = 0.5
#: The plain patterns. Letters of the first are ASCII in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16

STRONG = {"password", "passwd", "passphrase", "passcode", "pwd", "secret", "secrets", "credential", "credentials", "apikey", "privatekey", "accesskey", "secretkey", "authtoken"}
STRONG_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("encryption", "key"), ("signing", "key"), ("master", "key"), ("auth", "token"), ("access", "token"), ("refresh", "token"), ("bearer", "token"), ("connection", "string")}
WEAK = {"token", "auth", "authorization", "key", "pass", "pin", "salt", "bearer", "signature", "jwt"}
#: Last words of names that hold something about a secret.
ABOUT = {"name", "id", "url", "uri", "path", "file", "type", "length", "size", "count", "min", "max", "label", "field", "hint", "policy", "regex", "pattern", "expiry", "expires", "ttl", "placeholder", "prefix", "header", "param", "env"}
DUMMY = re.compile(r"x+|\*+|\.+|-+|_+|<.*>|\$.*|%.*%|\{.*\}|\[.*\]|your.*|.*change.?me.*|.*example.*|.*placeholder.*|none|null|nil|true|false|undefined|test(ing)?|dummy|redacted|required|optional|string|todo", re.I | re.S)

_NAME = r"[A-Za-z_$][\w$]*(?:-[\w$]+)*"
_PATH = rf"{_NAME}(?:\.{_NAME}|\[[ \t]*(?:\"[^\"\n\]]*\"|'[^'\n\]]*'|\w+)[ \t]*\])*"
TARGET = re.compile(
    rf"""(?:(?<![\w$.\]\-])|(?<=--))(?P<name>{_PATH})[ \t]*(?P<op>:=|=>|\?\?=|=(?![=>~])|:(?![:/=]))[ \t]*
    |(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')[ \t]*(?P<pair>=>|:(?![:/=])|=(?![=>~])|(?P<comma>,))[ \t]*
    |^[ \t]*(?:\#[ \t]*define|ENV|ARG|setx?|setenv)[ \t]+(?P<set>{_NAME})[ \t]+
    |<(?P<tag>{_NAME})>(?=(?P<inner>[^<>\n]+)</(?P=tag)>)""",
    re.X | re.M,
)
#: A text without any of these has no assignment.
SIGNS = ("=", ":", "<", '",', "',", "define", "ENV", "ARG", "set ", "set\t", "setx", "setenv")
BEFORE = re.compile(rf"({_NAME})[ \t]+$")
ANNOTATION = re.compile(r"[A-Za-z_][\w.\[\]|<>?]*[ \t]*=(?!=)[ \t]*")
STRING = re.compile(r'''[rRbBuUfF@L]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>(?:[^`\\]|\\.)*)`)''', re.S)
REFERENCE = re.compile(rf"\$\{{(?P<braced>{_NAME})\}}|\$?(?P<plain>{_PATH})")
#: Values without quotes, up to the end of the line or a comment; next to its operator a value may end at a space.
BARE = re.compile(r"""[^\s"'`,;&(){}\[\]<>]+""")
BARE_END = re.compile(r"[ \t]*(?:$|[,;}\]&]|#|//)", re.M)
JOINED = re.compile(r"""[ \t]*(?:\+|\.\.|&|~)[ \t]*\n?[ \t]*|[ \t]+\.[ \t]+|[ \t]*\\\n[ \t]*|[ \t]*(?=["'`])""")
ENDED = re.compile(r"[ \t]*(?:$|[,;)}\]&]|#|//)", re.M)


def words_of(name: str) -> list[str]:
    """Lower-case words of a name, split at case and signs."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def name_score(name: str) -> float:
    """1 for names of secrets, 0.6 for names that often are, a fifth of it if the last word is about a secret, else 0."""
    parts = words_of(name)
    if STRONG.intersection(parts) or STRONG_PAIRS.intersection(zip(parts, parts[1:])):
        score = 1.0
    elif WEAK.intersection(parts) and "public" not in parts:
        score = 0.6
    else:
        return 0.0
    return score * 0.2 if parts[-1] in ABOUT else score


class Held:
    """What a name holds: a literal where it is written, or a join of such values."""

    __slots__ = ("span", "parts", "features", "best")

    def __init__(self, span: tuple[int, int] | None, parts: tuple[Held, ...] = ()):
        self.span, self.parts, self.features, self.best = span, parts, None, (0.0, "")

    def of(self, text: str) -> tuple[Counter, int, bool]:
        """(numbers of characters, blanks between words, whether it is a placeholder); a join has its parts' sums."""
        if not self.features:
            if self.parts:
                each = [p.of(text) for p in self.parts]  # joins were asked when they were made, so this goes one step down
                self.features = sum((e[0] for e in each), Counter()), sum(e[1] for e in each), False
            else:
                own = text[slice(*self.span)].strip()
                blanks = 0 if "-----BEGIN" in own else len(own.split()) - 1
                self.features = Counter(own), blanks, bool(DUMMY.fullmatch(own))
        return self.features


def literal_score(counts: Counter, blanks: int, dummy: bool) -> float:
    """From 0 to 1 by the entropy of the characters (of 64 at most), 32 bits and more being full, with 0.6 for one
    class of characters alone. Placeholders, values of under six characters and texts of over two words score 0."""
    size = sum(counts.values())
    if size < 6 or dummy or blanks > 1:
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in counts.values()) * min(size, 64)
    kinds = {"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "#" for c in counts}
    return min(1.0, bits / 32) * (1.0 if len(kinds) > 1 else 0.6)


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, leftmost and not overlapping in a kind; too short matches are dropped
    after they were matched."""
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        yield from ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED)
    yield from ((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS)
    yield from ((m.start(), 2, m.end()) for m in HEX.finditer(text))


def _value(text: str, at: int, known: dict[str, Held], joins: list[Held], bare: bool, glued: bool) -> Held | None:
    """The expression at ``at``: a string, a name that holds one, or a join of both; or one value without quotes."""
    parts: list[Held] = []
    while at < len(text) and text[at] in "( \t":
        at += 1
    while True:
        m = STRING.match(text, at)
        if m:
            inner = m[m.lastgroup]
            whole = REFERENCE.fullmatch(inner) if inner[:1] == "$" else None
            held = known.get(whole["braced"] or whole["plain"]) if whole else None
            parts.append(held or Held(m.span(m.lastgroup)))
        else:
            m = REFERENCE.match(text, at)
            held = known.get(m["braced"] or m["plain"]) if m else None
            if not held or not (ENDED.match(text, m.end()) or JOINED.match(text, m.end())):
                break
            parts.append(held)
        at = m.end()
        joint = JOINED.match(text, at)
        if not joint:
            break
        at = joint.end()
    if len(parts) > 1:
        joins.append(Held(None, tuple(parts)))
        joins[-1].of(text)
        return joins[-1]
    if parts:
        return parts[0]
    m = BARE.match(text, at) if bare else None
    if m and (BARE_END.match(text, m.end()) or (glued and text[m.end()] in " \t")):
        return Held(m.span())
    return None


def _first_in_line(text: str, at: int) -> bool:
    while at and text[at - 1] in " \t-{":
        at -= 1
    return not at or text[at - 1] == "\n"


def pairs(text: str, joins: list[Held]) -> Iterator[tuple[str, Held]]:
    """(target, value) of each assignment in order; ``joins`` gets all joined values, each after its parts."""
    known: dict[str, Held] = {}
    for m in TARGET.finditer(text):
        if m["tag"]:
            yield m["tag"], Held(m.span("inner"))
            continue
        if m["comma"] and text[m.start() - 1 : m.start()] != "(":
            continue
        name, at, op = m["name"] or m["set"] or m["quoted"][1:-1], m.end(), m["op"] or m["pair"]
        if op == ":" and m["name"] and (typed := ANNOTATION.match(text, at)):
            at = typed.end()
        # values without quotes: of directives, after =, and after : where the name is the first in its line
        bare = not op or op[-1] == "=" or (op == ":" and (not m["name"] or _first_in_line(text, m.start("name"))))
        held = _value(text, at, known, joins, bare, glued=text[m.end() - 1] == "=")
        if not held:
            known.pop(name, None)
            continue
        if not m["quoted"]:  # a key of data is no name that others can use
            known[name] = held
        before = BEFORE.search(text, max(0, m.start() - 80), m.start()) if m["name"] and op != ":" else None
        yield f"{before[1]} {name}" if before else name, held


def scan(text: str, least: float = THRESHOLD) -> list[dict]:
    """All spans of a text by start and kind, in code points, ends exclusive. ``named`` spans are literals that are
    assigned, directly or through other names, to a name with which they score ``least`` or more, and that lie in no
    span of the plain patterns; ``name`` is the target with the best score."""
    plain = sorted(base_spans(text))
    best: dict[tuple[int, int], tuple[float, str]] = {}

    def lend(held, score):
        held.best = max(held.best, score)
        if held.span:
            best[held.span] = held.best

    joins: list[Held] = []
    if any(sign in text for sign in SIGNS):
        for target, held in pairs(text, joins):
            own = name_score(target)
            if own and (score := own * literal_score(*held.of(text))) >= least:
                lend(held, (score, target))
    for held in reversed(joins):
        if held.best[0]:
            for part in held.parts:
                lend(part, held.best)
    out = [{"kind": KINDS[k], "start": a, "end": b, "name": None, "score": 1.0} for a, k, b in plain]
    furthest, at, ordered = 0, 0, sorted(best)
    for a, b in ordered:
        while at < len(plain) and plain[at][0] <= a:
            furthest, at = max(furthest, plain[at][2]), at + 1
        if b > furthest:
            out.append({"kind": KINDS[3], "start": a, "end": b, "name": best[a, b][1], "score": best[a, b][0]})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


SPANS = "found array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, least: float = THRESHOLD) -> DataFrame:
    """(``carry`` or all columns, found): the spans of each row's whole text, see ``scan``.

    Null and empty texts have none. Rows that repeat an id are scanned each; an empty table gives an empty one; a kept
    column named ``found`` gives way.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))

    def make():
        return lambda column: [pa.array([scan(t.as_py() or "", least) for t in column], kind)]

    return W.with_columns(docs, text, SPANS, carry, make)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of ``documents``."""
    found = find_secrets(docs, carry=["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
