"""Credentials in command lines, code and configuration: find and mask them."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Publicly documented shapes of issued tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{35}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_\-]{20,}"
    r"|npm_[A-Za-z0-9]{36}|hv[sbr]\.[A-Za-z0-9_\-]{20,}|pypi-[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_PUBLIC = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE)[A-Z0-9 ]+-----.*?-----END [A-Z0-9 ]+-----|\b(?:ssh-[a-z0-9]+|ecdsa-[a-z0-9\-]+) AAAA[A-Za-z0-9+/=]+", re.S)

# Words that name a secret. The first group is believed for nearly any value; the second needs a value that looks random.
_STRONG = r"passwords?|passwd|passphrase|pass|pwd|passcode|secret|credentials?"
_WEAK = r"tokens?|api[_\-]?key|apikey|key|auth|authorization|signature|bearer"
_NAME = re.compile(rf"(?i)(?P<name>[a-z0-9_.\-]*(?:{_STRONG}|{_WEAK})[a-z0-9_\-]*)(?P<sep>[\"']?[ \t]*(?::[ \t]*|=[ \t]*))(?P<open>[\"']?)")
_FLAG = re.compile(rf"(?i)(?<!\S)--?(?P<name>(?:[a-z0-9]+[_\-])*(?:{_STRONG}|{_WEAK})[a-z0-9_\-]*)(?P<sep>[ \t]+)(?P<open>[\"']?)")
_SET = re.compile(rf"(?i)\bconfig(?:ure)?[ \t]+set[ \t]+(?P<name>\S*(?:{_STRONG}|{_WEAK})[a-z0-9_\-]*)(?P<sep>[ \t]+)(?P<open>[\"']?)")
# Name endings that say the value is where or how, not what.
_ABOUT = re.compile(r"(?i)(?:file|path|dir|folder|stdin|stdout|url|uri|env|name|type|ttl|len|length|size|count|limit|policy|field|format|store|ring|board|s?=?tokens)$")
_ABOUT_ID = re.compile(r"(?i)(?<!key)(?<!access)[_\-]id$")

_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s/:@'\"]*:(?P<v>[^\s/@'\"]+)@")
_URL_ALONE = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://(?P<v>[^\s/:@'\"]{16,})@")
_USER = re.compile(r"(?<!\S)(?:-u|--user|--proxy-user|-U|--userpwd)(?:[ \t]+|=|(?<=-u)|(?<=-U))(?P<q>[\"']?)(?P<user>[^\s:%\"'/]+)[:%](?P<v>[^\"'\n]+?|[^\s\"']+)(?=(?P=q)(?:\s|$|[;|&)]))", re.I)
# Tools whose short options take a password.
_SHORT_OPTIONS = {
    r"mysql\w*|mariadb\w*": ("-p", r"(?=[^\s\-])"),
    r"sshpass": ("-p", r"[ \t]*"),
    r"login|mongo\w*|cqlsh|influx|az|oc|cf|rabbitmqadmin": ("-p", r"[ \t=]+"),
    r"redis-cli|valkey-cli": ("-a", r"[ \t=]+"),
    r"ldap\w+": ("-w", r"[ \t=]+"),
    r"zip|unzip|7z|sqlcmd|bcp|mosquitto_\w+": ("-P", r"[ \t=]*"),
    r"lftp": ("-u", r"[ \t]+[^\s,]+,"),
}
_DASH_P = [re.compile(rf"(?i:\b(?:{tools}))\b(?!\s*[:=])[^|;&\n]*?[ \t]{option}{rest}(?P<open>[\"']?)") for tools, (option, rest) in _SHORT_OPTIONS.items()]
_AUTH = re.compile(r"(?i)\bauthorization[ \t]*[:=][ \t]*(?:bearer|token|basic|digest|apikey|key)[ \t]+(?P<v>[^\s\"']+)")
_PIPED = re.compile(r"(?i)(?:\becho|\bprintf)[ \t]+(?:-n[ \t]+|['\"]?%s(?:\\n)?['\"]?[ \t]+)*(?P<q>[\"']?)(?P<v>[^\s\"'|]+)(?P=q)[ \t]*\|[^|\n]*?(?:--password-stdin|--with-token|--token-stdin|\blogin\b)")
_BARE = re.compile(r"[^\s\"'`|;&<>()]+")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=.\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])")
_QUOTED = re.compile(r"(?P<q>[\"'])(?P<v>[!-~]{8,}?)(?P=q)")
#: What a text must hold for any of the rules to find something in it, as a pattern of the JVM: one part for each rule,
#: never narrower than the rule (its classes are wider or equal, and letter case is that of Unicode).
_OPTION_PARTS = "|".join(rf"(?:{tools})[^|;&\n]*[ \t]{option}" for tools, (option, _) in _SHORT_OPTIONS.items())
SCREEN = "(?iu)" + "|".join(
    (
        r"pass|pwd|secret|credential|token|key|auth|signature|bearer", r"://\S*@", r"[^\w]-u|^-u|--(?:proxy-)?user", _OPTION_PARTS, r"\|[^|\n]*(?:stdin|with-token|login)",
        r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|_live_|_test_|sk-|npm_|hv[sbr]\.|pypi-|eyJ", r"[A-Za-z0-9+/_\-]{20}", r"[\"'][!-~]{8}",
    )
)

_PLACEHOLDER = re.compile(
    r"(?i)^(?:(.)\1*|\*+|x+|\.+|-+|_+|null|none|nil|undefined|true|false|yes|no|on|off|empty|stdin|prompt|ask|example|sample|dummy|test|todo|tbd|changeme|change[_\-]?me|redacted|masked|hidden|secret|password|passwd|pass|token|key"
    r"|your[_\-].*|my[_\-]?(?:password|token|key|secret)|insert[_\-].*|replace[_\-].*|\[.*\]|<.*>|\{.*\}|%\w+%)$"
)
# Words that stand for a value or say its type.
_KIND = re.compile(r"(?i)^(?:str|string|text|char|varchar|bool|boolean|bytes|value|input|user|required|optional|default|file|random|here|unset|unknown|n/?a)$")
_REFERENCE = re.compile(r"\$(?!$)|\{\{|\}\}|`|\*{3,}|^(?:env|file|fd|stdin|keyring|vault|ref|arn|ssm|op):|^@|^~/|^\.{1,2}/|^[a-z]+://")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]+$")
_PATHLIKE = re.compile(r"^[\w.\-]+(?:/[\w.\-]+)*\.[a-z]{1,5}$")


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits each."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def alphabet(value: str) -> int:
    """The size of the smallest usual alphabet that the value is written in."""
    if _HEX.match(value):
        return 16
    if value.isalnum():
        return 36 if value == value.lower() or value == value.upper() else 62
    return 64 if re.fullmatch(r"[A-Za-z0-9+/=_\-]+", value) else 90


@dataclass(frozen=True)
class Shares:
    """How much of the most entropy that length and alphabet allow a value needs, by what stands around it.

    ``stated``: where only a secret can stand (a name such as password, an option, an address, an issued prefix);
    ``named``: under a name that may also mean something else (token, key); ``alone``: a quoted string or long token
    without a name, of at least ``long`` characters; ``short``: a quoted string of at least ``least`` ones.
    """

    stated: float = 0.3
    named: float = 0.6
    alone: float = 0.8
    symbols: float = 0.85
    short: float = 0.93
    long: int = 16
    least: int = 12


SHARES = Shares()


def looks_random(value: str, share: float) -> bool:
    """Entropy of at least ``share`` of the most that this length and alphabet allow."""
    return entropy(value) >= share * math.log2(max(2, min(len(value), alphabet(value))))


def _changes(value: str) -> float:
    """The share of places at which the kind of character (digit, upper, lower, other) changes. Of tokens drawn from
    letters and digits about 0.62, of those of one case about 0.4, of names made of words much less."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(value) - 1)


def _mixed(value: str) -> bool:
    """Changes its kind of character nearly as often as its alphabet lets a random token do."""
    return _changes(value) >= (0.2 if value == value.lower() or value == value.upper() else 0.35)


def _is_path(value: str) -> bool:
    """Begins at the root and does not look drawn at random."""
    return value.startswith("/") and not (len(value) >= 16 and re.search(r"[0-9]", value) and re.search(r"[A-Z]", value) and re.search(r"[a-z]", value) and looks_random(value, 0.85))


def _plausible(value: str, share: float = SHARES.stated) -> bool:
    """No placeholder, reference or path, and with the entropy that is asked for."""
    return bool(value) and looks_random(value, share) and not _PLACEHOLDER.match(value) and not _REFERENCE.search(value) and not _is_path(value)


def _believed(name: str, value: str) -> bool:
    """Whether a value under this name is a secret."""
    if not _plausible(value) or _ABOUT.search(name) or _ABOUT_ID.search(name):
        return False
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if re.search(rf"(?i){_STRONG}", name):
        return len(value) >= 4 and (digit or not value.isalpha() or len(value) >= 8 or bool(re.search(r"(?i)pass|pwd", name)) and not _KIND.match(value))
    least = 8 if re.search(r"(?i)token|api|secret|access|auth", name) else 16
    return len(value) >= least and digit and letter and not _UUID.match(value) and not _PATHLIKE.match(value) and looks_random(value, SHARES.named)


def _value(text: str, at: int, quote: str) -> tuple[int, int] | None:
    """The span of the value that begins at ``at``, after its opening quote if it has one."""
    if quote:
        end = text.find(quote, at)
        return (at, end) if end > at and "\n" not in text[at:end] else None
    m = _BARE.match(text, at)
    return m.span() if m else None


def _without_closers(value: str) -> str:
    """Without a comma or bracket at the end that belongs to what is around the value."""
    while value and (value[-1] == "," or any(value[-1] == c and o not in value for o, c in ("{}", "[]"))):
        value = value[:-1]
    return value


class _Spans:
    """Disjoint spans in order; one that overlaps another is refused. Look-ups by bisection."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.secret: list[bool] = []

    def free(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return start < end and (at == 0 or self.ends[at - 1] <= start)

    def add(self, start: int, end: int, secret: bool = True) -> None:
        if self.free(start, end):
            at = bisect.bisect_left(self.starts, start)
            self.starts.insert(at, start)
            self.ends.insert(at, end)
            self.secret.insert(at, secret)


def _alone(v: str, quoted: bool) -> bool:
    """Whether a quoted string or long token without a name is a secret: its kinds of characters are mixed and its
    entropy is nearly the most that length and alphabet allow. Runs of letters are usual in names, but come by chance in a
    tenth of random tokens, which change their kind all the same; drawn at random, 40 letters and digits
    have 0.9 of the most entropy, with a deviation of 0.024."""
    if _HEX.match(v) or _UUID.match(v):
        return False
    digits, uppers, lowers = sum(map(str.isdigit, v)), sum(map(str.isupper, v)), sum(map(str.islower, v))
    if not quoted:
        least = min(digits, uppers, lowers)
        if not least or v.count("/") > 2 or len(v) < 24 and _changes(v) < 0.5:
            return False
        return _mixed(v) and looks_random(v, SHARES.alone) or least >= 3 and not re.search(r"[a-z]{6,}|[A-Z]{9,}", v) and looks_random(v, SHARES.symbols)
    if not digits or not uppers + lowers or _PATHLIKE.match(v.lower()) or not _plausible(v):
        return False
    if len(v) >= SHARES.long:
        return looks_random(v, SHARES.alone if v.isalnum() else SHARES.symbols) and _mixed(v)
    # short ones: three kinds of letters and digits that change often, with or without the symbols of a password
    return len(v) >= SHARES.least and bool(uppers and lowers) and not re.search(r"[\\/(){}\[\]<>,;:=|%]", v) and _changes(v) >= 0.6 and looks_random(v, SHARES.short)


def find_secrets(text: str | None) -> list[tuple[int, int]]:
    """Spans of the literal secrets of a text, in order, without overlap.

    Every quoted string, assigned value, option value, part of an address and long token is a candidate; what stands around
    it decides how much entropy it needs (``Shares``).
    """
    if not text:
        return []
    spans = _Spans()
    for m in _PRIVATE.finditer(text):
        spans.add(*m.span())
    for m in _PUBLIC.finditer(text):
        spans.add(*m.span(), secret=False)
    for m in _URL.finditer(text):
        if _plausible(m["v"]):
            spans.add(*m.span("v"))
    for m in _URL_ALONE.finditer(text):
        if _plausible(m["v"], 0.7) and any(map(str.isdigit, m["v"])):
            spans.add(*m.span("v"))
    for m in _ISSUED.finditer(text):
        if looks_random(m.group(), SHARES.stated):
            spans.add(*m.span())
    for m in _AUTH.finditer(text):
        if _plausible(m["v"]) and len(m["v"]) >= 8:
            spans.add(*m.span("v"))
    for m in _PIPED.finditer(text):
        if _plausible(m["v"]) and len(m["v"]) >= 4:
            spans.add(*m.span("v"))
    for m in _USER.finditer(text):
        if _plausible(m["v"]) and len(m["v"]) >= 4 and not m["v"].isdigit() and "/" not in m["v"][:1]:
            spans.add(*m.span("v"))
    for pattern in _DASH_P:
        for m in pattern.finditer(text):
            span = _value(text, m.end(), m["open"])
            if span and _plausible(text[slice(*span)]) and span[1] - span[0] >= 4:
                spans.add(*span)
    for pattern in (_SET, _FLAG, _NAME):
        at = 0
        while m := pattern.search(text, at):
            at = m.end("sep")
            span = _value(text, m.end(), m["open"])
            if not span:
                continue
            start, end = span
            if text.startswith("pass:", start):
                start += 5
            if text[end - 1 : end] in "/|,#" and text[end : end + 1] in ("'", '"') and re.search(r"['\"]s[/|,#]", text[max(0, start - 200) : start]):
                end -= 1  # the closing delimiter of a substitution
            if not m["open"] and text[m.start() - 1 : m.start()] in ("?", "&"):
                end = start + len(text[start:end].split("&")[0])
            if not m["open"]:
                end = start + len(_without_closers(text[start:end]))
            if _believed(m["name"], text[start:end]):
                spans.add(start, end)
    for m in _LONG.finditer(text):
        if spans.free(*m.span()) and _alone(m.group(), False):
            spans.add(*m.span())
    for m in _QUOTED.finditer(text):
        if spans.free(*m.span("v")) and _alone(m["v"], True):
            spans.add(*m.span("v"))
    return [(s, e) for s, e, secret in zip(spans.starts, spans.ends, spans.secret) if secret]


def mask(text: str, spans: list[tuple[int, int]], by: str = "[MASKED]") -> str:
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def _over(batches: Iterator[pa.RecordBatch], made) -> Iterator[pa.RecordBatch]:
    """``made(text, spans)`` for the rows with a secret; a line repeated in a batch is searched once."""
    for batch in batches:
        seen: dict[str, object] = {}
        rows, values = [], []
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            if text is None:
                continue
            if text not in seen:
                spans = find_secrets(text)
                seen[text] = made(text, spans) if spans else None
            if seen[text] is not None:
                rows.append(i)
                values.append(seen[text])
        kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(values, pa.list_(pa.string()) if made is _texts else pa.string())], names=[*kept.schema.names, "made"])


def _texts(text: str, spans: list[tuple[int, int]]) -> list[str]:
    return list(dict.fromkeys(text[s:e] for s, e in spans))


def _screened(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The rows in which a rule can find something; the others never leave the JVM."""
    return df.where(F.rlike(text, F.lit(SCREEN))).select(*keys, F.col(text).alias("_text"))


def secrets(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, secret): each literal secret in ``text``, once for each row and value.

    Candidates are quoted strings, assigned values, option values, parts of addresses and long tokens. Each needs a share of the
    most Shannon entropy that its length and alphabet allow; how large a share depends on what stands around it. Placeholders,
    references to variables, files or commands, and identifiers are none. Public keys, certificates and bare digests
    are none. The scan is one map over the rows, whole texts, without a shuffle.

    Defined cases: null and empty texts hold none; a text in which a secret occurs twice gives it once;
    repeated rows all count; an empty table gives no rows; columns other than those named are not read.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    found = _screened(df, keys, text).mapInArrow(lambda it: _over(it, _texts), f"{schema}, made array<string>")
    return found.select(*keys, F.explode("made").alias("secret"))


def redacted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text): the rows that hold a secret, with only the secrets masked; the rest of the text stays as it is."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    masked = _screened(df, keys, text).mapInArrow(lambda it: _over(it, mask), f"{schema}, made string")
    return masked.withColumnRenamed("made", text)
