"""Problem 4: credentials embedded in source code, found and masked.

Method: configuration formats (JSON, YAML, INI, TOML, properties, env) are parsed into key
paths with offsets by the readers of `config`; in code and comments, quoted and bare values are
tied to the name they are assigned or handed to, across lines and through wrapping keys such as
`value`. A credential is a value whose shape fits a sensitive key, a value of a shape that is a
credential anywhere (provider prefixes, signed tokens, private keys, logins in URLs and command
arguments, secret hook URLs), or a password-like token that a comment tells of. Redactions
are spliced into the original bytes by byte offset, so everything around a value stays as it is.
A value is masked whole: literals joined to one value are one range with the code that joins
them (a literal in other quotes starts a further range), a key without an END line ends with its text.
One map over the rows without a shuffle; only found keys are made distinct.

Defined cases: null and empty texts give nothing; a null evidence gives nothing for evidence;
repeated rows give each key once in credential_lines; line numbers count LF.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import FORMATS, leaves
from ..grammar import extension
from .rows import map_rows

FOUND = "origin string, record_id long, line_no long, kind string, key_path string, start_pos long, end_pos long, start_byte long, end_byte long"
MASK = "[REDACTED]"

# fixed values: shapes that are credentials wherever they stand
SHAPES = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?P<aws>(?:AKIA|ASIA)[0-9A-Z]{4,})"
    r"|(?P<token>gh[pousr]_[A-Za-z0-9]{4,}|github_pat_[A-Za-z0-9_]{8,}|glpat-[A-Za-z0-9_-]{6,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{4,}|xox[abeoprs]-[A-Za-z0-9-]{6,}|SG\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]+)?|npm_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{20,}|pypi-[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|sk-[A-Za-z0-9_-]{20,}|ya29\.[A-Za-z0-9_-]{20,})"
    r"|(?P<signed>eyJ[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*){0,2})"
    r"|(?P<scheme>(?:Bearer|Basic|bearer|basic|Token)[ ]+(?=[A-Za-z0-9+/_.=-]{8}))"
    r")"
    r"|(?P<pem>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
    r"|(?<![A-Za-z0-9+.-])(?P<login>[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"<>`]*:)(?=[^\s/@'\"`]+@)"
    r"|(?P<hook>https?://[^\s'\"/]*hooks?[^\s'\"/]*/[^\s'\"]*?(?:services|webhooks?|hooks?|workflows)/|https?://[^\s'\"/]+/api/webhooks/|https?://hooks?\.[^\s'\"/]+/)"
)
FULL = {"AKIA": 20, "ASIA": 20, "ghp_": 40, "gho_": 40, "ghu_": 40, "ghs_": 40, "ghr_": 40, "glpa": 26, "sk_l": 32, "rk_l": 32, "sk_t": 32, "rk_t": 32, "xoxb": 50, "xoxp": 50, "SG.": 60}
# fixed values: words of a key that make its value a credential, alone or two together
SENSITIVE = set("password passwd pwd pass passphrase passcode passwort kennwort contrasena contraseña clave senha motdepasse parola secret secrets token tokens bearer apikey credential credentials auth authorization private jwt dsn pat session cookie pin salt signature connectionstring".split())
PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("account", "key"), ("auth", "key"), ("stripe", "key"), ("mail", "key"), ("deploy", "key"), ("service", "key"), ("client", "key"), ("ssh", "key"), ("license", "key"), ("storage", "key"), ("de", "passe"), ("app", "key"), ("hmac", "key"), ("session", "key"), ("webhook", "key"), ("shared", "key")}
# fixed values: words that turn such a key into something about a credential
ABOUT = set("hint label field name names ref reference type count policy length size url uri path file filename public placeholder pattern regex re prompt title text message description help env var variable key_name min max ttl expiry expires expire lifetime enabled required rotation version id index column header_name param parameter checksum hash sha digest fingerprint limit quota budget page class method mode format status state kind scope scopes issuer audience provider algorithm alg store manager service handler factory util utils test".split())
RUN_TOGETHER = re.compile(r".(?:password|passwd|passphrase|pwd|secret|token|jwt|apikey|(?:access|secret|signing|private|encryption|master|account|deploy)key)$")
WRAPPERS = set("value val default current data raw plain plaintext content text literal string secret_value".split())
TYPES = set("string str String null None const let var final static private public protected export readonly char number any undefined new f r b u rb or and is as byte bytes Optional Union self this".split())
MASKED = re.compile(r"\*{3,}|x{6,}|X{6,}|•{3,}|\.{4,}|#{4,}|<[^<>]*>|\[(?:REDACTED|MASKED|FILTERED|REMOVED|HIDDEN|SECRET)[^\]]*\]|\{\{|\$\{|\$\(|%\(|%[A-Z_]+%|redacted|masked", re.I)
PLACEHOLDER = re.compile(
    r"(?:your|my|example|sample|dummy|fake|test|changeme|change[-_ ]?me|placeholder|insert|enter|replace|todo|tbd|foo|bar|baz|none|null|nil|true|false|undefined|empty|default|secret|password|passwd|token|key|user|admin|root|guest|xxx+|abc123|123456\d*|dummy)(?:[-_ ]?(?:your|here|me|value|key|api|token|secret|password|pass|id|example|user|goes|this|name|field|type|bearer|basic|123\d*))*\Z",
    re.I,
)
SPOKEN = re.compile(r"(?i)(?:\b|_)(?:your|replace|change[-_ ]?me|changeme|insert|placeholder|example|dummy|sample|redacted|todo)(?:\b|_)")
REFERENCE = re.compile(r"(?:vault|secretsmanager|ssm|sm|arn|op|gcp|aws|azure|kv|env|file|ref|secret|keyring|doppler)[:/]|process\.env|os\.environ|getenv|System\.|ENV\[|config[.\[(]|\$[A-Za-z_{(]", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[a-zà-ÿ]+|[0-9]+")
LITERAL = re.compile(r"\"\"\"|'''|\"(?:[^\"\\\n]|\\.)*(?:\"|\Z)|'(?:[^'\\\n]|\\.)*(?:'|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z)")
IDENT = re.compile(r"(?<![\w.À-ÿ-])[A-Za-z_À-ÿ][\w.À-ÿ-]*")
BARE = re.compile(r"^[\s#/;*>\-!]*(?:export\s+|set\s+|-\s+|ENV\s+|ARG\s+)?[\"']?(?P<key>[A-Za-z_À-ÿ][\w .À-ÿ-]{0,60}?)[\"']?\s*(?P<sep>:=|=>|=|:)[ \t]*(?P<value>[^\s\"'`][^\n]*?)?[ \t\r]*$")
INLINE = re.compile(r"(?<![\w.À-ÿ-])(?P<key>[A-Za-z_À-ÿ][\w.À-ÿ-]*)\s*[:=]\s*(?P<value>[^\s\"'`,;)(]+)")
ARGUMENT = re.compile(r"--?(?P<key>[A-Za-z][\w-]*)[= ](?P<value>[^\s\"'`]+)")
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|;|--|<!--)")
OTHERWISE = re.compile(r"(?:\|\||\?\?|\?:|\bor|\belse|:-)\s*$")
FOLLOWS = re.compile(r"[=:,(\[{|?>]\s*[\w]{0,2}$|(?:or|else|return)\s*$")
CONTINUED = re.compile(r"[ \t]*\)?[ \t]*(?:\+|\.|\\|&|\|\|)?[ \t]*\r?\n[ \t]*(?:\+|\.|&)?[ \t]*(?=[\"'`])|[ \t]*(?:\+|\.)[ \t]*(?=[\"'`])")
BEARER, HOOKED, TOKEN = re.compile(r"[A-Za-z0-9+/_.=~-]*"), re.compile(r"[^\s'\"`<>)\\]*"), re.compile(r"[A-Za-z0-9_.-]*")
#: A line of a key: what stands around it in code, its text or a header, and what does not belong to a key.
KEY_LINE = re.compile(r"(?:[\s\"'.,`|>#*();&+]|\\[nrt\n]|//|/\*)*(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):(?:(?!\\n)[^\n])*|(?P<core>[A-Za-z0-9+/=]+)(?=\s*(?:\\[nrt\r\n]|[\"'`]|[ \t]*(?:\*/|-->)?\s*(?:\n|\Z)))|(?P<other>\S))")
END_MARK = re.compile(r"-----END(?:[^\n-]*-----)?")
#: Arguments of commands that are a login or a password.
COMMANDS = re.compile(r"\b(?:(?P<login>curl|wget|https?|httpie)|sshpass|mysql\w*|mariadb\S*|mongo\w*|redis-cli|ldap\w+|docker login|rabbitmq\w*|zip|unzip|7z|az login|sqlcmd|cqlsh)[ \t](?P<rest>[^\n|;]*)")
LOGIN_ARGUMENT = re.compile(r"(?:^|(?<=\s))(?:-u|--user|--proxy-user|-a|--auth)[ =]?(?:\"[^\":\n]*:(?P<d>[^\"\n]+)|'[^':\n]*:(?P<s>[^'\n]+)|[^\s:\"'@/]+:(?P<p>[^\s\"'`]+))")
PASSWORD_ARGUMENT = re.compile(r"(?:^|(?<=\s))-[pawP] ?(?:\"(?P<d>[^\"\n]+)|'(?P<s>[^'\n]+)|(?P<p>[^\s\"'`-][^\s\"'`]*))")
# fixed values: words that tell of a credential in running text
TELLING = "pw pwd pass password passwords passwd passphrase passcode login logins cred creds credential credentials secret token passwort kennwort zugang senha contraseña contrasena clave пароль".split() + ["api key", "mot de passe"]
TELLING_UNSPACED = "密码 口令 パスワード 비밀번호".split()
TOLD = re.compile(r"[^\s\"'`,;()<>\[\]{}]{8,}")
#: Names, numbered words, paths and the like, which running text is full of.
SPEECH = re.compile(r"[A-Za-z]++(?:[_.-][A-Za-z]++)*+\d{0,3}|[a-z]++(?:[_-][a-z0-9]++)*+|[\w.-]*/[\w./-]*|[\w.+-]+@[\w.-]+|[0-9a-fA-F-]+|v?\d[\w.-]*|[a-z]+(?:_[a-z]+)*=\S*|[A-Z_]+=\S*|\S*[:|]\S*|--?\S+")
CONFIG = {"env", "yaml", "yml", "ini", "cfg", "conf", "toml", "properties", "sh", "md", "txt", ""}
#: Every name that keyed_hits may take for a key, wherever it stands and whatever follows it: one word, or several at the start of a line.
NAME = re.compile(r"[A-Za-z_À-ÿ][\w.À-ÿ-]*+")
SPACED = re.compile(r"(?m)^[\s#/;*>\-!]*+(?:export\s+|set\s+|-\s+|ENV\s+|ARG\s+)?[\"']?([A-Za-z_À-ÿ][\w.À-ÿ-]*+(?:[ ]++[\w.À-ÿ-]++)++)[ ]*+[\"']?\s*[:=]")
VALUE = re.compile(r"(?i)value(?![a-z])[^\n]*?[\"'`]")
AS_KEY = re.compile(r"\s*(?::|=>|\]\s*(?:=[^=]|\?\?))")
#: The parts without which no shape can match.
PARTS = ("AKIA", "ASIA", "gh", "github_pat_", "glpat-", "_live_", "_test_", "xox", "SG.", "npm_", "AIza", "pypi-", "hf_", "dop_v1_", "sk-", "ya29.", "eyJ", "earer ", "asic ", "Token ", "PRIVATE KEY", "://")


def key_words(key: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(key)]


_KEYS: dict[str, bool] = {}


def sensitive(key: str) -> bool:
    """Does this key name hold a credential?"""
    got = _KEYS.get(key)
    if got is None:
        w = [x for x in key_words(key.rpartition(".")[2] or key) if not x.isdigit()]
        hit = any(x in SENSITIVE for x in w) or any(p in PAIRS for p in zip(w, w[1:], strict=False)) or "".join(w) in SENSITIVE or bool(w) and bool(RUN_TOGETHER.search(w[-1]))
        last = max((k for k, x in enumerate(w) if x in SENSITIVE or x == "key"), default=-1)
        if hit and any(x in ABOUT for x in w[last + 1 :]) and not (w[-1] == "id" and w[-2:-1] == ["key"]):
            hit = False
        if hit and "public" in w:
            hit = False
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        got = _KEYS[key] = hit
    return got


def strong(key: str) -> bool:
    """Keys under which even plain words are a passphrase."""
    return bool(set(key_words(key)) & {"password", "passwd", "pwd", "pass", "passphrase", "passwort", "kennwort", "contrasena", "contraseña", "senha", "passe", "secret", "clave", "parola"})


def no_secret(v: str) -> bool:
    """Masked or removed values, placeholders, references and the like."""
    return not v or bool(MASKED.search(v) or PLACEHOLDER.match(v) or SPOKEN.search(v) or REFERENCE.match(v))


def credential_shape(v: str, key: str, cut_off: bool = False) -> bool:
    """Could this be the value of a sensitive key, and not a label, a name, a path, a number or code?"""
    if no_secret(v):
        return False
    n = len(v)
    if n < (4 if cut_off else 6) or any(c in " \t\n" for c in v.strip()):
        return False
    v = v.strip()
    if re.fullmatch(r"[A-Za-z0-9+/]{32,}={0,2}", v) and all(len(re.findall(p, v)) > 3 for p in (r"\d", "[A-Z]", "[a-z]")):
        return True
    if re.fullmatch(r"[\d.,:+\- _]+", v):
        return n >= 8 and v.isdigit() and strong(key)
    if re.fullmatch(r"[^\W\d_]+[.!?,;:…]*", v):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*(?:\(.*\))?;?", v) and not (re.search(r"\d", v) and re.search(r"[A-Za-z]", v)):
        return False
    if re.fullmatch(r"(?:[\w.-]+/)+[\w.-]*", v) and (re.search(r"\.[a-z]{1,5}$", v) or not re.search(r"\d", v)):
        return False
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", v) or v.startswith(("/", "./", "../", "ssh-", "sha", "[", "{", "(", "\\", "^")):
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v):
        return strong(key)
    if re.search(r"\[[^\]]*\]|\\[dwsS]|[({].*[)}]", v):
        return False
    if re.fullmatch(r"[a-z]+(?:-[a-z]+){2,}", v):
        return strong(key) or "token" in key_words(key) or sensitive(key)
    digit, upper, lower, mark = (bool(re.search(p, v)) for p in (r"\d", "[A-Z]", "[a-z]", r"[^A-Za-z0-9\s]"))
    kinds = digit + upper + lower + mark
    if re.fullmatch(r"[a-z]+(?:[_-][a-z0-9]+)*", v) and not re.search(r"\d.*[a-z].*\d|[a-z]\d[a-z]", v):
        return False
    return kinds >= 2 and (digit or kinds >= 3)


class Hit:
    """start and end are those of the first range; `more` has the ranges of literals in other quotes."""

    __slots__ = ("start", "end", "kind", "path", "more")

    def __init__(self, start: int, end: int, kind: str, path: str, more: tuple[tuple[int, int], ...] = ()):
        self.start, self.end, self.kind, self.path, self.more = start, end, kind, path, more

    @property
    def ranges(self) -> list[tuple[int, int]]:
        return [(self.start, self.end), *self.more]


def following(text: str, end: int) -> Iterator[tuple[int, int, bool]]:
    """Inner ranges of the literals joined to the one that ends at `end`, and whether each is closed."""
    while c := CONTINUED.match(text, end):
        nxt = LITERAL.match(text, c.end())
        if not nxt or nxt.group() in ('"""', "'''") or text[nxt.end() : nxt.end() + 1] == ":":
            return
        if text[c.end()] == "`" and not c.group().strip(" \t\r\n)"):  # a fence or another statement: these need an operator
            return
        end = nxt.end()
        closed = end - nxt.start() > 1 and text[end - 1] == text[nxt.start()]
        if end - nxt.start() > 2 or not closed:
            yield nxt.start() + 1, end - 1 if closed else end, closed
        if not closed:
            return


def spread(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of joined literals, neighbours in the same quotes made one."""
    out = ranges[:1]
    for a, b in ranges[1:]:
        if text[a - 1] == text[out[-1][1]]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def whole(text: str, start: int, end: int, kind: str, chars: re.Pattern) -> Hit:
    """A token with what it goes on with in literals joined to its own."""
    ranges = [(start, end)]
    if text[end : end + 1] in ("\"", "'", "`"):
        for a, b, _ in following(text, end + 1):
            stop = chars.match(text, a, b).end()
            if stop > a:
                ranges.append((a, stop))
            if stop < b:
                break
    return Hit(*spread(text, ranges)[0], kind, "", tuple(spread(text, ranges)[1:]))


def key_end(text: str, at: int) -> int:
    """End of the key whose BEGIN mark ends at `at`: behind its END mark, or behind the last line of its text."""
    close, again = text.find("-----END", at), text.find("-----BEGIN", at)
    stop = len(text) if close < 0 else close
    if 0 <= close < at + 20_000 and not 0 <= again < close:
        return END_MARK.match(text, close).end()
    last, width = at, 0
    for m in KEY_LINE.finditer(text, at, stop):
        core = m["core"]
        if not core:
            if m["other"]:
                return last
            continue
        ends = m.end("core") >= len(text) - 1 or m.end("core") == stop
        if not (len(core) == width or len(core) >= 32 or ends or core.endswith("=") or re.search(r"\d", core) and re.search("[A-Za-z]", core)):
            return last
        last, width = m.end("core"), width or len(core)
    return END_MARK.match(text, close).end() if close >= 0 and not 0 <= again < close else last


def shape_hits(text: str) -> Iterator[Hit]:
    """Values that are credentials by their own shape."""
    n = len(text)
    for m in SHAPES.finditer(text):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "pem":
            rest = text[end : end + 400]
            body = re.sub(r"\\[nr]|[\s\"'+.,\\`|>#/*()]+|(?:Proc-Type|DEK-Info):[^\n]*", "", rest)
            if rest.strip(" \r\n\t\\\"'`;,)") == "" and end + len(rest) >= n:
                yield Hit(at, end, kind, "")
            elif not MASKED.match(body) and re.match(r"[A-Za-z0-9+/=]{8,}", body):
                yield Hit(at, key_end(text, end), kind, "")
            elif len(body) < 8 and end + len(rest) >= n and re.fullmatch(r"[A-Za-z0-9+/=]+", body):
                yield Hit(at, n, kind, "")
        elif kind == "scheme":
            v = BEARER.match(text, end).group()
            if m.group().strip().lower() == "basic":
                try:
                    ok = b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
                except (binascii.Error, ValueError):
                    ok = False
                ok = ok or end + len(v) >= n
            else:
                ok = len(v) >= 16 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v))
            if ok and not no_secret(v):
                yield whole(text, end, end + len(v), "header", BEARER)
        elif kind == "login":
            v = text[end : text.index("@", end)]
            if not no_secret(v) and not re.fullmatch(r"[A-Z_]+|\d+|\{\w+\}|:\w+|%s", v) and not v.startswith("$") and "{" not in v:
                yield Hit(end, end + len(v), "login", "")
        elif kind == "hook":
            v = HOOKED.match(text, end).group()
            parts = [x for x in v.split("/") if x]
            last = parts[-1] if parts else ""
            if len(last) >= 16 and re.search(r"\d", last) and not MASKED.search(v) or end + len(v) >= n and len(parts) > 1 and not MASKED.search(v):
                yield whole(text, end, end + len(v), "hook", HOOKED)
        else:
            v = m.group()
            tail = text[end : end + 2]
            full = FULL.get(v[:4] if not v.startswith("SG.") else "SG.", 0)
            if MASKED.search(v) or tail[:1] in ("*", "[", "{", "<", "\\", "$") or re.search(r"(?i)example|x{5,}|0{8,}|your", v):
                continue
            partial = len(v) < full
            if partial and not (end >= n - 1 or CONTINUED.match(text, end + 1) or tail[:1] == "\\"):
                continue
            if kind == "signed" and "." not in v and not (end >= n - 1 or CONTINUED.match(text, end + 1)):
                continue
            if kind == "aws" and len(v) > 20:
                continue
            yield whole(text, at, end, kind, TOKEN) if partial or not full else Hit(at, end, kind, "")


def key_of(path: tuple[str, ...]) -> str:
    """The key that a value stands under: the last one that is no index and no wrapper such as `value`."""
    own = [k for k in path if not k.isdigit()]
    while len(own) > 1 and own[-1].rpartition(".")[2].lower() in WRAPPERS:
        own.pop()
    return own[-1] if own else ""


def config_hits(text: str, ext: str) -> Iterator[Hit]:
    """Values under sensitive keys of a configuration format."""
    for leaf in leaves(text, ext):
        key = key_of(leaf.path)
        v = text[leaf.start : leaf.end]
        if key and sensitive(key):
            if credential_shape(v, key, leaf.cut_off):
                yield Hit(leaf.start, leaf.end, "keyed", ".".join(leaf.path))
            elif ext not in ("json", "env") and " " in v:  # an inner assignment, as in a connection string
                for m in INLINE.finditer(text, leaf.start, leaf.end):
                    if sensitive(m["key"]) and credential_shape(m["value"], m["key"], leaf.cut_off and m.end() == leaf.end):
                        yield Hit(*m.span("value"), "keyed", ".".join((*leaf.path, m["key"])))
        elif key.lower() in WRAPPERS and len(leaf.path) == 1 and leaf.start > 0 and text[text.rfind("\n", 0, leaf.start) + 1] in " \t" and credential_shape(v, "secret", leaf.cut_off) and len(v) > 12:
            yield Hit(leaf.start, leaf.end, "keyed", leaf.path[0])  # the key it stands under lies before this text


def argument_hits(text: str) -> Iterator[Hit]:
    """Logins and passwords among the arguments of commands."""
    for command in COMMANDS.finditer(text):
        pattern, kind = (LOGIN_ARGUMENT, "login") if command["login"] else (PASSWORD_ARGUMENT, "argument")
        for m in pattern.finditer(text, *command.span("rest")):
            group = next(k for k in "dsp" if m[k] is not None)
            a, b = m.span(group)
            v = text[a:b]
            if not no_secret(v) and (credential_shape(v, "password", b >= len(text) - 1) or len(v) >= 8 and re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and not v.startswith(("$", "{"))):
                yield Hit(a, b, kind, "")


def telling_places(text: str) -> list[tuple[int, int]]:
    """Places of words that tell of a credential, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for words, spaced in ((TELLING, True), (TELLING_UNSPACED, False)):
        for w in words:
            k = low.find(w)
            while k >= 0:
                end = k + len(w)
                if not spaced or not (low[k - 1 : k].isalpha() or low[end : end + 1].isalnum() or low[end : end + 1] == "_"):
                    out.append((k, end))
                k = low.find(w, k + 1)
    return sorted(out)


def told_hits(text: str, ext: str) -> Iterator[Hit]:
    """Password-like tokens behind a word that tells of a credential, in comments and running text."""
    n, done = len(text), 0
    for start, end in telling_places(text):
        if start < done:
            continue
        low, high = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        done = high = n if high < 0 else high
        before = text[low:start]
        if not (ext in ("md", "txt") and not text.startswith(("    ", "\t"), low) or re.match(r"\s*(?:#|//|/\*|\*|;|--|<!--)", before) or re.search(r"(?:\s#|//|/\*|<!--)[^\n\"']*$", before)):
            continue
        for t in TOLD.finditer(text, end, high):
            v = t.group().rstrip(".,;:!?*")
            if re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and re.search(r"[^\w]|_|[A-Z]", v) and not SPEECH.fullmatch(v) and credential_shape(v, "password", t.end() >= n - 1):
                yield Hit(t.start(), t.start() + len(v), "told", "")
                break


def keyed_hits(text: str, ext: str, names: set[str], comments: bool = False) -> Iterator[Hit]:
    """Values under sensitive names in code and running text; only those in comment lines if asked."""
    keys = [k for k in {*names, *SPACED.findall(text), *(m["key"] for m in ARGUMENT.finditer(text))} if sensitive(k)]
    if not keys and not VALUE.search(text):
        return
    config = ext in CONFIG or ext == "json"
    at, n = 0, len(text)
    open_keys: list[tuple[int, str]] = []  # keys whose block is open, with their indentation
    waiting = ""  # a key whose value starts on a later line
    done = 0  # end of the last value with all its parts
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if not line.strip() or comments and not COMMENT.match(line):
            continue
        body = line.rstrip()
        depth = len(line) - len(line.lstrip(" \t"))
        while open_keys and open_keys[-1][0] >= depth and not body.lstrip().startswith(("}", ")", "]")):
            open_keys.pop()
        parent = next((k for _, k in reversed(open_keys) if sensitive(k)), "") if open_keys else ""
        near = parent or any(k in line for k in keys) or depth and not open_keys and "value" in line
        literals = list(LITERAL.finditer(line)) if (near or waiting) and any(q in line for q in "\"'`") else []
        if waiting:
            got = None
            if literals and literals[0].group() not in ('"""', "'''"):
                got = joined(text, start + literals[0].start(), n)
            elif not literals:
                v = body.strip()
                got = ([(start + depth, start + depth + len(v))], v, start + depth + len(v) >= n, 0)
            if got:
                done = max(done, got[3])
            if got and credential_shape(got[1], waiting, got[2]):
                yield Hit(*got[0][0], "keyed", waiting, tuple(got[0][1:]))
            waiting = ""
            if got:
                continue
        if not near:
            if body.endswith(("{", "[", "(", ":")):
                ids = IDENT.findall(body)
                if ids:
                    open_keys.append((depth, next((x for x in reversed(ids) if x not in TYPES), ids[-1])))
            continue
        comment = bool(COMMENT.match(line))
        bare_to = len(line) - len(line.lstrip(" \t-,([{"))
        every = [(x.end(), x.group()) for x in IDENT.finditer(line) if x.group() not in TYPES and x.group().rpartition(".")[2] not in TYPES] if literals else []
        ends = [x[0] for x in every]
        for m in literals:
            if start + m.start() < done:
                continue
            if m.group() in ('"""', "'''"):
                break
            last = bisect_right(ends, m.start())
            key = every[last - 1][1] if last else ""
            if last > 1 and not sensitive(key) and OTHERWISE.search(line, 0, m.start()):  # a = read(b) or "value"
                key = next((x for _, x in reversed(every[max(0, last - 4) : last - 1]) if sensitive(x)), key)
            if key.rpartition(".")[2] in ("get", "env", "environ", "getenv", "Setenv", "put", "define", "setProperty", "getProperty", "set", "add", "connect") and not line[: m.start()].rstrip().endswith("="):
                key = ""
            leaf = key.rpartition(".")[2]
            if leaf.lower() in WRAPPERS and parent:
                key = parent
            elif leaf.lower() == "value" and depth and not open_keys and len(literals[-1].group()) > 14:
                key = "secret"  # the key it stands under lies before this text
            if not key and parent and m.start() <= bare_to:
                key = parent
            if not key or not sensitive(key):
                continue
            if AS_KEY.match(line, m.end()):
                continue  # the literal is itself a key
            before = line[: m.start()]
            if not FOLLOWS.search(before[-24:].rstrip() + " ") and before.strip():
                continue
            ranges, v, cut_off, done = joined(text, start + m.start(), n)
            if credential_shape(v, key, cut_off):
                yield Hit(*ranges[0], "keyed", key, tuple(ranges[1:]))
        if not literals or comment or config:
            m = BARE.match(line) if config or comment else None
            if m:
                key, v = m["key"].strip(), m["value"]
                if key.rpartition(".")[2].lower() in WRAPPERS and parent:
                    key = parent
                if v in (None, "|", ">", "|-", ">-", "(", "\\") and not literals:
                    if v is None or v in "{[":
                        open_keys.append((depth, key))
                    if v is not None and sensitive(key):
                        waiting = key
                    continue
                if v in ("{", "["):
                    open_keys.append((depth, key))
                    continue
                if v and not literals and sensitive(key):
                    v = re.split(r"\s+[#;]", v)[0].rstrip(" ,;")
                    p = start + m.start("value")
                    if " " in v and comment:
                        v = v.split(" ")[0].rstrip(".,;")
                    if credential_shape(v, key, p + len(v) >= n - 1):
                        yield Hit(p, p + len(v), "keyed", key)
                        continue
            if comment or config:
                for pattern in (INLINE, ARGUMENT):
                    for m in pattern.finditer(line):
                        if sensitive(m["key"]):
                            v = m["value"].rstrip(".,;")
                            p = start + m.start("value")
                            if credential_shape(v, m["key"], p + len(v) >= n - 1):
                                yield Hit(p, p + len(v), "keyed", m["key"])
        if body.endswith(("{", "[")):
            ids = [x for x in IDENT.findall(body) if x not in TYPES]
            if ids:
                open_keys.append((depth, ids[-1]))
        elif (body.endswith(("(", "=", "=>", "\\", ":")) or re.search(r"[:=]\s*[|>][-+]?$", body)) and not comment:
            ids = [x for x in IDENT.findall(body) if x not in TYPES]
            if ids:
                if sensitive(ids[-1]):
                    waiting = ids[-1]
                if body.endswith(("(", ":")):
                    open_keys.append((depth, ids[-1]))


def joined(text: str, at: int, n: int) -> tuple[list[tuple[int, int]], str, bool, int]:
    """A literal and the literals it is joined to: their ranges, the whole value, whether the text ends inside, and the end of the last."""
    m = LITERAL.match(text, at)
    if m is None:  # a quote that its line does not close
        end = text.find("\n", at)
        end = n if end < 0 else end
        return [(at + 1, end)], text[at + 1 : end], end >= n, end
    closed, end = m.end() - m.start() > 1 and text[m.end() - 1] == text[at], m.end()
    ranges = [(at + 1, end - 1 if closed else end)]
    if closed:
        for a, b, closed in following(text, end):
            ranges.append((a, b))
            end = b + closed
    cut_off = not closed or bool(re.match(r"\s*[+.\\]?\s*\Z", text[end : end + 6])) and text[end : end + 1] not in (";", ",", ")")
    return spread(text, ranges), "".join(text[a:b] for a, b in ranges), cut_off, end


def find_credentials(text: str | None, ext: str = "") -> list[Hit]:
    """All credentials of a text by place, overlapping ones merged to the first."""
    if not text:
        return []
    shaped = shape_hits(text) if any(p in text for p in PARTS) else ()
    names = set(NAME.findall(text))
    keyed = (*config_hits(text, ext), *keyed_hits(text, ext, names, True)) if ext in FORMATS else keyed_hits(text, ext, names)
    argued = argument_hits(text) if " -" in text else ()
    hits = sorted([*shaped, *keyed, *argued, *told_hits(text, ext)], key=lambda h: (h.start, -h.end))
    out: list[Hit] = []
    for h in hits:
        if out and any(a <= h.start < b for a, b in out[-1].ranges):
            ranges = out[-1].ranges
            for a, b in h.ranges:
                if a < ranges[-1][1]:
                    ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
                else:
                    ranges.append((a, b))
            out[-1] = Hit(*ranges[0], out[-1].kind, out[-1].path, tuple(ranges[1:]))
            continue
        out.append(h)
    return out


def redact(text: str | None, ext: str = "") -> str | None:
    """The text with each value masked and everything else as it was."""
    hits = find_credentials(text, ext)
    if not hits:
        return text
    raw, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in byte_ranges(text, [r for h in hits for r in h.ranges]):
        parts += [raw[at:a], MASK.encode()]
        at = b
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def byte_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ranges, which are in order, counted in bytes of UTF-8."""
    if text.isascii():
        return ranges
    out, at, size = [], 0, 0
    for a, b in ranges:
        first = size + len(text[at:a].encode("utf-8", "surrogatepass"))
        size = first + len(text[a:b].encode("utf-8", "surrogatepass"))
        out.append((first, size))
        at = b
    return out


def _finder():
    def one(origin, record_id, path, text):
        hits = find_credentials(text, extension(path))
        if not hits:
            return
        inside = iter(byte_ranges(text, [r for h in hits for r in h.ranges]))
        line, at = 1, 0
        for h in hits:
            line += text.count("\n", at, h.start)
            at = h.start
            for a, b in h.ranges:
                yield origin, record_id, line, h.kind, h.path, a, b, *next(inside)

    return one


def _redactor():
    def one(origin, record_id, path, text):
        got = redact(text, extension(path))
        if got != text:
            yield origin, record_id, got

    return one


def texts(files: DataFrame, matches: DataFrame) -> DataFrame:
    """The three kinds of text with their keys; likely ones only, by a cheap test in the JVM."""
    a = files.select(F.lit("file").alias("origin"), F.col("snapshot_id").alias("record_id"), "file_path", F.col("content").alias("text"))
    m = matches.select("match_id", "file_path", "snippet", F.col("evidence.code_snippet").alias("code"))
    b = m.select(F.lit("match").alias("origin"), F.col("match_id").alias("record_id"), "file_path", F.col("snippet").alias("text"))
    c = m.select(F.lit("evidence").alias("origin"), F.col("match_id").alias("record_id"), "file_path", F.col("code").alias("text"))
    return a.unionAll(b).unionAll(c).where(F.length("text") > 0)


def credentials(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Every credential with its place and key; one row for each of its ranges, with the line of the first."""
    return map_rows(texts(files, matches), _finder, FOUND)


def credential_lines(files: DataFrame, matches: DataFrame) -> DataFrame:
    return credentials(files, matches).select("origin", "record_id", "line_no").distinct()


def redacted(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Texts that held credentials, with their values masked."""
    return map_rows(texts(files, matches), _redactor, "origin string, record_id long, text string").distinct()
