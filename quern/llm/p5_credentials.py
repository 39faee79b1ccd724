"""Problem 5: credentials in source code, labelled by a linear-chain conditional random field over lexical tokens."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.crf import LinearChain, fit
from quern.llm.p5_training import training_texts

LABELS = ("O", "B", "I")
#: Token texts, and lines, whose results a process keeps.
KEPT = 1 << 17

# --- lexical tokens ------------------------------------------------------------------------------------------------

PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+?)-----")
PEM_END = re.compile(r"-----END ")
PEM_LINE = re.compile(r"^[\s/#*;'\"+.|<>!-]*?(=[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}|[A-Za-z0-9+/]{4,})(?:\\n)?['\"]?[\s;,+.]*(?:-->|\*/)?\s*$")
#: Between a block's first mark and its body: header fields, and lines without a sign of their own.
PEM_HEAD = re.compile(r"^[\s/#*;'\"+.|<>!-]*(?:[A-Z][A-Za-z-]*: [^\n]*?)?(?:\\n)*['\"]?[\s;,+.]*$")
TOKEN = re.compile(
    r"""(?P<uri>[A-Za-z][A-Za-z0-9+.\-]*://[^\s"'`<>]+)
    |(?P<string>"(?:[^"\\]|\\.)*"|(?<![A-Za-z0-9])'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<hole>\$\{[^}]*\}|\$\([^)]*\)|\{\{.*?\}\}|<[A-Za-z][A-Za-z0-9_.:\ \-]*>|%\([^)]*\)s)
    |(?P<op>:=|=>|==|!=|->|[=:])
    |(?P<word>[^\s=:;,()\[\]{}<>"'`]+(?:={1,2}(?=$|["'`\s]))?)
    |(?P<punct>[;,()\[\]{}<>"'`])""",
    re.X,
)
URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^\s:/@]*):([^\s/]*)@")
ADDRESS = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(?:\?([^#]*))?")
DSN = re.compile(r"^\s*[A-Za-z][\w .]*=[^;]*;.*=")
CONFIG = re.compile(r"^\s*(?:export\s+|ENV\s+|set\s+)?([A-Za-z_][\w.\-]*)\s*[=:]\s*([^\s\"'`{\[(<$][^\s]*?)(?<![;,{(\[])\s*$")
GLUED = re.compile(r"^(-[pu])([^\-=].{3,})$")


class Token(NamedTuple):
    start: int
    end: int
    text: str
    kind: str  # string, config, word, op, punct, hole, uri, segment, param, pass, user, dsn, glued, prose (a word of a longer string), pem, body


def lex(line: str, at: int = 0, inner: bool = False) -> list[Token]:
    """The tokens of a line (or of the inside of a string), at their places in it."""
    out: list[Token] = []
    if not inner and (m := CONFIG.match(line)) and "(" not in m[2]:
        out += [Token(at + m.start(1), at + m.end(1), m[1], "word"), Token(at + m.end(1), at + m.start(2), "=", "op")]
        return out + value(m[2], at + m.start(2), "config")
    add = out.append
    for m in TOKEN.finditer(line):
        kind, text = m.lastgroup, m[0]
        s = at + m.start()
        if kind == "word":
            if text[0] == "-" and (g := GLUED.match(text)):
                add(Token(s, s + 2, g[1], "word"))
                add(Token(s + 2, s + len(text), g[2], "glued"))
            else:
                add(Token(s, s + len(text), text, "prose" if inner else kind))
        elif kind == "punct" or kind == "op":
            add(Token(s, s + len(text), text, kind))
        elif kind == "string":
            out += literal(text, s)
        elif kind == "uri":
            out += value(text, s, "uri")
        elif text[0] == "<" and f"</{text[1:-1].split(' ', 1)[0]}" in line:  # an element that closes in its line: a name for what it holds
            name = text[1:-1].split(" ", 1)[0]
            out += [Token(s + 1, s + 1 + len(name), name, "word"), Token(s + len(text) - 1, s + len(text), ">", "op")]
        else:
            add(Token(s, s + len(text), text, kind))
    return out


def literal(text: str, s: int) -> list[Token]:
    """A quoted text that begins at s: what is inside."""
    if text[0] == "`":
        return [Token(s, s + 1, "`", "punct"), *lex(text[1:-1], s + 1, True), Token(s + len(text) - 1, s + len(text), "`", "punct")]
    return value(text[1:-1], s + 1, "string")


def address(text: str, at: int) -> list[Token]:
    """An address without a user: what leads to it, the parts of its path and the values of its query."""
    m = ADDRESS.match(text)
    if not m:
        return [Token(at, at + len(text), text, "uri")]
    out = [Token(at, at + m.end(1), m[1], "uri")]
    out += [Token(at + m.start(2) + p.start(), at + m.start(2) + p.end(), p[0], "segment") for p in re.finditer(r"[^/]{4,}", m[2])]
    if m[3]:
        for p in re.finditer(r"([^&=]+)=([^&]*)", m[3]):
            b = at + m.start(3)
            out += [Token(b + p.start(1), b + p.end(1), p[1], "word"), Token(b + p.end(1), b + p.start(2), "=", "op"), Token(b + p.start(2), b + p.end(2), p[2], "param")]
    return out


def value(text: str, at: int, kind: str) -> list[Token]:
    """A literal: whole, or parted where it is an address, a connection string or several words."""
    if "-----BEGIN" in text and PEM_BEGIN.search(text):
        return [Token(at, at + len(text), text, "pem")]
    if "://" in text and (m := URI.match(text)):
        user, word = at + m.start(2), at + m.start(3)
        return [
            Token(at, at + m.end(1), m[1], "uri"),
            Token(user, user + len(m[2]), m[2], "user"),
            Token(word, word + len(m[3]), m[3], "pass"),
            Token(at + m.end(), at + len(text), text[m.end() :], "uri"),
        ]
    if "://" in text and not re.search(r"\s", text):
        return address(text, at)
    if ";" in text and DSN.match(text):
        out = []
        for part in re.finditer(r"([^;=]*)=([^;]*)|[^;]+", text):
            if part[1] is None:
                out.append(Token(at + part.start(), at + part.end(), part[0], "prose"))
            else:
                out += [Token(at + part.start(1), at + part.end(1), part[1], "word"), Token(at + part.end(1), at + part.start(2), "=", "op"), Token(at + part.start(2), at + part.end(2), part[2], "dsn")]
        return out
    if len(text.split(None, 1)) > 1:
        return lex(text, at, True)
    return [Token(at, at + len(text), text, kind)]


def block(lines: list[str], i: int) -> tuple[list[tuple[int, int, int]], int]:
    """Of a key block that begins in line i and goes on: (line, first, last place) of its body's lines, and the first line behind it."""
    body: list[tuple[int, int, int]] = []
    j = i + 1
    while j < len(lines) and not PEM_END.search(lines[j]):
        if m := PEM_LINE.match(lines[j]):
            body.append((j, m.start(1), m.end(1)))
        elif body or not PEM_HEAD.match(lines[j]):
            break
        j += 1
    return body, j


# --- features --------------------------------------------------------------------------------------------------------

#: Words of a name that speak of a secret, and words that turn such a name into something else.
SECRET = frozenset(
    "password passwd pwd pass passphrase passwort passcode clave contrasena kennwort secret secrets token apikey credential credentials "
    "auth authorization bearer dsn pin tok pw masterauth".split()
)
ENDS_SECRET = ("password", "passwd", "passphrase", "passwort", "kennwort", "passcode", "secret", "token", "apikey", "pwd", "pass")
NOT_PASS = frozenset("bypass compass overpass underpass trespass encompass surpass".split())
KEY_OF = frozenset("api access account master encryption private secret license signing shared storage service deploy webhook hmac ssh app client salt seed refresh root session jwt".split())
NOT_IT = frozenset(
    "hint label field type header name names help prompt length len count size url uri path file dir env var regex pattern policy ttl expiry expires "
    "id ids placeholder title text message error field column param kind format max min limit index rules store manager provider".split()
)
PUBLIC = frozenset("public pub cert certificate digest sha sha1 sha256 sha512 md5 checksum hash integrity commit ref revision uuid guid trace etag fingerprint lock version".split())
NEUTRAL = frozenset("old new prod dev test stage staging admin root main default backup tmp temp value val str string b64 base64 v live".split())
TYPES = frozenset("string str &str &'static number String char any text std::string static".split())
HOLE = re.compile(
    r"(?i)^(?:\$\{.*|\$\(.*|\{\{.*|<.*>|%\w+%|%\(.*\)s|\$[A-Z_]+|[*.•x]{3,}|x{4,}.*|0{6,}|1234\w*|replace[_\-]?me|change[_\-]?me|changeit|your[_\-].*|todo|tbd|none|null|nil|true|false|"
    r"dummy.*|example.*|placeholder.*|redacted|\[?redacted\]?|insert.*here|not[_\-]?set|undefined|process\.env.*|os\.environ.*|env\..*|vault:.*)$"
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PROSE = frozenset("is still : / = ops user for until bearer basic token password passphrase secret credentials login with as the was now be set to from comes read".split())
#: Programs that take a password glued to -p, by a short flag, or with the user's name.
MYSQL = frozenset("mysql mysqldump mysqladmin mysqlimport mysqlcheck mysqlsh mariadb mariadb-dump mariadb-admin".split())
LOGIN = frozenset("sshpass docker podman nerdctl helm oc az cf svn 7z zip unzip sqlcmd bcp isql clickhouse-client redis-cli ldapsearch ldapmodify mongo mongosh mongodump cqlsh rabbitmqadmin htpasswd openssl keytool gpg smbclient influx".split())
CURL = frozenset("curl wget http https xh lftp ftp".split())
#: Words before a name and its value that stand in for an assignment.
SETS = frozenset("env arg setenv setx define #define".split())


_FIRM = frozenset(("password", "passwd", "secret"))


def name_class(name: str) -> str:
    parts = [w.lower() for w in WORDS.findall(name)]
    while len(parts) > 1 and (parts[-1] in NEUTRAL or parts[-1].isdigit()):
        parts.pop()
    if not parts:
        return "none"
    last, rest = parts[-1], parts[:-1]
    if last in NOT_IT or parts[0] in ("max", "min", "num", "count", "n"):
        return "about" if not SECRET.isdisjoint(parts) or "key" in parts else "other"
    if last in ("keys", "tokens", "passwords"):
        return "about"
    if not PUBLIC.isdisjoint(parts) and _FIRM.isdisjoint(parts):
        return "public"
    if last in SECRET or (last.endswith(ENDS_SECRET) and last not in NOT_PASS):
        return "secret"
    if last in ("key", "seed", "salt"):
        return "secret" if not KEY_OF.isdisjoint(rest) else "key"
    if last in ("header", "connection", "conn", "cred"):
        return "channel"
    if last in ("hook", "webhook", "callback", "sas", "sig", "signature"):
        return "hook"
    return "other_secret" if not SECRET.isdisjoint(parts) else "other"


def _decoded(v: str) -> str:
    """What a base64 text of plain signs says; '' for any other."""
    try:
        if max(binascii.a2b_base64(v[:4])) >= 128:
            return ""
        return base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return ""


_PLAIN, _DIGIT, _PLAIN_SIGNS = re.compile(r"[a-z]+\Z"), re.compile(r"\d"), re.compile(r"[A-Za-z0-9]+")
_PUBLISHED = re.compile(r"(?:AIza[\w\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|xox[a-z]-\d+-\d+-\w+|github_pat_\w{20,}|[a-z]{2,5}_v\d_[0-9a-f]{32,}|\d{8,10}:[\w\-]{30,})\Z")
_VENDOR = re.compile(r"[A-Za-z]{2,6}(?:[_\-.][a-z]{2,8})?[_\-.](?=[a-z]*[A-Z0-9])(?=[A-Z0-9]*[a-z])([A-Za-z0-9]{16,})\Z")
_NUMBER, _WORDS = re.compile(r"[\d.,_]+\Z"), re.compile(r"[a-z]+(?:[_\-. ][a-z]+)+\Z")
_UUID, _DIGEST = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"), re.compile(r"(?i)(?:sha\d{1,3}|md5)[-:=]")
_HEX, _JWT = re.compile(r"(?:[0-9a-f]{24,}|[0-9A-F]{24,})\Z"), re.compile(r"eyJ[\w\-]+\.(?:eyJ)?[\w\-]+\.[\w\-]*\Z")
_BASE64, _KEY_SIGNS = re.compile(r"[A-Za-z0-9+/]{10,}={0,2}\Z"), re.compile(r"[A-Za-z0-9+/_\-]{16,}\Z")
_ACCOUNT, _COLON = re.compile(r"\{.*\"(?:password|auth|token|secret)\""), re.compile(r"[\w.@\-]+:\S+\Z")
_PATH, _DOMAIN = re.compile(r"(?:/?[\w.@\-]+/)+[\w.\-]*\Z"), re.compile(r"(?:[a-z][a-z0-9\-]*\.)+[a-z]{2,}\Z")
_CONSTANT, _DOTTED = re.compile(r"[A-Z][A-Z_]+\Z"), re.compile(r"[A-Za-z_]+(?:(?:\.|::)[A-Za-z_]+)+\Z")
_STRONG, _ENDS, _MARK = re.compile(r"[^\w\-./]+\Z"), re.compile(r"\.$|[()]"), re.compile(r"[#!?*$%&+^~@]")


def shape(v: str) -> str:
    """One class of a value's form."""
    if not v:
        return "empty"
    if "-----BEGIN" in v:
        return "pem_private" if "PRIVATE KEY" in v else "pem_public"
    if HOLE.match(v):
        return "hole"
    if _PLAIN.match(v):
        return "word" if len(v) < 16 else "long_word"
    if len(v) >= 4 and len(set(v)) <= 2 and not v.isalnum():
        return "mask"
    if _NUMBER.match(v):
        return "number"
    if _WORDS.match(v):
        return "domain" if _DOMAIN.match(v) else "words"
    if _UUID.match(v):
        return "uuid"
    if _DIGEST.match(v):
        return "digest"
    if _HEX.match(v):
        return "hex"
    if v.startswith("eyJ") and _JWT.match(v):
        return "jwt"
    lower, upper, digit = v != v.upper(), v != v.lower(), _DIGIT.search(v) is not None
    if len(v) >= 12 and _BASE64.match(v) and (d := _decoded(v)) and d.isprintable():
        if _ACCOUNT.match(d):
            return "b64_account"
        if _COLON.match(d):
            return "b64_pair"
    if _PUBLISHED.match(v) or (m := _VENDOR.match(v)) and _mixed(m[1]):
        return "vendor"
    body = v.rstrip("=")
    if _KEY_SIGNS.match(body) and _mixed(body):
        return "random" if len(body) < 80 else "blob"
    if lower and not upper:
        if "/" in v and _PATH.match(v):
            return "path"
        if "." in v and _DOMAIN.match(v):
            return "domain"
    if _CONSTANT.match(v):
        return "constant"
    if not digit and _DOTTED.match(v):
        return "dotted"
    special = _PLAIN_SIGNS.sub("", v)
    if digit and (lower or upper):
        if not special:
            return "word_digits"
        if _STRONG.match(special):
            return "strong"
        return "other" if _ENDS.search(v) else "marked_digits_case" if lower and upper else "marked_digits"
    if lower and upper and not special:
        return "camel" if v[0].islower() else ("capital" if v[1:].islower() else "mixed_case")
    if special and _MARK.search(special):
        return "marked"
    if special and lower and upper:
        return "marked_case"
    return "other"


def _mixed(v: str) -> bool:
    """Letters of both cases and digits, changing often: drawn at random rather than spelled."""
    if not (any(map(str.islower, v)) and any(map(str.isupper, v)) and (any(map(str.isdigit, v)) or len(v) >= 24)):
        return False
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in v]
    turns = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
    return turns >= 0.35 * (len(v) - 1)


_CALLS = re.compile(r"(?i)env|vault|config\.get|lookup|fetch|prompt|readline|login|connect|auth|sign_?in|credential|passw|getpass|put|set|add|property|insert|entry|\bof$")
_CALLS_ENV, _CALLS_LOGIN = re.compile(r"(?i)env|vault|config\.get|lookup|fetch|getpass|prompt|readline"), re.compile(r"(?i)login|connect|auth|sign_?in|credential|passw")


def call_class(callee: str) -> str:
    if not _CALLS.search(callee):
        return "call" if callee else "none"
    return "env" if _CALLS_ENV.search(callee) else "login" if _CALLS_LOGIN.search(callee) else "put"


class Context(NamedTuple):
    """All that a token's features are made of. Few are unlike, so that what follows from one is worth keeping."""

    kind: str
    shape: str
    key: str
    before: str
    last: str
    near: str
    flag: str
    call: str
    arg: int
    login: bool
    command: str
    comment: bool
    next_kind: str
    next_mark: str
    body: bool | None
    long: bool


def described(c: Context) -> list[str]:
    """The features of a token in its context."""
    kind, s, k = c.kind, c.shape, c.key
    fs = [
        "1",
        f"kind={kind}",
        f"shape={s}",
        f"key={k}",
        f"{kind}|{s}",
        f"{kind}|{k}|{s}",
        f"{k}|{s}",
        f"{c.last}|{s}",
        f"{c.before}|{c.last}|{s}",
        f"near={c.near}|{c.last}|{s}",
        f"near={c.near}|{kind}|{s}",
        f"flag={c.flag}|{s}",
        f"call={c.call}|{c.arg}|{k}|{s}",
        f"login={c.login}|{c.last}|{s}",
        f"command={c.command}|{c.last}|{kind}",
        f"command={c.command}|{c.last}|{s}",
        f"comment={c.comment}|{k}|{c.last}",
        f"next={c.next_kind}|{kind}",
        f"next={c.next_kind}|{c.next_mark}|{k}|{kind}",
        f"{kind}|{c.comment}|{c.next_mark}|{s}",
    ]
    if c.body is not None:
        fs.append(f"{s}|body={c.body}")
    if c.long:
        fs.append(f"long|{k}|{kind}")
    return fs


#: What may be (part of) a credential.
VALUES = frozenset(("string", "config", "word", "prose", "pass", "dsn", "glued", "segment", "param"))
#: Words that change what stands behind them, and are told apart as such.
TELLING = frozenset("name key value val content login credentials account signin machine #define define".split()) | SETS
FLAGS = frozenset("-p -P -u -U -a -A -w -W -k -K".split())


class Fact(NamedTuple):
    """All that a token by itself says; of unlike tokens many say the same."""

    kind: str
    shape: str
    mark: str  # what the next tokens see of it
    name: str  # its class as a name
    call: str  # its class as what is called
    telling: str
    is_type: bool
    is_flag: bool
    hook: bool
    command: str
    may: bool  # may it be (part of) a credential
    long: bool
    whole: bool  # of a key block: is its end or much of it there
    open: bool  # at the end of a line: does its value stand in the next one


#: The unlike facts so far, and their numbers.
_facts: list[Fact] = []
_number: dict[Fact, int] = {}


@lru_cache(maxsize=KEPT)
def fact_no(kind: str, text: str) -> int:
    """The number of what a token says by itself."""
    f = fact(kind, text)
    if (k := _number.get(f)) is None:
        k = _number[f] = len(_facts)
        _facts.append(f)
    return k


@lru_cache(maxsize=KEPT)
def numbers_of(kind: str, text: str) -> tuple[int, ...] | None:
    """The numbers of the tokens that a match of TOKEN stands for, as lex makes them; None where that depends on the line."""
    if kind == "word" and (text[0] != "-" or not GLUED.match(text)) or kind in ("op", "punct"):
        return (fact_no(kind, text),)
    if kind == "hole":
        return None if text[0] == "<" else (fact_no(kind, text),)
    return tuple([fact_no(t.kind, t.text) for t in (literal(text, 0) if kind == "string" else value(text, 0, kind) if kind in ("uri", "config") else lex(text))])


def line_numbers(line: str) -> tuple[int, ...]:
    """The numbers of lex(line)'s tokens, without making these."""
    if (m := CONFIG.match(line)) and "(" not in m[2]:
        return (fact_no("word", m[1]), fact_no("op", "="), *numbers_of("config", m[2]))
    out: list[int] = []
    for m in TOKEN.finditer(line):
        if (got := numbers_of(m.lastgroup, m[0])) is None:
            return tuple([fact_no(t.kind, t.text) for t in lex(line)])
        out += got
    return tuple(out)


def fact(kind: str, text: str) -> Fact:
    s = shape(text) if kind not in ("op", "punct", "hole", "body") else kind
    low = text.lower()
    named = kind not in ("op", "punct", "body", "pem")
    name = name_class(text.lstrip("-")) if named else "none"
    if kind in ("op", "punct"):
        mark = text
    elif low in PROSE or low in ("#define", "define"):
        mark = low
    elif text.startswith("--"):
        mark = f"flag:{name}"
    elif len(text) == 2 and text[0] == "-":
        mark = text if text in FLAGS else "short"
    else:
        mark = f"w:{name}" if kind == "word" else s
    command = "none"
    if kind == "word":
        base = low.rsplit("/", 1)[-1]
        command = "mysql" if base in MYSQL else "login" if base in LOGIN else "curl" if base in CURL else "none"
    return Fact(
        kind,
        s,
        mark,
        name,
        call_class(text) if named else "none",
        "|" if text == "|" else low if low in TELLING else "",
        text in TYPES,
        text.startswith("--"),
        kind in ("uri", "segment") and ("hook" in low or kind == "uri" and "bot" in low),
        command,
        kind in ("pem", "body") or (kind in VALUES and len(text) >= 4 and s not in ("hole", "mask", "empty")),
        len(text) > 6,
        "END" in text or len(text) > 120,
        kind == "op" or text in ("|", ">", "|-", ">-", "\\", '"', "'", "("),
    )


def contexts(facts: tuple[Fact, ...], comment: bool, carried: tuple[str, str] = ("", "")) -> tuple[list[Context], tuple[str, str]]:
    """For each token its context, and what is carried into the next line.

    Carried are the class of a name whose value has not come yet (it may stand alone in the next line), and the class of what a field
    `name` or `key` holds (for a field `value` that follows).
    """
    out: list[Context] = []
    key, attr = carried[0] or "none", carried[1]
    callee, arg, flag, command = "none", 0, "none", "none"
    last: Fact | None = None  # the word or literal before
    said = 0  # tokens since a word that speaks of a secret
    login = hook = False
    held = ""  # the name before the last op, where it is a telling one
    has_body = any(f.kind == "body" for f in facts)
    before, prev = "^", "^"
    n = len(facts)
    for i in range(n):
        f = facts[i]
        kind = f.kind
        if i + 1 < n:
            nxt = facts[i + 1]
            next_kind = nxt.kind
            next_mark = nxt.mark if next_kind in ("punct", "op") else next_kind
        else:
            next_kind = next_mark = "$"
        out.append(
            Context(
                kind,
                f.shape,
                key,
                before,
                prev,
                "hook" if hook and kind == "segment" else "said" if 0 < said <= 5 else "none",
                flag,
                callee,
                arg,
                login,
                command,
                comment,
                next_kind,
                next_mark,
                has_body or f.whole if kind in ("pem", "body") else None,
                f.long,
            )
        )
        # what the following tokens see
        if kind == "op":
            # a declared type between a name and its value does not replace the name
            if not (key != "none" and last is not None and last.is_type):
                held = last.telling if last is not None else ""
                key = attr if attr and held in ("value", "val", "content") else last.name if last is not None else "none"
        elif kind == "punct":
            text = f.mark
            if text in "([":
                callee, arg = last.call if last is not None else "none", 0
                if text == "(":
                    key = "none"
            elif text == ",":
                arg = min(arg + 1, 2)
                # the first of two literals may be the name of the second
                key = "secret" if last is not None and last.kind == "string" and last.name == "secret" else "none"
            elif text == ")":
                callee = "none"
            elif text in ";{}":
                key = callee = "none"
        elif kind == "uri":
            hook = f.hook
        elif f.telling == "|" and facts[0].telling == "|":  # a row of a table: what stands before names what follows
            key = last.name if last is not None else "none"
            before, prev = prev, f.mark
            continue
        if kind in ("word", "string", "prose", "config"):
            if held in ("name", "key") and prev in ("=", ":", "=>"):
                attr = f.name
            if last is not None and last.telling in SETS:
                key = f.name
            flag = f.name if f.is_flag else "none"
            if f.name == "secret" and kind != "string":
                said = 1
            elif said:
                said += 1
            login = login or f.telling in ("login", "credentials", "account", "signin", "machine")
            if f.command != "none":
                command = f.command
            last = f
        elif kind == "segment":
            hook = hook or f.hook
        elif said:
            said += 1
        before, prev = prev, f.mark
    open_ = n >= 2 and facts[-1].open
    named = n <= 8 and held in ("name", "key") and last is not None
    return out, (key if open_ and key in ("secret", "other_secret", "hook") else "", attr if named and attr in ("secret", "other_secret") else "")


COMMENT = re.compile(r"^\s*(?://|#(?!define)|/\*|\*|<!--|--\s|;)")

# --- the model ---------------------------------------------------------------------------------------------------------


def labelled(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of each line of a training text, in which what is a credential stands between \\x01 and \\x02."""
    marked = [m.span(1) for m in re.finditer("\x01([^\x02]*)\x02", text)]
    shift = lambda x: x - sum(text[:x].count(c) for c in "\x01\x02")
    places = [(shift(a), shift(b)) for a, b in marked]
    plain = re.sub("[\x01\x02]", "", text)
    out, carried = [], ("", "")
    for _, start, tokens, line in sequences(plain):
        facts = tuple(fact(t.kind, t.text) for t in tokens)
        fs, carried = contexts(facts, bool(COMMENT.match(line)), carried)
        labels, open_ = [], False
        for t, f in zip(tokens, facts, strict=True):
            inside = f.may and any(t.start + start < b and t.end + start > a for a, b in places)
            labels.append(0 if not inside else 2 if open_ else 1)
            open_ = inside
        if tokens:
            out.append(([described(c) for c in fs], labels))
    return out


def sequences(content: str) -> Iterator[tuple[int, int, list[Token], str]]:
    """(line number from 1, its place, tokens by places in the line, the line) of each line; a key block of several lines is one sequence."""
    lines = content.split("\n")
    starts, start = [], 0
    for line in lines:
        starts.append(start)
        start += len(line) + 1
    i = 0
    while i < len(lines):
        line = lines[i]
        m = PEM_BEGIN.search(line) if "-----BEGIN" in line else None
        if m and (e := PEM_END.search(line, m.end())):
            close = line.find("-----", e.end())
            end = close + 5 if close >= 0 else len(line)
            yield i + 1, starts[i], [Token(m.start(), end, line[m.start() : end], "pem")], line
        elif m:
            body, j = block(lines, i)
            tokens = [Token(m.start(), m.end(), m[0], "pem")] if body else lex(line)
            tokens += [Token(starts[k] + a - starts[i], starts[k] + b - starts[i], lines[k][a:b], "body") for k, a, b in body]
            yield i + 1, starts[i], tokens, line
            i = j if body else i + 1
            continue
        else:
            yield i + 1, starts[i], lex(line), line
        i += 1


#: Texts of the invented training sample: the bound of what the model is fitted on.
TRAINING_TEXTS = 10_000
_models: dict[tuple, LinearChain] = {}


def model(n: int = TRAINING_TEXTS, seed: int = 17, without: tuple[str, ...] = ()) -> LinearChain:
    """The field, fitted on the driver in a few seconds from n invented labelled texts; kept for the process. `without`: families left out."""
    if (n, seed, without) not in _models:
        rows = [r for x in training_texts(n, seed, without) for r in labelled(x)]
        _models[n, seed, without] = fit([fs for fs, _ in rows], [g for _, g in rows], LABELS)
    return _models[n, seed, without]


# --- spans and redaction -----------------------------------------------------------------------------------------------


class Finder:
    """Finds the credentials of texts.

    What a line holds follows from its text and what is carried into it, and its labels from the facts of its tokens: neither is worked
    out again for lines, or for forms of lines, that come again.
    """

    def __init__(self, field: LinearChain):
        self.field = field
        self.kept: dict[tuple, tuple] = {}
        self.forms: dict[tuple, tuple] = {}

    def _line(self, line: str, carried: tuple[str, str]) -> tuple[list[tuple[int, int, int, str]], tuple[str, str]]:
        key = (line, carried)
        if (got := self.kept.get(key)) is None:
            facts = line_numbers(line)
            if not facts:
                return [], carried
            if len(self.kept) >= KEPT:
                self.kept.clear()
            labels, after = self._form(facts, COMMENT.match(line) is not None, carried)
            got = self.kept[key] = (self._places(lex(line), labels) if labels else [], after)
        return got

    def _form(self, facts: tuple[int, ...], comment: bool, carried: tuple[str, str]) -> tuple[list[int], tuple[str, str]]:
        key = (facts, comment, carried)
        if (got := self.forms.get(key)) is None:
            if len(self.forms) >= KEPT:
                self.forms.clear()
            got = self.forms[key] = self._labels(tuple(_facts[k] for k in facts), comment, carried)
        return got

    def _labels(self, facts: tuple[Fact, ...], comment: bool, carried: tuple[str, str]) -> tuple[list[int], tuple[str, str]]:
        found, after = contexts(facts, comment, carried)
        allowed = [f.may for f in facts]
        if not any(allowed):
            return [], after
        scored = [self.field.kept_scores(c, described) for c in found]
        if facts[0].kind == "pem" and len(facts) > 1:  # a key block is one credential or none: its lines are labelled together
            labels = self.field.best_of(scored, ([0] * len(scored), [1] + [2] * (len(scored) - 1)))
        else:
            labels = self.field.viterbi(scored, allowed)
        return labels if any(labels) else [], after

    def _places(self, tokens: list[Token], labels: list[int]) -> list[tuple[int, int, int, str]]:
        """(label, start, end, kind) of what is labelled; 2: goes on, does not begin on a line of its own."""
        out: list[tuple[int, int, int, str]] = []
        for t, y in zip(tokens, labels, strict=True):
            if y == 1 and t.kind == "pem" and (m := PEM_BEGIN.search(t.text)):
                e = PEM_END.search(t.text, m.end())
                out.append((y, t.start + m.end(), t.start + (e.start() if e else len(t.text)), "key block"))
            elif y and (y == 1 or out):
                out.append((y, t.start, t.end, t.kind))
        return [x for x in out if x[1] < x[2]]

    def spans(self, content: str) -> list[tuple[int, int, int, str]]:
        """(line number, start, end, kind) of each credential in Viterbi's labelling; of a key block the places between its marks.

        The line number is that on which it begins; 0 where it goes on. A place has at least one character.
        """
        found = []
        if "-----BEGIN" in content:
            carried = ("", "")
            for line_no, start, tokens, line in sequences(content):
                if tokens and tokens[0].kind == "pem":
                    labels, carried = self._form(tuple(fact_no(t.kind, t.text) for t in tokens), COMMENT.match(line) is not None, carried)
                    got = self._places(tokens, labels) if labels else []
                    found += [(line_no if k == 0 or y == 1 and kind != "body" else 0, start + a, start + b, kind) for k, (y, a, b, kind) in enumerate(got)]
                else:
                    got, carried = self._line(line, carried)
                    found += [(line_no if y == 1 else 0, start + a, start + b, kind) for y, a, b, kind in got]
            return found
        start, carried = 0, ("", "")
        for line_no, line in enumerate(content.split("\n"), 1):
            got, carried = self._line(line, carried)
            for y, a, b, kind in got:
                found.append((line_no if y == 1 else 0, start + a, start + b, kind))
            start += len(line) + 1
        return found


def spans(content: str, field: LinearChain) -> list[tuple[int, int, int, str]]:
    """Finder.spans of one text."""
    return Finder(field).spans(content)


def redacted(content: str, places: list[tuple[int, int, int, str]]) -> str:
    """Each literal character of a credential as '*'; quotes, line ends and everything around stay, also all lengths."""
    out = list(content)
    for _, a, b, _ in places:
        for i in range(a, b):
            if out[i] not in "\r\n" and not (out[i] == "n" and i > a and out[i - 1] == "\\"):
                out[i] = "*" if out[i] != "\\" else "\\"
    return "".join(out)


SPANS = "array<struct<line_no: int, start: int, end: int, kind: string>>"


def find_credentials(chunks: DataFrame, training: int = TRAINING_TEXTS) -> DataFrame:
    """(id, content, credentials, redacted) for each distinct chunk id.

    credentials: line_no from 1 (0 where a credential of an earlier line goes on), start and end as code points in content.
    Null content stays null and has none; an id that comes twice counts once (of copies that disagree the largest content
    holds; of equally large ones that with the larger hash); rows without id are none. Whole contents are read, in one pass without
    a shuffle but the one by id.
    """
    field = chunks.sparkSession.sparkContext.broadcast(model(training))  # some thousand weights

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(field.value)
        for p in parts:
            places = [finder.spans(c) if c else [] for c in p.content]
            yield pd.DataFrame(
                {
                    "id": p.id,
                    "content": p.content,
                    "credentials": [[dict(zip(("line_no", "start", "end", "kind"), x, strict=True)) for x in s] for s in places],
                    "redacted": [redacted(c, s) if c and s else c for c, s in zip(p.content, places, strict=True)],
                }
            )

    size = F.struct(F.coalesce(F.length("content"), F.lit(-1)).alias("n"), F.xxhash64("content").alias("h"), "content")
    once = chunks.where("id is not null").groupBy("id").agg(F.max(size).alias("r")).select("id", "r.content")
    return once.mapInPandas(run, f"id string, content string, credentials {SPANS}, redacted string")


def credential_lines(chunks: DataFrame, training: int = TRAINING_TEXTS) -> DataFrame:
    """(id, line_no) of each line on which a credential begins, of the same contents as find_credentials.

    The contents are read where they lie; what is shuffled, by id, is sizes, hashes and the lines found.
    """
    field = chunks.sparkSession.sparkContext.broadcast(model(training))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(field.value)
        for p in parts:
            yield p[["id", "n", "h"]].assign(lines=[sorted({x[0] for x in finder.spans(c)} - {0}) if c else [] for c in p.content])

    read = chunks.where("id is not null").select("id", F.coalesce(F.length("content"), F.lit(-1)).alias("n"), F.xxhash64("content").alias("h"), "content")
    lines = read.mapInPandas(run, "id string, n int, h long, lines array<int>").groupBy("id").agg(F.max(F.struct("n", "h", "lines")).alias("r"))
    return lines.select("id", F.explode("r.lines").alias("line_no"))
