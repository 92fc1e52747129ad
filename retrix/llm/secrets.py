"""Credentials embedded in source code and configuration: where they are, and the text with them masked.

Quoted strings, assigned values and long tokens are extracted from every line. A value is judged by its
Shannon entropy, measured over the alphabet it is written in, against a threshold that grows with its
length; a name that says what the value is lowers the threshold. Hashes, identifiers, references and known
placeholders are excluded. Logins in addresses and commands and private-key blocks have a form of their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"

#: Names of secrets (last words of a name), and words that make a name that of something else.
SECRET_WORDS = frozenset(
    "password passwd passwort passphrase pass pwd senha contrasena contraseña clave secret secrets token apikey authtoken credential credentials bearer".split()
)
KEY_BEFORE = frozenset("api secret access private auth signing encryption master account client service shared storage webhook license deploy app".split())
OTHER_WORDS = frozenset(
    "public max min ttl lifetime expiry expires expiration timeout policy file path dir field header name names id ids count size limit length len type kind url uri endpoint "
    "hash sha sha1 sha256 sha512 md5 digest checksum commit fingerprint cert certificate tokenizer tokens label hint prompt placeholder prefix suffix enabled required rotation "
    "version algorithm format input form regex pattern example template column env var ref reference manager store provider location bucket arn".split()
)
HASH_WORDS = frozenset("sha sha1 sha256 sha512 md5 hash digest checksum commit etag integrity fingerprint revision rev uuid guid id request trace span version public pub cert certificate image nonce salt build".split())
#: Beginnings of issued tokens.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeoprs]-[\w-]{16,}|sk-(?:ant-|proj-)?[\w-]{20,}|hf_[A-Za-z0-9]{20,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|AIza[\w-]{30,}|"
    r"(?:sk|pk|rk|[a-z]{2,12})_(?:live|prod)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{6,}|dop_v1_[a-f0-9]{40,}|shpat_[a-fA-F0-9]{24,}|ya29\.[\w-]{20,})(?![A-Za-z0-9_])"
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*+|\.{3,}|-+|_+|0+|1234\w*|redacted|masked|removed|hidden|omitted|change[_-]?(?:me|it|this)\w*|replace[_-]?\w*|todo\w*|fixme|tbd|none|null|nil|true|false|undefined|default|strict|"
    r"your[_-].*|my[_-]?(?:password|secret|token|key).*|insert[_-].*|enter[_-].*|put[_-].*|example\w*|exemplo\w*|ejemplo\w*|sample\w*|dummy\w*|fake\w*|test|placeholder\w*|password|passwd|pass|secret|senha|contraseña|contrasena|token|"
    r"api[_-]?key|user|admin|root|foo|bar|foobar|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|#\{.*|vault:.*|secret:.*|ssm:.*|env:.*|arn:.*|op://.*|file:.*|/run/.*|(?-i:/[a-z][a-z0-9_.-]*(?:/[a-z0-9_.-]+)*/?)|@\w+|sua[_-].*|tu[_-].*|a definir|por definir)$"
)
REFERENCE = re.compile(r"(?i)\$\{|\{\{|\$\(|<%|%\(|^\$[A-Za-z_]\w*$|^%\w+%$|getenv|environ|process\.env|^env\(|secrets\.|vault|keyring|^self\.|^this\.|^config[.\[]|^settings\.|^args\.|^os\.|^var\.|^data\.|^local\.")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñç]+|\d+")
#: A letter and three or more others, in syllables of at most three consonants and two vowels.
_SPOKEN_WORD = re.compile(r"[A-Za-z](?=[a-z]{3})(?:[bcdfghjklmnpqrstvwxyz]{0,3}[aeiou]{1,2})+[bcdfghjklmnpqrstvwxyz]{0,3}")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")

#: Share of the mean entropy of random values of its length and alphabet that a value has at least: without a name
#: that tells of a secret, in letters alone, with such a name, and in an authorisation header.
BARE_SHARE, LEAST_SHARE, NAMED_SHARE, HEADER_SHARE = 0.90, 0.94, 0.63, 0.74
#: Characters of a value without a name, at least and at most: what is longer is encoded data.
LEAST_LONG, MOST_LONG = 20, 256
#: Share of an unnamed value that words may take; what is more is an identifier.
WORDY_SHARE = 0.4


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> int:
    """Size of the alphabet a value is written in: digits, hexadecimal, base32, letters, base64 or printable."""
    if value.isdigit():
        return 10
    if _HEX.match(value):
        return 16
    lower, upper, digit = any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value), any(c.isdigit() for c in value)
    plain = all(c.isalnum() or c in "+/=_-." for c in value)
    return (26 * lower + 26 * upper + 10 * digit + 2) if plain else 94


@lru_cache(maxsize=1 << 14)
def expected_entropy(length: int, letters: int) -> float:
    """Mean entropy in bits a character of random values of a length, over an alphabet of so many letters."""
    total, chance = 0.0, (1 - 1 / letters) ** length  # of a letter that does not occur
    for k in range(1, length + 1):
        chance *= (length - k + 1) / k / (letters - 1)
        total += chance * k * math.log2(k)
        if chance < 1e-15 and k > length / letters:
            break
    return math.log2(length) - letters / length * total if length > 1 else 0.0


def random_like(value: str, share: float = LEAST_SHARE) -> bool:
    """Whether the entropy passes the threshold for the value's alphabet and length."""
    return entropy(value) >= share * (expected_entropy(len(value), alphabet(value)) or 1.0)


def wordy(value: str) -> bool:
    """Whether runs of letters that can be spoken as words take a good part of a value."""
    return sum(len(m) for m in _SPOKEN_WORD.findall(value)) >= WORDY_SHARE * len(value)


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def is_secret_name(name: str) -> bool:
    """Whether a name says that its value is a secret and not something about one."""
    words = [w for w in words_of(name) if not w.isdigit()]
    while words and words[-1] in ("prod", "dev", "hml", "stg", "staging", "test", "old", "new", "value", "default", "current"):
        words.pop()
    if not words or OTHER_WORDS & set(words):
        return False
    last = words[-1]
    return last in SECRET_WORDS or (last == "key" and len(words) > 1 and words[-2] in KEY_BEFORE) or last in ("apikey", "secretkey", "accesskey", "privatekey")


def is_literal(value: str) -> bool:
    """Whether a value is neither a stand-in nor a reference."""
    return bool(value) and not PLACEHOLDER.match(value) and not REFERENCE.search(value)


def named_value(value: str) -> bool:
    """Whether the value of a secret's name is a secret: long and mixed enough for what people choose."""
    if len(value) < 6 or not is_literal(value):
        return False
    kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value)
    if value.isdigit():
        return len(value) >= 8
    if re.fullmatch(r"[A-Za-z_][A-Za-z_]*(?:\.[A-Za-z_]+)*(?:\(.*\))?|https?://\S*|[\w./-]+/", value) and not ISSUED.search(value):
        return len(value) >= 16 and kinds >= 2 and random_like(value) and "_" not in value and "." not in value
    return kinds >= 2 and random_like(value, NAMED_SHARE)


def bare_value(value: str, words: set[str]) -> bool:
    """Whether a long token without a secret's name is one: random over a wide alphabet, no hash and no id."""
    if not LEAST_LONG <= len(value) <= MOST_LONG or _HEX.match(value) or _UUID.match(value) or HASH_WORDS & words:
        return False
    mixed = any(c.islower() for c in value) and any(c.isupper() for c in value) and sum(c.isdigit() for c in value) >= 2
    return mixed and is_literal(value) and random_like(value, BARE_SHARE) and "/" not in value[:1] and not wordy(value)


_NAME = r"[A-Za-zñç_][\w.ñç-]*+"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`"
_ASSIGNED = re.compile(
    rf"(?<![\wñç.-])(?P<name>{_NAME})[\"'\]]*\s*(?:(?<!:):(?![:/])|:?=(?![=>])|=>)\s*(?:new\s+\w+\()?(?P<value>(?:[rbuf]?(?:{_QUOTED})(?:\s*\+\s*(?:{_QUOTED}))*)|[^\s\"'`,;)}}<>]+)", re.I
)
_TYPED = re.compile(rf"(?<![\wñç.-])(?P<name>{_NAME})\s*:\s*[A-Za-z_][\w.\[\]<>]*\s*=\s*(?P<value>[rbuf]?(?:{_QUOTED})(?:\s*\+\s*(?:{_QUOTED}))*)")
_TAG = re.compile(rf"<(?P<name>{_NAME})(?:\s[^<>]*)?>(?P<value>[^<>\n]+)</(?P=name)>")
_ATTRIBUTE = re.compile(r"\b(?:key|name|id)\s*=\s*(?P<q>[\"'])(?P<name>[^\"']+)(?P=q)\s+(?:value|content)\s*=\s*(?P<r>[\"'])(?P<value>[^\"']*)(?P=r)", re.I)
_NOTED = re.compile(rf"/\*\s*(?P<name>{_NAME})\s*\*/\s*(?P<value>{_QUOTED})")
_SPOKEN = re.compile(r"(?i)\b(?P<name>(?:api[ _-]?)?key|password|passwd|pwd|senha|contraseña|contrasena|clave|token|secret|passphrase)\b(?:\s+[\wçãáéíóúñ]+){0,3}?\s*[:=]\s*(?P<value>\S+)")
_ACCOUNT = re.compile(r"(?i)\b(?:log-?in|user|usuario|usuário|conta|cuenta|account)\s+[\w.@-]+\s*/:?\s*(?P<value>\S+)")
_LOGIN = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://(?P<user>[^\s:/@\"'<>]*):(?P<value>[^\s@/\"'<>]+|[^\s\"'<>]+?)@(?=[\w\[$.{-])")
_BASIC = re.compile(r"(?i)(?:\bauthorization\b[\"']?\s*[:=,]\s*[\"']?\s*(?:token|basic|bearer|apikey)|\b(?:basic|bearer))\s+(?P<value>[A-Za-z0-9+/=_.~-]{8,})")
_COMMANDS = [
    re.compile(r"\b(?:mysql\w*|mariadb\w*|psql|mongo\w*|sshpass)\b[^\n|;]*?\s-p\s*(?P<value>'[^'\n]+'|\"[^\"\n]+\"|[^\s'\"-][^\s'\"]*)"),
    re.compile(r"\b(?:curl|wget|http|https|httpie)\b[^\n|;]*?\s(?:-u|--user)[\s=]*(?P<open>['\"]?)[^\s:'\"]*:(?P<value>[^\s'\"]+)"),
    re.compile(r"(?:^|\s)--?(?:password|passwd|pass|pwd|senha|token|secret|api-key|apikey|auth-token|access-token|secret-key|client-secret|passphrase)(?:[ =]+)(?P<value>'[^'\n]+'|\"[^\"\n]+\"|[^\s'\"]+)"),
    re.compile(r"(?i)[\"'](?:x-)?(?:api-?key|auth-?token|access-?token|authorization|private-?token)\s*:\s*(?P<value>[^\"'\s]+)[\"']"),
]
_LONG = re.compile(rf"[A-Za-z0-9+/_.-]{{{LEAST_LONG},}}={{0,2}}")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: The body of a private key whose END is missing: chunks of base64 as they stand in files, strings and comments, the last one shorter.
_BETWEEN = r"(?:[ \t\r\n\"'`,#*]|\\[rn]|\+(?=\s)|//(?=\s))*+"
_KEY_BODY = re.compile(rf"(?:{_BETWEEN}(?:[A-Z][A-Za-z-]+: [^\n]*\n{_BETWEEN})*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_BETWEEN}[A-Za-z0-9+/]{{1,15}}+={{0,2}}(?=[ \t\r\"'`,;)\\]*(?:\n|\Z)))?")
_PUBLIC = re.compile(r"\b(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-\w+)\s+\S+|\bsha(?:1|256|384|512)[:-][A-Za-z0-9+/=]+")
#: What a line with a credential holds at least, in lower case; other lines are passed over.
_HINTS = ("pass", "pwd", "senha", "contrase", "clave", "secret", "token", "key", "credential", "auth", "bearer", "basic ", "login", "log-in", "user", "usuario", "usuário", "conta", "cuenta", "account", "://", " -u", " -p")
_ISSUED_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk-", "hf_", "AKIA", "ASIA", "glpat-", "_live_", "_prod_", "eyJ", "AIza", "npm_", "SG.", "dop_v1_", "shpat_", "ya29.")
_RUN = _LONG


def _hinted(text: str) -> list[int]:
    """Places in the lines that may hold a credential."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for where, hints in ((low, _HINTS), (text, _ISSUED_HINTS)):
        for hint in hints:
            at = where.find(hint)
            while at >= 0:
                out.append(at)
                at = where.find("\n", at)
                at = where.find(hint, at) if at >= 0 else -1
    out += [m.start() for m in _RUN.finditer(text)]
    return sorted(out)


#: What a value, quoted or assigned, or an option looks like at least.
_VALUE = re.compile(r"[\"'`>][^\"'`<\n]{4,}[\"'`<]|[=:]\s*[^\s\"'`(),;]{6,}|\s-{1,2}[pu]|[A-Za-z0-9+/_.=-]{20,}|/")


def _pieces(value: str, at: int) -> list[tuple[int, int]]:
    """Places of the contents of a value: of each quoted string if it is one or several of them."""
    if value[:1] in "rbufRBUF" and value[1:2] in "\"'":
        value, at = value[1:], at + 1
    if value[:1] in "\"'`":
        return [(at + m.start() + 1, at + m.end() - 1) for m in re.finditer(_QUOTED, value)]
    return [(at, at + len(value))]


def secrets_in_line(line: str) -> list[tuple[int, int]]:
    """Places of the secrets of one line."""
    out: list[tuple[int, int]] = []

    def add(places: list[tuple[int, int]]) -> None:
        for start, end in places:
            if start < end and not any(s < end and start < e for s, e in out):
                out.append((start, end))

    covered = [m.span() for m in _PUBLIC.finditer(line)]
    free = lambda start, end: not any(s < end and start < e for s, e in covered)
    for m in ISSUED.finditer(line):
        if is_literal(m.group()) and not re.search(r"(?i)x{6,}|example|\.\.\.", m.group()) and free(*m.span()):
            add([m.span()])
    for m in _LOGIN.finditer(line) if "://" in line and "@" in line else ():
        value = m.group("value")
        if is_literal(value) and not re.search(r"(?i)[${}<>%*]{2,}|^\$\w+$", value):
            add([m.span("value")])
    for m in _BASIC.finditer(line):
        value = m.group("value")
        if is_literal(value) and (any(c.isdigit() for c in value) or any(c.isupper() for c in value)) and len(value) >= 12 and random_like(value, HEADER_SHARE):
            add([m.span("value")])
    for pattern in _COMMANDS if "-" in line or "X" in line or "x" in line or ":" in line else ():
        for m in pattern.finditer(line):
            places = _pieces(m.group("value"), m.start("value"))
            joined = "".join(line[s:e] for s, e in places)
            if joined and is_literal(joined) and len(joined) >= 4 and re.search(r"[^A-Za-z]", joined) and not REFERENCE.search(joined):
                add(places)
    for pattern in (_TYPED, _ASSIGNED, _TAG, _ATTRIBUTE, _NOTED):
        for m in pattern.finditer(line):
            if not is_secret_name(m.group("name")):
                continue
            places = _pieces(m.group("value"), m.start("value"))
            joined = "".join(line[s:e] for s, e in places)
            literal = m.group("value")[:1] in "\"'`" or m.group("value")[1:2] in "\"'" or pattern in (_TAG, _ATTRIBUTE) or not re.match(r"[(\[{]|[A-Za-z_][\w.]*[(\[]", joined)
            if literal and named_value(joined.strip()) and free(m.start("value"), m.end("value")):
                add(places)
    if re.match(r"\s*(?:#|//|/\*|\*|--|;|<!--|>)", line) or re.search(r"\s(?:#|//)\s", line):
        for m in (*_SPOKEN.finditer(line), *_ACCOUNT.finditer(line)):
            value = m.group("value").rstrip(".,;)*/>\"'").lstrip("\"'(")
            start = m.start("value") + m.group("value").index(value) if value else 0
            if len(value) >= 6 and named_value(value) and re.search(r"[\d\W_]", value):
                add([(start, start + len(value))])
    for m in _LONG.finditer(line):
        before = line[: m.start()]
        name = re.search(r"([\w.-]+)[\"'\]]?\s*[:=]+>?\s*[\"'(\[]*$", before)
        words = set(words_of(name.group(1))) if name else set()
        if bare_value(m.group(), words) and free(*m.span()) and "://" not in line[max(0, m.start() - 60) : m.end()]:
            add([m.span()])
    return sorted(out)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """Line (from 1), start and end of every secret of a text; a private key has the line of its BEGIN."""
    hinted = _hinted(text) if text else []
    if not hinted:
        return []
    out: list[tuple[int, int, int]] = []
    breaks = [-1]
    at = text.find("\n")
    while at >= 0:
        breaks.append(at)
        at = text.find("\n", at + 1)
    line_of = lambda place: bisect_right(breaks, place - 1)
    blocked: list[tuple[int, int]] = []
    begins = list(_BEGIN.finditer(text))
    ends = [m.start() for m in _END.finditer(text)] if begins else []
    for k, m in enumerate(begins):
        other = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        end = bisect_right(ends, m.end() - 1)
        closed = end < len(ends) and ends[end] <= other
        stop = ends[end] if closed else other
        body = text[m.end() : stop] if closed else _KEY_BODY.match(text, m.end(), stop).group()
        core = re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", body)
        if len(core) >= 16 and not re.search(r"(?i)\.\.\.|redacted|example|your[ _-]|<[^>]+>|\{\{|\$\{", body):
            line = line_of(m.start())
            for part in re.finditer(r"[A-Za-z0-9+/=]{8,}", text[m.end() : m.end() + len(body)]):
                out.append((line, m.end() + part.start(), m.end() + part.end()))
        blocked.append((m.start(), m.end() + len(body)))
    seen = -1
    for hint in hinted:
        if hint <= seen:
            continue
        line = line_of(hint)
        start = breaks[line - 1] + 1
        seen = end = breaks[line] if line < len(breaks) else len(text)
        if any(s < end and start < e for s, e in blocked):
            continue
        whole = text[start:end].rstrip("\r")
        if _VALUE.search(whole):
            out += [(line, start + s, start + e) for s, e in secrets_in_line(whole)]
    return sorted(out)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each secret replaced; all else, line breaks included, stays."""
    parts, at = [], 0
    for _, start, end in found:
        if start >= at:
            parts += [text[at:start], MASK]
            at = end
    return "".join([*parts, text[at:]])


def scan(df: DataFrame, id_col: str, text_col: str, table_name: str, with_text: bool = False) -> DataFrame:
    """Records that hold credentials: ``tbl``, ``rec_id``, ``lines`` (where one begins, in order), ``n_secrets``
    and, if ``with_text``, ``masked``, the whole text with only the secrets replaced.

    One row per row of ``df`` that holds any. Rows with a null id, and null or empty texts, give no row; a row
    that comes again comes out again. Texts are scanned whole and where they lie: no shuffle.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lines, many, masked = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = find_secrets(text)
                if found:
                    row.append(k)
                    lines.append(sorted({line for line, _, _ in found}))
                    many.append(len(found))
                    if with_text:
                        masked.append(mask(text, found))
            columns = [pa.array([table_name] * len(row), type=pa.string()), batch.column(0).take(pa.array(row, type=pa.int64())), pa.array(lines, type=pa.list_(pa.int32())), pa.array(many, type=pa.int32())]
            names = ["tbl", "rec_id", "lines", "n_secrets"]
            if with_text:
                columns.append(pa.array(masked, type=pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    used = df.select(F.col(id_col).cast("string").alias("rec_id"), F.col(text_col).cast("string").alias("body")).where("rec_id is not null and body is not null and body <> ''")
    return used.mapInArrow(search, "tbl string, rec_id string, lines array<int>, n_secrets int" + ", masked string" * with_text)
