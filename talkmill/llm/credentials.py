"""Credentials in code, configuration and prose: found and redacted to the character.

A line is cut into lexical tokens: literals (runs without white space, quotes,
brackets or separators), single signs, whole key blocks. A linear-chain
conditional random field labels them O, B or I from the shape of the literal and
its context; the Viterbi spans are exactly the characters that are redacted. The
field is fitted at first use, on a bounded sample of labelled lines made by a
grammar of public formats (``SAMPLE_LINES`` lines, seeded), and kept for the process.

Features are kinds, shapes and signs, never the neighbouring words themselves,
so the field can't learn sentences by heart. Part of the model is one
constraint: a literal of one kind of character (not ``MIXED``) can begin a
credential only in a line that names one or has a place for one (``CUED``), and a
plain word only after a sign, a cue or a word that leads to a value. Between
forced labels the chain falls into independent runs of literals, so only those
are scored, and lines without one are passed over; neither changes the labels.

A credential has no white space within, key blocks apart. At signs in a line
with a URL, and colons anywhere, end a literal.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.credential_samples import labelled_lines

SAMPLE_LINES = 14_000
#: Features that occur less often in the sample have no weight.
LEAST = 3
SEED, EPOCHS, RATE, DECAY, BATCH = 7, 4, 0.25, 5e-6, 256
BITS = 17
#: Rows labelled together.
SLICE = 1024
LABELS = O, B, I = 0, 1, 2
NEVER = -1e6

# Words that speak of credentials, with the kind of cue they give.
CUES = {
    "public": ("public", "sha", "sha1", "sha256", "sha512", "md5", "commit", "hash", "digest", "checksum", "fingerprint", "revision", "etag", "integrity", "uuid", "trace", "request", "publickey", "peer", "hostkey"),
    "pass": ("password", "passwd", "pwd", "pass", "passphrase", "passcode", "passwort", "kennwort", "contraseña", "clave", "passe", "пароль", "senha", "wachtwoord", "pin", "sshpass", "pgpassword", "identified", "passin"),
    "secret": ("secret", "secrets", "private", "preshared", "psk", "credential", "credentials", "geheimnis", "privatekey", "presharedkey", "apikey", "accesskey", "secretkey", "accountkey", "sharedaccesskey"),
    "token": ("token", "bearer", "auth", "authorization", "authtoken", "jwt", "sid", "cookie", "csrf", "jeton", "токен", "basic", "sessionid", "phpsessid", "jsessionid", "csrftoken"),
    "key": ("key", "ключ", "chiave"),
    "session": ("session",),
    "user": ("user", "username", "login", "account", "host", "server", "url", "endpoint", "channel", "id", "name", "from", "port", "region", "version", "image", "path", "page"),
}
_KIND = {w: i + 1 for i, words in enumerate(CUES.values()) for w in words}
PUBLIC, USER = 1, len(CUES)
STEMS = (("passw", 2), ("passphrase", 2), ("secret", 3), ("token", 4), ("apikey", 3))
ENDINGS = (("pass", 2), ("pwd", 2), ("key", 5))
#: What makes a key a credential, and what makes it none.
KEY_OF = {w: 3 for w in ("api", "access", "secret", "signing", "encryption", "account", "master", "deploy", "license", "session", "shared", "auth", "private")} | {w: 1 for w in ("host", "public", "primary", "foreign", "sort", "cache", "peer", "partition")}
# Parts of a name that turn its meaning: what is counted, limited or pointed to is none itself.
TURNS = ("count", "counts", "limit", "max", "min", "budget", "length", "file", "policy", "path", "size", "name", "primary", "foreign", "sort", "keys", "ref", "type", "url", "mode", "enabled", "timeout", "rate", "days", "expires", "domain", "banner", "tokens", "id", "hash", "cache", "always", "alive", "log", "version", "format", "rotation", "board")
# Words between a name and its value.
LINKS = ("is", "are", "was", "were", "to", "with", "by", "as", "for", "of", "in", "on", "at", "and", "or", "the", "a", "an", "my", "use", "using", "set", "new", "now", "it", "not", "has", "had", "this", "that", "ist", "war", "lautet", "heißt", "mit", "für", "von", "est", "était", "vaut", "avec", "es", "era", "será", "con", "usa", "è", "был", "теперь", "login", "begin", "return", "value", "be", "default", "machine", "typed", "const", "let", "var", "export", "wants", "only")
# Words after which a plain word may be a credential.
LEADS = frozenset(("is", "are", "was", "to", "with", "by", "as", "use", "using", "be", "now", "ist", "war", "lautet", "heißt", "mit", "est", "était", "vaut", "avec", "es", "era", "será", "con", "usa", "è", "был", "теперь", "typed", "only", "login", "this", "it", "define"))
# What public kinds of keys begin with.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "ya29.", "eyJ", "pat_", "npm_", "hf_", "SG.", "dop_v1_", "pypi-", "shpat_", "AAAA", "iVBOR", "R0lGOD", "/9j/", "sha256", "sha512")
_PREFIX = re.compile("|".join(map(re.escape, sorted(PREFIXES, key=len, reverse=True))))

#: A literal that may be a credential by its look alone: letters beside digits, mixed case, signs within, or length.
MIXED = r"[A-Za-z][-_.+/!%$*^#?~]?[0-9]|[0-9][-_.+/!%$*^#?~]?[A-Za-z]|[a-z][A-Z]|[A-Za-z0-9][!%$*^#?~+&@][A-Za-z0-9]|[A-Za-z0-9+/_-]{20}|\x00"
# A line is CUED if it names a credential or has a place for one: a URL with a user, an option with a value.
# Names that count within a longer name, and others that must end or stand alone.
_NAMED = ("passw", "passphrase", "passcode", "passin", "pwd", "secret", "token", "apikey", "key", "credential", "bearer", "auth", "jwt", "session", "cookie", "psk", "contrase", "clave", "парол", "токен", "ключ", "kennwort", "geheimnis", "jeton", "senha", "wachtwoord", "chiave", "identified")
_HINTS = ("pass", "sid", "pin", "://", "-p", "-a", "-u")
_MIXED = re.compile(MIXED)
_PLACED = re.compile(r"passe?(?![a-z])|sid(?![a-z])|(?<![a-z])pin(?![a-z])|://[^\s/@]*:[^\s@]*@|(?:^|(?<=\s))-[pau]\s?\S", re.M)
#: A name that goes on as a compound in prose ("token counter", "key file") names no value, but one in a login does.
_GOES_ON = re.compile(rf"[\w-]*+ (?!(?:{'|'.join((*LINKS, *sorted(LEADS)))})(?!\w))[^\W\d_]++(?:[ .,;!?)]|$)")
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)(PRIVATE KEY(?: BLOCK)?|PUBLIC KEY|CERTIFICATE)-----(?:(?!-----BEGIN).)*?-----END \1\2-----", re.S)
_LINE_END = re.compile(r"[\r\n]")
# MIXED on bytes: classes of characters, and the sequences of classes it consists of.
_CLASSES = bytes(
    97 if chr(c).isalpha() and c < 128 else 48 if 48 <= c < 58 else 112 if chr(c) in "-_.+/" else 115 if chr(c) in "!%$*^#?~" else 113 if chr(c) in "&@" else 10 if c in (10, 13) else 0 if c == 0 else 46 for c in range(256)
)
_CASES = bytes(97 if 97 <= c < 123 else 65 if 65 <= c < 91 else 10 if c in (10, 13) else 46 for c in range(256))
_LONG = bytes(120 if c < 128 and (chr(c).isalnum() or chr(c) in "+/_-") else 10 if c in (10, 13) else 46 for c in range(256))
_PLUS = bytes(112 if c == 43 else 10 if c in (10, 13) else 97 if c < 128 and chr(c).isalnum() else 46 for c in range(256))
_ENDS = r"\s\"'`<>()\[\]{},;:|=&@«»“”„‚‘’、。，：；（）「」\\\x00"
_PAD = r"=(?==?(?:$|[\s\"'`<>()\[\]{},;:&|\\]))"


def _lexer(at_sign: str) -> re.Pattern[str]:
    return re.compile(
        r"\x00\d\x00"
        r"|(?<![\w*])\*\*(?=\w)"  # emphasis
        r"|(?<!\S)-[A-Za-z](?=[^\s=-])"  # an option, with its value glued on or not
        r"|[A-Za-z][A-Za-z0-9+.-]*://"
        r"|(?<=[=:(\s,\[{>][\"'`])[^\s\"'`\\=/${}<>()\[\]:@]{4,200}(?=[\"'`])"  # quoted without structure: separators belong to it
        rf"|(?:[^.!?*{_ENDS}]|\*(?!\*(?:[\s.,;:!?)]|$))|[.!?](?=[^\s\"'`])|(?<=[A-Za-z0-9+/-]{{16}}){_PAD}|(?<=[A-Za-z0-9+/-]{{16}}=){_PAD}|(?<=[\w!$%^*#~?.-])&(?=[^\s&])(?![\w.\[\]-]*=){at_sign}|\\(?![nrt\"'\\])(?=[^\s]))+"
        r"|\\[nrt\\]|\S"
    )


# Without a URL in the line an at sign belongs to the literal, unless a host follows.
_LEX, _LEX_URL = _lexer(r"|(?<=[\w!$%^*#~?-])@(?=[\w!$%^*#~])(?![\w-]+(?:\.[\w-]+)+|[\w-]+:|localhost)"), _lexer("")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿа-яё]+|\d+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’_./-][^\W\d_]+)*")
_FORMS = tuple(
    re.compile(p)
    for p in (
        r"[^\W\d_]+", r"[^\W\d_]+(?:[-_./'][^\W\d_]+)+", r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", r"[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Za-z][a-z0-9]*(?:_[a-z0-9]+)+", r"(?=.*\d)[0-9a-f]{7,}", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[-+#]?[\d.,/%+x-]+(?:ms|s|m|h|d|px|[KMG]i?B)?",
        r"(?:[\w-]+\.)+[a-z]{2,8}", r"(?:\.{0,2}|~)/.*", r".*([Xx*.•#0-])\1{3}.*", r"[$%].*|.*\$.?\{.*", r"[A-Za-z]+\d{1,3}", r"v?\d+(?:\.\d+)+(?:-[\w.]+)?", r"\d{4}-\d\d-\d\dT?.*", r"[a-z]+(?:-[a-z0-9]{1,10})+", r"-{1,2}[A-Za-z].*", r"(?i:.*(?:your|example|change.?(?:me|it)|placeholder|dummy|redacted|insert|replace|hidden|not.set).*)", r"[A-Za-z]+(?:\.[A-Za-z_]+)+",
        r"[A-Z]+", r"[A-Z][a-z]+", r"(?i:none|null|nil|true|false|undefined|yes|no|on|off|todo|n/a|empty|missing|required|optional)",
    )
)
_SIZES = (0, 3, 5, 7, 9, 11, 13, 15, 17, 19, 23, 27, 31, 32, 35, 39, 40, 43, 44, 47, 63, 64, 127)


@lru_cache(maxsize=1 << 16)
def _number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=1 << 17)
def _look(text: str) -> tuple[int, int, int, int, int, bool, bool, bool]:
    """What a token is by itself: sign, kind of cue, turn, style, word of a link; whether it looks mixed, is a plain word, leads to a value."""
    if text[0] == "\0":
        return 2, 0, 0, 0, 0, True, False, False
    if not any(map(str.isalnum, text)) and len(text) < 3:
        return _number(text) | 4, 0, 0, 0, _number(text), False, False, text not in ".,;!?)"
    if text.endswith("://"):
        return 3, 0, 0, 0, 3, False, False, True
    word = text.lower()
    if len(text) < 20 and text.isalpha() and text.isascii() and (text == word or text[1:] == word[1:]):
        cue = min({_KIND.get(word, USER)} | {k for stem, k in STEMS if stem in word} | ({k for end, k in ENDINGS if word.endswith(end)} if word not in _KIND else set()))
        cue = cue if cue < USER or word in _KIND else 0
        has = 1 if text == word else 3 if len(text) > 1 else 2
        link = _number(word) if word in LINKS else has + 16 + 32 * (len(text) > 3) + 64 * bool(cue)
        return 1, cue, int(word in TURNS) if cue else 0, 1 + has, link, False, True, bool(cue) or word in LEADS
    cue = turn = style = 0
    has = any(map(str.islower, text)) + 2 * any(map(str.isupper, text)) + 4 * any(map(str.isdigit, text)) + 8 * (not text.isalnum())
    if len(text) < 60 and not _PREFIX.match(text):
        words = [w.lower() for w in _PARTS.findall(text)]
        kinds = {_KIND[w] for w in words if w in _KIND} | {k for stem, k in STEMS if any(stem in w for w in words)}
        kinds |= {k for end, k in ENDINGS if any(w.endswith(end) and w not in _KIND for w in words)}
        kinds |= {KEY_OF[a] for a, b in zip(words, words[1:]) if b in ("key", "keys") and a in KEY_OF}
        cue = min(kinds, default=0)
        turn = int(any(w in TURNS for w in words)) + 2 * (len(words) > 1) if cue else 0
        style = 1 + (has & 3) + 4 * (has >> 3)
    plain = _WORDS.fullmatch(text) is not None
    link = _number(word) if word in LINKS else has + 16 * plain + 32 * (len(text) > 3) + 64 * bool(cue)
    return 1, cue, turn, style, link, _MIXED.search(text) is not None, plain, bool(cue) or word in LEADS or text[0] == "-"


@lru_cache(maxsize=1 << 16)
def _shape(text: str) -> tuple[int, int, int, int, int]:
    """Classes of characters, size, forms, prefix and changes of class of a token."""
    if text[0] == "\0":
        return 0, 0, (1 << 40) + int(text[1]), 0, 0
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in text[:400]]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    forms = sum(1 << i for i, p in enumerate(_FORMS) if p.fullmatch(text)) if len(text) <= 400 else 0
    prefix = m.end() * 64 + PREFIXES.index(m[0]) + 1 if (m := _PREFIX.match(text)) else 0
    return sum(1 << c for c in set(classes)), bisect_left(_SIZES, len(text)), forms, prefix, min(changes * 8 // len(classes) if len(classes) > 12 else changes, 8)


COLUMNS = SIGN, HAS, SIZE, FORMS, PREFIX, CHANGES, CUE, GAP, STYLE, LINK, BEFORE, AFTER, PREV, ROLE, LEFT, RIGHT, AHEAD, TURN, QUOTED, FIRST = range(20)
_SETS = (
    (SIGN,), (HAS,), (SIZE,), (FORMS,), (PREFIX,), (CUE, GAP), (LINK,), (BEFORE,), (AFTER,), (PREV,), (ROLE,), (LEFT,), (RIGHT,), (CHANGES,), (HAS, SIZE), (FORMS, SIZE), (PREFIX, SIZE), (HAS, CHANGES), (CUE, HAS), (CUE, SIZE), (CUE, FORMS), (CUE, GAP, PREV), (CUE, LINK), (LINK, HAS), (LINK, FORMS), (CUE, TURN), (CUE, TURN, HAS), (CUE, TURN, FORMS),
    (CUE, STYLE, LINK), (BEFORE, AFTER), (CUE, BEFORE, AFTER), (HAS, BEFORE, AFTER), (ROLE, HAS), (ROLE, FORMS), (ROLE, AFTER), (ROLE, BEFORE), (ROLE, BEFORE, HAS), (LEFT, HAS), (LEFT, FORMS), (LEFT, CUE, HAS), (RIGHT, HAS), (AHEAD, HAS), (AHEAD, FORMS), (AHEAD, LEFT), (QUOTED, CUE), (QUOTED, HAS), (SIGN, BEFORE, AFTER), (SIGN, LINK), (HAS, SIZE, CUE), (FORMS, CHANGES), (CUE, LINK, FORMS), (PREFIX, AFTER), (PREFIX, HAS), (FIRST, HAS), (FIRST, CUE, FORMS),
)
FEATURES = len(_SETS) + 1
_MULTIPLIERS = np.random.default_rng(11).integers(1 << 20, 1 << 62, (len(_SETS), 3), dtype=np.uint64) | np.uint64(1)


def features_of(columns: np.ndarray) -> np.ndarray:
    """Feature numbers (token, feature) of tokens given by their columns: each set of columns is hashed as one."""
    values = columns.astype(np.uint64)
    out = np.empty((len(values), FEATURES), np.int32)
    out[:, -1] = 0
    for i, names in enumerate(_SETS):
        mixed = np.full(len(values), i * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k, name in enumerate(names):
            mixed = (mixed ^ values[:, name]) * _MULTIPLIERS[i, k]
            mixed ^= mixed >> np.uint64(29)
        out[:, i] = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
    return out


#: A run of literals: spans, columns, whether each may begin a credential, whether it may continue one.
Run = tuple[list[tuple[int, int]], list[tuple[int, ...]], list[bool], list[bool]]


def lex(line: str) -> tuple[list[tuple[int, int]], list[Run]]:
    """(spans of the tokens of a line, its runs of tokens that may belong to a credential)."""
    spans = [m.span() for m in (_LEX_URL if "://" in line else _LEX).finditer(line)]
    texts = [line[a:b] for a, b in spans]
    looks = list(map(_look, texts))
    named = cued(line.lower())
    count, size, runs, last = len(spans), len(line), [], -2
    cue, cue_at, turn, style, link, left, first, leads = 0, 0, 0, 0, "", 0, 1, False
    stage = user = 0  # how far into a URL's user part or an option
    for i, (sign, kind, turned, styled, word, mixed, plain, lead) in enumerate(looks):
        a, b = spans[i]
        begins = mixed or named and (sign == 1 and (leads or not plain) or sign == 2)
        continues = last == i - 1 and spans[i - 1][1] == a
        if begins or continues:
            before, after = line[a - 1] if a else "^", line[b] if b < size else "$"
            role = 0
            if sign == 1 and stage:
                role = (0, 1 + (after == "@"), 3 + (after == "@"), 5, 6 + user, 20)[stage]
            right = ahead = 0
            for n in range(i + 1, min(i + 6, count)):
                if looks[n][0] == 1:
                    right = right or looks[n][4]
                    if looks[n][1]:
                        ahead = looks[n][1] * 8 + n - i
                        break
            has, length, forms, prefix, changes = _shape(texts[i])
            if last < i - 1 or not runs:
                runs.append(([], [], [], []))
            run = runs[-1]
            run[0].append((a, b))
            run[1].append((
                sign, has, length, forms, prefix, changes, cue, min(i - cue_at, 6) if cue else 0, style, _number(link), ord(before), ord(after), looks[i - 1][0] if i else 0, role,
                left, right, ahead, turn, (before == after and before in "\"'`") + 2 * (before in "«“„*"), first,
            ))
            run[2].append(begins)
            run[3].append(continues)
            last = i
        leads = lead
        if sign != 1:
            text = texts[i]
            if sign == 3:
                stage, text = 1, "/"
            else:
                stage = 2 if stage == 1 and text == ":" else 5 if stage == 3 and text == ":" else stage if stage == 4 and text in "\"'" else 0
            link = link[-3:] + text
            continue
        if stage or texts[i][0] == "-":
            text, after = texts[i], line[b] if b < size else "$"
            if text in ("-u", "--user"):
                stage = 3
            elif len(text) == 2 and text[0] == "-":
                stage, user = 4, ord(text[1])
            elif stage == 4 or stage == 2 or stage == 3 and after != ":" or stage == 1 and after not in ":@":
                stage = 0
        left, first = word, 0
        if not link.endswith("ww"):
            link = link[-3:] + "w"
        if kind and not (kind == USER and cue and cue != USER and i - cue_at < 6):
            cue, cue_at, turn, style, link = kind, i, turned, styled, ""
    return spans, runs


class Field:
    """A linear-chain CRF over hashed features: ``weights`` (feature, label), ``moves`` (from, to)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def scores(self, columns: list[tuple[int, ...]], begins: list[bool], continues: list[bool]) -> np.ndarray:
        out = np.empty((len(columns), 3), np.float32)
        for start in range(0, len(columns), 20_000):
            part = features_of(np.array(columns[start : start + 20_000], np.int64))
            out[start : start + 20_000] = self.weights[part].sum(1)
        out[~np.array(begins, bool), B] = NEVER
        out[~np.array(continues, bool), I] = NEVER
        return out

    def viterbi(self, scores: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Best labels of several runs, O before and after each, whose token scores lie one after another, in that order."""
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        labels, at = np.zeros(len(scores), np.int8), 0
        while at < len(order):
            longest = lengths[order[at]]
            ids = np.array(order[at : at + max(1, min(2048, 400_000 // longest))])
            at += len(ids)
            size = np.array([lengths[i] for i in ids])
            where = starts[ids][:, None] + np.minimum(np.arange(longest)[None], size[:, None] - 1)
            padded = scores[where]
            best, back = padded[:, 0] + self.moves[O], np.zeros((longest, len(ids), 3), np.int8)
            for step in range(1, longest):
                live = int((size > step).sum())  # sequences come longest first
                ways = best[:live, :, None] + self.moves[None]
                back[step, :live] = ways.argmax(1)
                best[:live] = ways.max(1) + padded[:live, step]
            label, rows = (best + self.moves[:, O]).argmax(1), np.arange(len(ids))
            for step in range(longest - 1, -1, -1):
                live = int((size > step).sum())
                labels[starts[ids[:live]] + step] = label[:live]
                if step:
                    label[:live] = back[step, rows[:live], label[:live]]
        return labels


def prepared(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with each key block replaced by a one-token mark, and (end of the mark, characters saved) of each."""
    text = text.replace("\0", " ")
    if "-----BEGIN" not in text:
        return text, []
    saved: list[tuple[int, int]] = []
    out, at, size = [], 0, 0
    for m in _BLOCK.finditer(text):
        out += (text[at : m.start()], f"\0{int('PRIVATE' in m[2])}\0")
        size += m.start() - at + 3
        saved.append((size, m.end() - m.start() - 3))
        at = m.end()
    return "".join(out) + text[at:], saved


def fit(lines: list[tuple[str, list[tuple[int, int]]]]) -> Field:
    """Maximum likelihood by AdaGrad over batches of lines with the character spans of their credentials."""
    rng = np.random.default_rng(SEED)
    data = []
    for line, spans in lines:
        for tokens, columns, begins, continues in lex(line)[1]:
            labels = np.array([next((B if a == s else I for s, e in spans if s <= a and b <= e), O) for a, b in tokens])
            if all(begins[i] if x == B else continues[i] if x == I else True for i, x in enumerate(labels)):
                data.append((columns, labels, np.array(begins), np.array(continues)))
    flat = features_of(np.array([c for x in data for c in x[0]], np.int64))
    starts = np.concatenate(([0], np.cumsum([len(x[0]) for x in data])))
    moves, moved = np.zeros((3, 3)), np.full((3, 3), 1e-3)
    moves[O, I] = NEVER
    seen = np.bincount(flat.ravel(), minlength=1 << BITS) >= LEAST
    known = np.flatnonzero(seen)
    flat = np.where(seen, np.cumsum(seen), 0)[flat]  # numbered densely; 0 for those too rare to tell
    weights, squares = np.zeros((len(known) + 1, 3)), np.full((len(known) + 1, 3), 1e-3)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(data))
        for start in range(0, len(data), BATCH):
            ids = shuffled[start : start + BATCH]
            length = np.array([len(data[i][1]) for i in ids])
            count, longest = len(ids), int(length.max())
            used = np.concatenate([flat[starts[i] : starts[i + 1]] for i in ids])
            row = np.repeat(np.arange(count), length)
            col = np.concatenate([np.arange(n) for n in length])
            score = weights[used].sum(1)
            score[:, B] += np.where(np.concatenate([data[i][2] for i in ids]), 0, NEVER)
            score[:, I] += np.where(np.concatenate([data[i][3] for i in ids]), 0, NEVER)
            # Forward and backward in probabilities, each step scaled to 1; beyond a line's end all is 1.
            emit = np.ones((longest, count, 3))
            emit[col, row] = np.exp(score - score.max(1, keepdims=True))
            move = np.exp(moves)
            alpha, beta, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((longest, count, 1))
            emit[length - 1, np.arange(count)] *= move[:, O]
            alpha[0] = emit[0] * move[O]
            for s in range(longest):
                if s:
                    alpha[s] = (alpha[s - 1] @ move) * emit[s]
                scale[s] = alpha[s].sum(1, keepdims=True)
                alpha[s] /= scale[s]
            live = (np.arange(longest)[:, None] < length[None])[:, :, None]
            for s in range(longest - 2, -1, -1):
                beta[s] = np.where(live[s + 1], (emit[s + 1] * beta[s + 1]) @ move.T / scale[s + 1], 1)
            error = -(alpha * beta)[col, row]
            labels = np.concatenate([data[i][1] for i in ids])
            error[np.arange(len(labels)), labels] += 1
            step = -((alpha[:-1, :, :, None] * (emit * beta / scale)[1:, :, None, :]) * live[1:, :, :, None]).sum((0, 1)) * move
            joined, firsts, lasts = (col[1:] > 0).nonzero()[0], (col == 0).nonzero()[0], np.cumsum(length) - 1
            np.add.at(step, (labels[joined], labels[joined + 1]), 1)
            step[O] += error[firsts].sum(0)  # what was expected and found at both ends of the runs
            step[:, O] += error[lasts].sum(0)
            gradient = np.stack([np.bincount(used.ravel(), np.repeat(error[:, k], FEATURES), len(known) + 1) for k in LABELS], -1)
            gradient[0] = 0
            gradient -= DECAY * len(data) * weights * (gradient != 0)
            squares += gradient**2
            weights += RATE * gradient / np.sqrt(squares)
            step[O, I] = 0
            moved += step**2
            moves += RATE * step / np.sqrt(moved)
    table = np.zeros((1 << BITS, 3), np.float32)
    table[known] = weights[1:]
    return Field(table, moves.astype(np.float32))


@lru_cache(maxsize=1)
def field() -> Field:
    return fit(labelled_lines(SAMPLE_LINES, SEED))


def cued(low: str) -> bool:
    """Whether a line in lower case is CUED."""
    for name in _NAMED:
        at = low.find(name)
        while at >= 0:
            at += len(name)
            if _GOES_ON.match(low, at) is None or "login " in low:
                return True
            at = low.find(name, at)
    for hint in _HINTS:
        if hint in low:
            return _PLACED.search(low) is not None
    return False


def _mixed(classes: bytes, cases: bytes, runs: bytes, plus: bytes) -> bool:
    """Whether a text, translated by each of the four tables, is MIXED. The rarest class of a sequence is looked for first."""
    if b"aA" in cases or b"xxxxxxxxxxxxxxxxxxxx" in runs or b"\0" in classes:
        return True
    digits = b"0" in classes
    if digits and (b"a0" in classes or b"0a" in classes or b"ap0" in classes or b"0pa" in classes):
        return True
    if b"s" in classes and (b"asa" in classes or b"as0" in classes or b"0sa" in classes or b"0s0" in classes):
        return True
    if b"q" in classes and (b"aqa" in classes or b"aq0" in classes or b"0qa" in classes or b"0q0" in classes):
        return True
    return b"p" in plus and b"apa" in plus


def _admissible(text: str) -> list[tuple[int, str]]:
    """(offset, line) of the lines of a text that may hold a credential: one that is CUED, or has a literal that is MIXED."""
    data = text.encode("utf-8", "surrogatepass")
    tables = [data.translate(t) for t in (_CLASSES, _CASES, _LONG, _PLUS)]
    low, mixed = text.lower(), _mixed(*tables)
    if not mixed and not cued(low):
        return []
    if b"\n" not in tables[0]:
        return [(0, text)]
    out, at = [], 0
    for line, *classes in zip(_LINE_END.split(text), *[t.split(b"\n") for t in tables]):
        if line and (mixed and _mixed(*classes) or cued(line.lower())):
            out.append((at, line))
        at += len(line) + 1
    return out


def spans_of(texts: list[str], model: Field) -> list[list[tuple[int, int]]]:
    """Character spans of the credentials in each text, in order."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    jobs: list[tuple[int, int, list[tuple[int, int]], list[int]]] = []  # text, offset of the line, blocks, numbers of the line's runs
    numbers: dict[str, list[int]] = {}
    runs: list[list[tuple[int, int]]] = []
    columns: list[tuple[int, ...]] = []
    begins: list[bool] = []
    continues: list[bool] = []
    for t, text in enumerate(texts):
        marked, blocks = prepared(text)
        for begin, line in _admissible(marked):
            mine = numbers.get(line)
            if mine is None:
                mine = numbers[line] = []
                for tokens, rows, may, goes in lex(line)[1]:
                    mine.append(len(runs))
                    runs.append(tokens)
                    columns += rows
                    begins += may
                    continues += goes
            if mine:
                jobs.append((t, begin, blocks, mine))
    if not columns:
        return found
    labels = model.viterbi(model.scores(columns, begins, continues), list(map(len, runs)))
    starts = [0, *accumulate(map(len, runs))]
    spans: list[list[tuple[int, int]]] = [[] for _ in runs]
    number = 0
    for i in np.nonzero(labels)[0].tolist():
        while starts[number + 1] <= i:
            number += 1
        a, b = runs[number][i - starts[number]]
        if labels[i] == B:
            spans[number].append((a, b))
        else:
            spans[number][-1] = (spans[number][-1][0], b)
    for t, begin, blocks, mine in jobs:
        for a, b in (span for number in mine for span in spans[number]):
            moved = [sum(more for end, more in blocks if end <= begin + x) for x in (a, b)] if blocks else [0, 0]
            found[t].append((begin + a + moved[0], begin + b + moved[1]))
    return found


def may_hold(text: Column) -> Column:
    """The row filter: every text that isn't null or empty may hold a credential."""
    return F.coalesce(text != "", F.lit(False))


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row_id, secret``: each distinct credential of each row, exactly as in the text.

    Whole texts are searched. Null and empty texts hold none; repeated rows count once.
    """
    model = field()
    weights, moves = model.weights, model.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Field(weights, moves)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = part.column(1).to_pylist()
                index, secrets = [], []
                for i, spans in enumerate(spans_of(texts, mine)):
                    for secret in {texts[i][a:b] for a, b in spans}:
                        index.append(i), secrets.append(secret)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index, pa.int64())), pa.array(secrets, pa.string())], names=["row_id", "secret"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.col("row_id").isNotNull() & may_hold(F.col("text")))
    return rows.mapInArrow(run, f"row_id {kind}, secret string").distinct()


def redact(df: DataFrame, text: str, out: str = "redacted", mark: str = "[REDACTED]") -> DataFrame:
    """``df`` with ``out``: the text with only the credentials replaced by ``mark``, everything around them unchanged.

    Rows, their order within partitions and other columns are kept; a column
    named ``out`` is replaced. Null stays null.
    """
    model = field()
    weights, moves = model.weights, model.moves
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Field(weights, moves)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = part.column(at).to_pylist()
                clean = list(texts)
                held = [i for i, t in enumerate(texts) if t]
                for i, spans in zip(held, spans_of([texts[i] for i in held], mine)):
                    for a, b in reversed(spans):
                        clean[i] = clean[i][:a] + mark + clean[i][b:]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(clean, pa.string())], names=[*names, "__out"])

    plain = df.toDF(*names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    done = plain.mapInArrow(run, f"{fields}, __out string")
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns) if c != out], F.col("__out").alias(out))
