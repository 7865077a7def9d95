"""PII by a semi-Markov conditional random field.

Patterns give the base spans.  Around whatever may be personal data (digits, at
signs and their spelt forms, words like password, long runs of letters) a
semi-Markov CRF then scores whole candidate segments, of at most LONGEST tokens,
by features of the whole span and its context; transitions between neighbouring
labels are scored too, and one dynamic programme over the stretch, of any length,
chooses boundaries and types jointly.  What it finds beside the base spans is
added, among it secrets that follow no fixed pattern.

The field is trained here (train), by the likelihood of whole segmentations of
generated sentences; its weights lie beside this module, in _pii_weights.py.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from astrel.llm import _spark as S

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: Tokens of the longest entity; a key block of any length is one token.
LONGEST = 24
#: Words on either side of a sign of personal data that are looked at.
AROUND = 3
#: Characters before a span that its features may see.
BEFORE = 64
#: Tokens whose candidates are scored at once.
STEP = 2000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDS = r"pass(?:word|wd|phrase|code)?s?|pwd|pin|secret|token|api[ _-]?key|key|bearer|credentials?|auth(?:orization)?|login"
#: Signs of personal data; a run of 20 letters, digits or dashes counts as one.
_TRIGGER = re.compile(rf"[0-9@]|[\[(]\s?(?:at|dot)\s?[\])]|\bdot\b|\b(?:\w+[_-])?(?:{_WORDS})\b|-----BEGIN|[A-Za-z_+/-]{{20}}", re.I)
_SPACE = re.compile(r"\s")
#: What is quoted behind a word like password.
_QUOTE = re.compile(r"[\"']?\s{0,3}[:=]*>?\s{0,3}(?:\"[^\"\n]*\"|'[^'\n]*')")
_WORD = re.compile(r"\S+")
_BLOCK = r"-----BEGIN [A-Z ]+-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z ]+-----"
_TOKEN = re.compile(rf"{_BLOCK}|[^\W_]+|[^\s\w]|_")
_KEY = re.compile(rf"(?<![^\W_])(?:\w+[_-])?(?:{_WORDS})(?:s|\d{{1,3}}|(?:[_-]\w+)+)?(?![^\W_])[\"']?\]?\s{{0,3}}([:=]+>?|\bis\b|\bwas\b|)\s{{0,3}}[\"'`]?$", re.I)
_AT = r"\s?(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\sat\s)\s?"
_DOT = r"(?:\.|\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\sdot\s)\s?)"
_EMAIL_LIKE = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_SPELT = re.compile(r"[\[(]\s?(?:at|dot)\s?[\])]|\s(?:at|dot)\s|@", re.I)
_DATE = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}:\d{2}(?::\d{2})?|\d{4}-\d{2}-\d{2}T[\d:.]+Z?")
_NUMBER = re.compile(r"[$€£]?\d{1,3}(?:[,.]\d{3})*(?:[.,]\d+)?%?")
_CALL = re.compile(r"(?:tel|phone|call|mobile|cell|fax|ring|dial|whatsapp|sms|text|contact)\w*\.?\s*(?:me|us|no|number|nr|at|on)?\.?\s*(?:is)?\s*[:#]?\s*$", re.I)
_SSN_WORD = re.compile(r"(?:ssn|social security|soc\.? sec|tax id|tin)[\w .#]{0,12}[:#]?\s*$", re.I)
_CARD_WORD = re.compile(r"(?:card|visa|mastercard|amex|credit|debit|pan)[\w .#]{0,12}[:#]?\s*$", re.I)
_SSN = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}")
_IP6 = re.compile(r"(?=(?:[^:]*:){2})(?:[0-9A-Fa-f]{1,4}(?::|::)){1,7}[0-9A-Fa-f]{1,4}")
_CALLABLE = re.compile(r"\(\d{2,4}\) ?\d{3,4}[-. ]\d{3,4}|\d{3}[-. ]\d{3}[-. ]\d{4}|0\d{1,4}[-/ ]\d{2,4}(?:[- ]?\d{2,4}){1,3}|00\d{1,3}[- ]\d{1,4}(?:[- ]?\d{2,4}){1,3}|\+\d[\d(). -]{7,}\d")
_ISSUED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|AIza|ya29\.|eyJ|npm_|SG\.|hf_|dop_)")
_PLAIN = re.compile(r"[A-Za-z0-9_+/=.~-]+")
_NOTHING = frozenset("none null nil true false required string value your here example change changed empty optional invalid missing wrong expired field text name number reset".split())
_NUMERIC = frozenset("0123456789 ()+-./")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches: leftmost, not overlapping within a kind, failing ones dropped.

    Each kind is found in time linear in the text: an address is looked for around
    its at sign, since its local part can only be the run of signs before it.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def regions(text: str):
    """Stretches that may hold personal data, as (start, end): the words that show signs of it and AROUND words on either side."""
    first = last = None
    m = _TRIGGER.search(text)
    while m:
        start, end = m.start(), m.end()
        if text.startswith("-----BEGIN", start):
            block = _TOKEN.match(text, start)
            end = max(end, block.end())
        for _ in range(AROUND + 1):
            while start and not text[start - 1].isspace():
                start -= 1
            back = start
            while back and text[back - 1].isspace():
                back -= 1
            if _ < AROUND and back and start - back <= 3:
                start = back
        space = _SPACE.search(text, end)
        sign = end = space.start() if space else len(text)
        for _ in range(AROUND):
            word = _WORD.search(text, end, end + 400)
            if not word or word.start() - end > 3:
                break
            space = _SPACE.search(text, word.end())
            end = space.start() if space else len(text)
        quote = _QUOTE.match(text, m.end(), m.end() + 400)
        if quote and text[m.start()].isalpha():
            end = max(end, quote.end())
        if last is not None and start <= last:
            last = max(end, last)
        else:
            if last is not None:
                yield first, last
            first, last = start, end
        m = _TRIGGER.search(text, sign)
    if last is not None:
        yield first, last


def features(span: str, before: str, after: str) -> list[float]:
    """Features of a whole segment and what stands before and after it."""
    n = len(span)
    digits = "".join(c for c in span if "0" <= c <= "9")
    d, letters = len(digits), sum(c.isalpha() for c in span)
    plain = _PLAIN.fullmatch(span) is not None
    block = span.startswith("-----BEGIN") and n > 60
    key = _KEY.search(before)
    sign = key.group(1) if key else None
    strong, weak = bool(key and sign and sign[0] in ":="), bool(key and not (sign and sign[0] in ":="))
    quoted = bool(before) and before[-1] in "\"'`" and bool(after) and after[0] == before[-1]
    mixed = d > 0 and letters > 0
    cased = letters > 1 and span != span.lower() and span != span.upper() and not span.istitle()
    hexa = plain and all(c in "0123456789abcdefABCDEF" for c in span)
    number = letters == 0 and d > 0
    parts = span.split(".")
    quad = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    octets = quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    switches = sum(_shape(a) != _shape(b) for a, b in zip(span, span[1:], strict=False)) / n if n <= 4096 else 0.3
    lucky = number and 12 <= d <= 19 and luhn(digits)
    glued = bool(before) and (before[-1].isalnum() or before[-1] in "_+-./@" and span[0].isalnum())
    follows = bool(after) and (after[0].isalnum() or after[0] in "_@" or after[0] in "-./+=" and len(after) > 1 and after[1].isalnum())
    email = _EMAIL_LIKE.fullmatch(span) is not None
    return [
        1.0, math.log1p(min(n, 400)) / 3, d / n, letters / n, float(block),
        float(email), float(email and "@" not in span), float("://" in span or span.count("/") > 1), float("@" in span and not email), float("@" in span and "." not in span),
        float(octets), float(quad and not octets), float(_IP6.fullmatch(span) is not None and (d > 0 or n > 7)),
        float(lucky), float(number and 12 <= d <= 19 and not lucky), float(lucky and _CARD_WORD.search(before) is not None),
        float(number and _CALLABLE.fullmatch(span) is not None and 7 <= d <= 15), float(number and 7 <= d <= 15), float(number and _CALL.search(before) is not None and 6 <= d <= 15), float(number and span[0] in "+(" and 7 <= d <= 15),
        float(_SSN.fullmatch(span) is not None), float(d == 9 and number and _SSN_WORD.search(before) is not None), float(_SSN.fullmatch(span) is not None and _SSN_WORD.search(before) is not None),
        float(strong), float(weak), float(strong and plain and n >= 6), float(strong and plain and n >= 12), float(strong and (mixed or cased) and n >= 5), float(strong and quoted and n >= 4),
        float(weak and mixed and n >= 6), float(weak and cased and n >= 6), float(weak and quoted and n >= 5), float(weak and plain and n >= 16), float(bool(key) and d == 0 and span.lower() in _NOTHING), float(bool(key) and d > 0 and letters == 0),
        float(bool(key) and n < 5), float(plain and _ISSUED.match(span) is not None and n >= 16), float(hexa and mixed and n >= 16), float(hexa and mixed and n >= 32), float(plain and mixed and n >= 16), float(plain and mixed and cased and n >= 20),
        float(plain and span.upper() == span and mixed and n >= 12), switches, float(plain and switches > 0.35 and n >= 16), float(d == 0 and plain and n >= 20),
        float(_DATE.fullmatch(span) is not None), float(_NUMBER.fullmatch(span) is not None), float(" " in span), float(not plain), float(glued), float(follows), float(quoted),
    ]


FEATURES = len(features("a", "", ""))


def _shape(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if c.islower() else 2 if c.isupper() else 3


def candidates(text: str, start: int, end: int, blocked=()):
    """(tokens, iterator of (first, last, features)) of text[start:end], by last token: segments that may be entities.

    A segment has at most LONGEST tokens and begins and ends where a word or a
    bracketed or quoted part does.  It is one run without white space, or a number
    with its separators, or an address with spelt signs, or the inside of quotes
    behind a word like password.  blocked: disjoint ascending spans that none may overlap.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    opens = [a == start or not text[a - 1].isalnum() and text[a - 1] != "_" for a, _ in tokens]
    closes = [b == len(text) or not text[b].isalnum() and text[b] != "_" for _, b in tokens]
    ends = [b for _, b in blocked]

    def free(a, b):
        k = bisect.bisect_right(ends, a)
        return k == len(ends) or blocked[k][0] >= b

    def each():
        for j, (_, b) in enumerate(tokens):
            if not closes[j] or not (text[b - 1].isalnum() or text[b - 1] in "=_-+/"):
                continue
            number = True
            for i in range(j, max(j - LONGEST, -1), -1):
                a, first_end = tokens[i]
                piece = text[a:first_end]
                number = number and all(c in _NUMERIC for c in piece)
                spaced = i < j and first_end < tokens[i + 1][0]
                if spaced:
                    gap = text[first_end : tokens[i + 1][0]]
                    if len(gap) > 3 or gap.count("\n") > 1:
                        break
                if not opens[i] or not (piece[0].isalnum() or piece[0] in "+(-"):
                    continue
                if piece[0] == "-" and not piece.startswith("-----BEGIN"):
                    continue
                span = text[a:b]
                block = len(piece) > 60 and piece.startswith("-----BEGIN")
                if block and i < j:
                    break
                if not free(a, b):
                    break
                before = text[max(0, a - BEFORE) : a]
                whole = not _SPACE.search(span)
                if not (block or whole or number or _EMAIL_LIKE.fullmatch(span) or before[-1:] in ("'", '"', "`") and before[-1:] == text[b : b + 1] and _KEY.search(before)):
                    continue
                if not (block or len(span) >= 20 or any("0" <= c <= "9" for c in span) or _SPELT.search(span) or _KEY.search(before)):
                    continue
                yield i, j, features(span, before, text[b : b + 2])

    return tokens, each()


class Field:
    """weights: features x kinds; steps: score of a label after the one before it, label 0 for a token outside entities."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def decode(self, n: int, spans) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens as (first token, last token, kind); spans come by last token."""
        labels = len(self.steps)
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0.0
        come = np.zeros((n + 1, labels))  # best score of a label that begins at a token
        come_from = np.zeros((n + 1, labels), np.int32)
        begin = np.zeros((n + 1, labels), np.int32)
        spans, held, at = iter(spans), [], 0
        more = next(spans, None)

        def arrive(t):
            through = best[t][:, None] + self.steps
            come_from[t] = through.argmax(0)
            come[t] = through.max(0)

        arrive(0)
        while at < n:
            stop, held = min(at + STEP, n), []
            while more is not None and more[1] < stop:
                held.append(more)
                more = next(spans, None)
            scores = np.array([f for *_, f in held]) @ self.weights if held else None
            k = 0
            for t in range(at + 1, stop + 1):
                best[t, 0], begin[t, 0] = come[t - 1, 0], t - 1
                while k < len(held) and held[k][1] == t - 1:
                    i = held[k][0]
                    got = come[i, 1:] + scores[k]
                    better = got > best[t, 1:]
                    if better.any():
                        best[t, 1:][better] = got[better]
                        begin[t, 1:][better] = i
                    k += 1
                arrive(t)
            at = stop
        out, t, y = [], n, int(best[n].argmax())
        while t:
            i = int(begin[t, y])
            if y:
                out.append((i, t - 1, y - 1))
            t, y = i, int(come_from[i, y])
        return out[::-1]

    def spans(self, text: str, start: int, end: int, blocked=()) -> list[tuple[int, int, int]]:
        """Entities in text[start:end] as (start, end, kind)."""
        tokens, spans = candidates(text, start, end, blocked)
        first = next(spans, None)
        if first is None:
            return []
        rest = (x for group in ((first,), spans) for x in group)
        return [(tokens[i][0], tokens[j][1], k) for i, j, k in self.decode(len(tokens), rest)]

    def likelihood(self, n: int, spans, scores: np.ndarray, gold):
        """(log likelihood of gold, expected less true use of each candidate and label, of each step) over n tokens."""
        labels = len(self.steps)
        by_end, by_start = {}, {}
        for c, (i, j) in enumerate(spans):
            by_end.setdefault(j + 1, []).append((i, c))
            by_start.setdefault(i, []).append((j + 1, c))
        # fore[t, y]: the first t tokens, the last segment labelled y; aft[t, y]: what follows that
        fore, aft = np.full((n + 1, labels), -1e30), np.full((n + 1, labels), -1e30)
        come = np.full((n + 1, labels), -1e30)
        fore[0, 0] = 0.0
        for t in range(n + 1):
            if t:
                fore[t, 0] = come[t - 1, 0]
                if t in by_end:
                    fore[t, 1:] = np.logaddexp.reduce([come[i, 1:] + scores[c] for i, c in by_end[t]], axis=0)
            come[t] = np.logaddexp.reduce(fore[t][:, None] + self.steps, axis=0)
        leave = np.full((n + 1, labels), -1e30)  # what a segment that begins at t and all after it are worth
        aft[n] = 0.0
        for t in range(n - 1, -1, -1):
            leave[t, 0] = aft[t + 1, 0]
            if t in by_start:
                leave[t, 1:] = np.logaddexp.reduce([scores[c] + aft[e, 1:] for e, c in by_start[t]], axis=0)
            aft[t] = np.logaddexp.reduce(self.steps + leave[t][None], axis=1)
        total = np.logaddexp.reduce(fore[n])
        use = np.array([np.exp(come[i, 1:] + scores[c] + aft[j + 1, 1:] - total) for c, (i, j) in enumerate(spans)]).reshape(len(spans), labels - 1)
        steps = np.exp(np.clip(fore[:n, :, None] + self.steps[None] + leave[:n, None] - total, -700, 0)).sum(0)
        value, t, y = -total, 0, 0
        where = {i: (j, c, k) for (i, j), c, k in ((spans[c], c, k) for c, k in gold)}
        while t < n:
            j, c, k = where.get(t, (t, None, None))
            label = 0 if c is None else k + 1
            value += self.steps[y, label] + (0.0 if c is None else scores[c, k])
            steps[y, label] -= 1
            if c is not None:
                use[c, k] -= 1
            t, y = j + 1, label
        return value, use, steps


def _example(r: random.Random):
    """A generated sentence: (text, {(start, end): kind})."""
    low = "abcdefghijklmnopqrstuvwxyz"
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    word = lambda a=2, b=8: pick(low, r.randint(a, b))
    num = lambda n: pick("0123456789", n)
    hexa = lambda n: pick("0123456789abcdef", n)
    big = lambda n: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", n)
    any_ = lambda n: pick(low + low.upper() + "0123456789", n)
    camel = lambda: word(3, 6) + word(3, 6).title() + r.choice(("", word(2, 4).title()))

    def card(ok=True):
        d = num(r.choice((15, 15, 14, 12, 18)))
        d += next(c for c in "0123456789" if luhn(d + c) == ok)
        return r.choice(("", " ", "-", ".", "/", ".")).join([d] if r.random() < 0.3 else [d[i : i + 4] for i in range(0, len(d), 4)])

    octet = lambda: str(r.randint(0, 255))
    at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "."), (" @ ", "."), ("@", ".")))
    tld = lambda: r.choice(("com", "org", "net", "de", "io", "edu"))
    mixed = lambda: r.choice((word(3, 7) + num(r.randint(1, 4)) + word(0, 4), any_(r.randint(8, 24)), camel() + num(2), word(4, 6).title() + pick("!#$%", 1) + num(3)))
    key = lambda: r.choice(("password", "passwd", "pwd", "token", "secret", "api_key", "API key", "apikey", "access_token", "passphrase", "client-secret", "auth", "DB_PASSWORD", "login", "credential", "pin"))
    sign = lambda: r.choice(("=", ": ", " = ", ":", " := "))

    def held_in_quotes():
        mark = r.choice(('"', "'"))
        return key() + sign() + mark, r.choice((hexa(40), mixed(), word(6, 16), any_(r.randint(16, 300)), " ".join(word(3, 7) for _ in range(r.randint(3, 5))))), mark

    phone = lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"00{r.randint(1, 9)}{num(1)} {num(3)} {num(6)}", f"0{num(3)}/{num(3)} {num(3)}", f"+{num(2)} {num(3)} {num(7)}", f"0{num(4)}-{num(6)}"))
    block = lambda: "-----BEGIN " + (k := r.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"))) + "-----\n" + "\n".join(pick(low + low.upper() + "0123456789+/", 40) for _ in range(r.randint(2, 5))) + f"\n-----END {k}-----"
    long_word = lambda: r.choice(("internationalization", "counterrevolutionaries", "well-known-and-often-used", word(20, 26), "src/main/java/org/example/thing", "see_the_other_function_name"))
    makers = [
        (0, lambda: ("", f"{word(3, 7)}{r.choice(('.', '_', '', '-'))}{r.choice((num(r.randint(1, 3)), word(3, 6)))}{at}{word(3)}{r.choice(('', num(1), '-' + word(2, 4)))}{dot}{r.choice((tld(), word(3, 5) + dot + tld()))}", "")),
        (0, lambda: ("mail: ", f"{word(3, 7)}{at}{word(3)}{dot}{tld()}", "")),
        (1, lambda: ("", ".".join(octet() for _ in range(4)), r.choice(("", ".", ",", ":8080", "/24")))),
        (1, lambda: ("", r.choice((":".join(hexa(4) for _ in range(8)), f"{hexa(4)}:{hexa(3)}::{hexa(2)}", f"fe80::{hexa(4)}:{hexa(4)}")), "")),
        (2, lambda: (r.choice(("", "card ", "visa: ", "card number ")), card(), r.choice(("", ".")))),
        (3, lambda: (r.choice(("", "call ", "tel. ", "phone: ")), phone(), "")),
        (3, lambda: (r.choice(("call ", "tel: ", "phone ", "fax: ", "mobile no ")), r.choice((num(7), num(10), f"{num(3)} {num(4)}", f"{num(3)}-{num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}")), "")),
        (4, lambda: (key() + sign(), r.choice((hexa(r.randint(12, 40)), big(20), mixed(), mixed(), word(9, 22), camel(), num(r.randint(6, 9)))), "")),
        (4, held_in_quotes),
        (4, lambda: (r.choice((key() + " is ", key() + " ", "Bearer ", key() + " was ")), r.choice((mixed(), camel(), any_(20), word(17, 24))), "")),
        (4, lambda: ("", r.choice(("AKIA" + big(16), hexa(40), hexa(32), "ghp_" + any_(36), "sk_live_" + any_(24), "sk-" + any_(40), "xoxb-" + num(11) + "-" + any_(24), "AIza" + any_(35), "glpat-" + any_(20), any_(r.randint(24, 60)), f"eyJ{any_(18)}.{any_(30)}.{any_(30)}", block())), "")),
        (5, lambda: (r.choice(("SSN ", "ssn: ", "", "social security number ", "SSN#")), f"{num(3)}-{num(2)}-{num(4)}", r.choice(("", ".")))),
        (5, lambda: (r.choice(("SSN ", "ssn: ", "social security no. ")), r.choice((num(9), f"{num(3)} {num(2)} {num(4)}")), "")),
    ]
    clean = [
        lambda: r.choice((num(r.randint(1, 6)), card(False), num(16), f"{num(4)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{num(1)}.{num(1)}.{num(2)}", f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(3)}", f"{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", word() + num(2), f"${num(3)}.{num(2)}", f"{num(3)}%", "@" + word(), f"{word()}@{word()}", hexa(6) + "1", f"{num(3)},{num(3)}", f"{num(2)}-{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(7)}", f"{num(9)}", f"No. {num(5)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)} {num(4)}", f"v{num(1)}.{num(2)}", f"{num(2)} {word()} {num(3)}", f"{word(3, 5).upper()}-{num(4)}")),
        lambda: f"the {key()} {r.choice(('is', 'was', 'for', 'of', 'and', 'that', ''))} {r.choice(('wrong', 'required', 'expired', word(), word(3, 12), 'missing'))}",
        lambda: f"{key()}{sign()}{r.choice(('none', 'null', 'true', 'required', 'string', 'your', 'optional', 'example', word(1, 3)))}",
        lambda: f"{word()} {r.choice(('at', 'dot'))} {word()} {word()}", lambda: f"a {word()} dot and {word()} at {word()} or", lambda: long_word(), lambda: f"({word()}) [{word()}] {word()}-{word()}", lambda: f"http://{word()}.{tld()}/{word()}/{num(4)}",
        lambda: f"{word().title()} {word()} {num(2)} {word()}", lambda: f"{word()}_{word()}({num(1)})",
    ]
    text, gold = "", {}
    for _ in range(r.randint(1, 4)):
        text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
        if r.random() < 0.5:
            text += r.choice((clean[0], r.choice(clean)))()
        else:
            kind, make = r.choice(makers)
            lead, span, tail = make()
            text += lead
            gold[len(text), len(text) + len(span)] = kind
            text += span + tail
        text += r.choice((" ", ". ", "\n", ", "))
    return text, gold


def examples(count: int, seed: int):
    """Generated stretches as (tokens, candidate segments, features, gold as (candidate, kind))."""
    r, out = random.Random(seed), []
    for _ in range(count):
        text, gold = _example(r)
        for start, end in regions(text):
            tokens, spans = candidates(text, start, end)
            spans = list(spans)
            if spans:
                # what no candidate covers exactly can't be learnt
                true = [(c, gold[x]) for c, (i, j, _) in enumerate(spans) if (x := (tokens[i][0], tokens[j][1])) in gold]
                out.append((len(tokens), [(i, j) for i, j, _ in spans], np.array([f for *_, f in spans]), true))
    return out


def loss(field: Field, data, ridge: float = 0.02):
    """(negative log likelihood with a ridge, its slope in the weights, its slope in the steps)."""
    value = 0.5 * ridge * ((field.weights**2).sum() + (field.steps**2).sum())
    slope_w, slope_s = ridge * field.weights, ridge * field.steps
    for n, spans, f, gold in data:
        v, use, steps = field.likelihood(n, spans, f @ field.weights, gold)
        value -= v
        slope_w = slope_w + f.T @ use
        slope_s = slope_s + steps
    return value, slope_w, slope_s


#: How the shipped weights were trained.
TRAINED = {"count": 1600, "seed": 5, "rounds": 45}


def train(count: int, seed: int, rounds: int) -> Field:
    """A field fitted by the likelihood of whole segmentations of generated sentences."""
    data, kinds = examples(count, seed), len(KINDS)
    field = Field(np.zeros((FEATURES, kinds)), np.zeros((kinds + 1, kinds + 1)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.steps)]
    for step in range(1, rounds + 1):
        _, *slopes = loss(field, data)
        rate = 0.3 * min(1.0, 2 * (1 - step / (rounds + 1)))
        new = []
        for x, slope, mv in zip((field.weights, field.steps), slopes, state, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * slope
            mv[1] = 0.99 * mv[1] + 0.01 * slope**2
            new.append(x - rate * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8))
        field = Field(*new)
    return field


@functools.cache
def trained() -> Field:
    """The field with the shipped weights."""
    from astrel.llm import _pii_weights as W

    return Field(np.array(W.WEIGHTS), np.array(W.STEPS))


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the field adds); added spans overlap no base span and no other."""
    base = base_spans(text)
    blocked: list[tuple[int, int]] = []
    for a, b, _ in base:
        if blocked and a < blocked[-1][1]:
            blocked[-1] = (blocked[-1][0], max(b, blocked[-1][1]))
        else:
            blocked.append((a, b))
    ends = [b for _, b in blocked]
    added = []
    for start, end in regions(text):
        some = blocked[bisect.bisect_right(ends, start) : bisect.bisect_left(blocked, (end,))]
        added += field.spans(text, start, end, some)
    return base, added


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data in docs(doc_id, text, ...).

    Returns for each row of docs: doc_id; n_email, n_ip, n_card, n_phone (base
    spans); n_secret and n_added (spans the field adds), n_spans (all spans);
    base_sha256 of the base spans and spans, all spans, both as kind:start:end in code
    points, end exclusive, by start and then kind.

    Null texts count as empty; repeated rows give repeated results; texts are read
    whole, in time linear in their length; other columns are ignored.
    """
    field = field or trained()

    def over(batch):
        rows = []
        for text in batch.column(1).to_pylist():
            base, added = find(text, field) if text else ([], [])
            kinds = [k for *_, k in base]
            rows.append((*(kinds.count(k) for k in range(4)), sum(k == 4 for *_, k in added), len(added), len(base) + len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
        cols = list(zip(*rows, strict=True)) or [[]] * 9
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_added", "n_spans", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if i < 7 else pa.string()) for i, c in enumerate(cols))], names=names)

    return S.map_arrow(S.text_ids(docs), over, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_added long, n_spans long, base_sha256 string, spans string")
