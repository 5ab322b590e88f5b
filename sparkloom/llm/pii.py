"""Personal data behind disguises, found with offsets in the source.

Transducers rewrite a text step by step, each keeping the ranges it replaced: characters that look like
ASCII ones become these and invisible ones vanish; runs of spelled digits and figures, of seven digits, four
words and two different ones at least, become digits; "[at]", "(dot)", "name at host dot tld", "name @ host . com"
and, where the name is no common word of prose and the last label a known one, "name at host.tld" become @ and
dots. Each step takes time in proportion to the text. Identifiers are detected in the normalised text, and their ranges are mapped back through the steps to characters of the source, whose spans are
replaced by the identifier's kind.

Kinds: SECRET with a form of its own (cloud keys, signed tokens, private keys), EMAIL, SECRET after a name or of 32 hex
digits and more, CARD (13 to 19 digits that pass Luhn's check), ACCOUNT (those that don't, of one group of digits), IBAN (of
right checksum), SSN, IP (of version 4 or 6), PHONE. Spans don't overlap; an earlier kind of this list wins. A null text stays null, with no spans.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import col, extended

_LOOKS = {
    "a": "аɑα", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іı", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "＠﹫", ".": "．。․﹒", "-": "‐‑‒–—−－", "+": "＋", "(": "（", ")": "）", " ": "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000", ":": "：", "_": "＿", '"': "“”",
}
FOLD = {ord(x): k for k, many in _LOOKS.items() for x in many}
for _i in range(10):
    FOLD |= {base + _i: str(_i) for base in (0xFF10, 0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)}
for _i in range(26):
    FOLD |= {0xFF21 + _i: chr(65 + _i), 0xFF41 + _i: chr(97 + _i)}
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_STRANGE = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(FOLD)) + _INVISIBLE + "]")
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")

_DIGITS = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())} | {"oh": "0", "fuenf": "5"}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_WORD})|\d+)(?:[\s.,\-]+(?:(?:{_WORD})|\d+)(?!\w))+", re.IGNORECASE)
_TWO = re.compile(rf"(?<!\w)(?:{_WORD})[\s.,\-]+(?:{_WORD})(?!\w)", re.IGNORECASE)
_PART = re.compile(rf"{_WORD}|\d+", re.IGNORECASE)

_BRACED = re.compile(r"\s*[\[({<]\s*(at|dot|@|\.)\s*[\])}>]\s*", re.IGNORECASE)
_AT = re.compile(r"(?<=[\w+\-])\s+(at)\s+(?=\w)", re.IGNORECASE)
_SPACED = re.compile(r"(?<=[\w+\-])(?:\s+@\s*|@\s+)(?=\w)")
#: What follows "at": a host whose dots are all spelled; one with dots of either kind; one with blanks around dots.
_HOST_DOTS = re.compile(r"[\w\-]+(?:\s+dot\s+[\w\-]+)+", re.IGNORECASE)
_HOST_MIXED = re.compile(r"[\w\-]+(?:(?:\.|\s+dot\s+)[\w\-]+)+", re.IGNORECASE)
_HOST_SPACED = re.compile(r"[\w\-]+(?:\s*\.\s*[\w\-]+)*?\s*\.\s*(?:com|org|net|edu|gov|info|biz|io)(?!\w)", re.IGNORECASE)
_DOT = re.compile(r"\s+dot\s+|\s+\.\s*|\.\s+", re.IGNORECASE)
_BEFORE = re.compile(r"(?:\.|\s+dot\s+)$", re.IGNORECASE)
_TOP = frozenset("com org net edu gov mil int info biz io co ai dev app de fr es ru uk us eu it nl pl ch at ca au jp cn br in example test".split())
#: Words that come before "at example.com" in plain prose.
_PROSE = frozenset("a about again all also and are arrive arrived available be been book buy call check click contact day days directly down download ever everything far find first for found free from get go going had hand have he her here him home hosted i information in is it items join just last later left life listed live lives located look looked looking me meet more mail email now of off offered on once one online only or order out over page pages people place posted price prices published read register seen see sell she shop sign site sold someone something start stay stop store sure team that them then there they thing things this time today up us version visit was way we website well were what work works you".split())

_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*(\"[^\"\n]+\"|'[^'\n]+'|[^\s\"']{6,}))|(?<![0-9A-Za-z])([0-9a-f]{32,})(?![0-9A-Za-z])", re.IGNORECASE)
#: Keys and tokens of a form of their own: of cloud services and code hosts, signed web tokens, private key blocks.
_KEY = re.compile(r"(?<![0-9A-Za-z])(?:A(?:KIA|SIA|GPA|IDA|ROA)[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|gh[opsur]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z\-]{10,}|sk[-_](?:live_|test_)?[0-9A-Za-z]{20,}|eyJ[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,}\.[0-9A-Za-z_\-]{10,})(?![0-9A-Za-z])|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----")
_KEY_HINT = re.compile(r"A(?:KI|SI|GP|ID|RO)A[0-9A-Z]|AIza|gh[opsur]_|xox[abprs]-|sk[-_]|eyJ|-----BEGIN")
_LONG = re.compile(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)")
_GROUP = re.compile(r"\d+")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
#: Hexadecimal groups between colons, of which `ipaddress` tells whether they are an address.
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4})?(?:::?[0-9A-Fa-f]{1,4}){2,8}(?:::)?(?![\w:])")
_PHONE = re.compile(r"(?<![\d.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3}[ .\-]?\d{4}(?![\d])|(?<!\d)\+\d{7,15}(?!\d)")

Edit = tuple[int, int, int, int]  # start and end in the input, start and end in the output


class Trace:
    """A text and the steps that made it of a source."""

    def __init__(self, text: str):
        self.text, self.steps = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges, in order and apart, of the text as it is now."""
        if not edits:
            return
        out, made, at, size = [], [], 0, 0
        for start, end, new in edits:
            out += self.text[at:start], new
            size += start - at
            made.append((start, end, size, size + len(new)))
            size += len(new)
            at = end
        self.text = "".join(out) + self.text[at:]
        self.steps.append((made, [e[2] for e in made]))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters that a range of the text came from."""
        for made, starts in reversed(self.steps):
            i = bisect_right(starts, start) - 1
            if i >= 0:
                a, b, c, d = made[i]
                start = (a if c < d else b) if start < d or start == c < d else start - d + b
            i = bisect_right(starts, end - 1) - 1
            if i >= 0:
                a, b, c, d = made[i]
                end = b if end <= d and c < d else end - d + b
        return start, end


def normalise(text: str) -> Trace:
    trace = Trace(text)
    if not text.isascii() and _STRANGE.search(text):
        trace.text = text.translate(FOLD)  # one character for one, so offsets stay
        trace.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(trace.text)])
    if _TWO.search(trace.text):
        edits = []
        for m in _SPELLED.finditer(trace.text):
            parts = [w.lower() for w in _PART.findall(m[0])]
            spelled = [w for w in parts if w in _DIGITS]
            digits = "".join(_DIGITS.get(w, w) for w in parts)
            # few words among figures, or one word over and over, are no spelled number
            if len(digits) > 6 and len(set(spelled)) > 1 and len(spelled) > 3:
                edits.append((m.start(), m.end(), digits))
        trace.rewrite(edits)
    trace.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACED.finditer(trace.text)])
    trace.rewrite(_addresses(trace.text))
    return trace


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """The edits that make "ann dot lee at example dot com", "ann at example.com" and "ann @ example . com" addresses."""
    found = [(m, m.start(1), m.end(1)) for m in _AT.finditer(text)] if _AT.search(text) else []
    if "@" in text:
        found += [(m, m.start(), m.end()) for m in _SPACED.finditer(text)]
    edits: list[tuple[int, int, str]] = []
    for m, _, _ in sorted(found, key=lambda f: f[1]):
        done = edits[-1][1] if edits else 0
        start = m.start()
        if start < done:
            continue
        while True:  # words joined by dots, leftwards
            while start > done and (text[start - 1].isalnum() or text[start - 1] in "_+-"):
                start -= 1
            before = _BEFORE.search(text, max(done, start - 16), start)
            if not before or before.start() == done or not (text[before.start() - 1].isalnum() or text[before.start() - 1] in "_+-"):
                break
            start = before.start()
        name = text[start : m.start()]
        if not name:
            continue
        if "@" in m[0]:
            host = _HOST_SPACED.match(text, m.end()) or _HOST_MIXED.match(text, m.end())
            ok = host and (host[0].rpartition(".")[2].strip().lower() in _TOP)
        else:
            host = _HOST_DOTS.match(text, m.end()) or _HOST_MIXED.match(text, m.end())
            last = host and re.split(r"[.\s]", host[0])[-1].lower()
            ok = host and (" dot " in f" {' '.join(host[0].lower().split())} " and last.isalpha() and len(last) > 1 or last in _TOP and name.lower() not in _PROSE)
        if not ok:
            continue
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, start, m.start())]
        edits.append((m.start(), m.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, m.end(), host.end())]
    return edits


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Cards and accounts of 13 to 19 digits: whole groups of digits, as what follows a blank may be another number."""
    for m in _LONG.finditer(text):
        groups, at = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())], 0
        while at < len(groups):
            for end in range(len(groups), at, -1):
                a, b = groups[at][0], groups[end - 1][1]
                digits = re.sub(r"\D", "", text[a:b])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    yield "CARD", a, b
                    break
                if end == at + 1 and len(digits) >= 13:
                    yield "ACCOUNT", a, b
                    break
            else:
                end = at + 1
            at = end


def _found(text: str, spelled: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    if _KEY_HINT.search(text):
        for m in _KEY.finditer(text):
            yield "SECRET", *m.span()
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while start < at and text[start] in ".-+%":
            start += 1
        host = _HOST.match(text, at + 1)
        if host and start < at:
            yield "EMAIL", start, host.end()
        at = text.find("@", at + 1)
    if not re.search(r"\d", text):
        if '"' in text or "=" in text or ":" in text:
            for m in _SECRET.finditer(text):
                yield "SECRET", *m.span(1 if m[1] else 2)
        return
    for m in _SECRET.finditer(text):
        yield "SECRET", *m.span(1 if m[1] else 2)
    yield from _numbers(text)
    for m in _IBAN.finditer(text):
        end = m.end()
        while end - m.start() > 14:  # a word after it may have been taken for its last group
            code = text[m.start() : end].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                yield "IBAN", m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
    for m in _SSN.finditer(text):
        yield "SSN", *m.span()
    for m in _IP.finditer(text):
        if all(int(x) < 256 for x in m[0].split(".")):
            yield "IP", *m.span()
    for m in _IP6.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        yield "IP", *m.span()
    for m in _PHONE.finditer(text):
        yield "PHONE", *m.span()
    for start, end in spelled:
        yield "PHONE", start, end


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each identifier, as characters of the source, by start."""
    trace = normalise(text)
    spelled = [m.span() for m in re.finditer(r"(?<!\d)\d{7,12}(?!\d)", trace.text) if any(c.isalpha() for c in text[slice(*trace.source(*m.span()))])] if trace.steps else []
    taken: list[tuple[int, int, str]] = []  # in order
    for kind, a, b in _found(trace.text, spelled):
        start, end = trace.source(a, b)
        i = bisect_right(taken, (start,))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
            taken.insert(i, (start, end, kind))
    return [(kind, start, end) for start, end, kind in taken]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        out += text[at:start], f"[{kind}]"
        at = end
    return "".join(out) + text[at:] if out else text


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_found, spans, redacted), a row for each row of `df`; spans hold kinds and source offsets, not values."""
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find(t) if t else [] for t in texts]
            out = [t if not s else redact(t, s) for t, s in zip(texts, spans)]
            found = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in spans], pa.int32()), found, pa.array(out, pa.string())], ["doc_id", "n_found", "spans", "redacted"])

    schema = extended(rows.select("doc_id").schema, "n_found int, spans array<struct<kind:string,start:int,end:int>>, redacted string")
    return rows.mapInArrow(scan, schema)
