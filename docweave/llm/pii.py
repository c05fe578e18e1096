"""Personal data with offsets into the source text.

Base identifiers (e-mail, IP address, card, phone) are found on the text as it is. A
chain of transducers then rewrites disguises - homoglyphs and full-width signs to
ASCII, spelled digits to digits, at/dot words to @ and . - and records which source
characters every output character stands for; identifiers found on the rewritten text are
mapped back to source spans. Base spans stay; others are added where they overlap none of
their kind. Row by row: no shuffle; scans are linear in the text's length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vec import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and anchored at the start of a digit run: the same matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

#: Letters that look like ASCII ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοαυνρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXYIJSoauvpikABEZHIKMNOPTYX"))
HOMOGLYPHS |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
HOMOGLYPHS |= {"‐": "-", "‑": "-", "–": "-", "．": ".", "。": ".", "․": ".", "＠": "@", "﹫": "@", " ": " ", " ": " ", " ": " "}
#: Digits in words.
DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | {"oh": "0"}
_NUM = "(?:" + "|".join(DIGITS) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w){_NUM}(?:[\s,-]{{1,2}}(?:{_NUM}|[0-9]))+(?!\w)")
_ITEM = re.compile(rf"(?i){_NUM}|[0-9]|[\s,-]+")
_AT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]\s{0,3}")
_DOT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:dot|punkt|punto|point|\.)\s{0,3}[\])}>]\s{0,3}")
_WORDS = re.compile(r"(?i)(?<=[a-z0-9])\s{1,3}at\s{1,3}(?=[a-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}[a-z0-9-]{1,63}){1,8}|(?:(?:\s{1,3}dot\s{1,3}|\.)[a-z0-9-]{1,63}){0,7}(?:\s{1,3}dot\s{1,3}|\.)[a-z]{2,63})(?!\w))")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_NAMES = re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{1,64}(?:\s{1,3}dot\s{1,3}[a-z0-9._%+-]{1,64}){1,8}(?=@)")
_DOT_WORD = re.compile(r"(?i)\s{1,3}dot\s{1,3}")
_DOTS = re.compile(r"(?i)(?<=[a-z0-9])\s{1,3}dot\s{1,3}(?=[a-z])")
_DISGUISE = re.compile(rf"(?i)[\[({{<]\s{{0,3}}(?:at|@|dot|punkt|punto|point|\.)\s{{0,3}}[\])}}>]|\sdot\s|\sat\s{{1,3}}[a-z0-9-]{{1,63}}\.[a-z0-9]|(?<!\w){_NUM}[\s,-]{{1,2}}(?:{_NUM}|[0-9])(?!\w)|[{re.escape(''.join(HOMOGLYPHS))}]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and not overlapping within a kind."""
    if not _ANY.search(text):
        return [[], [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [list(_emails(text)), ips, cards, phones]


class Tape:
    """A text under rewriting: stretches of output with the source characters they stand for."""

    def __init__(self, text: str):
        self.text, self.out, self.src = text, [0], [(0, len(text), True)]

    def rewrite(self, found: list[tuple[int, int, str]]) -> None:
        """Replaces output stretches (start, end, new text), in order and apart."""
        out, src, parts, at, n = [], [], [], 0, 0
        for a, b, new in [*found, (len(self.text), len(self.text), "")]:
            for o, s in self._stretches(at, a):
                out.append(n)
                src.append(s)
                n += o
            parts.append(self.text[at:a])
            if new:
                out.append(n)
                src.append((self.source(a, b)[0], self.source(a, b)[1], False))
                n += len(new)
                parts.append(new)
            at = b
        self.text, self.out, self.src = "".join(parts), out or [0], src or [(0, 0, True)]

    def _stretches(self, a: int, b: int) -> Iterator[tuple[int, tuple[int, int, bool]]]:
        k = bisect.bisect_right(self.out, a) - 1
        while a < b:
            end = min(b, self.out[k + 1] if k + 1 < len(self.out) else len(self.text))
            s, t, plain = self.src[k]
            yield end - a, ((s + a - self.out[k], s + end - self.out[k], True) if plain else (s, t, False))
            a, k = end, k + 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source span of output characters a to b."""
        got = [s for _, s in self._stretches(a, b)]
        return got[0][0], got[-1][1]


def normalise(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in re.finditer(f"[{re.escape(''.join(HOMOGLYPHS))}]", tape.text)])
    spelled = []
    for m in _SPELLED.finditer(tape.text):
        for i in _ITEM.finditer(m[0]):
            spelled.append((m.start() + i.start(), m.start() + i.end(), DIGITS.get(i[0].lower(), i[0] if i[0].isdigit() else "")))
    tape.rewrite(spelled)
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in _WORDS.finditer(tape.text)])
    tape.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in _NAMES.finditer(tape.text) for d in _DOT_WORD.finditer(m[0])])
    dots, at = [], tape.text.find("@")
    while at >= 0:  # the dots of the host name that follows, however the @ was written
        at += 1
        while (m := _HOST.match(tape.text, at)) and (d := _DOTS.match(tape.text, m.end())):
            dots.append((*d.span(), "."))
            at = d.end()
        at = tape.text.find("@", at)
    tape.rewrite(dots)
    return tape


def find(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans of each kind, and all spans of each kind."""
    base = detect(text)
    every = [list(x) for x in base]
    if _DISGUISE.search(text):
        tape = normalise(text)
        if tape.text != text:
            for spans, got in zip(every, detect(tape.text)):
                own = sorted(spans)
                for a, b in got:
                    s, e = tape.source(a, b)
                    k = bisect.bisect_left(own, (s, s))
                    if not ((k < len(own) and own[k][0] < e) or (k and own[k - 1][1] > s)):
                        spans.append((s, e))
                spans.sort()
    return base, every


def _join(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, x in zip(KINDS, spans) for a, b in x)


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it):
        rows = []
        for text in batch.column(0).to_pylist():
            base, every = find(text or "")
            rows.append((*map(len, base), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), sum(map(len, every)) - sum(map(len, base))))
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
            names=[*batch.schema.names[1:], *_NEW],
        )


_NEW = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (all, kind:start:end in code points) and n_added.

    A null text counts as empty. Rows come out as often as they come in; columns of docs
    with the new names are replaced."""
    cols = [c for c in (docs.columns if keep is None else keep) if c not in _NEW]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cols), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"])
    return docs.select(F.col(text_col).cast("string").alias("docweave_text"), *cols).mapInArrow(_run, schema)
