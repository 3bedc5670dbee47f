"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base kinds (email, ip, card, phone) are found by their patterns in every whole text.  The field adds five kinds that the
patterns do not cover: ``name`` and ``address``, ``local_phone`` (numbers without a leading plus), ``national_id`` and ``account``
(long numbers that are no valid card).  Added spans that overlap a base span are dropped, and signs around a span are trimmed;
the rest is the field's decision.

A word can carry a label other than O only in a run of words that hold a digit, begin with a capital letter or are one of
``BRIDGES``, and only if the run holds a digit or follows one of ``CUES`` within two words; all other words are O by constraint.
Such a run is therefore a chain of its own, and decoding the chains by Viterbi decodes the whole text.  The words around a run enter
as features.  Features are hashed shapes and words, so a chain's emissions are sums of table rows, taken for all chains of a piece at
once; chains of equal length are decoded together.  A label can only go on after a word of its own kind (fixed steps).

The field is trained on the driver from a small labelled table that ``labelled_table`` spells out from templates (bounded, seeded).

Bounds: texts are worked on in pieces of about ``PIECE_BYTES`` (a single text is held whole); emissions are made for ``BLOCK_WORDS``
words at a time, and a chain beyond that is decoded in blocks whose scores at the start are kept, so that steps back are made
again block by block.  Words are taken whole, whatever their length.

Edge cases: null text is empty; any id, repeated rows included, gives its own row; no rows give no rows; ids are cast to long.  All
scans are linear in the text, also for long runs of digits or letters.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetools import hash_spans, mix, slices, spread, text_bytes, words
from .staging import arrow_map

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("name", "address", "local_phone", "national_id", "account")
KINDS = BASE_KINDS + FIELD_KINDS
#: Tag 0 is O; tags 2 k + 1 and 2 k + 2 begin and continue kind k of FIELD_KINDS.
N_TAGS = 1 + 2 * len(FIELD_KINDS)
TABLE = 1 << 15
PIECE_BYTES = 1 << 20
BLOCK_WORDS = 1 << 14
#: Words that announce a name, and words in lower case that may stand within an address.
CUES = "mr mrs ms miss dr prof herr frau señor señora madame monsieur dear name named contact sincerely regards signed patient".split()
BRIDGES = "rue avenue boulevard calle plaza place de la del des".split()
#: Words that streets end in; they share a feature.
STREET_WORDS = "street road avenue lane drive st rd ave boulevard blvd court way close square terrace".split()

# Equal to the patterns of the contract: a match can only begin where a run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            at = last = found.end()
        else:
            # characters up to here cannot be a local part of a later address
            at += 1
            last = at


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 64:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _joined(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [x.encode() for x in items]
    at = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    return np.frombuffer(b"".join(raw) + bytes(8), np.uint8), at[:-1], at[1:]


# Values that the labelled table is spelt out from.
_FIRST = "James Mary Robert Linda David Susan Karen Thomas Paul Anna Peter Julia Hans Petra Klaus Monika Pierre Marie Luc Claire José Carmen Luis Elena Émile Chloé".split()
_LAST = "Smith Johnson Brown Taylor Wilson Clark Lewis Walker Müller Schmidt Weber Becker Dubois Laurent Moreau Girard García López Fernández Ruiz O'Brien Hill".split()
_STREETS = "Oak Maple Main Church Park Mill Lake Cedar Washington High King Elm".split()
_TYPES = "Street Road Avenue Lane Drive St. Rd. Ave Boulevard Court".split()
_GERMAN = "Haupt Bahnhof Garten Schul Berg Linden".split()
_PLACES = "Mayor Real Alcalá Victor Voltaire Hugo République Rivoli Sol".split()
_PLAIN = "the of and to in is for with on that as it by was are be at this from or der die und das mit auf le la et les que en el los con una over about please today soon".split()
_PARTS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def labelled_table(rows: int = 2000, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Sentences of (word, tag), spelt out from templates."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    made = lambda: "".join(pick(_PARTS) for _ in range(int(rng.integers(2, 5))))
    plain = lambda: pick(_PLAIN) if rng.random() < 0.5 else made()
    capital = lambda: plain().capitalize()
    hexes = lambda n: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, n))
    # most names and streets are made up, so that shapes and neighbours tell them, not the lists
    some = lambda xs: made().capitalize() if rng.random() < 0.75 else pick(xs)
    first, last, street = lambda: some(_FIRST), lambda: some(_LAST), lambda: some(_STREETS)
    full = (lambda: f"{first()} {last()}", lambda: f"{first()} {last()}", lambda: f"{first()[0]}. {last()}", lambda: f"{first()} {last()[0]}. {last()}", lambda: f"{first()} {last()}-{last()}", first)
    called = ("my name is", "name is", "name:", "Name:", "named", "named", "contact", "Sincerely,", "sincerely,", "regards,", "Regards,", "signed", "Dear", "patient")
    titles = ("Mr", "Mr.", "Mrs", "Mrs.", "Ms.", "Miss", "Dr.", "Dr", "Prof.", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur", "mr.", "dr.")
    number = lambda: d(int(rng.integers(1, 4)))
    values = {
        "name": (lambda: (pick(called), pick(full)()), lambda: (pick(titles), pick((last, *full[:5]))())),
        "address": (
            *2 * (  # twice as frequent
                lambda: (pick(("at", "to", "lives at", "address:", "from", plain())), f"{pick((number(), d(4)))} {street()} {pick(_TYPES)}"),
                lambda: (pick(("at", "to", "near", "address:", plain())), f"{pick((number(), d(4)))} {street()} {street()} {pick(_TYPES)}"),
            ),
            lambda: (pick(("in der", "wohnt", "Adresse:", plain())), f"{some(_GERMAN)}{pick(('straße', 'str.', 'weg', 'platz', 'gasse'))} {number()}"),
            lambda: (pick(("au", "adresse:", "habite")), f"{number()} {pick(('rue', 'avenue', 'boulevard', 'place'))} {pick(('', 'de ', 'de la '))}{some(_PLACES)}"),
            lambda: (pick(("en", "vive en", "dirección:")), f"{pick(('Calle', 'Plaza', 'Avenida'))} {some(_PLACES)} {number()}"),
        ),
        "local_phone": tuple(lambda f=f: (pick(("call", "phone", "tel", "Tel:", "number", plain())), f()) for f in (lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(6)}", lambda: f"{d(3)}.{d(3)}.{d(4)}")),
        "national_id": tuple(lambda f=f: (pick(("ssn", "SSN", "id", "security number", "no", plain())), f()) for f in (lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}")),
        "account": tuple(lambda f=f: (pick(("account", "card", "no", plain(), plain(), plain())), f()) for f in (lambda: d(16), lambda: d(16), lambda: d(int(rng.integers(12, 20))), lambda: d(18), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}")),
    }
    other = (
        lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: d(int(rng.integers(1, 9))), lambda: f"{d(3)}.{d(2)}.{d(2)}.{d(3)}",
        lambda: f"{d(2)}%", lambda: f"v{d(1)}.{d(1)}", lambda: f"#{d(4)}", lambda: f"{d(2)}:{d(2)}", lambda: f"x{d(2)}y", lambda: f"{d(3)} {d(2)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}", lambda: f"{d(3)} {d(3)}", lambda: f"mail{d(1)}.example.com", lambda: f"{made()}.{d(2)}@mail{d(1)}.example.com", lambda: f'"{hexes(40)}"', lambda: hexes(32),
        lambda: f"{pick(('Version', 'Section', 'Chapter', 'Room', 'Route', 'Table', 'Figure', 'Windows', 'Top', 'Level'))} {d(int(rng.integers(1, 4)))}", lambda: f"Version {d(1)}.{d(1)}", lambda: f"Apache License, Version {d(1)}.{d(1)}.", lambda: f"CC BY-NC {d(1)}.{d(1)}.",
        lambda: f"{pick(('Monday', 'June', 'May', 'On'))} {d(2)} {pick(('March', 'April', 'June'))} 20{d(2)}", lambda: f"{capital()} {d(4)} {capital()}", lambda: f"In {d(4)} {capital()} {capital()}", lambda: f"{d(2)} {capital()}", lambda: f"{capital()} {capital()} {d(3)}",
        lambda: f"{pick(('the contact.', 'a patient.', 'the name.', 'by name.', 'no name.'))} {capital()} {plain()}", lambda: f"la {d(2)} {capital()}", lambda: f"{d(4)} {capital()} {capital()}", lambda: f"{pick(('Dear', 'dear', 'contact', 'signed'))} {pick(('Sir', 'Madam', 'Customer', 'Support', 'All', 'Team', 'Us'))}",
    )
    out = []
    for _ in range(rows):
        sentence: list[tuple[str, int]] = [(plain(), 0) for _ in range(int(rng.integers(0, 3)))]
        for _ in range(int(rng.integers(1, 4))):
            kind = pick((*FIELD_KINDS, "name", "address", *["O"] * 5))
            before, value = pick(values[kind])() if kind != "O" else (plain(), pick(other)())
            sentence += [(w, 0) for w in before.split(" ")]
            tag = 0 if kind == "O" else 1 + 2 * FIELD_KINDS.index(kind)
            sentence += [(w, tag and tag + (k > 0)) for k, w in enumerate(value.split(" "))]
            word, tag = sentence[-1]
            sentence[-1] = (word + pick(("", "", "", ".", ",", "###", "!!")), tag)
            sentence += [(plain(), 0), (plain(), 0)] if rng.random() < 0.8 else [(capital(), 0), (plain(), 0)]
        out.append(sentence)
    shouted = [[(w.upper() + "!!", 0) for w in (plain(), plain(), pick((d(5), f"{d(3)}.{d(2)}.{d(2)}.{d(3)}", plain())), plain(), plain(), plain())] for _ in range(rows // 20)]
    return out + shouted


_b = np.arange(256)
_UPPER = (_b >= ord("A")) & (_b <= ord("Z"))
_DIGIT = (_b >= ord("0")) & (_b <= ord("9"))
_LETTER = ((_b | 32) >= ord("a")) & ((_b | 32) <= ord("z")) | (_b >= 0x80)
#: Classes of bytes: digits are one, capitals another, other letters a third, every other sign is itself.
_CLASS = np.where(_DIGIT, 1, np.where(_UPPER, 2, np.where(_LETTER, 3, _b))).astype(np.uint8)
_LOW = np.where(_UPPER, _b + 32, _b).astype(np.uint8)
_CORE = _DIGIT | _LETTER


class Words:
    """The words of texts: ``start``, ``end``, text number, core (without signs around it), and hashes of shape and lower-case core."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.buf, self.offsets = buf, offsets
        self.start, self.end, per = words(buf, offsets)
        self.text = np.repeat(np.arange(len(per)), per)
        n = len(buf) - 8
        core, place = _CORE[buf[:n]], np.arange(n)
        after = np.minimum.accumulate(np.where(core, place, n)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(core, place, -1))
        self.a = np.minimum(np.append(after, n)[self.start], self.end)
        self.b = np.maximum(before[self.end - 1] + 1, self.a) if len(self.end) else self.end
        digits = np.append(0, np.cumsum(_DIGIT[buf[:n]]))
        self.digit = digits[self.end] > digits[self.start]
        wide = (buf[self.a] == 0xC3) & (buf[self.a + 1] >= 0x80) & (buf[self.a + 1] < 0x9F)
        self.capital = (_UPPER[buf[self.a]] | wide) & (self.b > self.a)

    def low(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the lower-cased cores of words ``at``."""
        sizes = self.b[at] - self.a[at]
        ends = np.cumsum(sizes)
        raw = np.append(_LOW[self.buf[np.repeat(self.a[at], sizes) + spread(sizes)]], np.zeros(8, np.uint8))
        return hash_spans(raw, ends - sizes, ends)

    def shape(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the shapes of words ``at`` up to their cores' ends: runs of letters count once, digits and signs each."""
        sizes = self.b[at] - self.start[at]
        kind = _CLASS[self.buf[np.repeat(self.start[at], sizes) + spread(sizes)]]
        first = spread(sizes) == 0
        keep = first | (kind == 1) | (kind > 3) | np.append(True, kind[1:] != kind[:-1])
        ends = np.append(0, np.cumsum(keep))[np.cumsum(sizes)]
        return hash_spans(np.append(kind[keep], np.zeros(8, np.uint8)), np.append(0, ends[:-1]), ends) if len(at) else np.zeros(0, np.uint64)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the runs whose words can carry labels."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self.low(np.arange(n))
        may = self.digit | self.capital | np.isin(low, _BRIDGE_HASHES)
        cue = np.isin(low, _CUE_HASHES)
        same = self.text[1:] == self.text[:-1]
        edge = np.append(True, (may[1:] != may[:-1]) | ~same)
        # a capitalised cue ends a run: what it announces is a run of its own
        edge |= np.append(False, cue[:-1] & same) | cue
        first = np.nonzero(edge)[0]
        end = np.append(first[1:], n)
        holds = np.add.reduceat(self.digit.astype(np.int64), first) > 0
        told = lambda k: (first >= k) & cue[first - k] & (self.text[first - k] == self.text[first])
        live = may[first] & ~cue[first] & (holds | told(1) | told(2))
        return first[live], end[live]

    def features(self, at: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Feature numbers of words ``at``, one row each.  Shapes and words that are not ``common`` count as one."""
        n = len(self.start)
        near = np.unique(np.clip(at[:, None] + np.arange(-2, 4), 0, max(n - 1, 0)))
        shape, low = self.shape(near), self.low(near)
        street = np.isin(low, _STREET_HASHES).astype(np.uint64)
        shape, low = (np.where(np.isin(x, c), x, np.uint64(0)) for x, c in zip((shape, low), common))
        sign = np.where(self.end[near] > self.b[near], self.buf[np.minimum(self.b[near], len(self.buf) - 1)], 0).astype(np.uint64)  # what follows the core

        def of(values: np.ndarray, step: int) -> np.ndarray:
            there = np.clip(at + step, 0, n - 1)
            inside = (at + step == there) & (self.text[there] == self.text[at])
            return np.where(inside, values[np.searchsorted(near, there)], np.uint64(0x9E37 + step))

        s = {k: of(shape, k) for k in (-2, -1, 0, 1, 2)}
        w = {k: of(low, k) for k in (-2, -1, 0, 1, 2)}
        c = {k: of(street, k) for k in (0, 1, 2, 3)}
        mark = of(sign, -1)
        sets = [(s[0],), (w[0],), (s[-1],), (w[-1],), (s[1],), (w[1],), (s[-1], s[0]), (s[0], s[1]), (s[-1], s[0], s[1]), (s[0], s[1], s[2]), (s[-2], s[-1], s[0]), (w[-1], s[0]), (w[-1], mark), (w[-2], w[-1]), (w[2], s[0]), (c[0], s[-1]), (s[0], c[0], c[1], c[2], c[3]), (s[-1], s[0], c[0], c[1], c[2]), ()]
        out = np.zeros((len(at), len(sets)), np.int32)
        for k, parts in enumerate(sets):
            h = np.full(len(at), k + 1, np.uint64)
            for p in parts:
                h = mix(h ^ p)
            out[:, k] = h % np.uint64(TABLE)
        return out


_CUE_HASHES, _BRIDGE_HASHES, _STREET_HASHES = (hash_spans(*_joined(x)) for x in (CUES, BRIDGES, STREET_WORDS))
#: Steps between tags that cannot be: a label goes on only after one of its own kind.
_BARRED = np.zeros((N_TAGS, N_TAGS))
for _tag in range(2, N_TAGS, 2):
    _BARRED[:, _tag] = -1e6
    _BARRED[_tag - 1 : _tag + 1, _tag] = 0


def _grouped(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the feature numbers, where equal ones begin, and which they are."""
    order = np.argsort(f.reshape(-1), kind="stable")
    rows = f.reshape(-1)[order]
    cuts = np.append(0, np.nonzero(rows[1:] != rows[:-1])[0] + 1)
    return order, cuts, rows[cuts]


def _common(values: np.ndarray, least: int = 5) -> np.ndarray:
    found, counts = np.unique(values, return_counts=True)
    return found[counts >= least]


class Field:
    """Weights of the conditional random field: ``emit[TABLE, tags]``, ``step[tags, tags]``, ``begin[tags]``; ``common`` are the
    shapes and words of the labelled table that have features of their own."""

    def __init__(self) -> None:
        self.common = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.emit, self.step, self.begin = np.zeros((TABLE, N_TAGS)), _BARRED.copy(), _BARRED[0].copy()

    def fit(self, sentences: list[list[tuple[str, int]]], rounds: int = 80, rate: float = 0.1, decay: float = 1e-5) -> "Field":
        """Adam over all chains; those of one length go together.  Small gradients make small steps, so rare features stay small."""
        buf, at, _ = _joined([" ".join(w for w, _ in s) for s in sentences])
        known = Words(buf, np.append(at, len(buf) - 8))
        tags = np.array([t for s in sentences for _, t in s])
        first, end = known.chains()
        every = np.arange(len(known.start))
        self.common = (_common(known.shape(every)), _common(known.low(every)))
        batches = []
        for size in np.unique(end - first):
            at = first[end - first == size][:, None] + np.arange(size)
            f = known.features(at.reshape(-1), self.common).reshape(*at.shape, -1)
            batches.append((f, tags[at], _grouped(f)))
        params = [self.emit, self.step, self.begin]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = sum(len(f) for f, _, _ in batches)
        for r in range(1, rounds + 1):
            grads = [np.zeros_like(p) for p in params]
            for f, t, groups in batches:
                self.gradient(f, t, grads, groups)
            for p, g, mm, vv in zip(params, grads, m, v):
                g = np.where(p > -1e5, g / total + decay * p, 0.0)
                mm[...] = 0.9 * mm + 0.1 * g
                vv[...] = 0.99 * vv + 0.01 * g * g
                p -= rate * (mm / (1 - 0.9**r)) / (np.sqrt(vv / (1 - 0.99**r)) + 1e-6)
        return self

    def gradient(self, f: np.ndarray, tags: np.ndarray, grads: list[np.ndarray], groups: tuple | None = None) -> float:
        """Adds expected minus observed counts of a batch of chains of one length; returns its negative log likelihood."""
        length = f.shape[1]
        e = self.emit[f].sum(axis=2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        sum_exp = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
        alpha[:, 0] = self.begin + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = sum_exp(alpha[:, t - 1, :, None] + self.step, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = sum_exp(self.step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = sum_exp(alpha[:, -1], 1)
        seen = np.eye(N_TAGS)[tags]
        delta = np.exp(alpha + beta - z[:, None, None]) - seen
        order, cuts, rows = _grouped(f) if groups is None else groups
        grads[0][rows] += np.add.reduceat(delta.reshape(-1, N_TAGS)[order // f.shape[2]], cuts, axis=0)
        grads[2] += delta[:, 0].sum(axis=0)
        for t in range(1, length):
            pair = np.exp(alpha[:, t - 1, :, None] + self.step + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            grads[1] += pair.sum(axis=0) - seen[:, t - 1].T @ seen[:, t]
        path = (e * seen).sum() + self.begin[tags[:, 0]].sum() + self.step[tags[:, :-1], tags[:, 1:]].sum()
        return float(z.sum() - path)

    def _forward(self, e: np.ndarray, score: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Steps back, and scores after the last word; ``score`` is that before the first (none at a chain's begin)."""
        back = np.zeros(e.shape, np.int8)
        for t in range(e.shape[1]):
            if score is None:
                score = self.begin + e[:, 0]
                continue
            options = score[:, :, None] + self.step
            back[:, t] = options.argmax(axis=1)
            score = options.max(axis=1) + e[:, t]
        return back, score

    def decode(self, size: int, length: int, emissions, block: int = BLOCK_WORDS) -> np.ndarray:
        """Best tags of ``size`` chains of ``length`` words; ``emissions(a, b)`` gives the scores of their words a to b."""
        tags = np.zeros((size, length), np.int8)
        cuts = [*range(0, length, block), length]
        known: list = [None]
        for a, b in zip(cuts[:-1], cuts[1:]):
            back, score = self._forward(emissions(a, b), known[-1])
            known.append(score)
        last, rows = known[-1].argmax(axis=1), np.arange(size)
        for k in range(len(cuts) - 2, -1, -1):
            a, b = cuts[k], cuts[k + 1]
            if b < length:  # steps back of earlier blocks are made again
                back, _ = self._forward(emissions(a, b), known[k])
            for t in range(b - 1, a - 1, -1):
                tags[:, t] = last
                last = back[rows, t - a, last]
        return tags

    def label(self, known: Words, block: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Words that carry labels, in order, and their tags."""
        first, end = known.chains()
        sizes, found = end - first, [(np.zeros(0, np.int64), np.zeros(0, np.int8))]
        for size in np.unique(sizes).tolist():
            mine = first[sizes == size]
            for part in (mine[k : k + max(1, block // size)] for k in range(0, len(mine), max(1, block // size))):
                spots = lambda a, b: part[:, None] + np.arange(a, b)  # noqa: B023, E731
                emissions = lambda a, b: self.emit[known.features((x := spots(a, b)).reshape(-1), self.common)].sum(axis=1).reshape(*x.shape, -1)  # noqa: B023, E731
                tags = self.decode(len(part), size, emissions, block).reshape(-1)
                hit = np.nonzero(tags)[0]
                found.append((part[hit // size] + hit % size, tags[hit]))
        at, tags = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at)
        return at[order], tags[order]


_trained: dict[tuple, Field] = {}


def trained_field(rows: int = 2000, seed: int = 11) -> Field:
    if (rows, seed) not in _trained:
        _trained[rows, seed] = Field().fit(labelled_table(rows, seed))
    return _trained[rows, seed]


def field_spans(buf: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans ``(start, kind, end)`` in code points that the field finds in each text."""
    known = Words(buf, offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    at, tags = field.label(known)
    if not len(at):
        return out
    opens = np.nonzero(tags % 2 == 1)[0]
    closes = np.append(opens[1:], len(at)) - 1
    # a bracket that opens a number belongs to it
    begin, end = known.a[at[opens]], known.b[at[closes]]
    bracket = (begin > known.start[at[opens]]) & (buf[begin - 1] == ord("("))
    begin = begin - bracket
    points = np.append(0, np.cumsum((buf[:-8] & 0xC0) != 0x80))
    text = known.text[at[opens]]
    begin, end = points[begin] - points[offsets[text]], points[end] - points[offsets[text]]
    for t, a, k, b in zip(text.tolist(), begin.tolist(), (tags[opens] // 2).tolist(), end.tolist()):
        if b > a:
            out[t].append((a, len(BASE_KINDS) + k, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


#: Texts without any of these hold no personal data of any kind.
_ANY = r"(?i)[0-9@]|\b(" + "|".join(CUES) + r")\b"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a count for each base kind, ``base_sha256``, ``spans`` and ``n_spans`` per document (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())  # TABLE x N_TAGS numbers

    def find(batches):
        field = shared.value
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                text = piece.column("text").fill_null("")
                some = np.nonzero(np.asarray(pc.match_substring_regex(text, _ANY)))[0]
                base: list[list] = [[] for _ in range(piece.num_rows)]
                every: list[list] = [[] for _ in range(piece.num_rows)]
                buf, offsets = text_bytes(text.take(pa.array(some)))
                raw = memoryview(buf)
                for n, (k, more) in enumerate(zip(some.tolist(), field_spans(buf, offsets, field))):
                    base[k] = own = base_spans(str(raw[offsets[n] : offsets[n + 1]], "utf-8"))
                    every[k] = own + [x for x in more if not any(a < x[2] and x[0] < b for a, _, b in own)] if more else own
                columns = [piece.column("id")]
                columns += [pa.array([sum(x[1] == kind for x in s) for s in base], pa.int64()) for kind in range(len(BASE_KINDS))]
                columns.append(pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string()))
                columns.append(pa.array([written(s) for s in every], pa.string()))
                columns.append(pa.array([len(s) for s in every], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return arrow_map(rows, find, f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
