"""Personal data in free text: found by a semi-Markov conditional random field and replaced by typed placeholders.

A labelling of a line is a chain of typed segments with plain text between them; its probability is proportional to
exp(sum of segment scores + sum of transition scores). Segments are bounded entities, as the method asks: a name has at
most 6 words (lower-case ones at least 2, all uncommon, or a word before them that
announces names), a phone
number 7 to 15 digits in 24 characters, an identity number 5 digits or more in 24 characters, an address the parts its
patterns name. Features of the whole segment (its shape, its words, what stands before and after it) score it; a
transition scores the types of two segments at most `NEAR` characters apart with the text between them. `forward` gives
the partition function and `backward` the marginals that training needs; `decode` finds the labelling of greatest
probability by the same dynamic program over segment ends. Weights are trained by `train_pii` and stored with the
package.

Null and empty texts have no mentions; texts are decoded whole, line by line (no pattern spans a line break).
"""

from __future__ import annotations

import gzip
import json
import math
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.path.join(os.path.dirname(__file__), "models", "pii.json.gz")
TYPES = ("email", "phone", "identity_number", "street_address", "person_name")
MAX_UNITS = 6
#: Two segments at most this many characters apart have a transition of their own.
NEAR = 6

TOKEN = re.compile(r"[^\W\d_]+(?:[-'’‑][^\W\d_]+)*|\d+|[^\w\s]|_")
#: Units a name is made of: words (may hold hyphens and apostrophes).
UNIT = re.compile(r"[^\W\d_]+(?:[-'’‑][^\W\d_]+)*")
PARTICLES = frozenset("de del della der den di da do dos das du la le van von vom zu zur ten ter bin ibn al el y e".split())

AT = r"(?:\s?[@＠]\s?|\s?[\(\[]\s?(?:at|AT|arroba)\s?[\)\]]\s?| AT )"
DOT = r"(?:\.|\s?[\(\[]\s?(?:dot|DOT|punto)\s?[\)\]]\s?| DOT )"
EMAIL = re.compile(rf"[\w%+'-]+(?:\.[\w%+'-]+)*{AT}[\w-]+(?:{DOT}[\w-]+)*{DOT}[^\W\d_][\w-]*")
PHONE = re.compile(r"(?<![\w.:/-])(?:\+|\()?\d+(?:\)? ?[ ./\xa0-]?\(?\d+)+(?![\w])")
IDENTITY = re.compile(r"(?<![\w.-])[A-Z]{0,8}\d[\dA-Z]*(?:[ .\xa0/-][\dA-Z]{1,12}){0,5}(?![\w])|(?<!\w)[A-Z]{2}(?: ?\d\d){3} ?[A-Z](?!\w)")

_W = r"[A-ZÀ-ÞŁŚŻŹĆĄĘŃÓА-Я][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_NO = r"\d{1,5} ?[A-Z]?(?:\b bis| ter)?"
#: Words that make a street (fixed values).
_SUFFIX = r"(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Ln|Lane|Ct|Court|Close|Way|Dr|Drive|Pl|Place|Sq|Square|Terrace|Crescent|Row|Hill|Gardens|Grove|Walk|Mews|Parade|Pkwy|Parkway|Hwy|Highway|Path|Park)\b\.?"
_FR = r"(?:rue|avenue|av\.|boulevard|bd|impasse|allée|allee|place|chemin|quai|route|passage|cours|square|sentier)"
_ES = r"(?:C/|Calle|C\.|Avda\.?|Av\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Carrera|Rua|Via|Viale|Corso|Piazza|Largo|ul\.|ulica|ул\.|улица|проспект|пер\.)"
_DE = r"(?:[A-ZÄÖÜ][^\W\d_]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|hof|steig|pfad|markt|graben|hain|berg|feld|straat|laan|gracht|plein|gatan|vägen)|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Hinter der) (?:[A-ZÄÖÜ][^\W\d_]*(?:[- ][A-ZÄÖÜ][^\W\d_]*)?))"
CORES = {
    "number first": re.compile(rf"(?<![\w.-]){_NO},? (?:(?:{_W}|St\.) ){{1,3}}{_SUFFIX}"),
    "french": re.compile(rf"(?<![\w.-]){_NO},? {_FR} (?:de la |de l['’]|de |du |des |d['’])?{_W}(?:[ -](?:(?:de|du|des|la) )?{_W}){{0,2}}"),
    "kind first": re.compile(rf"(?<!\w){_ES} ?(?:(?:de los|de las|de la|del|de|da|do|della|di) )?{_W}(?:[ -](?:(?:de|del|la) )?{_W}){{0,2}},? \d{{1,5}}(?: ?[A-Z]\b)?"),
    "german": re.compile(rf"(?<!\w){_DE} \d{{1,4}}(?: ?[a-zA-Z]\b)?"),
}
UNITS = re.compile(r",? (?:Apt|Unit|Flat|Suite|Ste|Apartment|Room|Whg)\.? ?#?\w{1,5}|, ?(?:bajo|\d{1,2}º(?: ?[A-Z]\b)?|\d{1,2}[ºª]? [A-Z]\b|esc\. \d)|,? #\d{1,5}")
POSTCODE = re.compile(rf",? \d{{4,5}} {_W}(?: {_W})?|,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}")
TOWN = re.compile(rf", {_W}(?: {_W})?(?:, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)?")


def shape(text: str) -> str:
    out = []
    for c in text:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        out.append(k)
    return "".join(out)


def _short(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", s)


class Line:
    """A line's tokens, and what stands before and after any place in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        self.ends = [t[1] for t in self.tokens]
        self.starts = [t[0] for t in self.tokens]

    def before(self, at: int) -> tuple[str, str, str, str]:
        """The three tokens before `at`, and the nearest word before it."""
        i = bisect_right(self.ends, at)
        near = [self.mask(t[2]) for t in self.tokens[max(0, i - 3) : i]]
        word = next((t[2].lower() for t in reversed(self.tokens[max(0, i - 4) : i]) if t[2][0].isalpha()), "^")
        near = ["^"] * (3 - len(near)) + near
        return near[2], near[1], near[0], word

    def after(self, at: int) -> tuple[str, str]:
        i = bisect_right(self.starts, at - 1)
        near = [self.mask(t[2]) for t in self.tokens[i : i + 2]]
        near += ["$"] * (2 - len(near))
        return near[0], near[1]

    @staticmethod
    def mask(token: str) -> str:
        return "0" if token[0].isdigit() else token.lower()


class Model:
    """Weights of the features, the common words of ordinary text, and words that announce names."""

    def __init__(self, weights: dict[str, float], words: frozenset[str], announcing: frozenset[str]) -> None:
        self.weights, self.words, self.announcing = weights, words, announcing

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with gzip.open(path, "rt") as f:
            data = json.load(f)
        return cls(data["weights"], frozenset(data["words"]), frozenset(data["announcing"]))

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w[f] for f in features if f in w)


def known(word: str, words: frozenset[str]) -> bool:
    """A common word, or one with an s."""
    return word in words or word.endswith("s") and word[:-1] in words


def _name_candidates(line: Line, words: frozenset[str], announcing: frozenset[str]) -> Iterator[tuple[int, int]]:
    text = line.text
    units = []
    for m in UNIT.finditer(text):
        a, b = m.span()
        word = m.group()
        if b < len(text) and text[b] == "." and len(word) == 1 and word.isupper():
            b += 1  # an initial
        units.append((a, b, word))
    for i, (a, _, word) in enumerate(units):
        if a and (text[a - 1] in "@_/\\" or text[a - 1].isalnum()):
            continue
        # Lower case like the first unit that is no particle.
        lower = not next((w for _, _, w in units[i : i + 4] if w not in PARTICLES), word)[0].isupper()
        announced = lower and line.before(a)[3] in announcing
        if lower and known(word, words) and not announced:
            continue
        end, size, rare = None, 0, True
        for j in range(i, min(len(units), i + MAX_UNITS)):
            s, e, w = units[j]
            if j > i:
                gap = text[end:s]
                if gap not in (" ", "\xa0", ", ", ",\xa0"):
                    break
                if gap[0] == "," and (lower != (not w[0].isupper())) and w not in PARTICLES:
                    break
                if not lower and not w[0].isupper() and w not in PARTICLES:
                    break
            end = e
            if w in PARTICLES and j + 1 < len(units):
                continue
            if lower and w[0].isupper():
                break
            size, rare = size + 1, rare and not known(w, words)
            if lower and (size < 2 or not rare and not announced):
                continue
            if e < len(text) and (text[e] in "@_" or text[e].isdigit() or text[e] == "\\" and text[e + 1 : e + 2] not in ('"', "'", "n")):
                continue
            yield a, e


def candidates(line: Line, words: frozenset[str], announcing: frozenset[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, type, detail) of all segments a type's patterns allow."""
    text, found = line.text, set()
    if "@" in text or "＠" in text or " AT " in text or "at)" in text.lower() or "at]" in text.lower():
        for m in EMAIL.finditer(text):
            found.add((m.start(), m.end(), "email", ""))
    if any(c.isdigit() for c in text):
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 15 and len(m.group()) <= 24:
                found.add((m.start(), m.end(), "phone", ""))
            # Groups set apart by spaces may not all belong to the number.
            gaps = [k.start() for k in re.finditer(" ", m.group())]
            for a, b in [(g + 1, len(m.group())) for g in gaps] + [(0, g) for g in gaps]:
                if 7 <= sum(c.isdigit() for c in m.group()[a:b]) <= 15:
                    found.add((m.start() + a, m.start() + b, "phone", ""))
        for m in IDENTITY.finditer(text):
            cuts = [len(m.group()), *(k.start() for k in re.finditer(r"[ .\xa0/-]", m.group()))]
            for c in cuts:
                part = m.group()[:c]
                if sum(x.isdigit() for x in part) >= 5 and len(part) <= 24:
                    found.add((m.start(), m.start() + c, "identity_number", ""))
        for kind, core in CORES.items():
            for m in core.finditer(text):
                ends = [(m.end(), "")] + [(m.end() - 1, "")] * m.group().endswith(".")
                for tail, name in ((UNITS, "u"), (POSTCODE, "p"), (TOWN, "t")):
                    for e, had in list(ends):
                        if (t := tail.match(text, e)) and not ("p" in had and name == "t"):
                            ends.append((t.end(), had + name))
                            if name in "pt" and " " in t.group().strip(", ")[1:] and (cut := t.group().rfind(" ")) > 2 and text[t.start() : t.start() + cut].strip(", ").strip("0123456789 "):
                                ends.append((t.start() + cut, had + name))
                for e, had in ends:
                    found.add((m.start(), e, "street_address", f"{kind}|{had}"))
    for a, e in _name_candidates(line, words, announcing):
        found.add((a, e, "person_name", ""))
    return sorted(found)


def _case(word: str) -> str:
    if len(word) <= 2 and word[0].isupper() and word.endswith("."):
        return "I"
    bare = word.rstrip(".")
    if bare.lower() in PARTICLES and not bare[0].isupper():
        return "p"
    if bare.isupper() and len(bare) > 1:
        return "U"
    if bare[0].isupper():
        return "X" if any(c.isupper() for c in bare[1:]) and "-" not in bare else "C"
    return "l"


def features(line: Line, start: int, end: int, kind: str, detail: str, words: frozenset[str]) -> list[str]:
    """Names of the features of a whole segment."""
    text = line.text[start:end]
    l1, l2, _, lw = line.before(start)
    r1, r2 = line.after(end)
    tight_left = line.text[start - 1] if start and not line.text[start - 1].isspace() else " "
    tight_right = line.text[end] if end < len(line.text) and not line.text[end].isspace() else " "
    t = kind[0] + ":"
    out = [t, f"{t}l1={l1}", f"{t}l12={l2} {l1}", f"{t}lw={lw}", f"{t}r1={r1}", f"{t}r12={r1} {r2}", f"{t}lr={l1}|{r1}", f"{t}t={_side(tight_left)}{_side(tight_right)}"]
    if kind == "person_name":
        parts = text.replace("\xa0", " ").replace(",", " ,").split()
        cases = "".join("," if w == "," else _case(w) for w in parts)
        real = [w.lower() for w in parts if w != ","]
        sorts = "".join("," if w == "," else "p" if w in PARTICLES else "i" if len(w.rstrip(".")) == 1 else "k" if known(w.lower(), words) else "u" for w in parts)
        opens = "^" if l1 in "^.?!:>" else "m"
        nature = "$" if r1 == "$" else "." if not r1[0].isalpha() else "k" if known(r1, words) else "u"
        out += [
            f"{t}c={cases}", f"{t}k={sorts}", f"{t}ck={cases}|{sorts}", f"{t}k|o={sorts}|{opens}", f"{t}k|l1={sorts}|{l1}", f"{t}k|lw={sorts}|{lw}", f"{t}k|r1={sorts}|{r1}",
            f"{t}k|r={sorts}|{opens}|{nature}", f"{t}c|t={cases}|{_side(tight_left)}{_side(tight_right)}", f"{t}re={r1[-2:]}|{opens}", f"{t}first={real[0]}", f"{t}last={real[-1]}",
            f"{t}n|r1={len(real)}|{r1}", f"{t}script={'c' if any('Ѐ' <= c <= 'ӿ' for c in text) else 'l'}",
        ]
        for w in real:
            out += [f"{t}w={w}", f"{t}s3={w[-3:]}"]
    elif kind == "street_address":
        core, _, tail = detail.partition("|")
        last = text.rstrip(".").rsplit(" ", 1)[-1].lower()
        out += [f"{t}k={core}", f"{t}tail={tail}", f"{t}tail|r1={tail}|{r1}", f"{t}last={last}", f"{t}tail|r12={tail}|{r1} {r2}", f"{t}n={min(6, text.count(' '))}"]
    elif kind == "email":
        local, host = re.split(r"[@＠]|[\(\[]\s?at\s?[\)\]]| AT ", text, maxsplit=1, flags=re.I)[:2] if re.search(r"[@＠]|at", text, re.I) else (text, "")
        out += [f"{t}local={local.strip().lower() if len(local) <= 5 else 'long'}", f"{t}dots={host.count('.')}", f"{t}tld={host.strip().rsplit('.', 1)[-1][-8:].lower()}", f"{t}at={'@' if '@' in text else 'w'}", f"{t}sep={bool(re.search('[._+-]', local))}"]
    else:
        s = shape(text)
        digits = sum(c.isdigit() for c in text)
        head = text[0] if text[0] in "+(0" else "9"
        out += [f"{t}m={s}", f"{t}m1={_short(s)}", f"{t}m|l1={s}|{l1}", f"{t}m1|lw={_short(s)}|{lw}", f"{t}d={digits}", f"{t}m|r1={s}|{r1}", f"{t}h={head}", f"{t}hm={head}{_short(s)}", f"{t}m1|t={_short(s)}|{_side(tight_left)}{_side(tight_right)}", f"{t}hd|l={head}{digits}|{'w' if l1[0].isalpha() else l1}"]
        i = bisect_right(line.ends, start)
        out += [f"{t}b={w}" for w in sorted({w.lower() for _, _, w in line.tokens[max(0, i - 5) : i] if w[0].isalpha()})]
    return out


def _side(c: str) -> str:
    return "a" if c.isalnum() else c


class Lattice:
    """Candidate segments of a line, ordered by their ends, and the transitions between near ones."""

    def __init__(self, line: Line, words: frozenset[str], announcing: frozenset[str]) -> None:
        found = sorted(candidates(line, words, announcing), key=lambda c: (c[1], c[0]))
        self.segments = [(a, b, kind) for a, b, kind, _ in found]
        self.features = [features(line, *c, words) for c in found]
        ends = [b for _, b, _ in self.segments]
        #: Of each segment: how many segments end too far before it for a transition, and its near predecessors.
        self.far = [bisect_left(ends, a - NEAR, 0, k) for k, (a, _, _) in enumerate(self.segments)]
        self.near = [[(j, self._transition(line.text, j, k)) for j in range(self.far[k], bisect_right(ends, self.segments[k][0], 0, k))] for k in range(len(found))]

    def _transition(self, text: str, j: int, k: int) -> list[str]:
        (_, b, one), (a, _, other) = self.segments[j], self.segments[k]
        pair = f"T:{one[0]}{other[0]}"
        return [pair, f"{pair}|{re.sub('[0-9]', '0', text[b:a]).lower()}"]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def forward(lattice: Lattice, score: list[float], step: list[list[float]]) -> tuple[list[float], list[float]]:
    """Log sums over the labellings that end with each segment, and over those of the first k segments (the last: log Z)."""
    ending: list[float] = []
    upto = [0.0]
    for k, near in enumerate(lattice.near):
        ending.append(score[k] + _log_sum([upto[lattice.far[k]], *(ending[j] + s for (j, _), s in zip(near, step[k], strict=True))]))
        upto.append(_log_sum([upto[k], ending[k]]))
    return ending, upto


def backward(lattice: Lattice, score: list[float], step: list[list[float]], ending: list[float], upto: list[float]) -> tuple[list[float], list[list[float]]]:
    """Probability of each segment and of each pair of near neighbours: the derivatives of log Z, from the last back."""
    n = len(ending)
    of_upto, of_ending = [0.0] * n + [1.0], [0.0] * n
    pairs = [[0.0] * len(near) for near in lattice.near]
    for k in range(n - 1, -1, -1):
        of_upto[k] += of_upto[k + 1] * math.exp(upto[k] - upto[k + 1])
        of_ending[k] += of_upto[k + 1] * math.exp(ending[k] - upto[k + 1])
        inner = ending[k] - score[k]
        of_upto[lattice.far[k]] += of_ending[k] * math.exp(upto[lattice.far[k]] - inner)
        for i, (j, _) in enumerate(lattice.near[k]):
            pairs[k][i] = of_ending[k] * math.exp(ending[j] + step[k][i] - inner)
            of_ending[j] += pairs[k][i]
    return of_ending, pairs


def best_segments(lattice: Lattice, score: list[float], step: list[list[float]]) -> list[int]:
    """The segments of the labelling of greatest score (Viterbi over segment ends)."""
    ending: list[tuple[float, int, int]] = []  # score, and the segment before (-1: that of upto[far])
    upto: list[tuple[float, int]] = [(0.0, -1)]  # score, and the last segment (-1: none)
    for k, near in enumerate(lattice.near):
        value, last = upto[lattice.far[k]]
        for (j, _), s in zip(near, step[k], strict=True):
            if ending[j][0] + s > value:
                value, last = ending[j][0] + s, j
        ending.append((value + score[k], last, k))
        upto.append((ending[k][0], k) if ending[k][0] > upto[k][0] else upto[k])
    out, k = [], upto[-1][1]
    while k >= 0:
        out.append(k)
        k = ending[k][1]
    return out[::-1]


def decode(line: Line, model: Model) -> list[tuple[int, int, str]]:
    """The labelling of greatest probability."""
    lattice = Lattice(line, model.words, model.announcing)
    if not lattice.segments:
        return []
    score = [model.score(f) for f in lattice.features]
    step = [[model.score(f) for _, f in near] for near in lattice.near]
    return [lattice.segments[k] for k in best_segments(lattice, score, step)]


_model: list[Model] = []


def model() -> Model:
    if not _model:
        _model.append(Model.load())
    return _model[0]


@lru_cache(maxsize=100_000)
def _mentions_of_line(text: str) -> tuple[tuple[int, int, str], ...]:
    return tuple(decode(Line(text), model()))


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every mention, in characters of the text."""
    out: list[tuple[int, int, str]] = []
    at = 0
    for part in re.split("(\n)", text or ""):
        if part.strip():
            out += [(at + a, at + b, k) for a, b, k in _mentions_of_line(part)]
        at += len(part)
    return out


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not text or not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["message_id", "field_name", "item_no", "start_char", "pii_type", "end_char"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    for batch in batches:
        rows = []
        for key, content, calls in zip(*(batch.column(c).to_pylist() for c in ("message_id", "content", "tool_calls")), strict=True):
            for a, b, kind in mentions(content):
                rows.append((key, "content", -1, a, kind, b))
            for i, call in enumerate(calls or ()):
                for a, b, kind in mentions(call):
                    rows.append((key, "tool_calls", i, a, kind, b))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def find(messages: DataFrame) -> DataFrame:
    """One row per mention, of `content` (item -1) and of every string in `tool_calls`."""
    own = messages.select(F.col("message_id").cast("long").alias("message_id"), "content", "tool_calls")
    return own.mapInArrow(_rows, "message_id long, field_name string, item_no int, start_char int, pii_type string, end_char int")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = [redact(t, mentions(t)) for t in batch.column("content").to_pylist()]
        calls = [None if c is None else [redact(t, mentions(t)) for t in c] for c in batch.column("tool_calls").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("message_id"), pa.array(contents, pa.string()), pa.array(calls, pa.list_(pa.string()))], names=["message_id", "content", "tool_calls"])


def redacted(messages: DataFrame) -> DataFrame:
    """Every message with its mentions replaced by [TYPE], all other text unchanged; nulls stay null."""
    own = messages.select(F.col("message_id").cast("long").alias("message_id"), "content", "tool_calls")
    return own.mapInArrow(_redacted, "message_id long, content string, tool_calls array<string>")
