"""Texts read with the wrong encoding: a hidden Markov model finds the damaged spans, its states' inverses restore them.

One state is clean text; every other is a pair of encodings (written in one, read in another) or a chain of such steps.
Each state scores a character by the character before it; the tables of all states are fitted by `train_mojibake` on clean
text put through the state's own damage, and stored with the package. Characters outside ASCII decide, ASCII ones in
between only carry the state on. Viterbi labels every character; a labelled span gets its state's inverse transform.

Every text is scored whole: a vectorised pass finds texts in which any pair of neighbours is likelier under damage than
clean, and those are decoded. Damage that stands only inside quotation marks or back-ticks, as a word or less, is the
text's subject, not damage. U+FFFD outside of such quotes is damage that can't be undone.

Null, blank and ASCII texts are clean. Spans are restored one by one; restored text is null where none can be undone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = os.path.join(os.path.dirname(__file__), "models", "mojibake.npz")
#: Log costs of entering a damaged state and of leaving it.
ENTER, LEAVE = -5.5, -2.5
#: Log odds of a whole span against clean text, without the costs, from which it counts.
LEAST_ODDS = 7.0
#: Times a pair of neighbours must occur in clean training text to be no sign of damage.
ORDINARY = 4
SIGNS = "°±×÷€£¥§©®™½¼"
NONE = "�"

# -- encodings ---------------------------------------------------------------------------------------------------------

SINGLE = "latin_1 cp1252 mac_roman cp437 cp850 cp1251 koi8_r cp1250 iso8859_2 cp1254 cp866 mac_cyrillic iso8859_15 cp1253 cp1257".split()
_tables: dict[str, tuple[dict[int, str], dict[str, int]]] = {}


def _table(codec: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes a code page leaves undefined stand for the control of that number."""
    if codec not in _tables:
        to = {}
        for b in range(256):
            try:
                to[b] = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                to[b] = chr(b)
        _tables[codec] = to, {c: b for b, c in to.items()}
    return _tables[codec]


def encode(text: str, codec: str, strict: bool = True) -> bytes:
    if codec not in SINGLE:
        return text.encode(codec, "strict" if strict else "ignore")
    back = _table(codec)[1]
    if strict and any(c not in back for c in text):
        raise UnicodeEncodeError(codec, text, 0, 1, "no such character")
    return bytes(back[c] for c in text if c in back)


def decode(data: bytes, codec: str, strict: bool = True) -> str:
    if codec not in SINGLE:
        return data.decode(codec, "strict" if strict else "replace")
    to = _table(codec)[0]
    return "".join(to[b] for b in data)


#: Damage as steps (written in, read as). A state that loses controls can't be undone.
STATES: dict[str, list[tuple[str, str]]] = {
    f"{a}>{b}": [(a, b)]
    for a, b in [
        *(("utf_8", x) for x in ("latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "koi8_r", "cp866", "gb18030", "cp932")),
        *(("cp1252", x) for x in ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r")),
        *((x, "cp1252") for x in ("cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp1254", "shift_jis", "euc_jp", "gb18030", "mac_cyrillic", "big5", "euc_kr")),
        ("cp1251", "koi8_r"),
        ("koi8_r", "cp1251"),
        ("cp866", "cp1251"),
        ("cp1251", "cp866"),
        ("cp1250", "cp1251"),
        ("cp1250", "cp850"),
        ("cp1254", "cp850"),
        ("cp1250", "mac_roman"),
    ]
} | {
    "utf_8>cp1252 twice": [("utf_8", "cp1252"), ("utf_8", "cp1252")],
    "utf_8>latin_1 twice": [("utf_8", "latin_1"), ("utf_8", "latin_1")],
    "utf_8>cp1252>latin_1": [("utf_8", "cp1252"), ("utf_8", "latin_1")],
    "utf_8>latin_1 without controls": [("utf_8", "latin_1"), ("drop", "controls")],
}
NAMES = ["clean", *STATES]


def damage(text: str, state: str) -> str:
    """What `text` reads like after the state's damage; characters its encodings lack are lost."""
    for a, b in STATES[state]:
        text = re.sub("[\x80-\x9f]", "", text) if a == "drop" else decode(encode(text, a, False), b, False)
    return text


def undo(text: str, state: str) -> str:
    """The inverse of a state's damage; ValueError where there is none."""
    for a, b in reversed(STATES[state]):
        if a == "drop":
            raise ValueError("controls are lost")
        text = decode(encode(text, b), a)
    return text


# -- classes of characters ----------------------------------------------------------------------------------------------


def _class_names() -> tuple[list[str], np.ndarray]:
    """Names of the classes, and the class of each code point of the Basic Multilingual Plane (last: all beyond)."""
    names = ["start", "lower", "upper", "digit", "space", "mark"]
    of = np.full(0x10001, -1, np.int32)
    of[:128] = names.index("mark")
    of[[9, 10, 13, 32]] = names.index("space")
    for group, name in (("abcdefghijklmnopqrstuvwxyz", "lower"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), ("0123456789", "digit")):
        of[[ord(c) for c in group]] = names.index(name)

    def own(points) -> None:
        for p in points:
            if of[p] < 0:
                of[p] = len(names)
                names.append(chr(p))

    own(range(0x80, 0x180))
    own(range(0x401, 0x460))
    for codec in SINGLE:
        own(ord(c) for c in _table(codec)[0].values())
    own(range(0x2010, 0x2027))
    own([0xFFFD])

    def shared(name: str, points) -> None:
        k = len(names)
        names.append(name)
        points = np.asarray(list(points))
        of[points[of[points] < 0]] = k

    # Han by how common it is in the two national sets, by their own order: level one holds everyday characters.
    def level(codec: str, rows: range) -> list[int]:
        found = []
        for row in rows:
            for cell in range(1, 95):
                try:
                    found.append(ord(bytes([0xA0 + row, 0xA0 + cell]).decode(codec)))
                except (UnicodeDecodeError, TypeError):
                    pass
        return found

    shared("han both", set(level("gb2312", range(16, 56))) & set(level("euc_jp", range(16, 48))))
    shared("han zh", level("gb2312", range(16, 56)))
    shared("han ja", level("euc_jp", range(16, 48)))
    shared("han two", set(level("gb2312", range(56, 88))) | set(level("euc_jp", range(48, 85))))
    shared("han rare", range(0x3400, 0xA000))
    shared("hiragana", range(0x3040, 0x30A0))
    shared("katakana", range(0x30A0, 0x3100))
    shared("half width kana", range(0xFF61, 0xFFA0))
    shared("full width", [*range(0xFF01, 0xFF61), *range(0x3000, 0x3040)])
    shared("hangul", range(0xAC00, 0xD7A4))
    shared("private", range(0xE000, 0xF900))
    shared("latin more", range(0x180, 0x370))
    shared("greek", range(0x370, 0x400))
    shared("cyrillic more", range(0x400, 0x530))
    shared("box", range(0x2500, 0x25A0))
    shared("sign", range(0x2000, 0x2C00))
    shared("other", range(0x10001))
    return names, of


CLASSES, CLASS_OF = _class_names()
K = len(CLASSES)
ASCII_CLASSES = 6


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS_OF[np.minimum(points, 0x10000)]


# -- model --------------------------------------------------------------------------------------------------------------


class Model:
    """log_p[state, class before, class]: smoothed bigrams; pairs of ASCII classes score 0 in all states."""

    def __init__(self, path: str = MODEL) -> None:
        data = np.load(path)
        self.log_p = np.zeros((len(NAMES), K, K), np.float32)
        for s, name in enumerate(NAMES):
            mine = data["state"] == s
            counts = np.zeros((K, K))
            counts[data["before"][mine], data["at"][mine]] = data["n"][mine]
            if s == 0:
                self.add_signs(counts)
            self.log_p[s] = self.smooth(counts)
            if s == 0:
                ordinary = counts >= ORDINARY
            else:
                # What damage leaves as it was, or makes of other ordinary text, is no sign of damage.
                self.log_p[s][ordinary] = np.minimum(self.log_p[s], self.log_p[0])[ordinary]
        self.gain = self.log_p[1:].max(axis=0) - self.log_p[0]
        self.gain[:ASCII_CLASSES, :ASCII_CLASSES] = 0

    @staticmethod
    def add_signs(counts: np.ndarray) -> None:
        """Signs that any text may hold beside numbers and words, whether or not training text did."""
        signs = classes(SIGNS)
        for names, after in ((("space", "digit"), False), (("space", "lower", "upper", "digit", "mark"), True)):
            for k in map(CLASSES.index, names):
                where = (signs, k) if after else (k, signs)
                counts[where] = np.maximum(counts[where], ORDINARY)

    @staticmethod
    def smooth(counts: np.ndarray) -> np.ndarray:
        total = counts.sum()
        single = (counts.sum(axis=0) + 0.02) / (total + 0.02 * K)
        before = counts.sum(axis=1, keepdims=True)
        p = (counts + 4 * single) / (before + 4)
        out = np.log(p)
        out[:ASCII_CLASSES, :ASCII_CLASSES] = 0
        return out

    def suspicious(self, texts: list[str]) -> np.ndarray:
        """Whether any pair of neighbours is clearly likelier damaged than clean, for each text."""
        lengths = np.array([len(t) + 1 for t in texts])
        c = classes("\n".join(texts) + "\n")
        at = np.flatnonzero((c[1:] >= ASCII_CLASSES) | (c[:-1] >= ASCII_CLASSES)) + 1
        hit = at[self.gain[c[at - 1], c[at]] > 2.5]
        owner = np.searchsorted(np.cumsum(lengths), hit, "right")
        out = np.zeros(len(texts), bool)
        out[owner] = True
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, end, state, log odds) of the damaged spans of the likeliest labelling."""
        c = classes(text)
        before = np.concatenate([[0], c[:-1]])
        at = np.flatnonzero((c >= ASCII_CLASSES) | (before >= ASCII_CLASSES))
        if not len(at):
            return []
        score = self.log_p[:, before[at], c[at]].T.astype(np.float64)
        score -= score[:, :1]
        n, s = score.shape
        back = np.zeros((n, s), np.int16)
        best = np.full(s, ENTER)
        best[0] = 0.0
        best += score[0]
        for i in range(1, n):
            top = int(best[1:].argmax()) + 1
            stay_clean, leave = best[0], best[top] + LEAVE
            enter = max(stay_clean, leave) + ENTER
            origin = 0 if stay_clean >= leave else top
            here = back[i]
            here[:] = np.where(best >= enter, np.arange(s), origin)
            new = np.maximum(best, enter)
            new[0], here[0] = max(stay_clean, leave), origin
            best = new + score[i]
        best[1:] += LEAVE
        state = int(best.argmax())
        labels = np.zeros(n, np.int16)
        for i in range(n - 1, -1, -1):
            labels[i] = state
            state = int(back[i][state]) if i else 0
        found = []
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), n]
        for a, b in zip(edges, edges[1:], strict=False):
            if labels[a]:
                inside = at[a:b][c[at[a:b]] >= ASCII_CLASSES]
                odds = float(score[a:b, labels[a]].sum())
                if len(inside) and odds >= LEAST_ODDS:
                    found.append((int(inside[0]), int(inside[-1]) + 1, int(labels[a]), odds))
        return found


_model: list[Model] = []


def model() -> Model:
    """One per worker process."""
    if not _model:
        _model.append(Model())
    return _model[0]


ENTITY = re.compile(r"&#(\d{3,5});")
QUOTED = re.compile(r"`[^`\n]{1,40}`|\"[^\"\n]{1,40}\"|“[^”\n]{1,40}”|'[^'\n]{1,40}'|«[^»\n]{1,40}»|„[^“”\n]{1,40}[“”]|「[^」\n]{1,40}」|‘[^’\n]{1,40}’")


def _quoted(text: str, start: int, end: int, quotes: list[tuple[int, int]]) -> bool:
    """Whether a span lies within one short quoted word."""
    return any(a < start and end < b and not re.search(r"\s", text[a + 1 : b - 1]) for a, b in quotes)


#: Further inverses to try where a state's own fails on a stretch: what lost some controls may have kept others.
KIN = {s: [s, *(o for o in NAMES[1:] if o != s and STATES[o][0][0] == STATES[s][0][0] and len(STATES[o]) == 1 and STATES[o][0][1] in ("latin_1", "cp1252"))] for s in NAMES[1:]}


def _undo_span(text: str, state: int) -> str | None:
    """The whole stretch undone, or its runs beyond ASCII one by one (clean characters in between stay), or None."""
    tries = KIN[NAMES[state]]
    for s in tries:
        try:
            return undo(text, s)
        except (ValueError, LookupError):
            pass

    def run(m: re.Match) -> str:
        for s in tries:
            try:
                return undo(m.group(), s)
            except (ValueError, LookupError):
                pass
        raise ValueError("no inverse")

    try:
        return re.sub(r"[^\x00-\x7f]+", run, text)
    except ValueError:
        return None


def examine(text: str | None) -> tuple[list[tuple[int, int, int, float]], str | None, bool] | None:
    """Spans, the restored text and whether something stays lost; None for a clean text.

    Each span is undone by itself: one that can't be, like lost characters, stays as it is while the others are restored
    (`lost` is then true). The restored text is None only where nothing could be undone.
    """
    if not text:
        return None
    plain = ENTITY.sub(lambda m: chr(int(m.group(1))) if 127 < int(m.group(1)) < 0xD800 else m.group(), text)
    quotes = [m.span() for m in QUOTED.finditer(plain)]
    spans = model().spans(plain)
    lost = [m.start() for m in re.finditer(NONE, plain)]
    if all(_quoted(plain, a, b, quotes) for a, b, _, _ in spans) and all(_quoted(plain, i, i + 1, quotes) for i in lost):
        return None
    out, at, stuck = [], 0, False
    for a, b, s, _ in spans:
        if _quoted(plain, a, b, quotes):
            continue
        fixed = _undo_span(plain[a:b], s)
        if fixed is None and b < len(plain) and (fixed := _undo_span(plain[a : b + 1], s)) is not None:
            b += 1  # the last byte of a multi-byte character may read as ASCII
        if fixed is None:
            stuck = True
            continue
        out += [plain[at:a], fixed]
        at = b
    return spans, "".join(out) + plain[at:] if out else None, stuck or bool(lost)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "spans", "damage", "lost", "text", "restored"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for first in range(0, len(texts), 500):
            part = texts[first : first + 500]
            for i in np.flatnonzero(model().suspicious([t if "&#" not in t else ENTITY.sub(NONE, t) for t in part])):
                if (found := examine(part[i])) is not None:
                    spans, restored, lost = found
                    kinds_ = sorted({NAMES[s] for _, _, s, _ in spans})
                    rows.append((ids[first + i], len(spans), ", ".join(kinds_), lost, part[i], restored))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def damaged(documents: DataFrame) -> DataFrame:
    """doc_id, spans, damage (states), lost, text, restored: the affected documents."""
    # ASCII texts without numeric entities can't be affected and needn't leave the JVM.
    own = documents.where(F.col("text").rlike(r"[^\x00-\x7F]|&#\d")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_find, "doc_id long, spans int, damage string, lost boolean, text string, restored string")
