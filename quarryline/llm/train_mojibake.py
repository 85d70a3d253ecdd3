"""Fits the tables of `mojibake`: python -m quarryline.llm.train_mojibake FOLDER OUT [LOCALES], with FOLDER holding documents.parquet.

Clean training text is what remains of the documents after plain tests for damage, and of the message catalogues of public
programs in further languages (LOCALES, a folder of gettext catalogues); each state's counts come from that text put
through the state's damage. At most TEXTS documents and LINES lines of a language are used.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np

from quarryline.llm import mojibake as M

TEXTS = 20_000
LINES = 400
FURTHER = ("cs", "sk", "hu", "ro", "hr", "sl", "sv", "da", "nb", "fi", "tr", "uk", "bg", "lt", "lv", "et")
#: Letters outside ASCII of the languages at hand, and signs common to all (fixed values).
LETTERS = "äöüßÄÖÜáéíóúñÁÉÍÓÚÑ¿¡àâçèêëîïôùûœæÀÂÇÈÊËÎÏÔÙÛãõÃÕąćęłńśźżĄĆĘŁŃŚŹŻğışĞİŞåÅæøÆØčďěňřšťůžČĎĚŇŘŠŤŮŽýÝľĺŕĽĹŔőűŐŰăâîșțşţĂÂÎȘȚŞŢđĐāēģīķļņūĀĒĢĪĶĻŅŪėįųĖĮŲ"
SIGNS = "’‘“”„…–—«»•→←×µ°±≈≥≤─│├└┌┐┘┬┴┼━▓░█✓✗✔✖№€£·⚠│½²³\xa0 "
CLEAN = re.compile(rf"^[\x00-\x7f{LETTERS}{SIGNS}Ѐ-џҐґ　-ヿ一-鿿！-｠☀-➿️\U0001F300-\U0001FAFF]*$")
WRONG = re.compile(
    "[a-zA-Z][Ѐ-џ]|[Ѐ-џ][a-zA-Z]|[а-яё][А-ЯЁ]|[ÂÄÅÐÑ][\u0080-¿]|Ã(?!O|ES)|â[\u0080-¿€”“•™š…‚ƒ„†‡ˆ‰‹–—˜›]|³ |³$|[‚†‡‰][a-zA-Z]|[a-z][ÀÁÂÄÆÇÈÉËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ][a-z]|[РС][°±²³µ·Ѐ-Џ‘-„…]|[縺繧蜃鏂鐨锛]|&#\\d|[├└┤┬│─][a-zA-Z]|[a-zA-Z][├└┤┬│─┼]|[œæ][ł¿]|[¿¡](?![A-ZÁÉÍÓÚÑ])"
)


def clean_texts(texts: list[str]) -> list[str]:
    kept = [t for t in texts if t and CLEAN.match(t) and not WRONG.search(t)]
    often = Counter(c for t in kept for c in set(re.findall(r"[^\x00-\x7f]", t)))
    return [t for t in kept if sum(often[c] < 4 for c in set(re.findall(r"[^\x00-\x7f]", t))) <= 1]


def pair_counts(texts: list[str]) -> np.ndarray:
    counts = np.zeros(M.K * M.K, np.int64)
    for t in texts:
        c = M.classes(t).astype(np.int64)
        before = np.concatenate([[0], c[:-1]])
        own = (c >= M.ASCII_CLASSES) | (before >= M.ASCII_CLASSES)
        counts += np.bincount(before[own] * M.K + c[own], minlength=M.K * M.K)
    return counts


def further_texts(locales: str) -> list[str]:
    """Lines of the catalogues beyond ASCII, the same number of each language."""
    from quarryline.llm.train_pii import ordinary

    out = []
    for code in FURTHER:
        lines = sorted({t for t in ordinary(locales, (code,)) if not t.isascii() and CLEAN.match(t) and not WRONG.search(t) and len(t) > 30})
        out += lines[:: max(1, len(lines) // LINES)][:LINES]
    return out


def main(folder: str, out: str, locales: str | None = None) -> None:
    import pyarrow.dataset as ds

    texts = ds.dataset(f"{folder}/documents.parquet").head(TEXTS, columns=["text"])["text"].to_pylist()
    clean = [t for t in clean_texts(texts) if not t.isascii()]
    clean += further_texts(locales) if locales else []
    print(len(texts), "texts,", len(clean), "clean ones beyond ASCII")
    rows = []
    for s, name in enumerate(M.NAMES):
        if s == 0:
            mine = clean
        else:
            encoding = M.STATES[name][0][0]
            mine = []
            for t in clean:
                special = [c for c in t if ord(c) > 127]
                usable = sum(bool(M.encode(c, encoding, False)) for c in special) if encoding != "utf_8" else len(special)
                if usable >= 0.8 * len(special):
                    mine.append(t)
            if all(b in M.SINGLE or a == "drop" for a, b in M.STATES[name]):
                # Each character is damaged by itself.
                table = {ord(c): M.damage(c, name) for c in set("".join(mine))}
                mine = [t.translate(table) for t in mine]
            else:
                mine = [M.damage(t, name) for t in mine]
        counts = pair_counts(mine)
        at = np.flatnonzero(counts)
        rows.append((np.full(len(at), s, np.int16), (at // M.K).astype(np.int16), (at % M.K).astype(np.int16), counts[at].astype(np.int32)))
    state, before, at, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    np.savez_compressed(out, state=state, before=before, at=at, n=n)
    print(len(n), "cells")


if __name__ == "__main__":
    main(*sys.argv[1:4])
