"""One consistent form for text that looks the same (problem 5), and words in that form.

The method is compatibility normalisation in composed form, full case folding, mapped blanks and
removal of default-ignorable characters. Two forms come out of it:

* `visual_form`: everything a reader cannot see is settled, what a reader sees stays. Letter case,
  accents, raised digits and punctuation are kept; look-alike letters and signs become one letter.
* `fold_key`: the fully case-folded compatibility form of the visual form. It is coarser, so texts
  of equal visual form always have equal keys; it serves as the blocking key and for comparisons
  that ignore case.

Both are defined character by character except for composition, so most texts are mapped by one
table lookup over the code points of a whole batch; texts with combining marks, invisible or
expanding characters take the string path. Both paths give the same result (tested).

Defined cases: null has the null form; texts of blanks have the empty form; very long texts are
mapped whole; unpaired surrogates cannot occur in Arrow strings.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

# Letters and signs of other scripts that look like a Latin one (public Unicode
# security data, only pairs that are alike in common fonts).
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ԍ": "G", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ӏ": "l", "ց": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Latin letters outside the plain alphabet
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # signs
    "‐": "-", "‑": "-", "‒": "-", "⁃": "-", "−": "-", "﹣": "-", "˗": "-", "∕": "/", "⁄": "/", "∶": ":", "ꓽ": ":", "׃": ":",
    "٪": "%", "⁎": "*", "∗": "*", "ǃ": "!", "ⅼ": "l", "ꓸ": ".", "․": ".", "‚": ",", "ˌ": ",", "∣": "|", "ǀ": "|", "׀": "|",
}

# Compatibility tags whose characters a reader sees as different from their mapping.
VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")

# Ranges of default-ignorable code points, and control characters without a glyph.
IGNORABLE = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF),
)

LIMIT = 0x110000
#: Characters a batch mapped at once may have; bounds the memory of the table path.
BATCH_CHARS = 1 << 20


@functools.cache
def _mapped() -> tuple[int, ...]:
    """Code points that normalisation may change, or that join with others."""
    found = []
    for cp in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        c = chr(cp)
        if unicodedata.decomposition(c) or unicodedata.combining(c) or unicodedata.category(c) in ("Zs", "Mc", "Me"):
            found.append(cp)
    return tuple(found)


@functools.cache
def _stages() -> tuple[dict[int, str | None], dict[int, str]]:
    """First stage: blanks, ignorables and compatibility mappings; second: look-alikes of decomposed text."""
    first: dict[int, str | None] = {cp: None for a, b in IGNORABLE for cp in range(a, b + 1)}
    for cp in _mapped():
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if cp in first:
            continue
        if unicodedata.category(c) == "Zs":
            first[cp] = " "
        elif d.startswith("<") and not d.startswith(VISIBLE_TAGS):
            to = unicodedata.normalize("NFKC", c)
            if not to.startswith(" "):  # spacing accents are signs of their own
                first[cp] = to
    first |= {0x09: " ", 0x0B: "\n", 0x0C: "\n", 0x85: "\n", 0x2028: "\n", 0x2029: "\n", 0x0D: "\n"}
    return first, str.maketrans(LOOK_ALIKES)


def visual_form(text: str | None) -> str | None:
    """The string as a reader sees it; see the module's docstring."""
    if text is None:
        return None
    first, look = _stages()
    s = text.replace("\r\n", "\n").translate(first)
    s = unicodedata.normalize("NFD", s).translate(look)
    return unicodedata.normalize("NFC", s).strip()


def fold_key(form: str | None) -> str | None:
    """Full case folding and compatibility composition of a visual form: equal forms have equal keys."""
    if form is None:
        return None
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its visual form if that is one character, whether it needs the string path,
    the lower case of the visual form, and whether that is a letter, digit or underscore."""
    cps = np.arange(LIMIT, dtype=np.uint32)
    form, hard, lower = cps.copy(), np.zeros(LIMIT, bool), cps.copy()
    first, look = _stages()
    hard[0xD800:0xE000] = True
    for cp in {*_mapped(), *look, *(cp for cp, to in first.items() if to is not None)}:
        c = chr(cp)
        s = visual_form(c) or first.get(cp)
        if s is None or len(s) != 1 or unicodedata.combining(c) or unicodedata.category(c) in ("Mc", "Me"):
            hard[cp] = True
        else:
            form[cp] = ord(s)
    hard[0x1100:0x1200] = hard[0x30000:] = True
    hard[[cp for cp, to in first.items() if to is None]] = True
    for cp in np.unique(form[~hard]).tolist():
        s = chr(cp).lower()
        if len(s) == 1 and cp != 0x3A3:  # the capital sigma is lowered by its place in the word
            lower[cp] = ord(s)
        else:
            hard[form == cp] = True
    low = lower[form]
    word = np.fromiter((chr(cp).isalnum() or cp == 0x5F for cp in range(LIMIT)), bool, LIMIT)
    return form, hard, low, word


def form_codes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the visual (lower-cased if asked) forms of `texts`, concatenated, each followed by one
    line feed, and where each text starts (one more entry for the end)."""
    form, hard, low, _ = tables()
    table = low if lower else form
    given = texts
    texts = [t.strip() for t in texts]
    if any("\r\n" in t for t in texts):
        texts = [t.replace("\r\n", "\n") for t in texts]
    codes = _codes(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    bad = hard[codes]
    if bad.any():
        which = np.unique(np.searchsorted(starts, np.flatnonzero(bad), side="right") - 1)
        for i in which.tolist():
            s = visual_form(given[i])
            texts[i] = s.lower() if lower else s
        done = np.zeros(len(texts), bool)
        done[which] = True
        codes = _codes(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        return np.where(np.repeat(done, lengths + 1), codes, table[codes]), starts
    return table[codes], starts


def _codes(texts: list[str]) -> np.ndarray:
    big = "\n".join(texts) + "\n" if texts else ""
    if big.isascii():
        return np.frombuffer(big.encode("ascii"), np.uint8)
    return np.frombuffer(big.encode("utf-32-le"), np.uint32)


_K = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * _A
    h = h ^ (h >> np.uint64(27))
    h = h * _B
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    k, inv = np.full(n, _K), np.full(n, np.uint64(pow(int(_K), -1, 1 << 64)))
    k[0] = inv[0] = 1
    return np.cumprod(k, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of `codes`; equal spans have equal hashes wherever they are."""
    n = 1 << max(10, int(len(codes)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def batches(texts: list[str], most: int = BATCH_CHARS):
    """Index ranges of `texts` with at most `most` characters each (one longer text alone), ASCII texts apart."""
    for ascii_ in (True, False):
        own = [i for i, t in enumerate(texts) if t is not None and t.isascii() is ascii_]
        at = 0
        while at < len(own):
            to, chars = at, 0
            while to < len(own) and (to == at or chars + len(texts[own[to]]) <= most):
                chars += len(texts[own[to]]) + 1
                to += 1
            yield own[at:to]
            at = to


def word_spans(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word (run of letters, digits, underscores) in `form_codes` output."""
    word = tables()[3][codes]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return a, b, np.searchsorted(starts, a, side="right") - 1
