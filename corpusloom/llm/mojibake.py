"""Text that was read in a wrong character encoding (problem 9).

Method: minimum description length. Each stretch of text that isn't ASCII is encoded back and decoded by every
plausible chain of encodings; original and candidates are compressed with a zstandard dictionary
of their language, and the chain of the least description length (compressed bytes, a cost for
each step of the chain, and a cost for characters foreign to the language) wins. Where the original
is the shortest, it is left unchanged.

The dictionaries are trained on a bounded sample of the distinct documents of each language (`SAMPLE` texts each);
which characters a language uses is a fixed alphabet, so garbled text, however often it is repeated, makes
nothing usual. A single-byte decoding is a candidate where it holds no more foreign characters than the text and its other decodings.
A text without a known language is judged by the two languages that describe its ASCII part best.
A sequence that stands alone and means no word or sign in its place is an example of
garbled text, not a case; so is one in quotation marks.

Defined cases: null and empty texts are sound; a replacement character that touches a letter, a figure or garble,
follows a sentence or makes up a word marks a document as affected but lost; no restored text holds one, it is null instead; texts are read whole, however long; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .budget import language_code

#: Texts per language that a dictionary is trained on, at most; and the dictionary's bytes.
SAMPLE = 600
#: Characters that a text has which a dictionary is trained on, least and most; all texts are judged, whatever their length.
SAMPLED_LENGTHS = (50, 20_000)
DICTIONARY_BYTES = 48_000
#: Description length, in bytes, of a step of a chain and of a character foreign to the language.
STEP_COST = 2
STRANGE_COST = 3
#: Bytes by which a single-byte decoding of sound text can be shorter by chance; charged where it removes no strange character.
CHANCE = 12
#: Steps of the longest chain that is tried.
MOST_STEPS = 3
#: Compression level; the texts are short, higher ones gain nothing.
LEVEL = 5

# Encodings that text is read in by mistake, and encodings that text is stored in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp1254", "cp866", "mac-cyrillic", "iso8859-5", "shift_jis", "cp1253", "cp1257")
STORED = {
    "west": ("cp1252", "cp437", "cp850", "mac-roman"),
    "ru": ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5"),
    "ja": ("shift_jis", "euc-jp"),
}
# Languages of the dictionaries, by the script of their encodings.
WEST = ("en", "de", "fr", "es", "pt")
LANGUAGES = (*WEST, "ru", "ja")
# The characters beyond ASCII that each language is written with; of kanji, those of the first level of JIS.
_MARKS = "“”‘’–—…€°"
ALPHABETS = {k: frozenset(_MARKS + v) - frozenset("–—" if k == "ru" else "") for k, v in {  # Russian dashes touch no letter
    "en": "éèêëïöñç£",
    "de": "äöüßÄÖÜẞé„‚«»›‹§",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ«»",
    "es": "áéíóúüñÁÉÍÓÚÜÑ¿¡«»ºª",
    "pt": "àáâãçéêíóôõúüÀÁÂÃÇÉÊÍÓÔÕÚÜ«»ºª",
    "ru": "".join(map(chr, range(0x410, 0x450))) + "ёЁ«»„№",
    "ja": "".join(map(chr, (*range(0x3001, 0x3018), *range(0x3041, 0x3097), *range(0x30A1, 0x30FF), *range(0xFF01, 0xFF5F)))) + "".join(
        bytes([a, b]).decode("shift_jis", "ignore") for a in range(0x88, 0x99) for b in range(0x40, 0xFD) if (a, b) >= (0x88, 0x9F) and (a, b) <= (0x98, 0x72)),
}.items()}
_KNOWN = frozenset().union(*ALPHABETS.values())
# Words of one or two letters that a wrong decoding can garble as a whole, by language.
SHORT_WORDS = {
    "fr": ("à", "ça", "où"), "pt": ("à", "é", "às", "só", "há", "já", "aí"), "es": ("él", "tú", "sí", "sé", "té", "mí", "ó"), "de": ("öl",),
    "ru": ("я", "а", "и", "в", "о", "к", "с", "у", "не", "но", "на", "по", "от", "до", "из", "за", "со", "во", "ты", "мы", "вы", "он", "их", "её", "да", "же", "бы", "ли", "то", "об"),
}
_ANY_WORD = frozenset().union(*SHORT_WORDS.values())

_ASCII = frozenset(map(chr, range(128)))
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_BEYOND = re.compile(r"[^\x00-\x7f]")
_INNER = re.compile(r"(?<=[A-Za-z])[^\x00-\x7f](?=[A-Za-z])")
_LATE = re.compile(r"(?<=[a-z])[^\x00-\x7f]")
_INVERTED = re.compile(r"[^\W\d_A-Za-z]*[а-яё][А-ЯЁ]{2}|[à-öø-ÿ][À-ÖØ-Þ]{2}")
_CUT = re.compile(r"(?<=[.!?…。])[ \t]+|\n")


@functools.cache
def _to_byte(encoding: str) -> dict[str, bytes]:
    """Bytes of each character of an encoding; bytes it leaves open stand for themselves."""
    out: dict[str, bytes] = {}
    if encoding in ("shift_jis", "euc-jp"):
        return out
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = bytes([b])
        except UnicodeDecodeError:
            out.setdefault(chr(b), bytes([b]))
    if encoding == "cp1252":  # readers map the C1 controls to themselves too
        for b in range(128, 160):
            out.setdefault(chr(b), bytes([b]))
    return out


def back(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as `text`; None where the encoding lacks a character."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        table = _to_byte(encoding)
        if not table:
            return None
        parts = []
        for c in text:
            b = c.encode() if c < "\x80" else table.get(c)
            if b is None:
                return None
            parts.append(b)
        return b"".join(parts)


@functools.lru_cache(maxsize=200_000)
def _undo_run(run: str, encoding: str) -> str | None:
    """The run decoded as UTF-8 after reading it back, if that is valid throughout and shorter."""
    raw = back(run, encoding)
    if raw is None:
        return None
    try:
        got = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return got if len(got) < len(run) else None


def undo_utf8(text: str, encoding: str) -> str:
    """`text` with every run that is UTF-8 read as `encoding` decoded; the rest unchanged."""
    return _RUN.sub(lambda m: _undo_run(m.group(), encoding) or m.group(), text)


def undo_single(text: str, read_as: str, stored: str) -> str | None:
    """`text` read back from `read_as` and decoded as the single- or double-byte encoding `stored`.

    Characters that `read_as` lacks were not read with it: they stay, and the stretches between them are decoded.
    """
    raw = back(text, read_as)
    if raw is None:
        table = _to_byte(read_as)
        parts = [("".join(g), k) for k, g in itertools.groupby(text, key=lambda c: c < "\x80" or c in table)] if table else []
        fixed = [undo_single(p, read_as, stored) or p if k and not p.isascii() else p for p, k in parts]
        got = "".join(fixed) or text
    else:
        try:
            got = raw.decode(stored)
        except UnicodeDecodeError:
            return None
    return got if got != text else None


@functools.cache
def _starts(encoding: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters of an encoding whose bytes can be the first and the second of a UTF-8 sequence."""
    table = _to_byte(encoding).items()
    return frozenset(c for c, b in table if b"\xc2" <= b <= b"\xf4"), frozenset(c for c, b in table if b"\x80" <= b <= b"\xbf")


@functools.lru_cache(maxsize=200_000)
def _undoable(run: str) -> tuple[str, ...]:
    """The encodings that the run can be UTF-8 read as."""
    out = []
    for e in READ_AS:
        first, second = _starts(e)
        if (not first or run[0] in first and run[1] in second) and _undo_run(run, e):
            out.append(e)
    return tuple(out)


@functools.cache
def _single_map(read_as: str, stored: str) -> tuple[dict[int, str], frozenset[str]]:
    """Character by character, what `undo_single` makes of a text; and the characters whose bytes `stored` leaves open."""
    out, undefined = {}, set()
    for c, b in _to_byte(read_as).items():
        try:
            out[ord(c)] = b.decode(stored)
        except UnicodeDecodeError:
            undefined.add(c)
    return out, frozenset(undefined)


@functools.cache
def _bits() -> dict[str, int]:
    """A bit for each character of the single-byte encodings, so that sets of them are whole numbers."""
    return {c: 1 << k for k, c in enumerate(sorted({c for e in READ_AS for c in _to_byte(e)}))}


def _mask(chars) -> int:
    bits, out = _bits(), 0
    for c in chars:
        out |= bits.get(c, 0)
    return out


@functools.cache
def _steps(langs: tuple[str, ...]) -> tuple[tuple[str, str, bool, int, int, int, int, int, tuple[int, ...]], ...]:
    """Every single-byte step of the languages: `(read as, stored, whether characters decide one by one, the characters that it reads, that
    it leaves open, that it changes, that become signs, that become capitals, and that become letters foreign to each language)`."""
    out = []
    for s in (s for k, names in STORED.items() if (k == "west" and set(langs) & set(WEST)) or k in langs for s in names):
        for e in READ_AS:
            if e == s:
                continue
            table = _to_byte(e)
            if not table or s in STORED["ja"]:
                out.append((e, s, False, _mask(table), 0, 0, 0, 0, ()))
                continue
            one, undefined = _single_map(e, s)
            foreign = tuple(_mask(chr(c) for c, got in one.items() if got.isalpha() and got not in ALPHABETS.get(lang, _KNOWN)) for lang in langs)
            signs = _mask(chr(c) for c, got in one.items() if not got.isalpha() and unicodedata.category(got)[0] not in "MC" and got != "’")
            capitals = _mask(chr(c) for c, got in one.items() if got.isupper())
            out.append((e, s, True, _mask(table), _mask(undefined), _mask(chr(c) for c, got in one.items() if got != chr(c)), signs, capitals, foreign))
    return tuple(out)


def _single_steps(text: str, langs: tuple[str, ...], odd: int) -> list[tuple[str, str, dict[int, str] | None]]:
    """`(read as, stored, map of characters)` that can turn a text with `odd` strange characters into one with no more of them.

    Of those with the same result, the first; no map where the characters don't decide one by one. A step is left out early where the letters
    that become foreign, signs between two letters and capitals after a small letter are too many by themselves.
    """
    chars = frozenset(text) - _ASCII
    out, known, mask = [], set(), _mask(chars)
    inner, late = _mask(_INNER.findall(text)), _mask(_LATE.findall(text))
    bits, wide = _bits(), max(text) >= "\u3000"
    unknown = any(c not in bits for c in chars)
    for e, s, alone, read, undefined, changed, signs, capitals, foreign in _steps(langs):
        if not (mask & read if read else wide):  # text read as one of two bytes a character holds Japanese characters
            continue
        one = None
        if alone and mask & undefined:
            if not unknown and not mask & ~read:  # the whole text would be decoded, and can't be
                continue
        elif alone:
            if not mask & changed:
                continue
            bad = inner & signs | late & capitals
            if bad.bit_count() > odd or min([(mask & f | bad).bit_count() for f in foreign]) > odd:
                continue
            one = _single_map(e, s)[0]
            key = frozenset((c, g) for c in chars if (g := one.get(ord(c), c)) != c)
            if key in known:
                continue
            known.add(key)
        out.append((e, s, one))
    return out


_NONE: frozenset[str] = frozenset()


def _odd(word: str, lang: str) -> frozenset[str]:
    """The characters of a word (what stands between two blanks) that don't belong where they are: letters foreign to the language,
    letters that stand alone and are no word, capitals after a small letter, signs in a word, and signs that touch a letter but for those of the language."""
    alphabet, words, odd = ALPHABETS.get(lang, _KNOWN), SHORT_WORDS.get(lang, _ANY_WORD), set()
    for k, c in enumerate(word):
        if c < "\x80" or c in odd:
            continue
        before, after = word[k - 1 : k], word[k + 1 : k + 2]
        if c.isalpha():
            if c not in alphabet or c.isupper() and before.islower() or c < "\u3000" and not before.isalnum() and not after.isalnum() and c.lower() not in words:
                odd.add(c)
        elif unicodedata.category(c)[0] in "MC" and not _pictorial(c):  # marks and controls
            if c not in alphabet:
                odd.add(c)
        elif before.isalpha() and after.isalpha() and c != "’" and before < "\u3000" and after < "\u3000" or (before.isalpha() or after.isalpha()) and c not in alphabet and not _pictorial(c):
            odd.add(c)
    return frozenset(odd) if odd else _NONE


_odd_short = functools.lru_cache(maxsize=300_000)(_odd)


@functools.lru_cache(maxsize=300_000)
def _odd_mapped(word: str, lang: str, read_as: str, stored: str) -> frozenset[str]:
    """`_odd` of a word after a single-byte step."""
    return _odd(word.translate(_single_map(read_as, stored)[0]), lang)


#: Length of the words whose strange characters a task remembers.
REMEMBERED = 40


def _strange(words: list[str], langs: tuple[str, ...], most: int, step: tuple[str, str] | None = None) -> int:
    """How many different strange characters the words hold (after `step`), in the language that they suit best; above `most`, any number above it."""
    least = None
    for lang in langs:
        odd = _NONE
        for w in words:
            if step is None:
                more = _odd_short(w, lang) if len(w) <= REMEMBERED else _odd(w, lang)
            else:
                more = _odd_mapped(w, lang, *step) if len(w) <= REMEMBERED else _odd(w.translate(_single_map(*step)[0]), lang)
            if more:
                odd = odd | more
                if len(odd) > most:
                    break
        least = len(odd) if least is None else min(least, len(odd))
        most = min(most, least)
    return least or 0


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if not w.isascii()]


class Model:
    """Compressors of each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.__init__(state)

    @functools.cached_property
    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang, raw in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(raw), write_content_size=False, write_dict_id=False, write_checksum=False)
            d.precompute_compress(compression_params=params)
            out[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return out

    def cost(self, text: str, langs: tuple[str, ...]) -> float:
        """Description length of `text` in bytes, in the language that describes it best."""
        raw = text.encode("utf-8", "surrogatepass")
        known = [lang for lang in langs if lang in self.compressors]
        return min((len(self.compressors[lang].compress(raw)) + STRANGE_COST * self.strange(text, (lang,)) for lang in known), default=len(raw))

    def likely(self, text: str) -> tuple[str, ...]:
        """The languages that a text without a known one is judged by: the two that describe its ASCII part best where that has most of its letters, else all."""
        plain = _BEYOND.sub("", text)
        if 2 * sum(map(str.isalpha, plain)) <= sum(map(str.isalpha, text)):
            return tuple(self.compressors)
        raw = plain.encode()
        return tuple(sorted(self.compressors, key=lambda k: (len(self.compressors[k].compress(raw)), k))[:2])

    @staticmethod
    def strange(text: str, langs: tuple[str, ...], most: int = 1 << 30) -> int:
        """How many different characters of `text` don't belong where they are (see `_odd`), in the language that it suits best; above `most`, any number above it."""
        return _strange(_words(text), langs, most)

    @staticmethod
    def plausible(got: str) -> bool:
        """Whether a decoded run is made of characters that the languages use."""
        odd = sum(not (c < "\x80" or c in _KNOWN or _pictorial(c)) for c in got)
        return 2 * odd < len(got)


def suspicious(text: str, lang: str | None) -> bool:
    """Whether a text may be garbled, so that no dictionary should be trained on it."""
    if text.isascii():
        return False
    if "�" in text or _INVERTED.search(text) or Model.strange(text, (lang or "",)):
        return True
    return any(run.isupper() or _undoable(run) for run in set(_RUN.findall(text)))


def _pictorial(c: str) -> bool:
    """Signs that any text may hold: fixed blanks, symbols, arrows, lines of trees, emoji."""
    return "←" <= c <= "⋿" or "☀" <= c <= "➿" or c >= "\U0001f000" or c in "\xa0\u200d\ufe0f─│└├"


def candidates(text: str, langs: tuple[str, ...], model: Model) -> dict[str, tuple[float, tuple[str, ...]]]:
    """Decodings of a stretch of text, each with the cost and the steps of its shortest chain.

    No decoding holds more strange characters than the text. Chains are steps that undo UTF-8, up to `MOST_STEPS` of them, all different decodings of a step being
    decoded further; or one single-byte step that leaves no more strange characters than any decoding of the first kind (it costs `CHANCE` if it leaves as many as the text).
    """
    out: dict[str, tuple[float, tuple[str, ...]]] = {}
    fresh: dict[str, tuple[float, tuple[str, ...]]] = {text: (0, ())}
    words = _words(text)
    most = odd = _strange(words, langs, 1 << 30)
    while fresh:
        found: dict[str, tuple[float, tuple[str, ...]]] = {}
        for t, (cost, chain) in fresh.items():
            if len(chain) == MOST_STEPS:
                continue
            for e in sorted({e for run in set(_RUN.findall(t)) for e in _undoable(run)}, key=READ_AS.index):
                got = undo_utf8(t, e)
                if got != text and got not in out:
                    found.setdefault(got, (cost + STEP_COST, (*chain, f"utf-8 as {e}")))
        for got, step in found.items():
            left = model.strange(got, langs, odd)
            if left <= odd and model.plausible("".join(c for c in got if c > "\x7f") or "-"):
                out[got] = step
                most = min(most, left)
        fresh = found
    for e, s, one in _single_steps(text, langs, most):
        if one:
            left = _strange(words, langs, most, (e, s))
            got = text.translate(one) if left <= most else None
        else:
            got = undo_single(text, e, s)
            left = model.strange(got, langs, most) if got else 0
        if got and left <= most and got != text and got not in out:
            out[got] = (STEP_COST + (1 if left < odd else CHANCE), (f"{s} as {e}",))
    return out


def is_example(text: str, start: int, end: int, got: str, lang: str | None) -> bool:
    """Whether a garbled sequence is shown rather than used: alone between blanks or quotation marks, and no word or sign there."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if not got or before.isalnum() or after.isalnum():
        return False
    if before and after and before in "\"'`“«„(‘" and after in "\"'`”»“)’":
        return True
    letters = sum(c.isalpha() for c in got)
    if letters == len(got):
        return letters <= 2 and got.lower() not in SHORT_WORDS.get(lang, ())
    return all(c in "“”‘’„«»" for c in got)


def lost_characters(text: str) -> bool:
    """Whether a replacement character stands for a lost one, rather than for itself: it touches a letter, a figure or garble, makes up a word, or follows the end of a sentence."""
    for m in re.finditer("�+", text):
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        if before and after and before in "\"'`“«„(‘" and after in "\"'`”»“)’":
            continue
        near = [c for c in (before.strip("\"'`"), after.strip("\"'`")) if c]
        if len(m.group()) > 1 or before and before in ".!?" or any(c.isalnum() or c > "\x7f" and not c.isspace() and not _pictorial(c) and c not in "“”‘’„«»–—…" for c in near):
            return True
    return False


def repair(text: str, lang: str | None, model: Model) -> tuple[bool, str | None]:
    """Whether `text` is garbled, and its original where nothing was lost."""
    langs = (lang,) if lang in model.compressors else model.likely(text)
    lost = affected = "�" in text and lost_characters(text)
    parts, at = [], 0
    pieces = []
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        pieces.append((text[at:end], m.group() if m else ""))
        at = m.end() if m else end
    shown: list[bool] = []
    for piece, gap in pieces:
        best, keep = None, piece
        if not piece.isascii():
            tried = candidates(piece, langs, model)
            original = model.cost(piece, langs) if tried else 0.0
            for got, (steps, chain) in tried.items():
                c = model.cost(got, langs) + steps
                if c < original:
                    odd = model.strange(got, langs)
                    if best is None or (c, odd) < best[:2]:
                        best = (c, odd, got, chain)
            if best:
                first = best[3][0].split(" as ")
                runs = [(r, _undo_run(r.group(), first[1]) if first[0] == "utf-8" else next((_undo_run(r.group(), e) for e in _undoable(r.group())), "")) for r in _RUN.finditer(piece)]
                seen = [u is not None and is_example(piece, r.start(), r.end(), u, lang) for r, u in runs if u is not None]
                shown.append(bool(seen) and all(seen))
                keep = best[2]
        parts += [keep, gap]
    if shown and not all(shown):
        affected = True
    elif shown and not lost:
        return False, None
    original = "".join(parts)
    return affected, None if lost or not affected or "�" in original else original


def _dictionary(texts: list[str]) -> bytes:
    parts = [p.encode() for t in texts for p in _CUT.split(t) if len(p) > 8]
    size = sum(map(len, parts))
    if size > 4 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 2), parts, k=256, d=6).as_bytes()
        except zstandard.ZstdError:
            return b"\n".join(parts)[-DICTIONARY_BYTES:]
    return b"\n".join(parts)


def train_model(df: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries from at most `sample` distinct texts of each language without suspicious characters.

    Rows are counted by language, which reads no text; then one pass picks texts by their hash, so the sample is spread over the whole table and the
    same every time, and copies count once. Each dictionary is trained in a task; only dictionaries come to the driver.
    """
    rows = df.select(language_code(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(*LANGUAGES))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).collect()}  # a row for each language of the list
    if not sizes:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, -(-4 * sample * (1 << 20) // n)))])
    short, long = SAMPLED_LENGTHS
    picked = rows.where(F.length("text").between(short, long)).withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")])
    once = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def train(pdf):
        lang, own = pdf["lang"].iloc[0], []
        for text in pdf.sort_values("h")["text"]:
            if len(own) == sample:
                break
            if not suspicious(text, lang):
                own.append(text)
        return pd.DataFrame({"lang": [lang], "dictionary": [_dictionary(own)]})

    return Model({lang: bytes(raw) for lang, raw in sorted(once.groupBy("lang").applyInPandas(train, "lang string, dictionary binary").collect()) if raw})


def garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """`(id_col, restored)` of the affected rows; `restored` is null where characters were lost."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sent = df.sparkSession.sparkContext.broadcast(train_model(rows.select("text", "lang"), sample))  # a dictionary of fixed size for each language
    kind = df.schema[id_col].dataType.simpleString()

    def run(it):
        model = sent.value
        for batch in it:
            ids, fixed = [], []
            langs = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and not text.isascii():
                    hit, original = repair(text, langs[i], model)
                    if hit:
                        ids.append(i)
                        fixed.append(original)
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(fixed, pa.string())], [id_col, "restored"])

    coded = rows.select(id_col, "text", language_code(F.col("lang")).alias("lang"))
    return coded.mapInArrow(run, f"`{id_col}` {kind}, restored string")
