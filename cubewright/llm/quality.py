"""Line-first quality rules."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import Words, groups, map_arrow, mix, sized_batches

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
#: Words that stand between the entries of navigation bars; a line fails that has two of them or
#: more, and one for every five words.
SEPARATORS = ("|", "/", ">", "»", "›", "•", "·")
#: Phrases of pages' furniture, in the languages of the corpus; a short line that holds one fails.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "subscribe to our newsletter", "click here", "sign in to continue", "log in to continue", "share on facebook", "follow us on", "read more",
    "skip to content", "back to top", "lorem ipsum",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici",
    "lire la suite", "suivez-nous sur", "haut de page", "abonnez-vous à notre",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "weiterlesen", "folgen sie uns",
    "nach oben", "zum inhalt springen", "newsletter abonnieren",
    "todos los derechos reservados", "aceptar cookies", "política de cookies", "política de privacidad", "aviso legal", "condiciones de uso",
    "haga clic aquí", "leer más", "síguenos en", "volver arriba", "suscríbete a nuestro",
)
#: What a line may end with; a line of fewer than MIN_OPEN_WORDS words fails that ends otherwise.
TERMINAL = ".!?…:;\"'”’»›)]。！？：；"
MIN_OPEN_WORDS = 10
MAX_BOILERPLATE_WORDS = 30
MAX_SYMBOL_PCT = 10
MIN_LETTER_PCT = 50
MAX_LOST_PCT = 50

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())]

#: Texts are judged together up to so many bytes.
BATCH_BYTES = 8 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _endings(chars: str | tuple[str, ...]) -> list[list[bytes]]:
    """Characters by the length of their UTF-8 form, from 1 to 3 bytes."""
    forms = [c.encode() for c in chars]
    return [[f for f in forms if len(f) == n] for n in (1, 2, 3)]


def _ends_with(d: np.ndarray, end: np.ndarray, start: np.ndarray, chars: str | tuple[str, ...], whole: bool) -> np.ndarray:
    """Whether the spans [start, end) of bytes end with one of chars, or are one of them."""
    out = np.zeros(len(end), bool)
    for n, forms in enumerate(_endings(chars), 1):
        fits = np.flatnonzero(end - start == n if whole else end - start >= n)
        code = np.zeros(len(fits), np.int64)
        for j in range(n):
            code = code << 8 | d[end[fits] - n + j]
        out[fits] |= np.isin(code, [int.from_bytes(f, "big") for f in forms])
    return out


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _letters_before(d: np.ndarray) -> np.ndarray:
    """How many letters lie before each byte, and before the end."""
    first = (d & 0xC0) != 0x80
    points = np.frombuffer(d.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    is_letter = np.zeros(len(d) + 1, np.int64)
    is_letter[1:][first] = _letters()[points]
    return np.cumsum(is_letter)


class Lines:
    """The lines of a group of texts: byte limits, text, and which rules fail."""

    def __init__(self, w: Words):
        d, off = w.data, w.offsets
        cuts = np.flatnonzero(d == 10)
        self.start = np.sort(np.concatenate((off[:-1], cuts + 1)))
        self.end = np.sort(np.concatenate((cuts, off[1:])))
        self.doc = np.sort(np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, cuts, "right") - 1)))
        # A text's first line may begin where the empty texts before it end; words tell which is which.
        self.first = np.searchsorted(w.start, self.start)
        self.words = np.searchsorted(w.start, self.end) - self.first
        self.wordy = self.words > 0

    def failing(self, w: Words) -> np.ndarray:
        """Whether each line breaks a rule: line-final punctuation, symbols, letters, navigation, boilerplate."""
        d, words, wordy = w.data, self.words, self.wordy

        def held(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags)))
            return total[self.end] - total[self.start]

        chars = held(w.word & ((d & 0xC0) != 0x80))
        letters = _letters_before(d)
        bad = 100 * held(_SYMBOL[d]) > MAX_SYMBOL_PCT * chars
        bad |= 100 * (letters[self.end] - letters[self.start]) < MIN_LETTER_PCT * chars
        last = np.where(wordy, self.first + words - 1, 0)
        if len(w.start):
            bad |= (words < MIN_OPEN_WORDS) & ~_ends_with(d, w.end[last], w.start[last], TERMINAL, False)
            signs = np.concatenate(([0], np.cumsum(_ends_with(d, w.end, w.start, SEPARATORS, True))))
            signs = signs[self.first + words] - signs[self.first]
            bad |= (signs >= 2) & (5 * signs >= words)
        low = np.where((d >= 65) & (d <= 90), d + 32, d).astype(np.uint8).tobytes()
        found = []
        for p in BOILERPLATE:
            p = p.encode()
            at = low.find(p)
            while at >= 0:
                found.append((at, at + len(p)))
                at = low.find(p, at + len(p))
        for x, y in found:
            k = int(np.searchsorted(self.start, x, "right")) - 1
            bad[k] |= y <= self.end[k] and words[k] < MAX_BOILERPLATE_WORDS
        return bad & wordy


def _measure(texts: pa.Array, repeat_window: int, min_words: int, max_repeat_pct: int) -> list[pa.Array]:
    whole = texts.fill_null("") if texts.null_count else texts
    cols: list[list] = [[] for _ in FIELDS]
    for lo, w in groups(whole):
        n = len(w.offsets) - 1
        d, off = w.data, w.offsets
        count = w.word_counts()

        def per_text(flags: np.ndarray, off=off) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[off])

        chars = per_text(w.word & ((d & 0xC0) != 0x80))
        symbols = per_text(_SYMBOL[d])
        lines = Lines(w)
        doc = lines.doc[lines.wordy]
        lh = mix(w.span_hash(lines.start[lines.wordy], lines.end[lines.wordy]) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(lh, return_index=True)
        dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
        # Words in windows that a text holds twice or more.
        at, wdoc, wh = w.windows(repeat_window)
        key = mix(wh + wdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ks = key[order]
        same = np.zeros(len(ks), bool)
        if len(ks) > 1:
            eq = ks[1:] == ks[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        marked = np.zeros(len(w.doc) + repeat_window, bool)
        hits = at[order[same]]
        for j in range(repeat_window):
            marked[hits + j] = True
        repeats = np.bincount(w.doc[marked[: len(w.doc)]], minlength=n)
        failed = (count < min_words) | (100 * repeats > max_repeat_pct * count)
        bad = lines.failing(w)
        line_lo = np.searchsorted(lines.doc, np.arange(n + 1))
        clean, ok = [], ~failed
        touched = np.add.reduceat(np.append(bad, False), line_lo[:-1]) if n else []
        for i in range(n):
            text = whole[lo + i].as_py()
            if touched[i]:
                a = line_lo[i]
                left = "\n".join([x for k, x in enumerate(text.split("\n")) if not bad[a + k]])
                ok[i] &= 100 * (len(text) - len(left)) <= MAX_LOST_PCT * len(text)
                text = left
            clean.append(text)
        for c, v in zip(cols, (count, chars, symbols, dup_lines, repeats, failed, ok, clean), strict=True):
            c.extend(v)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
    return [pa.array(c, t) for c, t in zip(cols, types, strict=True)]


def quality_rules(
    df: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, with_text: bool = True, repeat_window: int = 3, min_words: int = 50, max_repeat_pct: int = 50
) -> DataFrame:
    """Judges each text line first, then as a whole.

    Each line with a word is held against five rules, and fails if it has fewer than ten words and
    doesn't end in one of TERMINAL (line-final punctuation); if over a tenth of its words' characters
    are SYMBOLS; if under half of them are letters of any script; if SEPARATORS are two of its words
    or more and one in five (navigation); or if it has fewer than 30 words and holds a phrase of
    BOILERPLATE, A-Z lower-cased. Failing lines go, and a document is kept unless it fails the base
    (fewer than min_words words, or 100 * n_repeat_words > max_repeat_pct * n_words) or loses over
    half of its characters with its failing lines.

    Returns keep_cols (default: all of df's columns) and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and, where with_text,
    clean_text: the lines that passed. Columns of these names are replaced. A null text counts
    as empty: no words, so it fails. Repeated rows are judged each by itself; an empty table
    gives an empty result.
    """
    fields = FIELDS if with_text else FIELDS[:-1]
    own = {f.name for f in FIELDS}
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c not in own]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(it, len(keep), BATCH_BYTES):
            out = _measure(b.column(b.num_columns - 1), repeat_window, min_words, max_repeat_pct)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + out[: len(fields)], [*keep, *[f.name for f in fields]])

    return map_arrow(df.select(*keep, F.col(text_col).alias("_quality_text")), run, schema)
