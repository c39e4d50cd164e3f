"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.llm.common import map_arrow, sized_batches, staged, unstage

#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "national_id", "secret", "name")
BASE = 4

# Base patterns. Each is asked only where it can begin, which gives the leftmost matches in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*$")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Looser candidates.
_LOOSE_DIGITS = re.compile(r"(?<![\w.@+(-])\(?[0-9](?:[ ().-]{0,2}[0-9]){7,18}(?![\w@])")
_NATIONAL = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|[A-Za-z0-9_/+-]{24,}={0,2})(?![A-Za-z0-9_/+=-])")
_LONG = re.compile(r"[A-Za-z0-9_/+-]{20}")
_AT = re.compile(r"(?<![\w.])[A-Za-z0-9._-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+", re.IGNORECASE)
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Don|Doña)\.? ((?:[A-ZÀ-Ý][\w'-]+)(?: [A-ZÀ-Ý][\w'-]+)?)")
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Don", "Doña")

# Gazetteers and contexts, as fixed values: first names that are frequent in the corpus's countries,
# names of streets' and months' kind that look like persons' but aren't, top-level domains, prefixes of keys.
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle "
    "Anna Peter Hans Greta Karl Ursula Klaus Monika Jürgen Petra Wolfgang Sabine Andreas Renate Stefan Helga Markus Karin Christian Brigitte "
    "Pierre Marie Jean Claire Luc Sophie Michel Nathalie Philippe Isabelle Alain Sylvie Patrick Catherine Nicolas Martine Laurent Christine Camille Julien "
    "Juan Carmen José Lucía Carlos Ana Luis Elena Antonio María Manuel Josefa Francisco Isabel Javier Dolores Miguel Pilar Rafael Teresa "
    "Maria Martin Alexander Laura Simon Julia Sebastian Eva Max Katharina Lucas Emma Leo Mia Hugo Alice Pablo Sofía Diego Paula".split()
)
NOT_NAMES = frozenset("Street Road Avenue January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro mobi app dev io ai co me tv cc eu de fr es uk us ca ch at it nl be lu pt ie dk se no fi pl cz sk hu ro bg gr tr ru ua "
    "cn jp kr in au nz br mx ar cl pe za eg il ae sa sg hk tw th vn id my ph".split()
)
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "ya29.", "eyJ")
CONTEXT = {
    0: "mail email e-mail mailto contact contacto write to correo courriel adresse address kontakt",
    1: "ip ipv4 host server address client login gateway dns ping from",
    2: "card visa mastercard amex credit debit karte kreditkarte carte bancaire tarjeta payment paid pay number",
    3: "phone call tel telephone fax mobile mobil handy telefon téléphone portable teléfono móvil cell contact",
    4: "ssn social security national id ausweis identité dni",
    5: "token key secret password passwd pwd api apikey credential bearer auth authorization access private",
    6: "name dear regards sincerely signed by hello bonjour hola lieber liebe cher chère estimado estimada",
}
COUNTER_CONTEXT = "version isbn order invoice page chapter total price sum commit sha md5 checksum hash digest doi issn figure table year"
_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_COUNTER = frozenset(COUNTER_CONTEXT.split())
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
LABELERS = ("shape", "checksum", "gazetteer", "context", "borders")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base's patterns, by kind and start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
            at = text.find("@", end)
        else:
            # A local part can't hold this sign, so none that comes later reaches over it.
            end = at + 1
            at = text.find("@", at + 1)
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _clear(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return all(end <= a or b <= start for _, a, b in spans)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base, none of which overlaps another."""
    out: list[tuple[int, int, int]] = []

    def add(kind: int, a: int, b: int) -> None:
        if _clear(base, a, b) and _clear(out, a, b):
            out.append((kind, a, b))

    has_digit = _DIGIT.search(text) is not None
    if has_digit:
        if "-" in text:
            for m in _NATIONAL.finditer(text):
                add(4, m.start(), m.end())
        for m in _LOOSE_DIGITS.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            if 10 <= n <= 12:
                add(3, m.start(), m.end())
            elif 13 <= n <= 19 and luhn("".join(_DIGIT.findall(m[0]))):
                add(2, m.start(), m.end())
    if has_digit and _LONG.search(text):
        for m in _SECRET.finditer(text):
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                add(5, m.start(), m.end())
    low = text if "(" in text or "[" in text else ""
    if low and _AT.search(text):
        for m in _AT.finditer(text):
            add(0, m.start(), m.end())
    if any(t in text for t in _TITLES):
        for m in _NAME.finditer(text):
            add(6, m.start(1), m.end(1))
    return out


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 abstains."""
    s = text[start:end]
    digits = "".join(_DIGIT.findall(s))
    shape = checksum = gazetteer = 0
    if kind == 0:
        shape = 1 if "@" in s else 0
        gazetteer = 1 if re.split(r"[.\])\s]", s)[-1].lower() in TOP_DOMAINS else -1
    elif kind == 1:
        parts = [int(x) for x in re.findall("[0-9]+", s)]
        shape = 1 if len(parts) == 4 and max(parts) <= 255 else -1
        gazetteer = -1 if parts[:1] == [0] or max(parts) < 10 else 1
    elif kind == 2:
        checksum = 1 if luhn(digits) else -1
        shape = 1 if len(digits) in (15, 16, 19) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == 3:
        shape = 1 if s[0] in "+(" or s.count("-") == 2 or s.count(".") == 2 else -1
        gazetteer = 1 if s[0] == "+" or digits[-10] in "23456789" else -1
    elif kind == 4:
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        shape = 1
    elif kind == 5:
        shape = 1 if len(set(s)) >= 10 and len(digits) * 10 >= len(s) else -1
        checksum = 1 if len(s) in (20, 32, 36, 40, 64) else 0
        gazetteer = 1 if s.startswith(KEY_PREFIXES) else 0
    else:
        shape = 1 if " " in s else 0
        gazetteer = 1 if s.split()[0] in FIRST_NAMES else -1 if NOT_NAMES.intersection(s.split()) else 0
    near = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-4:]}
    context = 1 if near & _CONTEXT[kind] else -1 if near & _COUNTER else 0
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    borders = 1 if (not before or before in " \n\t\"'(:=,;") and (not after or after in " \n\t\"').,;:!?") else -1
    return shape, checksum, gazetteer, context, borders


def _code(kind: int, v: tuple[int, ...], is_base: bool) -> int:
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out * 2 + is_base


def _decode(code: int) -> tuple[int, list[int], bool]:
    code, is_base = divmod(code, 2)
    v = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code, v[::-1], bool(is_base)


def fit_labelers(codes: dict[int, int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes over vote patterns and their counts, for each kind by itself.

    Returns P(vote | kind, class), shape (kind, 2, labeler, 3), and each kind's share of true ones.
    Labelers are taken to err independently. Ten pseudo-counts a labeler say that a vote is right
    four times in five, so that few candidates don't overturn them.
    """
    prior = np.zeros((2, len(LABELERS), 3))
    prior[1], prior[0] = (1.0, 3.0, 6.0), (5.0, 3.0, 2.0)
    like = np.repeat((prior / prior.sum(axis=2, keepdims=True))[None], len(KINDS), axis=0)
    share, j = np.full(len(KINDS), 0.5), np.arange(len(LABELERS))
    for kind in range(len(KINDS)):
        mine = {c: n for c, n in codes.items() if _decode(c)[0] == kind}
        if not mine:
            continue
        pattern = np.array([[x + 1 for x in _decode(c)[1]] for c in mine])
        weight = np.array(list(mine.values()), float)
        for _ in range(rounds):
            post = posterior(like[kind], share[kind], pattern)
            share[kind] = min(0.95, max(0.05, (weight @ post + 1) / (weight.sum() + 2)))
            for c, w in ((1, weight * post), (0, weight * (1 - post))):
                got = prior[c].copy()
                np.add.at(got, (j[None, :].repeat(len(pattern), 0), pattern), w[:, None].repeat(len(j), 1))
                like[kind, c] = got / got.sum(axis=1, keepdims=True)
    return like, share


def posterior(like: np.ndarray, share: float, pattern: np.ndarray) -> np.ndarray:
    """P(true) of one kind's vote patterns (votes plus 1)."""
    j = np.arange(len(LABELERS))
    p1, p0 = share * like[1][j, pattern].prod(axis=1), (1 - share) * like[0][j, pattern].prod(axis=1)
    return p1 / (p1 + p0)


#: Features are hashed into so many weights.
FEATURES = 1 << 12
#: The classifier is trained on at most so many candidates of each kind: of those whose hashes fall
#: into one of so many buckets, the one with the least hash.
SAMPLE = 2048


def features(text: str, kind: int, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: its kind, votes, characters, length and neighbours."""
    s = text[start:end]
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    shape = re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "_" if c.isspace() else c for c in s))
    before, after = _WORD.findall(left)[-2:], _WORD.findall(right)[:1]
    out = [f"vote {i} {v}" for i, v in enumerate(vote)]
    out += [f"length {min(len(s), 64).bit_length()}", f"shape {shape[:12]}", f"first {shape[:1]}", f"last {shape[-1:]}"]
    out += [f"digits {10 * sum(c.isdigit() for c in s) // len(s)}", f"kinds {min(len(set(s)), 40) // 4}"]
    out += [f"before {w.lower()}" for w in before] + [f"after {w.lower()}" for w in after] + [f"left {left[-1:]}", f"right {right[:1]}"]
    return [zlib.crc32(f"{kind} {f}".encode()) % FEATURES for f in ["bias", *out]]


def train_classifier(rows: list[list[int]], target: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 0.001) -> np.ndarray:
    """Weights of a logistic classifier of spans by their features, for soft labels."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r) for r in rows])
    seen = np.bincount(col, minlength=FEATURES)
    step = rate / np.sqrt(np.maximum(seen, 1) * len(rows) / 50)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(rows)), -30, 30)))
        w += step * (np.bincount(col, (target - p)[row], FEATURES) - decay * seen * w)
    return w


def _votes_of(text: str) -> list[tuple[int, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, of the base, votes) of each candidate."""
    base = base_spans(text)
    out = [(k, a, b, True, votes(text, k, a, b)) for k, a, b in base]
    return out + [(k, a, b, False, votes(text, k, a, b)) for k, a, b in loose_spans(text, base)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


#: Texts are searched together up to so many bytes.
BATCH_BYTES = 4 << 20


def fit_span_classifier(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The classifier's weights, from all candidates of df's texts.

    Tasks count vote patterns and keep, for each kind and bucket of hashes, the candidate of least
    hash. Counts (at most 14 * 3**5 rows) and the sample (SAMPLE rows a kind) are combined by key
    and go to the driver, whatever the input. There EM estimates the labelers' reliabilities for
    each kind, and the classifier is trained on the sample with the posteriors as soft labels.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        least: dict[tuple[int, int], tuple[int, int, list[int]]] = {}
        for b in sized_batches(it, 0, BATCH_BYTES):
            for t in b.column(0).to_pylist():
                for kind, x, y, is_base, vote in _votes_of(t) if t else ():
                    code = _code(kind, vote, is_base)
                    seen[code] = seen.get(code, 0) + 1
                    h = zlib.crc32(t[max(0, x - 40) : y + 40].encode(), x - max(0, x - 40))
                    slot = (kind, h % SAMPLE)
                    if slot not in least or h < least[slot][0]:
                        least[slot] = (h, code, features(t, kind, x, y, vote))
        n, m = len(seen), len(least)
        cols = [
            pa.array([-1] * n + [k for k, _ in least], pa.int32()),
            pa.array([*seen, *[s for _, s in least]], pa.int64()),
            pa.array([*seen.values(), *[0] * m], pa.int64()),
            pa.array([None] * n + [{"h": h, "code": c, "features": f} for h, c, f in least.values()], pa.struct([("h", pa.int64()), ("code", pa.int64()), ("features", pa.list_(pa.int32()))])),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["kind", "key", "n", "row"])

    schema = "kind int, key long, n long, row struct<h: long, code: long, features: array<int>>"
    parts = staged(map_arrow(df.select(F.col(text_col).alias("_t")), count, schema), "pii-candidates")
    whole = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("row").alias("row")).orderBy("kind", "key").collect()
    unstage(parts)
    like, share = fit_labelers({r["key"]: r["n"] for r in whole if r["kind"] < 0})
    sample = [r["row"] for r in whole if r["kind"] >= 0]
    target = np.array([posterior(like[k], share[k], np.array([v]) + 1)[0] for k, v, _ in (_decode(r["code"]) for r in sample)])
    return train_classifier([r["features"] for r in sample], target)


def _accepted(text: str, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, of the base) of a text's spans, by kind and start."""
    got = [(k, a, b, is_base) for k, a, b, is_base, vote in _votes_of(text) if is_base or weights[features(text, k, a, b, vote)].sum() > 0]
    return sorted(got)


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "spans", keep_cols: list[str] | None = None) -> DataFrame:
    """Adds spans_col: each text's spans of personal data, by kind and start, in code points.

    The base's patterns are candidates and always stay. Looser patterns propose more (cards only
    with a right check digit); regex, checksum, gazetteer, context and border labelers vote on
    every candidate of every text. Expectation-maximisation estimates their reliabilities for each
    kind, and a classifier over the spans' characters, lengths, neighbours and votes, trained on
    the posteriors, decides on the candidates beside the base. See fit_span_classifier.

    Keeps keep_cols (default: all columns); a column called spans_col is replaced. A null or
    empty text has no spans. Repeated rows are searched each; an empty table gives an empty
    result. df must give the same rows when it is read twice.
    """
    keep = [c for c in (df.columns if keep_cols is None else keep_cols) if c != spans_col]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(spans_col, SPANS)])
    weights = fit_span_classifier(df, text_col)

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(it, len(keep), BATCH_BYTES):
            out = []
            for t in b.column(len(keep)).to_pylist():
                out.append([{"kind": KINDS[k], "start": x, "end": y, "base": c} for k, x, y, c in (_accepted(t, weights) if t else ())])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(out, kind)], schema.names)

    return map_arrow(df.select(*keep, F.col(text_col).alias("_pii_text")), find, schema)


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """text with its spans replaced by their kinds in angle brackets; where spans overlap, by the first one's."""
    parts, end = [], 0
    for kind, x, y, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if x >= end:
            parts += [text[end:x], f"<{KINDS[kind]}>"]
        end = max(end, y)
    return "".join(parts) + text[end:]


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each span of find_pii in text_col replaced by its kind in angle brackets; where spans
    overlap, by the first one's. Null texts stay null; other columns stay as they are."""
    schema = T.StructType([df.schema[c] for c in df.columns])
    at = df.columns.index(text_col)
    weights = fit_span_classifier(df, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized_batches(it, at, BATCH_BYTES):
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                if t and (got := _accepted(t, weights)):
                    texts[i] = redact(t, got)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return map_arrow(df, run, schema)
