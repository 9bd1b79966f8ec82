"""Text garbled by a wrong character encoding: finding and restoring it.

A smoothed character trigram model is trained on all records without structural signs of garbling. Every candidate chain (the bytes of
one encoding read as another) is undone unit by unit; a unit's gain is the rise of its log-likelihood, and the stretch with the
largest summed gain is accepted if the gain passes a margin that was validated on clean records and on records garbled on purpose.
Undoing is repeated until no stretch passes the margin; each undoing raises the likelihood, so this ends. Characters lost for good (U+FFFD, control characters) have a
fixed, very low likelihood where nothing else explains them, so they are found by a gain like any other; one is replaced only where a letter is clearly likeliest.

Texts of a batch are scored together: code points as arrays, trigrams by a hash table, all chains on all improbable parts at once; the chains with the largest gains of a part are then worked out one by one.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, product
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.llm.bpe import spread
from reedbed.session import materialise

#: Margins that are compared.
MARGINS = np.arange(12, 61) / 2
#: Old text is never counted as less likely than this for each character, so that mere oddity is no proof of garbling.
FLOOR = -9.0
ALPHABET = 150_000
#: Log-probability that text in capitals gives away against the same text in small letters.
CAPITALS = 3.0
LOST = "\ufffd"
#: Log-likelihood of a character that only a decoder writes for what it cannot read.
LOST_LOG = -40.0
#: Chains whose gain lies this near the largest are worked out exactly.
CLOSE = 3.0
#: Characters around a stretch whose windows depend on it, with some to spare (windows end at gaps of more than nine).
REACH = 24
#: Results of parts that a task keeps for equal ones.
DONE_MAX = 200_000

#: Encodings whose UTF-8 misreadings are undone.
UTF8_READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "cp1254", "gbk")
#: Fixed values: (encoding of the bytes, encoding they were read as).
SWAPS = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp866", "cp1252"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("kz1048", "cp1252"), ("kz1048", "cp1251"), ("gbk", "cp1252"),
    ("cp1254", "cp1252"), ("cp1252", "cp1251"), ("cp1254", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "gbk"), ("cp1251", "gbk"),
)

#: Lost characters, and control characters that only a misreading leaves in a text (U+0085 is a line end).
LEFTOVER = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
WINDOW = re.compile(r"(?s).{0,4}[^\x00-\x7f](?:.{0,8}?[^\x00-\x7f])*.{0,4}")
#: Lead and continuation bytes of UTF-8 seen as Latin letters, control characters, box drawing and the like next to each other.
STRUCTURAL = re.compile(
    "[\x80-\x9f�-]"
    "|[ÂÃÐÑÄÅâãäåæçèéð][¡-¿€‚ƒ„-•…‰‹›™]"
    "|[├┬Γ╨╤]|[√¬][^\\sa-z0-9]|[РС][ЂЃЉ-Џђѓљ-џ°±»“”]|[¡-þ]{5}"
    "|[а-яё][А-ЯЁ]"  # a capital after a small letter: one Cyrillic encoding read as another
)
DASHES = re.compile(r"[–—][^\s\d](?:[–—][^\s\d]){2}")


def _byte_chars(encoding: str) -> dict[str, int]:
    """Character to byte (0x80 to 0xff). Bytes that the encoding leaves undefined also stand as their C1 control characters."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
        if encoding in ("cp1252", "cp1254", "cp1250", "cp1251"):
            table.setdefault(chr(b), b) if b < 0xA0 else None
    return table


def _undefined(encoding: str) -> list[int]:
    out = []
    for b in range(0x80, 0xC0):
        try:
            bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out.append(b)
    return out


Unit = tuple[str, list[str]]  # old text, candidates for the new text (first is the plain one)


@dataclass
class Chain:
    """Cuts a text into units and gives for each what it was before the bytes were misread."""

    name: str
    units: Callable[[str], list[Unit]]
    touches: frozenset[str]  # characters outside ASCII that a unit with a new text can hold
    fast: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None  # code points and rows to new ones and where each begins; none: units only
    holds: Callable[[str], bool] = lambda text: True  # whether units could find anything


_UTF8 = re.compile(r"[\xc2-\xdf][\x80-\xbfĀ]|[\xe0-\xef][\x80-\xbfĀ]{2}|[\xf0-\xf4][\x80-\xbfĀ]{3}")


class _Proxies(dict):
    """For str.translate: a character becomes the byte it stands for, a lost one a wild card, any other one outside ASCII a mark."""

    def __init__(self, read_as: str):
        super().__init__({ord(c): b for c, b in _byte_chars(read_as).items()})
        self[ord(LOST)] = 0x100

    def __missing__(self, code: int) -> int:
        return code if code < 0x80 else 0x101


def _utf8_chain(read_as: str) -> Chain:
    table = _Proxies(read_as)
    guesses = _undefined(read_as)

    def proxy(text: str) -> str:
        return text.translate(table)

    def units(text: str) -> list[Unit]:
        seen, out, end = proxy(text), [], 0
        for m in _UTF8.finditer(seen):
            raw = m.group()
            n = raw.count("Ā")
            options = []
            for fill in product(guesses, repeat=n) if n else [()]:
                it = iter(fill)
                try:
                    options.append(bytes(next(it) if c == "Ā" else ord(c) for c in raw).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
            if options:
                out += [(c, []) for c in text[end : m.start()]]
                out.append((text[m.start() : m.end()], options))
                end = m.end()
        return out + [(c, []) for c in text[end:]]

    return Chain(f"utf_8 read as {read_as}", units, frozenset(chr(c) for c in table), _utf8_fast(table), lambda text: _UTF8.search(proxy(text)) is not None)


def _utf8_fast(table: _Proxies) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    byte = np.full(0x10000, 0x101, dtype=np.int64)
    byte[:0x80] = np.arange(0x80)
    for code, b in table.items():
        byte[code] = b
    byte[ord(LOST)] = 0x101  # lost bytes are filled in by units only

    def undo(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 sequences among the bytes that the characters stand for become one character each."""
        pad = lambda a, fill: np.concatenate([a, np.full(3, fill)])
        b, r = pad(np.where(codes < 0x10000, byte[np.minimum(codes, 0xFFFF)], 0x101), 0x101), pad(rows, -1)
        n = len(codes)
        b0, b1, b2, b3 = (b[i : n + i] for i in range(4))
        follows = [(x >= 0x80) & (x < 0xC0) & (r[i : n + i] == rows) for i, x in ((1, b1), (2, b2), (3, b3))]
        two = (b0 >= 0xC2) & (b0 < 0xE0) & follows[0]
        three = (b0 >= 0xE0) & (b0 < 0xF0) & follows[0] & follows[1] & ~((b0 == 0xE0) & (b1 < 0xA0)) & ~((b0 == 0xED) & (b1 >= 0xA0))
        four = (b0 >= 0xF0) & (b0 < 0xF5) & follows[0] & follows[1] & follows[2] & ~((b0 == 0xF0) & (b1 < 0x90)) & ~((b0 == 0xF4) & (b1 >= 0x90))
        new = codes.copy()
        new = np.where(two, (b0 & 0x1F) << 6 | (b1 & 0x3F), new)
        new = np.where(three, (b0 & 0xF) << 12 | (b1 & 0x3F) << 6 | (b2 & 0x3F), new)
        new = np.where(four, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | (b3 & 0x3F), new)
        gone = np.zeros(n + 3, dtype=bool)
        for i, of in ((1, two | three | four), (2, three | four), (3, four)):
            gone[np.flatnonzero(of) + i] = True
        kept = np.flatnonzero(~gone[:n])
        return new[kept], kept

    return undo


def _multibyte_chain(read_as: str, was: str) -> Chain:
    """Text read as a two-byte encoding: whole stretches are taken back to bytes and decoded as they were."""

    def units(text: str) -> list[Unit]:
        out: list[Unit] = []
        for part in re.split(r"(\s+)", text):
            if not NON_ASCII.search(part):
                out += [(c, []) for c in part]
                continue
            raw, owner = bytearray(), []
            for i, c in enumerate(part):
                try:
                    b = c.encode(read_as)
                except UnicodeEncodeError:
                    b = b"\xff"  # undecodable in any case
                raw += b
                owner += [i] * len(b)
            new = raw.decode(was, "replace")
            if was != "utf_8":
                out.append((part, [new]))
                continue
            # Cut where characters of both readings end together.
            at, start, piece = 0, 0, ""
            for c in new:
                size = len(c.encode("utf-8")) if c != LOST else _bad_length(raw, at)
                at += size
                piece += c
                if at >= len(raw) or owner[at] != owner[at - 1]:
                    stop = owner[at - 1] + 1
                    old = part[start:stop]
                    out.append((old, [piece] if old != piece else []))
                    start, piece = stop, ""
            out += [(c, []) for c in part[start:]]
        return out

    return Chain(f"{was} read as {read_as}", units, _wide_chars(read_as))


def _wide_chars(encoding: str) -> frozenset[str]:
    """Ideographs that stand for two bytes: what other encodings look like when read two bytes at a time."""
    out = set()
    for high in range(0x81, 0xFF):
        for low in range(0x40, 0xFF):
            try:
                c = bytes([high, low]).decode(encoding)
            except UnicodeDecodeError:
                continue
            out.add(c) if len(c) == 1 and ord(c) >= 0x3400 else None
    return frozenset(out)


def _bad_length(raw: bytearray, at: int) -> int:
    """Bytes that one replacement character stands for."""
    try:
        bytes(raw[at : at + 4]).decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start == 0:
            return max(1, e.end)
    return 1


def _pairs_fast(chars: dict[str, int]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    byte = np.full(0x10000, -1, dtype=np.int64)
    byte[:0x80] = np.arange(0x80)
    for c, b in chars.items():
        byte[ord(c)] = b
    wide = np.full((0x100, 0x100), -1, dtype=np.int64)
    for high in range(0x81, 0xFF):
        for low in [*range(0x40, 0x7F), *range(0x80, 0xFF)]:
            try:
                wide[high, low] = ord(bytes([high, low]).decode("gbk"))
            except (UnicodeDecodeError, TypeError):
                continue

    def undo(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two-byte characters among the bytes that the characters stand for, paired from the left."""
        n = len(codes)
        b = np.append(np.where(codes < 0x10000, byte[np.minimum(codes, 0xFFFF)], -1), -1)
        first, second = b[:-1], np.where(np.append(rows[1:], -2) == rows, b[1:], -1)
        open_ = (first >= 0x81) & (first < 0xFF) & (second >= 0x40) & (second != 0x7F) & (second < 0xFF)
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(open_ & ~np.append(False, open_[:-1]), at, 0))  # of each run of possible pairs
        pair = open_ & ((at - begin) % 2 == 0)
        new = np.where(pair, wide[np.maximum(first, 0), np.maximum(second, 0)], -1)
        pair &= new >= 0
        gone = np.append(False, pair[:-1])
        kept = np.flatnonzero(~gone)
        return np.where(pair, new, codes)[kept], kept

    return undo


def _swap_chain(was: str, read_as: str) -> Chain:
    if read_as == "gbk":
        return _multibyte_chain("gbk", was)
    chars = _byte_chars(read_as)
    if was == "gbk":
        table = {ord(c): chr(b) for c, b in chars.items()}
        pair = re.compile(r"[\x81-\xfe][\x40-\x7e\x80-\xfe]")

        def units(text: str) -> list[Unit]:
            seen, out, end = "".join(table.get(ord(c), "ā") if ord(c) > 127 else c for c in text), [], 0
            for m in pair.finditer(seen):
                try:
                    new = m.group().encode("latin-1").decode("gbk")
                except UnicodeDecodeError:
                    continue
                out += [(c, []) for c in text[end : m.start()]]
                out.append((text[m.start() : m.end()], [new]))
                end = m.end()
            return out + [(c, []) for c in text[end:]]

        return Chain(f"gbk read as {read_as}", units, frozenset(chars), _pairs_fast(chars))
    single = {}
    for c, b in chars.items():
        try:
            new = bytes([b]).decode(was)
        except UnicodeDecodeError:
            continue
        if new != c:
            single[c] = [new]
    mapped = np.arange(0x10000)
    for c, (new,) in single.items():
        mapped[ord(c)] = ord(new)
    fast = lambda codes, rows: (np.where(codes < 0x10000, mapped[np.minimum(codes, 0xFFFF)], codes), np.arange(len(codes)))
    return Chain(f"{was} read as {read_as}", lambda text: [(c, single.get(c, [])) for c in text], frozenset(single), fast)


def _twice(chain: Chain) -> Chain:
    """The same misreading two times over, undone at once: the text between the two is no more likely than the garbled one."""

    def units(text: str) -> list[Unit]:
        first = [(old, new[0] if new else old) for old, new in chain.units(text)]
        second = chain.units("".join(new for _, new in first))
        if not any(new for _, new in second):
            return [(c, []) for c in text]
        out, i = [], 0
        for mid, new in second:
            old, held = "", 0
            while held < len(mid):
                old += first[i][0]
                held += len(first[i][1])
                i += 1
            out.append((old, new or ([mid] if mid != old else [])))
        return out

    def fast(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        once, kept = chain.fast(codes, rows)
        second = rows[kept]
        twice, again = chain.fast(once, second)
        moved = (twice != once[again]) | (np.diff(np.append(again, len(once))) > 1)
        both = np.isin(rows, np.unique(second[again][moved]))  # texts in which the second step finds something; the others stay as they are
        undone = both[kept[again]]
        new, at = np.concatenate([twice[undone], codes[~both]]), np.concatenate([kept[again][undone], np.flatnonzero(~both)])
        order = np.argsort(at, kind="stable")
        return new[order], at[order]

    return Chain(f"{chain.name}, twice", units, chain.touches, fast, chain.holds)


def chains() -> list[Chain]:
    utf8 = [_multibyte_chain(e, "utf_8") if e == "gbk" else _utf8_chain(e) for e in UTF8_READ_AS]
    return utf8 + [_twice(c) for c in utf8 if c.fast] + [_swap_chain(a, b) for a, b in SWAPS]


@dataclass
class Model:
    """Interpolated trigram model; probabilities are kept once computed."""

    grams: dict[str, int] | Counts
    context: dict[str, int] | Counts
    total: int
    known: dict[str, float] = field(default_factory=dict)
    fast: FastModel | None = None

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Model:
        """From packed n-grams; their tables are those of the FastModel."""
        fast = FastModel((keys, counts))
        return cls(Counts(fast, 0), Counts(fast, 1), fast.total, fast=fast)

    def logp(self, gram: str) -> float:
        """Log-probability of the last of three characters after the other two."""
        value = self.known.get(gram)
        if value is None:
            count, context = self.grams.get, self.context.get
            p1 = (count(gram[2], 0) + 0.05) / (self.total + 0.05 * ALPHABET)
            p2 = (count(gram[1:], 0) + 1.0 * p1) / (context(gram[1], 0) + 1.0)
            p3 = (count(gram, 0) + 1.0 * p2) / (context(gram[:2], 0) + 1.0)
            value = math.log(p3)
            low = gram.lower()
            if low != gram and len(low) == 3:  # capitals are rarer, not stranger
                value = max(value, self.logp(low) - CAPITALS)
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[gram] = value
        return value

    def each(self, text: str) -> list[float]:
        """Log-probability of every character from the third on (0 for the first two, which are context)."""
        known = self.known.get
        out = [known(text[i - 2 : i + 1]) for i in range(2, len(text))]
        if None in out:
            out = [self.logp(text[i : i + 3]) if x is None else x for i, x in enumerate(out)]
        return [0.0, 0.0, *out]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after another, and the text of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return codes, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def windows(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches around characters outside ASCII: at most eight others between two of them, and four on either side."""
    at = np.flatnonzero(codes > 127)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) > 9) | (np.diff(rows[at]) != 0))
    first, last = at[new], at[np.append(new[1:], True)]
    begin, end = np.maximum(first - 4, 0), np.minimum(last + 5, len(codes))
    starts = np.flatnonzero(np.append(True, np.diff(rows) != 0))
    stops = np.append(starts[1:], len(codes))
    own = np.searchsorted(starts, first, "right") - 1
    begin, end = np.maximum(begin, starts[own]), np.minimum(end, stops[own])
    begin[1:] = np.maximum(begin[1:], end[:-1])
    return begin, end


def gram_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair and each triple of consecutive code points as one number."""
    two = codes[:-1] << 21 | codes[1:]
    return two, codes[:-2] << 42 | two[1:]


def packed(gram: str) -> int:
    """An n-gram as one number: each code point plus one in 21 bits, so that shorter ones come first and those of one beginning lie together."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c) + 1
    return key


def unpacked(key: int) -> str:
    return (unpacked(key >> 21) if key >> 21 else "") + chr((key & 0x1FFFFF) - 1)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-grams around characters outside ASCII (packed), and how often each occurs."""
    codes, rows = code_points(texts)
    begin, end = windows(codes, rows)
    # Windows one after another with a zero between them, which no code point plus one is.
    size = end - begin
    place = np.cumsum(size + 1) - size - 1
    line = np.zeros(int((size + 1).sum()), dtype=np.int64)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[np.repeat(place, size) + at] = codes[np.repeat(begin, size) + at] + 1
    two, three = gram_keys(line)
    one = line > 0
    both = one[:-1] & one[1:]
    said = pd.Series(np.concatenate([line[one], two[both], three[both[:-1] & one[2:]]])).value_counts(sort=False)
    return said.index.to_numpy(np.int64), said.to_numpy(np.int64)


def count_grams(texts: list[str], counts: Counter) -> None:
    """Adds gram_counts of texts."""
    for key, n in zip(*(a.tolist() for a in gram_counts(texts)), strict=True):
        counts[unpacked(key)] += n


_RUNS = re.compile(r"[^\x00-\x7f]+[\x00-\x7f]?")
#: Readings under which clean text of the usual languages hardly ever looks like UTF-8.
_TELLING = [_Proxies(e) for e in ("cp1252", "cp437", "cp850", "cp1251", "cp1250")]
for _letter in "іІїЇєЄґҐёЁўЎјЈ":  # letters of Cyrillic alphabets among the continuation bytes
    _TELLING[3].pop(ord(_letter), None)


def is_plain(text: str) -> bool:
    """No structural sign of garbling, and no run of characters that are valid UTF-8 in another reading: fit for training."""
    return DASHES.search(text) is None and all(map(_run_is_plain, set(_RUNS.findall(text))))


@lru_cache(maxsize=200_000)
def _run_is_plain(run: str) -> bool:
    """For a run of characters outside ASCII and the one behind it: all signs but dashes lie within these."""
    return STRUCTURAL.search(run) is None and not (len(run) > 1 and any(_UTF8.search(run.translate(t)) for t in _TELLING))


def train(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All n-grams (packed, ascending) of all records without structural signs, and their counts: 16 bytes for each different n-gram."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = [v for v in pdf["t"] if v and NON_ASCII.search(v) and is_plain(v)]
            for own in _by_size(plain, 8_000_000):
                yield pd.DataFrame(dict(zip(("gram", "n"), gram_counts([plain[i] for i in own]), strict=True)))

    kept = documents.select(F.col(text).alias("t")).mapInPandas(work, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    keys, counts = kept["gram"].to_numpy(np.int64), kept["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


class FastModel:
    """The probabilities of Model for whole arrays of code points: counts of pairs and triples in hash tables, those of single characters in arrays.

    Made from packed n-grams (ascending) and their counts, or from a Model of dictionaries."""

    def __init__(self, model: Model | tuple[np.ndarray, np.ndarray]):
        if isinstance(model, Model):
            said = sorted((packed(g), n) for g, n in model.grams.items())
            model = np.array([k for k, _ in said], dtype=np.int64), np.array([n for _, n in said], dtype=np.int64)
        self.keys, counts = model
        ends = np.searchsorted(self.keys, [1 << 21, 1 << 42])
        (one, two, three), (n1, n2, n3) = np.split(self.keys, ends), np.split(counts, ends)
        self.total = int(n1.sum())
        self.single, self.after = np.zeros(0x110000), np.zeros(0x110000)
        self.single[one - 1] = n1
        before, n = _sums(two >> 21, n2)
        self.after[before - 1] = n
        before, n = _sums(three >> 21, n3)
        pairs = np.union1d(two, before)
        values = np.zeros((len(pairs), 2))  # occurrences, and those with a character behind
        values[np.searchsorted(pairs, two), 0] = n2
        values[np.searchsorted(pairs, before), 1] = n
        self.pairs = _Hash(pairs - (1 << 21 | 1), values)
        self.triples = _Hash(three - (1 << 42 | 1 << 21 | 1), n3.astype(np.float64).reshape(-1, 1))
        self.low = np.arange(0x110000)
        for code in range(0x10000):
            small = chr(code).lower() if not 0xD800 <= code < 0xE000 else ""
            if len(small) == 1:
                self.low[code] = ord(small)

    def following(self, context: str) -> list[str]:
        """Characters outside ASCII seen after one or two others; all of them for an empty context."""
        begin, end = np.searchsorted(self.keys, [packed(context) << 21, packed(context) + 1 << 21])
        return [c for c in map(chr, (self.keys[begin:end] & 0x1FFFFF) - 1) if ord(c) > 127 and not LEFTOVER.match(c)]

    def _log(self, codes: np.ndarray) -> np.ndarray:
        two, three = gram_keys(codes)
        pair = self.pairs.get(two)
        p1 = (self.single[codes[2:]] + 0.05) / (self.total + 0.05 * ALPHABET)
        p2 = (pair[1:, 0] + p1) / (self.after[codes[1:-1]] + 1.0)
        return np.log((self.triples.get(three)[:, 0] + p2) / (pair[:-1, 1] + 1.0))

    def each(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of every character from the third on (0 for the first two, which are context)."""
        out = np.zeros(len(codes))
        if len(codes) < 3:
            return out
        out[2:] = self._log(codes)
        low = self.low[codes]
        differs = low != codes
        differs = np.flatnonzero(differs[2:] | differs[1:-1] | differs[:-2]) + 2
        if len(differs):  # capitals are rarer, not stranger
            three = np.stack([low[differs - 2], low[differs - 1], low[differs]], axis=1).ravel()
            out[differs] = np.maximum(out[differs], self._log(three)[::3] - CAPITALS)
        return out


class Counts:
    """Counts of single n-grams, or (column 1) of their occurrences with a character behind, out of the tables of a FastModel."""

    def __init__(self, fast: FastModel, column: int):
        self.fast, self.column = fast, column

    def get(self, gram: str, default: int = 0) -> float:
        if len(gram) == 1:
            return (self.fast.after if self.column else self.fast.single).item(ord(gram))
        if len(gram) == 2:
            return self.fast.pairs.one(ord(gram[0]) << 21 | ord(gram[1]), self.column, default)
        return self.fast.triples.one(ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2]), 0, default)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys (ascending) and the sum of the values of each."""
    different, first = np.unique(keys, return_index=True)
    return different, np.add.reduceat(values, first) if len(first) else values


class _Hash:
    """Rows of numbers by whole-number keys: open addressing with whole arrays; absent keys give zeros."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros((1 << self.bits, values.shape[1]))
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several for one slot the last stays
            own = self.keys[at] == keys[todo]
            self.values[at[own]] = values[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def one(self, key: int, column: int, default: float) -> float:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (held := self.keys.item(at)) != key:
            if held == -1:
                return default
            at = at + 1 & (1 << self.bits) - 1
        return self.values.item(at, column)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out, held = self.values[at], self.keys[at]
        wrong = np.flatnonzero(held != keys)
        out[wrong] = 0.0
        wrong = wrong[held[wrong] != -1]
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[wrong]
            out[wrong[hit]] = self.values[at[hit]]
            going = ~hit & (held != -1)
            wrong, at = wrong[going], at[going]
        return out


@dataclass
class Part:
    """The improbable part of a window: the text before it that serves as context, and the characters to be undone."""

    text: int
    begin: int
    end: int
    before: str
    part: str
    low: int  # its window
    high: int


Edit = tuple[int, int, str, float, str]  # begin, end, new text, gain, chain


@dataclass
class Restored:
    text: str
    chains: list[str]
    gain: float
    lost: int = 0


class Restorer:
    """Scores every chain on the improbable parts of texts."""

    def __init__(self, model: Model, margin: float):
        self.model, self.fast, self.margin, self.chains = model, model.fast or FastModel(model), margin, chains()
        self.by_name = {c.name: c for c in self.chains}
        self.all_letters = self.fast.following("")
        self.guessed: dict[tuple[str, str, str], tuple[float, str, bool]] = {}
        self.done: dict[tuple[str, str], tuple[float, str, str]] = {}  # results, which follow from the part alone
        self.touch = np.zeros((len(self.chains), 0x10000), dtype=bool)
        for i, chain in enumerate(self.chains):
            self.touch[i, [ord(c) for c in chain.touches if ord(c) < 0x10000]] = True

    def parts(self, texts: list[str]) -> list[Part]:
        """Improbable parts of the windows of texts."""
        codes, rows = code_points(texts)
        begin, end = windows(codes, rows)
        if not len(begin):
            return []
        # Only windows are scored, each after two blanks.
        size = end - begin
        stop = np.cumsum(size + 2)
        line = np.full(int(stop[-1]), 32, dtype=np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(stop - size, size) + at
        line[place] = codes[np.repeat(begin, size) + at]
        logs = np.zeros(len(line))
        logs[place] = self.fast.each(line)[place]
        short, starts = np.where(logs < -6.0, -6.0 - logs, 0.0), stop - size - 2
        sums = np.add.reduceat(short, starts)
        place = np.arange(len(line))
        head = np.minimum.reduceat(np.where(short > 0, place, len(line)), starts) - (stop - size)
        tail = np.maximum.reduceat(np.where(short > 0, place, -1), starts) - (stop - size)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        odd = np.flatnonzero(sums >= 4.0)
        of = rows[begin[odd]]
        base = begin[odd] - first[of]
        lows, highs = base + np.maximum(head[odd] - 8, 0), base + np.minimum(tail[odd] + 9, size[odd])
        context = np.maximum(lows - 2, base)
        out = []
        for t, c, a, z, low, high in zip(*(x.tolist() for x in (of, context, lows, highs, base, base + size[odd])), strict=True):
            text = texts[t]
            out.append(Part(t, a, z, text[c:a].rjust(2), text[a:z], low, high))
        return out

    def gains(self, parts: list[Part]) -> np.ndarray:
        """Gain (parts x chains) of the best stretch of each part by prefix sums; 0 if a chain changes nothing, NaN for chains that can be worked out by units only."""
        out = np.zeros((len(parts), len(self.chains)))
        if not parts:
            return out
        codes, rows = code_points([p.before + p.part for p in parts])
        starts = np.flatnonzero(np.append(True, np.diff(rows) != 0))
        context = np.zeros(len(codes), dtype=bool)
        context[starts] = context[starts + 1] = True
        old = np.where(context, 0.0, np.maximum(FLOOR, self.fast.each(codes)))
        small = np.minimum(codes, 0xFFFF)
        for c, chain in enumerate(self.chains):
            touched = self.touch[c][small] & ~context & (codes < 0x10000)
            hit = np.zeros(len(parts), dtype=bool)
            hit[rows[touched]] = True
            if chain.fast is None:
                out[hit, c] = np.nan
                continue
            lost = np.zeros(len(parts), dtype=bool)
            if chain.name.startswith("utf_8"):
                lost[rows[codes == ord(LOST)]] = True
                out[hit & lost, c] = np.nan
            use = (hit & ~lost)[rows]
            if not use.any():
                continue
            own, of, head, before = codes[use], rows[use], context[use], old[use]
            plain = np.where(head, -1, of)  # the context is not undone
            new, kept = chain.fast(own, plain)
            new = np.where(head[kept], own[kept], new)
            changed = np.zeros(len(parts), dtype=bool)
            changed[of[kept][(new != own[kept]) | (np.diff(np.append(kept, len(own))) > 1)]] = True
            left = changed[of[kept]]
            if left.any():
                sums = np.add.reduceat(before, kept)[left]
                new, head, of = new[left], head[kept][left], of[kept][left]
                out[changed, c] = _best_stretch(np.where(head, 0.0, self.fast.each(new)) - sums, of, len(parts))[changed]
        return out

    def _floor(self, logs: list[float]) -> list[float]:
        return [max(FLOOR, x) for x in logs]

    def _undo(self, chain: Chain, before: str, part: str, old_sums: list[float]) -> tuple[float, str] | None:
        """Largest gain of a stretch of the part (after two characters of context), and the part with that stretch undone."""
        units = chain.units(part)
        texts, ends = [], []
        at, changed = 0, False
        for old, options in units:
            at += len(old)
            ends.append(at)
            if not options:
                texts.append(old)
                continue
            changed = True
            if len(options) > 1:
                context = (before + "".join(texts[-2:]))[-2:]
                options = [max(options, key=lambda new: sum(self.model.each(context + new)))]  # noqa: B023
            texts.append(options[0])
        if not changed:
            return None
        sums = list(accumulate(self.model.each(before + "".join(texts)), initial=0.0))
        # The stretch of units with the largest sum of new less old log-likelihood.
        top, span, start, low, size = 0.0, None, 0, 0.0, 2
        for i, end in enumerate(ends):
            size += len(texts[i])
            rise = sums[size] - old_sums[end + 2]
            if rise - low > top:
                top, span = rise - low, (start, i + 1)
            if rise < low:
                low, start = rise, i + 1
        if span is None:
            return None
        a, b = span
        head, inner = "".join(u[0] for u in units[:a]), "".join(texts[a:b])
        new = head + inner + "".join(u[0] for u in units[b:])
        if new == part:
            return None
        # The gain in its real surroundings; it raises the floored likelihood of the part, so undoing cannot go in circles.
        logs, start = self.model.each(before + new), len(before) + len(head)
        stop = start + len(inner)
        value = sum(self._floor(logs[:start])) + sum(logs[start:stop]) + sum(self._floor(logs[stop:]))
        gain = value - old_sums[-1]
        return (gain, new) if gain > 0 else None

    def best(self, parts: list[Part]) -> list[tuple[float, str, str]]:
        """Gain, new part and chain of the likeliest single undoing of each part; gain 0 if none reaches about MARGINS[0]. Equal parts are worked out once."""
        keys = [(p.before, p.part) for p in parts]
        new = {k: p for k, p in zip(keys, parts, strict=True) if k not in self.done}
        for k, found in zip(new, self._best(list(new.values())), strict=True):
            self.done[k] = found
        out = [self.done[k] for k in keys]
        if len(self.done) > DONE_MAX:
            self.done.clear()
        return out

    def _best(self, parts: list[Part]) -> list[tuple[float, str, str]]:
        scores = self.gains(parts)
        units_only = np.isnan(scores)
        top = np.where(units_only, 0.0, scores).max(axis=1, initial=0.0)
        tried = units_only | ((scores > 0) & (scores >= top[:, None] - CLOSE) & (scores >= MARGINS[0] - CLOSE))
        out = [(0.0, p.part, "") for p in parts]
        for i in np.flatnonzero(tried.any(axis=1)):
            p = parts[i]
            old_sums = list(accumulate(self._floor(self.model.each(p.before + p.part)), initial=0.0))
            for c in np.flatnonzero(tried[i]):
                if units_only[i, c] and not self.chains[c].holds(p.part):
                    continue
                done = self._undo(self.chains[c], p.before, p.part, old_sums)
                if done and done[0] > out[i][0]:
                    out[i] = (*done, self.chains[c].name)
        return out

    def first(self, texts: list[str], near: list[list[tuple[int, int]]] | None = None) -> list[list[Edit]]:
        """Parts of each text with a gain of at least MARGINS[0], and what they become by one undoing; if ``near`` gives stretches (ascending), only parts whose windows can have changed by these."""
        out: list[list[Edit]] = [[] for _ in texts]
        parts = self.parts(texts)
        if near is not None:
            kept = []
            for p in parts:
                spans = near[p.text]
                i = bisect_right(spans, p.low - REACH, key=itemgetter(1))
                if i < len(spans) and spans[i][0] < p.high + REACH:
                    kept.append(p)
            parts = kept
        for p, (gain, new, name) in zip(parts, self.best(parts), strict=True):
            if gain >= MARGINS[0]:
                out[p.text].append((p.begin, p.end, new, gain, name))
        return out

    def top_gains_of_made(self, made: list[tuple[str, str]], enough: float) -> np.ndarray:
        """Largest gain of any part of texts garbled in a known way. Where undoing just that way reaches ``enough``, this gain is given, so no other chain need be tried."""
        parts = self.parts([t for t, _ in made])
        out = np.zeros(len(made))
        for p in parts:
            if out[p.text] >= enough:
                continue
            found = self.done.get((p.before, p.part))
            if found is None:
                old_sums = list(accumulate(self._floor(self.model.each(p.before + p.part)), initial=0.0))
                found = self._undo(self.by_name[made[p.text][1].replace("latin_1", "cp1252")], p.before, p.part, old_sums)
            if found:
                out[p.text] = max(out[p.text], found[0])
        open_ = [p for p in parts if out[p.text] < enough]
        for p, (gain, _, _) in zip(open_, self.best(open_), strict=True):
            out[p.text] = max(out[p.text], gain)
        return out

    def restore(self, texts: list[str], first: list[list[Edit]] | None = None) -> list[Restored]:
        """Every text with all stretches undone that pass the margin, one of each window at a time, until there is none. What ``first`` gives may be known already."""
        out = [Restored(t, [], 0.0) for t in texts]
        open_ = list(range(len(texts)))
        near: list[list[tuple[int, int]]] | None = None
        while open_:
            found, first = first or self.first([out[i].text for i in open_], near), None
            changes: dict[int, list[tuple[int, int, str]]] = {}
            for i, edits in zip(open_, found, strict=True):
                for begin, end, new, gain, name in edits:
                    if gain >= self.margin:
                        out[i].gain += gain
                        out[i].chains.append(name)
                        changes.setdefault(i, []).append((begin, end, new))
            open_, near = sorted(changes), []
            for i in open_:
                text, end, pieces, size, spans = out[i].text, 0, [], 0, []
                for b, e, new in sorted(changes[i]):
                    pieces += [text[end:b], new]
                    size += b - end + len(new)
                    spans.append((size - len(new), size))
                    end = e
                out[i].text = "".join(pieces) + text[end:]
                near.append(spans)  # what lies elsewhere has been looked at
        for r in out:
            if LEFTOVER.search(r.text):
                self._lost(r)
            r.chains = list(dict.fromkeys(r.chains))
        return out

    def _letters(self, context: str) -> list[str]:
        """Characters outside ASCII that the model has seen after a context or after its last character, else all of them."""
        some = {*self.fast.following(context), *self.fast.following(context[1:])}
        return list(some) if len(some) > 1 else self.all_letters

    def _lost(self, r: Restored) -> None:
        """Lost characters: the rise in likelihood if the likeliest one stood there is a gain like any other; it is written only where it is clearly likeliest."""
        out = list(r.text)
        for i, c in enumerate(r.text):
            if not LEFTOVER.match(c):
                continue
            before, behind = "".join(out[max(0, i - 2) : i]).rjust(2), "".join(out[i + 1 : i + 3])
            gain, best, clear = self._guess(before, c, behind)
            if gain >= self.margin:
                r.chains.append("lost character")
                r.gain += gain
            if clear:
                out[i] = best
            else:
                r.lost += 1
        r.text = "".join(out)

    def _guess(self, before: str, c: str, behind: str) -> tuple[float, str, bool]:
        """Gain of the likeliest character in place of a lost one, that character, and whether it is clearly likeliest."""
        found = self.guessed.get((before, c, behind))
        if found is None:
            logp = self.model.logp
            letters = np.array([ord(x) for x in self._letters(before)], dtype=np.int64)
            lines = np.tile(code_points([before + c + behind])[0], (len(letters), 1))
            lines[:, 2] = letters
            logs = self.fast.each(lines.ravel()).reshape(lines.shape)[:, 2:].sum(axis=1)
            scored = [(float(logs[i]), chr(letters[i])) for i in np.lexsort((letters, logs))[::-1][:2]]
            now = LOST_LOG + sum(self._floor([logp((before + c + behind)[k : k + 3]) for k in range(1, len(behind) + 1)]))
            gain = (scored[0][0] if scored else FLOOR * (len(behind) + 1)) - now
            alone = not (LEFTOVER.search(before) or LEFTOVER.match(behind[:1]))
            clear = alone and len(scored) == 2 and scored[0][0] - scored[1][0] >= 1.5 and scored[0][0] > -14
            found = (gain, scored[0][1] if scored else c, bool(clear))
            if len(self.guessed) > DONE_MAX:
                self.guessed.clear()
            self.guessed[before, c, behind] = found
        return found


def _best_stretch(rise: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Largest sum of consecutive values of each row (rows ascending); at least 0."""
    sums = np.cumsum(rise)
    first = np.flatnonzero(np.append(True, np.diff(rows) != 0))
    length = np.diff(np.append(first, len(rows)))
    out = np.zeros(n)
    order = np.argsort(length, kind="stable")
    cells = 4_000_000
    at = 0
    while at < len(order):  # rows of like length side by side
        longest = int(length[order[at]])
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * int(length[order[stop]]) <= cells and int(length[order[stop]]) <= 2 * longest + 16:
            stop += 1
        pick = order[at:stop]
        width = int(length[pick].max())
        place = first[pick][:, None] + np.minimum(np.arange(width), length[pick][:, None] - 1)
        s = sums[place] - (sums[first[pick]] - rise[first[pick]])[:, None]
        low = np.minimum(np.minimum.accumulate(np.concatenate([np.zeros((len(pick), 1)), s[:, :-1]], axis=1), axis=1), 0.0)
        out[rows[first[pick]]] = np.maximum((s - low).max(axis=1), 0.0)
        at = stop
    return out


def garbled(text: str, was: str, read_as: str, start: int, stop: int) -> str:
    """The stretch as it looks when its bytes are read in another encoding; what cannot be encoded or decoded is lost."""
    return text[:start] + text[start:stop].encode(was, "replace").decode(read_as, "replace") + text[stop:]


#: Ways in which clean records are garbled to validate the margin and to measure what is regained.
WAYS = [("utf_8", e) for e in ("cp1252", "latin_1", "cp437", "mac_roman", "cp1251", "gbk")] + [("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("gbk", "cp1252"), ("cp1254", "cp1252")]


def garbled_on_purpose(text: str, number: int) -> tuple[str, str] | None:
    """A record with one stretch misread and the way it was, way and length following from ``number``; None if that changes or loses something else."""
    pairs = WAYS
    start = NON_ASCII.search(text).start()
    stop = start + 20 + number % 180
    was, read_as = pairs[number % len(pairs)]
    try:
        text[start:stop].encode(was)
    except UnicodeEncodeError:
        was, read_as = pairs[number % 6]
    made = garbled(text, was, read_as, start, stop)
    return (made, f"{was} read as {read_as}") if made != text and LOST not in made else None


def margins_reached(gains: np.ndarray) -> np.ndarray:
    """Number of gains that reach none, one, two ... of the margins."""
    return np.bincount(np.searchsorted(MARGINS, gains, "right"), minlength=len(MARGINS) + 1)


def margin_of_counts(clean: np.ndarray, dirty: np.ndarray) -> float:
    """The margin with the best hit rate less twenty times the false-alarm rate; of equally good ones the smallest."""
    clean, dirty = (np.cumsum(n[::-1])[::-1] for n in (clean, dirty))
    return float(MARGINS[np.argmax(dirty[1:] / max(1, dirty[0]) - 20 * (clean[1:] / max(1, clean[0])))])


def chosen_margin(clean: list[float], dirty: list[float]) -> float:
    """margin_of_counts of gains."""
    return margin_of_counts(margins_reached(np.array(clean)), margins_reached(np.array(dirty)))


def _scored(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """Two sorts of rows: records (doc, t) that are garbled by the smallest margin or hold leftovers, with their largest gain and first edits;
    and numbers n of clean records, as they are and garbled on purpose (made), by the number of margins that their gain reaches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = Restorer(Model.of(*shared.value), MARGINS[0])
        counts = np.zeros((2, len(MARGINS) + 1), dtype=np.int64)
        for pdf in batches:
            pdf = pdf[[bool(t) and NON_ASCII.search(t) is not None for t in pdf["t"]]]
            for own in _by_size(pdf["t"].tolist()):
                some = pdf.iloc[own]
                texts = some["t"].tolist()
                edits = probe.first(texts)
                gains = np.array([max((gain for *_, gain, _ in e), default=0.0) for e in edits])
                plain = [LOST not in t and is_plain(t) for t in texts]
                made = [m for t, h, p in zip(texts, some["h"], plain, strict=True) if p and (m := garbled_on_purpose(t, abs(int(h))))]
                counts[0] += margins_reached(gains[plain])
                counts[1] += margins_reached(probe.top_gains_of_made(made, MARGINS[-1]))
                kept = (gains >= MARGINS[0]) | [LEFTOVER.search(t) is not None for t in texts]
                yield pd.DataFrame({"doc": some["doc"][kept], "t": some["t"][kept], "gain": gains[kept], "edits": [json.dumps(e) for e, k in zip(edits, kept, strict=True) if k], "made": None, "reached": None, "n": None}).astype({"t": object, "edits": object})
        made, reached = np.indices(counts.shape)
        yield pd.DataFrame({"doc": None, "t": None, "gain": None, "edits": None, "made": made.ravel() == 1, "reached": reached.ravel(), "n": counts.ravel()})

    return rows.select("doc", "t", F.xxhash64("t").alias("h")).mapInPandas(work, "doc bigint, t string, gain double, edits string, made boolean, reached int, n bigint")


def _trained(rows: DataFrame) -> tuple[Broadcast, float, DataFrame]:
    """The model of all records (column t), its margin, validated on all clean records, and the records (doc, t, edits) that pass the margin or hold leftovers."""
    shared = rows.sparkSession.sparkContext.broadcast(train(rows, "t"))
    scored = materialise(_scored(rows, shared), "garble")
    counts = np.zeros((2, len(MARGINS) + 1), dtype=np.int64)
    for r in scored.where("n > 0").groupBy("made", "reached").agg(F.sum("n").alias("n")).collect():
        counts[int(r.made), r.reached] = r.n
    margin = margin_of_counts(*counts)
    return shared, margin, scored.where(F.col("n").isNull() & ((F.col("gain") >= margin) | F.col("t").rlike(LEFTOVER.pattern))).select("doc", "t", "edits")


def regained(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """way, n, found, exact: all clean records, each garbled in one stretch on purpose; how many are found and how many come back exactly as they were.

    A measure of the operator on known originals; records with structural signs of garbling are left out.
    """
    rows = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")))
    shared, margin, _ = _trained(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(Model.of(*shared.value), margin)
        for pdf in batches:
            plain = [t for t in pdf["t"] if t and NON_ASCII.search(t) and is_plain(t)]
            for own in _by_size(plain):
                made = [(plain[i], *m) for i in own if (m := garbled_on_purpose(plain[i], zlib.crc32(plain[i].encode("utf-8", "surrogatepass"))))]
                got = restorer.restore([m for _, m, _ in made])
                yield pd.DataFrame({"way": [w for _, _, w in made], "found": [bool(r.chains) for r in got], "exact": [r.text == t for r, (t, _, _) in zip(got, made, strict=True)]}).astype({"way": object, "found": bool, "exact": bool})

    said = rows.select("t").mapInPandas(work, "way string, found boolean, exact boolean")
    return said.groupBy("way").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("int")).alias("found"), F.avg(F.col("exact").cast("int")).alias("exact"))


def find_garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Records with at least one garbled stretch: doc_id, restored (text as far as it can be regained), chains (array), gain, lost
    (number of characters that stay lost).

    Every row is judged over its whole text, by gains of likelihood alone. A null, empty or pure-ASCII text is never garbled. Repeated
    rows are judged each for itself. An empty table gives no rows. The model counts all records, and the margin is validated on all clean
    ones; records whose first gains stay below it are not looked at again.
    """
    rows = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("t")))
    shared, margin, open_ = _trained(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(Model.of(*shared.value), margin)
        for pdf in batches:
            for own in _by_size(pdf["t"].tolist()):
                out = [(doc, r.text, r.chains, r.gain, r.lost) for doc, r in zip(pdf["doc"].iloc[own], restorer.restore(pdf["t"].iloc[own].tolist(), [json.loads(e) for e in pdf["edits"].iloc[own]]), strict=True) if r.chains]
                yield pd.DataFrame(out, columns=[doc_id, "restored", "chains", "gain", "lost"])

    return spread(open_).mapInPandas(work, f"{doc_id} bigint, restored string, chains array<string>, gain double, lost int")


def _by_size(texts: list[str], characters: int = 1_000_000) -> Iterator[list[int]]:
    """Numbers of texts in runs of about so many characters."""
    own, size = [], 0
    for i, t in enumerate(texts):
        own.append(i)
        size += len(t)
        if size >= characters:
            yield own
            own, size = [], 0
    if own:
        yield own
