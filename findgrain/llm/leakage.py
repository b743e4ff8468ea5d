"""Held-out items that leak into a corpus, found by windows of canonical templates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrain.session import spread, through_table

WINDOW = 13
#: Characters a task looks at together; longer texts go through in overlapping pieces.
SLICE_CHARS = 400_000
#: Words that a piece repeats of the one before.
OVERLAP = 200
#: Item windows up to which the join may broadcast them; above, both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Bits of the filter of item hashes: so many a hash, within these bounds (64 MB at most).
FILTER_RATE, FILTER_LEAST, FILTER_MOST = 1024, 1 << 20, 1 << 29

NUMBER, UNIT, NAME = 1, 2, 3
SLOT = {NUMBER: "#", UNIT: "%", NAME: "@"}

# Words that are units where they follow a number.
UNITS = (
    "ns us µs ms s sec min h hz khz mhz ghz b kb mb gb tb pb kib mib gib tib bytes mm cm m km mg g kg t percent px pt kbit mbit gbit "
    "мс сек мин гб мб кб тб байт go mo ko"
).split()

_SINGLE = "々-〇ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-龎ｦ-ﾟ\U00020000-\U000323af"
#: Runs of letters and digits; each Han or kana letter by itself.
WORD = re.compile(rf"[^\W_{_SINGLE}]+|[{_SINGLE}]")
_STOPS = ".!?:…。！？\"“”«»„"
#: Where a long text may be cut: after a blank or a letter that is a word, unless a mark that composes with it follows.
_CUT = re.compile(rf"[\s{_SINGLE}](?![̀-゙゚ͯ])")
TOP = 0x323B0

WINDOW_SCHEMA = "family string, length int, hash long, template string, words string"
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def fold(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low)


def words_of(text: str) -> list[str]:
    return WORD.findall(fold(text))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit codes (splitmix)."""
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _classes() -> dict[str, np.ndarray]:
    """What each code point is; those above ``TOP`` are separators."""
    chars = [chr(i) for i in range(TOP)]
    single = np.zeros(TOP, bool)
    for m in re.finditer(r"(.)-(.)|(.)", _SINGLE):
        a, b = (m[1], m[2]) if m[1] else (m[3], m[3])
        single[ord(a) : ord(b) + 1] = True
    of = lambda test: np.fromiter(map(test, chars), bool, TOP)
    out = {"word": of(str.isalnum), "digit": of(str.isdigit), "upper": of(str.isupper), "blank": of(str.isspace)}
    out["single"] = single & out["word"]
    for name, marks in (("stop", _STOPS), ("line", "\n"), ("point", ".,:"), ("joint", "-'’")):
        out[name] = np.zeros(TOP, bool)
        out[name][[ord(c) for c in marks]] = True
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])


def _spans_hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of codes; equal spans have equal ones wherever they stand."""
    up, down = _power(len(codes))
    total = _running((codes + np.uint64(1)) * up[: len(codes)])
    return _mix((total[end] - total[start]) * down[start])


def aligned(text: str) -> tuple[str, str]:
    """A text composed, and the same lower-cased, character by character."""
    composed = text if text.isascii() else unicodedata.normalize("NFC", text)
    low = fold(composed)
    if len(low) != len(composed):
        parts = [c.lower() for c in composed]
        composed = "".join(c + p[1:] for c, p in zip(composed, parts))
        low = low if len(low) == len(composed) else "".join(parts)
    return composed, low


class Words:
    """The words of some texts with what their surroundings show: numbers, units, names, and tokens made of them.

    A number is a word that starts with a digit; "48.3" is one token. A unit is one of ``UNITS`` right after a number. A name is a word
    with a capital inside a sentence, or at a sentence's start if its text has it inside one too and never small; names that
    follow each other are one token. ``evidence`` holds hashes of (text, word) seen so elsewhere in the texts.
    """

    def __init__(self, texts: list[str], owner: list[int], evidence: tuple[np.ndarray, np.ndarray] | None = None):
        pairs = [aligned(t) for t in texts]
        self.low = "\n\n".join(p[1] for p in pairs)
        codes, shown = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (self.low, "\n\n".join(p[0] for p in pairs)))
        is_ = _classes()
        codes, shown = np.minimum(codes, TOP - 1), np.minimum(shown, TOP - 1)
        word, single = is_["word"][codes], is_["single"][codes]
        new = word.copy()
        new[1:] &= ~word[:-1] | single[1:] | single[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | single[1:] | single[:-1]
        self.start, self.end = np.flatnonzero(new), np.flatnonzero(last) + 1
        n = self.n = len(self.start)
        starts = _running(np.array([len(p[1]) + 2 for p in pairs], np.int64))[:-1]
        self.piece = np.searchsorted(starts, self.start, side="right") - 1
        self.offset = starts
        self.hash = _spans_hashed(codes.astype(np.uint64), self.start, self.end)
        first = np.ones(n, bool)
        first[1:] = self.piece[1:] != self.piece[:-1]

        gap_from = np.concatenate([np.zeros(min(n, 1), np.int64), self.end[:-1]])
        gap = self.start - gap_from
        within = lambda name: (lambda r: r[self.start] - r[gap_from])(_running(is_[name][codes].astype(np.int32)))
        mark = codes[np.minimum(gap_from, max(len(codes) - 1, 0))] if n else np.zeros(0, np.int64)
        before = lambda flags: np.concatenate([np.zeros(min(n, 1), bool), flags[:-1]])
        digits = _running(is_["digit"][codes].astype(np.int32))
        number = is_["digit"][codes[self.start]] if n else np.zeros(0, bool)
        whole_number = digits[self.end] - digits[self.start] == self.end - self.start
        capital = is_["upper"][shown[self.start]] if n else np.zeros(0, bool)
        all_blank = within("blank") == gap

        # after a short capitalised word, as "Dr", a point ends no sentence
        title = before(capital & (self.end - self.start <= 3)) & (gap == 2) & is_["point"][mark] & (within("stop") == 1)
        opens = first | (within("line") >= 2) | ((within("stop") > 0) & ~title)
        follows = before(number) & ~first & np.isin(self.hash, _unit_hashes())
        unit = follows & (gap <= 1)
        bare = capital & ~number & ~unit
        text = np.asarray(owner, np.uint64)[self.piece] if n else np.zeros(0, np.uint64)
        keyed = self.hash ^ _mix(text + np.uint64(1))
        inside, small = np.unique(keyed[bare & ~opens]), np.unique(keyed[~capital])
        self.evidence = inside, small
        if evidence is not None:
            inside, small = evidence
        doubtful = np.flatnonzero(bare & opens)
        name = bare & ~opens
        name[doubtful] = np.isin(keyed[doubtful], inside) & ~np.isin(keyed[doubtful], small)

        #: Type of each word for windows of words: its own form and the word before decide, whatever is between them.
        self.plain_type = np.where(number, NUMBER, np.where(follows, UNIT, 0))
        self.type = np.where(name, NAME, np.where(number, NUMBER, np.where(unit, UNIT, 0)))
        same_name = before(name) & name & ~opens & (all_blank | (gap == 1) & is_["joint"][mark])
        same_number = before(number & whole_number) & number & (gap == 1) & is_["point"][mark]
        self.token = np.flatnonzero(~((same_name | same_number) & ~first))

    def windows(self, family: str, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(first, last, hash)`` of the windows of ``length`` words (family w) or tokens (family t): index of first and last unit, and hash of the template.

        Windows of slots alone have the hash of their words (family w) or none (family t).
        """
        at = np.arange(self.n) if family == "w" else self.token
        kind = self.plain_type if family == "w" else self.type[self.token]
        n = len(at) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literal = self.hash[at]
        code = np.where(kind > 0, kind.astype(np.uint64), literal)
        up, down = _power(len(at))
        total = _running(code * up[: len(at)])
        h = (total[length:] - total[:-length]) * down[:n]
        slots = _running((kind > 0).astype(np.int32))
        filled = slots[length:] - slots[:-length]
        if family == "w":
            # a unit is one by the word before it, so the first of a window is a word
            cut = kind[:n] == UNIT
            h += np.where(cut, literal[:n] - code[:n], np.uint64(0))
            exact = _running(literal * up[: len(at)])
            h = np.where(filled - cut == length, (exact[length:] - exact[:-length]) * down[:n] + np.uint64(1), h)
            usable = np.ones(n, bool)
        else:
            usable = filled < length
        h = _mix(h + np.uint64(2 * length + (family == "w")))
        usable &= self.piece[at[:n]] == self.piece[at[length - 1 :]]
        first = np.flatnonzero(usable)
        return first, first + length - 1, h[first]

    def _unit(self, family: str, i: int) -> tuple[int, int]:
        if family == "w":
            return i, i + 1
        return self.token[i], self.token[i + 1] if i + 1 < len(self.token) else self.n

    def describe(self, family: str, first: int, last: int) -> tuple[str, str]:
        """Template and words of a window. Slots are numbered by their values, so templates agree where values map one to one."""
        values, template, seen = [], [], {}
        for i in range(first, last + 1):
            a, b = self._unit(family, i)
            value = " ".join(self.low[self.start[k] : self.end[k]] for k in range(a, b))
            kind = int(self.plain_type[a] if family == "w" else self.type[a])
            if family == "w" and kind == UNIT and i == first:
                kind = 0
            values.append(value)
            template.append(f"{SLOT[kind]}{seen.setdefault((kind, value), len(seen))}" if kind else value)
        if len(seen) and all(t[0] in "#%@" for t in template):
            template = ["=", *values]
        return family + " " + " ".join(template), " ".join(values)

    def ends_at(self, family: str, last: np.ndarray) -> np.ndarray:
        """Where windows end, in characters from the start of their piece."""
        units = last
        if family == "t":
            units = np.append(self.token[1:], self.n)[last] - 1
        return self.end[units] - self.offset[self.piece[units]]


@lru_cache(maxsize=1)
def _unit_hashes() -> np.ndarray:
    joined = "\n".join(UNITS)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return _spans_hashed(codes, end - np.array([len(u) for u in UNITS]), end)


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """A text in pieces of about ``SLICE_CHARS`` characters, each with how many of its characters the one before had too."""
    at, shared = 0, 0
    while True:
        m = _CUT.search(text, at + shared + SLICE_CHARS) if len(text) - at - shared > SLICE_CHARS else None
        stop = m.end() if m else len(text)
        yield text[at:stop], shared
        if stop == len(text):
            return
        # the last words of this piece, whatever their length
        tail = re.finditer(WORD, text[max(at, stop - 40 * OVERLAP) : stop])
        found = [x.start() for x in tail][-OVERLAP:]
        back = max(at, stop - 40 * OVERLAP) + (found[0] if found else 0)
        at, shared = max(back, at + 1), stop - max(back, at + 1)


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item"], pdf["text"]):
            w = Words([text], [0])
            for family, n in (("w", w.n), ("t", len(w.token))):
                length = min(WINDOW, n)
                if length:
                    firsts, lasts, hashes = w.windows(family, length)
                    rows += [(item, family, length, h, *w.describe(family, a, b)) for a, b, h in zip(firsts, lasts, hashes.view(np.int64).tolist())]
        yield pd.DataFrame(rows, columns=["item", "family", "length", "hash", "template", "words"])


class Finder:
    """Windows of documents whose hash the filter of item hashes has."""

    def __init__(self, lengths: list[tuple[str, int]], bits: np.ndarray):
        self.lengths, self.bits = lengths, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held: list[tuple[object, str, int]] = []
            size = 0
            for d, text in zip(pdf["doc"], pdf["text"]):
                if len(text) > SLICE_CHARS:
                    yield self._long(d, text)
                    continue
                held.append((d, text, 0))
                size += len(text)
                if size >= SLICE_CHARS:
                    yield self._slice(held, list(range(len(held))))
                    held, size = [], 0
            yield self._slice(held, list(range(len(held))))

    def _long(self, d, text: str) -> pd.DataFrame:
        # what the whole text shows of its names comes first
        shown = [Words([p], [0]).evidence for p, _ in pieces(text)]
        evidence = tuple(np.unique(np.concatenate(x)) for x in zip(*shown))
        return pd.concat([self._slice([(d, p, shared)], [0], evidence) for p, shared in pieces(text)])

    def _slice(self, held: list[tuple[object, str, int]], owner: list[int], evidence=None) -> pd.DataFrame:
        words = Words([t for _, t, _ in held], owner, evidence)
        shared = np.array([s for _, _, s in held], np.int64)
        found = []
        for family, length in self.lengths:
            first, last, hashes = words.windows(family, length)
            hit = np.flatnonzero(self.has(hashes))
            first, last, hashes = first[hit], last[hit], hashes[hit]
            piece = words.piece[first if family == "w" else words.token[first]]
            fresh = words.ends_at(family, last) > shared[piece]
            for a, b, h, p in zip(first[fresh], last[fresh], hashes[fresh].view(np.int64).tolist(), piece[fresh]):
                found.append((held[p][0], family, length, h, *words.describe(family, a, b)))
        return pd.DataFrame(found, columns=["doc", "family", "length", "hash", "template", "words"])


def _filter_bits(windows: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the low bits of all hashes; at most ``FILTER_MOST`` bits come to the driver."""
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_RATE * n).bit_length()))
    low = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = windows.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def find_leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", names: bool = True, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(doc, item, windows, verbatim)``: windows of a document that have the template of the item, and how many have its very words.

    Texts become templates in two families of windows. Windows of 13 words in a row (or the whole item, where it is shorter)
    have typed placeholders for numbers and for units after numbers, whatever the case of their letters; windows of 13 tokens also
    have them for names, take "48.3" as one number and "Ann Lee" as one name. Templates number their slots by value, so two are
    equal only if literal words and slot types agree and slot values map one to one. Windows are joined on the template, behind
    a filter of template hashes. ``windows`` counts those of the family that has more; ``verbatim`` the windows of words in
    which slot values are equal too: a pair without any is a re-parameterised item.

    Without ``names`` there are windows of words alone: names are literal words.

    * Words are runs of letters and digits, composed and lower-cased; each Han or kana letter is one.
    * Whether a word is a name shows in its own document or item alone: a capital inside a sentence. Scripts without case have no names.
    * A window without any literal word is a window of its words.
    * Null and empty texts, and texts without a word, match nothing; rows without id are left out. Copies count each.
    * Items that share a template match the same passage. An item repeated under one id counts once.
    * Whole texts are read, whatever their length, in one pass whatever the number of items. No items or no documents give no rows.

    The executors get a bitmap of item hashes of at most 64 MB. The item windows are broadcast to the join up to
    ``broadcast_windows`` rows, which have at most 13 tokens each, and shuffled above; the result is the same.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    texts = items.where(F.col(item).isNotNull() & (F.length(text) > 0)).select(F.col(item).alias("item"), F.col(text).alias("text"))
    item_kind = dict(texts.dtypes)["item"]
    made = texts.mapInPandas(_item_windows, f"item {item_kind}, {WINDOW_SCHEMA}").distinct()
    made = made if names else made.where("family = 'w'")
    windows = through_table(made, "item-windows")
    # at most 26 rows: which lengths windows have
    lengths = windows.groupBy("family", "length").agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in lengths)
    finder = spark.sparkContext.broadcast(Finder(sorted((r["family"], r["length"]) for r in lengths), _filter_bits(windows, n)))

    kind = dict(docs.dtypes)["doc"]
    hits = spread(docs).mapInPandas(lambda batches: finder.value(batches), f"doc {kind}, {WINDOW_SCHEMA}")
    held = windows.select("item", "hash", "template", F.col("words").alias("item_words"))
    held = F.broadcast(held) if n <= broadcast_windows else held.hint("merge")
    pairs = hits.join(held, ["hash", "template"])
    words = F.col("family") == "w"
    counts = pairs.groupBy("doc", "item").agg(
        F.greatest(F.count_if(words), F.count_if(~words)).alias("windows"),
        F.count_if(words & (F.col("words") == F.col("item_words"))).alias("verbatim"),
    )
    return counts.select(F.col("doc").alias(doc), F.col("item").alias(item), "windows", "verbatim")
