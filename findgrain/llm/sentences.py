"""Sentence boundaries in many languages, decided by what a document shows about its own words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrain.session import spread, through_table

# Abbreviations that are followed by what they belong to, and those that may also end a sentence.
NEVER_FINAL = frozenset(
    "Mr Mrs Ms Dr Prof Gen Sen Rev Hon Capt Lt Col Sgt St st Mt Ft vs cf e.g i.e a.k.a viz approx ca Fig fig Figs Eq Sec sec Ch ch Vol vol "
    "No no Nos nos p pp art Art al Mon Tue Wed Thu Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "Nr Abb Abs Kap Bd Hr Hrn Fr Fa vgl Vgl bzw ggf evtl inkl exkl zzgl sog S ff z.B d.h u.a i.d.R "
    "M MM Mme Mlle env éd chap janv févr avr juil sept oct nov déc "
    "Sr Sra Srta Dra Ud Uds pág págs núm tel ext p.ej EE EE.UU "
    "см См рис Рис стр ул тыс млн млрд др г гг т.е т.к напр проф акад им "
    "डॉ श्री पृ सं د ص น พ".split()
)
MAY_END = frozenset("etc Inc Ltd Co Corp Jr Sr.Jr a.m p.m usw h U.S U.K т.д т.п".split())
#: Words before a number with a point that make it an ordinal.
ORDINAL_AFTER = frozenset("am im vom zum beim ab seit bis".split())

CLOSERS = "\"”’»)]」』》）】〉›"
OPENING = {"”": "“", "»": "«", "」": "「", "』": "『", "》": "《", "“": "„"}
CLOSE_SET = frozenset(CLOSERS)
QUOTE_MARKS = "\"“”«»「」『』《》„"
OPENERS = frozenset(OPENING.values())
QUOTE_MARK = re.compile(f"[{QUOTE_MARKS}]")
QUOTE_STARTS = "“「『«„\""
HAN_KANA = "々-〇ぁ-ヿ㐀-鿿豈-﫿"
DEVANAGARI = "ऀ-ॣ०-ॿ"
THAI = "ก-๎"

BLANK_LINES = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")
LINE_END = re.compile(r"\r\n|\n|\r")
BULLET = re.compile(r"[-*•‣◦–+][^\S\r\n]")
NUMBERED = re.compile(r"\d{1,4}[.)][^\S\r\n]")
_FULL = "。！？｡।॥؟"
_CLOSE = re.compile(rf"(?:[{re.escape(CLOSERS)}]|[^\S\r\n]*(?:\r\n|\n|\r)?[^\S\r\n]*»)*")
#: Where a sentence may end: marks of scripts without case anywhere; a point, ! or ? before a blank, a closing mark or a capital.
#: Every alternative begins with a mark itself, which lets the scan skip from mark to mark.
_ENDS = rf"[{_FULL}!?…]+[!?]*|\.{{2,}}|\.(?=\s|$|[\"”»)\]“’]|[A-ZА-ЯÀ-ÖØ-ÞЁ](?:[^\W\d_A-Z]|\s)|[«„¿¡(`“]|[a-z][A-Z]|~/)"
CANDIDATE = re.compile(_ENDS)
CANDIDATE_THAI = re.compile(rf"{_ENDS}|[{THAI}]\s+(?=[{THAI}])")
HAS_THAI = re.compile(f"[{THAI}]")
#: A token that starts small and is still no ordinary word: a file, a path, a name with inner capitals.
ODD_START = re.compile(r"\w[\w-]+[./]\w|\w+_\w|[^\W\d_A-Z]+[A-Z]|\w+\s+v\d")
_LETTER = rf"[^\W\d_{HAN_KANA}]"
LEFT_WORD = re.compile(rf"(?:(?<!\w){_LETTER}{{1,2}}\.[^\S\r\n]?(?:\r\n|\n|\r)?)*{_LETTER}+(?:\.{_LETTER}+)*$")
LEFT_NUMBER = re.compile(rf"({_LETTER}+)?\.?\s*\d[\d.,:/-]*$")
CHAIN = re.compile(r"\.\s+")
NO_CASE = re.compile(f"[{HAN_KANA}{DEVANAGARI}{THAI}؀-ۿ]")
BARE_WORD = re.compile(r"(?<!\w)(\w+)(?![\w.])")
SHORTENED = re.compile(r"(?<!\w)(\w+)\.(?:(?=,|\s+[^\W\d_A-ZÀ-ÞА-ЯЁ])|(?=\s+(\d)))")
#: A word without a point that is no part of a path or compound. Before a capital or a digit it may be an abbreviation written without its point.
PLAIN_WORD = re.compile(r"(?<![\w./̀-ͯ-])(\w++)(?![./̀-ͯ-])(?!\s+[A-ZÀ-ÞА-ЯЁ\d])")
INNER_POINT = re.compile(r"\.(?:,|\s+([^\W\d_A-Z]))")
NEXT_WORD = re.compile(r"\w+")
WORD_BEFORE = re.compile(r"\w+$")
INNER_NAME = re.compile(r"(?<=[^\W\d_A-Z])\s+(\w+)")
HELD = re.compile(f"[{HAN_KANA}{DEVANAGARI}]")
#: Words that go on after dots.
CJK_GOES_ON = re.compile("但|而|却|不过|然而|可是|しかし|だが|でも|ただ|けれど|が|と")
AFTER_QUOTE_GOES_ON = re.compile("と|って|が|を|は|の|も|に|、|，")
HI_FRAME = re.compile(r"\s*\S+\s+(?:\S+\s+)?ने\s")


NEVER, MAY, ORDINARY = "never", "may", "ordinary"


@dataclass
class Lexicon:
    """What the corpus showed of words before a point: abbreviations that never end a sentence, those that may, ordinary words; and of numbers by the word before them.

    Where the corpus has nothing on a word, ``seeds`` (the lists above by default) are asked.
    """

    never_final: frozenset = frozenset()
    may_end: frozenset = frozenset()
    ordinary: frozenset = frozenset()
    ordinals: frozenset = frozenset()
    not_ordinals: frozenset = frozenset()
    seeds: tuple[frozenset, frozenset, frozenset] = (NEVER_FINAL, MAY_END, ORDINAL_AFTER)

    def of(self, key: str) -> str | None:
        if key in self.ordinary:
            return ORDINARY
        if key in self.may_end:
            return MAY
        if key in self.never_final:
            return NEVER
        if key in self.seeds[1]:
            return MAY
        return NEVER if key in self.seeds[0] else None

    def ordinal(self, key: str) -> bool:
        return key in self.ordinals or key in self.seeds[2] and key not in self.not_ordinals


def next_kind(s: str, j: int, b: int) -> str:
    """What starts at ``j``: E end of paragraph, l small letter, f file or other odd start, U capital, d digit, n letter without case, p mark that goes on, o other."""
    if j >= b:
        return "E"
    c = s[j]
    if c.islower():
        return "f" if ODD_START.match(s, j, b) else "l"
    if c.isupper():
        return "U"
    if c.isdigit():
        return "d"
    if c in ",;:—–-":
        return "p"
    if c in "./~`":
        return "f"
    return "n" if c.isalpha() else "o"


def left_key(s: str, a: int, pos: int) -> tuple[str, bool]:
    """The word before a point (chains such as "z. B" as one), or for a number the word before it; and whether it is a number."""
    back = 40
    while True:
        at = max(a, pos - back)
        left = s[at:pos]
        last = left[max(left.rfind(" "), left.rfind("\n")) + 1 :]
        if at == a or len(last) < back - 10 or not (last.isalnum() and last < "\u0e00"):
            break
        # a word that fills the view is looked at further back
        back *= 4
    if len(last) > 3 and last.isalpha() and last < "\u0e00":
        return last, False
    if last[-1:].isdigit():
        m = LEFT_NUMBER.search(left)
        return (m.group(1) or "") if m else "", True
    m = LEFT_WORD.search(left, max(0, len(left) - len(last) - 8))
    return (CHAIN.sub(".", m.group()), False) if m else ("", False)


def _skip(s: str, j: int, b: int) -> int:
    while j < b and s[j].isspace():
        j += 1
    return j


class Quotes:
    """Open quotation marks of the current sentence. Marks are read once, in order, however long the paragraph is."""

    def __init__(self, s: str, a: int, b: int):
        self.marks = [(m.start(), m.group()) for m in QUOTE_MARK.finditer(s, a, b)]
        self.at, self.opened = 0, False
        self.seen = dict.fromkeys(QUOTE_MARKS, 0)
        self.last = {mark: pos for pos, mark in self.marks}

    def advance(self, to: int) -> dict[str, int]:
        while self.at < len(self.marks) and self.marks[self.at][0] < to:
            mark = self.marks[self.at][1]
            self.seen[mark] += 1
            self.opened = self.opened or mark in OPENERS
            self.at += 1
        return self.seen

    def restart(self, start: int) -> None:
        self.advance(start)
        self.seen = dict.fromkeys(QUOTE_MARKS, 0)
        self.opened = False

    def inside(self, end: int) -> bool:
        """Whether a quotation is open at ``end`` that closes later in the paragraph."""
        seen = self.advance(end)
        return self.opened and any(seen[opened] > seen[close] and self.last.get(close, -1) >= end for close, opened in OPENING.items())


class Document:
    """What a document shows of its own words, gathered in one pass when a word is first in doubt."""

    def __init__(self, text: str):
        self.text = text
        self.words: set[str] | None = None
        self.inner: Counter | None = None
        self.plain: set[str] | None = None

    def _alone(self, word: str) -> bool:
        """Whether the word has a point here only, so that no other place can show anything; long texts do not ask, they have it gathered."""
        if len(self.text) > 20_000:
            return False
        pointed = word + "."
        return self.text.find(pointed, self.text.find(pointed) + 1) < 0

    def _gather(self) -> None:
        if self.words is None:
            self.words = set(BARE_WORD.findall(self.text))
            self.shortened = Counter((w, "d" if d else "l") for w, d in SHORTENED.findall(self.text))
            self.names = set(INNER_NAME.findall(self.text))

    def _inner(self) -> Counter:
        """Words with a point before a comma or an ordinary small word, which no sentence starts with."""
        if self.inner is None:
            self.inner, s = Counter(), self.text
            for m in INNER_POINT.finditer(s):
                if m.group(1) and next_kind(s, m.start(1), len(s)) != "l":
                    continue
                w, back = None, 40
                while w is None or w.start() == m.start() - back // 4 > 0:
                    # a word that fills the view is looked at further back
                    w = WORD_BEFORE.search(s, max(0, m.start() - back), m.start())
                    if w is None:
                        break
                    back *= 4
                if w:
                    self.inner[w.group()] += 1
        return self.inner

    def uses_plain(self, word: str) -> bool:
        """Whether this document uses the word without a point, and nowhere with one inside a clause."""
        if self.plain is None and len(self.text) <= 20_000 and self.text.count(word) == self.text.count(word + "."):
            # never without a point
            return False
        if self.plain is None:
            self.plain = set(PLAIN_WORD.findall(self.text))
        return word in self.plain and word not in self._inner()

    def shortens(self, word: str, kind: str) -> bool:
        """Whether this document has the word elsewhere with a point inside a clause, and nowhere without a point."""
        if self._alone(word) or self._inner()[word] <= (kind in "lp"):
            return False
        self._gather()
        return word not in self.words

    def abbreviation(self, word: str, kind: str) -> bool:
        """Whether this document shows the word elsewhere with a point before a small letter, a comma or a digit, and never without a point.

        ``kind`` is what follows here, which is no evidence for itself; a digit is none against a sentence that starts with one.
        """
        if self._alone(word):
            return False
        self._gather()
        if word in self.words:
            return False
        inside, number = self.shortened[word, "l"], self.shortened[word, "d"]
        return inside > 0 if kind == "d" else inside + number > (kind in "lp")

    def proper_name(self, word: str) -> bool:
        """Whether this document has the capitalised word inside a clause and never with a small first letter."""
        self._gather()
        return word in self.names and word[0].lower() + word[1:] not in self.words


def _name_follows(s: str, j: int, b: int, doc: Document) -> bool:
    m = NEXT_WORD.match(s, j, b)
    return bool(m and doc.proper_name(m.group()))


def _point_ends(s: str, a: int, b: int, pos: int, j: int, kind: str, lex: Lexicon, doc: Document, spaced: bool) -> bool:
    if "\u0900" <= s[pos - 1] <= "\u097f":
        return False
    key, number = left_key(s, a, pos)
    if number:
        return not lex.ordinal(key) and (kind != "l" or key in lex.not_ordinals)
    if not key:
        return kind != "p"
    last = key.rpartition(".")[2]
    word = key == last and len(last) > 1
    # what the corpus knows of it, else the seed list
    known = lex.of(key)
    # a word is what the document shows of it without doubt, whatever is known; an initial or a chain shows nothing of itself elsewhere.
    # The document is read where it can change the outcome: a plain word ends the sentence, as all but abbreviations do anyway
    if word and known == NEVER and spaced and kind not in "ldp" and doc.uses_plain(last):
        return True
    shown = word and known not in (NEVER, MAY) and kind in "ldpU" and doc.shortens(last, kind)
    if shown:
        return kind == "U" and not _name_follows(s, j, b, doc)
    if known == ORDINARY:
        return True
    if known is None and key != last:
        # a chain is known by its last part
        known = lex.of(last) if lex.of(last) != ORDINARY else None
    if known == MAY:
        return kind not in "lp"
    if known == NEVER:
        return False
    if key != last and len(last) > 2:
        # a file name
        return kind != "p"
    if len(last) == 1:
        # an initial, unless this letter was seen to end paragraphs
        return last in lex.ordinary
    if not spaced and len(last) <= 2 and last[0].isupper():
        return False
    if kind in "ldp" and doc.abbreviation(last, kind):
        return False
    if kind == "U" and doc.abbreviation(last, kind):
        return not _name_follows(s, j, b, doc)
    return kind != "p"


def prose(s: str, a: int, b: int, lex: Lexicon, doc: Document) -> Iterator[tuple[int, int]]:
    """Sentences of one paragraph."""
    start = _skip(s, a, b)
    candidates = CANDIDATE_THAI if HAS_THAI.search(s, a, b) else CANDIDATE
    first = candidates.search(s, start, b)
    if first is None or first.end() >= b:
        # nothing but its end could end a sentence
        while b > start and s[b - 1].isspace():
            b -= 1
        if b > start:
            yield start, b
        return
    guillemets = s.find("»", a, b) >= 0
    quotes = Quotes(s, a, b) if QUOTE_MARK.search(s, a, b) else None
    for m in candidates.finditer(s, first.start(), b):
        pos = m.start()
        if pos < start:
            continue
        mark, end = m.group(), m.end()
        if mark[-1].isspace():
            # blanks between Thai letters
            yield start, pos + 1
            start = end
            if quotes:
                quotes.restart(start)
            continue
        if mark == "." and pos and s[pos - 1].isspace():
            continue
        if mark == ".." and end < b and s[end].isalpha():
            # a point and a file name that begins with one
            mark, end = ".", end - 1
        after = s[end : end + 1]
        closers = _CLOSE.match(s, end, b).end() if after in CLOSE_SET or guillemets and after.isspace() else end
        quote = ""
        # a straight quote closes only where one is open; so does the mark that closes in German and opens elsewhere
        k = end
        while k < closers:
            if s[k] == '"' and quotes and quotes.advance(k)['"'] % 2 == 0:
                break
            if not s[k].isspace():
                quote += s[k]
            k += 1
        closers = k
        while closers > end and s[closers - 1].isspace():
            closers -= 1
        if closers < b and s[closers] == "“" and quotes:
            seen = quotes.advance(closers)
            if seen["„"] > seen["“"]:
                quote += "“"
                closers += 1
        end = closers
        if end < b and s[end] in ".!?…" and not quote:
            continue
        j = _skip(s, end, b)
        spaced = j > end
        if j >= b:
            break
        kind = next_kind(s, j, b)
        # inside a quotation that is still open and closes later
        if quotes and quotes.inside(end):
            continue
        full = mark[0] in _FULL
        if quote and any(q in "\"”»」』“’" for q in quote):
            if kind in "lp":
                continue
            if not spaced and AFTER_QUOTE_GOES_ON.match(s, j):
                continue
            if s[start] in QUOTE_STARTS and HELD.search(s, start, pos):
                if full or not spaced:
                    if s[j] not in QUOTE_STARTS and (not spaced or HI_FRAME.match(s, j, b)):
                        continue
                elif HI_FRAME.match(s, j, b):
                    continue
            if not spaced and not full and kind not in "Uo" and not NO_CASE.search(s, max(start, pos - 1), pos):
                continue
        elif quote and kind in "lp":
            # a remark in brackets inside a clause, unless the bracket is the sentence
            if not (s[start] in "(（[" and kind == "l"):
                continue
        elif mark[0] == "…" or mark.startswith(".."):
            if kind in "lp" or kind == "n" and not re.match(f"[{HAN_KANA}]", s[j]):
                continue
            if CJK_GOES_ON.match(s, j):
                continue
        elif mark == ".":
            if not _point_ends(s, a, b, pos, j, kind, lex, doc, spaced):
                continue
        elif kind == "p":
            continue
        elif not full and not spaced and kind not in "Uno":
            continue
        yield start, end
        start = j
        if quotes:
            quotes.restart(start)
    end = b
    while end > start and s[end - 1].isspace():
        end -= 1
    if end > start:
        yield start, end


def _lines(s: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    at = a
    for m in LINE_END.finditer(s, a, b):
        yield at, m.start()
        at = m.end()
    yield at, b


def _strip(s: str, a: int, b: int) -> tuple[int, int]:
    a = _skip(s, a, b)
    while b > a and s[b - 1].isspace():
        b -= 1
    return a, b


def paragraphs(s: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK_LINES.finditer(s):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(s):
        yield at, len(s)


def blocks(s: str) -> Iterator[tuple[int, int, bool]]:
    """Parts of a text that sentences do not cross, and whether the part is a sentence whole: a heading or a list item."""
    for a, b in paragraphs(s):
        a, b = _strip(s, a, b)
        if a == b:
            continue
        if s[a] == "#" or BULLET.match(s, a, b) or NUMBERED.match(s, a, b):
            lines = [x for x in (_strip(s, *line) for line in _lines(s, a, b)) if x[0] < x[1]]
            if s[a] == "#":
                heads = 0
                while heads < len(lines) and s[lines[heads][0]] == "#":
                    yield *lines[heads], True
                    heads += 1
                if heads < len(lines):
                    yield lines[heads][0], b, False
                continue
            marker = BULLET if BULLET.match(s, a, b) else NUMBERED
            starts = [x[0] for x in lines if marker.match(s, x[0], x[1])]
            listed = marker is BULLET or len(starts) == len(lines) and (len(lines) > 1 or s[b - 1] not in ".!?…")
            if listed:
                for i, x in enumerate(starts):
                    yield *_strip(s, x, starts[i + 1] if i + 1 < len(starts) else b), True
                continue
        yield a, b, False


def split_text(s: str, lex: Lexicon) -> list[tuple[int, int]]:
    """Spans ``(start, end)`` of the sentences of a text in code points."""
    doc, out = Document(s), []
    for a, b, whole in blocks(s):
        if whole:
            out.append((a, b))
        else:
            out += prose(s, a, b, lex, doc)
    return out


POINT = re.compile(r"(?<=\w)\.(\s+|$)")
COUNTS = "key string, n long, lower long, digit long, upper long, ends long"


def gather(texts) -> Counter:
    """Counts of (key, kind of what follows) over the points of texts. Keys of numbers start with "#"."""
    seen: Counter = Counter()
    for s in texts:
        b = len(s)
        for m in POINT.finditer(s):
            pos, blank = m.start(), m.group(1)
            key, number = left_key(s, 0, pos)
            if key:
                ends = m.end() == b or len(blank) > 1 and len(LINE_END.findall(blank)) > 1
                seen["#" + key if number else key, "E" if ends else next_kind(s, m.end(), b)] += 1
    return seen


def learn(counts) -> Lexicon:
    """Classes of words from rows ``(key, n, lower, digit, upper, ends)`` of a corpus.

    A paragraph's end is a sentence's end for certain, a small letter, a digit or a comma after the point shows an
    abbreviation. A word that never ends a paragraph though it stands often before a point is never final; one with both
    kinds of evidence may end a sentence before a capital; one that ends paragraphs and shows nothing else is ordinary.
    Words in between have no class.
    """
    never, may, ordinary, ordinals, not_ordinals = set(), set(), set(), set(), set()
    for key, n, lower, digit, _upper, ends in counts:
        if n < LEAST:
            continue
        if key.startswith("#"):
            if ends < 0.01 * n:
                ordinals.add(key[1:])
            elif ends >= 0.03 * n and lower < 0.3 * n:
                not_ordinals.add(key[1:])
        elif ends < 0.01 * n:
            size = len(key.rpartition(".")[2])
            if size <= 4 or lower + digit >= 0.5 * n:
                never.add(key)
        elif lower >= 0.2 * n:
            may.add(key)
        elif ends >= 0.03 * n:
            ordinary.add(key)
    return Lexicon(frozenset(never), frozenset(may), frozenset(ordinary), frozenset(ordinals), frozenset(not_ordinals))


#: Points a word must stand before for a class of its own.
LEAST = 30
#: A word enters the corpus lexicon from this share of all points on, so it has at most the inverse number of words.
LEXICON_SHARE = 1e-5


def corpus_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows for ``learn``: counted per task, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: dict[str, list[int]] = {}
            for (key, kind), n in gather(pdf["text"]).items():
                r = rows.setdefault(key, [0, 0, 0, 0, 0])
                r[0] += n
                for i, k in enumerate("ldUE", 1):
                    if kind == k:
                        r[i] += n
            yield pd.DataFrame([(k, *r) for k, r in rows.items()], columns=["key", "n", "lower", "digit", "upper", "ends"])

    texts = documents.where(F.length(text) > 0).select(F.col(text).alias("text"))
    part = spread(texts).mapInPandas(count, COUNTS)
    return part.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "lower", "digit", "upper", "ends")])


def corpus_lexicon(documents: DataFrame, text: str = "text", share: float = LEXICON_SHARE) -> Lexicon:
    """The classes of words that stand before at least ``share`` of all points; rarer ones are left to their document and the seed list."""
    counts = corpus_counts(documents, text)
    counts = through_table(counts, "points")
    # at most 1 / share rows pass, whatever the corpus
    points = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") >= LEAST) & (F.col("n") >= share * points)).collect()
    return learn((r["key"], r["n"], r["lower"], r["digit"], r["upper"], r["ends"]) for r in rows)


def sentences(documents: DataFrame, *, doc: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None, lexicon_share: float = LEXICON_SHARE) -> DataFrame:
    """``(doc, start_char, end_char)``: one row per sentence, as code points from 0, end exclusive.

    Document-centred disambiguation: whether a word before a point is an abbreviation, a number an ordinal, and a capital
    a name, is decided by unambiguous occurrences: those elsewhere in the document first, then those of the whole corpus
    where a word stands before at least ``lexicon_share`` of all points (and ``LEAST``), then a seed list. Terminators follow the script: ideographic and Indic stops need no blank, Thai sentences end at blanks
    between Thai letters, a point after Devanagari is an abbreviation.

    * Blank lines end sentences; a heading and each list item is one; other line breaks are blanks.
    * Null, empty and blank texts have no sentences; rows without id are left out; copies are cut alike.
    * A text without terminators is one sentence per paragraph. Whole texts are read, whatever their length.
    """
    spark = documents.sparkSession
    lex = spark.sparkContext.broadcast(lexicon or corpus_lexicon(documents, text, lexicon_share))
    kind = dict(documents.select(F.col(doc)).dtypes)[doc]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, starts, ends = [], [], []
            for d, s in zip(pdf["doc"], pdf["text"]):
                for a, b in split_text(s, lex.value):
                    ids.append(d)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({doc: pd.Series(ids, dtype=pdf["doc"].dtype), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})

    rows = documents.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    return spread(rows).mapInPandas(cut, f"`{doc}` {kind}, start_char int, end_char int")
