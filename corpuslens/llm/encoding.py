"""Text garbled by decoding with a wrong encoding: finding it, and regaining the original."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bodies import body, header
from corpuslens.llm.compact import tiered
from corpuslens.sources.tables import checkpointed, spread

#: Legacy encodings in which UTF-8 is misread, and pairs (misread as, was) of one-byte encodings.
MULTIBYTE = ("cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "cp866", "koi8_r")
ONE_BYTE = (
    ("cp1252", "cp1250"),
    ("cp1252", "iso8859_2"),
    ("cp1250", "iso8859_2"),
    ("iso8859_2", "cp1250"),
    ("cp1250", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp1251", "cp1250"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp437", "cp1250"),
    ("cp850", "cp1250"),
    ("mac_roman", "cp1250"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp852"),
    ("iso8859_2", "cp1252"),
    ("iso8859_5", "cp1252"),
    ("koi8_r", "cp1252"),
)

#: How many times as frequent a place has to become by another reading to count as misread, as a logarithm; documents that a place
#: has to stand in to be counted, places that are kept in a dict at most (all others are kept packed), and different characters by which a pair of encodings has to show.
GAIN, LEAST, PLACES, CHARACTERS = math.log(20), 2, 500_000, 3

#: What a decoded span may hold: Latin letters, punctuation, signs, controls that a second decoding takes; other scripts only as runs.
_PLAUSIBLE = re.compile("(?:[\x20-\x7e\x80-ſ‐-‧‰′″‹›€™←-↓−≈≠≤≥Ωµ½¼¾①-⑳─-╿ﬁﬂ]|[Ѐ-ӿ]{2,}|[぀-ヿ一-鿿]{2,}|[Α-ώ]{2,})+")


def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte of the upper half; undefined bytes pass as C1 controls, as many decoders do."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    if codec in ("cp1252", "cp1250"):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def _byte_pair(c: str, pair: tuple[str, str]) -> str | None:
    """A character of the wrong encoding, read by the right one."""
    try:
        return c.encode(pair[0]).decode(pair[1])
    except UnicodeError:
        return None


def _automaton(table: dict[str, int]) -> re.Pattern[str]:
    """Accepts maximal runs of characters whose bytes are well-formed UTF-8 sequences of two to four bytes."""

    def bytes_in(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = bytes_in(0x80, 0xBF)
    forms = (
        bytes_in(0xC2, 0xDF) + tail,
        bytes_in(0xE0, 0xE0) + bytes_in(0xA0, 0xBF) + tail,
        bytes_in(0xE1, 0xEC) + tail + tail,
        bytes_in(0xED, 0xED) + bytes_in(0x80, 0x9F) + tail,
        bytes_in(0xEE, 0xEF) + tail + tail,
        bytes_in(0xF0, 0xF0) + bytes_in(0x90, 0xBF) + tail + tail,
        bytes_in(0xF1, 0xF3) + tail + tail + tail,
        bytes_in(0xF4, 0xF4) + bytes_in(0x80, 0x8F) + tail + tail,
    )
    return re.compile("(?:" + "|".join(f for f in forms if "[]" not in f) + ")+")


_TABLES = {c: _byte_of(c) for c in MULTIBYTE}
_AUTOMATA = {c: _automaton(t) for c, t in _TABLES.items()}
_LEADS = {c: {k for k, b in t.items() if b >= 0xC2} for c, t in _TABLES.items()}
_TAILS = {c: {k for k, b in t.items() if b < 0xC0} for c, t in _TABLES.items()}
_RUN = re.compile("[^\x00-\x7f]{2,}")
_WIDE = re.compile("[一-鿿㐀-䶿-]+[\x21-\x7e]?")


#: Characters beyond ASCII that the upper halves of the encodings have, and those that stand for nothing: their places are counted.
_UPPER = "".join(sorted({c for codec in {x for pair in ONE_BYTE for x in pair} | set(MULTIBYTE) for c in _byte_of(codec) if c > "\x9f" or c == "\x85"}))
_LOST = "\ufffd"
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_TRANSLATED = [(pair, {c: m for c in _byte_of(pair[0]) if (m := _byte_pair(c, pair)) not in (None, c)}) for pair in ONE_BYTE]
#: What may be left of a character whose further bytes are lost: its first byte's character in an encoding, by which characters begin with that byte.
_STUMPS = {c: {x for x in _UPPER if x.encode()[0] == b} for codec in ("cp1252", "cp1250") for c, b in _TABLES[codec].items() if 0xC2 <= b <= 0xC5 or b == 0xE2}


def _folded(c: str) -> str:
    """A neighbour as it counts: digits, and blanks, are one."""
    return "0" if c.isdigit() else " " if not c or c.isspace() else c


def places(text: str) -> dict[str, int]:
    """Each different place of a text and how often it has it: three characters, of which the neighbours are folded."""
    found: dict[str, int] = {}
    padded = f" {text} "
    for i in (m.start() for m in _CENTRE.finditer(padded)):
        place = _folded(padded[i - 1]) + padded[i] + _folded(padded[i + 1])
        if padded[i] != "?" or place[0].isalpha() and place[2].isalpha():
            found[place] = found.get(place, 0) + 1
    return found


_CENTRE = re.compile("[^\x00-\x7f]|(?<=\\w)\\?(?=\\w)")


@dataclass
class Habits:
    """In how many documents each place stands: what the corpus has habitually, against which a rare place is judged.

    A place is misread if reading it by a pair of one-byte encodings makes it RATIO times as frequent, and lost if another character between
    the same neighbours would be. The same table holds for all pairs, so the byte mapping that makes the corpus's usual places decides.
    """

    counts: Mapping[str, int]
    documents: int = 1

    def __post_init__(self) -> None:
        self.memo: dict[str, tuple[float, int]] = {}
        self.tables = [table for _, table in _TRANSLATED]
        self.between: dict[str, tuple[int, str]] = {}
        for place, n in self.counts.items():
            if place[1] > "\x7f" and place[1] != _LOST:
                around = place[0] + place[2]
                self.between[around] = max(self.between.get(around, (0, "")), (n, place[1]))

    def count(self, place: str) -> int:
        return self.counts.get(place, 0)

    def gain(self, place: str, table: dict[str, str]) -> float:
        """How many times more frequent the place is if its characters are read by `table`, as a logarithm."""
        read = "".join(table.get(c, c) for c in place)
        if read == place:
            return 0.0
        return math.log((self.count(_folded(read[0]) + read[1] + _folded(read[2])) + 0.5) / (self.count(place) + 0.5))

    def shown(self) -> None:
        """Keep only the pairs of encodings that the corpus shows by several different characters: one alone may be anything."""
        by: list[set[str]] = [set() for _ in self.tables]
        for place in self.counts:
            gain, k = self.judged(place)
            if gain > GAIN and k >= 0:
                by[k].add(place[1])
        self.tables = [t for t, seen in zip(self.tables, by) if len(seen) >= CHARACTERS]
        self.memo.clear()

    def judged(self, place: str) -> tuple[float, int]:
        """(gain, number of the table) of the reading by which the place becomes most frequent; (gain, -1) if a lost character explains it better."""
        known = self.memo.get(place)
        if known is None:
            known = self._judge(place)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[place] = known
        return known

    def _judge(self, place: str) -> tuple[float, int]:
        c = place[1]
        if c == _LOST or _CONTROL.match(c):
            return math.inf, -1
        best, which = 0.0, -1
        for k, table in enumerate(self.tables):
            if c in table and (gain := self.gain(place, table)) > best:
                best, which = gain, k
        n = 0
        if c == "?":
            n = self.between.get(place[0] + place[2], (0, ""))[0]
        elif c in _STUMPS and (c == "â" or place[0].isalpha() or place[2].isalpha()):
            n = max((self.count(place[0] + x + place[2]) for x in _STUMPS[c]), default=0)
        lost = math.log((n + 0.5) / (self.count(place) + 0.5))
        return (lost, -1) if lost > best else (best, which)

    def odd(self, place: str) -> bool:
        return self.judged(place)[0] > GAIN

    def odd_in(self, text: str) -> int:
        """How many odd places the words of a text have; a reading has to make the whole word likelier, not one place at another's cost."""
        total = 0
        if not any(map(self.odd, places(text))):
            return 0
        for word in text.split():
            if word.isascii() and "?" not in word:
                continue
            own = places(word)
            for place, n in own.items():
                gain, k = self.judged(place)
                if gain > GAIN and (k < 0 or sum(m * self.gain(p, self.tables[k]) for p, m in own.items()) > GAIN):
                    total += n
        return total

    def likelihood(self, text: str) -> float:
        """Sum of the logarithms of the frequencies of a text's places beyond ASCII; signs without a place in the corpus cost most."""
        return sum(n * math.log((self.count(p) + 0.5) / (self.documents + 1)) for p, n in places(text).items())


def _spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, original) of the maximal well-formed spans whose original is plausible, by the encoding that explains most."""
    best: list[tuple[int, int, str]] = []
    weight = 0
    runs = [(m.start(), m.group()) for m in _RUN.finditer(text)]  # each byte of a sequence is a character beyond ASCII
    have = {c for _, run in runs for c in run}
    for codec, automaton in _AUTOMATA.items():
        if have.isdisjoint(_LEADS[codec]) or have.isdisjoint(_TAILS[codec]):
            continue
        table, found = _TABLES[codec], []
        for at, run in runs:
            for m in automaton.finditer(run):
                right = bytes(table[c] for c in m.group()).decode("utf-8")
                if _PLAUSIBLE.fullmatch(right):
                    found.append((at + m.start(), at + m.end(), right))
        size = sum(e - b for b, e, _ in found)
        if size > weight:
            best, weight = found, size
    wide = []
    for m in _WIDE.finditer(text) if max(text, default="") > "\u33ff" else ():
        for run in (m.group(), m.group().rstrip("".join(map(chr, range(0x21, 0x7F))))):
            try:
                raw = run.encode("gb18030")
                right = raw.decode("utf-8")
            except UnicodeError:
                continue
            if run and not run.isascii() and re.fullmatch("[\x20-\x7e\xa0-ſ‐-‧€]+", right):
                wide.append((m.start(), m.start() + len(run), right))
                break
    return best if sum(e - b for b, e, _ in wide) <= weight else wide


def _quoted(line: str, begin: int, end: int, right: str) -> bool:
    """A garbled sequence that stands by itself, with what it stands for by itself in the same line."""
    alone = not (begin and line[begin - 1].isalnum()) and not (end < len(line) and line[end].isalnum())
    return alone and re.search(rf"(?<!\w){re.escape(right)}(?!\w)", line[:begin] + " " + line[end:]) is not None


def _reread(line: str, habits: Habits) -> str:
    """The likeliest reading of a line with odd places: of the whole line, or of the words with such, by each pair of encodings."""
    best, most = line, habits.likelihood(line)
    words = re.split(r"(\s+)", line)
    marked = [i for i, w in enumerate(words) if habits.odd_in(w)]
    seen = {line}
    for table in habits.tables:
        whole = "".join(table.get(c, c) for c in line)
        parts = words.copy()
        for i in marked:
            parts[i] = "".join(table.get(c, c) for c in words[i])
        for other in (whole, "".join(parts)):
            if other not in seen and (now := habits.likelihood(other)) > most:
                best, most = other, now
            seen.add(other)
    return best


def _fill_lost(text: str) -> str:
    """Words with lost characters take the one word of the text that fits, if there is just one."""
    words = set(re.findall(r"[^\W\d_]{3,}", text))

    def fill(m: re.Match) -> str:
        fits = re.compile(re.escape(m.group()).replace("�", "[^\x00-\x7f]"))
        found = {w for w in words if fits.fullmatch(w)}
        return found.pop() if len(found) == 1 else m.group()

    return re.sub("[^\\W\\d_]*�[^\\W\\d_�]*(?:�[^\\W\\d_�]*)*", fill, text)


def _hidden(line: str, spans: list[tuple[int, int, str]]) -> str:
    """The line with blanks in place of some spans."""
    for begin, end, _ in spans:
        line = line[:begin] + " " * (end - begin) + line[end:]
    return line


def repair_line(line: str, habits: Habits) -> tuple[str, int]:
    """(line with its original text, garbled sequences found) — see repair."""
    found = 0
    while spans := [s for s in _spans(line) if not _quoted(line, *s)]:  # twice garbled text comes out one step a time; each step is shorter
        found += len(spans)
        out, at = [], 0
        for begin, end, right in spans:
            out += [line[at:begin], right]
            at = end
        line = "".join(out) + line[at:]
    quoted = _spans(line)
    stumps = len(_STUMP.findall(_hidden(line, quoted)))
    odd = habits.odd_in(_hidden(line, quoted))
    if stumps or odd:
        found += max(stumps, odd)
        if not quoted:
            line = _reread(line, habits)
        line = _STUMP.sub("”", line)
    return line, found


#: The first two bytes of signs of punctuation in UTF-8, E2 80, misread, whose third byte is lost; the sign lost so is most often a closing mark.
_STUMP = re.compile("â€[\x9d?\ufffd]?")


def repair(text: str, habits: Habits) -> tuple[str, int, int]:
    """(text with garbled sequences restored, sequences found, odd places that are left).

    Characters are mapped back to the bytes of a legacy encoding; an automaton over the bytes finds the maximal
    runs that are well-formed UTF-8, and only those are decoded, by the encoding that explains most of the
    line. Text garbled more than once is decoded as often. Bytes of one-byte encodings misread as each other
    have no such structure: every character beyond ASCII is judged with its neighbours by how often the corpus has such places, as it stands and as
    each pair of encodings reads it; see Habits. Lost characters are told likewise, and filled from the text's other words where one
    fits. A garbled sequence quoted beside what it stands for, and rare but right characters, stay.
    """
    if not is_garbled(text, habits):
        return text, 0, 0
    lines, total = [], 0
    for line in text.split("\n"):
        found = 0
        if not line.isascii() or "?" in line:
            line, found = repair_line(line, habits)
        lines.append(line)
        total += found
    out = "\n".join(lines)
    if total and _LOST in out:
        out = _fill_lost(out)
    return out, total, habits.odd_in(out) if total else 0


def is_garbled(text: str, habits: Habits) -> bool:
    """Whether repair would find a sequence."""
    if text.isascii() and "?" not in text:
        return False
    if not (_STUMP.search(text) or habits.odd_in(text) or _spans(text)):
        return False
    for line in text.split("\n"):
        if line.isascii() and "?" not in line:
            continue
        spans = _spans(line)
        if any(not _quoted(line, *s) for s in spans):
            return True
        rest = _hidden(line, spans)
        if _STUMP.search(rest) or habits.odd_in(rest):
            return True
    return False


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`place, n` of each batch: the documents with each place."""
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in batch.column("body").to_pylist():
            if text and not (text.isascii() and "?" not in text):
                seen.update(places(text).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["place", "n"])


def habits_of(bodies: DataFrame) -> Habits:
    """In how many of all bodies each place stands.

    Places seen once tell nothing that an unseen one doesn't, so all those in at least LEAST documents come to the driver. The most frequent are kept in a dict,
    PLACES at most, by classes of frequency an eighth of an octave wide; the others are kept packed, none is left out.
    """
    counted = checkpointed(bodies.mapInArrow(_counted, "place string, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST))
    octave = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, 1 << 30
    for o, n in sorted(counted.groupBy(octave.alias("o")).count().collect(), reverse=True):  # a few hundred rows
        total += n
        if total > PLACES:
            break
        least = o
    kept = counted.where(octave >= least).toArrow()
    rest = counted.where(octave < least).toArrow() if total > PLACES else kept.slice(0, 0)
    counts = tiered(dict(zip(kept.column("place").to_pylist(), kept.column("n").to_pylist())), rest.column("place").to_pylist(), rest.column("n").to_numpy())
    habits = Habits(counts, bodies.count())
    habits.shown()
    return habits


def _run(write: bool, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        habits = Habits(*shared.value[:2])
        habits.tables = shared.value[2]
        for batch in batches:
            texts = batch.column("body").to_pylist()
            if not write:
                yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([bool(t) and is_garbled(t, habits) for t in texts])], names=["path", "found"])
                continue
            done = [repair(t, habits) if t else (t, 0, 0) for t in texts]
            found, left = (pa.array([d[k] for d in done], pa.int32()) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("head"), pa.array([d[0] for d in done], pa.string()), found, left], names=["path", "head", "body", "found", "left"])

    return run


def _shared(bodies: DataFrame):
    habits = habits_of(bodies)
    return bodies.sparkSession.sparkContext.broadcast((habits.counts, habits.documents, habits.tables))  # PLACES in a dict, the others in 23 to 32 bytes each


def garbled(docs: DataFrame) -> DataFrame:
    """Documents whose body has a garbled sequence: `path`, each once.

    Null content and null path have none; rows with the same path count as one document.
    """
    rows = spread(docs.where("path IS NOT NULL AND content IS NOT NULL").select("path", body().alias("body")))
    return rows.mapInArrow(_run(False, _shared(rows.select("body"))), "path string, found boolean").where("found").select("path").distinct()


def restored(docs: DataFrame) -> DataFrame:
    """Every row with its body restored: `path, content, found, left`.

    found counts the garbled sequences, left the odd places that remain. The header stays as it is. Null content
    stays null; rows delivered twice come out twice; an empty table gives no row.
    """
    rows = spread(docs.select("path", F.coalesce(header(), F.lit("")).alias("head"), body().alias("body")))
    done = rows.mapInArrow(_run(True, _shared(rows.select("body"))), "path string, head string, body string, found int, left int")
    return done.select("path", F.concat("head", "body").alias("content"), "found", "left")
