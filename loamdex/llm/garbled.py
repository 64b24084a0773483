"""Text that was decoded with a wrong character encoding.

1. *Twins.*  A form is a word that holds ASCII letters and others, or a clause
   with three or more runs of non-ASCII characters.  Its key is what stays when
   those runs are stripped, with their places, for clauses also with their
   lengths; a clause whose lengths share a divisor has a key for each (a
   character may have become two or three).  Within a key the form that most
   texts hold is the clean one; each other form that is ``ratio`` times as rare
   is its possible garbled twin.  So a key costs as many alignments as it has
   forms, however many those are.
2. *Transformations.*  Twins are aligned run by run and, as far as lengths
   tell, character by character.  A sequence that stands for one and the same
   character in most of its twins, in two or more, is a mapping; what clean
   forms show of a character counts against it.  Nothing up to here knows of
   encodings.  The mappings are then explained by as few pairs of encodings as
   possible (written with one, read with the other), each by two mappings or
   more that no other pair explains, or by one beside three that others explain
   too; they carry over to characters that no twin showed.  Twins that lost bytes which the reader does not have are aligned
   once the reader is known, and give a table from sequences to characters.
3. *Application.*  One scan applies the learned transformations to every run of
   non-ASCII characters of every text, takes back the one that a character
   bigram model of the corpus prefers over the whole text, and repeats that for
   text that was garbled in several ways.  A sequence that a text puts in
   quotation marks or in code marks by itself is a quotation, not damage.

Beside what is learned so, three fixed rules stand: the pairs in
``ALWAYS``, whose readings prove themselves as valid UTF-8; characters that
nobody writes (U+FFFD, C1 controls, long runs of signs of the upper half of a
one-byte encoding); and references that spell the bytes of one character.
Encodings of two bytes a character swallow neighbours and leave no twins to
align; for pairs with one of them (``_guess``) each unit's possible original is
looked up among the units of the corpus instead.

Counts of forms, units and bigrams, by text, cover all texts.  The model that
is sent to the workers has a fixed number of bigram cells, one entry for each
pair of encodings, and one for each character that lost bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.runtime import materialize

from .hashing import pieces

# Names of encodings.
READERS = "cp1252 latin-1 iso8859-15 cp1254 cp1250 iso8859-2 cp1251 cp1253 cp437 cp850 cp866 koi8-r mac_roman gbk".split()
WRITERS = "utf-8 cp1252 cp1251 koi8-r cp866 iso8859-5 cp1253 cp1254 cp1250 iso8859-2 gbk big5 cp932 euc-jp euc-kr".split()

#: Cells of the bigram model.
CELLS = 1 << 18

_RUN = re.compile(r"[^\x00-\x7f]+")
#: Two or more references in a row, by number or by name.
_REF = re.compile(r"(?:&(?:#[0-9]{2,4}|#[xX][0-9a-fA-F]{2,4}|[A-Za-z]{2,8}[0-9]{0,2});){2,}")
_UNIT = re.compile(r"[A-Za-z]*[^\x00-\x7f]+(?:[A-Za-z]+[^\x00-\x7f]+)*[A-Za-z]*")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_QUOTES = "\"'`“”‘’„‚«»‹›「」『』"
#: Runs of the upper half of one-byte encodings; no language writes five of their letters or signs in a row.
_UPPER = re.compile("[\x80-\u024f‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™›€]{5,}")
_SIGNS = re.compile("[\xa1-\u024f]")
_LOST = "�"


def write(text: str, encoding: str) -> bytes | None:
    """Bytes of a text; C1 controls stand for themselves in the Windows encodings; None if not writable."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def read(data: bytes, encoding: str) -> str | None:
    """The text of some bytes, strictly; None if they are not valid."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def _script(text: str) -> tuple[str, ...]:
    """Readers that can have produced a text, by its characters."""
    top = max(text)
    if top >= "　":
        return ("gbk",)
    if any("Ͱ" <= c < "Ѐ" for c in text):
        return ("cp1253", "cp437")
    if any("Ѐ" <= c < "Ԁ" for c in text):
        return ("cp1251", "cp866", "koi8-r")
    if any("─" <= c < "☀" for c in text):
        return ("cp437", "cp850", "cp866", "koi8-r")
    return tuple(r for r in READERS if r not in ("gbk", "cp1253", "cp1251", "cp866", "koi8-r")) + ("cp1251", "cp1253")


_WIDE = frozenset(["gbk", "big5", "cp932", "euc-jp", "euc-kr"])
#: Writers by reader, of the pairs with an encoding of two bytes a character.
WIDE_PAIRS = {"gbk": ("utf-8",)} | {r: tuple(w for w in WRITERS if w in _WIDE) for r in ("latin-1", "cp1252")}
#: Pairs that are tried without having been learned.
ALWAYS = frozenset([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gbk")])


def readings(text: str, pairs: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, str, str]]:
    """(writer, reader, original) for each pair of encodings that turns some original into ``text``."""
    wide = any(len(r) > 3 for r in _RUN.findall(text))  # two characters of a two-byte encoding
    for reader in _script(text):
        if reader not in pairs or (data := write(text, reader)) is None:
            continue
        for writer in pairs[reader]:
            if writer in _WIDE and not wide:
                continue
            original = read(data, writer)
            if original is not None and original != text and _LOST not in original:
                yield writer, reader, original


def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Model cell of each character pair; both are code points as uint32."""
    x = a * np.uint32(0x9E3779B1) ^ (b + np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 18)


def _cell(a: str, b: str) -> int:
    x = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ ((ord(b) + 0x7F4A7C15) * 0x85EBCA6B & 0xFFFFFFFF)
    x ^= x >> 15
    return (x * 0xC2B2AE35 & 0xFFFFFFFF) >> 14


def skeleton(unit: str) -> str:
    return _RUN.sub("", unit)


#: ASCII signs and controls that end a clause; the blank and the hyphen do not.
_CLAUSE = re.compile(r"[^\x00-\x1f!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~]+")
#: Characters that one character becomes at most.
SHARES = (1, 2, 3)


def forms_of(text: str, units: set[str] | None = None) -> set[tuple[int, str, int]]:
    """(key, form, share) of a text's words and clauses; ``share`` is what a clause's lengths were divided by."""
    out = set()
    for unit in units if units is not None else set(_UNIT.findall(text)):
        if sum(map(str.isascii, unit)) > 1:
            out.add((_key("w" + _RUN.sub("\0", unit)), unit, 1))
    for clause in set(_CLAUSE.findall(text)):
        if clause.isascii():
            continue
        sizes = [len(r) for r in _RUN.findall(clause)]
        if len(sizes) > 2:
            for share in SHARES:
                if not any(n % share for n in sizes):
                    out.add((_key("c" + _RUN.sub(lambda m, n=share: f"\0{len(m.group()) // n}", clause)), clause, share))
    return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def align(clean: str, garbled: str) -> set[tuple[str, str]]:
    """(sequence, character) of twins: runs in order; a run of n characters is cut evenly where the garbled one has a multiple of n."""
    out = set()
    for c, g in zip(_RUN.findall(clean), _RUN.findall(garbled)):
        if len(g) % len(c) == 0 and len(g) <= 12 * len(c):
            share = len(g) // len(c)
            out.update((g[i * share : (i + 1) * share], x) for i, x in enumerate(c))
    return out


_COUNTS = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()), T.StructField("value", T.StringType()), T.StructField("share", T.IntegerType()), T.StructField("n", T.LongType())]
)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per form (kind 'form'), per unit (kind 'unit') and per bigram cell (kind 'cell')."""
    cells = np.zeros(CELLS, np.int64)
    forms: Counter[tuple[int, str, int]] = Counter()
    units: Counter[str] = Counter()

    def out(kind: str, keys: list[int], values: list[str], shares: list[int], counts: list[int]) -> pa.RecordBatch:
        columns = [pa.array([kind] * len(keys)), pa.array(keys, pa.int64()), pa.array(values, pa.string()), pa.array(shares, pa.int32()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=_COUNTS.names)

    def flush() -> Iterator[pa.RecordBatch]:
        yield out("form", *map(list, zip(*forms)), list(forms.values())) if forms else out("form", [], [], [], [])
        yield out("unit", [0] * len(units), list(units), [0] * len(units), list(units.values()))
        forms.clear(), units.clear()

    for batch in pieces(batches, 0):
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            codes = np.frombuffer("\n".join(part).encode("utf-32-le", "replace"), np.uint32)
            owner = np.repeat(np.arange(len(part)), [len(t) + 1 for t in part])[: len(codes)]
            pairs = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
            # a text counts once for a cell, so that a long garbled text weighs no more than a short one
            once = np.unique(owner[pairs] * CELLS + cell(codes[pairs], codes[pairs + 1]))
            cells += np.bincount(once % CELLS, minlength=CELLS)
        for text in texts:
            mine = set(_UNIT.findall(text))
            forms.update(forms_of(text, mine))
            units.update(mine)
        if len(forms) + len(units) > 200_000:
            yield from flush()
    yield from flush()
    used = np.flatnonzero(cells)
    if len(used):
        yield out("cell", used.tolist(), [""] * len(used), [0] * len(used), cells[used].tolist())


_CANDIDATES = T.StructType([T.StructField(c, T.StringType()) for c in ("skeleton", "clean", "garbled", "writer", "reader")] + [T.StructField("n_garbled", T.LongType())])


def _guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit all originals that some pair with an encoding of two bytes could have garbled into it."""
    for batch in batches:
        rows = []
        for unit, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(unit) < 3:  # a single character tells nothing about the encoding
                continue
            for writer, reader, original in readings(unit, WIDE_PAIRS):
                if len(original) > 2 and _RUN.search(original) and skeleton(original) == skeleton(unit):
                    rows.append((skeleton(unit), original, unit, writer, reader, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_CANDIDATES.names)


#: Readers that leave out bytes they do not have.
_DROPPING = ("cp1252", "cp1250")

_ALIGNED = T.StructType([T.StructField("sequence", T.StringType()), T.StructField("character", T.StringType()), T.StructField("n", T.LongType())])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twins of each (sequence, character); a form beside itself counts for its own letters, not for signs, which stand anywhere."""
    seen: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for clean, garbled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update(align(clean, garbled) if clean != garbled else {(c, c) for c in garbled if c.isalpha()})
    if seen:
        sequences, characters = zip(*seen)
        yield pa.RecordBatch.from_arrays([pa.array(sequences), pa.array(characters), pa.array(list(seen.values()), pa.int64())], names=_ALIGNED.names)


def become(character: str, writer: str, reader: str, lossy: bool = False) -> str | None:
    """What a character becomes; C1 controls stand for bytes that a Windows encoding does not have, or those are left out."""
    data = write(character, writer)
    if data is None:
        return None
    if lossy:
        return data.decode(reader, "ignore")
    got = read(data, reader)
    if got is None and reader.startswith("cp125"):
        got = "".join(read(bytes([b]), reader) or chr(b) for b in data)
    return got


def explain(mappings: dict[str, str], least: int) -> set[tuple[str, str]]:
    """The pairs of encodings behind mappings from sequences to characters."""
    behind = {(w, r): {s for s, c in mappings.items() if become(c, w, r) == s} for r in READERS for w in WRITERS if w != r}
    pairs, left = set(), set(mappings)
    while True:
        best = max(behind, key=lambda p: (len(behind[p] & left), len(behind[p])))  # then the first in the order of the names
        if (new := len(behind[best] & left)) < least and (not new or len(behind[best]) < least + 2):
            break
        pairs.add(best)
        left -= behind[best]
    return pairs


def align_lost(clean: str, garbled: str, reader: str) -> dict[str, str]:
    """Garbled sequence of each non-ASCII character of a twin that lost bytes; none if they do not line up."""
    out, at = {}, 0
    for c in clean:
        piece = c if c.isascii() else become(c, "utf-8", reader, lossy=True)
        if piece is None or not garbled.startswith(piece, at):
            return {}
        if not c.isascii() and len(piece) > 1:
            out[piece] = c
        at += len(piece)
    return out if at == len(garbled) else {}


_LOSSY = T.StructType([T.StructField(c, T.StringType()) for c in ("clean", "garbled", "reader")] + [T.StructField("n_clean", T.LongType())])


def _lose(readers: list[str]):
    """The mapper from clean units to what they become when a reader leaves bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unit.encode("utf-8", "ignore")
                for reader in readers:
                    if read(data, reader) is None and len(lost := data.decode(reader, "ignore")) > 1:
                        rows.append((unit, lost, reader, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_LOSSY.names)

    return run


def _aligned_lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*r, 1) for c, g, e in zip(*(batch.column(i).to_pylist() for i in range(3))) for r in align_lost(c, g, e).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=_ALIGNED.names)


@dataclass
class Model:
    """What the scan needs: learned pairs of encodings, aligned sequences and the bigram model."""

    pairs: frozenset[tuple[str, str]]
    cells: np.ndarray
    sequences: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.floor = log2(float(self.cells.sum()) + CELLS)
        self.by_reader = {r: tuple(w for w in WRITERS if (w, r) in self.pairs) for r in READERS}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.sequences, key=len, reverse=True)))) if self.sequences else None
        self.utf8 = {r: ("utf-8",) for r in READERS if ("utf-8", r) in self.pairs and r not in _LOOSE}

    def cost(self, text: str) -> tuple[float, int]:
        """(bits, number) of the character pairs of a text; pairs of ASCII characters do not count."""
        total, n = 0.0, 0
        for a, b in zip(text, text[1:]):
            if a > "\x7f" or b > "\x7f":
                total += self.floor - log2(self.cells[_cell(a, b)] + 0.5)
                n += 1
        return total, n


#: Readers whose letters lie where UTF-8 has its bytes: their words can be valid sequences by chance.
_LOOSE = frozenset(["cp866", "koi8-r", "cp1251", "cp1253", "gbk"])


class Reader:
    """Restores texts with a model; what a run can be read as is kept for runs seen before."""

    def __init__(self, model: Model, strong: float, weak: float):
        self.model, self.strong, self.weak = model, strong, weak
        self.seen: dict[tuple[str, str, str], dict[tuple[str, str], tuple[str, float]]] = {}

    def options(self, before: str, run: str, after: str) -> dict[tuple[str, str], tuple[str, float]]:
        """For each pair of encodings that makes a run more likely: (restored run, gain in bits)."""
        key = (before, run, after)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._judge(before, run, after)
        return self.seen[key]

    def _gain(self, old: str, new: str, writer: str, reader: str) -> float:
        """Bits won by reading ``new`` for ``old``.

        A reading must consist of pairs that the corpus knows, so that it does
        not win by being shorter; one of the same length must be likelier by
        three bits a pair, so that common letters do not replace rare but
        proper signs.
        """
        (bits, n), (less, m) = self.model.cost(old), self.model.cost(new)
        if not n:
            return 0.0
        known = not m or less / m <= self.model.floor - 3.0  # its pairs are found in the corpus
        if writer == "utf-8" and reader not in _LOOSE:
            if not known and bits / n < less / m:
                return 0.0
            bits += 2.0 * (len(old) - len(new))  # strict sequences seldom come about by chance
        elif not known or len(new) == len(old) and bits / n - less / m < 3.0:
            return 0.0
        return max(0.0, bits - less)

    def _judge(self, before: str, run: str, after: str) -> dict[tuple[str, str], tuple[str, float]]:
        out = {}
        old = before + run + after
        for writer, reader, original in readings(run, self.model.by_reader):
            won = self._gain(old, before + original + after, writer, reader)
            if writer == "utf-8":
                for deep in self._deeper(original):  # garbled more than once: what is between may be as unlikely
                    more = self._gain(old, before + deep + after, writer, reader)
                    if more > won:
                        original, won = deep, more
            if won >= self.weak or writer == "utf-8" and reader not in _LOOSE:
                out[writer, reader] = (original, won)
        for reader in _script(run):  # parts of the run
            if ("utf-8", reader) in self.model.pairs and ("utf-8", reader) not in out and reader not in ("cp866", "koi8-r", "gbk"):
                part, won = self._parts(before, run, after, reader)
                if won >= self.weak:
                    out["utf-8", reader] = (part, won)
        if self.model.pattern is not None and not (run[0] in _QUOTES and run[-1] in _QUOTES):
            whole = self.model.pattern.sub(lambda m: self.model.sequences[m.group()], run)
            if whole != run and (won := self._gain(old, before + whole + after, "utf-8", "cp1252")) >= self.weak:
                out["aligned", ""] = (whole, won)
        return out

    def _deeper(self, text: str) -> list[str]:
        """Originals of an original, by UTF-8 written once or twice more."""
        out, level = [], [text]
        for _ in range(2):
            level = [o for t in level if _RUN.search(t) for w, _, o in readings(t, self.model.utf8)]
            out += level
        return out

    def _parts(self, before: str, run: str, after: str, reader: str) -> tuple[str, float]:
        """The run with its valid UTF-8 sequences restored, except those that stand alone in quotation marks."""
        data = write(run, reader)
        if data is None or len(data) != len(run):  # some characters are not the reader's
            data = b"".join(b if (b := write(c, reader)) is not None and len(b) == 1 else b"?" for c in run)
        out, last, won = "", 0, 0.0
        for m in _UTF8.finditer(bytes(data)):
            original = read(m.group(), "utf-8")
            if original is None:
                continue
            a, b = m.span()
            left, right = (run[a - 1] if a else before), (run[b] if b < len(run) else after)
            if left and right and left in _QUOTES and right in _QUOTES:
                continue
            g = self._gain(left + run[a:b] + right, left + original + right, "utf-8", reader)
            if g > 0:
                out += run[last:a] + original
                last, won = b, won + g
        return (out + run[last:], won) if won else (run, 0.0)

    def text(self, text: str) -> tuple[str, float, bool]:
        """(restored text, gain in bits, whether characters were lost)."""
        total = 0.0
        if "&" in text:
            text, total = self._references(text)
        while True:  # each round makes the text shorter or likelier
            text, gain = self._round(text, self.strong if total < self.strong else self.weak)
            if not gain:
                break
            total += gain
        noise = any(len(_SIGNS.findall(m.group())) >= 3 for m in _UPPER.finditer(text))
        lost = any(not _quoted(text, m.start(), m.end()) for m in re.finditer(_LOST + "+", text))
        control = any(not _quoted(text, m.start(), m.end()) for m in re.finditer("[\x80-\x84\x86-\x9f]", text))
        return text, total + (self.strong if lost or control or noise else 0.0), lost or control or noise

    def _round(self, text: str, least: float) -> tuple[str, float]:
        """One pair of encodings, the one that wins most over the whole text, taken back."""
        runs = []
        totals: Counter[tuple[str, str]] = Counter()
        for m in _RUN.finditer(text):
            a, b = m.span()
            if _quoted(text, a, b):
                continue
            got = self.options(text[a - 1 : a] if a else "", m.group(), text[b : b + 1])
            if got:
                runs.append((a, b, got))
                for pair, (_, gain) in got.items():
                    totals[pair] += gain
        if not totals:
            return text, 0.0
        best, gain = max(totals.items(), key=lambda x: (x[1], x[0]))
        if gain < least:
            return text, 0.0
        out, last = [], 0
        for a, b, got in runs:
            if best in got:
                out += [text[last:a], got[best][0]]
                last = b
        return "".join(out) + text[last:], gain

    def _references(self, text: str) -> tuple[str, float]:
        """References, by number or name, to the single bytes of multi-byte characters, read as those characters."""
        total, out, last = 0.0, [], 0
        for m in _REF.finditer(text):
            if _quoted(text, *m.span()):
                continue
            named = unescape(m.group())
            if "&" in named or named.isascii() or (data := write(named, "cp1252") or write(named, "latin-1")) is None:
                continue
            original = read(data, "utf-8")
            if original is not None and original != named:
                out += [text[last : m.start()], original]
                last, total = m.end(), total + self.strong
        return "".join(out) + text[last:], total


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] stands by itself between quotation or code marks, which may be part of the run."""
    left, right = text[a - 1 : a], text[b : b + 1]
    run = text[a:b]
    if left and right and left in "\"'`" and right in "\"'`":
        return True
    return len(run) > 2 and run[0] in _QUOTES and run[-1] in _QUOTES and not any(c in _QUOTES for c in run[1:-1])


def learn(texts: DataFrame, least_twins: int = 2, ratio: float = 3.0) -> Model:
    """The model of a corpus; ``texts`` has one column of non-null texts with non-ASCII characters."""
    counts = materialize(texts.mapInArrow(_count, _COUNTS).groupBy("kind", "key", "value", "share").agg(F.sum("n").alias("n")), "forms")
    forms = counts.where("kind = 'form'").select("key", F.col("value").alias("form"), "share", "n")
    own = F.when(F.col("share") == 1, F.struct("n", "form"))
    tops = forms.groupBy("key").agg(F.max(own).alias("top"), F.count(F.lit(1)).alias("forms")).where("forms > 1 and top is not null")
    twins = forms.join(tops.select("key", F.col("top.form").alias("clean"), F.col("top.n").alias("n_clean")), "key")
    twins = twins.where(F.col("n_clean") >= F.when(F.col("form") == F.col("clean"), ratio).otherwise(ratio * F.col("n")))
    seen = twins.select("clean", "form").mapInArrow(_aligned, _ALIGNED).groupBy("sequence", "character").agg(F.sum("n").alias("n"))
    best = seen.groupBy("sequence").agg(F.max(F.struct("n", "character")).alias("b"), F.sum("n").alias("all"))
    kept = best.where((F.col("b.n") >= least_twins) & (2 * F.col("b.n") >= F.col("all")) & (F.col("b.character") != F.col("sequence")))
    # at most one row for each sequence that some character has become
    pairs = explain({r["sequence"]: r["character"] for r in kept.select("sequence", "b.character").orderBy("sequence").collect()}, least_twins)
    units = counts.where("kind = 'unit'").select(F.col("value").alias("unit"), "n")
    common = units.where("n >= 2").select(F.col("unit").alias("clean"), F.col("n").alias("n_clean"))
    wide = units.mapInArrow(_guess, _CANDIDATES).join(common, "clean").where(F.col("n_clean") >= ratio * F.col("n_garbled"))
    support = wide.groupBy("writer", "reader").agg(F.countDistinct("garbled").alias("twins")).where(F.col("twins") >= least_twins)
    pairs |= {(r["writer"], r["reader"]) for r in support.collect()}  # at most one row for each pair of names
    pairs |= ALWAYS
    dropping = [r for r in _DROPPING if ("utf-8", r) in pairs]
    garbled = units.select(F.col("unit").alias("garbled"), F.col("n").alias("n_garbled"))
    lossy = common.mapInArrow(_lose(dropping), _LOSSY).join(garbled, "garbled").where(F.col("n_clean") >= ratio * F.col("n_garbled"))
    lost = lossy.select("clean", "garbled", "reader").mapInArrow(_aligned_lost, _ALIGNED).groupBy("sequence", "character").count()
    best = lost.groupBy("sequence").agg(F.max(F.struct("count", "character")).alias("b")).select("sequence", "b.character")
    sequences = {r["sequence"]: r["character"] for r in best.collect()}  # at most one row for each character of Unicode
    cells = np.zeros(CELLS, np.float32)
    for r in counts.where("kind = 'cell'").select("key", "n").collect():  # at most CELLS rows
        cells[r["key"]] = r["n"]
    return Model(frozenset(pairs), cells, sequences)


_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("restored", T.StringType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("whole", T.BooleanType()),
    ]
)


def garbled_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_twins: int = 2,
    strong: float = 8.0,
    weak: float = 3.0,
) -> DataFrame:
    """(doc_id, restored, gain, whole) of each text that holds wrongly decoded characters.

    ``restored`` is the text with every run replaced that can be restored,
    ``whole`` tells that no character was lost for good.  ``gain`` is the
    number of bits by which the bigram model prefers the restored text; a text
    is found from ``strong`` bits, and a run counts from ``weak`` bits.

    Null, empty and pure ASCII texts without references are never found.  Each
    repeated row is judged by itself.  Other columns are ignored.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("text").rlike(r"[^\x00-\x7F]|&#[0-9xX]|&[A-Za-z0-9]+;&"))
    model = learn(texts.select("text"), least_twins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, strong, weak)
        for batch in pieces(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fixed, gain, lost = reader.text(text)
                if gain >= strong:
                    rows.append((doc, fixed, gain, not lost))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.float64(), pa.bool_()])], names=_FOUND.names)

    return texts.mapInArrow(run, _FOUND)
