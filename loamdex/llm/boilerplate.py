"""The article's own blocks of web pages, by a conditional random field over DOM leaf blocks.

*Records.*  A page gives the blocks of visible text between block-level tags; a
text that was scraped from a page gives its lines.

*Labels.*  Pages on which the source's own main-content selectors fit, and
whose h1 lies inside what they select, label themselves: the article is what
the h1's parent element holds, without navigation elements, without text that
the source repeats on many urls, and without the lists that hang on such a
repeated heading.  A bounded sample of them trains two fields: one with
ancestor-tag and text features for pages, one with text features only for
lines; the second sees the same pages written out line by line.

*Counts.*  On how many urls of its source a block's letters are found is
counted over all records (two narrow shuffles of hashes, combined on the map
side), and what is frequent is a feature for both fields.

*Decoding.*  One map over each table; records of like length go through
Viterbi together.  Nothing of the texts is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.functions.html import INLINE, Page, block_texts, fold, select
from loamdex.runtime import counted, frequent_keys, join_bounded, materialize

from .crf import Chain, Sequences
from .hashing import pieces, signed

#: Hashed feature space; the last id is kept for the bias.
SIZE = 1 << 16

_CODE = re.compile(r"[(){}\[\]=;$#<>_]")
_STOP = re.compile(r"[.!?。！？…][\"'”’»)]*$")
_USER = re.compile(r"[\w.-]{3,20}: ")
_RANDOM = re.compile(r"^(?=.*\d)[0-9a-z]{4,8}$")


class Ids(dict):
    """Feature name to id."""

    def __missing__(self, name: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[name] = zlib.crc32(name.encode("utf-8", "replace")) % (SIZE - 1)
        return value


@dataclass
class Block:
    """One block or line; ``tags`` are features of its place in the DOM, empty for lines."""

    text: str
    tags: tuple[str, ...] = ()
    element: int = 0


#: All ASCII bytes but letters.
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def line_key(source: str, text: str) -> int | None:
    """Hash of a block's letters (and other non-ASCII characters) within its source, case folded; None if it has none."""
    letters = text.lower().encode("utf-8", "replace").translate(None, _NOT_LETTERS)
    return xxhash.xxh3_64_intdigest(letters, _seed(source)) if letters else None


@lru_cache(maxsize=4096)
def _seed(source: str) -> int:
    return xxhash.xxh3_64_intdigest(source)


class Places:
    """Features of an element's place: its tags upward, the words of their classes, ids and roles, and its way to the h1's parent.

    Elements with the same chain of start tags share a number, and a number's
    features are made once.
    """

    def __init__(self):
        self.numbers: dict[tuple[int, str, str], int] = {}
        self.made: dict[tuple, tuple[str, ...]] = {}

    def of(self, page: Page, levels: dict[int, int]) -> "PagePlaces":
        if len(self.numbers) > 200_000:
            self.numbers.clear()
            self.made.clear()
        return PagePlaces(self, page, levels)


class PagePlaces:
    def __init__(self, places: Places, page: Page, levels: dict[int, int]):
        self.made, self.page = places.made, page
        numbers, tags, raw, parent = places.numbers, page.tags, page.raw, page.parent
        self.number, self.away = [0], [-1]
        #: child of the h1's parent element that the element is or lies in, and the depth below it
        self.below, self.depth = [0], [0]
        #: nearest block-level element, link and h1 at or above the element
        self.leaf, self.link, self.head = [0], [0], [0]
        home = next((e for e, d in levels.items() if d == 0), -1)
        for e in range(1, len(tags)):
            up = parent[e]
            tag = tags[e]
            if tag in INLINE:  # shares its parent's place
                self.number.append(self.number[up]), self.away.append(self.away[up])
                self.leaf.append(self.leaf[up]), self.link.append(e if tag == "a" else self.link[up]), self.head.append(self.head[up])
                self.below.append(self.below[up]), self.depth.append(self.depth[up])
                continue
            self.leaf.append(e), self.link.append(self.link[up]), self.head.append(e if tag == "h1" else self.head[up])
            key = (self.number[up], tag, raw[e])
            self.number.append(numbers.setdefault(key, len(numbers) + 1))
            self.away.append(levels[e] if e in levels else self.away[up])
            if up == home and e not in levels:
                self.below.append(e), self.depth.append(1)
            else:
                self.below.append(self.below[up]), self.depth.append(self.depth[up] + 1 if self.below[up] else 0)
        self.levels = bool(levels)

    def features(self, leaf: int) -> tuple[str, ...]:
        page, below = self.page, self.below[leaf]
        way = (min(self.away[leaf], 3), page.tags[below] if below else "-", min(self.depth[leaf], 3), bool(below and page.raw[below].strip()), self.levels)
        key = (self.number[leaf], way)
        got = self.made.get(key)
        if got is None:
            got = self.made[key] = self._make(leaf, *way)
        return got

    def _make(self, leaf: int, away: int, child: str, depth: int, marked: bool, levels: bool) -> tuple[str, ...]:
        path = self.page.path(leaf)
        tags = [self.page.tags[e] for e in path]
        out = {f"tag:{tags[0] if tags else ''}", f"up2:{'<'.join(tags[:2])}", f"up3:{'<'.join(tags[:3])}"}
        out.update(f"in:{t}" for t in tags)
        for e in path:
            attrs = self.page.attributes(e)
            for name in ("class", "id", "role"):
                out.update(f"{name}:{'?' if _RANDOM.match(w) else w}" for w in attrs.get(name, "").lower().split())
        out.add("h1:none" if not levels else "h1:apart" if away < 0 else f"h1:{away}")
        if away == 0:
            out.update((f"child:{child}", f"child:{child}:{depth}:{marked}"))
        return tuple(sorted(out))


def page_blocks(html: str, places: Places) -> tuple[list[Block], str, Page]:
    """(blocks, title, page); the title is the text of the h1."""
    page = Page(html)
    h1 = page.tags.index("h1") if "h1" in page.tags else 0
    levels = {e: d for d, e in enumerate(page.path(page.parent[h1]))} if h1 else {}
    here = places.of(page, levels)
    links: Counter[int] = Counter()
    size: Counter[int] = Counter()
    kinds: dict[int, str] = {}
    for el, block, text in page.pieces:
        n = len(text)
        size[block] += n
        if a := here.link[el]:
            links[block] += n
            href = page.attributes(a).get("href", "")
            kinds[block] = "up" if href.startswith("..") else "root" if href.startswith("/") else "abs" if ":" in href else "rel" if href.endswith("/") else "other"
    title, out = "", []
    for el, block, raw in page.blocks():
        leaf = here.leaf[el]
        if h1 and not title and here.head[leaf] == h1:
            title = fold(raw)
        share = links[block] / max(1, size[block])
        link = ("link:all", f"href:{kinds[block]}") if share > 0.8 else ("link:some",) if share else ("link:none",)
        out.append(Block(raw, here.features(leaf) + link, leaf))
    return out, title, page


def line_blocks(text: str) -> list[Block]:
    """Lines of a scraped text that show something; separated by \\n only."""
    return [Block(line) for line in text.split("\n") if line.strip()]


def _shape(n: int) -> str:
    return "1" if n == 1 else "2" if n == 2 else "3" if n == 3 else "6" if n < 7 else "12" if n < 13 else "25" if n < 26 else "99"


def _script(text: str) -> str:
    for c in text:
        if c.isalpha():
            return "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic" if c < "԰" else "wide"
    return "none"


def _near_names(b: str, before: str, after: str) -> tuple[str, ...]:
    return "b:" + b, "p:" + before, "n:" + after, "pn:" + before + after, "bp:" + b + before, "bn:" + b + after


def _text_names(b: str, end: str, begin: str, script: str, code: int, bars: int, rep: int, crumbs: bool, site: bool, user: bool) -> tuple[str, ...]:
    return f"e:{end}", f"f:{begin}", f"be:{b}{end}", f"c:{code}", f"sc:{script}", f"|:{bars}", f"rep:{rep}", f">:{crumbs}", f"site:{site}", f"user:{user}"


def _where_names(b: str, side: str, back: str, fore: str, plain: bool, pos: int, tail: int, top: int) -> tuple[str, ...]:
    return f"side:{side}", f"sb:{side}{b}", f"back:{back}", f"fore:{fore}", f"bf:{back}{fore}{plain}", f"pos:{pos}", f"tail:{tail}", f"top:{top}"


@dataclass
class Records:
    """Feature ids of the blocks of many records; see :class:`loamdex.llm.crf.Sequences`."""

    ids: list[int] = field(default_factory=list)
    bounds: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=list)
    word_bounds: list[int] = field(default_factory=lambda: [0])
    scale: list[float] = field(default_factory=list)
    ends: list[int] = field(default_factory=lambda: [0])

    def stacked(self) -> Sequences:
        number = lambda x: np.array(x, np.int64)
        return Sequences(number(self.ids), number(self.bounds), number(self.words), number(self.word_bounds), np.array(self.scale), number(self.ends))


class Features:
    """Turns records into feature ids.  What a few small traits determine is looked up by the traits."""

    def __init__(self):
        self.ids = Ids()
        self.memo: tuple[dict, ...] = ({}, {}, {}, {})

    def _new(self, kind: int, traits: tuple) -> tuple[int, ...]:
        memo = self.memo[kind]
        if len(memo) > 200_000:
            memo.clear()
        names = traits if kind == 3 else (_near_names, _text_names, _where_names)[kind](*traits)
        got = memo[traits] = tuple(self.ids[x] for x in names)
        return got

    def record(self, out: Records, blocks: list[Block], texts: list[str], title: str, often: list[int], share: list[float], site: str) -> None:
        """Add the features of a record's blocks to ``out``.

        ``texts`` are the folded blocks, ``often`` the number of urls with the
        same letters (0 if few) and ``share`` their share of the source's urls.
        """
        n = len(blocks)
        low = [t.lower() for t in texts]
        words = [t.split() for t in low]
        count = Counter(texts)
        where = texts.index(title) if title and title in count else -1
        codes = [len(_CODE.findall(t)) for t in texts]
        plain = [c < 2 and len(w) <= 14 and not _STOP.search(t) for t, w, c in zip(texts, words, codes)]
        heads = [o > 0 and len(w) <= 6 and c < 2 for o, w, c in zip(often, words, codes)]
        back, fore = _runs(often, plain, heads), _runs(often[::-1], plain[::-1], heads[::-1])[::-1]
        basic = ["^"]
        for i in range(n):
            s = share[i]
            level = "0" if not often[i] else "a" if s < 0.02 else "b" if s < 0.06 else "c" if s < 0.2 else "d"
            basic.append(level + _shape(len(words[i])) + ("p" if plain[i] else "s") + ("T" if i == where else ""))
        basic.append("$")
        near, looks, place, tags = self.memo
        look_up, ids = self.ids.__getitem__, out.ids
        for i, t in enumerate(texts):
            b = basic[i + 1]
            key = (b, basic[i], basic[i + 2])
            ids += near.get(key) or self._new(0, key)
            last, first = t[-1], t[0]
            end = last if last in ".:?!;,)>…。»|" else "a" if last.isalpha() else "9" if last.isdigit() else "o"
            begin = "U" if first.isupper() else "l" if first.islower() else "9" if first.isdigit() else first if first in "©•*-–$<{" else "o"
            crumbs = ">" in t and " > " in t or "»" in t or "›" in t
            key = (b, end, begin, _script(t), min(codes[i], 4), min(t.count(" | "), 2), min(count[t], 3), crumbs, bool(site) and site in low[i], ": " in t and bool(_USER.match(t)))
            ids += looks.get(key) or self._new(1, key)
            side = "-" if where < 0 else "pre" if i < where else "is" if i == where else "post"
            key = (b, side, back[i], fore[i], plain[i], min(9, 10 * i // n), min(n - 1 - i, 3), min(i, 3))
            ids += place.get(key) or self._new(2, key)
            if key := blocks[i].tags:
                ids += tags.get(key) or self._new(3, key)
            ids.append(SIZE - 1)
            out.bounds.append(len(ids))
            w = words[i]
            if len(w) <= 30:  # longer blocks tell themselves by their shape
                grams = set(w)
                if len(w) <= 8:
                    grams.update(map("\t".join, zip(w, w[1:])))
                out.words += map(look_up, grams)
                out.scale.append(1.5 / len(grams) ** 0.5)
            else:
                out.scale.append(0.0)
            out.word_bounds.append(len(out.words))
        out.ends.append(len(out.bounds) - 1)


def _runs(often: list[int], plain: list[bool], heads: list[bool]) -> list[str]:
    """For each block what the nearest non-plain or repeated block before it is, and how far."""
    out, what, far = [], "edge", 0
    for o, p, h in zip(often, plain, heads):
        out.append(what + ("0" if far == 0 else "1" if far == 1 else "4" if far < 5 else "9" if far < 13 else "+"))
        if h:
            what, far = "head", 0
        elif o:
            what, far = "often", 0
        elif not p:
            what, far = "text", 0
        else:
            far += 1
    return out


def _select(page: Page, selector: str) -> list[int]:
    """As ``select``; a selector that is not understood fits nothing."""
    try:
        return select(page, selector)
    except ValueError:
        return []


def label_page(blocks: list[Block], page: Page, selectors: list[str], exclude: list[str], often: list[int]) -> list[bool] | None:
    """Which blocks are the article's, by the source's own selectors; None if they do not fit the page."""
    h1 = next((e for e in range(1, len(page.tags)) if page.tags[e] == "h1"), 0)
    if not h1:
        return None
    up = set(page.path(h1))
    if not any(set(_select(page, s)) & up for s in selectors):
        return None
    home = page.parent[h1]
    banned = {e for s in exclude for e in _select(page, s)} - up
    banned |= {e for e in range(1, len(page.tags)) if page.tags[e] in ("nav", "aside", "footer", "header", "button", "form", "noscript") and e not in up}
    below: list[int] = []
    for b in blocks:
        path = page.path(b.element)
        below.append(path[path.index(home) - 1] if home in path and path.index(home) else -1 if home in path else 0)
    first: dict[int, int] = {}
    for i, child in enumerate(below):
        if child > 0:
            first.setdefault(child, i)
    out = []
    for i, b in enumerate(blocks):
        child = below[i]
        ok = child != 0 and not banned & set(page.path(b.element)) and not (often[i] and page.tags[b.element] != "h1")
        if ok and child > 0 and page.tags[child] in ("section", "div") and often[first[child]] and len(fold(blocks[first[child]].text).split()) <= 6:
            ok = False
        out.append(ok)
    return out if any(out) else None


def as_lines(blocks: list[Block], labels: list[bool], often: list[int], rng: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A labelled page written out as a scraper would.

    Code comes line by line, menus joined or one by one; furniture is at times
    left out, and at times some of it stands between the article's own lines.
    """
    drop = {k for k in ("before", "between", "after") if rng.random() < 0.25}
    inside = [i for i, x in enumerate(labels) if x]
    prompts = [fold(b.text) for b, ok, n in zip(blocks, labels, often) if n and not ok and "|" not in b.text]
    stray = rng.random() * 0.4 if prompts and rng.random() < 0.7 else 0.0
    out, truth = [], []
    for i, (b, ok) in enumerate(zip(blocks, labels)):
        zone = "in" if ok else "before" if i < inside[0] else "after" if i > inside[-1] else "between"
        if zone in drop:
            continue
        parts = b.text.split("\n") if "in:pre" in b.tags else [b.text]
        if not ok and " | " in b.text and rng.random() < 0.5:
            parts = b.text.split(" | ")
        elif not ok and re.search("[»›]", b.text) and rng.random() < 0.7:
            parts = re.split("[»›]", b.text) if rng.random() < 0.6 else [re.sub("[»›]", ">", b.text)]
        for part in parts:
            if part.strip():
                out.append(Block(fold(part)))
                truth.append(ok)
                if ok and rng.random() < stray:
                    for _ in range(rng.integers(1, 4)):
                        out.append(Block(prompts[rng.integers(len(prompts))]))
                        truth.append(False)
    return out, truth


class Often:
    """Frequent letter sequences of some sources: number of urls and share of the source's urls; ``urls`` by a source's number."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, urls: dict[int, int]):
        order = np.argsort(keys)
        self.keys, self.counts, self.urls = keys[order], counts[order], urls

    def look(self, source: str, number: int, blocks: list[Block]) -> tuple[list[int], list[float]]:
        keys = [line_key(source, b.text) for b in blocks]
        if not len(self.keys):
            return [0] * len(keys), [0.0] * len(keys)
        wanted = np.array([k or 0 for k in keys], np.uint64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hits = np.where((self.keys[at] == wanted) & (wanted != 0), self.counts[at], 0).tolist()
        total = max(1, self.urls.get(number, 1))
        return hits, [h / total for h in hits]


_KEYS = T.StructType([T.StructField("number", T.LongType()), T.StructField("key", T.LongType()), T.StructField("url", T.LongType())])


def _keys(is_page: bool):
    """The mapper from (number, source, url, text) to one row for each different letter sequence of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            numbers, keys, urls = [], [], []
            for number, source, url, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                blocks = block_texts(text) if is_page else text.split("\n")
                found = {k for b in blocks if (k := line_key(source, b)) is not None}
                keys.extend(found)
                numbers.extend([number] * len(found))
                urls.extend([xxhash.xxh3_64_intdigest(url)] * len(found))
            hashes = [pa.array(signed(np.array(c, np.uint64))) for c in (keys, urls)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *hashes], names=_KEYS.names)

    return run


def count_often(pages: DataFrame, texts: DataFrame, least: int = 3, least_share: float = 0.005) -> tuple[DataFrame, DataFrame, int]:
    """Letter sequences found on ``least`` or more urls and ``least_share`` of the urls of their source.

    (lines, urls, number of lines): lines is (number, key, n), urls is (number,
    urls), where number is that of the source.  A source has at most (lines of a
    record / least_share) of them, so their number grows with the number of
    sources, not of records.
    """
    usable = [(p.where("source is not null and url is not null"), k) for p, k in ((pages, True), (texts, False))]
    rows = [p.select("number", "source", "url", "text").mapInArrow(_keys(k), _KEYS) for p, k in usable]
    keys = materialize(rows[0].unionByName(rows[1]), "block-keys")
    both = usable[0][0].select("number", "url").unionByName(usable[1][0].select("number", "url"))
    totals, n_sources = counted(both.distinct().groupBy("number").agg(F.count(F.lit(1)).alias("urls")), "source-urls")
    frequent, n_frequent = counted(frequent_keys(keys, "key", "url", least), "frequent-lines")
    named = join_bounded(keys.select("number", "key"), frequent, "key", n_frequent).groupBy("key").agg(F.min("number").alias("number"), F.first("n").alias("n"))
    lines = join_bounded(named, totals, "number", n_sources).where(F.col("n") >= least_share * F.col("urls")).select("number", "key", "n")
    return *counted(lines, "often"), totals


def _often(lines: DataFrame, totals: DataFrame, which: Column) -> Often:
    """The counts of the sources that a condition on their number picks, as workers hold them."""
    got = lines.where(which).select("key", "n").toArrow()
    urls = {r["number"]: r["urls"] for r in totals.where(which).collect()}
    return Often(got.column("key").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy(), urls)


def _site(source: str | None) -> str:
    return re.split(r"[_\W]", source or "")[0].lower()


def train(rows: list[tuple[str, int, str, list[str], list[str]]], often: Often, rounds: int = 120) -> tuple[Chain, Chain]:
    """(page field, line field) from (source, its number, html, main selectors, exclude selectors) of sampled pages."""
    features, places, rng = Features(), Places(), np.random.default_rng(3)
    page_items, page_truth, line_items, line_truth = Records(), [], Records(), []
    for source, number, html, selectors, exclude in rows:
        blocks, title, page = page_blocks(html, places)
        hits, share = often.look(source, number, blocks)
        labels = label_page(blocks, page, selectors, exclude, hits)
        if labels is None:
            continue
        features.record(page_items, blocks, [fold(b.text) for b in blocks], title, hits, share, _site(source))
        page_truth += labels
        lines, truth = as_lines(blocks, labels, hits, rng)
        hits, share = often.look(source, number, lines)
        features.record(line_items, lines, [b.text for b in lines], title if rng.random() < 0.9 else "", hits, share, _site(source))
        line_truth += truth
    chains = Chain(SIZE), Chain(SIZE)
    if page_truth:
        chains[0].fit(page_items.stacked(), np.array(page_truth), rounds)
        chains[1].fit(line_items.stacked(), np.array(line_truth), rounds)
    return chains


_OUT = T.StructType([T.StructField("rec_kind", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("block_no", T.IntegerType()), T.StructField("text", T.StringType())])


def _extract(kind: str, chain: Chain, often: Often):
    """The mapper from (rec_id, source, number, title, text) to the blocks of the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, places = Features(), Places()
        for batch in pieces(batches, 4):
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                items, owners, texts, places_in = Records(), [], [], []
                for rec, source, number, title, text in zip(*(piece.column(i).to_pylist() for i in range(5))):
                    if kind == "page":
                        blocks, title, _ = page_blocks(text, places)
                    else:
                        blocks, title = line_blocks(text), fold(title or "")
                    if not blocks:
                        continue
                    hits, share = often.look(source, number, blocks) if source is not None else ([0] * len(blocks), [0.0] * len(blocks))
                    folded = [fold(b.text) for b in blocks]
                    features.record(items, blocks, folded, title, hits, share, _site(source))
                    owners += [rec] * len(blocks)
                    texts += folded
                    places_in += range(len(blocks))
                if not owners:
                    continue
                keep = np.flatnonzero(chain.decode(items.stacked()))
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind] * len(keep)),
                            pa.array([owners[i] for i in keep], pa.int64()),
                            pa.array([places_in[i] for i in keep], pa.int32()),
                            pa.array([texts[i] for i in keep]),
                        ],
                        names=_OUT.names,
                    )

    return run


def main_blocks(pages: DataFrame, scraped: DataFrame, sources: DataFrame, sample: int = 600, rounds: int = 120, limit: int = 1_000_000) -> DataFrame:
    """(rec_kind, rec_id, block_no, text): the article's blocks of all pages and scraped texts, in order.

    ``pages`` has page_id, source_id, url, html, status_code, ``scraped`` has
    scraped_id, source_id, url, title, content, ``sources`` the scraper
    selectors by source_id.  ``sample`` bounds the labelled pages that train
    the fields; they are chosen by a hash of page_id.  Workers hold about
    ``limit`` frequent lines at a time: if there are more, the sources are
    decoded in groups, with the same result, as counts are within a source.

    Pages with a status other than 200, and null, empty and blank records, have
    no blocks.  A record without source or url is decoded without counts.
    Repeated records are decoded each, and count once for their url.  A page
    without h1 is decoded by its tags and text alone.  Without any page that
    its selectors fit nothing is learned and nothing comes out.  Other columns
    are ignored.
    """
    ok = pages.where((F.col("status_code") == 200) & (F.length(F.trim("html")) > 0))
    number = F.xxhash64("source_id").alias("number")
    p = ok.select(F.col("page_id").cast("long").alias("rec_id"), F.col("source_id").alias("source"), number, "url", F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    s = scraped.where(F.length(F.trim("content")) > 0).select(
        F.col("scraped_id").cast("long").alias("rec_id"), F.col("source_id").alias("source"), number, "url", "title", F.col("content").alias("text")
    )
    lines, n_lines, totals = count_often(p, s)
    rules = sources.select(F.col("source_id").alias("source"), "scraper.main_content_selectors", "scraper.exclude_selectors").dropDuplicates(["source"])
    rules, n_rules = counted(rules, "rules")
    # thin out by hash before the top-k, so that no partition sends more than its share of the sample
    share = F.pmod(F.xxhash64("rec_id"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample / max(1, ok.count())) * (1 << 30))
    drawn = p.where(share).select("source", "number", "url", "text", "rec_id").transform(lambda x: join_bounded(x, rules, "source", n_rules))
    drawn = drawn.orderBy(F.xxhash64("rec_id"), "rec_id").limit(sample).toArrow().to_pylist()
    known = _often(lines, totals, F.col("number").isin(sorted({r["number"] for r in drawn})))  # of ``sample`` sources at most
    chains = train([(r["source"], r["number"], r["text"], r["main_content_selectors"] or [], r["exclude_selectors"] or []) for r in drawn], known, rounds)
    groups = max(1, -(-n_lines // limit))
    out = []
    for g in range(groups):
        mine = F.pmod("number", F.lit(groups)) == g
        often = _often(lines, totals, mine)
        for d, kind, c in ((p, "page", chains[0]), (s, "scraped", chains[1])):
            out.append(d.where(mine).select("rec_id", "source", "number", "title", "text").mapInArrow(_extract(kind, c, often), _OUT))
    return reduce(DataFrame.unionByName, out)


def block_shas(blocks: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, block_sha): one row for each different block of a record; 12 hex digits of SHA-1.

    A record's blocks leave the map together, so equal ones are dropped with a narrow shuffle of hashes.
    """
    return blocks.select("rec_kind", "rec_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("block_sha")).distinct()
