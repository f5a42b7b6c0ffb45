"""Main text of web pages: markup first, then a suffix array per host for what its pages repeat.

A scanner walks the page's tags once. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are left out by element, role and class. Where an article or main
element is there, its text goes on, else the rest. The texts of all pages are then token streams:
those of a host are sorted by suffix up to the least length of a repeat, and stretches of that
length or more that stand in several different pages are boilerplate. Covered tokens are removed
and unique runs kept.

Only what may repeat goes into the suffix arrays, as hashes of its tokens. A stretch has a least gram,
the same in all its places; grams are counted over all pages, and those that too few pages hold rule
their stretches out. The bitmap of the others has a fixed size: names that share a slot cost time,
not results.

A host's streams are cut into shards of bounded size by page. A host of one shard is settled there.
Of a larger host every shard reports each stretch with as many of its pages as it takes to decide;
what is frequent over all shards goes back to them, and they mark its places. So a host of any size,
and a stretch on any number of its pages, is spread over tasks.

Defined results: null and empty pages have empty text; markup that never ends is closed by the end
of the page; an article without text falls back to the rest of the page as it is; a null url is a
host of its own kind; repeated rows give repeated results and count as one page, as do pages of a
host with the same text and near copies (sketches of their grams agree in three quarters, directly
or over others); empty tables give empty tables; extra columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, column, strings, table, utf8
from sparkloom.llm.shingles import word_hashes
from sparkloom.operators.graph import components

#: Tokens of a repeat at least, pages that it must stand in, tokens of a shard about.
LEAST_TOKENS, LEAST_PAGES, SHARD_TOKENS = 8, 3, 500_000
#: Bits of the bitmap that lets stretches by which surely do not repeat, and of one row of it; characters of text and names of grams handled at once.
SLOTS, PAGE, AT_ONCE, NAMES_AT_ONCE = 1 << 24, 1 << 15, 2_000_000, 2_000_000
#: Values of a page's sketch, values of a band in which near copies meet, equal values of near copies at least.
SKETCH, BAND, NEAR = 24, 4, 18

#: Elements without text of the page; inline elements, which do not part words; elements without end tag.
DROPPED = set("head nav footer aside form button select option textarea svg canvas iframe object noscript template dialog menu".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Whole names in class, id or role that mark what is not the article, and endings of such names.
NOISE = set(
    """ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal
    newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus share sharing
    social related recommended widget toolbar pagination login signup complementary contentinfo search alert dialog""".split()
)
ENDINGS = tuple(f"{a}{w}" for w in "ad ads advert banner breadcrumbs comments consent footer menu modal nav navbar newsletter notice pagination popup promo share sidebar signup".split() for a in "-_")
#: Names of these that may as well stand for a part of an article, which they then do not drop.
ARTICLE_PARTS = set("alert banner comment dialog notice promo recommended related search toolbar widget".split())
STATES = ("with", "no", "has", "without", "hide", "show", "is", "not")
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def parts(page: str) -> tuple[str, list[str]]:
    """Text of the article or main elements, and the blocks of the rest that nothing marks as noise.

    Names that mark noise drop no article or main, and none inside the element that has them, but for articles in an article.
    """
    stack: list[tuple[str, int, int, bool]] = []  # element, what it adds to dropped and to named, main
    count: dict[str, int] = {}  # elements of each name in the stack
    dropped, named, inside = 0, 0, 0  # elements open that drop text, those that do by a name alone, article and main elements open
    main: list[str] = []
    rest: list[str] = []
    at = 0

    def text(a: int, b: int) -> None:
        if a < b and not dropped:
            (main if inside else rest).append(page[a:b])

    def gap() -> None:
        if not dropped:
            (main if inside else rest).append("\0")

    def push(name: str, out: int, by_name: int, core: bool) -> None:
        nonlocal dropped, named, inside
        stack.append((name, out, by_name, core))
        count[name] = count.get(name, 0) + 1
        dropped, named, inside = dropped + out, named + by_name, inside + core

    def pop() -> str:
        nonlocal dropped, named, inside
        name, out, by_name, core = stack.pop()
        count[name] -= 1
        dropped, named, inside = dropped - out, named - by_name, inside - core
        return name

    for m in TAG.finditer(page):
        text(at, m.start())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name not in INLINE:
                gap()
            if count.get(name):
                while pop() != name:
                    pass
                if name not in INLINE:
                    gap()
            continue
        if name not in INLINE:
            gap()
        if name in VOID:
            continue
        if name in ("article", "main"):
            # an element left open before it does not swallow the article
            while stack and stack[-1][1] > 0 and stack[-1][0] in ("head", "nav", "header", "footer", "form", "p", "b"):
                pop()
            back = 0 if count.get("article") else named
            push(name, -back, -back, True)
            continue
        noise = "=" in m[4] and name not in ("html", "body") and not count.get("pre") and not count.get("code") and not (inside and name in INLINE)
        noise = noise and any(is_noise(w) and not (inside and w in ARTICLE_PARTS) for x in MARKS.findall(m[4]) for w in x.strip("\"'").lower().split())
        hard = name in DROPPED or (name == "header" and not inside)
        out, by_name = int(noise or hard), int(noise and not hard)
        if out or name not in INLINE or name == "code":
            if name in ("p", "li") and stack and stack[-1][0] == name:
                pop()
            push(name, out, by_name, False)
            if name not in INLINE:
                gap()
    text(at, len(page))
    return blocks(main), [b for b in split_blocks(rest) if b]


def is_noise(name: str) -> bool:
    """Whether a whole name marks noise: names of a state such as with-sidebar do not."""
    return name in NOISE or (name.endswith(ENDINGS) and re.split("[-_]", name, maxsplit=1)[0] not in STATES)


def split_blocks(pieces: list[str]) -> list[str]:
    """Blocks with character references decoded and white space made single."""
    return [" ".join(entities.unescape(x).split()) for x in "".join(pieces).split("\0")]


def blocks(pieces: list[str]) -> str:
    return " ".join(x for x in split_blocks(pieces) if x)


def page_text(page: str) -> str:
    main, rest = parts(page)
    return main or " ".join(rest)


def stream_id(host: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{host}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[str]]]:
    """The batches in portions of bounded size, with the hosts and texts of their pages."""
    for batch in batches:
        html, start, texts, size = column(batch, "html"), 0, [], 0
        for i in range(batch.num_rows):
            texts.append(page_text(html[i].as_py() or ""))
            size += len(texts[-1])
            if size > AT_ONCE or i == batch.num_rows - 1:
                part = batch.slice(start, i + 1 - start)
                yield part, strings(column(part, "host")), texts
                start, texts, size = i + 1, [], 0


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of the texts one after another, and its text."""
    data, at = utf8(pa.array(texts, pa.large_string()))
    with np.errstate(over="ignore"):
        values, sizes = word_hashes(data, at, fold=False)
    return values, np.repeat(np.arange(len(texts)), sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(hosts: list[str]) -> np.ndarray:
    known = {h: stream_id(h, "") for h in set(hosts)}
    return np.array([known[h] for h in hosts], np.int64).view(np.uint64)


def gram_names(values: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """A name for every n tokens in a row, by their hashes and a salt for each place."""
    size = max(0, len(values) - n + 1)
    name = salt[:size].copy()
    for j in range(n):
        name = name * np.uint64(0x9E3779B97F4A7C15) + values[j : size + j]
    return mixed(name)


class Grams:
    """Of every stretch of `depth` tokens in some texts: text, place in it, and the least name of the shorter grams in it; equal stretches of a host have equal ones."""

    def __init__(self, hosts: list[str], texts: list[str], depth: int):
        self.values, owner = hashed(texts)
        gram, n = depth // 2 + 1, max(0, len(self.values) - depth + 1)
        name = gram_names(self.values, salts(hosts)[owner] if len(owner) else np.zeros(0, np.uint64), gram)
        least = name[:n]
        for j in range(1, depth - gram + 1):
            least = np.minimum(least, name[j : n + j])
        self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        whole = owner[:n] == owner[depth - 1 :] if n else np.zeros(0, bool)
        self.owner, self.least = owner[:n][whole], least[whole]
        self.place = np.arange(n)[whole] - self.first[self.owner]


def marked(slots: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the slot of each name is set in a bitmap."""
    slot = (names & np.uint64(SLOTS - 1)).astype(np.int64)
    return (slots[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def repeat_slots(pages: DataFrame, least_tokens: int, least_pages: int) -> np.ndarray:
    """Bitmap of fixed size with the least grams of all stretches that may repeat: those that enough pages hold, copies included, and names that share their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for _, hosts, texts in portions(batches):
            # copies that one task meets count once here already
            fresh = [x for x in zip(hosts, texts) if (k := stream_id(*x)) not in seen and not seen.add(k)]
            found = Grams([h for h, _ in fresh], [t for _, t in fresh], least_tokens)
            order = np.lexsort((found.least, found.owner))
            at, least = found.owner[order], found.least[order]
            keep = np.ones(len(at), bool)
            keep[1:] = (at[1:] != at[:-1]) | (least[1:] != least[:-1])
            # half of a name does: names that share it cost time, not results
            held.append(least[keep].astype(np.uint32))
            size += len(held[-1])
            if size >= NAMES_AT_ONCE:
                yield packed_names(np.concatenate(held), least_pages)
                held, size = [], 0
        if held:
            yield packed_names(np.concatenate(held), least_pages)

    def often(rows: pa.Table) -> pa.Table:
        names, n = np.unique(unpacked_names(rows), return_counts=True)
        return pa.table({"name": pa.array(names[n >= least_pages].view(np.int32))})

    return bitmap(pages.mapInArrow(run, "range int, names binary").groupBy("range").applyInArrow(often, "name int"), "name")


def packed_names(names: np.ndarray, most: int) -> pa.RecordBatch:
    """(range, names): names of 32 bits, each at most so many times, by their first 12 bits; of the others the last 16 stand before the first 4, as sorted bytes take little room."""
    names = np.sort(names)
    if len(names) > most:
        names = names[np.concatenate([np.ones(most, bool), names[most:] != names[:-most]])]
    bounds = np.flatnonzero(np.concatenate([[True], names[1:] >> 20 != names[:-1] >> 20])) if len(names) else np.zeros(0, np.int64)
    parts = [names[a:b] for a, b in zip(bounds, [*bounds[1:], len(names)])]
    packed = [x.astype("<u2").tobytes() + (x >> 16 & 15).astype(np.uint8).tobytes() for x in parts]
    return pa.RecordBatch.from_arrays([pa.array((names[bounds] >> 20).astype(np.int32)), pa.array(packed, pa.binary())], ["range", "names"])


def unpacked_names(rows: pa.Table) -> np.ndarray:
    out = [np.zeros(0, np.uint32)]
    for first, packed in zip(rows["range"].to_pylist(), rows["names"].to_pylist()):
        n = len(packed) // 3
        out.append(np.uint32(first << 20) | np.frombuffer(packed, np.uint8, n, 2 * n).astype(np.uint32) << 16 | np.frombuffer(packed, "<u2", n))
    return np.concatenate(out)


def bitmap(rows: DataFrame, name: str) -> np.ndarray:
    """Bitmap of SLOTS bits with the lowest bits of each name."""
    slot = F.col(name).bitwiseAND(SLOTS - 1).cast("int")
    rows = rows.select(F.shiftright(slot, PAGE.bit_length() - 1).alias("page"), slot.bitwiseAND(PAGE - 1).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    slots = np.zeros((SLOTS // PAGE, PAGE // 8), np.uint8)
    for page, bits in rows.collect():
        slots[page] = np.frombuffer(bits, np.uint8)
    return slots.ravel()


def texts_of(pages: DataFrame, slots, whether: bool) -> DataFrame:
    """(page_id, url, raw, text) of the pages whose raw name is set, or is not set, in a broadcast bitmap: text as the markup leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = column(batch, "raw").to_numpy().view(np.uint64)
            chosen = batch.take(pa.array(np.flatnonzero(marked(slots.value, names) == whether)))
            for part, _, texts in portions([chosen]):
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), column(part, "raw"), pa.array(texts, pa.string())], ["page_id", "url", "raw", "text"])

    return pages.mapInArrow(run, "page_id long, url string, raw long, text string")


def segments(pages: DataFrame, slots, least_tokens: int) -> DataFrame:
    """(host, raw, stream, at, tokens, sketch): runs of tokens of each page's text that hold all its stretches that may repeat, as hashes, the first with the sketch of the page's grams; stream is a hash of host and text; copies that one task meets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, hosts, texts in portions(batches):
            raws = column(part, "raw").to_pylist()
            found = Grams(hosts, texts, least_tokens)
            hit = marked(slots.value, found.least)
            drawn = sketches(found.owner, found.least, len(texts))
            own, place = found.owner[hit], found.place[hit]
            cut = np.ones(len(own), bool)
            cut[1:] = (own[1:] != own[:-1]) | (place[1:] > place[:-1] + least_tokens)
            starts = np.flatnonzero(cut).tolist()
            out: list[tuple] = []
            last, name, new = -1, 0, False
            for a, b in zip(starts, [*starts[1:], len(own)]):
                i, mine = int(own[a]), None
                if i != last:
                    last, name = i, stream_id(hosts[i], texts[i])
                    new = raws[i] not in seen
                    seen.add(raws[i])
                    mine = drawn[i].tolist() if new else None
                if new:
                    first = int(found.first[i])
                    out.append((hosts[i], raws[i], name, int(place[a]), found.values[first + int(place[a]) : first + int(place[b - 1]) + least_tokens].tobytes(), mine))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            cols = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["host", "raw", "stream", "at", "tokens", "sketch"])

    return pages.mapInArrow(run, "host string, raw long, stream long, at int, tokens binary, sketch array<long>").withColumn("host", F.xxhash64("host"))


def sketches(owner: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """Least values of differently scrambled names of each text."""
    out = np.zeros((n, SKETCH), np.int64)
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for i in range(SKETCH):
            odd = mixed(np.array([i + 1], np.uint64)) | np.uint64(1)
            out[owner[starts], i] = np.minimum.reduceat(names * odd, starts).view(np.int64)
    return out


def near_copies(runs: DataFrame) -> DataFrame:
    """(host, stream, kin): streams that are near copies of others, with the smallest of them."""
    drawn = runs.where("sketch is not null").select("host", "stream", "sketch")
    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("sketch", b * BAND + 1, BAND)) for b in range(SKETCH // BAND)])
    # names alone meet in the bands; sketches are read again for those that met
    banded = drawn.select("stream", F.explode(bands).alias("band"))
    heads = banded.groupBy("band").agg(F.min("stream").alias("head"), F.max("stream").alias("top")).where("head < top").select("band", "head")
    met = checkpointed(banded.join(heads, "band").where("stream <> head").select("stream", "head").distinct())
    ids = met.select("stream").unionAll(met.select("head")).distinct()
    known = checkpointed(drawn.join(ids, "stream", "left_semi").groupBy("stream").agg(F.first("host").alias("host"), F.first("sketch").alias("sketch")))
    one = known.select("stream", F.col("sketch").alias("x"))
    other = known.select(F.col("stream").alias("head"), F.col("sketch").alias("y"))
    equal = F.size(F.filter(F.arrays_zip("x", "y"), lambda z: z["x"] == z["y"]))
    edges = met.join(one, "stream").join(other, "head").where(equal >= NEAR).select(F.col("stream").alias("a"), F.col("head").alias("b"))
    kin = components(edges, loops=False).select(F.col("node").alias("stream"), F.col("component").alias("kin"))
    named = known.select("host", F.col("stream").alias("named"))
    return checkpointed(kin.join(named, F.col("stream") == F.col("named")).select("host", "stream", "kin"))


def suffix_ranks(values: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix among all by its first tokens: prefix doubling up to the depth; ends sort first."""
    rank, known = np.unique(values, return_inverse=True)[1].astype(np.int64) + 1, 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    return rank


class Shard:
    """The suffix array of some runs of tokens: of every stretch of `depth` tokens inside a run its run, place in it, and rank among all suffixes."""

    def __init__(self, runs: list[np.ndarray], depth: int):
        sizes = np.array([len(r) for r in runs], np.int64)
        flat = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        # every run ends in a value of its own, so no stretch runs from run to run
        owner = np.repeat(np.arange(len(runs)), sizes + 1)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.empty(len(owner), np.int64)
        last = np.zeros(len(owner), bool)
        last[first[1:] - 1] = True
        ids[last] = -1 - np.arange(len(runs))
        ids[~last] = np.unique(flat, return_inverse=True)[1]
        place = np.arange(len(owner)) - first[owner]
        rank = suffix_ranks(ids, depth) if len(ids) else ids
        whole = place + depth <= sizes[owner]
        order = np.argsort(rank[whole], kind="stable")
        self.owner, self.place, self.rank = owner[whole][order], place[whole][order], rank[whole][order]
        self.flat, self.at = flat, (first[owner] - owner + place)[whole][order]
        self.depth = depth

    def groups(self) -> np.ndarray:
        """Number of each stretch among the different ones, in the order of their suffixes."""
        fresh = np.ones(len(self.rank), bool)
        fresh[1:] = self.rank[1:] != self.rank[:-1]
        return np.cumsum(fresh) - 1

    def names(self, salt: int) -> np.ndarray:
        """A name of each stretch, the same in all shards of a host."""
        return gram_names(self.flat, np.full(len(self.flat), salt, np.int64).view(np.uint64), self.depth)[self.at].view(np.int64)


def covered(raws: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(raw, start, stop) of the stretches' union."""
    order = np.lexsort((starts, raws))
    raws, starts = raws[order], starts[order]
    cut = np.ones(len(starts), bool)
    cut[1:] = (raws[1:] != raws[:-1]) | (starts[1:] > starts[:-1] + depth)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return raws[first], starts[first], starts[last] + depth


def repeated(runs: DataFrame, least_tokens: int, least_pages: int) -> DataFrame:
    """(raw, start, stop): tokens of a page's text in stretches that stand in enough different pages of its host."""

    def opened(rows: pa.Table, kin: pa.Table | None) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
        # tasks may have brought a copy each
        first_of: dict[tuple, int] = {}
        for i, k in enumerate(zip(rows["raw"].to_pylist(), rows["at"].to_pylist())):
            first_of.setdefault(k, i)
        rows = rows.take(list(first_of.values()))
        shard = Shard([np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()], least_tokens)
        of = dict(zip(kin["stream"].to_pylist(), kin["kin"].to_pylist())) if kin is not None else {}
        kins = np.array([of.get(x, x) for x in rows["stream"].to_pylist()], np.int64)
        return shard, rows["raw"].to_numpy()[shard.owner], kins[shard.owner], rows["at"].to_numpy()[shard.owner] + shard.place

    def result(n: int, **given) -> pa.Table:
        kinds = {"host": pa.int64(), "shard": pa.int32(), "stretch": pa.int64(), "kin": pa.int64(), "raw": pa.int64(), "start": pa.int32(), "stop": pa.int32()}
        return pa.table({c: pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()})

    def settle(rows: pa.Table, kin: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return result(0)
        whole, number, host = rows["shards"][0].as_py() == 1, rows["shard"][0].as_py(), rows["host"][0].as_py()
        shard, raws, kin, place = opened(rows, kin)
        group = shard.groups()
        order = np.lexsort((kin, group))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[order][1:] != group[order][:-1]) | (kin[order][1:] != kin[order][:-1])
        each = order[fresh]  # one place a stretch and page
        if whole:
            often = np.bincount(group[each], minlength=int(group[-1]) + 1 if len(group) else 0) >= least_pages
            found = covered(raws[often[group]], place[often[group]], least_tokens)
            return result(len(found[0]), raw=found[0], start=found[1].astype(np.int32), stop=found[2].astype(np.int32))
        # the pages that decide, of each stretch
        some = each[np.arange(len(each)) - np.searchsorted(group[each], group[each]) < least_pages]
        return result(len(some), host=np.full(len(some), host), shard=np.full(len(some), number, np.int32), stretch=shard.names(host)[some], kin=kin[some])

    def mark(rows: pa.Table, often: pa.Table) -> pa.Table:
        if not rows.num_rows or not often.num_rows:
            return result(0)
        shard, raws, _, place = opened(rows, None)
        hit = np.isin(shard.names(rows["host"][0].as_py()), often["stretch"].to_numpy())
        found = covered(raws[hit], place[hit], least_tokens)
        return result(len(found[0]), raw=found[0], start=found[1].astype(np.int32), stop=found[2].astype(np.int32))

    # one row a host of several shards
    sums = runs.groupBy(F.col("host").alias("of")).agg(F.ceil(F.sum(F.length("tokens")) / (8 * SHARD_TOKENS)).cast("int").alias("shards")).where("shards > 1")
    sums = checkpointed(sums)

    def deal(rows: DataFrame) -> DataFrame:
        dealt = rows.join(sums, F.col("host") == F.col("of"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        return dealt.withColumn("shard", F.pmod(F.xxhash64("stream"), "shards").cast("int"))

    dealt = deal(runs.drop("sketch"))
    out = "host long, shard int, stretch long, kin long, raw long, start int, stop int"
    kin = deal(near_copies(runs)).select(F.col("host").alias("host"), F.col("shard").alias("shard"), "stream", "kin")
    found = checkpointed(dealt.groupBy("host", "shard").cogroup(kin.groupBy("host", "shard")).applyInArrow(settle, out))
    told = found.where("stretch is not null")
    often = told.select("stretch", "kin").distinct().groupBy("stretch").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("stretch")
    back = told.select("host", "shard", "stretch").distinct().join(often, "stretch").select("host", "shard", "stretch")
    marks = dealt.where("shards > 1").groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInArrow(mark, out)
    return found.where("raw is not null").unionAll(marks).select("raw", "start", "stop")


def main_text(pages: DataFrame, least_tokens: int = LEAST_TOKENS, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) of every page: the runs of its text that no repeat of the host covers."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    plain = plain.withColumn("raw", F.xxhash64("host", "html"))
    slots = pages.sparkSession.sparkContext.broadcast(repeat_slots(plain, least_tokens, least_pages))
    runs = checkpointed(segments(plain, slots, least_tokens))
    spans = F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")
    gone = checkpointed(repeated(runs, least_tokens, least_pages).groupBy("raw").agg(spans))
    # only the texts that lose something are shuffled, and those that share a slot with them
    held = pages.sparkSession.sparkContext.broadcast(bitmap(gone, "raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()):
                if spans:
                    tokens, kept, at = text.split(" "), [], 0
                    for x in spans:
                        kept += tokens[at : x["start"]]
                        at = max(at, x["stop"])
                    text = " ".join(kept + tokens[at:])
                out.append(text)
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = texts_of(plain, held, True).join(gone, "raw", "left").select("page_id", "url", "text", "spans")
    return texts_of(plain, held, False).select("page_id", "url", "text").unionAll(joined.mapInArrow(run, "page_id long, url string, text string"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
