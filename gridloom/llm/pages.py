"""Main text of web pages: a host's suffix array finds the boilerplate, marks of the page check it.

Each page's blocks become token streams, a mark for each block's start and a token for each word: one of the content
of its article (else main), one of all the rest; all of a page is in the array. Streams are dealt by (host, part),
where a host has as many parts as it needs, so it lies in bounded chunks. A chunk's streams are concatenated and their
suffixes sorted by their first MIN_TOKENS tokens: equal neighbours that stand on distinct pages are repeated
substrings, and every token under one is covered. Where a host goes on in another chunk, what was found and what is
still alone is counted over all its chunks, a row for each substring and chunk, so a repeat between chunks is found too.

Covered runs go and unique runs stay. Pages give their elements names (nav, footer, an ad's class), and the array
says what such names are worth: a kind of element that it finds covered on enough pages is boilerplate, and then all
elements of the kind go, those with a text of their own as well; elements of a kind that it finds unique on all
pages stay. The marks decide alone only on what an array can't judge: kinds that it has seen on fewer than
MIN_JUDGED pages of hosts with more than one page, and what readers write or fill in (BY_NATURE), which is unique
on every page. They also check the array's finds: the content of an article is kept, although passages of it may stand
on other pages too, and a passage of another page's article covers surroundings only, no unmarked text, which may quote
it. So a substring of articles alone decides nothing, and between chunks only those are counted that may equal one of the
rest: all rests' substrings are first put into a bitmap of fixed size, by hash. A hit too many is a row too many, no more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .htmlparse import MAIN, SURROUNDING, Block, blocks
from .shingles import mixed

#: The shortest repeat that counts, in tokens; and from how many on a covered run is taken for a copied text.
MIN_TOKENS, COPY_TOKENS = 8, 200
#: Tokens of a chunk at most, and the bytes of pages in a host's part, for each: some eight make a token, so a part is well below a chunk and tasks are alike.
CHUNK_TOKENS, TOKEN_BYTES = 2_000_000, 2
#: The bitmap of substrings: 2 ** bits, in parts of 2 ** bits.
MAP_BITS, PART_BITS = 27, 21
BREAK = 1
#: A kind of element is judged by the array from so many on, and is boilerplate if this share of them is covered.
MIN_JUDGED, MIN_SHARE = 100, 0.01
#: Kinds of surroundings whose text is by nature another on every page.
BY_NATURE = frozenset("form fieldset dialog comment comments commentlist reply replies respond disqus search subscribe newsletter signup login".split())


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def stream(found: list[Block]) -> tuple[list[Block], list[Block]]:
    """The blocks of a page's two streams: all but the content of its article, and that."""
    return [x for x in found if x.mark != MAIN], [x for x in found if x.mark == MAIN]


def boxes(found: list[Block]) -> list[tuple[str, int, int]]:
    """(kind, first place, end) in the page's stream of each element of surroundings."""
    out: list[tuple[str, int, int]] = []
    at, last = 0, None
    for x in stream(found)[0]:
        end = at + 2 + x.text.count(" ")
        if x.mark == SURROUNDING:
            if x.box == last:
                out[-1] = (x.kind, out[-1][1], end)
            else:
                out.append((x.kind, at + 1, end))
        last, at = x.box if x.mark == SURROUNDING else None, end
    return out


def _tokens(some: list[Block]) -> np.ndarray:
    out: list[int] = []
    for x in some:
        out.append(BREAK)
        out += [xxhash.xxh32_intdigest(w) | 2 for w in x.text.split(" ")]
    return np.array(out, np.uint32)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, article, signs, inside = [], [], [], []
        for page in batch.column("html"):
            found = blocks(page.as_py())
            main = [x.text for x in found if x.mark == MAIN] or [x.text for x in found]
            signs.append(xxhash.xxh64_intdigest("\n".join(main)) - (1 << 63))
            for x, out in zip(stream(found), (rest, article), strict=True):
                out.append(_tokens(x).tobytes())
            inside.append([{"kind": k, "a": a, "b": b} for k, a, b in boxes(found)])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("host", "parts", "part", "page_id", "h")], pa.array(signs, pa.int64()), pa.array(inside, _BOXES), pa.array(rest, pa.binary()), pa.array(article, pa.binary())], ["host", "parts", "part", "page_id", "h", "sign", "boxes", "tokens", "article"])


def hashed(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the substrings of `text` that begin at `at`."""
    a, b = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
    for k in range(length):
        token = text[at + k].astype(np.uint64)
        a, b = mixed((a ^ token) + np.uint64(0x9E3779B97F4A7C15)), mixed((b + token) * np.uint64(0xD1342543DE82EF95))
    return a, b


def bits_of(host: str, a: np.ndarray) -> np.ndarray:
    """The bitmap's places of a host's substrings, by their first hash."""
    return (mixed(a ^ np.uint64(xxhash.xxh64_intdigest(host))) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def substrings(pages: DataFrame, length: int) -> bytes:
    """The bitmap of all substrings of the rests' streams, packed: it goes to all tasks, and is nearly empty unless pages are very many."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                text = _tokens(stream(blocks(page.as_py()))[0])
                if len(text) >= length:
                    held.append(bits_of(host, hashed(text, np.arange(len(text) - length + 1), length)[0]))
            if len(held) > 10_000:
                held = [np.unique(np.concatenate(held))]
        found = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        edges = np.searchsorted(found, np.arange(0, (1 << MAP_BITS) + 1, 1 << PART_BITS))
        some = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(found[edges[k] : edges[k + 1]] % (1 << PART_BITS)).astype(np.uint32).tobytes() for k in some], pa.binary())], ["k", "places"])

    def merged(t: pa.Table) -> pa.Table:
        part = np.zeros(1 << PART_BITS, bool)
        for x in t.column("places"):
            part[np.frombuffer(x.as_buffer(), np.uint32)] = True
        return pa.table({"k": pa.array([t.column("k")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for r in pages.select("host", "html").mapInArrow(places, "k int, places binary").groupBy("k").applyInArrow(merged, "k int, bits binary").toLocalIterator():
        out[r["k"] * size : (r["k"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return zlib.compress(out.tobytes(), 1)


def suffix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first `length` tokens, number of each suffix's class in that order).

    Prefix doubling: ranks by the first k tokens give ranks by the first 2k. A suffix that ends earlier
    sorts before those it begins. `length` is a power of two.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < length:
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


_FOUND = "host string, page_id long, h long, sign long, boxes array<struct<kind:string,a:int,b:int>>, spans array<int>, at long, around boolean, a long, b long, lo long, hi long, least long, most long"
_BOXES = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
_KINDS = (pa.string(), *[pa.int64()] * 3, _BOXES, pa.list_(pa.int32()), pa.int64(), pa.bool_(), *[pa.int64()] * 6)
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def covered_spans(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Begins and ends, in turn, of the runs under substrings of `length` that begin at `starts`."""
    step = np.zeros(size + length + 2, np.int64)
    np.add.at(step, starts + 1, 1)
    np.add.at(step, starts + length + 1, -1)
    return np.flatnonzero(np.diff(np.cumsum(step) > 0))


def _chunk(host: str, rows: list[tuple], shared: bool, length: int, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each page of a chunk, with the covered runs of its rest; for hosts that go on also rows of substrings, without `at` if found repeated already.

    lo, hi: the least and the greatest sign of the pages that have the substring in their rest; least, most: anywhere.
    """
    texts = [t for r in rows for t in r[4:6]]  # the rest at even places, the article at odd ones
    sizes = np.array([len(t) for t in texts])
    text = np.concatenate([np.append(t.astype(np.int64), (1 << 33) + k) for k, t in enumerate(texts)])
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    start = np.cumsum(sizes + 1) - sizes - 1
    inside = np.arange(len(text)) - start[of] + length <= sizes[of]
    around = np.zeros(len(text), bool)
    for k, r in enumerate(rows):
        for x in r[3]:
            around[start[2 * k] + x["a"] : max(start[2 * k] + x["a"], start[2 * k] + x["b"] - length + 1)] = True
    page, rest = of // 2, of % 2 == 0
    order, group = suffix_classes(text, length)
    order, group = order[inside[order]], group[inside[order]]
    signs = np.array([r[2] for r in rows], np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(order) else np.empty(0, np.int64)
    top = np.iinfo(np.int64)
    sign, mine = signs[page[order]], rest[order]
    least, most, lo, hi = (f.reduceat(x, first) if len(order) else first for f, x in ((np.minimum, sign), (np.maximum, sign), (np.minimum, np.where(mine, sign, top.max)), (np.maximum, np.where(mine, sign, top.min))))
    member = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    repeated, anywhere, has = lo < hi, least != most, lo <= hi
    covers = mine & (repeated[member] | (anywhere[member] & around[order]))
    spans = covered_spans(order[covers], length, len(text)).reshape(-1, 2)
    own = np.searchsorted(page[spans[:, 0]], np.arange(len(rows) + 1))
    local = spans - start[of[spans[:, 0]]][:, None]
    for at in range(0, len(rows), 5_000):
        some = rows[at : at + 5_000]
        yield _batch(host=[host] * len(some), page_id=[r[0] for r in some], h=[r[1] for r in some], sign=[r[2] for r in some], boxes=[r[3] for r in some], spans=[local[own[k] : own[k + 1]].ravel() for k in range(at, at + len(some))])
    if not shared or not len(order):
        return
    a, b = hashed(text, order[first], length)
    bit = bits_of(host, a)
    sent = has | ((known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)
    a, b = a.view(np.int64), b.view(np.int64)
    alone = np.flatnonzero(mine & ~covers)  # what is on pages of one and the same text, or may be covered by other chunks
    done = np.flatnonzero(sent & (repeated | anywhere | ~has))
    seen = lambda c: {"lo": pa.array(lo[c], mask=~has[c]), "hi": pa.array(hi[c], mask=~has[c]), "least": least[c], "most": most[c]}
    for at in range(0, len(done), 200_000):
        c = done[at : at + 200_000]
        yield _batch(host=[host] * len(c), a=a[c], b=b[c], **seen(c))
    ids, hs = np.array([r[0] if r[0] is not None else 0 for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    none = np.array([r[0] is None for r in rows])
    for at in range(0, len(alone), 200_000):
        m = alone[at : at + 200_000]
        c, i = member[m], order[m]
        yield _batch(host=[host] * len(m), page_id=pa.array(ids[page[i]], mask=none[page[i]]), h=hs[page[i]], at=i - start[of[i]], around=around[i], a=a[c], b=b[c], **seen(c))


def _arrays(batches: Iterator[pa.RecordBatch], length: int, chunk_tokens: int, packed: bytes) -> Iterator[pa.RecordBatch]:
    """Chunks of a sorted partition: a part of a host each, or less if that has too many tokens. A host of one part that isn't cut is whole."""
    known = np.frombuffer(zlib.decompress(packed), np.uint8)
    now, rows, size, cut = None, [], 0, False
    for batch in batches:
        columns = [batch.column(c) for c in ("host", "parts", "part", "page_id", "h", "sign", "boxes", "tokens", "article")]
        for host, parts, part, page_id, h, sign, inside, *raw in zip(*columns, strict=True):
            new = (host.as_py(), parts.as_py(), part.as_py())
            tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in raw]
            more = sum(map(len, tokens))
            if rows and (new != now or size + more > chunk_tokens):
                yield from _chunk(now[0], rows, cut or new == now or now[1] > 1, length, known)
                rows, size, cut = [], 0, new == now
            now = new
            rows.append((page_id.as_py(), h.as_py(), sign.as_py(), inside.as_py(), *tokens))
            size += more
    if rows:
        yield from _chunk(now[0], rows, cut or now[1] > 1, length, known)


def boilerplate(pages: DataFrame, length: int = MIN_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(host, page_id, h, sign, boxes, spans) of each page: spans are the covered runs of its stream, begins and ends in turn, of one or more finds."""
    size = F.sum(F.octet_length(F.coalesce("html", F.lit("")))) / F.lit(float(chunk_tokens * TOKEN_BYTES))
    large = F.broadcast(pages.groupBy("host").agg(F.ceil(size).cast("int").alias("parts")).where("parts > 1"))  # no more rows than there are chunks
    parts = F.coalesce("parts", F.lit(1))
    dealt = pages.join(large, "host", "left").select("host", parts.alias("parts"), F.pmod("h", parts).cast("int").alias("part"), "page_id", "h", "html")
    streams = dealt.mapInArrow(_streams, "host string, parts int, part int, page_id long, h long, sign long, boxes array<struct<kind:string,a:int,b:int>>, tokens binary, article binary")
    packed = substrings(pages, length)
    dealt = streams.repartition("host", "part").sortWithinPartitions("host", "part", "h", "page_id")
    found = written(dealt.mapInArrow(lambda b: _arrays(b, length, chunk_tokens, packed), _FOUND), "repeats")
    open_ = found.where("a is not null")
    over = open_.groupBy("host", "a", "b").agg(F.expr("min(lo) < max(hi)").alias("twice"), F.expr("min(least) < max(most)").alias("anywhere")).where("twice or anywhere")
    late = open_.where("at is not null").join(over, ["host", "a", "b"]).where("twice or around").groupBy("page_id", "h").agg(F.collect_set("at").alias("late"))
    late = late.select(F.col("page_id").alias("_p"), F.col("h").alias("_h"), "late")
    rows = found.where("a is null").join(late, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("h") == F.col("_h")), "left")
    more = F.flatten(F.transform("late", lambda x: F.array(x.cast("int"), (x + length).cast("int"))))
    out = written(rows.select("host", "page_id", "h", "sign", "boxes", F.concat("spans", F.coalesce(more, F.array().cast("array<int>"))).alias("spans")), "covered")
    forget(found)
    return out


def verdicts(found: DataFrame, length: int = MIN_TOKENS) -> dict[str, bool]:
    """Whether elements of each kind of surroundings are boilerplate, by what the array covers. Kinds are words of a fixed list, so few; those it can't judge aren't in it."""
    box = found.select("host", "sign", "spans", F.explode("boxes").alias("x")).where(F.col("x.b") - F.col("x.a") >= length)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b")))
    hit = (F.size("spans") > 0) & F.exists(pairs, lambda s: F.least(s["b"], F.col("x.b")) - F.greatest(s["a"], F.col("x.a")) >= length)
    each = box.groupBy("host", F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(hit.cast("bigint")).alias("hits"), F.min("sign").alias("lo"), F.max("sign").alias("hi"))
    total = each.where("lo <> hi").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    return {r["kind"]: r["hits"] >= MIN_SHARE * r["n"] for r in total if r["n"] >= MIN_JUDGED and r["kind"] not in BY_NATURE}


def _without(text: str, gone: np.ndarray, length: int) -> str:
    """A block's text without its covered words. A run that only touches the block's edge ends there."""
    if not gone.any():
        return text
    if not gone.all():
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < length:
                gone[a:b] = False
    return " ".join([w for w, g in zip(text.split(" "), gone.tolist(), strict=True) if not g])


def main_text(page: str | None, spans: list[int] | None, goes: dict[str, bool], length: int = MIN_TOKENS) -> str:
    """The text of a page with covered runs `spans` in its stream, where elements of the kinds `goes` is true for are boilerplate."""
    found = blocks(page)
    mine = stream(found)[0]
    size = sum(2 + x.text.count(" ") for x in mine)
    covered, runs = np.zeros(size, bool), sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else []
    for a, b in runs:
        covered[a:b] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    gone = {a for kind, a, b in boxes(found) if goes.get(kind, True) or any(min(b, y) - max(a, x) >= min(length, b - a) for x, y in runs)}
    for a, b in runs:
        if b - a >= COPY_TOKENS:
            covered[a:b] = False
    out, place, last, go = [], 0, None, False
    for x in found:
        if x.mark == MAIN:
            out.append(x.text)
            continue
        n = x.text.count(" ") + 1
        if x.mark != SURROUNDING or x.box != last:
            go = place + 1 in gone
        last = x.box if x.mark == SURROUNDING else None
        if not (x.mark == SURROUNDING and go) and (kept := _without(x.text, covered[place + 1 : place + 1 + n].copy(), length)):
            out.append(kept)
        place += n + 1
    return " ".join(out)


def _texts(batches: Iterator[pa.RecordBatch], goes: dict[str, bool], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py(), a.as_py(), goes, length) for p, a in zip(batch.column("html"), batch.column("spans"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, length: int = MIN_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    Null and empty html give empty text. A null url, or one without host, belongs to the host "". Pages of one
    main text count as one page for the array, so copies don't take each other for boilerplate. Rows that share
    a page_id are pages of their own. Pages of any length are read whole. No rows: no rows. Further columns, of
    any name, don't count.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("url", "html").alias("h"))
    found = boilerplate(p, length, chunk_tokens)
    goes = verdicts(found, length)
    spans = found.groupBy(F.col("page_id").alias("_p"), F.col("h").alias("_h")).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    both = p.drop("host").hint("merge").join(spans, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("h") == F.col("_h")), "left").select("page_id", "url", "html", "spans")
    return both.mapInArrow(lambda b: _texts(b, goes, length), "page_id long, url string, text string, n_chars long")
