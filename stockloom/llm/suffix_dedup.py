"""Removes every byte inside a string of N bytes that also starts earlier: bucket-pointer refinement.

The suffixes of a corpus fall into buckets by their first q bytes. A bucket with several suffixes is sorted by the buckets of
the suffixes that start where its known prefix ends, and its parts again, until N bytes are known. To spread this:

1. Each N-byte string has one anchor: the q-gram in it with the least hash, the leftmost among equals. Equal strings have
   equal anchors at equal offsets, so the bucket of the anchor's q-gram holds all places where a string can repeat. Only
   anchors travel, some one in forty bytes. Neighbouring strings with one anchor form a run; the bytes of its strings are its context.
2. The contexts of anchors that occur again meet by anchor and are refined there. Strings are removed only where their N bytes
   have been compared and agree; hashes choose who meets whom and decide nothing.

The task that reads the texts refines its own slice first, so that runs whose strings all repeat within it do not travel. Where contexts
meet, those equal byte by byte as a whole are one bucket at once, and the others are refined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL_SIDE, broadcast_if_under, group_bounds, materialize

Q = 24
_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(1729).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time; parts overlap by a string, and each string starts in one part. A run that
#: such a border cuts is two runs with one anchor. Places take 22 bits beside a hash, whatever the length of the part.
CHUNK, _PLACE = 1 << 20, np.uint64((1 << 22) - 1)
#: Bytes of texts (or one longer text) that are refined together before anything travels.
SLICE = 4 << 20
#: At most so many anchors are dealt over several tasks; their list is sent to every executor (16 bytes each).
MOST_HOT = 2_000_000


def _powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    have = _kept.get("n", 0)
    if have < n:
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _kept.update(n=n, p=out)
    return _kept["p"][0], _kept["p"][1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_at(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them; zeros follow the end. A view, no copy of the words."""
    return np.ndarray((len(raw),), ">u8", buffer=raw + bytes(8), strides=(1,))


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Whether size bytes from a and from b on are equal, place by place."""
    size = np.broadcast_to(np.asarray(size, np.int64), a.shape)
    out = np.zeros(len(a), bool)
    at = np.arange(len(a))
    done = 0
    while len(at):
        left = size[at] - done
        shift = (8 * np.clip(8 - left, 0, 8)).astype(np.uint64)
        differ = words[a[at] + done] ^ words[b[at] + done]
        equal = np.where(left > 0, differ.astype(np.uint64) >> np.minimum(shift, np.uint64(63)), np.uint64(0)) == 0
        at, left = at[equal], left[equal]
        out[at[left <= 8]] = True
        at = at[left > 8]
        done += 8
    return out


def runs_of(buf: np.ndarray, inside: np.ndarray, n_bytes: int, q: int):
    """Runs of strings with one anchor: hash of the anchor, first and last start of a string. inside: places where a string starts."""
    n = len(buf)
    w = n_bytes - q + 1
    if n < n_bytes:
        return None
    pw, inv = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[:n], out=c[1:])
    gram = _mix((c[q:] - c[:-q]) * inv[: n - q + 1])
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: width - w], least[w - width :])
    anchor = (least & _PLACE).astype(np.int64)
    inside = inside[: len(anchor)]
    lo = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])))
    hi = np.append(lo[1:], len(anchor)) - 1
    keep = inside[lo]
    return gram[anchor[lo[keep]]].view(np.int64), lo[keep], hi[keep]


def not_first(bucket: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Marks the members of a bucket whose place comes after the bucket's first; equal places are one."""
    return first_of(bucket, place)[1]


def first_of(bucket: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first member of each one's bucket by place, and whether its place differs from the first's."""
    order = np.lexsort([*reversed(place), *reversed(bucket)])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in bucket:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    for p in place:
        later |= p != p[first]
    return first, later


def _slices(texts, most: int):
    """Rows of consecutive texts with about `most` bytes: first row, their bytes end to end, starts, ends."""
    at = 0
    while at < len(texts):
        got, total, to = [], 0, at
        while to < len(texts) and (to == at or total < most):
            got.append((texts[to].as_py() or "").encode("utf-8", "surrogatepass"))
            total += len(got[-1])
            to += 1
        ends = np.cumsum([len(g) for g in got])
        yield at, b"".join(got), np.append(0, ends[:-1]), ends
        at = to


def united(doc: np.ndarray, tie: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, those that touch or overlap as one."""
    order = np.lexsort((s, tie, doc))
    doc, tie, s, e = (x[order].astype(np.int64) for x in (doc, tie, s, e))
    if not len(s):
        return doc, tie, s, e
    own = np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))) << 33
    reach = np.maximum.accumulate(own + e)
    new = np.flatnonzero(np.append(True, (own + s)[1:] > reach[:-1]))
    return doc[new], tie[new], s[new], (reach - own)[np.append(new[1:], len(s)) - 1]


def _spread(doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A key for rows that need not meet any other."""
    return _mix(doc.view(np.uint64) * np.uint64(_ODD) ^ s.astype(np.uint64)).view(np.int64)


def known_runs(raw: bytes, starts: np.ndarray, rank: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_bytes: int, most: int = SLICE) -> np.ndarray:
    """Which runs of a slice need not travel: all their strings also start earlier in the slice, by the same refinement of buckets as where
    contexts meet. Runs whose anchor occurs again in the slice are looked at; their contexts overlap, and each byte is taken once.

    starts, rank: first byte of each document and its number in the order of documents; h, lo, hi: hash of the anchor, first and last start
    of a run. Refines some `most` bytes at a time; strings that such a cut parts travel and meet later."""
    by = np.argsort(h, kind="stable")
    again = np.append(False, h[by][1:] == h[by][:-1])
    met = np.sort(by[again | np.append(again[1:], False)])
    if not len(met):
        return np.zeros(len(h), bool)
    of = np.searchsorted(starts, lo[met], side="right") - 1
    gap = np.append(True, (lo[met][1:] > hi[met][:-1] + n_bytes) | (of[1:] != of[:-1]))  # stretches of one document
    s, e = lo[met][gap], (hi[met] + n_bytes)[np.append(gap[1:], True)]
    long = np.maximum(1, -(-(e - s - n_bytes + 1) // most))  # a long stretch is cut; its parts overlap by a string
    part = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    s, e, of = np.repeat(s, long) + part * most, np.repeat(e, long), np.repeat(of[gap], long)
    e = np.minimum(e, s + most + n_bytes - 1)
    reach = np.cumsum(e - s)
    repeats = np.zeros(len(raw) + 1, np.int32)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, side="right")))
        ends = np.cumsum(e[at:to] - s[at:to])
        found, group = refine(b"".join([raw[a:b] for a, b in zip(s[at:to].tolist(), e[at:to].tolist(), strict=True)]), ends, n_bytes)
        if len(found):
            k = np.searchsorted(ends, found, side="right")
            where = s[at:to][k] + found - np.append(0, ends[:-1])[k]
            place = rank[of[at:to][k]] * (len(raw) + 1) + where - starts[of[at:to][k]]
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.repeat(np.minimum.reduceat(place, new), np.diff(np.append(new, len(group))))
            repeats[where[place != least] + 1] = 1
        at = to
    repeats = np.cumsum(repeats)
    return repeats[hi + 1] - repeats[lo] == hi + 1 - lo


_ANCHORS = "h long, doc long, tie long, lo int, more int, again boolean"


def _anchors(n_bytes: int, q: int, chunk: int, bits: int):
    few = np.uint64((1 << bits) - 1)

    def run(batches):
        for b in batches:
            ids, ties = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, raw, starts, ends in _slices(b.column(2), SLICE):
                buf = np.frombuffer(raw, np.uint8)
                edge = np.zeros(len(buf) + 1, np.int8)
                some = ends - starts >= n_bytes
                np.add.at(edge, starts[some], 1)
                np.add.at(edge, ends[some] - n_bytes + 1, -1)
                inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
                found = []
                for part in range(0, len(raw), chunk):
                    got = runs_of(buf[part : part + chunk + n_bytes - 1], inside[part:], n_bytes, q)
                    if got is not None and len(got[0]):
                        found.append((got[0], got[1] + part, got[2] + part))
                if not found:
                    continue
                h, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                h = (h.view(np.uint64) & few).view(np.int64)
                del found, inside, edge
                at = np.searchsorted(ends, lo, side="right")
                doc, tie, start = ids[row + at], ties[row + at], lo - starts[at]
                more = hi - lo
                own = np.lexsort((ties[row : row + len(ends)], ids[row : row + len(ends)])) + row
                rank = np.empty(len(ends), np.int64)
                rank[own - row] = np.cumsum(np.append(0, (ids[own][1:] != ids[own][:-1]) | (ties[own][1:] != ties[own][:-1])))
                again = np.flatnonzero(known_runs(raw, starts, rank, h, lo, hi, n_bytes))
                rest = np.ones(len(h), bool)
                rest[again] = False
                d, t, s, e = united(doc[again], tie[again], start[again], start[again] + more[again] + n_bytes)
                cols = ((h[rest], _spread(d, s)), (doc[rest], d), (tie[rest], t), (start[rest].astype(np.int32), s.astype(np.int32)), (more[rest].astype(np.int32), (e - s - n_bytes).astype(np.int32)))
                cols = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.arange(len(cols[0])) >= int(rest.sum()))], names=["h", "doc", "tie", "lo", "more", "again"])

    return run


def _flat(lists: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and fields of a list-of-structs column; a null list is empty, a null number -1."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    rows = lists.flatten()
    return np.append(0, np.cumsum(sizes)), [pa.compute.fill_null(rows.field(n).cast(pa.int64()), -1).to_numpy(zero_copy_only=False) for n in names]


def _cut(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """size bytes from each place on, as a binary column."""
    ends = np.cumsum(size)
    where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - size), size)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(buf[where])])


_CONTEXTS = "h long, share int, doc long, tie long, lo int, more int, bytes binary"


def _contexts(n_bytes: int, bits: int, most: int = 4 << 20):
    """What is to be refined, of the documents that have any: the context of a run; for a run of a hot anchor each of its
    strings, dealt by what they hold, so that one anchor's strings spread over many tasks. Strings equal to an earlier
    one of the slice come without bytes: they are repeats."""
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]

    def batch(h, share, doc, tie, lo, more, raw):
        cols = (h, share.astype(np.int32), doc, tie, lo.astype(np.int32), more.astype(np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), raw], names=names)

    def run(batches):
        for b in batches:
            offsets, (kind, lo, more, anchor, parts) = _flat(b.column(3), ["kind", "lo", "more", "h", "parts"])
            docs, ties = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            of = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            for row, raw, starts, ends in _slices(b.column(2), SLICE // 4):
                buf, words = np.frombuffer(raw, np.uint8), words_at(raw)
                mine = slice(offsets[row], offsets[row + len(ends)])
                one = mine.start + np.flatnonzero(kind[mine] == 1)
                sizes = np.cumsum(more[one] + n_bytes)
                cuts = np.searchsorted(sizes, np.arange(most, int(sizes[-1]) + most, most) if len(sizes) else [], side="right").tolist()
                for s, e in zip([0, *cuts], [*cuts, len(one)], strict=True):  # bounded batches
                    i = one[s:e]
                    if len(i):
                        yield batch(anchor[i], np.zeros(len(i)), docs[of[i]], ties[of[i]], lo[i], more[i], _cut(buf, starts[of[i] - row] + lo[i], more[i] + n_bytes))
                hot = mine.start + np.flatnonzero(kind[mine] == 2)
                if not len(hot):
                    continue
                n = more[hot] + 1
                i = np.repeat(hot, n)
                at = lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                place = starts[of[i] - row] + at
                digest = np.zeros(len(i), np.uint64)
                for k in [*range(0, n_bytes - 7, 8), max(0, n_bytes - 8)]:
                    digest = _mix(digest * np.uint64(_ODD) ^ words[place + k].astype(np.uint64))
                digest &= np.uint64((1 << bits) - 1 if n_bytes >= 8 else 0)
                d, t = docs[of[i]], ties[of[i]]
                first, later = first_of([anchor[i], digest], [d, t, at])
                known = np.flatnonzero(later)
                known = known[same_bytes(words, place[known], place[first[known]], n_bytes)]
                fresh = np.ones(len(i), bool)
                fresh[known] = False
                fresh = np.flatnonzero(fresh)
                for s in range(0, len(fresh), most // n_bytes + 1):
                    j = fresh[s : s + most // n_bytes + 1]
                    share = 1 + (digest[j] % np.maximum(parts[i[j]], 1).astype(np.uint64)).astype(np.int64)
                    yield batch(anchor[i[j]], share, d[j], t[j], at[j], np.zeros(len(j)), _cut(buf, place[j], np.full(len(j), n_bytes)))
                d, t, s, e = united(d[known], t[known], at[known], at[known] + n_bytes)
                if len(s):
                    yield batch(_spread(d, s), np.zeros(len(s)), d, t, s, e - s - n_bytes, pa.nulls(len(s), pa.binary()))

    return run


def refine(raw: bytes, ends: np.ndarray, n_bytes: int, strip: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-byte strings in the contexts that occur more than once, and a number that equal strings share.

    Suffixes are sorted by eight bytes; `bucket` points from each suffix to the first place of its bucket, `deep` tells how many
    bytes the suffixes of a bucket have in common. A bucket with two or more strings that are not known to the end is
    sorted by the pointers of the suffixes `deep` further on; its parts are deeper by what those have in common, their pointers
    are set at once, and the parts are refined in turn before the next buckets, which profit from all pointers set so far.
    A bucket is refined as a whole or not at all, so pointers always agree with one order of all suffixes, in which equal
    strings are neighbours. Neighbours are then compared byte by byte. The end of a context sorts before any byte.
    """
    n = len(raw)
    sizes = np.diff(np.append(0, ends))
    left = np.repeat(ends, sizes) - np.arange(n)
    words = words_at(raw)
    gram = words.astype(np.uint64)
    short = np.flatnonzero(left < 8)
    gram[short] &= ~((np.uint64(1) << (8 * (8 - left[short])).astype(np.uint64)) - np.uint64(1))
    wanted = left >= n_bytes
    suffix = np.argsort(gram).astype(np.int32)
    at = np.arange(n, dtype=np.int32)
    g = gram[suffix]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if n else np.zeros(0, np.int64)
    del g, gram
    bucket = np.empty(n, np.int32)
    bucket[suffix] = np.repeat(at[start], np.diff(np.append(start, n)))
    deep = np.full(n, 8, np.int32)
    live = at
    if n_bytes > 8 and n:
        many = np.repeat(np.add.reduceat(wanted[suffix], start, dtype=np.int32) > 1, np.diff(np.append(start, n)))
        live = at[many]
    else:
        live = at[:0]
    while len(live):
        cut = len(live)
        if cut > strip:  # whole buckets
            own = bucket[suffix[live[: 2 * strip]]]
            edges = np.flatnonzero(own[1:] != own[:-1]) + 1
            later = edges[edges >= strip] if len(edges) else edges
            if len(later):
                cut = int(later[0])
            else:
                own = bucket[suffix[live]]
                edges = np.flatnonzero(own[1:] != own[:-1]) + 1
                later = edges[edges >= strip]
                cut = int(later[0]) if len(later) else len(live)
        here, live = live[:cut], live[cut:]
        while len(here):
            m = suffix[here]
            depth = deep[m]
            ended = left[m] <= depth
            next_ = np.where(ended, m, m + depth)
            key = np.where(ended, -1, bucket[next_]).astype(np.int64)
            own = bucket[m].astype(np.int64)
            order = np.argsort(own * (n + 1) + key + 1)
            m, own, key, next_ = m[order], own[order], key[order], next_[order]
            start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(m)))
            further = deep[next_]  # before any depth changes here
            suffix[here] = m
            bucket[m] = np.repeat(here[start], size)
            deep[m] = depth[order] + further
            go = (np.add.reduceat(wanted[m], start, dtype=np.int32) > 1) & (deep[m[start]] < n_bytes) & (key[start] >= 0)
            here = here[np.repeat(go, size)]
    v = suffix[wanted[suffix]].astype(np.int64)
    if len(v) < 2:
        return v[:0], v[:0]
    equal = same_bytes(words, v[:-1], v[1:], n_bytes)
    group = np.append(0, np.cumsum(~equal))
    some = np.append(equal, False) | np.append(False, equal)
    return v[some], group[some]


def _refined(n_bytes: int, most: int):
    """Spans of the strings that also start earlier, among rows of _contexts sorted by anchor, share and place.

    Holds one bucket, or about `most` bytes of several. Of a bucket that goes on in the next batch only the first of equal contexts stays."""

    def collapsed(c, raw):
        """Which rows equal an earlier one of their bucket byte by byte, at another place."""
        h, share, doc, tie, lo, _ = c
        seen: dict = {}
        later = np.zeros(len(raw), bool)
        same = np.zeros(len(raw), bool)
        for i, k in enumerate(zip(h.tolist(), share.tolist(), raw, strict=True)):
            if k[2] is None:
                later[i] = True
            else:
                f = seen.setdefault(k, i)
                if f != i:
                    same[i] = True
                    later[i] = doc[i] != doc[f] or tie[i] != tie[f] or lo[i] != lo[f]
        return later, ~(later | same)

    def spans(found):
        row = [np.concatenate(x) for x in zip(*found, strict=True)] if found else None
        if row is None or not len(row[0]):
            return None
        d, t, s, e = united(*row)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "tie", "s", "e"])

    def refined(c, raw):
        _, _, doc, tie, lo, _ = c
        ends = np.cumsum([len(r) for r in raw])
        at, group = refine(b"".join(raw), ends, n_bytes)
        k = np.searchsorted(ends, at, side="right")
        place = lo[k] + at - np.append(0, ends[:-1])[k]
        again = not_first([group], [doc[k], tie[k], place])
        k, place = k[again], place[again]
        return doc[k], tie[k], place, place + n_bytes

    def run(batches):
        kept_c, kept_raw = None, []
        for b in _with_end(batches):
            found = []
            if b is not None:
                c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                raw = b.column(6).to_pylist()
                if kept_c is not None:
                    c, raw = [np.concatenate(x) for x in zip(kept_c, c, strict=True)], kept_raw + raw
            elif kept_c is None:
                return
            else:
                c, raw = kept_c, kept_raw
            later, rest = collapsed(c, raw)
            gone = np.flatnonzero(later)
            if len(gone):
                found.append((c[2][gone], c[3][gone], c[4][gone].astype(np.int64), c[4][gone] + c[5][gone].astype(np.int64) + n_bytes))
            rest = np.flatnonzero(rest)
            last = (c[0][-1], c[1][-1])
            c, raw = [x[rest] for x in c], [raw[i] for i in rest.tolist()]
            bounds = group_bounds(c[:2]).tolist() if len(raw) else [0]
            open_from = len(raw)
            if b is not None and len(raw) and (c[0][-1], c[1][-1]) == last:
                open_from = bounds[-2]
            sizes = np.cumsum([0, *map(len, raw)])
            cut = 0
            for e in bounds[1:]:
                if e > open_from:
                    break
                if sizes[e] - sizes[cut] >= most or e == open_from:
                    found.append(refined([x[cut:e] for x in c], raw[cut:e]))
                    cut = e
            kept_c, kept_raw = ([x[open_from:] for x in c], raw[open_from:]) if open_from < len(raw) else (None, [])
            out = spans(found)
            if out is not None:
                yield out

    return run


def _with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _hot_anchors(sample: DataFrame, sampled: int, rows: int, strings: int) -> DataFrame:
    """h, parts: anchors that some `rows` or more runs have, as a sample has it, and over how many parts their strings are dealt.

    Should there be more than MOST_HOT of them, only those stay whose number of runs is above the power of two at which no more than MOST_HOT are left."""
    least = max(2, rows // sampled)
    seen = sample.where("NOT again").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    seen = materialize(seen, "hot-anchors")
    by_size = {int(r.p): int(r.k) for r in seen.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 63 rows at most
    total = 0
    for p in sorted(by_size, reverse=True):
        total += by_size[p]
        if total > MOST_HOT:
            least = max(least, 1 << (p + 1))
            break
    return F.broadcast(seen.where(F.col("n") >= least).select("h", F.ceil(F.col("n") * (sampled * strings) / F.lit(8192.0)).cast("int").alias("parts")))


def duplicate_spans(docs: DataFrame, n_bytes: int = 100, q: int = Q, hot: int = 16_384, sampled: int = 64, chunk: int = CHUNK, most: int = 2 << 20, bits: int = 64, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc, tie, text, marks (runs to remove, and others), refined (spans to remove), row (the named columns).

    One hash shuffle of the anchors and one of the texts, which both joins share. hot: an anchor with so many runs is dealt
    over tasks string by string, each holding some 8000 strings; one document in `sampled` is looked at to find them.
    bits: hashes keep so many. Neither how a bucket is dealt nor what a hash says changes the result.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    row = [F.struct(*columns).alias("row")] if columns else []
    docs = docs.select(key.alias("doc"), F.col("text").cast("string").alias("text"), *row)
    twice = docs.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("_twice"))
    docs = docs.join(broadcast_if_under(twice, SMALL_SIDE), "doc", "left")
    docs = docs.select("doc", F.when(F.col("_twice"), F.xxhash64("text")).otherwise(F.lit(0)).alias("tie"), "text", *["row" for _ in row])
    texts = docs.select("doc", "tie", "text")
    sample = texts.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(sampled)) == 0).mapInArrow(_anchors(n_bytes, q, chunk, bits), _ANCHORS)
    hot_keys = _hot_anchors(sample, sampled, hot, n_bytes - q + 1)

    runs = texts.mapInArrow(_anchors(n_bytes, q, chunk, bits), _ANCHORS).join(hot_keys, "h", "left")
    runs = runs.withColumn("share", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc", "lo"), F.col("parts"))).otherwise(F.lit(-1)).cast("int"))
    runs = runs.repartition("h", "share").withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("h", "share")))
    kind = F.when(F.col("again"), 0).when(F.col("share") >= 0, 2).when(F.col("met") > 1, 1)
    marks = runs.withColumn("kind", kind).where("kind IS NOT NULL")
    by_doc = marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "h", "lo", "more", "parts")).alias("marks"))
    joined = docs.join(by_doc, ["doc", "tie"], "left")
    contexts = joined.select("doc", "tie", "text", "marks").mapInArrow(_contexts(n_bytes, bits), _CONTEXTS)
    contexts = contexts.repartition("h", "share").sortWithinPartitions("h", "share", "doc", "tie", "lo")
    refined = contexts.mapInArrow(_refined(n_bytes, most), "doc long, tie long, s int, e int")
    refined = refined.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("refined"))
    return joined.join(refined, ["doc", "tie"], "left")


def _apply(n_bytes: int, texts: bool):
    """Cuts the spans out: maximal runs, then the remaining bytes, as text or as a digest."""

    def run(batches):
        for b in batches:
            at1, (kind, lo, more) = _flat(b.column(2), ["kind", "lo", "more"])
            at2, (s2, e2) = _flat(b.column(3), ["s", "e"])
            doc = b.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                m = slice(at1[i], at1[i + 1])
                gone = kind[m] == 0
                s = np.append(lo[m][gone], s2[at2[i] : at2[i + 1]])
                e = np.append(lo[m][gone] + more[m][gone] + n_bytes, e2[at2[i] : at2[i + 1]])
                kept, at, n_spans = [], 0, 0
                if len(s):
                    order = s.argsort(kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                    n_spans = len(new)
                    for a, z in zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist(), strict=True):
                        kept.append(raw[at:a])
                        at = z
                kept.append(raw[at:])
                left = b"".join(kept)
                last = left.decode("utf-8", "ignore") if texts else hashlib.sha256(left).hexdigest()
                for col, v in zip(rows, (doc[i], len(raw), len(raw) - len(left), n_spans, last), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept", "row"]
            yield pa.RecordBatch.from_arrays([*arrays, *b.columns[4:]], names=names[: b.num_columns + 1])

    return run


def dedup_digests(docs: DataFrame, n_bytes: int = 100, **kw) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes. A null id is smaller than all others. Rows that share an id come one
    after another by a hash of their text; rows that share both are one document, and each gets its result.
    """
    out = duplicate_spans(docs, n_bytes, **kw).select("doc", "text", "marks", "refined")
    out = out.mapInArrow(_apply(n_bytes, False), "doc long, n_bytes long, n_removed long, n_spans long, kept string")
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def dedup_documents(docs: DataFrame, n_bytes: int = 100, columns: tuple[str, ...] = ("doc_id", "lang", "source", "n_chars"), **kw) -> DataFrame:
    """The documents with repeated bytes cut out of their texts, in the columns of documents; n_chars follows the text.

    Bytes of a character that a cut has split are dropped with it. A text cut to nothing stays as an empty one.
    """
    joined = duplicate_spans(docs, n_bytes, columns=columns, **kw).select("doc", "text", "marks", "refined", "row")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_apply(n_bytes, True), f"doc long, n_bytes long, n_removed long, n_spans long, kept string, row {kind}")
    text = F.col("kept")
    cut = F.col("n_removed") > 0
    return out.select(
        "row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(cut, F.char_length(text).cast("long")).otherwise(F.col("row.n_chars").cast("long")).alias("n_chars")
    )
