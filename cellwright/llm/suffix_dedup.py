"""Suffix-array dedup: byte strings of a given length that an earlier document also holds are removed.

1. Anchors (``passages``) mark the places that some other document may share; the bytes around each, all strings of
   ``length`` bytes that hold the anchor, go to the shard of the anchor's hash.
2. Each shard drops equal stretches, joins the rest to one text and sorts its suffixes by induction: suffixes are
   classed as smaller or larger than their right neighbours, leftmost-smaller substrings are induced, named and their
   order found by sorting the text of names in the same way, recursively; one more linear induction gives the array.
3. Permuted common prefixes say which neighbours of the array share ``length`` bytes. Each run of such neighbours gets
   its least document; strings in later documents are reported and removed by one join.

Defined results: null text is empty; a null id neither removes nor loses bytes; rows with one id are one age, so neither
removes the other's bytes; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import passages as ps
from cellwright.llm import textkit as tk

LENGTH, ANCHOR = 50, 24
#: Bytes of documents a shard to sort: suffix arrays take many times the bytes of their text, so these shards are small.
SORT_BYTES = 4 << 20
_NONE = np.iinfo(np.int64).max


# ---- induced sorting -------------------------------------------------------------------------------------------------


def smaller_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is not, as nothing follows it."""
    n = len(t)
    s = np.zeros(n, bool)
    if n > 1:
        differ = t[:-1] != t[1:]
        at = np.where(differ, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        known = nxt < n
        s[:-1][known] = (t[:-1] < t[1:])[nxt[known]]
    return s


def _deal(buckets: list[list], chars: np.ndarray, rows: np.ndarray) -> None:
    """Appends rows to the buckets of their characters, keeping their order."""
    if len(rows):
        order = np.argsort(chars, kind="stable")
        chars, rows = chars[order], rows[order]
        cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        ends = [*cut[1:].tolist(), len(rows)]
        for c, i, j in zip(chars[cut].tolist(), cut.tolist(), ends, strict=True):
            buckets[c].append(rows[i:j])


def _flow(queue: list, c: int, t: np.ndarray, want: np.ndarray, buckets: list[list]) -> np.ndarray:
    """Reads bucket c in scan order: predecessors of the wanted type go to their buckets, those of the same one are read next."""
    seen = []
    cur = np.concatenate(queue) if queue else np.zeros(0, np.int64)
    while len(cur):
        seen.append(cur)
        prev = cur[cur > 0] - 1
        prev = prev[want[prev]]
        chars = t[prev]
        _deal(buckets, chars[chars != c], prev[chars != c])
        cur = prev[chars == c]
    return np.concatenate(seen) if seen else np.zeros(0, np.int64)


def induce(t: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones ``left`` in order: one pass up and one down."""
    larger = ~small
    present = np.flatnonzero(np.bincount(t, minlength=256)).tolist()
    lms: list[list] = [[] for _ in range(256)]
    _deal(lms, t[left], left)
    up: list[list] = [[] for _ in range(256)]
    up[int(t[-1])].append(np.array([len(t) - 1]))
    large = {}
    for c in present:
        large[c] = _flow(up[c], c, t, larger, up)
        if lms[c]:
            own = np.concatenate(lms[c])
            prev = own[own > 0] - 1
            _deal(up, t[prev], prev)
    down: list[list] = [[] for _ in range(256)]
    out = []
    for c in reversed(present):
        own = _flow(down[c], c, t, small, down)
        out.append(own)
        back = large[c][::-1]
        prev = back[back > 0] - 1
        prev = prev[small[prev]]
        _deal(down, t[prev], prev)
        out.append(back)
    return np.concatenate(out)[::-1]


def _words_at(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, the first byte lowest; ``t`` has 8 bytes to spare."""
    return np.ndarray((len(t) - 8,), "<u8", t, 0, (1,))


def _same(w: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings of the given lengths at a and b are equal, eight bytes at a time."""
    same, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        beyond = (8 - np.minimum(length[live] - k, 8)).astype(np.uint64) * np.uint64(8)
        differ = (w[a[live] + k] ^ w[b[live] + k]) << beyond != 0
        same[live[differ]] = False
        k += 8
        live = live[~differ]
        live = live[length[live] > k]
    return same


def _same_names(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the runs of names of the given lengths at a and b are equal."""
    same, live, k = np.ones(len(a), bool), np.flatnonzero(length > 0), 0
    while len(live):
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
        live = live[length[live] > k]
    return same


def _after_run(t: np.ndarray) -> np.ndarray:
    """For each place the first one after it with another name; the length at the end."""
    n = len(t)
    at = np.where(np.append(t[:-1] != t[1:], True), np.arange(1, n + 1), n)
    return np.minimum.accumulate(at[::-1])[::-1]


ROUNDS = 40


def _grouped(t: np.ndarray, own: np.ndarray, after: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """``own`` by name, length of the run of equal names and the name that follows, in scan order; and each one's group of equals."""
    n, names = len(t), int(t.max()) + 2
    nxt = after[own]
    run, name = nxt - own, np.where(nxt < n, t[np.minimum(nxt, n - 1)], -1) + 1
    first, follows = (t[own], name) if sign > 0 else (names - t[own], names - name)
    if (names + 1) ** 2 * (int(run.max()) + 1) < 1 << 62:
        key = (first * (run.max() + 1) + run) * (names + 1) + follows
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = key[1:] != key[:-1]
    else:
        order = np.lexsort((follows, run, first))
        fresh = np.any([x[order][1:] != x[order][:-1] for x in (first, run, follows)], axis=0)
    return own[order], np.concatenate([[0], np.cumsum(fresh)])


def _ordered_type(t: np.ndarray, own: np.ndarray, after: np.ndarray, base: np.ndarray, sign: int) -> np.ndarray:
    """The suffixes ``own`` of one type in order, induced from what follows their runs of equal names.

    Names are passed upwards (sign 1, larger suffixes) or downwards (-1, smaller ones); within a name, a longer run comes later
    among larger suffixes and sooner among smaller ones. Only suffixes with equals in all of that need the place of what
    follows them, which is in ``base`` already or comes earlier in the same pass. Groups are ordered again where such places
    move, which soon ends in most texts; after ``ROUNDS`` of that all are ordered once more, each when what it waits for
    has its place, so that no text takes more than linear work.
    """
    if not len(own):
        return own
    rows, group = _grouped(t, own, after, sign)
    base[rows] = np.arange(len(rows))
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)
    mine, of, follow = rows[tied], group[tied], after[rows[tied]]
    size[size == 1] = 0
    first = np.cumsum(size) - size
    # who waits for a place that may move: their numbers in ``mine``, one stretch a place
    moving = np.zeros(len(t) + 1, bool)
    moving[mine] = True
    waits = np.flatnonzero(moving[follow])
    waits = waits[np.argsort(follow[waits])]
    wait_from = np.concatenate([[0], np.cumsum(np.bincount(follow[waits], minlength=len(t) + 1))])
    groups, rounds = np.flatnonzero(size), 0
    while len(groups) and rounds < ROUNDS:
        rounds += 1
        at = _stretches(first[groups], size[groups])
        by = at[np.argsort(of[at] * (4 * len(t)) + base[follow[at]], kind="stable")]
        moved = mine[by][base[mine[by]] != tied[at]]
        base[mine[by]] = tied[at]
        groups = np.unique(of[waits[_stretches(wait_from[moved], wait_from[moved + 1] - wait_from[moved])]])
    left = np.bincount(of[waits], minlength=len(size))
    ready = np.flatnonzero((size > 0) & (left == 0)) if len(groups) else groups
    while len(ready):
        at = _stretches(first[ready], size[ready])
        by = at[np.argsort(of[at] * (4 * len(t)) + base[follow[at]])]
        base[mine[by]] = tied[at]
        placed = wait_from[mine[at]]
        freed = of[waits[_stretches(placed, wait_from[mine[at] + 1] - placed)]]
        np.subtract.at(left, freed, 1)
        ready = np.unique(freed[left[freed] == 0])
    rows[base[rows]] = rows.copy()
    return rows


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def induce_names(t: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """``induce`` for texts of any numbers: the same two passes, over all names at once."""
    n = len(t)
    after = _after_run(t)
    base = np.full(n + 1, -1, np.int64)  # the end comes before all
    base[left] = n + np.arange(len(left))  # within one name, smaller suffixes follow all larger ones
    large = _ordered_type(t, np.flatnonzero(~small), after, base, 1)
    base[large] = n + n - np.arange(len(large))  # downwards, larger suffixes come after all smaller ones of their name
    down = _ordered_type(t, np.flatnonzero(small), after, base, -1)
    rows = np.concatenate([large, down[::-1]])
    return rows[np.argsort(t[rows], kind="stable")]


def suffix_array(t: np.ndarray, dense: bool = False) -> np.ndarray:
    """The suffixes of a text of bytes or of other whole numbers (``dense``: all from 0 to the largest) in order, by induced sorting.

    Leftmost-smaller substrings are induced from any order of their starts and named; unless all names differ, the text of
    names is sorted by this function again. One more induction from their order gives the array.
    """
    bytewise = t.dtype == np.uint8
    t = np.ascontiguousarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    if not bytewise and not dense:
        t = np.unique(t, return_inverse=True)[1].astype(np.int64)
    small = smaller_types(t)
    is_left = np.zeros(n, bool)
    is_left[1:] = small[1:] & ~small[:-1]
    left = np.flatnonzero(is_left)
    by_type = induce if bytewise else induce_names
    if len(left) > 1:
        rough = by_type(t, small, left)
        by = rough[is_left[rough]]
        rank_of = np.empty(n, np.int64)
        rank_of[left] = np.arange(len(left))
        length = np.append(np.diff(left) + 1, n)  # the last one reaches the end and equals no other
        i = rank_of[by]
        a, b, la, lb = by[:-1], by[1:], length[i[:-1]], length[i[1:]]
        same = la == lb
        if bytewise:
            same[same] = _same(_words_at(np.concatenate([t, np.zeros(16, np.uint8)])), a[same], b[same], la[same])
        else:
            same[same] = _same_names(t, a[same], b[same], la[same])
        name = np.empty(len(left), np.int64)
        name[i] = np.concatenate([[0], np.cumsum(~same)])
        left = by if name.max() == len(left) - 1 else left[suffix_array(name, True)]
    return by_type(t, small, left)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text, the bytes shared with the suffix before it in the array, up to ``most``.

    Where the bytes before both suffixes are equal, the place shares one byte less than the place before it does with its own
    neighbour; so only the others are compared, and these all the way.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    apart = np.ones(n, bool)
    apart[1:] = (phi[1:] <= 0) | (t[:-1] != t[phi[1:] - 1])
    at = np.flatnonzero(apart & (phi >= 0))
    other = phi[at]
    room = n - np.maximum(at, other)
    w = _words_at(np.concatenate([t, np.zeros(16, np.uint8)]))
    shared = np.zeros(len(at), np.int64)
    live, k = np.arange(len(at)), 0
    while len(live):
        x = w[at[live] + k] ^ w[other[live] + k]
        same = x == 0
        x = x[~same]
        shared[live[~same]] = k + (np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1) // 8  # the lowest bit that differs
        live = live[same]
        k += 8
        shared[live] = k
        live = live[room[live] > k]
    out = np.zeros(n, np.int64)
    out[at] = np.minimum(shared, room)
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(apart, place, 0))
    return np.clip(out[last] - (place - last), 0, most)


# ---- tasks -----------------------------------------------------------------------------------------------------------


def _stretch(length: int, k: int):
    width = 2 * length - k
    head = [("doc_id", "<i8"), ("th", "<i4"), ("p", "<u4"), ("lo", "<i2"), ("hi", "<i2")]
    return width, np.dtype([*head, ("b", "u1", (width,))])


def _packed(e: np.ndarray, width: int) -> bytes:
    """Heads byte column by byte column, then the stretches one after the other."""
    raw = e.view(np.uint8).reshape(len(e), -1)
    head = np.ascontiguousarray(raw[:, : e.dtype.itemsize - width].T).tobytes()
    body = zstandard.compress(head + np.ascontiguousarray(e["b"]).tobytes(), 3)
    return len(e).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def _unpacked(data: bytes, entry: np.dtype, width: int) -> list[np.ndarray]:
    """The parts of a block, each as its rows."""
    out, i = [], 0
    while i < len(data):
        n, size = int.from_bytes(data[i : i + 4], "little"), int.from_bytes(data[i + 4 : i + 8], "little")
        part = np.frombuffer(zstandard.decompress(data[i + 8 : i + 8 + size]), np.uint8)
        cut = (entry.itemsize - width) * n
        raw = np.empty((n, entry.itemsize), np.uint8)
        raw[:, : entry.itemsize - width] = part[:cut].reshape(-1, n).T
        raw[:, entry.itemsize - width :] = part[cut:].reshape(n, width)
        out.append(raw.view(entry).ravel())
        i += 8 + size
    return out


def _map_stretches(length: int, k: int, shards: int):
    """Cuts the bytes around each shared anchor; of equal ones in a batch the least document's goes to the shard."""
    width, entry = _stretch(length, k)
    back, windows = length - k, length - k + 1

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            buf, offs = tk.text_column(batch, "text")
            ids, ths = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            places = ps.places_column(batch, "<u4")
            done_rows: list[int] = []
            done: list[bytes] = []
            sent: dict[int, list[bytes]] = {}
            weight = np.cumsum([0, *(len(x) for x in places)]).astype(np.int64)
            for i, j in tk.slices(weight, 40_000):
                doc = np.repeat(np.arange(i, j), np.diff(weight[i : j + 1]))
                p = np.concatenate(places[i:j]).astype(np.int64)
                lo = np.maximum(0, back - p)
                hi = np.minimum(width, offs[doc + 1] - offs[doc] - p + back)
                col = np.arange(width)[None]
                at = np.clip((offs[doc] + p - back)[:, None] + col, 0, max(len(buf) - 1, 0))
                e = np.zeros(len(p), entry)
                e["b"] = np.where((col >= lo[:, None]) & (col < hi[:, None]), buf[at], 0)
                e["doc_id"], e["th"], e["p"], e["lo"], e["hi"] = ids[doc], ths[doc], p, lo, hi
                body = tk.BYTE_WORD[e["b"][:, back : back + k]] * tk.powers(k)[None]
                anchor = tk.mix(body.sum(1, dtype=np.uint64))
                whole = tk.mix((tk.BYTE_WORD[e["b"]] * tk.powers(width)[None]).sum(1, dtype=np.uint64) + (lo * 512 + hi).astype(np.uint64))
                order = np.lexsort((e["doc_id"], whole))
                e, anchor, whole, row = e[order], anchor[order], whole[order], doc[order]
                head = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(e) else np.zeros(0, bool)
                first = np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))
                later = (e["doc_id"] > e["doc_id"][first]) & (e["b"] == e["b"][first]).all(1) & (e["lo"] == e["lo"][first]) & (e["hi"] == e["hi"][first])
                mask = _all_windows(e["lo"][later], e["hi"][later], length, windows)
                marks = np.stack([e["p"][later].astype("<u4"), mask], 1)
                own = row[later]
                o = np.argsort(own, kind="stable")
                own, marks = own[o], marks[o]
                cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                done_rows += own[cut].tolist()
                done += tk.ragged(marks, np.append(cut, len(own)))
                e, shard = e[~later], (anchor[~later] % np.uint64(shards)).astype(np.int64)
                o = np.argsort(shard, kind="stable")
                e, shard = e[o], shard[o]
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
                for s, x, y in zip(shard[cut].tolist(), cut, np.append(cut, len(e))[1:], strict=True):
                    sent.setdefault(s, []).append(_packed(e[x:y], width))
            m, q = len(sent), len(done)
            at = np.array(done_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.fromiter(sent, np.int64, m), np.arange(q) % shards]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(m, np.int64), ids[at]])),
                    pa.array(np.concatenate([np.zeros(m, np.int64), ths[at]])),
                    pa.array([b"".join(x) for x in sent.values()] + done, pa.binary()),
                    pa.array([True] * m + [False] * q),
                ],
                names=["shard", "doc_id", "th", "places", "asks"],
            )

    return run


def _all_windows(lo: np.ndarray, hi: np.ndarray, length: int, windows: int) -> np.ndarray:
    """Bits of the strings that fit between lo and hi."""
    j = np.arange(windows)[None]
    fits = (j >= lo[:, None]) & (j + length <= hi[:, None])
    return (fits * (1 << j)).sum(1).astype("<u4")


def _may_share(b: np.ndarray, least: np.ndarray, most: np.ndarray, length: int, k: int) -> np.ndarray:
    """Stretches that agree with another document's on half of what a string adds to the anchor, to its left or right.

    Two equal strings around an anchor do so on one side at least; all other stretches need no sorting.
    """
    back, half = length - k, -(-(length - k) // 2)
    keep = np.zeros(len(b), bool)
    for part in (b[:, back - half : back + k], b[:, back : back + k + half]):
        h = tk.mix((tk.BYTE_WORD[part] * tk.powers(part.shape[1])[None]).sum(1, dtype=np.uint64))
        order = np.argsort(h, kind="stable")
        h = h[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        differ = np.minimum.reduceat(least[order], head) != np.maximum.reduceat(most[order], head)
        keep[order] |= np.repeat(differ, np.diff(np.append(head, len(h))))
    return keep


def _sort_shard(length: int, k: int):
    width, entry = _stretch(length, k)
    windows = length - k + 1

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("places", pa.binary())])
        asks = table.column("asks")
        out = [table.filter(pa.compute.invert(asks)).select(["doc_id", "th", "places"]).cast(schema)]
        data = [e for x in table.filter(asks).column("places").to_pylist() for e in _unpacked(x, entry, width)]
        if data:
            e = np.concatenate(data)
            body = np.ascontiguousarray(np.concatenate([e["b"], e["lo"][:, None].astype(np.uint8), e["hi"][:, None].astype(np.uint8)], 1))
            _, first, of = np.unique(body.view(f"V{width + 2}").ravel(), return_index=True, return_inverse=True)
            least, most = np.full(len(first), _NONE), np.full(len(first), -_NONE)
            np.minimum.at(least, of, e["doc_id"])
            np.maximum.at(most, of, e["doc_id"])
            keep = _may_share(e["b"][first], least, most, length, k)
            stays = keep[of]
            of, e = (np.cumsum(keep) - 1)[of[stays]], e[stays]
            if not len(e):
                return pa.concat_tables(out)
            first = np.unique(of, return_index=True)[1]
            least = least[keep]
            text = np.ascontiguousarray(e["b"][first]).ravel()
            sa = suffix_array(text)
            shares = permuted_prefixes(text, sa, length)[sa] >= length
            head = np.flatnonzero(~shares)
            where, col = sa // width, sa % width
            fits = (col >= e["lo"][first][where]) & (col + length <= e["hi"][first][where])
            doc = np.where(fits, least[where], _NONE)
            low = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(sa))))
            by_place = np.full(len(text), _NONE)
            by_place[sa[fits]] = low[fits]
            by_place = by_place.reshape(-1, width)[:, :windows]
            hit = np.zeros(len(e), "<u4")
            for j in range(windows):
                hit |= ((by_place[of, j] < e["doc_id"]).astype("<u4") << np.uint32(j)).astype("<u4")
            e, hit = e[hit > 0], hit[hit > 0]
            order = np.lexsort((e["p"], e["th"], e["doc_id"]))
            e, hit = e[order], hit[order]
            if len(e):
                cut = np.flatnonzero(np.concatenate([[True], (e["doc_id"][1:] != e["doc_id"][:-1]) | (e["th"][1:] != e["th"][:-1])]))
                marks = tk.ragged(np.stack([e["p"].astype("<u4"), hit], 1), np.append(cut, len(e)))
                out.append(pa.table([pa.array(e["doc_id"][cut].copy()), pa.array(e["th"][cut].astype(np.int64)), pa.array(marks, pa.binary())], schema=schema))
        return pa.concat_tables(out)

    return run


def _cut(length: int, k: int):
    def run(batches):
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            n_bytes, n_removed, spans, kept = [], [], [], []
            for i, marks in enumerate(ps.places_column(batch, "<u4")):
                own = buf[offs[i] : offs[i + 1]]
                starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                rest = own
                if len(marks):
                    marks = marks.reshape(-1, 2).astype(np.int64)
                    j = np.arange(length - k + 1)[None]
                    at = ((marks[:, :1] + k - length + j)[(marks[:, 1:] >> j & 1) > 0]).ravel()
                    step = np.bincount(at, minlength=len(own) + 1) - np.bincount(at + length, minlength=len(own) + 1)
                    gone = np.cumsum(step)[: len(own)] > 0
                    starts, ends = tk.spans_of(gone)
                    rest = own[~gone]
                n_bytes.append(len(own))
                n_removed.append(int((ends - starts).sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                kept.append(rest.tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges), kept (the other bytes, joined), a row per document."""
    if not 0 < anchor <= length or length - anchor > 31:
        raise ValueError("the anchor must be at most 31 bytes shorter than the removed strings")
    texts = ps.keyed(docs, id_col, text_col)
    shards = ps.shard_count(docs, text_col)
    near = ps.joined(texts, ps.shared_anchors(texts, "byte", length, anchor, shards), "inner")
    shards = shards * max(1, ps.SHARD_BYTES // SORT_BYTES)
    stretches = near.mapInArrow(_map_stretches(length, anchor, shards), f"shard int, {ps.PLACES}, asks boolean")
    marks = stretches.repartition(shards, "shard").groupBy("shard").applyInArrow(_sort_shard(length, anchor), ps.PLACES)
    out = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return ps.joined(texts, marks, "left").mapInArrow(_cut(length, anchor), out)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(tk.table_of(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
