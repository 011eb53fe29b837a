"""Substring dedup by level-wise doubling: only windows of words that repeat are looked at again at twice the length.

1. The first level takes windows of ``FIRST`` words. Any window of the wanted length holds one whose hash is the least
   around it (``passages``), chosen by its words alone; those that another document also holds survive.
2. Each further level extends every survivor to twice its length, once to the left and once to the right: as long as three
   of its lengths fit the wanted one, one of both lies within any wanted window around it. Those that repeat survive.
3. The last level extends survivors to all windows of the wanted length around them and keeps those that start in a
   document with a smaller id. A longer repeat is covered by its windows. Levels follow from the lengths; where no candidate
   survives, Spark finds the side of the next join empty and skips what follows.

Windows are compared by the hashes of their words, at the last level by two that come from different byte tables.

Defined results: words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return;
null text has none; a null id neither removes nor loses words; rows with one id are one age; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import passages as ps
from cellwright.llm import textkit as tk

WINDOW, FIRST = 50, 8
#: A second random word for each byte value.
OTHER_WORD = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("d", "<u4"), ("s", "<u4")])


def _entries_of(batch: pa.RecordBatch, candidates) -> np.ndarray:
    """The windows of a batch that ``candidates`` makes of each slice's words and surviving places."""
    buf, offs = tk.text_column(batch, "text")
    places = ps.places_column(batch, "<u4")
    parts = []
    for i, j in tk.slices(offs):
        part = buf[offs[i] : offs[j]]
        starts, ends, head = tk.words(part, offs[i : j + 1] - offs[i], ~ps.SPACE)
        doc = np.repeat(np.arange(i, j), [len(x) for x in places[i:j]])
        at = head[doc - i] + np.concatenate(places[i:j]).astype(np.int64)
        if not len(at):
            continue
        start, a, b = candidates(part, starts, ends, at, head[doc - i], head[doc - i + 1])
        e = np.zeros(len(start), ENTRY)
        d = np.searchsorted(head, start, "right") - 1
        e["a"], e["b"], e["d"], e["s"] = a, b, d + i, start - head[d]
        parts.append(e)
    return np.concatenate(parts) if parts else np.zeros(0, ENTRY)


def _hashes(part, starts, ends, size: int, other: bool = False) -> np.ndarray:
    return tk.window_hashes(tk.word_hashes(part, starts, ends, OTHER_WORD) if other else tk.word_hashes(part, starts, ends), size)


def _wider(size: int):
    """Candidates of twice the length: each survivor with as many words before it, and with as many after it."""

    def candidates(part, starts, ends, at, low, high):
        start = np.concatenate([at[at - size >= low] - size, at[at + 2 * size <= high]])
        start = np.unique(start)
        h = _hashes(part, starts, ends, 2 * size)[start] if len(start) else np.zeros(0, np.uint64)
        return start, h, h

    return candidates


def _around(window: int, size: int):
    """Candidates of the wanted length: all windows of a document that hold a survivor."""

    def candidates(part, starts, ends, at, low, high):
        step = np.zeros(len(starts) + 1, np.int64)
        first, last = np.maximum(low, at + size - window), np.minimum(at, high - window)
        fits = first <= last
        np.add.at(step, first[fits], 1)
        np.add.at(step, last[fits] + 1, -1)
        start = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        if not len(start):
            return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return start, _hashes(part, starts, ends, window)[start], _hashes(part, starts, ends, window, True)[start]

    return candidates


def _map_windows(candidates, last: bool, shards: int):
    """Windows by shard of their hash; what a batch settles by itself passes: of equal windows in several documents, all (or
    at the last level the later ones) survive, and one entry of the least document stands for them in the shard."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ids, ths = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            keys = np.zeros(len(batch), ps.KEY)
            keys["doc_id"], keys["th"] = ids, ths
            e = _entries_of(batch, candidates)
            e = e[np.lexsort((ids[e["d"]], e["b"], e["a"]))]
            new = np.concatenate([[True], (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]) if len(e) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            if last:
                lead = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
                settled, asks = ids[e["d"]] > ids[e["d"][lead]], None
            else:
                many = np.maximum.reduceat(e["d"], head) != np.minimum.reduceat(e["d"], head) if len(e) else new
                settled = np.repeat(many, np.diff(np.append(head, len(e))))
                asks = e[head[many]]
                asks["s"] = ps.SEEN_TWICE
            own, done = ps._by_doc(e["d"][settled].astype(np.int64), e["s"][settled], keys, len(keys))
            e = e[~settled] if last else np.concatenate([e[~settled], asks])
            shard = (tk.mix(e["b"].copy()) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            e, shard = e[order], shard[order]
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(e) else np.zeros(0, np.int64)
            data, tables = [], []
            for x, y in zip(cut, np.append(cut, len(e))[1:], strict=True):
                part = e[x:y]
                used, part["d"] = np.unique(part["d"], return_inverse=True)
                data.append(tk.packed(part))
                tables.append(tk.packed(keys[used]))
            m, q = len(cut), len(done)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([shard[cut], np.arange(q) % shards]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(m, np.int64), own["doc_id"]])),
                    pa.array(np.concatenate([np.zeros(m, np.int64), own["th"]])),
                    pa.array(data + done, pa.binary()),
                    pa.array(tables + [None] * q, pa.binary()),
                ],
                names=["shard", "doc_id", "th", "data", "keys"],
            )

    return run


def _survivors(last: bool):
    """Of one shard: the windows that another document also holds; at the last level, that start in one with a smaller id."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("places", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("keys").is_valid()
        out = [table.filter(pa.compute.invert(asks)).select(["doc_id", "th", "data"]).rename_columns(["doc_id", "th", "places"]).cast(schema)]
        entries, keys, base = [], [], 0
        asked = table.filter(asks)
        for data, tab in zip(asked.column("data").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            e, own = tk.unpacked(data, ENTRY), tk.unpacked(tab, ps.KEY)
            e["d"] += base
            base += len(own)
            entries.append(e)
            keys.append(own)
        if entries:
            e, key = np.concatenate(entries), np.concatenate(keys)
            e = e[np.lexsort((e["b"], e["a"]))]
            head = np.flatnonzero(np.concatenate([[True], (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]))
            size = np.diff(np.append(head, len(e)))
            if last:
                ids = key["doc_id"][e["d"]]
                e = e[ids > np.repeat(np.minimum.reduceat(ids, head), size)]
            else:
                shared = (np.maximum.reduceat(e["d"], head) != np.minimum.reduceat(e["d"], head)) | (np.maximum.reduceat(e["s"], head) == ps.SEEN_TWICE)
                e = e[np.repeat(shared, size) & (e["s"] != ps.SEEN_TWICE)]
            own, places = ps._by_doc(e["d"].astype(np.int64), e["s"], key, len(key))
            out.append(pa.table([pa.array(own["doc_id"].copy()), pa.array(own["th"].copy()), pa.array(places, pa.binary())], schema=schema))
        return pa.concat_tables(out)

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            places = ps.places_column(batch, "<u4")
            n_words, n_removed, spans, kept = [], [], [], []
            for i, j in tk.slices(offs):
                part = buf[offs[i] : offs[j]]
                starts, ends, head = tk.words(part, offs[i : j + 1] - offs[i], ~ps.SPACE)
                for d in range(i, j):
                    a, b = head[d - i], head[d - i + 1]
                    gone = np.zeros(b - a, bool)
                    if len(places[d]):
                        at = places[d].astype(np.int64)
                        step = np.bincount(at, minlength=b - a + 1) - np.bincount(at + window, minlength=b - a + 1)
                        gone = np.cumsum(step)[: b - a] > 0
                    x, y = tk.spans_of(gone)
                    n_words.append(int(b - a))
                    n_removed.append(int(gone.sum()))
                    spans.append([{"start": p, "end": q} for p, q in zip(x.tolist(), y.tolist(), strict=True)])
                    stay = np.flatnonzero(~gone) + a
                    kept.append(_join(part, starts[stay], ends[stay]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


def _join(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one space: each word's bytes and the byte after it, which becomes a space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    stop = np.cumsum(size)
    at = np.arange(stop[-1]) - np.repeat(stop - size, size) + np.repeat(starts, size)
    out = buf[np.minimum(at, len(buf) - 1)]
    out[stop - 1] = 32
    return out[:-1].tobytes()


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges), kept (the other words, joined by a space)."""
    texts = ps.keyed(docs, id_col, text_col)
    shards = ps.shard_count(docs, text_col)

    def level(places: DataFrame, candidates, last: bool) -> DataFrame:
        windows = ps.joined(texts, places, "inner").mapInArrow(_map_windows(candidates, last, shards), ps.ANCHORS)
        return windows.repartition(shards, "shard").groupBy("shard").applyInArrow(_survivors(last), ps.PLACES)

    size = min(first, window)
    places = ps.shared_anchors(texts, "word", window, size, shards)
    while 3 * size <= window:
        places, size = level(places, _wider(size), False), 2 * size
    later = level(places, _around(window, size), True)
    out = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    return ps.joined(texts, later, "left").mapInArrow(_cut(window), out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(tk.table_of(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
