"""Benchmark decontamination: an FM-index per shard of training text, searched for every window of the test items.

A shard is a bounded slice of a partition. Words that no item has, and runs of words shorter than the shortest window,
cannot be part of an occurrence: they become breaks, and the index covers the rest. Windows are searched backward through
wavelet ranks, all of a shard together, located by sampled suffix places and merged to removal spans. Documents are not
shuffled. Items are the query set: their bytes are measured first, and more than ``BLOCK_BYTES`` of them are searched in
blocks, each broadcast by itself, that pass over the same rows one after the other and add to the same spans.

Defined results: letters A-Z are lower-cased; null or wordless text has no words and is not contaminated; an item without
words has no window; null item ids are ignored; words compare by 64-bit hashes; repeated rows give repeated results;
items given twice count once; an empty table on either side gives no hits; other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cellwright.llm import textkit as tk
from cellwright.llm.fm_index import FMIndex

WINDOW, BLOCK_BYTES, SHARE = 13, 8 << 20, 20
#: Bytes of words after lower-casing: digits, letters and whatever is not ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BREAK, FIRST = 1, 2
STATE, DONE = "hits binary", "n_hit long, spans array<struct<start:long,end:long>>"


def _prepare(items: list[tuple[str, str]], window: int) -> dict:
    """Sorted word hashes, the distinct windows by length as word numbers, and the items of each window."""
    texts = [t.encode() for _, t in items]
    offs = np.cumsum([0, *map(len, texts)])
    buf = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, first = tk.words(buf, offs, WORD)
    vocab, word = np.unique(tk.word_hashes(buf, starts, ends), return_inverse=True)
    word = word + FIRST
    windows: dict[tuple, set[int]] = {}
    for i in range(len(items)):
        own = word[first[i] : first[i + 1]].tolist()
        for k in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).add(i)
    groups = []
    for size in sorted({len(w) for w in windows}):
        phrases = [w for w in windows if len(w) == size]
        owners = [sorted(windows[w]) for w in phrases]
        groups.append((np.array(phrases, np.int64), np.cumsum([0, *map(len, owners)]), np.concatenate(owners).astype(np.int64)))
    return {"vocab": vocab, "groups": groups, "names": [i for i, _ in items]}


def search_slice(buf: np.ndarray, offs: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Each document's first word, hit word starts and ends (disjoint, in order), and each document's items."""
    buf = LOWER[buf]
    starts, ends, first = tk.words(buf, offs, WORD)
    items: list[list[str]] = [[] for _ in range(len(offs) - 1)]
    none = np.zeros(0, np.int64)
    vocab = known["vocab"]
    if not len(starts) or not known["groups"]:
        return first, none, none, items
    h = tk.word_hashes(buf, starts, ends)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    found = vocab[at] == h
    head = np.zeros(len(h), bool)
    head[first[:-1][first[:-1] < len(h)]] = True
    # runs of known words within one document, long enough for the shortest window
    index = np.flatnonzero(found)
    if not len(index):
        return first, none, none, items
    fresh = np.concatenate([[True], np.diff(index) > 1]) | head[index]
    run = np.cumsum(fresh) - 1
    index = index[np.bincount(run)[run] >= known["groups"][0][0].shape[1]]
    if not len(index):
        return first, none, none, items
    fresh = np.concatenate([[False], (np.diff(index) > 1) | head[index[1:]]])
    spot = np.arange(len(index)) + np.cumsum(fresh)
    text = np.full(int(spot[-1]) + 1, BREAK, np.int64)
    text[spot] = at[index] + FIRST
    word_at = np.zeros(len(text), np.int64)
    word_at[spot] = index
    fm = FMIndex(text, len(vocab) + FIRST)
    step = np.zeros(len(h) + 1, np.int64)
    pairs = []
    for phrases, cut, owners in known["groups"]:
        lo, hi = fm.search(phrases)
        hit = np.flatnonzero(hi > lo)
        count = (hi - lo)[hit]
        if not len(hit):
            continue
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
        begin = word_at[fm.locate(rows)]
        np.add.at(step, begin, 1)
        np.add.at(step, begin + phrases.shape[1], -1)
        doc = np.searchsorted(first, begin, "right") - 1
        seen = np.unique(np.stack([doc, np.repeat(hit, count)], 1), axis=0)
        each = np.diff(cut)[seen[:, 1]]
        own = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(cut[seen[:, 1]], each)
        pairs.append(np.stack([np.repeat(seen[:, 0], each), owners[own]], 1))
    for d, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
        items[d].append(known["names"][i])
    covered = np.cumsum(step)[:-1] > 0
    begin, stop = tk.spans_of(covered)
    # spans of neighbouring documents may touch
    cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(h))]
    cuts = np.unique(cuts[covered[cuts] & covered[cuts - 1]])
    return first, np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([stop, cuts])), items


def _union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for x in (a, b):
        np.add.at(step, x[:, 0], 1)
        np.add.at(step, x[:, 1], -1)
    return np.stack(tk.spans_of(np.cumsum(step)[:-1] > 0), 1)


def _texts_of(batch: pa.RecordBatch, inside: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The texts: a column of their own, or field ``inside`` of the carried rows."""
    if inside is None:
        return tk.text_column(batch, "text")
    return tk.text_column(pa.RecordBatch.from_arrays([batch.column("row").field(inside)], names=["text"]), "text")


def _spans(hits: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """How many words the spans of each document cover, and the spans."""
    bounds = np.cumsum([0, *map(len, hits)])
    flat = np.concatenate([np.zeros((0, 2), np.int64), *hits])
    total = np.concatenate([[0], np.cumsum(flat[:, 1] - flat[:, 0])])[bounds]
    spans = pa.StructArray.from_arrays([pa.array(flat[:, k].copy(), pa.int64()) for k in (0, 1)], names=["start", "end"])
    return pa.array(np.diff(total), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)


def _map_search(shared, inside: int | None, last: bool):
    """Adds a block's hits to those of the blocks before it (columns ``hits`` and ``items``, if any); the last block's rows are results."""

    def run(batches):
        known = shared.value
        for batch in batches:
            buf, offs = _texts_of(batch, inside)
            later = "hits" in batch.schema.names
            before_hits, before_items = (batch.column(c).to_pylist() if later else [None] * len(batch) for c in ("hits", "items"))
            hits, lists, counts = [], [], []
            for i, j in tk.slices(offs):
                first, begin, stop, items = search_slice(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], known)
                cut = np.searchsorted(begin, first)
                for d in range(i, j):
                    n = int(first[d - i + 1] - first[d - i])
                    own = np.stack([begin, stop], 1)[cut[d - i] : cut[d - i + 1]] - first[d - i]
                    if before_hits[d]:
                        own = _union(np.frombuffer(before_hits[d], "<i8").reshape(-1, 2), own, n)
                    hits.append(own)
                    lists.append(sorted({*(before_items[d] or []), *items[d - i]}))
                    counts.append(n)
            kept = {c: batch.column(c) for c in batch.schema.names if c == "row" or c == "text" and not last}
            found = {"n_words": pa.array(counts, pa.int64()), "items": pa.array(lists, pa.list_(pa.string()))}
            if last:
                found["n_hit"], found["spans"] = _spans(hits)
            else:
                found["hits"] = pa.array([x.astype("<i8").tobytes() for x in hits], pa.binary())
            yield pa.RecordBatch.from_pydict(kept | found)
            del batch, buf, kept, found
            tk.release()

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (carried columns, all by default), n_words, n_hit, items (ids as sorted strings), spans (of words), contaminated."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item IS NOT NULL").distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    rows = tk.carried(docs, text_col, carry)
    # a text that the rows carry goes to Python once, within them; one pass of one worker, however many tasks an executor runs
    carried = rows.schema["row"].dataType
    inside = next((i for i, f in enumerate(carried.fields) if f.name == text_col and f.dataType == K.StringType()), None)
    rows = rows if inside is None else rows.select("row")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        shared = spark.sparkContext.broadcast(_prepare([(r.item, r.text) for r in block], window))
        last = b == blocks - 1
        text = "" if inside is not None or last else "text string, "
        rows = rows.mapInArrow(_map_search(shared, inside, last), tk.carried_schema(rows, f"{text}n_words long, items array<string>, {DONE if last else STATE}"))
    done = rows.select("row", "n_words", "n_hit", "items", "spans")
    return done.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(tk.table_of(spark, sf_dir, "documents"), tk.table_of(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return done.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )
