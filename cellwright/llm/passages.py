"""Passages of a fixed length that repeat across documents: shared machinery of the substring operators.

A passage of ``length`` tokens holds at least one *anchor*: a run of ``k`` tokens whose hash is the least among the
``length - k + 1`` runs in the passage. Anchors depend on content alone, so equal passages hold equal anchors, and two
documents can share a passage only where they share an anchor. ``shared_anchors`` finds those places with one shuffle of
compact blocks; the operators then look at the tokens around them only. Nothing is capped: a run that is frequent within
a batch is settled there and sends one representative on, so a shard gets at most one row a batch for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

#: An entry of a shard: 32 bits of the anchor's hash, the document's place in the block's table, the token's place.
ENTRY = np.dtype([("h", "<u4"), ("d", "<u4"), ("p", "<u4")])
KEY = np.dtype([("doc_id", "<i8"), ("th", "<i8")])
SPACE = tk.byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
SEEN_TWICE = np.uint32(0xFFFFFFFF)
SHARD_BYTES = 32 << 20
ANCHORS = "shard int, doc_id long, th long, data binary, keys binary"
PLACES = "doc_id long, th long, places binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key that is never null: id and 32 bits of the text's hash, so that rows with one id and different texts stay apart.

    As no key is null, inner and outer joins ask for the same exchange of the texts, and Spark makes it once.
    """
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(0)).alias("key"), F.shiftright(F.xxhash64(F.col(text_col), ident.isNull()), 32).alias("th"), F.col(text_col).alias("text"))


def shard_count(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards grow in number, not in size, with the bytes of the texts."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // shard_bytes))


def token_arrays(buf: np.ndarray, offs: np.ndarray, unit: str):
    """Tokens as 64-bit words, each document's first token, and, for words, their starts and ends."""
    if unit == "byte":
        return tk.BYTE_WORD[buf], offs, None, None
    starts, ends, first = tk.words(buf, offs, ~SPACE)
    return tk.word_hashes(buf, starts, ends), first, starts, ends


def _anchors_of(buf, offs, unit, length, k):
    """Hash, document and token place of each anchor in a slice."""
    tok, first, _, _ = token_arrays(buf, offs, unit)
    h = tk.window_hashes(tok, k)
    at = tk.winnow(h, length - k + 1)
    doc = np.searchsorted(first, at, "right") - 1
    keep = (at + k <= first[doc + 1]) & (first[doc + 1] - first[doc] >= length)
    at, doc = at[keep], doc[keep]
    return h[at], doc, (at - first[doc]).astype(np.uint32)


def _by_doc(doc: np.ndarray, place: np.ndarray, keys: np.ndarray, n: int):
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    own = keys[doc[cut]]
    return own, tk.ragged(place, np.append(cut, len(doc)))


def _map_anchors(unit: str, length: int, k: int, shards: int):
    def run(batches):
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            n = len(batch)
            if not n:
                continue
            ids = batch.column("doc_id")
            keys = np.zeros(n, KEY)
            keys["doc_id"], keys["th"] = ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
            live = ids.is_valid().to_numpy(zero_copy_only=False)
            parts = []
            for i, j in tk.slices(offs):
                h, d, p = _anchors_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], unit, length, k)
                parts.append((h, d + i, p))
            h, d, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            ok = live[d]
            h, d, p = h[ok], d[ok], p[ok]
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(h)))
            many = np.maximum.reduceat(d, head) != np.minimum.reduceat(d, head) if len(h) else np.zeros(0, bool)
            own = np.repeat(many, size)
            settled = _by_doc(d[own], p[own], keys, n)
            rep = np.zeros(int(many.sum()), ENTRY)
            rep_h = h[head[many]]
            rep["p"] = SEEN_TWICE
            ask = np.zeros(int((~own).sum()), ENTRY)
            ask["d"], ask["p"] = d[~own], p[~own]
            allh = np.concatenate([rep_h, h[~own]])
            entry = np.concatenate([rep, ask])
            entry["h"] = (allh >> np.uint64(32)).astype(np.uint32)
            shard = ((allh & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard, entry = shard[order], entry[order]
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
            data, tables = [], []
            for a, b in zip(cut, np.append(cut, len(shard))[1:], strict=True):
                e = entry[a:b]
                used, e["d"] = np.unique(e["d"], return_inverse=True)
                data.append(tk.packed(e))
                tables.append(tk.packed(keys[used]))
            m, q = len(cut), len(settled[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([shard[cut], np.arange(q) % shards]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(m, np.int64), settled[0]["doc_id"]])),
                    pa.array(np.concatenate([np.zeros(m, np.int64), settled[0]["th"]])),
                    pa.array(data + settled[1], pa.binary()),
                    pa.array(tables + [None] * q, pa.binary()),
                ],
                names=["shard", "doc_id", "th", "data", "keys"],
            )

    return run


def _reduce_anchors(table: pa.Table) -> pa.Table:
    """Of one shard: what is settled passes; entries whose hash another document has, come out by document."""
    keys_col = table.column("keys")
    passed = table.filter(keys_col.is_null()).select(["doc_id", "th", "data"]).rename_columns(["doc_id", "th", "places"])
    asked = table.filter(keys_col.is_valid())
    entries, keys, base = [], [], 0
    for data, tab in zip(asked.column("data").to_pylist(), asked.column("keys").to_pylist(), strict=True):
        e, own = tk.unpacked(data, ENTRY), tk.unpacked(tab, KEY)
        e["d"] += base
        base += len(own)
        entries.append(e)
        keys.append(own)
    out = []
    if entries:
        e, key = np.concatenate(entries), np.concatenate(keys)
        e = e[np.argsort(e["h"], kind="stable")]
        head = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
        size = np.diff(np.append(head, len(e)))
        d = e["d"].astype(np.int64)
        shared = (np.maximum.reduceat(d, head) != np.minimum.reduceat(d, head)) | (np.maximum.reduceat(e["p"], head) == SEEN_TWICE)
        e = e[np.repeat(shared, size) & (e["p"] != SEEN_TWICE)]
        own, places = _by_doc(e["d"].astype(np.int64), e["p"], key, len(key))
        out.append(pa.table([pa.array(own["doc_id"].copy()), pa.array(own["th"].copy()), pa.array(places, pa.binary())], names=["doc_id", "th", "places"]))
    return pa.concat_tables([passed.cast(pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("places", pa.binary())])), *out])


def shared_anchors(texts: DataFrame, unit: str, length: int, k: int, shards: int) -> DataFrame:
    """doc_id, th, places (4-byte token places): every anchor that some other row may share."""
    blocks = texts.mapInArrow(_map_anchors(unit, length, k, shards), ANCHORS)
    return blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(_reduce_anchors, PLACES)


def by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("key"), "th").agg(F.collect_list("places").alias("places"))


def joined(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Each text with its places; the exchange of the texts by key serves every such join of a query."""
    return texts.join(by_document(places), ["key", "th"], how)


def places_column(batch: pa.RecordBatch, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x), dtype) if x else np.zeros(0, dtype) for x in batch.column("places").to_pylist()]


def spans_column(spans: Column) -> Column:
    return F.size(spans).cast("long")
