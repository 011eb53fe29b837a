"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

1. Labels are learnt from rows outside the held-out fold alone. A bounded sample of them, ``EXAMPLES`` rows a class in
   hash order, is the example set; every other step covers all rows.
2. Terms are words and word beginnings of ``STARTS`` bytes: every term of every example, none picked or cut. Their document
   frequencies are counted over all documents. A term's weight is its inverse document frequency times its relevance,
   ``z * z / (z * z + RELEVANT)``, where z tells how many standard errors apart the two classes of examples use it. By
   plain frequencies rare words that say nothing outweigh those that do (README has both figures).
3. Example vectors lie in an inverted index cut into blocks of examples that share their heaviest term; each block knows
   its largest weight of each term. A document visits blocks by their upper bounds and stops when none left can reach the
   ``NEIGHBOURS`` nearest, so cosines are exact and none is missed; equal vectors share one entry and ties with the last
   neighbour all vote.
4. Votes are weighted by 1 / (distance + ``SOFT``) and by each class's sampling rate, and smoothed by the base rate.

The terms of the examples, their counts and the example vectors reach the driver; they are bounded by the example set.

Defined results: null or empty text has the empty vector, like texts without a known term, and is scored by the examples
without one; no label or a single class gives every document the base rate; an id labelled twice takes the larger label;
a null id is not held out; repeated rows score alike; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

EXAMPLES, RELEVANT = 1500, 64.0
NEIGHBOURS, SOFT, PRIOR, BLOCK, THRESHOLD = 25, 0.05, 1.0, 256, 0.3
STARTS = (6,)
#: Bytes of text whose terms are held at once.
SLICE_BYTES = 1 << 19
#: Letters and digits of lower-cased ASCII, and every other byte above it.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(buf: np.ndarray, offs: np.ndarray):
    """Hash and document of every word and word beginning, with the bytes each one stands on."""
    starts, ends, first = tk.words(buf, offs, WORD)
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    out = [(tk.word_hashes(buf, starts, ends), doc, starts, ends)]
    for n in STARTS:
        long = ends - starts > n
        out.append((tk.mix(tk.word_hashes(buf, starts[long], starts[long] + n) + np.uint64(n)), doc[long], starts[long], starts[long] + n))
    return out


def _count_terms(batches):
    """Of example rows: how many documents of each class hold each term."""
    for batch in batches:
        buf, offs = tk.text_column(batch, "text")
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        hs, ys = [], []
        for i, j in tk.slices(offs, SLICE_BYTES):
            for h, doc, _, _ in terms(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                hs.append(h[new])
                ys.append(toxic[i + doc[new]])
        h, y = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hs, ys))
        h, of = np.unique(h, return_inverse=True)
        n, pos = np.bincount(of, minlength=len(h)), np.bincount(of, y, minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(pos.astype(np.int64))], names=["h", "n", "pos"])


class Lexicon:
    """Sorted hashes of the terms and a table of their low bits that turns most other words away."""

    def __init__(self, hashes: np.ndarray):
        self.h = np.sort(hashes.astype(np.uint64))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.h & np.uint64(0x3FFFFF)).astype(np.int64)] = True

    def counts(self, buf: np.ndarray, offs: np.ndarray):
        """Rows (document, term number, count) of a slice, in order, and the bytes of one place of each."""
        rows = []
        for h, doc, a, b in terms(buf, offs):
            if not len(h) or not len(self.h):
                continue
            maybe = np.flatnonzero(self.seen[(h & np.uint64(0x3FFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.h, h[maybe]), len(self.h) - 1)
            ok = self.h[at] == h[maybe]
            maybe = maybe[ok]
            rows.append((doc[maybe] * len(self.h) + at[ok], a[maybe], b[maybe]))
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros((0, 2), np.int64)
        key, a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        doc, term = np.divmod(key[new], len(self.h))
        return doc, term, np.diff(np.append(new, len(key))), np.stack([a[order[new]], b[order[new]]], 1)


def _map_frequencies(shared):
    """Of each partition: how many of its documents hold each term; the count of all documents stands one beyond the last."""

    def run(batches):
        lexicon = shared.value
        df = np.zeros(len(lexicon.h) + 1, np.int64)
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            df[-1] += len(batch)
            for i, j in tk.slices(offs, SLICE_BYTES):
                df += np.bincount(lexicon.counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1], minlength=len(df))
        term = np.flatnonzero(df)
        tk.release()
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(df[term])], names=["term", "df"])

    return run


def _map_vectors(shared):
    """Of example rows: term numbers and counts, four bytes each."""

    def run(batches):
        lexicon = shared.value
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            ids, counts = [], []
            for i, j in tk.slices(offs, SLICE_BYTES):
                doc, term, count, _ = lexicon.counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                ids += tk.ragged(term.astype("<i4"), cut)
                counts += tk.ragged(count.astype("<i4"), cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "terms", "counts"])

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of some ranges, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class BlockIndex:
    """Example vectors by term and block: a row per term of a block, with its largest weight and its postings."""

    def __init__(self, weight: np.ndarray, examples: list[tuple], class_weight: tuple[float, float]):
        self.weight = weight
        groups: dict[tuple, list] = {}
        empty = [0.0, 0.0, []]
        for doc_id, toxic, terms_, counts in examples:
            w = self.weights(np.frombuffer(terms_, "<i4"), np.frombuffer(counts, "<i4"))
            g = groups.setdefault((terms_, counts), [0.0, 0.0, [], w]) if w is not None else empty
            g[0] += class_weight[1] if toxic else 0.0
            g[1] += class_weight[1 if toxic else 0]
            g[2].append(doc_id)
        all_weight = sum(g[1] for g in groups.values()) + empty[1]
        self.base = (sum(g[0] for g in groups.values()) + empty[0]) / all_weight if all_weight else 0.0
        self.unknown = (empty[0] + PRIOR * self.base) / (empty[1] + PRIOR)
        heaviest = lambda k: (int(np.frombuffer(k[0], "<i4")[np.argmax(groups[k][3])]), min(groups[k][2]))
        keys = sorted(groups, key=heaviest)
        self.pos, self.all = np.array([groups[k][0] for k in keys]), np.array([groups[k][1] for k in keys])
        self.docs = [sorted(groups[k][2])[:3] for k in keys]
        self.blocks = max(1, -(-len(keys) // BLOCK))
        size = [len(k[0]) // 4 for k in keys]
        owner = np.repeat(np.arange(len(keys)), size)
        term = np.concatenate([np.frombuffer(k[0], "<i4") for k in keys]).astype(np.int64) if keys else np.zeros(0, np.int64)
        value = np.concatenate([groups[k][3] for k in keys]) if keys else np.zeros(0)
        flat = term * self.blocks + owner // BLOCK
        order = np.argsort(flat, kind="stable")
        self.owner, self.value, flat = owner[order].astype(np.int32), value[order], flat[order]
        cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.value, cut) if len(cut) else np.zeros(0)
        self.block = (flat[cut] % self.blocks).astype(np.int32)
        self.cut = np.append(cut, len(flat))
        self.of_term = np.searchsorted(flat[cut] // self.blocks, np.arange(len(weight) + 1))

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray | None:
        w = (1 + np.log(count)) * self.weight[term]
        norm = math.sqrt(float((w * w).sum()))
        return w / norm if norm else None

    def _visit(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the postings of some rows add to the cosine with each example."""
        n = self.cut[rows + 1] - self.cut[rows]
        at = _ranges(self.cut[rows], n)
        return np.bincount(self.owner[at], np.repeat(w, n) * self.value[at], len(self.pos))

    def nearest(self, term: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines, nearest first: NEIGHBOURS of them and all ties with the last one.

        The best blocks come first; then all those whose bound still reaches the NEIGHBOURS-th best cosine found.
        """
        n = self.of_term[term + 1] - self.of_term[term]
        rows, each = _ranges(self.of_term[term], n), np.repeat(w, n)
        block = self.block[rows]
        bound = np.bincount(block, each * self.most[rows], self.blocks)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(self.blocks, bool)
        seen[order[: max(1, 2 * NEIGHBOURS // BLOCK + 1)]] = True
        own = seen[block]
        score = self._visit(rows[own], each[own])
        k = min(NEIGHBOURS, len(score))
        least = np.partition(score, -k)[-k]
        rest = ~seen & (bound > 0) & (bound >= least - 1e-9)
        if rest.any():
            own = rest[block]
            score += self._visit(rows[own], each[own])
            least = np.partition(score, -k)[-k]
        entries = np.flatnonzero((score >= least - 1e-9) & (score > 0))
        score = np.round(score[entries], 10)
        order = np.lexsort((entries, -score))
        return entries[order], score[order]

    def score(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int], np.ndarray]:
        """Score, nearest examples, and which of the terms are the heaviest."""
        w = self.weights(term, count) if len(term) and len(self.pos) else None
        if w is None:
            return self.unknown, [], np.zeros(0, np.int64)
        entries, cosine = self.nearest(term, w)
        near = 1 / (1 - np.minimum(cosine, 1.0) + SOFT)
        value = (float((near * self.pos[entries]).sum()) + PRIOR * self.base) / (float((near * self.all[entries]).sum()) + PRIOR)
        return min(max(round(value, 12), 0.0), 1.0), [d for e in entries[:3].tolist() for d in self.docs[e]][:3], np.argsort(-w, kind="stable")[:3]


def _map_scores(lexicon_shared, index_shared):
    def run(batches):
        lexicon, index = lexicon_shared.value, index_shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            scores = []
            for i, j in tk.slices(offs, SLICE_BYTES):
                part = buf[offs[i] : offs[j]]
                doc, term, count, span = lexicon.counts(part, offs[i : j + 1] - offs[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    key = hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                    if key not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[key] = index.score(term[a:b], count[a:b])
                    value, near, top = known[key]
                    why = ", ".join(part[x:y].tobytes().decode("utf-8", "replace") for x, y in span[a + top].tolist())
                    scores.append((value, near, why))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([s[0] for s in scores], pa.float64()),
                    pa.array([s[1] for s in scores], pa.list_(pa.int64())),
                    pa.array([s[2] for s in scores], pa.string()),
                ],
                names=["row", "score", "neighbours", "evidence"],
            )
            tk.release()

    return run


def term_weights(n: np.ndarray, pos: np.ndarray, n_all: int, n_pos: int, df: np.ndarray, docs: int) -> np.ndarray:
    """Inverse document frequency times relevance, from the examples of either class and the documents that hold a term."""
    share = (n + 1) / (n_all + 2)
    z = (pos / n_pos - (n - pos) / (n_all - n_pos)) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / (n_all - n_pos)))
    return (np.log((1 + docs) / (1 + df)) + 1) * z**2 / (z**2 + RELEVANT)


def examples_of(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, tuple[float, float]]:
    """Texts of at most ``per_class`` labelled rows of each class, and how many labelled rows one of them stands for."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    taught = taught.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [taught.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    some = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # copies would make their words look telling: equal texts are one example
    rows = texts.join(some, "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    weight = lambda y: max(1.0, counts.get(y, 0) / per_class)
    return rows, (weight(0), weight(1))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = EXAMPLES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (carried columns, all by default), score, predicted, neighbours (example ids), evidence (heaviest terms)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    examples, class_weight = examples_of(docs, labels, per_class, id_col, text_col)
    examples = tk.stored(examples, "examples")
    n_pos, n_all = examples.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    known = examples.where(F.lit(bool(0 < n_pos < n_all))).select("text", "toxic").mapInArrow(_count_terms, "h long, n long, pos long")
    by_term = known.groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    hashes, n, pos = (by_term.column(c).to_numpy() for c in ("h", "n", "pos"))
    order = np.argsort(hashes.view(np.uint64))
    lexicon = Lexicon(hashes.view(np.uint64))
    lex = sc.broadcast(lexicon)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    counted = docs.select(low.alias("text")).mapInArrow(_map_frequencies(lex), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(lexicon.h) + 1)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = term_weights(n[order], pos[order], n_all, n_pos, df[:-1], df[-1]) if len(order) else np.zeros(0)
    vectors = examples.mapInArrow(_map_vectors(lex), "doc_id long, toxic int, terms binary, counts binary").orderBy("doc_id").toArrow()
    index = sc.broadcast(BlockIndex(weight, list(zip(*(vectors.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "counts")), strict=True)), class_weight))
    rows = tk.carried(docs, text_col, carry).withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    scored = rows.mapInArrow(_map_scores(lex, index), tk.carried_schema(rows, "score double, neighbours array<long>, evidence string"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(tk.table_of(spark, sf_dir, "documents"), tk.table_of(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted", "neighbours", "evidence")
