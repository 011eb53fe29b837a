"""Near-duplicate classes by Order MinHash and banded alignment.

1. Equal texts are one: an aggregate of hashes gives each distinct text a number, its least id. The ids of one text stay
   packed in parts, so that a text which a third of all rows share is dealt over all tasks.
2. Each document has the runs of ``SHINGLE`` words, labelled by how often the run came before. For each of ``SKETCHES``
   hash functions the ``KEPT`` labelled runs of least hash are taken and kept in text order; their digest is a bucket.
   Documents share a bucket where the same runs come in the same order, so the sketch follows edits, not word sets alone.
   Documents of at most ``FEW`` runs, for which sketches fail too often, and those long enough to be near one, have
   buckets of their rarest labelled runs over all such documents: two texts of the wanted similarity share one of the
   first ``n - similarity * n + 1``. This is exact: no pair of which one text has at most ``FEW`` runs is missed.
3. In each bucket every document is aligned with the one that has most company (the sum of its buckets' sizes), which
   settles large groups of copies. Buckets that still span several known classes are settled by one task each where they
   hold at most ``group`` documents and ``group_runs`` runs. Documents of larger ones meet where they share one of their
   rarest labelled runs, early enough in either for the similarity, so no pair is lost; of each two classes a few pairs
   are aligned first, the others unless these have joined them. So every two documents of a bucket are in one class, were
   aligned, or have too few runs in common. The group size moves work, never results.
4. An alignment keeps the order of runs and looks within the band that the similarity allows: matched runs over all runs
   of either text (an ordered Jaccard similarity) must reach ``SIMILARITY``. It compares runs by 32 bits of their hashes.
   Links are joined to classes once at the end.

A hot bucket is never gathered: its leader comes from a partial aggregate, and its pairs, one a document, are
rows of a join whose skewed partitions Spark splits. No candidate is dropped, and no bucket's pairs are all emitted.
Sketches of longer texts are drawn by chance: a pair just at the similarity shares none of them about once in 1000 times.

Defined results: words are runs of bytes other than white space, ASCII letters lower-cased; texts of fewer words than a
run are one run; null text is empty; empty texts are one class; rows with one id and several texts are a row for each
text; repeated rows are one; rows with a null id are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cellwright.llm import textkit as tk
from cellwright.llm.decontaminate import LOWER
from cellwright.llm.passages import SPACE

SHINGLE, SKETCHES, KEPT, SIMILARITY = 5, 24, 6, 0.8
#: Texts of at most so many runs have exact candidates.
FEW = 64
#: Documents and runs of a bucket that one task may settle, and pairs of two classes that are aligned first where it holds more.
GROUP, GROUP_RUNS, LEADS = 1024, 8 << 20, 16
#: Sizes of documents of one band differ by no more than this factor.
BAND = 1 + 1 / 32
#: Bytes of text whose runs are held at once.
SLICE_BYTES = 1 << 19
#: Links a partition, and ids a task joins at once, while links become classes.
LINKS, NODES = 1 << 19, 1 << 20
_RNG = np.random.default_rng(77)
SEEDS = _RNG.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64)
ODDS = _RNG.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each document's runs of k words as 64-bit hashes, in text order."""
    starts, ends, first = tk.words(LOWER[buf], offs, ~SPACE)
    tok = tk.word_hashes(LOWER[buf], starts, ends)
    runs = tk.window_hashes(tok, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(runs[a : b - k + 1] if b - a >= k else tk.window_hashes(tok[a:b], b - a) if b > a else runs[:0])
    return out


def labelled_runs(runs: np.ndarray) -> np.ndarray:
    """Runs told apart by how often each one came before."""
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    same = np.concatenate([[False], runs[order[1:]] == runs[order[:-1]]])
    if not same.any():
        return runs
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    nth = np.empty(n, np.uint64)
    nth[order] = np.arange(n) - head
    return tk.mix(runs.astype(np.uint64) + nth * np.uint64(0x9E3779B97F4A7C15))


def order_sketch(runs: np.ndarray) -> np.ndarray:
    """The buckets of one document."""
    n = len(runs)
    if not n:
        return np.zeros(0, np.uint64)
    labelled = labelled_runs(runs)
    h = (labelled[None] ^ SEEDS) * ODDS
    h ^= h >> np.uint64(31)
    m = min(KEPT, n)
    least = np.argpartition(h, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (SKETCHES, 1))
    least.sort(axis=1)
    key = (runs[least] * tk.powers(m)[None]).sum(1, dtype=np.uint64)
    return tk.mix(key + np.arange(SKETCHES, dtype=np.uint64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(bounds), flat)


def _map_sketches(similarity: float):
    """Buckets of texts of more than FEW runs; labelled runs of texts that may be near one of at most FEW; columns but text stay."""
    most, none = int(FEW / similarity + 1e-9), np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            buf, offs = tk.text_column(batch, "text")
            keys, labels = [], []
            for i, j in tk.slices(offs, SLICE_BYTES):
                for r in shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    keys.append(order_sketch(r) if len(r) > FEW else none)
                    labels.append(labelled_runs(r) if len(r) <= most else none)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(keys), _lists(labels)], names=[*kept, "keys", "labels"])
            tk.release()

    return run


def _map_runs(batches):
    """Runs as 32-bit numbers: what alignment needs of a text."""
    for batch in batches:
        buf, offs = tk.text_column(batch, "text")
        out = []
        for i, j in tk.slices(offs, SLICE_BYTES):
            out += [(r >> np.uint64(32)).astype("<u4").tobytes() for r in shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
        size = pa.array([len(x) // 4 for x in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(out, pa.binary())], names=["doc_id", "size", "runs"])
        tk.release()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the longest common subsequence of runs within the band reaches the similarity."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    need = int(np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))
    if min(n, m) < need:
        return False
    size = min(n, m)
    differ = np.flatnonzero(a[:size] != b[:size])
    head = int(differ[0]) if len(differ) else size
    a, b = a[head:], b[head:]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - size :][::-1] != b[len(b) - size :][::-1])
    tail = int(differ[0]) if len(differ) else size
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    band = n + m - 2 * (need + head + tail)
    x, y = np.unique(a), np.unique(b)
    if np.isin(a, y).sum() < need or np.isin(b, x).sum() < need:
        return False
    return _common_in_band(a.tolist(), b.tolist(), band) >= need


def _common_in_band(a: list[int], b: list[int], band: int) -> int:
    """The longest common subsequence whose matches lie within ``band`` of the diagonal.

    Only the ``2 * band + 1`` columns of the band are kept as bits; they move one column a row. Columns that leave are
    counted, as no later row can change them.
    """
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    bits = {x: sum(1 << j for j in at) if len(at) <= 64 else int.from_bytes(np.packbits(np.bincount(at).astype(bool), bitorder="little").tobytes(), "little") for x, at in where.items() if len(at) > 4}
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    v, lo, gone, m = full, -band, 0, len(b)
    for x in a:
        at = where.get(x)
        if at:
            if len(at) > 4:
                match = (bits[x] >> lo if lo >= 0 else bits[x] << -lo) & full
            else:
                match = 0
                for j in at:
                    if 0 <= j - lo < width:
                        match |= 1 << (j - lo)
            if match:
                u = v & match
                v = ((v + u) | (v - u)) & full
        if not v & 1:
            gone += 1
        v = v >> 1 | top
        lo += 1
        if lo > m:
            break
    return gone + width - v.bit_count()


def _map_aligned(similarity: float):
    def run(batches):
        for batch in batches:
            ra, rb = batch.column("runs_a").to_pylist(), batch.column("runs_b").to_pylist()
            ok = np.array([aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(ra, rb, strict=True)], bool)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _forest(batches):
    """Of the links of a partition, NODES ids at a time, only a spanning forest goes on: each id and its least one."""
    top: dict[int, int] = {}

    def root(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    def pairs():
        out = [(x, root(x)) for x in top]
        out = [p for p in out if p[0] != p[1]]
        top.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            top.setdefault(u, u)
            top.setdefault(v, v)
            x, y = root(u), root(v)
            top[max(x, y)] = min(x, y)
        if len(top) > NODES:
            yield pairs()
    if top:
        yield pairs()


def _links_stored(links: DataFrame) -> tuple[DataFrame, int, tuple]:
    """A table of links, how many partitions of LINKS rows it needs (a single one needs no exchange), and what tells tables apart."""
    table = tk.stored(links.mapInArrow(_forest, "u long, v long").distinct(), "links")
    state = tuple(table.agg(F.count("*"), F.sum("v"), F.sum(F.col("u").cast("decimal(38,0)") * 31)).first())
    return table, -(-state[0] // LINKS) or 1, state


def classes_of(links: DataFrame) -> DataFrame:
    """id, cls: the least id of each connected component, by alternating large and small stars until nothing changes."""
    table, parts, state = _links_stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u")
        last, was = table, state
        table, parts, state = _links_stored(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts))
        tk.discard(last)
        if was == state:
            return table.coalesce(parts).groupBy("u").agg(F.min("v").alias("cls")).withColumnRenamed("u", "id")


def _overlaps(runs: list[np.ndarray]) -> np.ndarray:
    """How many labelled runs every two of a bounded group of documents have in common, in any order."""
    m = len(runs)
    label = np.concatenate([labelled_runs(r.astype(np.uint64)) for r in runs])
    doc = np.repeat(np.arange(m), [len(r) for r in runs])
    _, col, often = np.unique(label, return_inverse=True, return_counts=True)
    common = often > 1
    keep = common[col]
    col, doc = (np.cumsum(common) - 1)[col[keep]], doc[keep]
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    out, width = np.zeros((m, m), np.float32), 4096
    for first in range(0, int(common.sum()), width):
        i, j = np.searchsorted(col, [first, first + width])
        has = np.zeros((m, width), np.float32)
        has[doc[i:j], col[i:j] - first] = 1
        out += has @ has.T
    return out


def _settle_group(similarity: float):
    """Links of one bounded group: every two of its documents are in one class or were aligned."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        ids, start = (table.column(x).to_numpy()[order] for x in ("doc_id", "cls"))
        runs = [np.frombuffer(x, "<u4") for x in table.column("runs").to_pylist()]
        runs = [runs[i] for i in order.tolist()]
        cls = np.unique(start, return_inverse=True)[1]
        size = np.array([len(x) for x in runs])
        need = np.ceil(similarity / (1 + similarity) * (size[:, None] + size[None]) - 1e-9)
        near = (_overlaps(runs) >= need) & (cls[:, None] != cls[None])
        links = []
        for i, j in np.argwhere(np.triu(near, 1)).tolist():
            if cls[i] != cls[j] and aligned(runs[i], runs[j], similarity):
                links.append((ids[i], ids[j]))
                cls[cls == cls[j]] = cls[i]
        a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def _map_labels(batches):
    """Labelled runs of each document, as they are told apart; other columns stay."""
    for batch in batches:
        offs = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("runs")).to_numpy(), dtype=np.int64)])
        kept = [c for c in batch.schema.names if c != "runs"]
        for i, j in tk.slices(offs, SLICE_BYTES):
            part = batch.slice(i, j - i)
            values = [labelled_runs(np.frombuffer(x, "<u4").astype(np.uint64)) for x in part.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _lists(values)], names=[*kept, "labels"])
        tk.release()


def _rarest(rows: DataFrame, similarity: float, *also: Column) -> DataFrame:
    """Of each document's ``n`` labels, those first in the order of rarity, of which near texts share one; ``also``: more about a label."""
    common = rows.groupBy("label").agg(F.count("*").alias("often"), *also)
    rare = Window.partitionBy("doc_id").orderBy("often", "label")
    ranked = rows.join(common, "label").withColumn("nth", F.row_number().over(rare))
    return ranked.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)


def _need(n: Column, m: Column, similarity: float) -> Column:
    """How many runs near texts of n and m runs have in common."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def _candidates(labels: DataFrame, similarity: float) -> DataFrame:
    """a, b, x, y, shared: every two documents (a has no fewer labels) of two classes (x < y) that may be near.

    ``labels``: doc_id, cls, n, label. All labels are put in one order, rare ones first. Of two near documents the first
    label that both have leaves room in either for all those that they need, so it is among few of a document's labels:
    the fewer, the nearer their sizes. Documents look for that label among those of one band of sizes at a time. Where a
    label's rows are of one class but for a few, only these few meet the others: a label that all copies of a text have
    makes no pairs of copies.
    """
    n, m = F.col("n"), F.col("m")
    own = _rarest(labels, similarity, F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
    own = tk.stored(own.select("label", "doc_id", "cls", "n", "nth"), "prefixes")
    most = own.groupBy("label", "cls").agg(F.count("*").alias("often")).groupBy("label").agg(F.max(F.struct("often", "cls")).alias("most"), F.count("*").alias("classes"))
    own = own.join(most.where("classes > 1"), "label").withColumn("out", F.col("cls") != F.col("most.cls"))
    band, least = (lambda size: F.floor(F.log(size) / float(np.log(BAND)))), F.ceil(n * similarity - 1e-9)
    small = own.where(F.col("nth") <= n - _need(n, n, similarity) + 1).select("label", band(n).alias("band"), F.col("doc_id").alias("b"), F.col("cls").alias("cls_b"), n.alias("m"), F.col("nth").alias("j"), "out")
    large = own.withColumn("band", F.explode(F.sequence(band(least), band(n))))
    large = large.where(F.col("nth") <= n - _need(n, F.greatest(least, F.floor(F.pow(F.lit(BAND), "band"))), similarity) + 1)
    large = large.select("label", "band", F.col("doc_id").alias("a"), F.col("cls").alias("cls_a"), "n", F.col("nth").alias("i"), "out")
    need = _need(n, m, similarity)
    fits = (F.col("cls_a") != F.col("cls_b")) & ((n > m) | (n == m) & (F.col("a") > F.col("b"))) & (F.col("i") <= n - need + 1) & (F.col("j") <= m - need + 1)
    some = large.drop("out").join(small.where("out").drop("out"), ["label", "band"]).where(fits)
    rest = large.where("out").drop("out").join(small.where("NOT out").drop("out"), ["label", "band"]).where(fits)
    x, y = F.least("cls_a", "cls_b").alias("x"), F.greatest("cls_a", "cls_b").alias("y")
    return some.unionByName(rest).groupBy("a", "b", x, y).agg(F.count("*").alias("shared"))


def _open(state: DataFrame, group: int, group_runs: int) -> tuple[DataFrame, DataFrame]:
    """Buckets that still span several classes, with their documents: those one task may settle, and larger ones."""
    sizes = state.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("members"), F.sum("size").alias("runs_in")).where("lo < hi")
    sizes = sizes.select("bucket", ((F.col("members") <= group) & (F.col("runs_in") <= group_runs)).alias("fits"))
    wide = tk.stored(state.join(sizes, "bucket").select("bucket", "doc_id", "cls", "size", "fits"), "open")
    return wide.where("fits").drop("fits"), wide.where("NOT fits").drop("fits")


def _settled(small: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """Links of bounded buckets; buckets with the same documents are one."""
    sets = small.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", "cls"))).alias("docs")).groupBy("docs").agg(F.min("bucket").alias("bucket"))
    rows = sets.select("bucket", F.explode("docs").alias("doc")).select("bucket", "doc.doc_id", "doc.cls").join(runs, "doc_id")
    return tk.stored(rows.select("bucket", "doc_id", "cls", "runs").groupBy("bucket").applyInArrow(_settle_group(similarity), "a long, b long"), "found")


def _pairs_found(pairs: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    left, right = (runs.select(F.col("doc_id").alias(x), F.col("runs").alias(f"runs_{x}")) for x in "ab")
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "runs_a", "runs_b")
    return tk.stored(both.mapInArrow(_map_aligned(similarity), "a long, b long"), "found")


def _followed(links: DataFrame) -> DataFrame:
    """doc_id, cls: classes that are cheap to know, each document's last leader, and that one's own. They may be too fine, never too coarse."""
    lead = links.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("cls"))
    upper = lead.select(F.col("doc_id").alias("cls"), F.col("cls").alias("top"))
    return lead.join(upper, "cls", "left").select("doc_id", F.coalesce("top", "cls").alias("cls"))


def _classed(state: DataFrame, known: DataFrame) -> DataFrame:
    return state.drop("cls").join(known, "doc_id", "left").withColumn("cls", F.coalesce("cls", "doc_id"))


def sketches_of(texts: DataFrame, similarity: float) -> DataFrame:
    """keys and labels of every row of ``texts``, beside its columns but text; no text is shuffled."""
    kept = texts.drop("text")
    return texts.mapInArrow(_map_sketches(similarity), K.StructType([*kept.schema.fields, *(K.StructField(c, K.ArrayType(K.LongType())) for c in ("keys", "labels"))]))


def near_links(texts: DataFrame, similarity: float, group: int = GROUP, group_runs: int = GROUP_RUNS, leads: int = LEADS, sketches: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """id, cls of every document of ``texts`` (doc_id, text; distinct texts, rows may repeat) that has a near duplicate.

    ``sketches``: theirs (doc_id, keys, labels), where they are known. ``nodes``: numbers (node) that stand for documents
    in place of their ids and are what sketches go by, with the columns of ``texts`` that tell them.
    """
    if nodes is None:
        nodes = texts.select("doc_id", F.col("doc_id").alias("node")).distinct()
    by = [c for c in nodes.columns if c != "node"]
    # rows that repeat are one from here on, where they are small
    mapped = tk.stored((sketches_of(texts, similarity) if sketches is None else sketches).dropDuplicates(["doc_id"]), "sketches")
    keys = mapped.select("doc_id", F.explode("keys").alias("bucket"))
    labels = mapped.select("doc_id", F.size("labels").alias("n"), F.explode("labels").alias("label"))
    rare = _rarest(labels, similarity).where("often > 1").select("doc_id", F.xxhash64("label").alias("bucket"))
    rows = keys.unionByName(rare)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = tk.stored(rows.join(shared, "bucket"), "members")
    tk.discard(mapped)
    # a document in many large buckets is central to its copies: it leads them, so one round links nearly all
    weight = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    # the few columns that tell texts meet their numbers first: each text is shuffled once
    wanted = nodes.join(weight.select(F.col("doc_id").alias("node")), "node")
    asked = texts.join(wanted, by).select(F.col("node").alias("doc_id"), "text")
    runs = tk.stored(asked.mapInArrow(_map_runs, "doc_id long, size int, runs binary").dropDuplicates(["doc_id"]), "runs")
    weight = weight.join(runs.select("doc_id", "size"), "doc_id")
    state = tk.stored(members.select("bucket", "doc_id").join(weight, "doc_id"), "round")
    tk.discard(members)
    lead = state.groupBy("bucket").agg(F.max(F.struct("weight", -F.col("doc_id"))).alias("lead")).select("bucket", (-F.col("lead")["col2"]).alias("a"))
    found = _pairs_found(state.join(lead, "bucket").where("a <> doc_id").select("a", F.col("doc_id").alias("b")), runs, similarity)
    state = state.select("bucket", "doc_id", "size", F.col("doc_id").alias("cls"))
    small, large = _open(_classed(state, _followed(found)), group, group_runs)
    links = [found, _settled(small, runs, similarity)]
    if not large.isEmpty():
        links += _settled_large(large, runs, similarity, reduce(DataFrame.unionByName, links), leads)
    return classes_of(reduce(DataFrame.unionByName, links))


def _settled_large(large: DataFrame, runs: DataFrame, similarity: float, links: DataFrame, leads: int) -> list[DataFrame]:
    """Links of buckets that no task may hold: of each two classes ``leads`` pairs are aligned, and all others unless that makes them one.

    A document counts once, however many such buckets it is in, and a pair only if it shares one.
    """
    known = tk.stored(classes_of(links).withColumnRenamed("id", "doc_id"), "classes")
    docs = tk.stored(_classed(large, known).groupBy("doc_id", "cls").agg(F.collect_set("bucket").alias("buckets")), "wide")
    labels = docs.select("doc_id", "cls").join(runs.select("doc_id", "runs"), "doc_id").mapInArrow(_map_labels, "doc_id long, cls long, labels array<long>")
    labels = tk.stored(labels.select("doc_id", "cls", F.size("labels").alias("n"), F.explode("labels").alias("label")), "labels")
    pairs = _candidates(labels, similarity)
    for c in "ab":
        pairs = pairs.join(docs.select(F.col("doc_id").alias(c), F.col("buckets").alias(f"buckets_{c}")), c)
    pairs = tk.stored(pairs.where(F.arrays_overlap("buckets_a", "buckets_b")).select("a", "b", "x", "y", "shared"), "pairs")
    tk.discard(labels)
    some = F.pmod(F.xxhash64("a", "b"), F.lit(leads)).alias("some")
    first = pairs.groupBy("x", "y", some).agg(F.max(F.struct("shared", "a", "b")).alias("top")).select("top.a", "top.b")
    first = tk.stored(first, "leads")
    found = _pairs_found(first, runs, similarity)
    between = found.join(pairs, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = tk.stored(classes_of(between), "classes")
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for c in "xy":
        rest = rest.join(merged.select(F.col("id").alias(c), F.col("cls").alias(f"new_{c}")), c, "left").withColumn(c, F.coalesce(f"new_{c}", c))
    return [found, _pairs_found(rest.where("x <> y").select("a", "b"), runs, similarity)]


def text_hash(text: Column) -> Column:
    """128 bits of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, leads: int = LEADS) -> DataFrame:
    """A row per id and text: doc_id, h (``text_hash``), same_text (the least id with this very text), class_id (the least
    id of the class), stays (whether this row is the one that stands for its class)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    # the ids of one text come in as many parts as there are partitions: a text that a third of all rows share is no hot key
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = texts.groupBy("h", salt.alias("salt")).agg(F.min("doc_id").alias("lead"), F.sort_array(F.collect_set("doc_id")).alias("ids"))
    parts = tk.stored(parts, "texts")
    # a number for each distinct text: its least id, but another one for all but the first of the texts that one id leads
    nth = F.row_number().over(Window.partitionBy("lead").orderBy("h"))
    first = parts.groupBy("h").agg(F.min("lead").alias("lead")).withColumn("nth", nth)
    first = tk.stored(first.select("h", "lead", F.when(F.col("nth") == 1, F.col("lead")).otherwise(-F.shiftrightunsigned(F.xxhash64("lead", "h"), 1) - 1).alias("node")), "nodes")
    nodes = first.select("h", F.col("lead").alias("doc_id"), "node")
    # every row is sketched where it is read, copies too: their sketches are a fraction of the texts that would be shuffled
    sketches = sketches_of(texts, similarity).join(nodes, ["doc_id", "h"]).select(F.col("node").alias("doc_id"), "keys", "labels")
    found = tk.stored(near_links(texts, similarity, group, leads=leads, sketches=sketches, nodes=nodes), "classes")
    classed = first.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    best = classed.groupBy("cls").agg(F.min(F.struct("lead", "h")).alias("best"))
    classed = classed.join(best, "cls").select("h", F.col("lead").alias("same_text"), F.col("best.lead").alias("class_id"), (F.col("best.h") == F.col("h")).alias("first"))
    rows = parts.select("h", "ids").join(classed, "h").select(F.explode("ids").alias("doc_id"), "h", "same_text", "class_id", "first")
    return rows.select("doc_id", "h", "same_text", "class_id", (F.col("first") & (F.col("doc_id") == F.col("same_text"))).alias("stays"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id once: of rows with one id and several texts, the class of its least text."""
    found = near_classes(tk.table_of(spark, sf_dir, "documents"))
    return found.groupBy("doc_id").agg(F.min(F.struct("h", "same_text", "class_id")).alias("own")).select("doc_id", "own.same_text", "own.class_id")
