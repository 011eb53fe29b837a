"""Packing of tokenised documents into sequences of a fixed length: first-fit decreasing in randomised groups.

1. Texts become token ids, ``end_id`` after each. Parts of words are encoded once and kept (the last ``KNOWN`` to twice as many
   a worker); this holds for vocabularies like the one named, which drop white space and cut at digits and between letters
   and signs; for others ``apart=False`` encodes whole texts. A document is cut into parts of ``capacity`` ids, the last one shorter, so a row is bounded however long
   its text is.
2. Parts are dealt by a hash of their own number into groups of about ``GROUP`` parts. In a group, parts go, longest
   first, into the first sequence with room for them, which a tournament tree over the free room finds in a logarithm of steps.
3. Sequences that are left with more than ``SLACK`` free places are laid end to end and cut at the capacity; the rest of
   a group becomes sequences of powers of two, which need no padding. So a full group of documents of any lengths is
   padded by at most ``SLACK`` places a sequence, and few parts are cut.

Only a part's number and length are shuffled for placing; ids move once, when parts meet their places.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; ids may be null; an
empty table gives no rows; only the columns named are carried, as a struct, so no name clashes.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

CAPACITY, SLACK, GROUP, KNOWN, SEED = 4096, 16, 8192, 450_000, 11
#: The vocabulary and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Where words are parted: around digits, and between a letter and an ASCII sign.
DIGIT, EDGE = r"([0-9])", r"([A-Za-zÀ-ÖØ-öø-ɏ])([\x21-\x40\x5b-\x60\x7b-\x7e])"
#: Words of letters alone, each one piece for such a vocabulary, and how many are encoded at once.
PLAIN, JOINED = re.compile("[a-zà-öø-ɏ]+"), 128


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which items are placed, and each placed item's bin: the first one with room.

    A tournament tree holds the free room of all bins; its inner nodes hold the largest of their children.
    """
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths[order].tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i] = at - leaves
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return order, bins


def _powers(n: int) -> list[int]:
    """The powers of two that n is made of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def place(lengths: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Rows of (item, start in the item, length, sequence, offset) that cover each item once."""
    order, bins = first_fit_decreasing(lengths, capacity)
    size = lengths[order]
    by_bin = np.argsort(bins, kind="stable")
    order, size, bins = order[by_bin], size[by_bin], bins[by_bin]
    filled = np.bincount(bins, weights=size).astype(np.int64)
    done = (filled >= capacity - slack) | (filled & (filled - 1) == 0)
    keep = done[bins]
    number = np.cumsum(done) - 1
    ends = np.cumsum(size)
    offset = ends - size - (np.cumsum(filled) - filled)[bins]
    whole = np.stack([order[keep], np.zeros(keep.sum(), np.int64), size[keep], number[bins[keep]], offset[keep]], 1)
    # the others, end to end: cut at every item's end and at every sequence's
    item, ends = order[~keep], np.cumsum(size[~keep])
    if not len(item):
        return whole
    total = int(ends[-1])
    rest = [capacity] * (total // capacity) + _powers(total % capacity)
    stops = np.cumsum(rest)
    cuts = np.union1d(ends, stops)
    begin = np.concatenate([[0], cuts[:-1]])
    of, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(stops, begin, "right")
    apart = np.stack([item[of], begin - (ends - size[~keep])[of], cuts - begin, done.sum() + seq, begin - (stops - rest)[seq]], 1)
    return np.concatenate([whole, apart])


def _place_group(capacity: int, slack: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        rows = place(group.column("n").to_numpy(), capacity, slack)
        key, home = group.column("key").to_numpy()[rows[:, 0]], group.column("home")[0].as_py()
        return pa.table({"key": key, "cut": rows[:, 1], "length": rows[:, 2], "sequence_id": (home << 32) + rows[:, 3], "offset": rows[:, 4]})

    return run


class _Encoder:
    """Token ids of texts; parts of words seen lately are not encoded again.

    Words between ASCII white space are parted further where no token of such a vocabulary can reach across: between a
    letter of the Latin alphabets and ASCII that is no letter, and around ASCII digits. Words that hold one of the
    vocabulary's added tokens, in either case, stay whole and as they are.
    """

    def __init__(self, definition: str, apart: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer, self.apart, self.recent, self.older = Tokenizer.from_str(definition), apart, {}, {}
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.added = "|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or "[^\\s\\S]"

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def _fresh_words(self, words: list[str]) -> dict[str, bytes]:
        """Plain words are encoded many at once and told apart by their last tokens; where these are not one a word, singly."""
        out, plain = {}, [w for w in words if PLAIN.fullmatch(w)]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            bounds = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(bounds) == len(group) + 1:
                raw = ids.tobytes()
                out.update(zip(group, [raw[a:b] for a, b in zip(bounds, bounds[1:])], strict=True))
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._fresh(rest), strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.recent) > KNOWN:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        missing = [w for w in words if w not in recent]
        recent.update((w, older[w]) for w in missing if w in older)
        new = [w for w in missing if w not in older]
        recent.update(self._fresh_words(new))
        return [recent[w] for w in words]

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Each text's first word, each word's number, and of each number the parts: their ids, first part and part's number."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        unique = coded.dictionary
        lower = pc.ascii_lower(unique)
        parted = pc.replace_substring_regex(pc.replace_substring_regex(lower, DIGIT, r" \1 "), EDGE, r"\1 \2")
        parted = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(lower, self.added), unique, parted))
        parts = parted.flatten().dictionary_encode()
        first = split.offsets.to_numpy().astype(np.int64)
        inner = parted.offsets.to_numpy().astype(np.int64)
        return first - first[0], coded.indices.to_numpy(), self._known(parts.dictionary.to_pylist()), inner - inner[0], parts.indices.to_numpy()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts."""
        if not self.apart:
            pool = self._fresh(texts.to_pylist())
            return np.frombuffer(b"".join(pool), np.uint32), np.cumsum([0, *[len(x) // 4 for x in pool]])
        first, word, pool, inner, part = self._words(texts)
        # ids of all unique words one after another, then those of the texts
        flat, bounds = _gathered(np.frombuffer(b"".join(pool), np.uint32), np.cumsum([0, *[len(x) // 4 for x in pool]]), part)
        ids, ends = _gathered(flat, bounds[inner], word)
        return ids, ends[first]


def _gathered(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that ``rows`` name, one after another, and their bounds."""
    n = np.diff(bounds)[rows]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(ends[-1]) + np.repeat(bounds[rows] - ends[:-1], n)], ends


def _map_parts(shared, capacity: int, end_id: int, apart: bool):
    """A row for every ``capacity`` ids of a document, the last one shorter."""

    def run(batches):
        encoder = _Encoder(shared.value, apart)
        for batch in batches:
            texts = batch.column("text").fill_null("")
            if not len(texts):
                continue
            _, offs = tk.text_column(batch, "text")
            for i, j in tk.slices(offs):
                ids, ends = encoder.ids(texts.slice(i, j - i))
                docs = np.arange(j - i)
                ids, first = np.insert(ids, ends[1:], end_id).astype("<u4"), ends + np.arange(j - i + 1)
                n = np.diff(first)
                parts = -(-n // capacity)
                of = np.repeat(docs, parts)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
                length = np.minimum(capacity, n[of] - start)
                bounds = np.concatenate([first[of] + start, first[-1:]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(of + i)), pa.array(start), pa.array(length), pa.array(n[of]), pa.array(tk.ragged(ids, bounds), pa.binary())],
                    names=["row", "start", "n", "doc_tokens", "ids"],
                )

    return run


def packed_sequences(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", apart: bool = True, group: int = GROUP, slack: int = SLACK
) -> DataFrame:
    """row (struct of ``columns``), start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row a piece.

    ``tokenizer_path`` names a definition file that the driver reads; its text goes to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = tk.carried(docs, text_col, list(columns))
    parts = rows.mapInArrow(_map_parts(shared, capacity, end_id, apart), tk.carried_schema(rows, "start long, n long, doc_tokens long, ids binary"))
    # a number of its own for every part, fixed by being written
    parts = tk.stored(parts.withColumn("key", F.monotonically_increasing_id()), "parts")
    groups = max(1, -(-parts.count() // group))
    home = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(groups))
    placed = parts.select("key", "n", home.alias("home")).groupBy("home").applyInArrow(_place_group(capacity, slack), "key long, cut long, length long, sequence_id long, offset long")
    piece = F.substring("ids", (4 * F.col("cut") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return parts.join(placed, "key").select("row", (F.col("start") + F.col("cut")).alias("start"), "length", piece.alias("ids"), "doc_tokens", "sequence_id", "offset")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packed_sequences(tk.table_of(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
