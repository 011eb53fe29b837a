"""Tables that a tool extracted, scored against corrected ones: rows matched by label in order, figures by place or order.

Reading a grid is Columns over its rows, without a shuffle; rows of a table then meet those of its extraction in one small
function, which looks at a window of rows ahead for each row and so does work in proportion to the table, whatever its length.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

# Fixed patterns: a printed figure, a reference to a note alone or behind a label, a year.
FIGURE = r"^\(?-?\d[\d,]*(?:\.\d+)?\)?%?\*?$|^\(?-?\.\d+\)?%?$"
NOTE_REF = r"^\(?\d{1,2}(?:\.\d{1,2}){0,2}(?:\s?\(?[a-z]{1,3}\)?)?\)?$"
TRAILING_REF = r"(?:\s+\(?\d{1,2}(?:\.\d{1,2}){0,2}(?:\s?\(?[a-z]{1,3}\)?)?\)?)+$"
YEAR = r"^(?:FY)?(?:19|20)\d{2}(?:/\d{2})?\*?$"
# The signs of nils, and white space; words that head references; the least likeness of two labels; how far ahead a row may be found.
NILS, WHITE = "-–—−", "\t\n\x0b\f\r"
REF_WORDS = ("note", "notes", "note no", "page", "page no", "page no.")
LABEL_MATCH, WINDOW = 0.75, 12


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, where lambdas would do so for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cleaned(grid: Column) -> Column:
    """Cells with single spaces; rows and columns that are empty everywhere are gone, short rows filled up."""
    rows = F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    rows = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))

    def kept(rows: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
        return F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: F.exists(rows, lambda r: F.coalesce(F.get(r, j), F.lit("")) != ""))

    return _once(rows, lambda rows: _once(kept(rows), lambda keep: F.transform(rows, lambda r: F.transform(keep, lambda j: F.coalesce(F.get(r, j), F.lit(""))))))


def printed_figure(token: Column) -> Column:
    """A printed figure in one form: (1,234) reads -1234, any nil reads -; null for other words."""

    def read(t: Column) -> Column:
        sign = F.when(F.left(t, F.lit(1)).isin("(", "-"), "-").otherwise("")
        digits = F.translate(F.ltrim(F.trim(t, F.lit("()%")), F.lit("-")), ",", "")
        return F.when((t != "") & (F.trim(t, F.lit(NILS)) == ""), "-").when(t.rlike(FIGURE) & ~t.isin("000", "'000"), F.concat(sign, digits))

    return _once(F.rtrim(F.trim(token), F.lit("*")), read)


def body_rows(grid: Column) -> Column:
    """The rows of a grid (an array of arrays of strings) in order: label, figures, header.

    A header has no figures but years: a heading, or the upper lines of a wrapped label. Columns left of the first one with a
    figure in thousands hold labels and references.
    """
    words = lambda c: F.filter(F.split(F.translate(c, WHITE, " " * len(WHITE)), " "), lambda w: w != "")
    thousands = lambda line: F.transform(line, lambda c, j: F.when(F.contains(c, F.lit(",")) & F.exists(words(c), lambda w: F.contains(w, F.lit(",")) & (F.coalesce(printed_figure(w), F.lit("")) != "")), j))
    is_label = lambda c: (c != "") & ~c.rlike(NOTE_REF) & ~F.trim(F.lower(c), F.lit(".: ")).isin(*REF_WORDS)

    def read(line: Column, first: Column) -> Column:
        tokens = F.flatten(F.transform(F.slice(line, first + 1, F.greatest(F.size(line) - first, F.lit(0))), words))
        tokens = F.transform(tokens, lambda w: F.struct(w.alias("word"), printed_figure(w).alias("figure")))
        return _once(tokens, lambda t: named(F.filter(F.slice(line, 1, first), is_label), t))

    def named(labels: Column, tokens: Column) -> Column:
        lead = F.array_position(F.transform(tokens, lambda t: t["figure"].isNotNull()), True)
        ahead = F.transform(F.slice(tokens, 1, F.when(lead > 0, lead - 1).otherwise(F.size(tokens)).cast("int")), lambda t: t["word"])
        label = F.trim(F.regexp_replace(F.array_join(F.concat(labels, ahead), " "), TRAILING_REF, ""))
        figures = F.filter(F.transform(tokens, lambda t: t["figure"]), lambda f: f.isNotNull())
        return _once(F.struct(label.alias("label"), figures.alias("figures")), lambda r: F.struct(r["label"].alias("label"), r["figures"].alias("figures"), F.forall(F.filter(r["figures"], lambda f: f != "-"), lambda f: f.rlike(YEAR)).alias("header")))

    first = F.coalesce(F.array_min(F.flatten(F.transform(grid, lambda line: F.coalesce(thousands(line), F.array().cast("array<int>"))))), F.lit(1))
    return _once(first, lambda first: F.transform(grid, lambda line: read(line, first)))


@lru_cache(1 << 16)
def _plain(label: str) -> str:
    return re.sub(r"[^a-z0-9]", "", label.lower())


@lru_cache(1 << 16)
def _ratio(gold: str, text: str) -> float:
    """The likeness of two plain labels that differ; 0 where it can't reach the least one."""
    if 2 * min(len(gold), len(text)) < LABEL_MATCH * (len(gold) + len(text)):
        return 0.0
    matcher = SequenceMatcher(None, gold, text)
    return matcher.ratio() if matcher.quick_ratio() >= LABEL_MATCH else 0.0


def _same_figures(gold: list[str], got: list[str]) -> int:
    """Figures, nils apart, that agree: by column where rows have as many, else in order."""
    if len(gold) == len(got):
        return sum(a == b != "-" for a, b in zip(gold, got, strict=True))
    blocks = SequenceMatcher(None, gold, got, autojunk=False).get_matching_blocks()
    return sum(f != "-" for a, _, n in blocks for f in gold[a : a + n])


def _named(rows: list, longest: int) -> list[tuple[list[str], list[str], int]]:
    """Of each row that is no header: its plain label alone and with the headers just above it, its figures and how many there are.

    Labels too long to be like one of ``longest`` signs are left out.
    """
    out, above = [], []
    for label, figures, header in rows:
        if header:
            above.append(_plain(label))
            continue
        if header is None:
            continue
        texts = [_plain(label)]
        for line in reversed(above):
            if line:
                texts.append(line + texts[-1])
                if LABEL_MATCH * (longest + len(texts[-1])) > 2 * longest:
                    break
        out.append((texts, figures, len(figures) - figures.count("-")))
        above = []
    return out


def _row_matches(gold: list, got: list) -> list[int]:
    """Each corrected row with figures takes the likeliest row of the next ``WINDOW``; rows before the last one taken are gone.

    Rows are (label, figures, header); among rows equally like, the one with most figures right is taken, then the first.
    """
    wanted = [(label, _plain(label), figures, len(figures) - figures.count("-")) for label, figures, header in gold if header is False]
    rows = _named(got, max((len(w[1]) for w in wanted), default=0))
    total = found = lines = complete = wrong = used = start = 0
    for label, plain, figures, n in wanted:
        if not n:
            continue
        total += n
        lines += 1
        ahead = range(start, min(start + WINDOW, len(rows)))
        best, tried = 1.0, [k for k in ahead if plain in (rows[k][0] if plain else rows[k][0][:1])]
        if not tried and plain:
            like = [max(_ratio(plain, t) for t in rows[k][0]) for k in ahead]
            best = max(like, default=0.0)
            tried = [k for k in ahead if like[k - start] == best >= LABEL_MATCH]
        elif not tried and not label:
            best, tried = 0.0, list(ahead)
        hits = [_same_figures(figures, rows[k][1]) for k in tried]
        most = max(hits, default=0)
        if tried and (most or best):
            k = tried[hits.index(most)]
            start = k + 1
            used += rows[k][2]
            found += most
            complete += most == n
            wrong += rows[k][2] - most
    return [total, found, lines, complete, wrong, sum(r[2] for r in rows) - used]


COUNTS = ("figures", "found", "rows", "rows_complete", "wrong", "unmatched_rows_figures")


def _tables(rows: pa.ListArray) -> list[list]:
    """Each table's rows as (label, figures, header); none for a null."""
    offsets = rows.offsets.to_pylist()
    flat = rows.values
    figures = flat.field("figures")
    at, each = figures.offsets.to_pylist(), figures.values.to_pylist()
    all_rows = list(zip([x or "" for x in flat.field("label").to_pylist()], [each[i:j] for i, j in pairwise(at)], flat.field("header").to_pylist(), strict=True))
    return [all_rows[i:j] if ok else [] for (i, j), ok in zip(pairwise(offsets), rows.is_valid().to_pylist(), strict=True)]


@F.arrow_udf(K.ArrayType(K.StructType([K.StructField(c, K.LongType()) for c in COUNTS])))
def row_matches(gold: pa.Array, got: pa.Array) -> pa.Array:
    """One set of counts of each corrected table with figures, none of others."""
    counts = [_row_matches(a, b) for a, b in zip(_tables(gold), _tables(got), strict=True)]
    bounds = list(accumulate((int(c[0] > 0) for c in counts), initial=0))
    kept = [c for c in counts if c[0]]
    each = pa.StructArray.from_arrays([pa.array([c[i] for c in kept], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)


def extraction_scores(gold: DataFrame, extracted: DataFrame, keys: list[str], tool: list[str]) -> DataFrame:
    """How much of each corrected table with figures (keys, grid) each extraction (keys, tool, grid; one of each tool) gets right.

    Tables that a tool gave no rows for score nothing found; extractions of unknown tables are left out.
    """
    wanted = gold.select(*keys, body_rows(F.col("grid")).alias("rows"))
    got = extracted.select(*keys, *tool, _once(cleaned(F.col("grid")), body_rows).alias("got"))
    out = got.join(wanted, keys).select(*keys, *tool, F.inline(row_matches("rows", "got")))
    return out.withColumn("table_complete", F.col("found") == F.col("figures"))


def extraction_summary(scores: DataFrame, tool: list[str]) -> DataFrame:
    """Totals and shares of each tool, and its place: most figures found, then most tables complete, then by name."""
    out = scores.groupBy(*tool).agg(F.count("*").alias("tables"), *[F.sum(c).alias(c) for c in ("figures", "found", "wrong", "rows", "rows_complete")], F.count_if("table_complete").alias("tables_complete"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    out = out.withColumns({"found_share": share("found", "figures"), "rows_complete_share": share("rows_complete", "rows")})
    order = [F.desc("found_share"), F.desc("tables_complete"), *tool]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # a row a tool
