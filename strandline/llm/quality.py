"""Quality rules by robust multivariate outlyingness.

Statistics of every whole text are counted over Arrow buffers, a few MB at a time. Their transformed vectors are then
compared with what is usual for their language and source: a minimum-covariance-determinant estimate a cell. Three
starts a cell (median and MAD, spatial signs, plain moments) are concentrated, each step an aggregation over all rows,
until no determinant falls any more; of the three the one of least determinant stands. Nothing is sampled. A cell is
(lang, source), or the language where a source has too few rows of it, or everything where the language has too few.
Vectors whose squared Mahalanobis distance, scaled to be chi-square at its median, exceeds CUT are rejected.

Cell names and models have one row a cell. They are broadcast behind a count of cells; above BROADCAST_CELLS the joins
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import IS_WORD, ROW, cut, mix, place_table, row_key, slices, span_hashes, unused, word_spans

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_CELL, SUBSET = 60, 0.75
#: Concentration ends when no log-determinant falls by more than this, or after so many steps.
SETTLED, MOST_STEPS = 1e-3, 8
BROADCAST_CELLS = 20_000
#: The vector's features with the least standard deviation each is credited with; constant features would else decide alone.
FEATURES = {"word_length": 0.5, "symbols": 0.10, "dup_lines": 0.10, "repeats": 0.12, "capitals": 0.06, "marks": 0.10}
#: Chi-square of 6 degrees of freedom: its median, and the bound on the squared distance. The credited deviations already
#: widen the ellipsoid, so the scale is never below 1.
CHI2_MEDIAN, CUT = 5.348, 80.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?=~^@_{}[]\\/")] = 1
_TABLE = place_table(2)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks")


def _totals(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def _repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that their owner has twice or more."""
    both = mix(keys ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(both)
    ranked = both[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _duplicates(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many keys equal an earlier one of its own."""
    both = mix(keys ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    _, first = np.unique(both, return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def count_texts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of a slice of texts, one array a name of _COUNTS."""
    n = len(offs) - 1
    start, end, first = word_spans(data, offs)
    n_words = np.diff(first)
    inside = IS_WORD[data]
    out = {
        "n_words": n_words,
        "word_chars": _totals(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _totals(_SYMBOL[data], offs),
        "n_capitals": _totals(_CAPITAL[data], offs),
        "n_letters": _totals(_LETTER[data], offs),
        "n_marks": _totals(_MARK[data], offs),
    }
    # Lines: a text of k newlines has k + 1, bounded by its own ends.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    line_end = np.sort(np.concatenate([breaks, offs[1:]]), kind="stable")
    line_owner = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offs)) + 1)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    (hashes,) = span_hashes(data, line_start, line_end, _TABLE)
    out["n_lines"] = np.bincount(line_owner[has_word], minlength=n)
    out["n_dup_lines"] = _duplicates(line_owner[has_word], hashes[has_word], n)
    # Windows of words within one text.
    (words,) = span_hashes(data, start, end, _TABLE)
    owner = np.repeat(np.arange(n), n_words)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
        window = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            window = mix(window + words[at + k])
        twice = at[_repeated(owner[at], window)]
        covered[twice] += 1
        covered -= np.bincount(twice + WINDOW, minlength=len(words) + 1)
    out["n_repeat_words"] = np.bincount(owner, weights=np.cumsum(covered)[:-1] > 0, minlength=n).astype(np.int64)
    return out


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, row, lang, source, counts...) a row of docs, over whole texts; null texts count as without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches):
            counts = count_texts(data, offs)
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], *[pa.array(counts[c].astype(np.int64)) for c in _COUNTS]], names=["doc_id", "row", "lang", "source", *_COUNTS])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text", "lang", "source").alias("row"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id long, row {ROW}, lang string, source string, {', '.join(c + ' long' for c in _COUNTS)}")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vector() -> dict[str, Column]:
    """Transformed statistics, rounded so that exact medians need few distinct values."""
    raw = {
        "word_length": F.log1p(_share("word_chars", "n_words")) * 4,
        "symbols": F.log1p(_share("n_symbols", "n_words") * 10),
        "dup_lines": F.sqrt(_share("n_dup_lines", "n_lines")),
        "repeats": F.sqrt(_share("n_repeat_words", "n_words")),
        "capitals": F.sqrt(_share("n_capitals", "n_letters")),
        "marks": F.log1p(_share("n_marks", "n_words") * 2),
    }
    return {k: F.round(v, 3) for k, v in raw.items()}


def _with_cells(stats: DataFrame) -> DataFrame:
    """stats with `cell`: the finest grouping that has MIN_CELL rows."""
    pairs = cut(stats.groupBy("lang", "source").agg(F.count("*").alias("n")))
    rest = F.when(F.col("n") < MIN_CELL, F.col("n")).otherwise(0)
    langs = pairs.groupBy("lang").agg(F.sum(rest).alias("left"))
    named = pairs.join(langs, "lang").select("lang", "source", F.when(F.col("n") >= MIN_CELL, F.concat_ws("\u0001", F.lit("p"), "lang", "source")).when(F.col("left") >= MIN_CELL, F.concat_ws("\u0001", F.lit("l"), "lang")).otherwise(F.lit("*")).alias("cell"))
    return stats.join(F.broadcast(named) if pairs.count() <= BROADCAST_CELLS else named, ["lang", "source"])


def _distance(mean: str = "mean", precision: str = "precision") -> Column:
    p = len(FEATURES)
    away = [F.col(f) - F.col(mean)[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i + 1):
            total = total + away[i] * away[j] * F.col(precision)[i * p + j] * (1 if i == j else 2)
    return total


def _inverted(estimates: DataFrame) -> DataFrame:
    """(cell, start, mean, precision, logdet); cov gains the least variances on its diagonal first."""
    floor, size = np.diag(np.square(list(FEATURES.values()))), len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covs = [np.array(c, float).reshape(size, size) + floor for c in b.column(3).to_pylist()]
            precision = pa.array([np.linalg.inv(c).ravel().tolist() for c in covs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], precision, pa.array([float(np.linalg.slogdet(c)[1]) for c in covs], pa.float64())], names=["cell", "start", "mean", "precision", "logdet"])

    return estimates.select("cell", "start", "mean", "cov").mapInArrow(run, "cell string, start int, mean array<double>, precision array<double>, logdet double")


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    names = list(FEATURES)
    cov = [F.covar_pop(a, b) for a in names for b in names]
    return rows.groupBy(*keys).agg(F.array(*[F.avg(f) for f in names]).alias("mean"), F.transform(F.array(*cov), lambda x: F.coalesce(x, F.lit(0.0))).alias("cov"))


def _joined(rows: DataFrame, model: DataFrame, few: bool, *keys: str) -> DataFrame:
    return rows.join(F.broadcast(model) if few else model, list(keys))


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    """(cell, start, mean, cov) of the three starts of every cell."""
    names = list(FEATURES)
    size = len(names)
    centre = cut(vectors.groupBy("cell").agg(F.array(*[F.percentile(f, F.lit(0.5)) for f in names]).alias("mean")))
    spread = cut(_joined(vectors, centre, few, "cell").groupBy("cell").agg(F.first("mean").alias("mean"), F.array(*[F.percentile(F.round(F.abs(F.col(f) - F.col("mean")[i]), 3), F.lit(0.5)) * 1.4826 for i, f in enumerate(names)]).alias("mad")))
    zero = F.lit(0.0)
    diagonal = F.array(*[F.col("mad")[i] * F.col("mad")[i] if i == j else zero for i in range(size) for j in range(size)])
    # Spatial signs: every vector counts by its direction alone, in units of the features' own spread.
    unit = [F.sqrt(F.col("mad")[i] * F.col("mad")[i] + floor * floor) for i, floor in enumerate(FEATURES.values())]
    away = _joined(vectors, spread, few, "cell").select("cell", "mean", F.array(*unit).alias("unit"), *[((F.col(f) - F.col("mean")[i]) / unit[i]).alias(f) for i, f in enumerate(names)])
    norm = F.greatest(F.sqrt(sum((F.col(f) * F.col(f) for f in names), zero)), F.lit(1e-9))
    signs = away.select("cell", "mean", "unit", *[(F.col(f) / norm).alias(f) for f in names])
    directions = signs.groupBy("cell").agg(F.first("mean").alias("mean"), F.first("unit").alias("unit"), F.array(*[F.avg(F.col(a) * F.col(b)) for a in names for b in names]).alias("s"))
    signed = F.array(*[F.col("s")[i * size + j] * F.col("unit")[i] * F.col("unit")[j] * size for i in range(size) for j in range(size)])
    starts = [spread.select("cell", F.lit(0).alias("start"), "mean", diagonal.alias("cov")), directions.select("cell", F.lit(1).alias("start"), "mean", signed.alias("cov")), _moments(vectors, "cell").select("cell", F.lit(2).alias("start"), "mean", "cov")]
    return starts[0].unionByName(starts[1]).unionByName(starts[2])


def fit(vectors: DataFrame) -> DataFrame:
    """(cell, mean, precision, scale): the MCD estimate of each cell of `vectors` (cell and the features)."""
    names = list(FEATURES)
    few = 3 * vectors.select("cell").distinct().count() <= BROADCAST_CELLS
    model = cut(_inverted(_starts(vectors, few)))
    # A distance is ranked by its logarithm in steps of a hundredth: the exact quantile then needs few distinct values.
    ranked = lambda: F.round(F.log1p(_distance()), 2)
    for step in range(MOST_STEPS):
        far = _joined(vectors, model, few, "cell").select("cell", "start", *names, ranked().alias("far"))
        bound = far.groupBy("cell", "start").agg(F.percentile("far", F.lit(SUBSET)).alias("bound"))
        inner = _joined(far, bound, few, "cell", "start").filter("far <= bound + 0.005")
        after = cut(_inverted(_moments(inner, "cell", "start")))
        fallen = after.join(model.select("cell", "start", F.col("logdet").alias("before")), ["cell", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        model = after
        if step and (fallen is None or fallen <= SETTLED):  # the starts' own determinants are of no subset
            break
    best = cut(model.groupBy("cell").agg(F.min(F.struct("logdet", "start", "mean", "precision")).alias("m")).select("cell", "m.mean", "m.precision"))
    middle = _joined(vectors, best, few, "cell").groupBy("cell").agg(F.percentile(ranked(), F.lit(0.5)).alias("m"))
    scaled = middle.select("cell", F.greatest(F.expr("expm1(m)") / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    return cut(best.join(scaled, "cell"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def verdicts(docs: DataFrame) -> DataFrame:
    """Statistics of every row of docs with base_failed, distance (scaled, squared) and kept.

    The estimates are fitted to the rows that pass the base rules; a row whose cell has none of those is kept or not by
    the base rules alone. Null or empty texts have no words and fail; null lang and source count as ''; repeated rows
    count as often as they occur and each get a row; an empty table gives no rows.
    """
    vector = _vector()
    stats = cut(_with_cells(cut(text_statistics(docs))).withColumns(vector).withColumn("base_failed", base_failed()))
    model = fit(stats.filter(~F.col("base_failed")).select("cell", *FEATURES))
    few = model.count() <= BROADCAST_CELLS
    judged = stats.join(F.broadcast(model) if few else model, "cell", "left").withColumn("distance", _distance() / F.col("scale"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with its columns."""
    own = unused(docs, "__row")
    good = verdicts(docs).filter("kept").select(F.col("row").alias(own)).distinct()
    return docs.withColumn(own, row_key("doc_id", "text", "lang", "source")).join(good, own, "left_semi").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
