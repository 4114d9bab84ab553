"""Quality rules, and outliers by the minimum covariance determinant.

Each document has a vector of transformed statistics.  For every group (language and source)
the estimator looks for the half of the documents whose covariance has the least
determinant, by concentration steps: keep the half nearest by Mahalanobis distance, take
their mean and covariance, repeat until the determinant falls no more.  This is done from
three starts, all at coordinate-wise medians (scatter by medians alone, with correlations of
tanh of the scores, with correlations of spatial signs), and the one that ends with the least
determinant is taken.  Its estimate is brought to the scale of normal data, and mean and covariance are taken
once more from all documents within the ``REWEIGHT`` quantile of chi-square.  Documents beyond the
``LEVEL`` quantile by that estimate are rejected.
(P. Rousseeuw, K. Van Driessen, A Fast Algorithm for the MCD Estimator, 1999; the
deterministic starts follow M. Hubert et al., 2012.)

What makes the estimate fit texts:

* Copies of a text count once in the estimate, so a text that fills half of a group does not become its measure.
* Most texts of a group hold no symbol at all.  Their number gets a uniform number from the text's hash on top (a
  randomised residual), so that its scatter is at least the resolution of a count.
* Rates of short texts scatter more.  Each vector is drawn to the group's medians by sqrt(n / (n + ``SHRINK``)), n being its words.

Distinct texts of all documents take part.  Medians and cutoffs are read from counts over fine bins and moments are
sums (those of a concentration step by bin of distance, so that one pass over the documents serves both), so every step is one
aggregation with small partial results and no group is gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.frames import cut
from cardloom.llm.workers import in_batches
from cardloom.llm.words import IS_FIRST, Words, coded, flat, numbered, per_doc, slices

#: Base rules: least words; most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group that the estimator keeps (with half the number of statistics and one on top);
#: concentration steps at most, where a start takes up to ten or so.
SHARE, STEPS = 0.5, 50
#: A start has converged when the logarithm of the determinant falls by less.
FALL = 1e-3
#: Groups with fewer documents are judged with all documents of their language.
LEAST_GROUP = 50
FEATURES = ("f_length", "f_variety", "f_capitals", "f_marks", "f_symbols")
#: Added to each variance against singular groups: a scatter of 0.005, where statistics of clean texts scatter by 0.01 to 0.04.
RIDGE = 0.005**2
#: Words at which half of a squared deviation is the text's own.
SHRINK = 100
#: Quantiles of chi-square: within which documents are used once more, beyond which they are rejected.  ``SHRINK`` and
#: ``LEVEL`` were chosen on documents with even ids of sf0.1; README has the figures of the others.
REWEIGHT, LEVEL = 0.975, 0.99999
#: Rows for groups are broadcast up to so many groups (under 1 kB each); beyond that groups are
#: joined by a shuffle, each in so many lots, so that a large group has many tasks.
BROADCAST_GROUPS, LOTS = 10_000, 64
#: Width of the bins from which quantiles are read: of statistics, of logarithms of distances.
FINE, BIN = 1 / 2048, 1 / 16
#: Characters of a word, and marks in it, count up to so many (a link or a key is one odd word, not many).
LONG_WORD, MARKED = 20, 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(128, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_marks", "n_short_chars")


def _word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: code points up to ``LONG_WORD``, marks up to ``MARKED``, whether it begins with a capital.

    Marks are ASCII characters other than letters, U+0080 to U+00BF, U+2000 to U+2BFF and U+3000 to U+303F; capitals are
    A-Z and U+00C0 to U+00DE.
    """
    data, offsets = flat(words)
    after = np.append(data[1:], np.uint8(0))
    marks = np.zeros(len(data), bool)
    ascii_ = data < 128
    marks[ascii_] = ~_LETTER[data[ascii_]]
    marks |= (data == 0xC2) | ((data == 0xE2) & (after < 0xB0)) | ((data == 0xE3) & (after == 0x80))
    first, second = data[offsets[:-1]], after[offsets[:-1]]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second <= 0x9E))
    return np.minimum(per_doc(IS_FIRST[data], offsets), LONG_WORD), np.minimum(per_doc(marks, offsets), MARKED), capital


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of whole texts; null is empty.

    n_words; word_chars: code points in words; n_symbols: of ``#*$%&|<>``; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in windows of three that are found
    twice or more; n_distinct: distinct words; n_capitals: words that begin with a capital; n_marks: marks in words, up to
    ``MARKED`` each; n_short_chars: code points in words, up to ``LONG_WORD`` each.
    """
    data, offsets = flat(texts)
    n_docs = len(offsets) - 1
    w = Words(data, offsets)
    counts = w.counts()
    short, marks, capital = (np.bincount(w.doc, weights=x[w.code], minlength=n_docs) for x in _word_features(w.distinct))
    own_words = numbered(w.code * n_docs + w.doc)[1] if len(w.code) else np.zeros(0, np.int64)
    out = {
        "n_words": counts,
        "word_chars": per_doc(w.inside & IS_FIRST[data], offsets),
        "n_symbols": per_doc(_SYMBOL[data], offsets),
        "n_distinct": np.bincount(own_words % n_docs, minlength=n_docs) if n_docs else counts,
        "n_capitals": capital,
        "n_marks": marks,
        "n_short_chars": short,
    }
    # lines: their bytes without the line feeds lie in a row
    feed = data == 10
    starts = np.union1d(offsets[:-1], np.flatnonzero(feed) + 1)
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    packed = np.concatenate(([0], np.cumsum(~feed)))
    filled = np.concatenate(([0], np.cumsum(w.inside)))
    ends = np.append(starts[1:], len(data))
    has_word = filled[ends] > filled[starts]
    code, _ = coded(data[~feed], packed[starts])
    code, doc = code[has_word], doc[has_word]
    lines = np.bincount(doc, minlength=n_docs)
    distinct = numbered(code * n_docs + doc)[1] if len(code) else np.zeros(0, np.int64)
    out["n_dup_lines"] = lines - np.bincount(distinct % n_docs, minlength=n_docs) if n_docs else lines
    # windows of three words
    repeated = np.zeros(len(w.code), bool)
    if len(w.code) >= 3:
        at = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        n = len(w.distinct)
        pair, _ = numbered(w.code[at] * n + w.code[at + 1])
        triple, _ = numbered(pair * n + w.code[at + 2])
        own, values = numbered(triple * n_docs + w.doc[at])
        twice = at[np.bincount(own, minlength=len(values))[own] > 1] if len(own) else at
        for k in range(3):
            repeated[twice + k] = True
    total = np.concatenate(([0], np.cumsum(repeated)))
    out["n_repeat_words"] = total[w.first[1:]] - total[w.first[:-1]]
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` has ``text`` and other columns; the text is replaced by its statistics."""
    others = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + [f"{s} long" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, "text")):
            found = text_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(found[s].astype(np.int64)) for s in STATISTICS], [*others, *STATISTICS])

    return in_batches(docs.select("text", *others), run, schema)


def features(dither: Column) -> dict[str, Column]:
    """Transformed statistics: logarithms of lengths, square roots of rates, which even out their scatter.

    ``dither``: a number from 0 to 1 that follows from the text.
    """
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f_length": F.log(F.greatest(F.col("n_short_chars"), F.lit(1)) / words),
        "f_variety": F.log(F.greatest(F.col("n_distinct"), F.lit(2))) / F.log(F.greatest(words, F.lit(2.0))),
        "f_capitals": F.sqrt(F.col("n_capitals") / words),
        "f_marks": F.sqrt(F.col("n_marks") / words),
        "f_symbols": F.sqrt((F.col("n_symbols") + dither) / F.greatest(F.col("word_chars"), F.lit(1))),
    }


def dithered(hashed: Column) -> Column:
    """A number from 0 to 1 (not 1) that follows from a hash."""
    return F.pmod(hashed, F.lit(1 << 20)) / F.lit(float(1 << 20))


def chi_square(p: int, level: float) -> float:
    """Quantile of chi-square with p degrees of freedom (Wilson and Hilferty)."""
    from statistics import NormalDist

    z, c = NormalDist().inv_cdf(level), 2 / (9 * p)
    return p * (1 - c + z * math.sqrt(c)) ** 3


def chi_square_share(x: float, p: int) -> float:
    """How much of chi-square with p degrees of freedom lies below x (series of the incomplete gamma function)."""
    a, z, k = p / 2, x / 2, 0
    term = total = 1 / a
    while term > 1e-15 * total:
        k += 1
        term *= z / (a + k)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def consistency(p: int, share: float) -> float:
    """What a covariance of the ``share`` nearest of normal data is multiplied with to be that of all."""
    return share / chi_square_share(chi_square(p, share), p + 2)


def binned_quantile(df: DataFrame, by: list[str], value: Column, level: float, out: str) -> DataFrame:
    """Per group the upper edge of the bin that holds the quantile: counts of bins, no rows."""
    bins = df.select(*by, F.floor(value / FINE).alias("_bin")).groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*by)
    run = F.sum("_m").over(w.orderBy("_bin"))
    bins = bins.withColumn("_run", run).withColumn("_all", F.sum("_m").over(w))
    return bins.where(F.col("_run") >= F.lit(level) * F.col("_all")).groupBy(*by).agg(((F.min("_bin") + 1) * F.lit(FINE)).alias(out))


def per_group(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join what is known of each group to its rows without bringing a group's rows together."""
    if few:
        return rows.join(F.broadcast(groups), on, how)
    # which lot a row is in does not matter, as each has all groups; equal rows lie in different ones
    dealt = rows.withColumn("_lot", F.monotonically_increasing_id() % LOTS)
    copies = groups.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long"))))
    return dealt.join(copies, [*on, "_lot"], how).drop("_lot")


_PARAMETERS = "grp string, start int, mean array<double>, inverse array<double>, logdet double"
_SCHEMA = pa.schema([("grp", pa.string()), ("start", pa.int32()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64())])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's features from ``mean`` by ``inverse`` (flat, row by row)."""
    p = len(FEATURES)
    off = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + off[i] * off[j] * F.col("inverse")[i * p + j] * F.lit(1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _square(upper: list[float]) -> np.ndarray:
    """The symmetric matrix with these entries on and above its diagonal."""
    s = np.zeros((len(FEATURES), len(FEATURES)))
    s[np.triu_indices(len(FEATURES))] = upper
    return s + s.T - np.diag(np.diag(s))


def _started(scores: DataFrame) -> DataFrame:
    """Mean and inverse covariance of each start, from medians, spreads and sums of products of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"grp": [], "start": [], "mean": [], "inverse": [], "logdet": []}
            for grp, mean, v, *sums in zip(*(batch.column(c).to_pylist() for c in ("grp", "mean", "v", "tanh", "sign")), strict=True):
                spread = np.sqrt(v)
                for k, upper in enumerate((None, *sums)):
                    r = np.eye(len(v))
                    if upper is not None:
                        s = _square(upper)
                        d = np.sqrt(np.maximum(np.diag(s), 1e-12))
                        r = 0.99 * s / np.outer(d, d)  # never singular
                        np.fill_diagonal(r, 1)
                    inverse = np.linalg.inv(r * np.outer(spread, spread))
                    for name, x in zip(out, (grp, k, mean, np.round(inverse, 6).ravel().tolist(), math.inf), strict=True):
                        out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return scores.mapInArrow(run, _PARAMETERS)


def _inverted(moments: DataFrame, factor: float = 1.0) -> DataFrame:
    """Mean, inverse covariance (of the covariance times ``factor``) and log determinant from sums; one small row for each group and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, inverse, logdet = [], [], []
            for n, first, second in zip(*(batch.column(c).to_pylist() for c in ("n", "first", "second")), strict=True):
                m = np.array(first) / n
                cov = _square(second) / n - np.outer(m, m) + RIDGE * np.eye(len(m))
                # rounding takes away what the order of sums leaves in the last digits
                mean.append(np.round(m, 9).tolist())
                inverse.append(np.round(np.linalg.inv(factor * cov), 6).ravel().tolist())
                logdet.append(round(float(np.linalg.slogdet(cov)[1]), 9))
            yield pa.RecordBatch.from_pydict({"grp": batch.column("grp"), "start": batch.column("start"), "mean": mean, "inverse": inverse, "logdet": logdet}, schema=_SCHEMA)

    return moments.mapInArrow(run, _PARAMETERS)


def _products(x: list[Column]) -> Column:
    """Sums of products of each two, as an array."""
    return F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))])


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, first, second: how many rows, sums of features and of their products, of each group."""
    x = [F.col(f) for f in FEATURES]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("first"), _products(x).alias("second"))


def medians(rows: DataFrame) -> DataFrame:
    """grp, middle: the medians of each group's features."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(FEATURES)])).alias("e")).select("grp", "e.i", "e.x")
    found = binned_quantile(long, ["grp", "i"], F.col("x"), 0.5, "m")
    return found.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a")).select("grp", F.expr("transform(a, x -> x.m)").alias("middle"))


def drawn(rows: DataFrame) -> DataFrame:
    """Features drawn to ``middle`` by the length of the text."""
    part = F.sqrt(F.col("n_words") / (F.col("n_words") + F.lit(float(SHRINK))))
    return rows.withColumns({f: F.col("middle")[i] + (F.col(f) - F.col("middle")[i]) * part for i, f in enumerate(FEATURES)})


def starts(rows: DataFrame, few: bool = False) -> DataFrame:
    """grp, start, mean, inverse, logdet (infinite): where the concentration steps of each group begin.

    ``rows``: grp, the features, and ``middle``, which is where they begin.
    """
    p = len(FEATURES)
    # spreads from the median distance to the medians
    long = rows.select("grp", "middle", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.abs(F.col(f) - F.col("middle")[i]).alias("x")) for i, f in enumerate(FEATURES)])).alias("e"))
    spread = binned_quantile(long.select("grp", "e.i", "e.x"), ["grp", "i"], F.col("x"), 0.5, "d")
    v = F.pow(F.col("d") * 1.4826, F.lit(2)) + F.lit(RIDGE)
    spread = spread.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", v.alias("v")))).alias("a"))
    start = cut(spread.select("grp", F.expr("transform(a, x -> x.v)").alias("v")))
    scores = per_group(rows, start, ["grp"], few).select("grp", "middle", *[((F.col(f) - F.col("middle")[i]) / F.sqrt(F.col("v")[i])).alias(f) for i, f in enumerate(FEATURES)])
    size = F.greatest(F.sqrt(sum((F.col(f) * F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0]) * F.col(FEATURES[0]))), F.lit(1e-9))
    scores = scores.withColumns({f"s{i}": F.col(f) / size for i, f in enumerate(FEATURES)} | {f"t{i}": F.tanh(f) for i, f in enumerate(FEATURES)})
    sums = scores.groupBy("grp").agg(F.first("middle").alias("mean"), _products([F.col(f"t{i}") for i in range(p)]).alias("tanh"), _products([F.col(f"s{i}") for i in range(p)]).alias("sign"))
    return cut(_started(start.join(sums, "grp").select("grp", "mean", "v", "tanh", "sign")))


def _concentrated(far: DataFrame) -> DataFrame:
    """n, first, second of the nearest half of each group and start: sums by bin of distance, then over the bins up to the half's.

    ``far``: grp, start, the features and ``_bin``.  One pass over the rows; then a group and start has a row for each bin.
    """
    p, on = len(FEATURES), ["grp", "start"]
    bins = _sums(far, [*on, "_bin"])
    w = Window.partitionBy(*on)
    bins = bins.withColumn("_before", F.coalesce(F.sum("n").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("n").over(w))
    near = bins.where(F.col("_before") < F.least(F.lit(SHARE) * F.col("_all") + F.lit((p + 1) / 2), F.col("_all")))
    added = [F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(c) for c, k in (("first", p), ("second", p * (p + 1) // 2))]
    return near.groupBy(*on).agg(F.sum("n").alias("n"), *added)


def estimates(rows: DataFrame, few: bool = False) -> DataFrame:
    """grp, middle, mean, inverse, logdet: the reweighted MCD estimate of each group (``logdet`` that of its half).

    ``rows``: grp, n_words and the features, of each text once.
    """
    p, on = len(FEATURES), ["grp", "start"]
    middle = cut(medians(rows))
    rows = cut(drawn(per_group(rows, middle, ["grp"], few)).select("grp", "middle", *FEATURES))
    # The starts of a group go their way together, each until its determinant falls no more.
    chains = starts(rows, few).withColumn("moving", F.lit(True))
    rows = rows.drop("middle")
    for _ in range(STEPS):
        moving = chains.where("moving").drop("moving")
        far = per_group(rows, moving, ["grp"], few).withColumn("_bin", F.floor(F.log(_distance() + 1e-6) / BIN))
        moved = _inverted(_concentrated(far)).select(*on, F.struct("mean", "inverse", "logdet").alias("_new"))
        both = chains.join(moved, on, "left").withColumn("moving", F.coalesce(F.col("_new.logdet") < F.col("logdet") - FALL, F.lit(False)))
        both = both.select(*on, *[F.when(F.col("moving"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ("mean", "inverse", "logdet")], "moving")
        # starts of a group that have met stay together: one goes on
        chains = cut(both.withColumn("_first", F.min("start").over(Window.partitionBy("grp", "logdet", "moving"))).where("start = _first").drop("_first"))
        if not chains.where("moving").head(1):
            break
    best = chains.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("b"))
    best = cut(best.select("grp", "b.start", "b.mean", "b.inverse", "b.logdet"))
    # once more from all that are near on the scale of normal data
    near = per_group(rows, best, ["grp"], few).where(_distance() / consistency(p, SHARE) <= chi_square(p, REWEIGHT))
    last = _inverted(_sums(near, on), consistency(p, REWEIGHT)).select("grp", "mean", "inverse")
    return cut(best.select("grp", "logdet").join(last, "grp").join(middle, "grp"))


def group_of(by: list[str]) -> Column:
    """The name of a row's group."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in by])


def judge(docs: DataFrame, by: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base rules and the robust verdict on every document.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance (squared; null where none is taken), grp (by which it is judged), ``_narrow`` (its own, as :func:`group_of`
    names it), and ``_hash`` of the text.

    ``by``: the first column is the wider group (language), all of them the group.
    Only documents that pass the base rules are used for the estimate.  A group of fewer than
    ``LEAST_GROUP`` documents is judged as part of its wider group; if that is small too, as part
    of all documents.

    Edge cases: a null or empty text has no words and fails; nulls in ``by`` form a group
    of their own; null and repeated keys are kept as they are; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), group_of(by[:1]).alias("_wide"), group_of(by).alias("_narrow"), F.xxhash64(text).alias("_hash"))
    rows = statistics(rows).withColumns(features(dithered(F.coalesce("_hash", F.lit(0)))))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = cut(rows.drop("n_distinct", "n_capitals", "n_marks", "n_short_chars"))
    good = rows.where("not base_failed")
    sizes = cut(good.groupBy("_wide", "_narrow").agg(F.count(F.lit(1)).alias("m")))
    wide = sizes.groupBy("_wide").agg(F.sum("m").alias("wm"))
    level = F.when(F.col("m") >= LEAST_GROUP, F.col("_narrow")).when(F.col("wm") >= LEAST_GROUP, F.concat(F.lit("*"), F.col("_wide"))).otherwise(F.lit("*"))
    groups = cut(sizes.join(wide, "_wide").select("_narrow", level.alias("grp")))
    few = groups.count() <= BROADCAST_GROUPS
    used = ["grp", "_hash", "n_words", *FEATURES]
    own = per_group(good, groups.where("grp not like '*%'"), ["_narrow"], few).select(*used)
    # a wider group that stands in, or all documents, is estimated over all it holds
    stand_in = groups.where("grp like '*_%'").select("grp").distinct().withColumn("_wide", F.expr("substring(grp, 2)"))
    pooled = per_group(good, stand_in, ["_wide"], few).select(*used)
    everything = good.crossJoin(F.broadcast(groups.where("grp = '*'").select("grp").distinct())).select(*used)  # one row or none
    params = estimates(own.unionByName(pooled).unionByName(everything).distinct().drop("_hash"), few)
    told = per_group(rows, groups, ["_narrow"], few, "left")
    told = drawn(per_group(told, params, ["grp"], few, "left")).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    limit = chi_square(len(FEATURES), LEVEL)
    return told.select(
        F.col("_key").alias(key),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"),
        "distance", "grp", "_narrow", "_hash",
    )
