"""Scores of retrieval and generation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragweave.functions.text import collapse


def without_none(x: Column | str) -> Column:
    """The word None goes, white space collapses."""
    return collapse(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\bNone\b", ""))


def ranking_scores(retrieved: DataFrame, golds: DataFrame, depth: int = 10) -> DataFrame:
    """hits_4, hits_10, map_10, mrr_10 of each query that has golds.

    ``retrieved``: query_id, rank, text; ``golds``: query_id, gold. A gold counts at the first rank whose
    text holds it; precision at a rank is the golds first found there by the rank, and the sum of these is
    divided by all golds given (repeats included), at most ``depth``.
    """
    pairs = retrieved.filter(F.col("rank") <= depth).join(golds.select("query_id", "gold").distinct(), "query_id")
    found = pairs.filter(F.contains(without_none("text"), F.col("gold"))).groupBy("query_id", "gold").agg(F.min("rank").alias("rank"))
    per = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.col("rank")).alias("gain"))
    sizes = golds.groupBy("query_id").agg(F.count("gold").alias("n"))
    both = sizes.join(per, "query_id", "left")
    return both.select(
        "query_id",
        F.coalesce((F.col("first") <= 4).cast("int"), F.lit(0)).alias("hits_4"),
        F.coalesce((F.col("first") <= 10).cast("int"), F.lit(0)).alias("hits_10"),
        F.coalesce(F.col("gain") / F.least(F.col("n"), F.lit(depth)), F.lit(0.0)).alias("map_10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_10"),
    )


def gains(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each score after minus before."""
    old = before.agg(*[F.avg(n).alias(n) for n in names])
    new = after.agg(*[F.avg(n).alias(f"{n}_after") for n in names])
    return old.join(new).select(*[(F.col(f"{n}_after") - F.col(n)).alias(f"{n}_gain") for n in names])


# The rules of the 13a tokeniser, in order.
RULES_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokens_13a(x: Column | str) -> Column:
    """Tokens for BLEU: entities, then punctuation and digits set apart."""
    t = F.col(x) if isinstance(x, str) else x
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    for pattern, put in RULES_13A:
        t = F.regexp_replace(t, pattern.replace("` -", "`!-"), put)  # setting spaces apart, too, would only make more of them
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def ngram_sums(pairs: DataFrame, lengths: Sequence[int], hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """(key, n, matched, total, asked): clipped n-gram matches, the hypothesis' and the reference's n-grams, for token arrays.

    A pair's n-grams meet in its own row, by numbers: a batch's words are numbered, and an n-gram is the number of the
    n-gram before it with its next word. So nothing is exploded or shuffled, and no hash stands for a word. A pair has a
    row for each length even where it has no such n-gram; null tokens are left out.
    """
    lengths = list(lengths)
    schema = T.StructType([pairs.schema[key], T.StructField("n", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("matched", "total", "asked")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = sum(batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
            for a, b in _cuts(held, TOKENS):
                part = batch.slice(a, b - a)
                for n, *sums in _pair_sums(part.column(1), part.column(2), lengths):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(b - a, n, np.int32)), *map(pa.array, sums)], schema.names)

    return pairs.select(key, F.array_compact(hypothesis), F.array_compact(reference)).mapInArrow(run, schema)


#: Tokens whose n-grams are counted at once, but for a pair that has more.
TOKENS = 1 << 20


def _cuts(held: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold ``most`` together, or are one row."""
    ends, a = np.cumsum(held), 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def _pair_sums(ours: pa.Array, theirs: pa.Array, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, matched, total, asked) of each row of two columns of token lists."""
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ours, theirs)]
    flat = pa.concat_arrays([ours.flatten(), theirs.flatten()]).dictionary_encode()
    word, rows, first = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(ours), int(sizes[0].sum())
    each = np.concatenate(sizes)
    row = np.repeat(np.tile(np.arange(rows), 2), each)
    left = np.repeat(np.cumsum(each), each) - np.arange(len(word))  # tokens from here to the list's end
    gram = row.copy()
    for n in range(1, max(lengths, default=0) + 1):
        at = np.flatnonzero(left >= n)
        found = pa.array(gram[at] * len(flat.dictionary) + word[at + n - 1]).dictionary_encode()
        gram[at] = found.indices.to_numpy(zero_copy_only=False)
        distinct = len(found.dictionary)
        if n in lengths:
            split = int(np.searchsorted(at, first))
            c, r = (np.bincount(gram[x], minlength=distinct) for x in (at[:split], at[split:]))
            of = np.zeros(distinct, np.int64)
            of[gram[at]] = row[at]
            matched = np.bincount(of, np.minimum(c, r), rows).astype(np.int64)
            yield n, matched, *(np.bincount(row[x], minlength=rows) for x in (at[:split], at[split:]))


def ngram_matches(pairs: DataFrame, n: int, hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """(key, n, matched, total): clipped n-gram matches and the hypothesis' n-grams, for token arrays."""
    return ngram_sums(pairs, [n], hypothesis, reference, key).drop("asked")


def bleu(pairs: DataFrame, most: int = 4, hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """One row: bleu, brevity_penalty, hypothesis and reference lengths of the corpus, and the precisions of each length."""
    per = ngram_sums(pairs, range(1, most + 1), hypothesis, reference, key).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matched", "total", "asked")])
    whole = per.groupBy().agg(F.sort_array(F.collect_list(F.struct("n", "matched", "total", "asked"))).alias("per"))  # a row for each length
    share = F.transform("per", lambda x: F.when(x["total"] > 0, x["matched"] / x["total"]).otherwise(0.0))
    sizes = whole.select(share.alias("precisions"), F.get("per", F.lit(0))["total"].alias("hypothesis_length"), F.get("per", F.lit(0))["asked"].alias("reference_length"))
    sizes = sizes.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("hypothesis_length", "reference_length")})
    penalty = F.when(F.col("hypothesis_length") > F.col("reference_length"), 1.0).when(F.col("hypothesis_length") > 0, F.exp(1 - F.col("reference_length") / F.col("hypothesis_length"))).otherwise(0.0)
    logs = F.aggregate("precisions", F.lit(0.0), lambda acc, p: acc + F.when(p > 0, F.ln(p)).otherwise(F.lit(float("-inf"))))
    return sizes.withColumn("brevity_penalty", penalty).select((F.col("brevity_penalty") * F.when(F.size("precisions") > 0, F.exp(logs / most)).otherwise(0.0)).alias("bleu"), "brevity_penalty", "hypothesis_length", "reference_length", "precisions")


def f_measure(matched: Column, hypothesis: Column, reference: Column) -> Column:
    return F.when(matched > 0, 2 * matched / (hypothesis + reference)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int = 1, hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """(key, rouge): F-measure of shared n-grams of token arrays."""
    sums = ngram_sums(pairs, [n], hypothesis, reference, key)
    return sums.select(key, f_measure(F.col("matched"), F.col("total"), F.col("asked")).alias("rouge"))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """(key, rouge_l): F-measure of the longest common subsequence of token arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, r in zip(f["h"], f["r"]):
                common = _common(list(h), list(r))
                out.append(2 * common / (len(h) + len(r)) if common else 0.0)
            yield pd.DataFrame({key: f[key], "rouge_l": out})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, F.col(hypothesis).alias("h"), F.col(reference).alias("r")).mapInPandas(run, f"`{key}` {kind}, rouge_l double")


def _union_common(r: list[str], hypotheses: list[list[str]]) -> set[int]:
    """Places of ``r`` that a longest common subsequence with any of the sentences covers."""
    covered: set[int] = set()
    for h in hypotheses:
        table = np.zeros((len(r) + 1, len(h) + 1), np.int32)
        for i, x in enumerate(r):
            same = np.array([x == y for y in h], bool)
            for j in range(len(h)):
                table[i + 1, j + 1] = table[i, j] + 1 if same[j] else max(table[i, j + 1], table[i + 1, j])
        i, j = len(r), len(h)
        while i and j:
            if r[i - 1] == h[j - 1]:
                covered.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
    return covered


def rouge_lsum(pairs: DataFrame, hypothesis: str = "hypothesis", reference: str = "reference", key: str = "pair_id") -> DataFrame:
    """(key, rouge_lsum): F-measure of the union of longest common subsequences, line by line, of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, r in zip(f["h"], f["r"]):
                ours, theirs = ([line.lower().split() for line in (x or "").split("\n") if line.split()] for x in (h, r))
                left, matched = Counter(t for line in ours for t in line), 0
                for line in theirs:
                    for i in sorted(_union_common(line, ours)):
                        if left[line[i]] > 0:
                            left[line[i]] -= 1
                            matched += 1
                sizes = sum(map(len, ours)) + sum(map(len, theirs))
                out.append(2 * matched / sizes if matched else 0.0)
            yield pd.DataFrame({key: f[key], "rouge_lsum": out})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, F.col(hypothesis).alias("h"), F.col(reference).alias("r")).mapInPandas(run, f"`{key}` {kind}, rouge_lsum double")


def bootstrap(scores: DataFrame, names: list[str], key: str, rounds: int = 100, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(metric, low, mid, high) of means over resamples, by the Poisson bootstrap.

    A row's weight in a round is drawn from its key and the round, so a rerun or another partitioning draws
    the same; sums are pre-aggregated, and only ``rounds`` rows a metric are left to take quantiles of.
    """
    draw = (F.pmod(F.xxhash64(F.col(key), F.col("round"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < draw))
    rows = scores.select(key, *names).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight).filter("w > 0")
    sums = rows.groupBy("round").agg(*[F.try_divide(F.sum(F.col(n) * F.col("w")), F.sum(F.when(F.col(n).isNotNull(), F.col("w")))).alias(n) for n in names])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("mean")) for n in names])).alias("m")).select("m.*")
    ends = [(1 - level) / 2, 0.5, (1 + level) / 2]
    return long.groupBy("metric").agg(*[F.percentile("mean", q).alias(n) for q, n in zip(ends, ("low", "mid", "high"))])


Metric = Callable[[DataFrame], DataFrame]
METRICS: dict[str, Metric] = {
    "rouge1": lambda pairs: rouge_n(pairs, 1).withColumnRenamed("rouge", "rouge1"),
    "rouge2": lambda pairs: rouge_n(pairs, 2).withColumnRenamed("rouge", "rouge2"),
    "rougeL": lambda pairs: rouge_l(pairs).withColumnRenamed("rouge_l", "rougeL"),
}
#: Metrics of n-grams, which share one reading, unless another metric is registered under the name.
NGRAMS = {name: (n, METRICS[name]) for name, n in (("rouge1", 1), ("rouge2", 2))}


def register_metric(name: str, metric: Metric) -> None:
    """Add a metric by name: pairs of token arrays in, (pair_id, name) out."""
    METRICS[name] = metric


def scored(pairs: DataFrame, names: Sequence[str], key: str = "pair_id") -> DataFrame:
    """(key, a column of each named metric); an unknown one is an error."""
    if lost := set(names) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(lost)}")
    shared = [n for n in dict.fromkeys(names) if n in NGRAMS and METRICS[n] is NGRAMS[n][1]]
    if shared:
        sums = ngram_sums(pairs, [NGRAMS[n][0] for n in shared], key=key)
        score = f_measure(F.col("matched"), F.col("total"), F.col("asked"))
        out = sums.groupBy(key).agg(*[F.max(F.when(F.col("n") == NGRAMS[n][0], score)).alias(n) for n in shared])
    else:
        out = pairs.select(key)
    for name in [n for n in names if n not in shared]:
        out = out.join(METRICS[name](pairs).select(key, name), key, "left")
    return out.select(key, *names)


def answerable(queries: DataFrame, excluded: Sequence[str] = (), kind: str = "question_type") -> DataFrame:
    """Queries without those that have no answer (type null_query) and without the excluded types."""
    return queries.filter(~F.coalesce(F.lower(F.trim(kind)).isin("null_query", *[e.strip().lower() for e in excluded]), F.lit(False)))


def averages(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.agg(*[F.round(F.avg(n), 4).alias(n) for n in names], F.count("*").alias("num"))


def judged(rows: DataFrame, judge: Callable[[list[str]], Sequence[str]], prompt: Column, names: Sequence[str], batch: int = 16) -> DataFrame:
    """``rows`` with a number for each name, read from the judge's answer to ``prompt``.

    The judge is a model behind a callable: prompts in, answers out. An answer is JSON with a member for each
    name; what isn't a number between 0 and 1 is null.
    """
    from ragweave.operators.models import generated

    said = generated(rows.withColumn("__prompt", prompt), "__prompt", judge, "__said", batch)
    number = lambda n: F.get_json_object("__said", f"$.{n}").try_cast("double")
    return said.withColumns({n: F.when(number(n).between(0, 1), number(n)) for n in names}).drop("__prompt", "__said")
