"""Quality rules with a host-level verdict.

Each document gets plain figures (words, symbols, repeated lines and 5-word windows) and
two rules of its own; failures are then counted by host, and each host's failure rate is
shrunk towards all hosts with a beta prior fitted to the hosts by moments.  A document is
rejected if it fails a rule that its host fails habitually (shrunk rate >= ``habit``), or
if its host fails the base rules in most of its documents (>= ``condemn``).

Hosts are pre-aggregated before the shuffle; the verdict table has one row a host and is
joined back on narrow rows, so that a host with a third of all documents stays spread.

Defined cases: a null text has no words and so fails; a null host is a host of its own;
an empty table gives an empty result; rows repeat as they do in the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, mix, span_hashes, steps, string_buffer, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Least words, and most words in repeated windows per 100.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Most symbols per 100 words, and most repeated lines per 100 words.
MOST_SYMBOLS, MOST_DUP_LINES = 30, 5
HABIT, CONDEMN = 0.02, 0.8
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(x, dtype=np.int64)]
    return run[offsets[1:]] - run[offsets[:-1]]


def _figures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five figures of each text of a step."""
    n = len(offsets) - 1
    starts, stops = word_spans(data, offsets[1:])
    at = np.searchsorted(offsets, starts, side="right") - 1  # the text of each word
    words = np.bincount(at, minlength=n)
    length = np.r_[0, np.cumsum(data & 0xC0 != 0x80)]
    chars = np.bincount(at, weights=length[stops] - length[starts], minlength=n).astype(np.int64)

    repeated = np.zeros(n, np.int64)
    if len(at) >= 5:
        h = span_hashes(data, starts, stops, fold_case=False)
        win = h[:-4].copy()
        for k in range(1, 5):
            win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
        inside = np.flatnonzero(at[4:] == at[:-4])
        key = mix(win[inside] ^ mix(at[inside].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = inside[count[inverse] > 1]
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
        repeated = np.bincount(at[np.cumsum(cover)[:-1] > 0], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_from = np.unique(np.r_[offsets[:-1], breaks + 1])
    line_from = line_from[line_from < len(data)]
    line_to = np.r_[line_from[1:], len(data)]
    line_to = line_to - ((line_to > 0) & (data[np.maximum(line_to, 1) - 1] == 10)) if len(data) else line_to
    ink = np.zeros(len(data) + 1, np.int64)
    ink[starts + 1] = 1
    ink = np.cumsum(ink)
    full = ink[line_to] > ink[line_from] if len(line_from) else np.zeros(0, bool)
    line_from, line_to = line_from[full], line_to[full]
    of = np.searchsorted(offsets, line_from, side="right") - 1
    key = mix(span_hashes(data, line_from, line_to, fold_case=False) ^ mix(of.astype(np.uint64)))
    first = np.unique(key, return_index=True)[1]
    dup = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)
    return [words, chars, _sums(_SYMBOL[data], offsets), dup, repeated]


def figures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the five figures of each text, as long."""

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffer(batch.column(2))
            for i, j in steps(offsets):
                part = offsets[i : j + 1]
                out = _figures(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *(pa.array(x.astype(np.int64)) for x in out)], names=["doc_id", "host", *FIGURES])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{x} long" for x in FIGURES))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _rules() -> dict[str, Column]:
    """A document's own rules, judged by its host's habit."""
    return {
        "symbols": F.col("n_symbols") * 100 > F.col("n_words") * MOST_SYMBOLS,
        "lines": F.col("n_dup_lines") * 100 > F.col("n_words") * MOST_DUP_LINES,
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """One row a host: its documents, and each rule's shrunk failure rate as rate_<rule>.

    With hosts' rates of mean m and variance v, the prior's strength is m(1-m)/v - 1,
    held between 1 and 1000 documents (1000 where hosts don't differ at all).
    """
    rules = {"base": _base_failed()} | _rules()
    by_host = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x.cast("long")).alias(f"f_{k}") for k, x in rules.items()))
    prior = by_host.agg(*(f(F.col(f"f_{k}") / F.col("n")).alias(f"{what}_{k}") for k in rules for what, f in (("m", F.avg), ("v", F.var_pop))))
    out = by_host.crossJoin(F.broadcast(prior))  # one row: the prior
    for k in rules:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        strength = F.when(v > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(1000.0)
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + m * strength) / (F.col("n") + strength))
    return out.select("host", "n", *(f"rate_{k}" for k in rules))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", habit: float = HABIT, condemn: float = CONDEMN) -> DataFrame:
    """doc_id, the figures, base_failed, kept, and the rules that spoke against the document."""
    measured = cut(figures(docs, id_col, text_col, host_col))
    rules = _rules()
    rates = host_rates(measured).select(
        F.col("host").alias("host_"), (F.col("rate_base") >= condemn).alias("condemned"), *((F.col(f"rate_{k}") >= habit).alias(f"habit_{k}") for k in rules)
    )
    rows = measured.join(rates, F.col("host").eqNullSafe(F.col("host_")), "left")
    against = F.array_compact(F.array(F.when(F.col("condemned"), F.lit("host")), *(F.when(x & F.col(f"habit_{k}"), F.lit(k)) for k, x in rules.items())))
    rows = rows.select("doc_id", *FIGURES, _base_failed().alias("base_failed"), against.alias("against"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("against") == 0)).select("doc_id", *FIGURES, "base_failed", "kept", "against")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns; an id is rejected as a whole if one of its rows is."""
    bad = judged(docs, id_col, text_col, host_col).where(~F.col("kept")).select(F.col("doc_id").alias("rejected_")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["rejected_"]), "left_anti")
