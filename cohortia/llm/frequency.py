"""Frequency of every distinct code or run of codes, by suffix arrays over blocks of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.functions.text import read_plain

COUNTS = "bloque string, ngrama array<string>, n int, ocurrencias bigint, registros bigint"


def suffix_array(tokens: np.ndarray, record: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by at least their first `depth` tokens, by prefix doubling.

    A suffix ends with its record, and a shorter suffix sorts before the longer ones it begins.
    """
    n = len(tokens)
    rank, reach = tokens.astype(np.int64) + 1, 1
    while reach < depth:
        later = np.zeros(n, dtype=np.int64)
        if n > reach:
            same = record[reach:] == record[:-reach]
            later[:-reach][same] = rank[reach:][same]
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + later, return_inverse=True)
        rank, reach = rank + 1, reach * 2
    return np.argsort(rank.astype(np.uint16) if n and rank.max() < 65_536 else rank, kind="stable")


def ngram_intervals(tokens: np.ndarray, record: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n up to depth: (n, position of one occurrence, occurrences, records) of every distinct n-gram.

    An n-gram is an interval of the suffix array inside which neighbours share at least n tokens; its width is
    the number of occurrences. For the number of records, each suffix is paired with the suffix of the same record
    that precedes it in the array: where the two share n tokens, the record has been counted already, so such
    adjacencies are subtracted from the width.
    """
    n_tok = len(tokens)
    if not n_tok:
        return
    sa = suffix_array(tokens, record, depth)
    position = np.arange(n_tok)
    end = np.searchsorted(record, record, side="right")  # records are contiguous and in order
    room = (end - position)[sa]
    by_record = np.argsort(record[sa], kind="stable")  # places in the array, record by record, in array order
    first, second = by_record[:-1], by_record[1:]
    paired = record[sa[first]] == record[sa[second]]
    first, second = first[paired], second[paired]
    near = np.ones(n_tok, dtype=bool)  # shares n tokens with the suffix before it
    near[0] = False
    twin = np.ones(len(first), dtype=bool)
    for n in range(1, depth + 1):
        fits = room >= n
        at = np.minimum(sa + n - 1, n_tok - 1)
        token = np.where(fits, tokens[at], -1)
        near[1:] &= (token[1:] == token[:-1]) & fits[1:] & fits[:-1]
        twin &= fits[first] & fits[second] & (token[first] == token[second])
        if not fits.any():
            return
        opens = fits & ~near
        interval = np.cumsum(opens) - 1
        k = int(opens.sum())
        width = np.bincount(interval[fits], minlength=k)
        repeats = np.bincount(interval[second[twin]], minlength=k)
        yield n, sa[opens], width, width - repeats


def block_counts(columns: list[pa.Array], depth: int, lengths: tuple[int, ...] | None = None) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """(n-grams, n, occurrences, records) per length of one block of records; columns are the repeated columns in order. lengths
    names the n to give, all up to depth by default."""
    rows = len(columns[0])
    coded = pa.chunked_array([pa.concat_arrays([c.cast(pa.string()) for c in columns])]).combine_chunks().dictionary_encode()
    names: dict[str, int] = {}
    ids = np.array([-1 if (v := read_plain(x)) is None else names.setdefault(v, len(names)) for x in coded.dictionary.to_pylist()] + [-1])
    index = coded.indices.fill_null(len(ids) - 1).to_numpy(zero_copy_only=False)
    grid = ids[index].reshape(len(columns), rows).T
    there = grid >= 0
    tokens, record = grid[there], np.nonzero(there)[0]
    words = pa.array(list(names), pa.string())
    for n, at, occ, rec in ngram_intervals(tokens, record, depth):
        if lengths is None or n in lengths:
            spelled = words.take(pa.array(tokens[at[:, None] + np.arange(n)].ravel()))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), spelled), n, occ, rec


def ngram_counts(
    df: DataFrame, blocks: dict[str, list[str]], depth: int | None = None, lengths: tuple[int, ...] | None = None, block_rows: int = 100_000,
) -> DataFrame:
    """(bloque, ngrama, n, ocurrencias, registros) of every run of codes in the repeated columns.

    blocks maps a name to its numbered columns. Suffixes are ordered by all that a record can hold (depth, by default the number of
    columns), so runs of every length are intervals of one array; lengths names those to give, all by default. Codes are read
    (trimmed, upper case, no-data words missing); missing values between filled columns are passed over. Each task
    cuts its records into blocks of block_rows and builds one suffix array per block, so memory is bounded; as a record
    lies in one block, both counts add up, and a code held by a third of all records is one row per block. A repeated
    record counts each time. Empty tables and columns without codes give no rows; other columns aren't read.
    """
    wanted = [c for cols in blocks.values() for c in cols]
    narrow = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole, k = pa.Table.from_batches(held).combine_chunks(), 0
            for name, cols in blocks.items():
                arrays = [whole.column(k + i).combine_chunks() for i in range(len(cols))]
                arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
                k += len(cols)
                for grams, n, occ, rec in block_counts(arrays, depth or len(cols), lengths):
                    size = len(grams)
                    columns = [pa.repeat(pa.scalar(name, pa.string()), size), grams, pa.repeat(pa.scalar(n, pa.int32()), size), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())]
                    made = pa.RecordBatch.from_arrays(columns, ["bloque", "ngrama", "n", "ocurrencias", "registros"])
                    for at in range(0, size, 50_000):
                        yield made.slice(at, 50_000)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= block_rows:
                yield from flush(held)
                held = []
        if any(b.num_rows for b in held):
            yield from flush(held)

    partial = narrow.mapInArrow(run, COUNTS)
    return partial.groupBy("bloque", "ngrama", "n").agg(F.sum("ocurrencias").alias("ocurrencias"), F.sum("registros").alias("registros"))


def mark_frequencies(counts: DataFrame, total: DataFrame, rare_below: int = 5, common_percent: int = 4) -> DataFrame:
    """Adds marcas: RARO below rare_below records, COMUN above common_percent of all records; both, one or none.

    total has one row and one column, the number of records.
    """
    rare = F.when(F.col("registros") < rare_below, F.lit("RARO"))
    common = F.when(F.col("registros") * 100 > total.scalar() * common_percent, F.lit("COMUN"))
    return counts.withColumn("marcas", F.array_compact(F.array(rare, common)))
