"""Nucleotide sequences as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# The standard genetic code in the order of bases T, C, A, G; usual bacterial start codons.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG", "ATT", "CTG")

CODE = dict(zip(map("".join, product(BASES, repeat=3)), AMINO_ACIDS))
STOPS = tuple(k for k, v in CODE.items() if v == "*")
# codons as numbers of base 5, where 4 is any other letter: 1 marks stops, 2 starts
_ORDER, _PAIRED, _KINDS = np.full(256, 4, np.uint8), np.array([2, 3, 0, 1, 4], np.uint8), np.zeros(125, np.uint8)
_ORDER[[ord(c) for c in BASES]] = range(4)
for _codons, _mark in ((STOPS, 1), (STARTS, 2)):
    _KINDS[[25 * BASES.index(k[0]) + 5 * BASES.index(k[1]) + BASES.index(k[2]) for k in _codons]] = _mark


def clean(s: Column) -> Column:
    """Upper case, U as T, letters other than A, C, G and T taken out."""
    return F.regexp_replace(F.replace(F.upper(s), F.lit("U"), F.lit("T")), "[^ACGT]", "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def gc(df: DataFrame, sequence: str, *carried: str) -> DataFrame:
    """Base counts, GC share and melting temperature (base-count rule up to 13 bases, else the length formula)."""
    n = {b: F.length(sequence) - F.length(F.replace(F.col(sequence), F.lit(b), F.lit(""))) for b in "ACGT"}
    length = F.length(sequence)
    strong = n["G"] + n["C"]
    melting = F.when(length > 13, 64.9 + 41 * (strong - 16.4) / length).otherwise(2.0 * (length - strong) + 4.0 * strong)
    return df.select(*carried, length.alias("length"), *(n[b].alias(f"n_{b.lower()}") for b in "ACGT"), F.when(length > 0, strong / length).alias("gc"), F.when(length > 0, melting).alias("melting"))


def gc_windows(df: DataFrame, sequence: str, window: int, *carried: str) -> DataFrame:
    """GC share of windows of at least 10 bases, a quarter of their width apart, at the position of their middle."""
    window = max(10, window)
    step = max(1, window // 4)
    starts = F.when(F.length(sequence) >= window, F.sequence(F.lit(0), F.length(sequence) - window, F.lit(step)))
    rows = df.select(*carried, sequence, F.explode(starts).alias("start"))
    part = F.substring(F.col(sequence), F.col("start") + 1, F.lit(window))
    return rows.select(*carried, (F.col("start") + window // 2).alias("position"), ((window - F.length(F.regexp_replace(part, "[GC]", ""))) / F.lit(float(window))).alias("gc"))


def _amino(codon: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CODE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, codon), F.lit("X"))


def codons(s: Column, frame: int = 1) -> Column:
    """Codons of a frame 1, 2, 3 (or -1, -2, -3 on the other strand)."""
    strand = s if frame > 0 else reverse_complement(s)
    skip = abs(frame) - 1
    # one pass over the text; a substring for each codon would walk the string from its start every time
    return F.regexp_extract_all(F.substring(strand, skip + 1, 1 << 30), F.lit("(?s)..."), 0)


def translate(df: DataFrame, sequence: str, frame: int = 1, to_stop: bool = False, to: str = "protein") -> DataFrame:
    """The protein of a frame; unknown codons are X; up to the first stop if asked."""
    protein = F.array_join(F.transform(codons(F.col(sequence), frame), _amino), "")
    return df.withColumn(to, F.substring_index(protein, "*", 1) if to_stop else protein)


def codon_usage(df: DataFrame, sequence: str, by: list[str], frame: int = 1) -> DataFrame:
    """Codon counts and relative synonymous usage: count times observed synonyms over the amino acid's total."""
    rows = df.select(*by, F.explode(codons(F.col(sequence), frame)).alias("codon")).groupBy(*by, "codon").agg(F.count("*").alias("n")).withColumn("amino_acid", _amino(F.col("codon")))
    w = Window.partitionBy(*by, "amino_acid")
    return rows.where("amino_acid <> 'X'").withColumn("rscu", F.col("n") * F.count("*").over(w) / F.sum("n").over(w).cast("double"))


def _frames(sequence: str, least: int) -> np.ndarray:
    """Rows of (frame, first_base, last_base, amino_acids) of one sequence; other letters are in no codon that is looked for."""
    bases = _ORDER[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]  # one byte a letter
    found = [np.empty((0, 4), int)]
    # T and A, C and G are two apart in BASES
    for sign, strand in ((1, bases), (-1, _PAIRED[bases][::-1])):
        kinds = _KINDS[strand[:-2] * 25 + strand[1:-1] * 5 + strand[2:]]
        for skip in range(3):
            kind = kinds[skip::3]
            stops = np.flatnonzero(kind == 1)
            if not len(stops):
                continue
            starts = np.flatnonzero(kind == 2)
            at = np.searchsorted(starts, np.append(-1, stops[:-1]), side="right")
            first = np.append(starts, len(kinds))[at]
            amino_acids = stops - first
            kept = (amino_acids > 0) & (amino_acids >= least)
            a, b = first[kept] * 3 + skip + 1, stops[kept] * 3 + skip + 3
            ends = (a, b) if sign > 0 else (len(bases) - b + 1, len(bases) - a + 1)
            found.append(np.stack([np.full(len(a), sign * (skip + 1)), *ends, amino_acids[kept]], axis=1))
    return np.concatenate(found)


def orfs(df: DataFrame, sequence: str, key: str, least: int = 30) -> DataFrame:
    """Open reading frames of all six frames: from the first start after a stop to the next stop, unterminated ones left out.

    A sequence is read where it lies; codons are neither listed as rows nor shuffled.
    Positions are 1-based on the given strand; ``least`` is in amino acids without the stop.
    """
    columns = ("frame", "first_base", "last_base", "amino_acids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [_frames(s or "", least) for s in some[1].to_pylist()]
                rows = np.concatenate(found).astype(np.int32)
                of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([some[0].take(pa.array(of)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [key, *columns])

    return df.select(key, F.col(sequence).cast("string")).mapInArrow(run, StructType([df.schema[key], *(StructField(c, IntegerType()) for c in columns)]))


def coverage(intervals: DataFrame, key: str) -> DataFrame:
    """Bases that the union of (first_base, last_base) intervals covers, per key."""
    w = Window.partitionBy(key).orderBy("first_base", "last_base")
    before = F.max("last_base").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last_base") - F.greatest(F.col("first_base") - 1, F.coalesce(before, F.lit(0))))
    return intervals.withColumn("_new", new).groupBy(key).agg(F.sum("_new").alias("covered"))


def kmers(df: DataFrame, sequence: str, by: list[str], k: int = 4, canonical: bool = False) -> DataFrame:
    """Overlapping k-mer counts; canonical ones fold a k-mer and its reverse complement into the lesser."""
    # k passes, each over every k-th position
    parts = F.concat(*(F.regexp_extract_all(F.substring(F.col(sequence), o + 1, 1 << 30), F.lit(f"(?s).{{{k}}}"), 0) for o in range(k)))
    rows = df.select(*by, F.explode(parts).alias("kmer"))
    if canonical:
        rows = rows.withColumn("kmer", F.least("kmer", reverse_complement(F.col("kmer"))))
    return rows.groupBy(*by, "kmer").agg(F.count("*").alias("n"))
