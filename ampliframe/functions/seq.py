"""Sequence functions as columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements, with the IUPAC ambiguity codes; fixed values.
PLAIN, COMPLEMENT = "ACGTMRWSYKVHDBXN-", "TGCAKYWSRMBDHVXN-"
#: What an IUPAC code stands for; fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT"}
IUPAC_N = IUPAC | {"N": "ACGT"}


def complement(s: Column) -> Column:
    return F.translate(F.upper(s), PLAIN, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return complement(F.reverse(s))


def chars(s: Column) -> Column:
    """The characters of s as an array; that of an empty string is empty."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def gc(s: Column) -> Column:
    """Per cent of G and C, to one decimal, ties to the even digit as in the reference semantics."""
    return F.bround(F.lit(100.0) * F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s), 1)


def max_homopolymer(s: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+|N+|-+|R+|Y+)"), F.lit(1)), lambda x: F.length(x))
    return F.coalesce(F.array_max(runs), F.lit(0))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) if i % 2 == 0 else F.split(F.lit(x), "") for kv in table.items() for i, x in enumerate(kv)))


def bases_of(base: Column) -> Column:
    """The bases that a code stands for; ['N'] for any other."""
    return F.coalesce(F.try_element_at(_map(IUPAC), base), F.array(F.lit("N")))


def expand(s: Column, with_n: bool = False) -> Column:
    """All plain sequences that s stands for, sorted; null if a character has no meaning."""
    table = _map(IUPAC_N if with_n else IUPAC)
    step = lambda done, c: F.flatten(F.transform(done, lambda p: F.transform(F.try_element_at(table, c), lambda x: F.concat(p, x))))
    return F.sort_array(F.array_distinct(F.aggregate(chars(s), F.array(F.lit("")), step)))


def neighbours(s: Column) -> Column:
    """s and all sequences with one base exchanged: 3 L + 1 of them, sorted."""
    places = F.sequence(F.lit(1), F.length(s))
    at = F.transform(places, lambda i: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s)))))
    return F.sort_array(F.array_distinct(F.flatten(at)))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches from the 3' end, over the shorter length."""
    return F.size(F.filter(F.arrays_zip(chars(F.reverse(a)).alias("a"), chars(F.reverse(b)).alias("b")), lambda p: (p["a"] != p["b"]).eqNullSafe(True)))


def iupac_hamming(a: Column, b: Column) -> Column:
    """The same, where a place counts only if the codes share no base and neither is N or a blank."""
    code = F.create_map(*(F.lit(x) for k, v in IUPAC.items() for x in (k, sum(1 << "ACGT".index(c) for c in v))))
    apart = lambda p: (F.try_element_at(code, p["a"]).bitwiseAND(F.try_element_at(code, p["b"])) == 0).eqNullSafe(True)
    return F.size(F.filter(F.arrays_zip(chars(F.reverse(a)).alias("a"), chars(F.reverse(b)).alias("b")), apart))


def pairing(a: Column, b: Column) -> Column:
    """For two aligned strands: | where bases pair, . where they do not, blank where either is no base."""
    pair = lambda x, y: F.when(~x.isin(*"ACGT") | ~y.isin(*"ACGT"), " ").when(complement(x) == y, "|").otherwise(".")
    n = F.least(F.length(a), F.length(b))
    return F.array_join(F.zip_with(F.slice(chars(a), F.lit(1), n), F.slice(chars(b), F.lit(1), n), pair), "")


def same_start(a: Column, b: Column) -> Column:
    """Whether one sequence starts with the other."""
    n = F.least(F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)


def chrom_name(s: Column) -> Column:
    return F.translate(s, "/-", "__")


def alignment_text(a: Column, b: Column, offset: Column, score: Column) -> Column:
    """Two primers as they bind: the score, a read forwards, the pairing, and b read backwards, shifted by offset."""
    one, two = F.concat(F.lit("5'-"), a, F.lit("-3' >")), F.concat(F.lit("3'-"), F.reverse(b), F.lit("-5'"))
    one = F.concat(F.repeat(F.lit(" "), F.greatest(offset, F.lit(0))), one)
    two = F.concat(F.repeat(F.lit(" "), F.greatest(-offset, F.lit(0))), two)
    width = F.greatest(F.length(one), F.length(two))
    one, two = F.rpad(one, width, F.lit(" ")), F.rpad(two, width, F.lit(" "))
    return F.concat(F.lit("score: "), F.bround(score, 2).cast("string"), F.lit("\n"), one, F.lit("\n"), pairing(one, two), F.lit("\n"), two, F.lit("\n"))


def match_text(name: Column, primer: Column, genome: Column) -> Column:
    """A primer over the genome's end, both read to the 3' end: | where they are equal, . where not."""
    n = F.least(F.length(primer), F.length(genome))
    last = lambda s: F.substring(s, F.length(s) - n + 1, n)
    marks = F.array_join(F.zip_with(chars(last(primer)), chars(last(genome)), lambda x, y: F.when(x == y, "|").otherwise(".")), "")
    shown = F.substring(genome, F.greatest(F.length(genome) - F.length(primer) + 1, F.lit(1)), F.length(primer))
    return F.concat(F.lit("5'"), primer, F.lit(": "), name, F.lit("<br>5'"), marks, F.lit("<br>5'"), shown)


def mean_gc_off(seqs: Column, rounded: bool = True) -> Column:
    """Mean distance of sequences' share of G and C from a half."""
    share = lambda s: gc(s) / 100 if rounded else F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s)
    return F.aggregate(F.transform(seqs, lambda s: F.abs(F.lit(0.5) - share(s))), F.lit(0.0), lambda a, x: a + x) / F.size(seqs)
