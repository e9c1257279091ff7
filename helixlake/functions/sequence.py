"""Column functions on sequences, identifiers and coordinates. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a strict reader accepts (IUPAC without V, and the gap).
ALPHABET = "ACGTURYKMSWBDHNX-"
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq) -> Column:
    """Other characters than A, C, G and T stand for themselves."""
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def definite(base) -> Column:
    return _col(base).isin("A", "C", "G", "T")


def replace_ambiguous(chr_, seq) -> Column:
    """Each character but A, C, G, T becomes a base chosen by a hash of place and sequence."""
    base = F.transform(
        F.split(_col(seq), ""),
        lambda c, i: F.when(definite(c), c).otherwise(F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(_col(chr_), i), F.lit(4)) + 1).cast("int"), F.lit(1))),
    )
    return F.array_join(base, "")


def stripped_id(description) -> Column:
    """Bars and dots become blanks; of exactly five tokens the fourth, else all."""
    flat = F.translate(_col(description), "|.", "  ")
    tokens = F.filter(F.split(flat, " "), lambda x: x != "")
    return F.when(F.size(tokens) == 5, F.element_at(tokens, 4)).otherwise(flat)


def accession(description) -> Column:
    """Of five bar-separated parts the last but one, up to its first dot; else all."""
    parts = F.split(_col(description), r"\|")
    return F.when(F.size(parts) == 5, F.substring_index(F.element_at(parts, -2), ".", 1)).otherwise(_col(description))


def wrapped(seq, width: int = 80) -> Column:
    """Line breaks after every ``width`` characters but none at the end."""
    return F.regexp_replace(_col(seq), "(.{%d})(?=.)" % width, "$1\n")


def conventional_start(sign, start, end) -> Column:
    """1-based, inclusive; on the negative strand start is the larger coordinate."""
    return F.when(_col(sign) > 0, _col(start) + 1).otherwise(_col(end))


def conventional_end(sign, start, end) -> Column:
    return F.when(_col(sign) > 0, _col(end)).otherwise(_col(start) + 1)


def without_gaps(body) -> Column:
    return F.replace(_col(body), F.lit("-"), F.lit(""))


def amino_acid(codon) -> Column:
    """The standard genetic code, codons in the order T, C, A, G of each letter; else X."""
    c = _col(codon)
    number = F.conv(F.translate(c, "TCAG", "0123"), 4, 10).cast("int")
    return F.when(c.rlike("^[TCAG]{3}$"), F.substring(F.lit(_STANDARD), number + 1, F.lit(1))).otherwise(F.lit("X"))


def translated(seq, frame: int = 0) -> Column:
    """Amino acids of a frame (0 to 2) of the sequence as it is.

    The sequence is cut into codons once: a lambda that took them from it would work it
    out, and count it through from its start, for every codon.
    """
    codons = F.regexp_extract_all(F.substring(_col(seq), frame + 1, (1 << 31) - 1), F.lit("(?s)..."), F.lit(0))
    return F.array_join(F.transform(codons, amino_acid), "")


def six_frames(seq) -> Column:
    """Frames 0 to 2 of the sequence, then of its reverse complement."""
    return F.array(*[translated(s, f) for s in (_col(seq), reverse_complement(seq)) for f in range(3)])


def reverse_permutation(p) -> Column:
    return F.reverse(F.transform(_col(p), lambda x: -x))


def contains_run(whole, part) -> Column:
    """Whether ``part`` is a contiguous run of ``whole``; an empty part always is."""
    w, p = _col(whole), _col(part)
    fits = F.exists(F.sequence(F.lit(1), F.greatest(F.size(w) - F.size(p) + 1, F.lit(1))), lambda i: F.slice(w, i, F.greatest(F.size(p), F.lit(1))) == p)
    return F.when(F.size(p) == 0, F.lit(True)).otherwise((F.size(p) <= F.size(w)) & fits)
