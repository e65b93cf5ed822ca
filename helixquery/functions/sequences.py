"""Nucleotide sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: How letters stand for bases where a table has prose in place of sequences.
AS_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def from_prose(text: Column) -> Column:
    """A sequence made of a text's letters a-z."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), LETTERS, AS_BASES)


def normalised(text: Column) -> Column:
    """Bases of a FASTA-like text: header, comment and blank lines go, U is T, ambiguity codes are N, the rest goes."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike("^[>;]") & (F.trim(x) != ""))
    return F.translate(F.regexp_replace(F.translate(F.array_join(lines, ""), LETTERS, LETTERS.upper()), "[^ACGTNURYSWKMBDHV]", ""), "URYSWKMBDHV", "TNNNNNNNNNN")


def reverse_complement(s: Column) -> Column:
    """Letters other than ACGT become N."""
    return F.translate(F.regexp_replace(F.reverse(s), "[^ACGT]", "N"), "ACGT", "TGCA")


def packed(s: Column) -> Column:
    """Two bits a base (A=0 C=1 G=2 T=3) of up to 32 bases (32 use the sign's bit as well); null if another letter occurs."""
    digits = F.translate(s, "ACGT", "0123")
    return F.when(s.rlike("^[ACGT]{1,32}$"), F.conv(digits, 4, -10).cast("long"))


def unpacked(x: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def hamming(a: Column, b: Column) -> Column:
    """Differing bases of two packed sequences of one length."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def mismatch_positions(a: Column, b: Column, k: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substr(a, i + 1, F.lit(1)) != F.substr(b, i + 1, F.lit(1)))


def pam(kmer: Column) -> Column:
    return F.when(kmer.endswith("GG"), "NGG").when(kmer.startswith("TTT"), "TTTN").otherwise("none")


def is_tttv(kmer: Column, pam_type: Column) -> Column:
    return (pam_type == "TTTN") & (F.substr(kmer, F.lit(4), F.lit(1)) != "T")


def longest_run(s: Column, base: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"({base}+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0))


def longest_homopolymer(s: Column) -> Column:
    return F.greatest(*(longest_run(s, b) for b in "ACGT"))


def gc(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s)).otherwise(0.0)


def self_complementary_run(s: Column, n: int) -> Column:
    """Longest run of equal places of a sequence of n bases and its reverse complement, over all offsets."""
    rc = reverse_complement(s)
    places = range(-n + 1, n)

    def equal(offset: int) -> Column:
        a, b = max(0, offset), min(n, n + offset)
        x, y = F.substr(s, F.lit(a + 1), F.lit(b - a)), F.substr(rc, F.lit(a - offset + 1), F.lit(b - a))
        marks = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, "1").otherwise("0"))
        return longest_run(F.array_join(marks, ""), "1")

    return F.greatest(*(equal(o) for o in places))


#: Nearest-neighbour enthalpies (cal/mol) and entropies (cal/mol/K) of DNA duplexes: fixed published values.
NN_DH = {"AA": -7900, "AC": -8400, "AG": -7800, "AT": -7200, "CA": -8500, "CC": -8000, "CG": -10600, "CT": -7800, "GA": -8200, "GC": -9800, "GG": -8000, "GT": -8400, "TA": -7200, "TC": -8200, "TG": -8500, "TT": -7900}
NN_DS = {"AA": -22.2, "AC": -22.4, "AG": -21.0, "AT": -20.4, "CA": -22.7, "CC": -19.9, "CG": -27.2, "CT": -21.0, "GA": -22.2, "GC": -24.4, "GG": -19.9, "GT": -22.4, "TA": -21.3, "TC": -22.2, "TG": -22.7, "TT": -22.2}
#: Initiation by the base at either end.
INIT_DH = {"A": 2300, "C": 100, "G": 100, "T": 2300}
INIT_DS = {"A": 4.1, "C": -2.8, "G": -2.8, "T": 4.1}


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = [F.lit(float(v)) if i % 2 else F.lit(v) for kv in table.items() for i, v in enumerate(kv)]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def melting_temperature(s: Column, oligo_nm: float = 250.0, na_molar: float = 0.05) -> Column:
    """Celsius, one decimal, of a short oligonucleotide."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    total = lambda t, d: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + _lookup(t, p, d))
    first, last = F.left(s, F.lit(1)), F.right(s, F.lit(1))
    dh = _lookup(INIT_DH, first, 0.0) + _lookup(INIT_DH, last, 0.0) + total(NN_DH, -8000.0)
    ds = _lookup(INIT_DS, first, 0.0) + _lookup(INIT_DS, last, 0.0) + total(NN_DS, -22.0)
    ds = ds + 0.368 * (F.length(s) - 1) * F.log(F.lit(na_molar))
    ct = F.when(s == reverse_complement(s), oligo_nm * 1e-9).otherwise(oligo_nm * 1e-9 / 4)
    return F.bround(dh / (ds + 1.987 * F.log(ct)) - 273.15, 1)
