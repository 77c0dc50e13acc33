"""Column functions on sequences; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the ambiguity codes, in the same order.
AMBIGUOUS = "acgtnrykmbdhvswACGTNRYKMBDHVSW"
COMPLEMENTS = "tgcanyrmkvhdbswTGCANYRMKVHDBSW"


def clean(text: Column) -> Column:
    """Bases of a text as a reader of sequence files takes them: others are dropped, n is read as a."""
    return F.translate(F.regexp_replace(text, "[^ACGTNacgtn]", ""), "ACGTNn", "acgtaa")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgt", "tgca"))


def reverse_complement_ambiguous(seq: Column) -> Column:
    """With ambiguity codes, keeping case."""
    return F.reverse(F.translate(seq, AMBIGUOUS, COMPLEMENTS))


def is_canonical(seq: Column) -> Column:
    return seq < reverse_complement(seq)


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def encode(seq: Column) -> Column:
    """Bases as digits 0 to 3."""
    return F.translate(seq, "acgt", "0123")


def decode(digits: Column) -> Column:
    return F.translate(digits, "0123", "acgt")


def kmer_number(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a number, two bits a base."""
    return F.conv(encode(kmer), 4, 10).cast("long")


def kmer_text(number: Column, k: int) -> Column:
    return decode(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"))


def kmer_hash(number: Column, k: int, factor: int) -> Column:
    """(number * factor mod 2**64) >> (64 - 2k), without overflow under ANSI rules."""
    if k <= 15:
        low, high = F.lit(factor & 0xFFFFFFFF), F.lit(factor >> 32)
        upper = (number * high + F.shiftrightunsigned(number * low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftrightunsigned(upper, 32 - 2 * k)
    wide = (number.cast("decimal(19,0)") * F.lit(str(factor)).cast("decimal(19,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.floor(wide / F.lit(str(1 << (64 - 2 * k))).cast("decimal(20,0)")).cast("long")


def is_homopolymer(seq: Column) -> Column:
    return seq.rlike("^(a+|c+|g+|t+)$")


def packed(seq: Column) -> Column:
    """Two bits a base in bytes, first base in the highest bits; a last byte is filled up with a."""
    filled = F.concat(encode(seq), F.repeat(F.lit("0"), F.pmod(-F.length(seq), F.lit(4)).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), (F.length(filled) / 2).cast("int") - 1), lambda i: F.conv(F.substring(filled, i * 2 + 1, F.lit(2)), 4, 16))
    return F.when(F.length(seq) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(pairs, "")))


def unpacked(data: Column, length) -> Column:
    """The first ``length`` bases of packed data."""
    both = F.array(*[F.lit(a + b) for a in "acgt" for b in "acgt"])
    digits = F.hex(data)
    bases = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.element_at(both, F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("int") + 1))
    return F.when(F.length(data) == 0, F.lit("")).otherwise(F.substring(F.array_join(bases, ""), F.lit(1), F.lit(length) if isinstance(length, int) else length))


def reverse_complement_packed(data: Column, length) -> Column:
    """The reverse complement of packed bases, packed."""
    return packed(reverse_complement(unpacked(data, length)))


def with_runs(seq: Column) -> tuple[Column, Column]:
    """(bases, runs): n read as a, and what was read so as an array of (start, end), half-open."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1))), lambda i: F.lower(F.substring(seq, i, F.lit(1))) == "n")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(runs, i):
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["start"].alias("start"), i.alias("end"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] == i - 1), grown).otherwise(F.concat(runs, F.array(F.struct((i - 1).alias("start"), i.alias("end")))))

    return clean(seq), F.when(F.length(seq) == 0, none).otherwise(F.aggregate(starts, none, add))


def only_bases(seq: Column) -> Column:
    """Whether there is nothing but a, c, g and t in either case."""
    return ~seq.rlike("[^ACGTacgt]")


#: Amino acids in the order of their numbers; b, x and z have the number behind the last.
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def amino_text(seq: Column) -> Column:
    """Amino acids in capitals, b and z as X; other letters are dropped."""
    return F.translate(F.regexp_replace(F.upper(seq), f"[^{AMINO}BXZ]", ""), "BZ", "XX")


def amino_numbers(seq: Column) -> Column:
    """Amino acids as numbers from 0; 20 for b, x and z; other letters are dropped."""
    letters = F.filter(F.split(amino_text(seq), ""), lambda x: x != "")
    return F.transform(letters, lambda x: F.instr(F.lit(AMINO + "X"), x) - 1)


def first_mismatch(a: Column, b: Column) -> Column:
    """0 if equal, else 1 + the first place in which two sequences of one length differ."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(places, F.lit(0)), F.lit(0))


def quality_bits(quality: Column, threshold: int) -> Column:
    return F.transform(quality, lambda q: q >= threshold)


def quality_from_bits(bits: Column, low: int = 0, high: int = 40) -> Column:
    return F.transform(bits, lambda b: F.when(b, F.lit(high)).otherwise(F.lit(low)))


def mean_quality(quality: Column) -> Column:
    """Null for a read without qualities."""
    return F.aggregate(quality, F.lit(0.0), lambda s, q: s + q) / F.nullif(F.size(quality), F.lit(0))


def index_ranges(text: str) -> list[tuple[int, int]]:
    """``x[-y](,x[-y])*`` as half-open ranges; a single x is [x, x + 1)."""
    out = []
    for part in text.split(","):
        first, dash, last = part.partition("-")
        if not first.isdigit() or (dash and not last.isdigit()):
            raise ValueError(f"not an index list: {text}")
        low = int(first)
        high = int(last) if dash else low + 1
        if high <= low:
            raise ValueError(f"empty range: {part}")
        out.append((low, high))
    return out
