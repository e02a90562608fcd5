"""Symbol alphabets, and column expressions over sequences of symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """``comprises`` maps each ambiguous symbol to the core symbols it may stand for; ``complement`` pairs core symbols."""

    name: str
    core: str
    comprises: dict[str, str]
    aliases: dict[str, str]
    complement: dict[str, str]

    @property
    def symbols(self) -> str:
        return self.core + "".join(self.comprises)

    def complement_of(self, symbol: str) -> str:
        """The complement of a core or ambiguous symbol."""
        if symbol in self.complement:
            return self.complement[symbol]
        want = {self.complement[s] for s in self.comprises[symbol]}
        return next(s for s, c in self.comprises.items() if set(c) == want)

    def expand(self, symbol: str) -> str:
        return symbol if symbol in self.core else self.comprises[self.aliases.get(symbol, symbol)]


# The standard nucleotide and amino acid codes (IUPAC).
IUPAC = {"W": "AT", "S": "CG", "M": "AC", "K": "GT", "R": "AG", "Y": "CT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
DNA = Alphabet("DNA", "ACGT", IUPAC, {"U": "T", "X": "N", ".": "N"}, {"A": "T", "C": "G", "G": "C", "T": "A"})
RNA = Alphabet("RNA", "ACGU", {k: v.replace("T", "U") for k, v in IUPAC.items()}, {"T": "U", "X": "N", ".": "N"}, {"A": "U", "C": "G", "G": "C", "U": "A"})
AMINO = "ACDEFGHIKLMNPQRSTVWY"
PROTEIN = Alphabet("PROTEIN", AMINO, {"B": "DN", "Z": "EQ", "J": "IL", "X": AMINO}, {"*": "X", ".": "X"}, {})
#: The standard genetic code, codons in the order TCAG of each position.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def guess_alphabet(counts: dict[str, int]) -> Alphabet:
    """The alphabet whose core symbols cover most of the counts; DNA before RNA before protein where they tie."""
    cover = lambda a: sum(n for s, n in counts.items() if s.upper() in a.core)
    total = sum(counts.values())
    return next((a for a in (DNA, RNA) if cover(a) >= 0.9 * total), PROTEIN)


def parse_alphabet(text: str) -> Alphabet:
    """An alphabet definition: a header ``ALPHABET "name"``; ``A ~ T`` for complementary core symbols, ``A`` for one without;
    ``R = AG`` for ambiguous ones and, of one symbol, aliases. Quoted names and colours are passed over."""
    import re

    name, core, pairs, comprises, aliases = "", [], {}, {}, {}
    for line in text.splitlines():
        line = re.sub(r'"[^"]*"', lambda m: m.group() if line.startswith("ALPHABET") else "", line.split("#")[0]).strip()
        line = re.sub(r"(?<=\S)\s+[0-9A-Fa-f]{6}\b", "", line)
        if not line:
            continue
        if line.startswith("ALPHABET"):
            name = (re.search(r'"([^"]*)"', line) or [None, ""])[1]
        elif "~" in line:
            a, b = (x.strip()[0] for x in line.split("~"))
            core += [a, b]
            pairs |= {a: b, b: a}
        elif "=" in line:
            a, b = (x.strip() for x in line.split("="))
            if len(b) == 1:
                aliases[a] = b
            else:
                comprises[a] = b
        else:
            core.append(line[0])
    return Alphabet(name, "".join(dict.fromkeys(core)), comprises, aliases, pairs)


def reverse_complement(seq: str | Column, alphabet: Alphabet = DNA) -> Column:
    own = alphabet.symbols + "".join(s.lower() for s in alphabet.symbols)
    other = "".join(alphabet.complement_of(s) for s in alphabet.symbols)
    return F.translate(F.reverse(seq), own, other + other.lower())


def canonical(word: Column, alphabet: Alphabet = DNA) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(word, reverse_complement(word, alphabet))


def encode(seq: str | Column, alphabet: Alphabet = DNA) -> Column:
    """array<int> of core indexes from 0; -1 for anything else."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(alphabet.core) for x in (s, i)])
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.transform(F.filter(F.split(F.upper(col), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1)))


def core_only(seq: str | Column, alphabet: Alphabet = DNA) -> Column:
    """The core symbols of a text, upper-cased; all else is dropped."""
    return F.regexp_replace(F.upper(seq), f"[^{alphabet.core}]+", "")


def is_core(word: Column, alphabet: Alphabet = DNA) -> Column:
    return ~word.rlike(f"[^{alphabet.core}]")


def hard_mask(seq: str | Column, symbol: str = "N") -> Column:
    return F.regexp_replace(seq, "[a-z]", symbol)


def words(seq: str | Column, k: int) -> Column:
    """All overlapping words of ``k`` symbols, in order, in one pass over the sequence."""
    return F.regexp_extract_all(F.col(seq) if isinstance(seq, str) else seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def codons(seq: str | Column, frame: int = 0) -> Column:
    return F.regexp_extract_all(F.substring(seq, frame + 1, 2**30), F.lit("[A-Za-z]{3}"), F.lit(0))


def translate_dna(seq: str | Column, frame: int = 0) -> Column:
    """Protein of a reading frame from 0 to 2; codons with a non-core symbol give X."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.array_join(F.transform(codons(seq, frame), lambda c: F.coalesce(F.try_element_at(table, F.upper(c)), F.lit("X"))), "")


def iupac_regex(pattern: str, alphabet: Alphabet = DNA) -> str:
    """A regular expression for a pattern of core and ambiguous symbols."""
    return "".join(s if s in alphabet.core else f"[{alphabet.expand(s)}]" for s in pattern.upper())


def gc_content(seq: str | Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GCgc]", "")) / n)


def centred(seq: Column, length: int) -> Column:
    """The ``length`` symbols in the middle; shorter sequences stay as they are."""
    return F.when(F.length(seq) <= length, seq).otherwise(F.substr(seq, ((F.length(seq) - length) / 2).cast("int") + 1, F.lit(length)))
