"""Enzyme patterns, residue masses, codon tables, biotypes and the names of variant kinds."""

from __future__ import annotations

import re

# Cleavage after the match of the pattern (public PeptideCutter rules).
ENZYMES = {
    "arg-c": r"R",
    "asp-n": r"\w(?=D)",
    "bnps-skatole": r"W",
    "caspase 1": r"(?<=[FWYL]\w[HAT])D(?=[^PEDQKR])",
    "caspase 2": r"(?<=DVA)D(?=[^PEDQKR])",
    "caspase 3": r"(?<=DMQ)D(?=[^PEDQKR])",
    "caspase 4": r"(?<=LEV)D(?=[^PEDQKR])",
    "caspase 5": r"(?<=[LW]EH)D",
    "caspase 6": r"(?<=VE[HI])D(?=[^PEDQKR])",
    "caspase 7": r"(?<=DEV)D(?=[^PEDQKR])",
    "caspase 8": r"(?<=[IL]ET)D(?=[^PEDQKR])",
    "caspase 9": r"(?<=LEH)D",
    "caspase 10": r"(?<=IEA)D",
    "chymotrypsin high specificity": r"([FY](?=[^P]))|(W(?=[^MP]))",
    "chymotrypsin low specificity": r"([FLY](?=[^P]))|(W(?=[^MP]))|(M(?=[^PY]))|(H(?=[^DMPW]))",
    "clostripain": r"R",
    "cnbr": r"M",
    "enterokinase": r"(?<=[DE]{3})K",
    "factor xa": r"(?<=[AFGILTVM][DE]G)R",
    "formic acid": r"D",
    "glutamyl endopeptidase": r"E",
    "granzyme b": r"(?<=IEP)D",
    "hydroxylamine": r"N(?=G)",
    "iodosobenzoic acid": r"W",
    "lysc": r"K",
    "lysn": r"\w(?=K)",
    "ntcb": r"\w(?=C)",
    "pepsin ph1.3": r"((?<=[^HKR][^P])[^R](?=[FL][^P]))|((?<=[^HKR][^P])[FL](?=\w[^P]))",
    "pepsin ph2.0": r"((?<=[^HKR][^P])[^R](?=[FLWY][^P]))|((?<=[^HKR][^P])[FLWY](?=\w[^P]))",
    "proline endopeptidase": r"(?<=[HKR])P(?=[^P])",
    "proteinase k": r"[AEFILTVWY]",
    "staphylococcal peptidase i": r"(?<=[^E])E",
    "thermolysin": r"[^DE](?=[AFILMV])",
    "thrombin": r"((?<=G)R(?=G))|((?<=[AFGILTVM][AFGILTVWA]P)R(?=[^DE][^DE]))",
    "trypsin": r"([KR](?=[^P]))|((?<=W)K(?=P))|((?<=M)R(?=P))",
}
EXCEPTIONS = {
    "trypsin_exception": r"((?<=[CD])K(?=D))|((?<=C)K(?=[HY]))|((?<=C)R(?=K))|((?<=R)R(?=[HR]))",
}

# Average masses of the free amino acids, and of water, in dalton.
WATER = 18.0153
MASSES = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546,
    "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "O": 255.3134, "P": 115.1305,
    "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "U": 168.0532, "V": 117.1463, "W": 204.2252,
    "Y": 181.1885,
}

# NCBI genetic codes, residues of the 64 codons in TCAG order.
CODON_TABLES = {
    "Standard": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Vertebrate Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    "Yeast Mitochondrial": "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Mold Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Invertebrate Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    "Ciliate Nuclear": "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Echinoderm Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    "Euplotid Nuclear": "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Bacterial": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Alternative Yeast Nuclear": "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Ascidian Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    "Alternative Flatworm Mitochondrial": "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    "Chlorophycean Mitochondrial": "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Trematode Mitochondrial": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
}
CODON_TABLE_ALIASES = {
    "SGC0": "Standard",
    "SGC1": "Vertebrate Mitochondrial",
    "SGC2": "Yeast Mitochondrial",
    "SGC3": "Mold Mitochondrial",
    "SGC4": "Invertebrate Mitochondrial",
    "SGC5": "Ciliate Nuclear",
    "SGC8": "Echinoderm Mitochondrial",
    "SGC9": "Euplotid Nuclear",
}
#: Mitochondrial contigs and what they use where nothing else is said.
MITOCHONDRIAL = ("chrM", "MT")
MITOCHONDRIAL_TABLE, MITOCHONDRIAL_STARTS = "SGC1", ("ATG", "ATA", "ATT")

# Biotypes that are left out of novel ORF calling by default.
EXCLUDED_BIOTYPES = (
    "protein_coding", "Mt_rRNA", "Mt_tRNA", "miRNA", "misc_RNA", "rRNA", "scRNA", "snRNA", "snoRNA", "ribozyme",
    "sRNA", "scaRNA", "Mt_tRNA_pseudogene", "tRNA_pseudogene", "snoRNA_pseudogene", "snRNA_pseudogene",
    "scRNA_pseudogene", "rRNA_pseudogene", "misc_RNA_pseudogene", "miRNA_pseudogene", "artifact", "vaultRNA/vault_RNA",
)

# Types of variant records, and the attributes whose positions are written from 1.
SMALL_TYPES = ("SNV", "SNP", "INDEL", "MNV", "RNAEditingSite")
SPLICING_TYPES = ("Insertion", "Deletion", "Substitution")
POSITION_ATTRS = ("START", "DONOR_START", "ACCEPTER_START", "ACCEPTER_POSITION")
SPLICING_PREFIXES = ("SE", "RI", "A3SS", "A5SS", "MXE")
ALT_TRANSLATION_PREFIXES = ("W2F", "SECT")
SOURCE_NOVEL_ORF, SOURCE_CODON_REASSIGNMENT, SOURCE_SECT = "NovelORF", "CodonReassign", "SECT"


def pattern_of(enzyme: str) -> str:
    return ENZYMES[enzyme] if enzyme in ENZYMES else EXCEPTIONS[enzyme]


def range_pattern(enzyme: str) -> str:
    """The whole stretch that a cleavage rule looks at: its lookarounds taken as ordinary parts."""
    out, pattern = "", pattern_of(enzyme)
    i = 0
    while i < len(pattern):
        m = re.match(r"\(\?<?=", pattern[i:])
        if not m:
            out += pattern[i]
            i += 1
            continue
        depth, j = 1, i + m.end()
        while depth:
            depth += (pattern[j] == "(") - (pattern[j] == ")")
            j += 1
        out += pattern[i + m.end() : j - 1]
        i = j
    return out


def codons(table: str = "Standard") -> dict[str, str]:
    residues = CODON_TABLES[CODON_TABLE_ALIASES.get(table, table)]
    bases = "TCAG"
    return {a + b + c: residues[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}
